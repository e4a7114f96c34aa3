"""siltbed - Spark-native analytics over storage images, file listings and recovered text."""
