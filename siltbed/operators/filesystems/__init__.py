"""Listings of file systems inside device images."""
