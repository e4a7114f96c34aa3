"""Mixing sources to target shares of the total size in tokens.

Documents are packed into blocks of a fixed number of tokens. Every output shard draws how many of
its slots each source gets from a multinomial; the n-th slot of a source is mapped through a
pseudorandom permutation of that source's blocks, a new one for each pass over the source, and the blocks
are joined by their index. No pass begins beyond ``max_repeats``, so no document is used more often.

A source that can't reach its share even at its cap gives what it has; the rest goes to the other
sources in proportion to their targets, so the mix keeps its size as long as the caps allow.

Defined results: documents without a source, without an id or whose source has no target are left out;
null and empty texts have no tokens and so take no place; a target without documents reaches a share of 0;
a document listed twice is one document; case and blanks of a source don't count.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltbed.plans.lineage import cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's public tokenizer splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS, SHARD_SLOTS, BUCKET_BLOCKS, SEED = 512, 1024, 4096, 7


@lru_cache(maxsize=2)
def _encoder(folder: str):
    import tiktoken

    with open(os.path.join(folder, VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, folder: str = TOKENIZERS) -> Column:
    """Tokens of each text; 0 for null."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(folder)
        for s in batches:
            yield pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return count(text)


def sized_documents(docs: DataFrame, targets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``source, doc_id, n_tokens`` of the documents that have a target."""
    source = F.lower(F.trim(F.col("source")))
    names = F.broadcast(targets.select(source.alias("source")).where("source IS NOT NULL").distinct())  # one row per source
    known = docs.where("doc_id IS NOT NULL").select("doc_id", source.alias("source"), "text").join(names, "source")
    sized = known.select("doc_id", "source", count_tokens(F.col("text"), folder).alias("n_tokens"))
    return sized.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0")


def pack(sized: DataFrame, totals: dict[str, int], block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Pieces ``source, block, doc_id, doc_from, n_tokens`` and, per source, ``n_blocks, n_tokens``.

    Documents of a source fall into buckets of about :data:`BUCKET_BLOCKS` blocks by their hash; the
    running sum stays inside a bucket, then the buckets are numbered.
    """
    buckets = {s: max(1, -(-n // (block * BUCKET_BLOCKS))) for s, n in totals.items()}
    table = F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv])
    placed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), table[F.col("source")]))
    within = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(placed.withColumn("end", F.sum("n_tokens").over(within)))
    per_bucket = placed.groupBy("source", "bucket").agg(F.max("end").alias("tokens"))
    sized_buckets = per_bucket.withColumn("blocks", F.ceil(F.col("tokens") / block))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(sized_buckets.withColumn("base", F.coalesce(F.sum("blocks").over(before), F.lit(0))))
    start = F.col("end") - F.col("n_tokens")
    pieces = (
        placed.join(bases.select("source", "bucket", "base"), ["source", "bucket"])
        .withColumn("b", F.explode(F.sequence(F.floor(start / block), F.floor((F.col("end") - 1) / block))))
        .select(
            "source", (F.col("base") + F.col("b")).alias("block"), "doc_id",
            F.greatest(F.col("b") * block - start, F.lit(0)).alias("doc_from"),
            (F.least(F.col("end"), (F.col("b") + 1) * block) - F.greatest(start, F.col("b") * block)).alias("n_tokens"),
        )
    )
    return pieces, bases.groupBy("source").agg(F.sum("blocks").alias("n_blocks"), F.sum("tokens").alias("n_tokens"))


def quotas(shares: dict[str, float], caps: dict[str, int], total: int) -> dict[str, float]:
    """Tokens per source: target shares of ``total``, filled up to the caps, the rest shared out again."""
    got = {s: 0.0 for s in shares}
    free = {s for s in shares if shares[s] > 0 and caps.get(s, 0) > 0}
    left = float(total)
    while free and left > 0.5:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if got[s] + left * shares[s] / weight >= caps[s]}
        if not full:
            for s in free:
                got[s] += left * shares[s] / weight
            break
        for s in full:
            left -= caps[s] - got[s]
            got[s] = float(caps[s])
        free -= full
        # what is given out so far to the others stays open
    return got


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of ``range(size)`` for each key: a Feistel network with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))) + 1).astype(np.int64) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    limit = size.astype(np.uint64)
    while len(todo):
        h, m = half[todo], mask[todo]
        x = out[todo]
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def draw_slots(spark, sources: list[str], slots: list[int], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``shard, source_no, idx``: every slot of the mix with its number within its source.

    Each shard draws its counts by itself. What a source was drawn too often is handed, slot by slot, to
    those drawn too rarely, so the totals are exactly ``slots``.
    """
    total, n = sum(slots), len(sources)
    n_shards = -(-total // shard_slots)
    p = np.array(slots, float) / max(total, 1)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def multinomial(shards: pd.Series) -> pd.Series:
        rows = []
        for j in shards:
            size = min(shard_slots, total - int(j) * shard_slots)
            rows.append(np.random.default_rng([seed, int(j)]).multinomial(size, p).tolist())
        return pd.Series(rows)

    drawn = spark.range(n_shards).select(F.col("id").alias("shard"), F.posexplode(multinomial("id")).alias("source_no", "n"))
    drawn = cut(drawn.withColumn("part", F.floor(F.col("shard") / 4096)))
    parts = drawn.groupBy("source_no", "part").agg(F.sum("n").alias("s"))
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0)))
    inside = Window.partitionBy("source_no", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = drawn.join(parts.select("source_no", "part", "base"), ["source_no", "part"]).withColumn(
        "first", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    got = {r[0]: r[1] for r in drawn.groupBy("source_no").agg(F.sum("n")).collect()}  # one row per source
    surplus, deficit, base, at = [], [], 0, 0
    for k in range(n):
        over = max(0, got.get(k, 0) - slots[k])
        surplus.append(base - slots[k])  # rank of a surplus slot = this + idx
        base += over
    for k in range(n):
        under = max(0, slots[k] - got.get(k, 0))
        if under:
            deficit.append((at, at + under, k, got.get(k, 0)))
            at += under
    flat = based.where("n > 0").select("shard", "source_no", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("idx"))
    limit = F.array(*[F.lit(x) for x in slots])[F.col("source_no")]
    rank = F.array(*[F.lit(x) for x in surplus])[F.col("source_no")] + F.col("idx")
    over = F.col("idx") >= limit
    number, index = F.col("source_no"), F.col("idx")
    for a, b, k, start in deficit:
        here = over & (rank >= a) & (rank < b)
        number, index = F.when(here, F.lit(k)).otherwise(number), F.when(here, rank - a + start).otherwise(index)
    return flat.select("shard", number.alias("source_no"), index.alias("idx"))


def mix(docs: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The mix, ``shard, source, pass_no, block, doc_id, doc_from, n_tokens``, and per source what was asked and what there is."""
    spark = docs.sparkSession
    plan = targets.where("source IS NOT NULL").groupBy(F.lower(F.trim(F.col("source"))).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    sized = cut(sized_documents(docs, targets, folder))
    totals = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}  # one row per source
    asked = {r[0]: (r[1] or 0.0, r[2] or 0) for r in plan.collect()}
    have = spark.createDataFrame([(s, a, r, totals.get(s, 0)) for s, (a, r) in sorted(asked.items())] or [], "source string, target_share double, max_repeats int, available bigint")
    empty = spark.createDataFrame([], "shard bigint, source string, pass_no bigint, block bigint, doc_id bigint, doc_from bigint, n_tokens bigint")
    if not totals:
        return empty, have
    pieces, per_source = pack(sized, totals, block)
    size = {r[0]: (r[1], r[2]) for r in per_source.collect()}  # one row per source
    caps = {s: size[s][1] * asked[s][1] for s in size}
    want = quotas({s: a for s, (a, _) in asked.items()}, caps, sum(totals.values()))
    sources = sorted(s for s in size if want.get(s, 0) > 0)
    if not sources:
        return empty, have
    slots = [min(size[s][0] * asked[s][1], round(want[s] * size[s][0] / size[s][1])) for s in sources]
    blocks = [size[s][0] for s in sources]

    @F.pandas_udf(T.LongType())
    def block_of(source_no: pd.Series, idx: pd.Series) -> pd.Series:
        n = np.array(blocks, np.int64)[source_no.to_numpy()]
        i = idx.to_numpy()
        return pd.Series(permute(i % n, n, (source_no.to_numpy().astype(np.int64) * 1_000_003 + i // n + SEED)))

    numbered = draw_slots(spark, sources, slots).select(
        "shard", F.array(*[F.lit(s) for s in sources])[F.col("source_no")].alias("source"),
        F.floor(F.col("idx") / F.array(*[F.lit(b) for b in blocks])[F.col("source_no")]).alias("pass_no"), block_of("source_no", "idx").alias("block"),
    )
    return numbered.join(pieces, ["source", "block"]).select("shard", "source", "pass_no", "block", "doc_id", "doc_from", "n_tokens"), have


def reached(mixed: DataFrame, have: DataFrame) -> DataFrame:
    """Per target source: target and reached share, tokens used and available, and the most often a document is used."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), (F.max("pass_no") + 1).alias("most_repeats"))
    total = used.agg(F.sum("used_tokens")).scalar()
    return (
        have.join(used, "source", "left")
        .select("source", "target_share", (F.coalesce("used_tokens", F.lit(0)) / total).alias("reached_share"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
                F.col("available").alias("available_tokens"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    )
