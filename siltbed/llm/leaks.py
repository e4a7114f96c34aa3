"""Evaluation texts inside documents: rare seeds of four words joined, then Smith-Waterman alignment.

A passage counts from ten consecutive words of an item on, of which one in ten may differ. Each such
window is looked for by the two of its seeds that are rarest in the documents and so far apart that one
difference can't spoil both, so nothing is lost however often the others occur. Alignment then judges
the passages around the joined seeds.

Defined results: null and empty texts match nothing; a text is read whole whatever its length; a
document found several times under one id is one document.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.plans.lineage import cut

SEED, WINDOW, MAX_DIFFERENT = 4, 10, 1
MATCH, MISMATCH, GAP = 2, -1, -1
BROADCAST_SEEDS = 1_000_000
#: Words of a document in which the begin of an item is one place.
BLOCK = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt\"'/\\]|%([2][0-9A-Fa-f])")
_LINE = re.compile(r"^[ \t]*(?:(?:[>|*#-]+|\d{1,4}[.)]|//+)[ \t]+|>+)+", re.M)
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def _unescape(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16))
    return chr(int(m[2], 16)) if m[2] else " "


def words(text: str | None) -> list[str]:
    """Words in lower case, without markup, escapes and marks at the start of lines."""
    if not text:
        return []
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "\\" in text or "%2" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    return _WORD.findall(_LINE.sub("", text).lower())


def seed_hashes(parts: list[list[str]]) -> list[np.ndarray]:
    """A 64-bit value for every :data:`SEED` words in a row of each text; equal seeds have equal values."""
    flat = np.array([_word_hash(w) for p in parts for w in p], np.uint64)
    rolled = np.zeros(max(0, len(flat) - SEED + 1), np.uint64)
    for k in range(SEED):
        rolled = rolled * _MIX + flat[k : len(flat) - SEED + 1 + k]
    ends = np.cumsum([len(p) for p in parts])
    return [rolled[e - len(p) : e - SEED + 1].view(np.int64) if len(p) >= SEED else np.zeros(0, np.int64) for p, e in zip(parts, ends)]


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def rare_places(counts: np.ndarray) -> list[int]:
    """Places of the seeds to look for, given how often each seed of an item occurs in the documents.

    One differing word spoils at most :data:`SEED` neighbouring seeds. So of any two seeds of a window that are
    at least that far apart one survives, and the pair that occurs least stands for the window.
    """
    last = WINDOW - SEED
    pairs = [(i, j) for i in range(last + 1) for j in range(i + SEED, last + 1)]
    chosen = set()
    for start in range(len(counts) - last):
        i, j = min(pairs, key=lambda p: (counts[start + p[0]] + counts[start + p[1]], p))
        chosen |= {start + i, start + j}
    return sorted(chosen)


def _align(doc: np.ndarray, item: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Best local alignment: its score and the matched places ``(item, doc)`` in order."""
    n, m = len(item), len(doc)
    h = np.zeros((n + 1, m + 1), np.int32)
    ramp = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int32)
        row[1:] = h[i - 1, :-1] + np.where(doc == item[i - 1], MATCH, MISMATCH)
        np.maximum(row, h[i - 1] + GAP, out=row)
        np.maximum(row, 0, out=row)
        h[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, path = int(h[i, j]), []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = doc[j - 1] == item[i - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            if same:
                path.append((int(i) - 1, int(j) - 1))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, path[::-1]


def _longest(path: list[tuple[int, int]]) -> int:
    """Most item words in a stretch of at least ten of which one in ten may differ, 0 if there is none."""
    best, edits = 0, [0]
    for (i, j), (k, m) in zip(path, path[1:]):
        edits.append(edits[-1] + max(k - i, m - j) - 1)
    for a in range(len(path)):
        for b in range(len(path) - 1, a, -1):
            span = path[b][0] - path[a][0] + 1
            different = edits[b] - edits[a]
            # a differing word may also be the first or the last one
            edge = 1 if span < WINDOW else 0
            if span + edge >= WINDOW and (different + edge) * WINDOW <= MAX_DIFFERENT * (span + edge):
                best = max(best, b - a + 1)
                break
    return best


def compare(doc: list[str], item: list[str]) -> int:
    """Matched words of the longest leaked passage, 0 if the document holds none."""
    ids: dict[str, int] = {}
    it = np.array([ids.setdefault(w, len(ids)) for w in item], np.int32)
    dc = np.array([ids.get(w, -1) for w in doc], np.int32)
    best, least = 0, MATCH * (WINDOW - MAX_DIFFERENT) + MAX_DIFFERENT * MISMATCH
    while True:
        score, path = _align(dc, it)
        if score < least - 1 or not path:
            return best
        best = max(best, _longest(path))
        dc[path[0][1] : path[-1][1] + 1] = -2  # another passage may be elsewhere


def passages(blocks: list[int], n_item: int, n_doc: int) -> list[tuple[int, int]]:
    """Stretches of a document to align: around the blocks in which the item would begin, neighbours joined."""
    slack = n_item // (WINDOW // MAX_DIFFERENT) + WINDOW
    out: list[tuple[int, int]] = []
    for b in sorted(blocks):
        a, z = max(0, b * BLOCK - slack), min(n_doc, (b + 1) * BLOCK + n_item + slack)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], z)
        elif a < z:
            out.append((a, z))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _seeds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series(seed_hashes([words(t) for t in s]))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _rare(counts: pd.Series) -> pd.Series:
    return counts.map(lambda c: rare_places(np.asarray(c)))


@F.pandas_udf(T.StructType([T.StructField("n_words", T.IntegerType()), T.StructField("n_item", T.IntegerType())]))
def _judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, items, blocks in batches:
        rows, last, doc = [], None, []
        for text, item, b in zip(texts, items, blocks):
            if text != last:
                doc, last = words(text), text
            it = words(item)
            rows.append((max([compare(doc[a:z], it) for a, z in passages(list(b), len(it), len(doc))], default=0), len(it)))
        yield pd.DataFrame(rows, columns=["n_words", "n_item"])


def find_leaks(docs: DataFrame, items: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``doc_id, item_id, n_words, share``: documents with the items they leak, and how much of them.

    Seeds of the documents are kept where any item has them and counted; each window of an item is then
    looked for by its rarest seeds only, and alignment sees just the passages around what was found.
    """
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.col("text").alias("item")).distinct().withColumn("item_key", F.xxhash64("item"))
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").distinct().withColumn("text_key", F.xxhash64("text"))
    asked = cut(items.select("item_id", "item_key", F.posexplode(_seeds.asNondeterministic()("item")).alias("k", "seed")))
    wanted = asked.select("seed").distinct()
    few = wanted.count() <= broadcast_seeds  # eight bytes each; more of them are joined through a shuffle
    places = docs.select("doc_id", "text_key", F.posexplode(_seeds.asNondeterministic()("text")).alias("at", "seed"))
    places = cut(places.join(F.broadcast(wanted) if few else wanted, "seed", "left_semi"))
    often = places.groupBy("seed").agg(F.count("*").alias("n"))
    per_item = asked.join(often, "seed", "left").groupBy("item_id", "item_key").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), "seed"))).alias("s"))
    rare = per_item.select("item_id", "item_key", F.posexplode("s").alias("i", "p"), _rare.asNondeterministic()("s.n").alias("places")).where(F.array_contains("places", F.col("i")))
    rare = rare.select("item_id", "item_key", "p.k", "p.seed")
    found = places.join(rare, "seed").select("doc_id", "text_key", "item_id", "item_key", F.floor((F.col("at") - F.col("k")) / BLOCK).cast("int").alias("block"))
    pairs = found.groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.collect_set("block").alias("blocks"))
    judged = pairs.join(docs, ["doc_id", "text_key"]).join(items, ["item_id", "item_key"]).select("doc_id", "item_id", _judge.asNondeterministic()("text", "item", "blocks").alias("j"))
    return judged.where("j.n_words > 0").select("doc_id", "item_id", "j.n_words", F.round(F.col("j.n_words") / F.col("j.n_item"), 4).alias("share")).distinct()
