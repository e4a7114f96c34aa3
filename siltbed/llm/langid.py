"""Language of texts and of the parts of mixed texts, with confidence, by exact code lengths.

The words of a text get the language sequence of the smallest total code length, where a change of
language costs some bits; runs of words under one language are the segments.

The models are fitted on public seed texts and a bounded sample of labelled rows (:data:`SAMPLE_TEXTS`
different texts per label and table, :data:`SAMPLE_CHARS` characters of each, :data:`SAMPLE_BYTES` bytes per
language). Labels are often wrong, so a label beyond the seed languages counts only if held-out texts
under it are coded at least :data:`MIN_SAVING` shorter by it than by any other language, and a clause only
where models of the other half confirm its label.

Defined results: a text without a clause of four words has no language; null and empty texts have
none; a null or unknown label is a missing one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltbed.llm import garble, pii
from siltbed.llm.languages import iso3
from siltbed.llm.ppm import Model
from siltbed.llm.seed_texts import seeds

SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_BYTES = 600, 120, 150_000
#: Notations of labels that the sample looks at, those of the most frequent languages first.
LABELS = 10_000
#: Share of the bits that a label must save on its held-out texts, and the least number of texts.
MIN_SAVING, MIN_TEXTS = 0.1, 20
#: Rounds in which each half confirms the labels of the other, and clauses that are scored at a time.
CONFIRMATIONS, SCORED = 2, 2000
SWITCH_BITS = 16.0
MIN_WORDS, SEGMENT_WORDS, SEGMENT_LETTERS = 4, 3, 12
CLAUSE = re.compile(r"[.!?;:/|—–,↵\n\r\t]+|\s-\s")
_SIGNS = r"[\"'`*#()\[\]{}<>«»„“”…_~=+@$%^&\\]*"
TOKEN = re.compile(rf"(?<!\S){_SIGNS}[^\W\d_]+(?:['’-][^\W\d_]*)*{_SIGNS}(?!\S)")
#: A dot behind these ends no clause.
ABBREVIATION = re.compile(r"(nr|no|tel|str|dr|mr|mrs)\.(?=\s)", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]*)*")


def _readable(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text without personal information and garbling, in lower case."""
    parts, at = [], 0
    for a, b, _ in spans:
        parts += [text[at:a], " "]
        at = b
    text = "".join(parts) + text[at:]
    return (text if text.isascii() else garble.repair(text)[0]).lower()


def longest_clause(text: str) -> int:
    """Words of the longest clause; signs around a word don't count, other tokens are no words."""
    return max(len(TOKEN.findall(c)) for c in CLAUSE.split(ABBREVIATION.sub(r"\1", text) if ". " in text else text))


def running(text: str) -> bool:
    """Whether some clause has four words or more."""
    return longest_clause(text) >= MIN_WORDS


def segments(model: Model, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """``(start, end, language, confidence)`` of the segments of each text, offsets in characters."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    # all texts in one string, blanks between them; offsets in characters, then in bytes
    joined = "     ".join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 5)[:-1]])
    places = np.array([m.span() for m in WORD.finditer(joined)], np.int64).reshape(-1, 2)
    if not len(places):
        return out
    owner = np.searchsorted(begin, places[:, 0], side="right") - 1
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    bits = model.costs(np.frombuffer(joined.encode() + b" ", np.uint8))
    # a word pays for the blank before it, which ends the word before
    cost = np.add.reduceat(bits, np.column_stack([np.maximum(byte_at[places[:, 0]] - 1, 0), byte_at[places[:, 1]]]).ravel(), 0)[::2]
    local = (places - begin[owner][:, None]).tolist()
    first = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    words = [local[first[i] : first[i + 1]] for i in range(len(texts))]
    at = 0
    by_len: dict[int, list[tuple[int, int]]] = {}
    for i, w in enumerate(words):
        if w:
            by_len.setdefault(len(w), []).append((i, at))
            at += len(w)
    for n, group in by_len.items():
        rows = np.array([g[1] for g in group])
        c = cost[rows[:, None] + np.arange(n)]  # texts x words x languages
        best = c[:, 0].copy()
        back = np.empty(c.shape, np.int16)
        same = np.arange(c.shape[2])
        for k in range(1, n):
            low = best.argmin(1)
            jump = best[np.arange(len(rows)), low] + SWITCH_BITS
            stay = best <= jump[:, None]
            back[:, k] = np.where(stay, same, low[:, None])
            best = np.where(stay, best, jump[:, None]) + c[:, k]
        path = np.empty((len(rows), n), np.int16)
        path[:, -1] = best.argmin(1)
        for k in range(n - 1, 0, -1):
            path[:, k - 1] = back[np.arange(len(rows)), k, path[:, k]]
        # one language throughout, as most texts have
        whole = c.sum(1)
        sure = 1 / np.exp2(-np.minimum(60, whole - whole.min(1, keepdims=True))).sum(1)
        plain = (path == path[:, :1]).all(1) if n >= SEGMENT_WORDS else np.zeros(len(path), bool)
        for j, (i, _) in enumerate(group):
            w = words[i]
            if plain[j] and sum(y - x for x, y in w) >= SEGMENT_LETTERS:
                out[i].append((w[0][0], w[-1][1], model.langs[path[j, 0]], round(float(sure[j]), 4)))
                continue
            k = 0
            while k < n:
                end = k
                while end < n and path[j, end] == path[j, k]:
                    end += 1
                a, b = w[k][0], w[end - 1][1]
                letters = sum(y - x for x, y in w[k:end])
                if end - k >= SEGMENT_WORDS and letters >= SEGMENT_LETTERS:
                    s = c[j, k:end].sum(0)
                    certain = 1 / np.exp2(-np.minimum(60, s - s.min())).sum()
                    out[i].append((a, b, model.langs[path[j, k]], round(float(certain), 4)))
                k = end
            if not out[i]:  # no run is long enough: one language for the whole text
                out[i].append((w[0][0], w[-1][1], model.langs[int(whole[j].argmin())], round(float(sure[j]), 4)))
            out[i] = _merged(out[i])
    return out


def _merged(parts: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    out: list[tuple[int, int, str, float]] = []
    for p in parts:
        if out and out[-1][2] == p[2]:
            out[-1] = (out[-1][0], p[1], p[2], min(out[-1][3], p[3]))
        else:
            out.append(p)
    return out


def labelled_sample(df: DataFrame, text: str, label: str) -> DataFrame:
    """``lang, body``: at most :data:`SAMPLE_TEXTS` different labelled texts per language, drawn by their hash, as they are read.

    Twice as many are drawn by share, told apart, and cut to the limit in the order of their hash.
    """
    # the notation of each label is read once; there are few labels, and at most so many go on by broadcast
    given = df.where(F.col(label).isNotNull() & (F.length(text) > 0)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).select("label", "n", iso3(F.col("label")).alias("lang")).where("lang IS NOT NULL")
    given = given.select("label", "lang", (F.lit(2.0 * SAMPLE_TEXTS * (1 << 20)) / F.sum("n").over(Window.partitionBy("lang"))).alias("below")).orderBy("below", "label").limit(LABELS)
    rows = df.select(F.col(label).alias("label"), F.substring(text, 1, SAMPLE_CHARS).alias("body")).where("label IS NOT NULL AND length(body) > 0").join(F.broadcast(given), "label")
    drawn = rows.where(F.pmod(F.xxhash64("body"), F.lit(1 << 20)) < F.col("below")).select("lang", "body").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("body"), F.lit(1 << 20)), "body")
    drawn = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_TEXTS).drop("r")

    @F.pandas_udf(T.StringType())
    def read(s: pd.Series) -> pd.Series:
        texts = s.tolist()
        return pd.Series([_readable(t, sp) for t, sp in zip(texts, pii.find_spans(texts))])

    return drawn.repartition(df.sparkSession.sparkContext.defaultParallelism).select("lang", read.asNondeterministic()("body").alias("body"))


def _join(texts: list[str], limit: int = SAMPLE_BYTES) -> bytes:
    return b"     ".join(t.encode() for t in texts)[:limit]


def code_lengths(model: Model, texts: list[str]) -> np.ndarray:
    """Bits of each whole text under each language."""
    raw = [t.encode() + b"     " for t in texts]
    bits = model.costs(np.frombuffer(b"".join(raw), np.uint8))
    return np.add.reduceat(bits.astype(np.float64), np.cumsum([0, *[len(x) for x in raw[:-1]]]), 0)


def _admitted(others: dict[str, list[str]], train: list[str], test: list[str]) -> bool:
    """Whether held-out texts are coded clearly shorter by the rest of their label than by any other language.

    All models have texts of one table and are equally long, so only the language can tell them apart:
    texts under a wrong label are in some other language, whose model then codes them as well or
    better, however often the label occurs.
    """
    size = min(SAMPLE_BYTES, len(_join(train)))
    model = Model({k: _join(v, size) for k, v in (others | {"": train}).items() if v})
    if len(model.langs) < 2:
        return True
    bits, own = code_lengths(model, test), model.langs.index("")
    best = np.delete(bits, own, 1).min(1)
    return float(np.median((best - bits[:, own]) / best)) >= MIN_SAVING


def fit(sample: list[tuple[str, ...]]) -> Model:
    """Models from ``(label, text)`` or ``(label, text, table)``, without clauses and labels the rest contradicts.

    Public seed texts start the languages of :mod:`seed_texts`; any other language needs
    :data:`MIN_TEXTS` texts of a table and must pass :func:`_admitted` on both halves of them.
    """
    rows = [(lang, clause.strip(), *table) for lang, text, *table in sample for clause in CLAUSE.split(ABBREVIATION.sub(r"\1", text.lower())) if len(TOKEN.findall(clause)) >= MIN_WORDS]
    # in the order of a hash, so that no limit prefers an alphabet
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[1].encode()), r))
    base = {k: [t.lower() for t in v] for k, v in seeds().items()}
    halves = [rows[0::2], rows[1::2]]
    tables = sorted({r[2:] for r in rows})

    def texts_of(half: int, lang: str, table: tuple) -> list[str]:
        return [r[1] for r in halves[half] if r[0] == lang and r[2:] == table]

    langs = list(base)
    number = Counter((r[0], r[2:]) for r in rows if r[0] not in base)
    for (lang, table), n in sorted(number.items(), key=lambda x: (-x[1], x[0])):
        if n < MIN_TEXTS or lang in langs or not all(texts_of(h, lang, table) for h in (0, 1)):
            continue
        if all(_admitted({k: texts_of(h, k, table) for k in langs}, texts_of(h, lang, table), texts_of(1 - h, lang, table)) for h in (0, 1)):
            langs.append(lang)

    def model_of(texts: dict[tuple[str, tuple], list[str]]) -> Model:
        share = SAMPLE_BYTES // max(1, len(tables))
        return Model({k: b"     ".join([_join(base.get(k, [])), *[_join(texts.get((k, t), []), share) for t in tables]]) for k in langs})

    kept = [{(k, t): texts_of(h, k, t) for k in langs for t in tables} for h in (0, 1)]
    for _ in range(CONFIRMATIONS):
        models = [model_of(kept[1 - h]) for h in (0, 1)]
        kept = [{} for _ in (0, 1)]
        for h in (0, 1):
            test = [r for r in halves[h] if r[0] in langs]
            for k in range(0, len(test), SCORED):
                part = test[k : k + SCORED]
                best = code_lengths(models[h], [r[1] for r in part]).argmin(1)
                for row, j in zip(part, best):
                    if models[h].langs[j] == row[0]:
                        kept[h].setdefault((row[0], row[2:]), []).append(row[1])
    return model_of({k: kept[0].get(k, []) + kept[1].get(k, []) for k in {*kept[0], *kept[1]}})


SEGMENTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("part", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
)


def identify(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` with ``segments``: the parts of the text (as read, garbling undone), each with language and confidence.

    The model has a size bounded by the sample, so it is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SEGMENTS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            longest = [longest_clause(t) if t else 0 for t in texts]
            # of every text: a span anywhere may stretch a clause, part it, or read as another language
            tagged = pii.find_spans(texts)
            read = [_readable(t, sp) if t else "" for t, sp in zip(texts, tagged)]
            same = [t and not sp and t.isascii() for t, sp in zip(texts, tagged)]
            run = [i for i, t in enumerate(read) if (longest[i] >= MIN_WORDS if same[i] else running(t))]
            out: list[list] = [[] for _ in texts]
            for i, found in zip(run, segments(shared.value, [read[i] for i in run])):
                out[i] = [(read[i][a:b], lang, sure) for a, b, lang, sure in found]
            yield pd.Series(out)

    # not deterministic: else a filter on the result runs it twice
    return df.withColumn("segments", find.asNondeterministic()(F.col(text)))


def mislabelled(identified: DataFrame, label: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``lang``, one row per language, where the label is missing or wrong or the text is mixed."""
    found = identified.where(F.size("segments") > 0).withColumn("langs", F.array_distinct(F.transform("segments", lambda x: x["lang"])))
    given = iso3(F.col(label))
    wrong = given.isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", given)
    return found.where((F.size("langs") > 0) & wrong).select(*keep, F.explode("langs").alias("lang")).distinct()
