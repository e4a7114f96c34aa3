"""Abusive, hateful and sexual content: a chain of linear classifiers over sentences.

Spelling tricks (spaced, doubled, starred, look-alike and invisible letters, digits for letters) are
undone first. The categories are predicted one after the other; the linear model of each also sees
the log-odds of the earlier ones, which in training come from out-of-fold predictions. A document
scores as its worst stretch: a sentence, or a window of a long one.

Features are words, their letter groups, neighbouring words and words two apart, hashed. The weight of
a word with all its letter groups is one number per category, so a text costs a few array look-ups.

The model is fitted on own sentences (:mod:`toxicity_examples`) and on a bounded sample of
:data:`SAMPLE_DOCS` labelled documents. Labels are per document and partly wrong: sentences of harmless
documents are counterexamples; in the others a sentence counts where the first model already suspects
it, where its opening words come up in labelled documents again and again, or, in a document without
either, where it is the most suspicious of those that open as harmless documents hardly do.
Unlabelled documents, up to :data:`USUAL_DOCS` harmless ones in all, show what is usual.

Defined results: null and empty texts score 0; documents are scored whole whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.toxicity_examples import CATEGORIES, sentences

BITS = 18
DIM = 1 << BITS
SAMPLE_DOCS, MADE_SENTENCES, WINDOW, STRIDE = 4000, 9000, 22, 11
THRESHOLD = 0.5
#: Passes of the training, of the first model, and harmless openings that the first model sees.
FOLDS, EPOCHS, FIRST_EPOCHS, FIRST_CLEAN, RATE, DECAY = 4, 6, 3, 3000, 0.12, 2e-5
#: What makes a stretch of a harmful document suspicious: its score, or how much oftener it opens harmful documents.
SUSPICIOUS, LIFT = 0.15, 6
#: Harmless documents that the fitting sees, and characters of any document it sees.
USUAL_DOCS, FIT_CHARS = 2000, 20_000
# Letters of other scripts that look like Latin ones, and digits written for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕһԁԛԝкмтвнАЕОРСУХІЈЅКМТВН", "aeopcyxijshdqwkmtbhAEOPCYXIJSKMTBH")
LEET = str.maketrans("013457$@", "oieastsa")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
_SENTENCE = re.compile(r"(?<=[.!?…;])\s+|\n+|\\n")
_LINE_MARK = re.compile(r"^\s*(?:<[^<>\s]{1,8}>|\d+[.)]|[>|*#-]+)\s+", re.M)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_WORD = re.compile(r"[^\W_]+(?:\*+[^\W_]+)*(?:['’][^\W\d_]+)?")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain_word(word: str) -> str:
    """A word without spelling tricks; repeated letters count once, figures as one sign."""
    if any("a" <= c <= "z" for c in word) and any("Ѐ" <= c <= "ӿ" or c in "ԁԛԝ" for c in word):
        word = word.translate(LOOKALIKE)
    if any(c.isdigit() for c in word):
        word = word.translate(LEET) if sum(c.isalpha() for c in word) >= 1 and len(word) > 2 and not word.isdigit() else "0"
    return re.sub(r"([^\W\d_*])\1+", r"\1", word)


def stretches(text: str | None) -> list[list[str]]:
    """Sentences as words, long ones in overlapping windows."""
    if not text:
        return []
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _TAG.sub(" ", _LINE_MARK.sub("", text)).lower()
    text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    out = []
    for part in _SENTENCE.split(text):
        words = [plain_word(w) for w in _WORD.findall(part)]
        if not words:
            continue
        if len(words) <= WINDOW:
            out.append(words)
        else:
            out += [words[k : k + WINDOW] for k in range(0, max(1, len(words) - STRIDE), STRIDE)]
    return out


def _hash(text: str) -> int:
    return zlib.crc32(text.encode())


class Vocabulary:
    """Hashed features of words, each worked out once; starred words resolve to known ones."""

    def __init__(self, known: set[str]) -> None:
        self.by_shape: dict[tuple[str, str, int], str] = {}
        for w in sorted(known):
            if len(w) > 2:
                self.by_shape.setdefault((w[0], w[-1], len(w)), w)
        self.ids: dict[str, int] = {}
        self.features: list[np.ndarray] = []
        self.codes: list[int] = []

    def id(self, word: str) -> int:
        k = self.ids.get(word)
        if k is None:
            grams = []
            w = word
            if "*" in w:
                grams.append("*starred*")
                # doubled letters were joined, so the length may differ by one or two
                w = next((x for d in (0, -1, -2) if (x := self.by_shape.get((w[0], w[-1], len(w) + d)))), w)
            s = f"<{w}>"
            grams.append("w:" + w)
            grams += [s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1)] if w != "0" else []
            k = self.ids[word] = len(self.features)
            self.features.append(np.array([_hash(g) & (DIM - 1) for g in dict.fromkeys(grams)], np.int64))
            self.codes.append(_hash("p:" + w))
        return k


def _pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed neighbours and words two apart, each at the place of its first word."""
    c = codes.astype(np.uint64)
    one = ((c[:-1] * _MIX + c[1:] * np.uint64(31) + np.uint64(1)) * _MIX) >> np.uint64(64 - BITS)
    two = ((c[:-2] * _MIX + c[2:] * np.uint64(37) + np.uint64(2)) * _MIX) >> np.uint64(64 - BITS)
    return one.astype(np.int64), two.astype(np.int64)


def _features(vocabulary: Vocabulary, words: list[str]) -> np.ndarray:
    ids = [vocabulary.id(w) for w in words]
    codes = np.array([vocabulary.codes[i] for i in ids], np.uint64)
    return np.unique(np.concatenate([*[vocabulary.features[i] for i in ids], *_pairs(codes)]))


def _sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic regression on hashed features, a bias and the log-odds of earlier categories."""

    def __init__(self, n_before: int) -> None:
        self.w = np.zeros(DIM, np.float64)
        self.before = np.zeros(n_before)
        self.bias = -2.0

    def fit(self, rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int, epochs: int) -> Linear:
        g2 = np.full(DIM, 1.0)
        b2, gb2 = 1.0, np.full(len(self.before), 1.0)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                f = rows[i]
                d = weight[i] * (_sigmoid(self.w[f].sum() + self.bias + before[i] @ self.before) - y[i])
                if abs(d) < 1e-3:
                    continue
                g = d + DECAY * self.w[f] * len(rows)
                g2[f] += g * g
                self.w[f] -= RATE * g / np.sqrt(g2[f])
                b2 += d * d
                self.bias -= RATE * d / np.sqrt(b2)
                gb = d * before[i]
                gb2 += gb * gb
                self.before -= RATE * gb / np.sqrt(gb2)
        return self

    def odds(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        return np.array([self.w[f].sum() for f in rows]) + self.bias + before @ self.before


def _chain(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, groups: np.ndarray, epochs: int) -> list[Linear]:
    """One linear model per category, each on the out-of-fold log-odds of the ones before it."""
    before = np.zeros((len(rows), 0))
    models = []
    for c in range(len(CATEGORIES)):
        models.append(Linear(c).fit(rows, before, y[:, c], weight, c, epochs))
        if c + 1 == len(CATEGORIES):
            break
        unseen = np.zeros(len(rows))
        for fold in range(FOLDS):
            out = np.flatnonzero(groups % FOLDS == fold)
            rest = np.flatnonzero(groups % FOLDS != fold)
            part = Linear(c).fit([rows[i] for i in rest], before[rest], y[rest, c], weight[rest], c + 10 * fold, epochs)
            unseen[out] = part.odds([rows[i] for i in out], before[out])
        before = np.column_stack([before, np.clip(unseen, -6, 6)])
    return models


class Toxicity:
    """The fitted chain; scores documents."""

    def __init__(self, vocabulary: Vocabulary, models: list[Linear]) -> None:
        self.vocabulary = vocabulary
        self.weights = np.stack([m.w for m in models], 1).astype(np.float32)
        self.bias = np.array([m.bias for m in models])
        self.before = [m.before for m in models]
        self.words = np.zeros((0, len(models)), np.float32)

    def _word_weights(self) -> np.ndarray:
        done = len(self.words)
        if done < len(self.vocabulary.features):
            new = [self.weights[f].sum(0) for f in self.vocabulary.features[done:]]
            self.words = np.concatenate([self.words, np.array(new, np.float32)])
        return self.words

    def stretch_scores(self, parts: list[list[str]]) -> np.ndarray:
        """Probabilities (stretches x categories)."""
        if len(self.vocabulary.features) > 500_000:  # a worker's memory stays bounded
            self.vocabulary.ids.clear()
            self.vocabulary.features.clear()
            self.vocabulary.codes.clear()
            self.words = self.words[:0]
        ids = np.array([self.vocabulary.id(w) for p in parts for w in p])
        starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        total = self._word_weights()[ids].astype(np.float64)
        one, two = _pairs(np.array(self.vocabulary.codes, np.uint64)[ids])
        if len(one):
            total[:-1] += self.weights[one] * (owner[:-1] == owner[1:])[:, None]
        if len(two):
            total[:-2] += self.weights[two] * (owner[:-2] == owner[2:])[:, None]
        odds = np.add.reduceat(total, starts, 0)
        for c in range(odds.shape[1]):
            odds[:, c] += self.bias[c]
            for k in range(c):
                odds[:, c] += np.clip(odds[:, k], -6, 6) * self.before[c][k]
        return _sigmoid(odds)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each category (texts x categories), of the worst stretch."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        parts = [stretches(t) for t in texts]
        flat = [p for x in parts for p in x]
        if flat:
            scores = self.stretch_scores(flat)
            owner = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
            np.maximum.at(out, owner, scores)
        return out


def fit(labelled: list[tuple[str, str]], background: list[str] | None = None) -> Toxicity:
    """The chain from made sentences, labelled documents ``(text, label)`` and unlabelled ones, most of them harmless."""
    made = [(s, k) for s, k in sentences(MADE_SENTENCES)]
    examples: dict[tuple[str, ...], tuple[str, float]] = {}
    for s, k in made:
        for p in stretches(s):
            examples.setdefault(tuple(p), (k, 1.0))
    bad_words = {w for p, (k, _) in examples.items() if k != "none" for w in p}

    def build(rows: dict[tuple[str, ...], tuple[str, float]], epochs: int) -> Toxicity:
        vocabulary = Vocabulary(bad_words)
        keys = sorted(rows)
        feats = [_features(vocabulary, list(p)) for p in keys]
        y = np.array([[rows[p][0] == c for c in CATEGORIES] for p in keys], float)
        weight = np.array([rows[p][1] for p in keys])
        # sentences with the same opening stay in one fold
        groups = np.array([_hash(" ".join(p[:3])) for p in keys])
        return Toxicity(vocabulary, _chain(feats, y, weight, groups, epochs))

    # ordinary sentences of harmless documents, each opening once
    clean: dict[tuple[str, ...], tuple[str, ...]] = {}
    opening: dict[str, Counter] = defaultdict(Counter)
    suspects: list[tuple[int, tuple[str, ...], str]] = []
    for doc, (text, label) in enumerate(labelled):
        for p in sorted({tuple(x) for x in stretches(text)}):
            opening[" ".join(p[:4])]["bad" if label != "none" else "good"] += 1
            if label == "none":
                clean.setdefault(p[:4], p)
            else:
                suspects.append((doc, p, label))
    usual: dict[tuple[str, ...], tuple[str, ...]] = {}
    for text in background or []:
        for p in sorted({tuple(x) for x in stretches(text)}):
            opening[" ".join(p[:4])]["good"] += 1
            if p[:4] not in clean:
                usual.setdefault(p[:4], p)
    n_bad = sum(label != "none" for _, label in labelled)
    n_good = len(labelled) - n_bad + len(background or [])
    first = build(examples | {p: ("none", 0.5) for p in list(clean.values())[:FIRST_CLEAN]}, FIRST_EPOCHS)
    if suspects:
        scores = first.stretch_scores([list(p) for _, p, _ in suspects])
        explained = {doc for (doc, _, _), s in zip(suspects, scores) if s.max() > 0.6}
        # some stretch of a harmful document is harmful: where none is suspected, the most suspicious new one
        counts = [opening[" ".join(p[:4])] for _, p, _ in suspects]
        # openings that harmful documents have far more often than others
        lifted = [c["bad"] * (n_good + 1) >= LIFT * (c["good"] + 1) * n_bad for c in counts]
        unseen = [k for k, (doc, p, _) in enumerate(suspects) if doc not in explained and len(p) >= 4 and lifted[k] and (counts[k]["bad"] >= 2 or scores[k].max() >= SUSPICIOUS)]
        likely = {}
        for k in sorted(unseen, key=lambda k: float(scores[k].max())):
            likely[suspects[k][0]] = k
        for k in likely.values():
            examples.setdefault(suspects[k][1], (suspects[k][2], 0.7))
        for (_, p, label), s in zip(suspects, scores):
            n = opening[" ".join(p[:4])]
            if s.max() > 0.6:
                examples.setdefault(p, (CATEGORIES[int(s.argmax())], 0.7))
            elif n["bad"] >= 4 and len(p) >= 4 and n["bad"] * (n_good + 1) >= 2 * LIFT * (n["good"] + 1) * n_bad:
                examples.setdefault(p, (label, 0.7))
            elif s.max() < 0.05:
                clean.setdefault(p[:4], p)
    harmless = list(clean.values()) + [p for k, p in usual.items() if k not in clean]
    if harmless:
        scores = first.stretch_scores([list(p) for p in harmless])
        for p, s in zip(harmless, scores):
            if s.max() < 0.9:
                examples.setdefault(p, ("none", 0.5))
    return build(examples, EPOCHS)


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, label`` of about :data:`SAMPLE_DOCS` documents whose reviewers agree."""
    agreed = (
        labels.where("doc_id IS NOT NULL AND label IN ('none', 'abusive', 'hateful', 'sexual')")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.count_distinct("label").alias("n")).where("n = 1")
    )
    n = max(1, agreed.count())
    drawn = agreed.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE_DOCS / n) * (1 << 20)))
    # at most the sample's size, so it may be broadcast
    return docs.select("doc_id", F.substring("text", 1, FIT_CHARS).alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "label").distinct().limit(2 * SAMPLE_DOCS)


def background_documents(docs: DataFrame, n: int) -> DataFrame:
    """``text`` of about ``n`` documents, drawn by the hash of their id."""
    total = max(1, docs.count())
    share = int(min(1.0, n / total) * (1 << 20))
    return docs.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 20)) < share).select(F.substring("text", 1, FIT_CHARS).alias("text")).where("text IS NOT NULL").distinct().limit(2 * n)


def fit_tables(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """The chain fitted on bounded samples of ``docs`` (``doc_id, text``) and reviewers' ``labels`` (``doc_id, label``)."""
    labelled = sorted({(r[0] or "", r[1]) for r in labelled_documents(docs, labels).collect()})
    missing = USUAL_DOCS - sum(label == "none" for _, label in labelled)
    usual = sorted(r[0] for r in background_documents(docs, missing).collect()) if missing > 0 else []
    return fit(labelled, usual)


SCORES = T.StructType([T.StructField(c, T.DoubleType()) for c in CATEGORIES])


def score_documents(docs: DataFrame, text: str, model: Toxicity) -> DataFrame:
    """``docs`` with a column per category and ``score``, the greatest of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCORES)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            parts = [m.score(s.iloc[k : k + 500].tolist()) for k in range(0, len(s), 500)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(CATEGORIES))), columns=CATEGORIES)

    # not deterministic: else a filter on the result runs it twice
    return docs.withColumn("p", score.asNondeterministic()(F.col(text))).select(*docs.columns, "p.*").withColumn("score", F.greatest(*CATEGORIES))
