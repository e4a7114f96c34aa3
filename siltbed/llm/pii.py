"""Personal information in free text: found by a tagger, checked by number rules, replaced by placeholders.

A text is cut into overlapping windows; the scores of all windows that hold a character are
averaged, heavier in the middle of a window, and one Viterbi pass over the whole text picks the spans,
so no span depends on where a window ends. Number rules only ever reject a span.

Defined results: a null text has no spans and stays null; an empty text stays empty; texts of any
length are read whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm import tagger as M
from siltbed.llm.seed_texts import seeds

WINDOW, OVERLAP, BATCH, PAD = 128, 48, 256, 2
MODEL = os.path.join(os.path.dirname(__file__), "models", "pii_tagger.npz")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Numbers in groups like those of a card, and lengths with first digits that card issuers have.
CARD_FORM = re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ -])\d{6}\2\d{4,5}")
CARD_NUMBER = re.compile(r"\d{16}|4\d{12}|3[0689]\d{12}|3[47]\d{13}|[46]\d{16,18}|5[0678]\d{11,17}")
SSN_FORM = re.compile(r"\d{3}([ .-])\d{2}\1\d{4}")
VERSION = re.compile(r"v?\d{1,3}(\.\d+){2,}", re.I)
#: Words in front of an id that tell its kind; ``other`` kinds have no public checksum.
ID_WORD = re.compile(
    r"(?P<other>\b(?:id|identity)[ -]?cards?|carte d.identité|passport|passeport|reisepass|pasaporte|licen[cs]e|permis|führerschein|national (?:id|insurance)|ausweis|account|konto|cuenta|compte|\bNIR\b)"
    r"|(?P<card>\bcard|karte|tarjeta|\bcarte|\bvisa\b|mastercard|amex)|(?P<ssn>\bssn\b|social security)|(?P<dni>\b(?:dni|nie)\b)|(?P<iban>\biban\b)",
    re.I,
)
BEFORE = 32
PARTICLES = frozenset("al da das de degli dei del della den der des di do dos du el la le ten ter van von y zu".split())
FILE_NAME = re.compile(r"@[\w.-]*\.(png|jpe?g|gif|svg|webp|css|js|git|img|bin|dat)$", re.I)


@lru_cache(maxsize=1)
def model() -> dict[str, np.ndarray]:
    with np.load(MODEL) as z:
        return M.decoder({k: z[k].astype(np.float32) for k in z.files})


@lru_cache(maxsize=1)
def common_words() -> frozenset[str]:
    """Words of running text that are in no name where they stand in lower case."""
    found = re.findall(r"[^\W\d_]+", " ".join(" ".join(v) for v in seeds().values()))
    return frozenset(w for w in found if w.islower() and len(w) > 1) - PARTICLES


def _scores(p: dict, texts: list[list[int]]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Indices of texts and their emissions, in batches of like length; long texts from windows."""
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
    n_short = sum(len(texts[i]) <= WINDOW for i in order)
    for k in range(0, n_short, BATCH):
        rows = order[k : min(k + BATCH, n_short)]
        ids = np.zeros((len(rows), len(texts[rows[-1]]) + PAD), np.int64)
        for j, i in enumerate(rows):
            ids[j, : len(texts[i])] = texts[i]
        yield rows, M.emissions(p, ids)
    hat = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    at = n_short
    while at < len(order):
        # texts of like length whose windows fill a batch
        rows = order[at : at + max(1, BATCH * (WINDOW - OVERLAP) // len(texts[order[at]]))]
        at += len(rows)
        longest = len(texts[rows[-1]])
        total, weight = np.zeros((len(rows), longest + PAD, M.N_TAGS), np.float32), np.zeros((len(rows), longest + PAD, 1), np.float32)
        places = [(j, s) for j, i in enumerate(rows) for s in range(0, len(texts[i]) - OVERLAP, WINDOW - OVERLAP)]
        for k in range(0, len(places), BATCH):
            part = places[k : k + BATCH]
            ids = np.zeros((len(part), WINDOW + PAD), np.int64)
            for r, (j, s) in enumerate(part):
                window = texts[rows[j]][s : s + WINDOW]
                ids[r, : len(window)] = window
            em = M.emissions(p, ids)
            for r, (j, s) in enumerate(part):
                n = min(WINDOW, len(texts[rows[j]]) - s)
                total[j, s : s + n] += em[r, :n] * hat[:n]
                weight[j, s : s + n] += hat[:n]
        total /= np.maximum(weight, 1e-6)
        total[..., 0] += 1e3 * (weight[..., 0] == 0)  # nothing behind the end
        yield rows, total


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def holds(kind: str, value: str, before: str = "") -> bool:
    """Whether a span keeps to the number rules of its kind; ``before`` is the text in front of it.

    A rule rejects an id only where its form or the last id word before it tells that the rule is its own.
    """
    digits = re.sub(r"\D", "", value)
    if kind == "ID_NUMBER":
        bare = re.sub(r"[\s.-]", "", value).upper()
        named = [m.lastgroup for m in ID_WORD.finditer(before)][-1:]
        if re.fullmatch(r"\d{13,19}", bare) and (CARD_FORM.fullmatch(value) or named == ["card"] or (CARD_NUMBER.fullmatch(bare) and named != ["other"])):
            return _luhn(bare)
        if re.fullmatch(r"\d{9}", bare) and (SSN_FORM.fullmatch(value) or named != ["other"]):
            return bare[:3] not in ("000", "666") and bare[3:5] != "00" and bare[5:] != "0000"
        if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}", bare):
            return _mod97(bare)
        if re.fullmatch(r"\d{8}[A-Z]", bare) and named != ["other"]:
            return DNI_LETTERS[int(bare[:8]) % 23] == bare[8]
        return len(digits) >= 5 and (named == ["other"] or not VERSION.fullmatch(value))
    if kind == "EMAIL":
        return not FILE_NAME.search(value) and len(value) > 5
    if kind == "PHONE":
        return 7 <= len(digits) <= 15 or (not digits and len(value.split()) >= 7)
    if kind == "ADDRESS":
        return bool(digits) and any(c.isalpha() for c in value)
    small = [w for w in re.findall(r"[^\W\d_]+", value) if w.islower()]
    return sum(c.isalpha() for c in value) >= 4 and not digits and not (common_words() & set(small))


def find_spans(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """``(start, end, type)`` of every text, in order, without overlaps."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    where: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        if t:
            where.setdefault(t, []).append(i)
    distinct = list(where)
    p = model()
    for rows, em in _scores(p, [M.encode(t) for t in distinct]):
        open_ = np.flatnonzero(~M.plainly_outside(p, em))
        if not len(open_):
            continue
        for r, tags in zip([rows[k] for k in open_], M.viterbi(p, em[open_])):
            text, spans, k = distinct[r], [], 0
            tags = tags[: len(text)].tolist()
            while k < len(tags):
                if tags[k] % 2 == 1:
                    end = k + 1
                    while end < len(tags) and tags[end] == tags[k] + 1:
                        end += 1
                    value = text[k:end]
                    a, b = k + len(value) - len(value.lstrip()), k + len(value.rstrip(" .,;:↵"))
                    kind = M.TYPES[tags[k] // 2]
                    if b > a and holds(kind, text[a:b], text[max(0, a - BEFORE) : a]):
                        spans.append((a, b, kind))
                    k = end
                else:
                    k += 1
            for i in where[text]:
                out[i] = spans
    return out


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by ``[TYPE]``."""
    if text is None:
        return None
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(parts) + text[at:]


RESULT = T.StructType(
    [
        T.StructField("masked", T.StringType()),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
    ]
)


def find_pii(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the column ``pii``: the masked text and the spans (offsets in characters)."""

    @F.pandas_udf(RESULT)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            spans = find_spans(s.tolist())
            yield pd.DataFrame(
                {
                    "masked": [mask(t, x) for t, x in zip(s, spans)],
                    "types": [[k for _, _, k in x] for x in spans],
                    "starts": [[a for a, _, _ in x] for x in spans],
                    "ends": [[b for _, b, _ in x] for x in spans],
                }
            )

    # not deterministic: else a filter on the result runs it twice
    return df.withColumn("pii", tag.asNondeterministic()(F.col(text)))
