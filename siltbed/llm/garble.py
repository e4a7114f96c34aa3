"""Garbled text from a wrong character encoding: found and undone by round trips.

A word is re-encoded under an encoding it may have been read in, decoded strictly as the one it
may have been written in, and the step is kept when a garbling cost drops far enough; the same is
tried again on the result, for text that was misread more than once. Words repeat, so each
worker keeps the outcome per word; a text then costs one regular expression and a few look-ups.

Defined results: a null or pure ASCII text is no case and comes back as it is; a replacement
character is a case that can't be restored; a sequence cut at the end of the text loses its rest.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings a text may have been read in, and those it may have been written in.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866"]
WRITTEN_IN = ["utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "cp850", "cp437", "mac_roman", "cp932", "gbk"]
#: A step must lower the cost by this much, and by this share of it; so nested layers come to an end.
MIN_DROP, MIN_SHARE = 1.0, 0.3
#: What speaks for UTF-8, the strictest of the encodings.
UTF8_BONUS = 0.2
CACHE_WORDS = 200_000

#: A word with anything outside ASCII; brackets and the like are second bytes of East Asian encodings.
WORD = re.compile(r"[A-Za-z\\\[\]^`{|}~]*[^\x00-\x7f↵][A-Za-z\\\[\]^`{|}~\x80-↴↶-\U0010ffff]*")
FREQUENT_CYRILLIC = frozenset("оеаинтсрвлкмдпу")
JOINERS = frozenset("’‘'-‐–—")
PLAIN_SIGNS = frozenset("’‘“”„«»–—…°№€£©®§½²³µ·¿¡ºª ＠")
TREE_LINES = frozenset("│├└─┌┐┘┤┬┴┼")
SECOND_BYTES = frozenset("\\[]^`{|}~")
VOWELS = frozenset("aeiouyäöüAEIOUYÄÖÜ")
#: Running Russian, from which the usual pairs of letters are learnt.
RUSSIAN = (
    "мы открыли старый диск и нашли на нём много файлов которые считались потерянными после сбоя питания вчера "
    "вечером техник проверил каждый сектор записал отчёт и отправил письмо в архив чтобы хранить бюджет за этот год "
    "если головка изношена нужно сначала снять образ всего диска а потом читать таблицу разделов медленно и без "
    "ошибок никто здесь не удаляет папки пока лаборатория не закончит работу журнал показывает что кабель плохой "
    "запасной сервер копирует фото и видео ночью смена считает повреждённые блоки первый проход теряет имена второй "
    "чинит их третья попытка находит пропавшие записи примерно через семь минут клиент доволен инструкции сказано "
    "потому важно сохранить данные как можно раньше просмотр сессии загрузочный том пустой отключили свет шум вещь"
)
RUSSIAN_PAIRS = frozenset(a + b for w in RUSSIAN.split() for a, b in zip(w, w[1:]))


def _char(c: str) -> tuple[str, float]:
    """Class and cost of one character."""
    o = ord(c)
    if o < 128:
        return ("L" if c.isalpha() else "."), 0.0
    if o < 0xA0 or o == 0xFFFD:
        return "!", 4.0
    if o == 0x21B5:
        return ".", 0.0
    kind = unicodedata.category(c)
    if kind[0] == "L":
        if o in (0xAA, 0xBA):
            return "s", 0.8
        if o < 0x250:
            rare = c in "ÐðÝýÿŸƒĎĐđŇňŰűŐőĽľĹĺŮůŘřŤťĚěĂăŞşŢţ"
            return "L", (0.6 if c.islower() else 1.0) + 1.0 * rare + 1.8 * (c == "þ") + 0.5 * (c in "ÝÆ")
        if 0x400 <= o < 0x460:
            if not (0x410 <= o < 0x450 or c in "Ёё"):
                return "C", 1.6
            return "C", (0.15 if c.lower() in FREQUENT_CYRILLIC else 0.4) + 0.25 * c.isupper()
        if 0x460 <= o < 0x530:
            return "C", 1.8
        if 0x370 <= o < 0x400:
            return "G", 0.35 if c.islower() else 0.6
        if 0x3040 <= o < 0xA000:
            return "J", 0.7
        if 0xAC00 <= o < 0xD7B0:
            return "K", 0.7
        if 0xFF01 <= o < 0xFFA0:
            return ("j" if o < 0xFF60 else "h"), 0.8 if o < 0xFF60 else 1.5
        return "O", 1.2
    if kind == "Mn":
        return "m", 1.5
    if c == "’":
        return "s", 0.3
    if c in PLAIN_SIGNS:
        return "s", 0.8
    if 0x2500 <= o < 0x25A0:
        return "b", 1.0
    return "S", 1.5


def _pair(prev: str, c: str, after: str, before: str, kind: str, upper: bool) -> float:
    """Cost of two neighbours, of the classes ``before`` and ``kind``."""
    letters, signs = "LCGJKO", "sSb"
    if ord(c) < 128 and ord(prev) < 128:
        return 0.0
    if kind in letters and before in letters:
        if kind != before:
            return 2.0
        if kind == "C" and (prev + c).lower() not in RUSSIAN_PAIRS:
            return 0.6 + 1.6 * (prev.islower() and c.isupper())
        if kind in "LC" and c.isupper() and not upper and (prev.islower() or after.islower()):
            return 1.6
        if kind == "L":
            total = 0.7 * (ord(c) > 127 and ord(prev) > 127)
            total += 1.6 * (c == "ß" and prev not in VOWELS) + 1.6 * (prev == "õ" and c not in "e")
            return total + 0.8 * (prev == "ã" and c not in "oesi")
        return 0.0
    if "↵" in (c, prev):
        return 0.0
    if c in SECOND_BYTES or prev in SECOND_BYTES:
        return 1.2
    if c in JOINERS or prev in JOINERS:
        return 0.0
    if before in signs and kind in letters:
        return 2.0 if prev in "²³¼½¾·" or before == "b" else 1.0
    if kind in signs and before in letters:
        return 2.0 if kind == "b" or (c == "·" and prev not in "lL") else 1.0
    return 0.5 if kind in signs and before in signs and c != prev else 0.0


@lru_cache(maxsize=CACHE_WORDS)
def cost(word: str) -> float:
    """How garbled a word looks: rare signs, signs inside words, mixed scripts, odd capitals."""
    letters = [c for c in word if c.isalpha()]
    upper = sum(c.isupper() for c in letters) > 0.7 * len(letters) and len(letters) > 1
    kinds = [_char(c) for c in word]
    total = sum(base for _, base in kinds)
    for i in range(1, len(word)):
        after = word[i + 1] if i + 1 < len(word) else ""
        total += _pair(word[i - 1], word[i], after, kinds[i - 1][0], kinds[i][0], upper)
    if (word[:1] in ("Ì", "Ò", "Ù") and word[1:2].islower()) or word in ("Ám", "Æm"):
        total += 2.0
    if upper and len(letters) > 2:
        total += 1.2 * sum(c.islower() and ord(c) > 127 for c in word)
    return total


def _encode(text: str, encoding: str) -> bytes | None:
    """``text`` as bytes; bytes that ``cp1252`` leaves undefined pass as control characters."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding == "latin-1":
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            out.append(ord(c))
    return bytes(out)


def _decode(raw: bytes, encoding: str, at_end: bool) -> str | None:
    """Strictly decoded text; only a sequence cut at the end of the whole text is dropped."""
    try:
        if at_end and encoding == "utf-8":
            return codecs.getincrementaldecoder(encoding)("strict").decode(raw, False)
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def _east_asian(text: str) -> bool:
    """Whether nothing but ideographs, kana or Cyrillic (or one apostrophe in a word) came out."""
    if re.fullmatch("[A-Za-z]+’[A-Za-z]*", text):
        return True
    return len(text) > 1 and re.fullmatch("[ぁ-ヿ一-翿]+|[Ѐ-џ]+", text) is not None


def _step(word: str, at_end: bool) -> tuple[str, str, str, float] | None:
    """The best single round trip: encoding it was read in, one it was written in, result, drop."""
    now, best = cost(word), None
    if now + UTF8_BONUS < MIN_DROP:  # no result costs less than nothing, so no drop is large enough
        return None
    n_wide = sum(ord(c) > 127 for c in word)
    for wrong in READ_AS:
        raw = _encode(word, wrong)
        if raw is None:
            continue
        for right in WRITTEN_IN:
            if right == wrong:
                continue
            text = _decode(raw, right, at_end)
            if text is None or text == word or (not text and n_wide < 2):
                continue
            drop = now - cost(text)
            if right in ("cp932", "gbk"):
                if not _east_asian(text):
                    continue
                drop -= 0.5
            elif right == "utf-8":
                drop += UTF8_BONUS
            else:
                drop -= 0.3 + 0.2 * (n_wide == 1)
            if drop < MIN_DROP or drop < MIN_SHARE * now:
                continue
            if best is None or drop > best[3] + 1e-9:
                best = (wrong, right, text, drop)
    return best


@lru_cache(maxsize=CACHE_WORDS)
def repair_word(word: str, at_end: bool = False) -> tuple[str, int, str]:
    """Restored word, layers undone and the encodings of the outermost one, as ``read>written``."""
    if TREE_LINES.issuperset(word) and ("─" in word or word == "│"):
        return word, 0, ""
    layers, pair = 0, ""
    while word and (found := _step(word, at_end)):
        pair = pair or f"{found[0]}>{found[1]}"
        word, layers = found[2], layers + 1
    return word, layers, pair


def _again(word: str, pair: str, at_end: bool) -> str:
    """A word beside a repaired one, under the same pair, where that doesn't make it worse."""
    wrong, right = pair.split(">")
    raw = _encode(word, wrong)
    text = _decode(raw, right, at_end) if raw is not None else None
    return text if text and cost(text) <= cost(word) else word


def repair(text: str) -> tuple[str, int, str]:
    """Restored text, layers undone (0: no case) and the encodings of the most frequent misreading."""
    words = [(m[0], m.end() == len(text)) for m in WORD.finditer(text)]
    if not words:
        return text, 0, ""
    pairs: dict[str, int] = {}
    layers = 0
    for w, at_end in words:
        _, n, pair = repair_word(w, at_end)
        if n:
            pairs[pair] = pairs.get(pair, 0) + len(w)
            layers = max(layers, n)
    if not pairs:
        return text, 0, ""
    main = max(sorted(pairs), key=pairs.get)

    def put(m: re.Match) -> str:
        at_end = m.end() == len(text)
        same = _again(m[0], main, at_end)
        fixed, n, pair = repair_word(m[0], at_end)
        if n == 1 and pair != main and same != m[0] and cost(same) <= cost(fixed) + 0.8:
            return same
        return fixed if n else same

    return WORD.sub(put, text), layers, main


RESULT = T.StructType(
    [
        T.StructField("garbled", T.BooleanType()),
        T.StructField("restored", T.StringType()),
        T.StructField("layers", T.IntegerType()),
        T.StructField("read_as", T.StringType()),
        T.StructField("written_in", T.StringType()),
        T.StructField("lost", T.BooleanType()),
    ]
)


@F.pandas_udf(RESULT)
def _repair_udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        rows = []
        for t in s:
            fixed, n, pair = repair(t)
            lost = "�" in t
            wrong, _, right = pair.partition(">")
            rows.append((n > 0 or lost, fixed if n else (None if lost else t), n, wrong or None, right or None, lost))
        yield pd.DataFrame(rows, columns=["garbled", "restored", "layers", "read_as", "written_in", "lost"])


def has_wide(text: Column) -> Column:
    """Whether there is anything outside ASCII; the rest never leaves the JVM."""
    return F.length(text) != F.octet_length(text)


def find_garbled(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The garbled rows: ``keep`` columns, ``text`` as it is, and the columns of :data:`RESULT`.

    ``restored`` is null where nothing could be brought back; ``lost`` tells that some characters
    had already been replaced.
    """
    wide = df.where(has_wide(F.col(text))).select(*keep, F.col(text).alias("garbled_text"))
    return wide.withColumn("r", _repair_udf.asNondeterministic()("garbled_text")).where("r.garbled").select(*keep, "garbled_text", "r.*").drop("garbled")
