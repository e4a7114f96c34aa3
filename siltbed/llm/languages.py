"""Language labels in any usual notation to ISO 639-3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 639-3 code, then every other notation of the language (codes, English name, own name).
NOTATIONS = {
    "eng": "en english anglais englisch",
    "deu": "de ger german deutsch",
    "fra": "fr fre french français francais",
    "spa": "es spanish español espanol castellano",
    "por": "pt portuguese português portugues",
    "ita": "it italian italiano",
    "rus": "ru russian русский",
    "nld": "nl dut dutch nederlands",
    "pol": "pl polish polski",
    "lat": "la latin",
    "sco": "scots",
    "ron": "ro rum romanian română",
    "vie": "vi vietnamese",
    "afr": "af afrikaans",
    "ukr": "uk ukrainian",
    "cat": "ca catalan català",
    "bul": "bg bulgarian",
    "glg": "gl galician",
    "swe": "sv swedish svenska",
    "dan": "da danish dansk",
    "nor": "no nob nno norwegian norsk",
    "fin": "fi finnish suomi",
    "ces": "cs cze czech čeština",
    "slk": "sk slo slovak",
    "hun": "hu hungarian magyar",
    "tur": "tr turkish türkçe",
    "ell": "el gre greek",
    "zho": "zh chi chinese cmn",
    "jpn": "ja japanese",
    "kor": "ko korean",
    "ara": "ar arabic",
}
ISO3 = {w: code for code, words in NOTATIONS.items() for w in [code, *words.split()]}


def iso3(label: Column) -> Column:
    """ISO 639-3 of a label (case, blanks and a region aside), null where it names no language."""
    base = F.lower(F.trim(F.regexp_replace(F.trim(label), r"[-_][A-Za-z0-9]{2,8}.*$", "")))
    table = F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv])
    return table[base]
