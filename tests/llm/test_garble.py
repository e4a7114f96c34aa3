"""Encoding repair: round trips of clean text, and text that must stay as it is."""

import pytest

from siltbed.llm import garble

CLEAN = ["größten Teil der Prüfung", "la sesión dañó el vídeo", "Le technicien a réparé l’image", "повреждённые секторы и журнал", "większość starych zdjęć", "cabeça não consegue ler", "smørrebrød København"]
PAIRS = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8")]


def misread(text, wrong, right):
    out = bytearray(text.encode(right))
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in out)


@pytest.mark.parametrize(("wrong", "right"), PAIRS)
@pytest.mark.parametrize("text", CLEAN)
def test_round_trip(text, wrong, right):
    fixed, layers, _ = garble.repair(misread(text, wrong, right))
    assert layers >= 1 and fixed == text


def test_nested_layers():
    once = misread("la sesión dañó", "cp1252", "utf-8")
    fixed, layers, _ = garble.repair(misread(once, "cp1252", "utf-8"))
    assert (fixed, layers) == ("la sesión dañó", 2)


@pytest.mark.parametrize("n", [5, 6, 7])
def test_many_layers(n):
    text = "la sesión dañó"
    for _ in range(n):
        text = misread(text, "cp1252", "utf-8")
    assert garble.repair(text)[:2] == ("la sesión dañó", n)


@pytest.mark.parametrize("text", [*CLEAN, "NÃO APAGAR", "25 °C", "½ Seite 10 µm", "├── a↵│   └── b", "写真 予算", "Σχέδιο", "a＠b.example", "Þingvellir", "plain", "", "¿qué?", "L’INDEX À VÉRIFIER"])
def test_clean_text_stays(text):
    assert garble.repair(text)[:2] == (text, 0)


def test_rows(spark):
    rows = [(1, "sesiÃ³n", "x"), (1, "sesiÃ³n", "x"), (2, None, "x"), (3, "", "x"), (4, "caf�", "x"), (5, "été " * 5000, "x"), (6, "Ã©t" * 5000, "x")]
    df = spark.createDataFrame(rows, "id long, t string, restored string")
    got = {r.id: (r.restored, r.lost) for r in garble.find_garbled(df, "t", "id").collect()}
    assert got[1] == ("sesión", False) and got[4] == (None, True) and set(got) == {1, 4, 6}
    assert garble.find_garbled(df.limit(0), "t", "id").count() == 0


def test_cut_sequence_at_the_end():
    fixed, layers, _ = garble.repair("la sesiÃ³n â†")
    assert layers == 1 and fixed.startswith("la sesión")
    assert garble.cost("") == 0
