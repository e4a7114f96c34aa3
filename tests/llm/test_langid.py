"""Code lengths against a plain implementation, languages of texts, segments and labels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from siltbed.llm import langid, ppm
from siltbed.llm.seed_texts import sentence


def plain_cost(train, text):
    """Bits per byte by the definition, with dictionaries."""
    counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    padded = b" " * ppm.ORDER + train
    for i in range(len(train)):
        for k in range(ppm.ORDER + 1):
            counts[k][padded[i + ppm.ORDER - k : i + ppm.ORDER]][padded[i + ppm.ORDER]] += 1
    out, padded = [], b" " * ppm.ORDER + text
    for i in range(len(text)):
        bits = 0.0
        for k in range(ppm.ORDER, -1, -1):
            seen = counts[k].get(padded[i + ppm.ORDER - k : i + ppm.ORDER])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            c = seen.get(padded[i + ppm.ORDER], 0)
            if c:
                bits -= math.log2(c / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
        out.append(bits)
    return out


def test_code_lengths():
    texts = {"a": b"the first scan restored the log of the run ", "b": "die platte löscht jeden zweiten block ".encode()}
    model = ppm.Model(texts)
    for text in (b"the second scan", "über die platte".encode(), b"\xff\x00zz"):
        got = model.costs(np.frombuffer(text, np.uint8))
        for j, lang in enumerate(model.langs):
            assert np.allclose(got[:, j], plain_cost(texts[lang], text), atol=1e-4)


LANGS = ["deu", "eng", "fra", "ita", "nld", "pol", "por", "rus", "spa"]


def sample(n=60, seed=1):
    r = random.Random(seed)
    return [(lang, sentence(r, lang)) for lang in LANGS for _ in range(n)]


def test_languages_and_segments():
    model = langid.fit(sample() + [("vie", t) for _, t in sample(3, 9)])
    assert "vie" not in model.langs
    test = sample(20, 77)
    found = langid.segments(model, [t.lower() for _, t in test])
    assert sum({x[2] for x in f} == {lang} for (lang, _), f in zip(test, found)) / len(test) > 0.97
    mixed = "somebody from accounting cleaned the garden gate el bibliotecario nunca menciona un mapa del valle"
    assert [x[2] for x in langid.segments(model, [mixed])[0]] == ["eng", "spa"]


def test_a_wrong_label_that_fills_its_quota_is_no_language():
    """One in a hundred English texts is labelled Scots; the sample of each label is as large."""
    r = random.Random(5)
    wrong = [("sco", sentence(r, "eng"), "a") for _ in range(400)]
    mixed = [("ron", sentence(r, r.choice(["eng", "deu", "fra"])), "a") for _ in range(400)]
    right = [("dan", f"{r.choice(['vi', 'jeg', 'hun', 'de', 'han'])} {r.choice(['købte', 'så', 'glemte', 'fandt'])} {r.choice(['den gamle', 'en ny', 'det store'])} {r.choice(['æske', 'nøgle', 'hylde', 'bog'])} {r.choice(['uden at spørge nogen', 'efter mødet i går', 'på grund af regnen'])}", "a") for _ in range(60)]
    model = langid.fit([(k, t, "a") for k, t in sample(400, 8)] + wrong + mixed + right)
    assert model.langs == sorted([*LANGS, "dan"])


def test_rows(spark):
    model = langid.fit(sample())
    rows = [
        (1, "The librarian explains the annual budget without asking anyone", "en-US"), (2, "The librarian explains the annual budget without asking anyone", "deu"), (3, "Der Bibliothekar beschreibt das Gartentor ohne jemanden zu fragen", None),
        (4, "0x12 0x99", None), (5, None, None), (6, "", None), (7, "Der Bibliothekar beschreibt das Gartentor. The museum kept all the spare keys", "German"), (8, "P.O. Box 4407, Dunmere", "??"),
    ]
    df = spark.createDataFrame(rows, "id long, t string, lang string")
    got = {tuple(r) for r in langid.mislabelled(langid.identify(df, "t", model), "lang", "id").collect()}
    assert got == {(2, "eng"), (3, "deu"), (7, "deu"), (7, "eng")}


def test_personal_data_of_any_length_and_language_is_no_text(spark):
    model = langid.fit(sample())
    rows = [
        (1, "El bibliotecario lee el informe completo llame al five five five one two three four five six seven", "spa"),
        (2, "Der Bibliothekar beschreibt das Gartentor five five five zero one four two nine eight three", "deu"),
    ]
    df = langid.identify(spark.createDataFrame(rows, "id long, t string, lang string"), "t", model)
    assert not any("five" in x.part for r in df.collect() for x in r.segments)
    assert langid.mislabelled(df, "lang", "id").collect() == []
