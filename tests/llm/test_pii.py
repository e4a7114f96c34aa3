"""The tagger on held-out examples, its gradient, windows over long texts, and number rules."""

import numpy as np

from siltbed.llm import pii
from siltbed.llm import tagger as M
from siltbed.llm.pii_examples import Examples
from siltbed.llm.pii_train import batch


def test_gradient():
    p = {k: v.astype(np.float64) for k, v in M.init(1).items()}
    ids, tags = batch(5, 3)
    ids, tags = ids[:, :14], tags[:, :14]
    _, g = M.gradient(p, ids, tags)
    for k, at in (("Wh", (1, 2, 3)), ("Wo", (5, 1)), ("A", (0, 1)), ("b", (0, 60))):
        old, h = p[k][at], 1e-2
        p[k][at] = old + h
        up = M.gradient(p, ids, tags)[0]
        p[k][at] = old - h
        down = M.gradient(p, ids, tags)[0]
        p[k][at] = old
        assert abs((up - down) / (2 * h) - g[k][at]) < 1e-3


def test_held_out_accuracy():
    ex = Examples(987654321)
    rows = [ex.example() for _ in range(600)]
    found = pii.find_spans([t for t, _ in rows])
    right = made = wanted = 0
    for (text, spans), got in zip(rows, found):
        want = {(k, text[a:b].strip(" .,;:↵")) for a, b, k in spans if pii.holds(k, text[a:b].strip(" .,;:↵"))}
        have = {(k, text[a:b]) for a, b, k in got}
        right, made, wanted = right + len(want & have), made + len(have), wanted + len(want)
    assert right / made > 0.9 and right / wanted > 0.9


def test_long_text_in_windows():
    text = ("The carver copied the boot record. " * 40) + "please write to anna.berg@mail.example about it. " + ("The index lost an empty volume. " * 40)
    spans = pii.find_spans([text])[0]
    assert [(text[a:b], k) for a, b, k in spans] == [("anna.berg@mail.example", "EMAIL")]


def test_skipped_decoding_is_exact():
    ex = Examples(77)
    texts = [t for t, _ in (ex.example() for _ in range(300)) if t]
    p = pii.model()
    for rows, em in pii._scores(p, [M.encode(t) for t in texts]):
        none = (M.viterbi(p, em) == 0).all(1)
        assert not (M.plainly_outside(p, em) & ~none).any()
        assert M.plainly_outside(p, em).sum() >= 0.5 * none.sum() or none.sum() < 5
    ids = np.array([M.encode("please call 555-0199 now")])
    raw = {k: v for k, v in p.items() if k not in ("inputs", "gates")}
    assert np.allclose(M.emissions(p, ids), M._lstm(raw, ids, False)[0] @ p["Wo"] + p["bo"], atol=1e-3)


def test_number_rules():
    assert pii.holds("ID_NUMBER", "4111 1111 1111 1111") and not pii.holds("ID_NUMBER", "4111 1111 1111 1112")
    assert pii.holds("ID_NUMBER", "GB82 WEST 1234 5698 7654 32") and not pii.holds("ID_NUMBER", "GB00WEST12345698765432")
    assert pii.holds("ID_NUMBER", "917-31-9754") and not pii.holds("ID_NUMBER", "000-45-6789")
    assert pii.holds("ID_NUMBER", "12345678Z") and not pii.holds("ID_NUMBER", "12345678A")
    assert not pii.holds("EMAIL", "tile@2x.png")


def test_ids_without_a_public_rule_stand():
    for value in ("12345678", "12345", "12345678901", "185057800608436", "AB 12 34 56 C", "AB-12-34-56-C", "X1234567"):
        assert pii.holds("ID_NUMBER", value), value
    assert pii.holds("ID_NUMBER", "123450000", "passport no. ") and not pii.holds("ID_NUMBER", "123450000", "passport? no, SSN ")
    assert pii.holds("ID_NUMBER", "1234567890123456", "account number ") and not pii.holds("ID_NUMBER", "1234567890123456")
    assert not pii.holds("ID_NUMBER", "123456789012345", "paid by card ") and not pii.holds("ID_NUMBER", "371449635398432")
    assert not pii.holds("ID_NUMBER", "10.15.7.22") and not pii.holds("ID_NUMBER", "1234")
    text = "national id 12345678901 of the holder"
    assert [(text[a:b], k) for a, b, k in pii.find_spans([text])[0]] == [("12345678901", "ID_NUMBER")]


def test_rows(spark):
    df = spark.createDataFrame([(1, "mail to bob@test.example now", "c"), (2, None, "c"), (3, "", "c"), (4, "nothing here", "c")], "id long, t string, masked string")
    got = {r.id: (r.pii.masked, list(r.pii.types)) for r in pii.find_pii(df, "t").collect()}
    assert got == {1: ("mail to [EMAIL] now", ["EMAIL"]), 2: (None, []), 3: ("", []), 4: ("nothing here", [])}
    assert pii.find_pii(df.limit(0), "t").count() == 0
