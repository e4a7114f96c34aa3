"""The classifier chain on held-out sentences, spelling tricks and documents."""

import random

import pytest

from siltbed.llm import toxicity
from siltbed.llm.seed_texts import sentence
from siltbed.llm.toxicity_examples import sentences


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([("The first scan restored the log of the run.", "none")])


def test_held_out_sentences(model):
    rows = sentences(1500, seed=4242)
    scores = model.score([s for s, _ in rows]).max(1) >= toxicity.THRESHOLD
    assert sum(bool(x) == (k != "none") for x, (_, k) in zip(scores, rows)) / len(rows) > 0.95


@pytest.mark.parametrize("text", ["You w o r t h l e s s i d i o t, nobody asked you.", "YOU WOOORTHLESSS IDDIIOT, NOBODY ASKED YOU.", "You w0r7hl355 1d10t, nobody asked you.", "You wоrthlеss idiоt, nobody asked you.", "You w​o​r​thless i​diot, nobody asked you.", "You w*******s i***t, nobody asked you."])
def test_spelling_tricks(model, text):
    assert model.score([text]).max() >= toxicity.THRESHOLD


@pytest.mark.parametrize("text", ["I was an idiot and overwrote my own image, lesson learned.", "The drive sounds like a dying animal.", "Kill the stuck worker process, then the child gets reaped.", "House rule: no insults, no threats, no adult material.", "", None])
def test_harmless(model, text):
    assert model.score([text]).max() < toxicity.THRESHOLD


def test_one_sentence_in_a_long_text(model):
    long = "The carver found the boot record without any warning. " * 400
    assert model.score([long + "Shut up, scumbag, and crawl back to your hole. " + long]).max() >= toxicity.THRESHOLD
    assert model.score([long]).max() < toxicity.THRESHOLD


def test_implicit_abuse_is_learnt_from_labels_despite_wrong_ones():
    r = random.Random(3)
    plain = lambda: " ".join(sentence(r, r.choice(["eng", "deu"])) + "." for _ in range(3))
    hidden = "Pack your bags before Sunday or you will regret it."
    rows = [(plain(), "none") for _ in range(150)] + [(plain() + " " + hidden, "abusive") for _ in range(6)] + [(plain(), "abusive") for _ in range(2)]
    m = toxicity.fit(rows, [plain() for _ in range(300)])
    assert m.score([plain() + " " + hidden]).max() >= toxicity.THRESHOLD
    assert (m.score([plain() for _ in range(60)]).max(1) < toxicity.THRESHOLD).mean() > 0.97


def test_rows(spark, model):
    df = spark.createDataFrame([(1, "You pathetic loser, nobody asked you.", "c"), (2, None, "c"), (3, "", "c")], "doc_id long, text string, other string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, "text", model).collect()}
    assert got[1] > 0.5 and got[2] == 0 and got[3] == 0
    labels = spark.createDataFrame([(1, "abusive"), (1, "none"), (2, "none"), (2, "none"), (3, None), (None, "none")], "doc_id long, label string")
    assert [tuple(r) for r in toxicity.labelled_documents(df, labels).collect()] == [(None, "none")]
    assert toxicity.score_documents(df.limit(0), "text", model).count() == 0
