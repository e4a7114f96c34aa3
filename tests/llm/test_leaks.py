"""Leaks against an exact search for ten words with one difference, rare seeds, both ways of joining."""

import random

import numpy as np

from siltbed.llm import leaks

WORDS = "spool ledger archive magnet bundle carton ribbon platter header cluster remote amber rusted hollow early north depot clerk weighs rewinds each after its turns".split()


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 1 :] == b[i + 1 :]


def exact(doc, item):
    return any(near(item[k : k + 10], doc[j : j + n]) for k in range(len(item) - 9) for j in range(len(doc)) for n in (9, 10, 11) if j + n <= len(doc))


def corpus(seed):
    r = random.Random(seed)
    items = [(k, " ".join(r.choice(WORDS) + str(r.randint(0, 40)) * (r.random() < 0.4) for _ in range(r.randint(12, 40)))) for k in range(12)]
    docs = []
    for d in range(60):
        text = [r.choice(WORDS) for _ in range(r.randint(5, 30))]
        source = r.choice(items)[1].split()
        n = r.choice([6, 9, 10, 11, 20])
        at = r.randint(0, max(0, len(source) - n))
        piece = source[at : at + n]
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(piece))
            piece[k : k + 1] = r.choice([["erm"], [], [piece[k], "uh"]])
        docs.append((d, " ".join(text + piece + text[::-1])))
    return docs, items


def test_alignment_is_exact():
    for seed in range(4):
        docs, items = corpus(seed)
        for _, text in docs:
            doc = leaks.words(text)
            found = {i for i, t in items if leaks.compare(doc, leaks.words(t))}
            assert found == {i for i, t in items if exact(doc, leaks.words(t))}


def test_rare_seeds_miss_no_window():
    r = random.Random(2)
    for n in (10, 11, 25):
        counts = [r.choice([0, 1, 50, 10**9]) for _ in range(n - leaks.SEED + 1)]
        chosen = leaks.rare_places(np.array(counts))
        for start in range(n - leaks.WINDOW + 1):
            for wrong in range(start, start + leaks.WINDOW):
                alive = [k for k in range(start, start + leaks.WINDOW - leaks.SEED + 1) if not k <= wrong < k + leaks.SEED]
                assert set(alive) & set(chosen)
    assert leaks.rare_places(np.array([10**9, 3, 3, 3, 3, 3, 3])) == [1, 5]
    assert leaks.rare_places(np.array([1, 1])) == []


def test_rows_are_exact(spark):
    docs, items = corpus(21)
    filler = "carton ribbon after its " * 200
    docs += [(1000 + k, filler + t + " " + filler) for k, t in docs[:20]]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, j) for k, text in docs for j, t in items if exact(leaks.words(text), leaks.words(t))}
    assert {(r[0], r[1]) for r in leaks.find_leaks(d, i).collect()} == want


def test_markup_and_escapes():
    plain = "the clerk weighs 12 rusted spools because one hollow ledger turns amber"
    for text in (
        "<p>The <b>clerk</b> weighs 12 rusted spools, because one hollow ledger turns amber.</p>", "> The clerk weighs\n> 12 rusted spools because\n> one hollow ledger turns amber", "1. THE CLERK weighs 12\n2. rusted spools because one\n3. hollow ledger turns amber",
        "the clerk\\nweighs 12 rusted\\u0020spools because &quot;one hollow&quot; ledger turns amber", "<u17> the clerk weighs 12 rusted spools because\n<u17> one hollow ledger turns amber", "the%20clerk%20weighs 12 rusted spools because one hollow ledger turns amber",
    ):
        assert leaks.words(text) == plain.split(), text


def test_rows_and_both_joins(spark):
    docs, items = corpus(9)
    d = spark.createDataFrame([*docs, docs[0], (900, None), (901, ""), (None, docs[1][1])], "doc_id long, text string").withColumn("item_id", leaks.F.lit("clash"))
    i = spark.createDataFrame([*items, (77, None), (None, "x")], "item_id long, text string")
    small = {tuple(r) for r in leaks.find_leaks(d, i).collect()}
    assert small and small == {tuple(r) for r in leaks.find_leaks(d, i, broadcast_seeds=0).collect()}
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_several_texts_under_one_item(spark):
    a = "the clerk weighs twelve rusted spools because one hollow ledger turns amber"
    b = "each north depot rewinds its early magnet ribbon before remote carton header arrives"
    d = spark.createDataFrame([(1, f"so {a} now"), (2, f"so {b} now")], "doc_id long, text string")
    for texts in ((a, b), (b, a)):
        i = spark.createDataFrame([(7, t) for t in texts], "item_id long, text string")
        small = {tuple(r) for r in leaks.find_leaks(d, i).collect()}
        assert {r[:2] for r in small} == {(1, 7), (2, 7)}
        assert small == {tuple(r) for r in leaks.find_leaks(d, i, broadcast_seeds=0).collect()}
