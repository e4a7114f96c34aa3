"""Permutations, quotas, and the invariants of a mix."""

import numpy as np

from siltbed.llm import mixing


def test_permutation():
    for n in (1, 2, 3, 10, 255, 256, 257, 1000):
        for key in (1, 2):
            got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got) == list(range(n))


def test_quotas():
    got = mixing.quotas({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000}, 100)
    assert got["a"] == 10 and got["b"] == 90 and got["c"] == 0
    assert mixing.quotas({"a": 1.0}, {"a": 5}, 100)["a"] == 5
    assert mixing.quotas({}, {}, 0) == {}


def test_slots_have_exact_totals(spark):
    slots = [700, 40, 260]
    rows = mixing.draw_slots(spark, ["a", "b", "c"], slots, shard_slots=64).collect()
    for k, n in enumerate(slots):
        assert sorted(r.idx for r in rows if r.source_no == k) == list(range(n))
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert sorted(sizes.values())[-15:] == [64] * 15 and sum(sizes.values()) == 1000


def test_mix(spark):
    docs = [(k, ["Wiki ", "forum", "FORUM", "chat", None, "other"][k % 6], "word " * (20 + k % 50)) for k in range(300)]
    docs += [docs[0], (900, "wiki", None), (901, "wiki", ""), (None, "wiki", "x y")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("n_tokens", mixing.F.lit("clash"))
    t = spark.createDataFrame([("wiki", 0.6, 2), ("forum", 0.3, 1), ("chat", 0.05, 1), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    mixed, have = mixing.mix(d, t, block=64)
    rows = mixed.collect()
    used = {}
    for r in rows:
        for k in range(r.doc_from, r.doc_from + r.n_tokens):
            used[(r.doc_id, k)] = used.get((r.doc_id, k), 0) + 1
    limit = {"wiki": 2, "forum": 1, "chat": 1}
    source = {k: (s or "").strip().lower() for k, s, _ in docs if k is not None}
    assert used and all(n <= limit[source[doc]] for (doc, _), n in used.items())
    total = sum(r.n_tokens for r in rows)
    available = sum(r.available for r in have.collect())
    assert abs(total - available) / available < 0.05
    share = {r.source: (r.reached_share, r.most_repeats) for r in mixing.reached(mixed, have).collect()}
    assert share["none"] == (0.0, 0) and abs(sum(s for s, _ in share.values()) - 1) < 1e-9 and share["wiki"][1] <= 2
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[0].count() == 0
