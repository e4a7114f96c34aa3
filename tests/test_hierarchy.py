"""Hierarchies against a plain walk over parents, with random forests, circles and odd rows."""

import random

from siltbed.operators import hierarchy as H

DIRENTS = "image_id long, parent_ino long, child_ino long, xid long, name string, extra int"
INODES = "image_id long, ino long, parent_id long, xid long, name string"


def brute(nodes):
    """path, depth, root, ancestors or the smallest node of the circle, per node."""
    out = {}
    for key in nodes:
        chain, v = [], key
        while v in nodes and v not in chain:
            chain.append(v)
            parent = nodes[v][0]
            if v[1] == 2 or parent is None or (v[0], parent) not in nodes:
                out[key] = ("tree", len(chain) - 1, v[1], [x[1] for x in chain[:0:-1]])
                break
            v = (v[0], parent)
        else:
            out[key] = ("cycle", min(x[1] for x in chain[chain.index(v) :]))
    return out


def build(spark, dirents, inodes):
    d, i = spark.createDataFrame(dirents, DIRENTS), spark.createDataFrame(inodes, INODES)
    nodes = H.nodes_of(d, i)
    cycles = H.separate_cycles(nodes)
    return nodes, cycles, H.build_hierarchy(nodes, cycles)


def test_random_forests(spark):
    rng = random.Random(3)
    dirents = []
    for image in (1, 2):
        for ino in range(3, 160):
            parent = rng.choice([2, ino - 1, ino - 1, rng.randint(2, 165)])
            dirents.append((image, parent, ino, rng.randint(1, 99), f"n{ino}", 0))
        dirents.append((image, 2, 2, 1, "", 0))
    dirents += [(3, 11, 10, 1, "a", 0), (3, 12, 11, 1, "b", 0), (3, 10, 12, 1, "c", 0), (3, 12, 13, 1, "below", 0), (3, 14, 14, 1, "self", 0)]
    nodes, cycles, tree = build(spark, dirents, [])
    want = brute({(r.image_id, r.ino): (r.parent, r.name) for r in nodes.collect()})
    got_cycles = {(r.image_id, r.ino): r.cycle_ino for r in cycles.collect()}
    assert got_cycles == {k: v[1] for k, v in want.items() if v[0] == "cycle"}
    assert got_cycles[(3, 13)] == 10 and got_cycles[(3, 14)] == 14
    rows = {(r.image_id, r.ino): r for r in tree.collect()}
    assert set(rows) == {k for k, v in want.items() if v[0] == "tree"}
    for k, (_, depth, root, ancestors) in ((k, v) for k, v in want.items() if v[0] == "tree"):
        r = rows[k]
        assert (r.depth, r.root_ino, list(r.ancestors)) == (depth, root, ancestors)
        below = {q for q, v in want.items() if v[0] == "tree" and q[0] == k[0] and k[1] in v[3]}
        inside = {q for q, s in rows.items() if q[0] == k[0] and s.root_ino == r.root_ino and r.first < s.first <= r.last}
        assert below == inside and r.n_descendants == len(below)
    assert H.descendants(tree).count() == sum(v[1] for v in want.values() if v[0] == "tree")


def test_odd_rows(spark):
    dirents = [
        (1, 2, 5, 1, "old", 0), (1, 6, 5, 9, "new", 0), (1, 6, 5, 9, "new", 0), (1, None, 7, 1, "void", 0), (1, 2, None, 1, "void", 0),
        (None, 2, 8, 1, "void", 0), (1, 999, 9, 1, None, 0), (1, 2, 6, None, "dir", 0),
    ]
    inodes = [(1, 7, 6, 1, "x"), (1, 7, 2, None, "x"), (1, 5, 2, 99, "x"), (1, 2, 77, 1, "x"), (1, 10, None, 1, "x")]
    _, cycles, tree = build(spark, dirents, inodes)
    assert cycles.count() == 0
    got = {r.ino: (r.path, r.depth, r.root_ino) for r in tree.collect()}
    assert got == {2: ("/", 0, 2), 6: ("/dir", 1, 2), 5: ("/dir/new", 2, 2), 7: ("/dir/#7", 2, 2), 9: ("?/#9", 0, 9), 10: ("?/#10", 0, 10)}


def test_empty(spark):
    _, cycles, tree = build(spark, [], [])
    assert cycles.count() == 0 and tree.count() == 0


def test_wide_folder_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "SIBLINGS_PER_BLOCK", 7)
    _, _, tree = build(spark, [(1, 2, k, 1, f"f{k}", 0) for k in range(3, 103)], [(1, 2, None, 1, "")])
    rows = tree.collect()
    assert sorted(r["first"] for r in rows) == list(range(101))
