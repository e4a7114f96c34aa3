"""Parent-child links to full hierarchies: cycle separation, then heavy-path decomposition.

Everything runs in rounds over DataFrames. A round doubles the length of every pointer, so a
tree of depth d takes about log2(d) rounds, and the lists of chains take at most log2(rows) levels.
No tree, folder or chain is ever gathered on the driver.

Defined results for odd input
-----------------------------
* Rows with a null image or node are void; a null parent makes a terminal node (a root).
* A parent that is no node makes its child a terminal node too; the root inode is one in any case.
* A node listed several times takes the link of the highest ``xid`` (null counts as lowest); on a
  tie the largest parent wins. A link record beats a node record whatever their ``xid``.
* A null name becomes ``#<ino>``; an empty table gives an empty result; other columns are ignored.
* A node whose chain of parents never ends gets no path, only its ``cycle_ino``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltbed.plans.lineage import cut

ROOT_INO = 2
#: Siblings are numbered in blocks of about this many, so that a huge folder is no single task.
SIBLINGS_PER_BLOCK = 4096


def nodes_of(dirents: DataFrame, inodes: DataFrame, names: bool = True) -> DataFrame:
    """One row per node: ``image_id, ino, parent`` and, with ``names``, ``name``.

    The parent comes from the newest link record, or from the newest node record where a node has
    no link record at all.
    """
    links = dirents.where("image_id IS NOT NULL AND parent_ino IS NOT NULL AND child_ino IS NOT NULL").select(
        "image_id", F.col("child_ino").alias("ino"), F.lit(1).alias("linked"), "xid",
        F.col("parent_ino").alias("parent"), *(["name"] if names else []),
    )
    records = inodes.where("image_id IS NOT NULL AND ino IS NOT NULL").select(
        "image_id", "ino", F.lit(0).alias("linked"), "xid",
        F.col("parent_id").alias("parent"), *([F.lit(None).cast("string").alias("name")] if names else []),
    )
    best = F.max(F.struct("linked", "xid", "parent", *(["name"] if names else []))).alias("b")
    return (
        links.unionByName(records)
        .groupBy("image_id", "ino")
        .agg(best)
        .select("image_id", "ino", "b.parent", *(["b.name"] if names else []))
    )


def separate_cycles(nodes: DataFrame) -> DataFrame:
    """``image_id, ino, cycle_ino`` of every node on or below a circle of parents.

    Round k holds the nodes that have an ancestor 2**k steps up, with that ancestor. Nodes of a
    finite chain drop out; when a round drops none, no finite chain is that long, and all that is
    left is cyclic. The ancestors that remain as targets shrink to the circles themselves, and
    the running minimum over the steps gives the smallest inode of each circle.
    """
    jump = cut(
        nodes.where(F.col("parent").isNotNull() & (F.col("ino") != ROOT_INO)).select(
            "image_id", "ino", F.col("parent").alias("ptr"), F.col("ino").alias("low")
        )
    )
    before = None
    while True:
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut(
            a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.ptr") == F.col("b.ino"))).select(
                "a.image_id", "a.ino", "b.ptr", F.least("a.low", "b.low").alias("low")
            )
        )
        now = jump.agg(F.count("*"), F.count_distinct("image_id", "ptr"), F.sum("low")).first()
        if now[0] == 0 or now == before:
            break
        before = now
    a, b = jump.alias("a"), jump.alias("b")
    return a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.ptr") == F.col("b.ino"))).select(
        "a.image_id", "a.ino", F.col("b.low").alias("cycle_ino")
    )


def _climb(forest: DataFrame, sizes: bool = False) -> DataFrame:
    """``image_id, ino, depth, root`` (and ``size``, the nodes of the subtree) for an acyclic forest.

    ``forest`` has ``image_id, ino, parent``, the parent null at a root. Only the rows that have
    not met their root are joined in a round, so a root with a third of all rows is no hot key.
    """
    state = cut(
        forest.select(
            "image_id", "ino", "parent", F.col("parent").isNull().alias("done"),
            F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"),
            F.coalesce("parent", "ino").alias("ptr"), F.lit(1).cast("long").alias("size"),
        ).drop("parent")
    )
    while state.where(~F.col("done")).limit(1).count():
        todo = state.where(~F.col("done")).alias("a")
        up = state.select("image_id", "ino", "done", "depth", "ptr").alias("b")
        moved = todo.join(
            up, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.ptr") == F.col("b.ino"))
        ).select(
            "a.image_id", "a.ino", "b.done", (F.col("a.depth") + F.col("b.depth")).alias("depth"), "b.ptr", "a.size"
        )
        merged = state.where("done").unionByName(moved)
        if sizes:
            below = todo.groupBy("image_id", F.col("ptr").alias("ino")).agg(F.sum("size").alias("more"))
            merged = merged.join(below, ["image_id", "ino"], "left").select(
                "image_id", "ino", "done", "depth", "ptr", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")
            )
        state = cut(merged)
    return state.select("image_id", "ino", "depth", F.col("ptr").alias("root"), *(["size"] if sizes else []))


def _light_offsets(kids: DataFrame) -> DataFrame:
    """``image_id, ino, before``: the nodes in earlier light siblings' subtrees.

    The sum runs over blocks of siblings, then over the blocks of a folder, so that a folder with a
    third of all rows is spread over many tasks.
    """
    counts = kids.groupBy("image_id", "parent").agg(F.count("*").alias("n"))
    blocked = kids.join(counts, ["image_id", "parent"]).withColumn(
        "block", F.pmod(F.xxhash64("ino"), F.ceil(F.col("n") / SIBLINGS_PER_BLOCK))
    )
    sums = blocked.groupBy("image_id", "parent", "block").agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("image_id", "parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("image_id", "parent", "block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = (
        Window.partitionBy("image_id", "parent", "block").orderBy("ino").rowsBetween(Window.unboundedPreceding, -1)
    )
    return blocked.join(base, ["image_id", "parent", "block"]).select(
        "image_id", "ino", (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("before")
    )


def _label(name: Column, ino: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("#"), ino.cast("string")))


def build_hierarchy(nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row per node that reaches a root.

    ``image_id, ino, parent_ino, root_ino, depth, path, ancestors`` (from the root down),
    ``chain_head, chain_pos`` (the heavy path), ``first, last`` (the node and its descendants are
    exactly the nodes of the same root with ``first`` in that interval) and ``n_descendants``.
    """
    tree = nodes.join(cycles.select("image_id", "ino"), ["image_id", "ino"], "left_anti")
    ids = tree.select("image_id", F.col("ino").alias("parent"), F.lit(True).alias("known"))
    tree = cut(
        tree.withColumn("parent", F.when(F.col("ino") != ROOT_INO, F.col("parent")))
        .join(ids, ["image_id", "parent"], "left")
        .select("image_id", "ino", F.when(F.col("known"), F.col("parent")).alias("parent"), "name")
    )
    sized = cut(_climb(tree.select("image_id", "ino", "parent"), sizes=True).join(tree, ["image_id", "ino"]))

    heavy = (
        sized.where("parent IS NOT NULL")
        .groupBy("image_id", "parent")
        .agg(F.max(F.struct("size", (-F.col("ino")).alias("m"))).alias("h"))
        .select("image_id", "parent", (-F.col("h.m")).alias("heavy"), F.col("h.size").alias("heavy_size"))
    )
    marked = cut(
        sized.join(heavy, ["image_id", "parent"], "left").withColumn(
            "is_heavy", F.coalesce(F.col("heavy") == F.col("ino"), F.lit(False))
        )
    )
    chains = _climb(marked.select("image_id", "ino", F.when(F.col("is_heavy"), F.col("parent")).alias("parent")))
    placed = marked.join(
        chains.select("image_id", "ino", F.col("depth").alias("pos"), F.col("root").alias("head")), ["image_id", "ino"]
    )
    label = F.when((F.col("parent").isNull()) & (F.col("ino") == ROOT_INO), F.lit("")).otherwise(
        _label(F.col("name"), F.col("ino"))
    )
    along = Window.partitionBy("image_id", "head").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(
        placed.withColumn("label", label)
        .withColumn("names", F.collect_list("label").over(along))
        .withColumn("inos", F.collect_list("ino").over(along))
        .select("image_id", "ino", "parent", "root", "depth", "size", "is_heavy", "heavy_size", "head", "pos", "names", "inos")
    )

    # the chains: each hangs on a node of another chain, after the heavy subtree and earlier light ones
    light = placed.where("NOT is_heavy AND parent IS NOT NULL")
    offsets = _light_offsets(light.select("image_id", "parent", "ino", "size"))
    hang = placed.select(
        "image_id", F.col("ino").alias("parent"), F.col("head").alias("up_head"), F.col("pos").alias("up_pos"),
        F.col("names").alias("up_names"), F.col("inos").alias("up_inos"),
    )
    links = cut(
        light.select("image_id", F.col("ino").alias("head"), "parent", "heavy_size")
        .join(offsets.withColumnRenamed("ino", "head"), ["image_id", "head"])
        .join(hang, ["image_id", "parent"])
        .select(
            "image_id", "head", "up_head", "up_names", "up_inos",
            (F.col("up_pos") + 1 + F.col("heavy_size") + F.col("before")).alias("shift"),
        )
    )
    names = F.array().cast("array<string>")
    level = cut(
        placed.where("parent IS NULL").select(
            "image_id", "head", names.alias("pre_names"), F.array().cast("array<bigint>").alias("pre_inos"),
            F.lit(0).cast("long").alias("start"),
        )
    )
    prefix = level
    while True:
        up = level.select("image_id", F.col("head").alias("up_head"), "pre_names", "pre_inos", "start")
        level = cut(
            links.join(up, ["image_id", "up_head"]).select(
                "image_id", "head", F.concat("pre_names", "up_names").alias("pre_names"),
                F.concat("pre_inos", "up_inos").alias("pre_inos"), (F.col("start") + F.col("shift")).alias("start"),
            )
        )
        if level.limit(1).count() == 0:
            break
        prefix = prefix.unionByName(level)
    full = placed.join(prefix, ["image_id", "head"])
    return full.select(
        "image_id", "ino", F.col("parent").alias("parent_ino"), F.col("root").alias("root_ino"), "depth",
        F.concat(
            F.when(F.col("root") == ROOT_INO, F.lit("")).otherwise(F.lit("?/")),
            F.when((F.col("root") == ROOT_INO) & (F.col("depth") == 0), F.lit("/"))
            .otherwise(F.array_join(F.concat("pre_names", "names"), "/")),
        ).alias("path"),
        F.slice(F.concat("pre_inos", "inos"), F.lit(1), F.col("depth").cast("int")).alias("ancestors"),
        F.col("head").alias("chain_head"), F.col("pos").alias("chain_pos"),
        (F.col("start") + F.col("pos")).alias("first"),
        (F.col("start") + F.col("pos") + F.col("size") - 1).alias("last"),
        (F.col("size") - 1).alias("n_descendants"),
    )


def descendants(hierarchy: DataFrame) -> DataFrame:
    """``image_id, ino, descendant_ino``: one row per node and node below it, as long as the answer itself.

    Read from the concatenated chain segments of each node, without any self join.
    """
    return hierarchy.select("image_id", F.explode("ancestors").alias("ino"), F.col("ino").alias("descendant_ino"))
