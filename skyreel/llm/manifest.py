"""A Merkle manifest of a dataset, with a proof for every row, by a slot pivot.

The rows of a group, in order, are leaves; every ``fanout`` consecutive nodes become their parent, the sha256 of the
children's hashes one after another, until one node is left. The tops of the groups are the leaves of one more tree.

A parent's children are spread into ``fanout`` columns by conditional aggregates over the parent: the columns together,
hashed, are the parent, and the columns without a node's own slot are its siblings. ``HEIGHT`` levels are worked out in one pass over
blocks of ``fanout ** HEIGHT`` consecutive leaves; the tops of the blocks are the leaves of the next pass. A block is all
that a task must hold, whatever the size of a group, and no join is on the group alone but for the last pass's few nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.listing import PLACE_BITS, positioned
from .common import checkpointed, prepared

HEIGHT = 8
"""Levels of a pass."""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"


def piece(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its UTF-8 length, ``:``, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(piece, values)).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]).cast("binary"), 256))


def proof_hash(proof: Column) -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "").cast("binary"), 256)


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (group, key, leaf, ...) with tree (a number for each group, in order of groups), at (place in it from 0) and n (its rows).

    Rows are range-partitioned and sorted once. Equal rows may be any number, so they are spread by the row's number.
    """
    order = ("group", "key", "leaf", "__spread")
    spread = rows.withColumn("__spread", F.xxhash64(F.monotonically_increasing_id()))
    kept = checkpointed(spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("__spread"))
    kept = kept.withColumn("__i", F.monotonically_increasing_id()).withColumn("part", F.shiftright("__i", PLACE_BITS))
    ends = kept.groupBy("part", "group").agg(F.min("__i").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("group").orderBy("part")
    ends = ends.select(
        "part", "group", "first",
        F.coalesce(F.sum("rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy("group")).alias("n"), F.min("first").over(Window.partitionBy("group")).alias("tree"),
    )
    here = ends.select(F.col("part").alias("p"), F.col("group").alias("g"), "first", "before", "n", "tree")
    placed = kept.join(here, (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g")))
    return placed.select(*rows.columns, "tree", (F.col("__i") - F.col("first") + F.col("before")).alias("at"), "n")


def _pass(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (tree, at, n, hash, ...) with block, top (the block's highest node) and proof (the siblings up to it)."""
    size = fanout**HEIGHT
    slots = [f"__s{s}" for s in range(fanout)]
    ups = [f"__u{level}" for level in range(HEIGHT, 0, -1)]  # ancestors' places, the highest first: every window is a prefix of one sort
    rows = nodes.withColumn("block", F.floor(F.col("at") / size)).withColumns({f"__u{level}": F.floor(F.col("at") / fanout**level) for level in range(1, HEIGHT + 1)})
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *ups).withColumn("top", F.col("hash"))
    levels = []
    for level in range(HEIGHT):
        family = Window.partitionBy("tree", "block", *ups[: HEIGHT - level])
        slot = F.col("at") if level == 0 else F.col(f"__u{level}")
        slot = F.pmod(slot, F.lit(fanout))
        rows = rows.withColumns({c: F.max(F.when(slot == s, F.col("top"))).over(family) for s, c in enumerate(slots)})
        at_work = F.col("n") > fanout**level
        join = lambda keep: F.concat(*[F.when(keep(s), F.coalesce(F.col(c), F.lit(""))).otherwise("") for s, c in enumerate(slots)])  # noqa: E731, B023
        level_ = F.when(at_work, F.struct(join(lambda s: slot > s).alias("left"), join(lambda s: slot < s).alias("right")))  # noqa: B023
        rows = rows.withColumns({f"__p{level}": level_, "top": F.when(at_work, F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in slots]).cast("binary"), 256)).otherwise(F.col("top"))}).drop(*slots)
        levels.append(f"__p{level}")
    return rows.withColumn("proof", F.filter(F.array(*levels), lambda p: p.isNotNull())).drop(*ups, *levels)


def _trees(nodes: DataFrame, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """Every tree's (tree, top), and the passes over ``nodes`` (tree, at, n, hash, ...) and over the blocks of the pass before."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    passes = [checkpointed(_pass(nodes, fanout))]
    while most > fanout**HEIGHT:
        blocks = passes[-1].groupBy("tree", F.col("block").alias("at")).agg(F.max("top").alias("hash"), F.max(F.ceil(F.col("n") / fanout**HEIGHT)).alias("n"))
        passes.append(checkpointed(_pass(blocks, fanout)))
        most = -(-most // fanout**HEIGHT)
    tops = passes[-1].groupBy("tree").agg(F.max("top").alias("top"))
    return tops, passes


def manifest(rows: DataFrame, fanout: int = 2) -> DataFrame:
    """``rows`` (group, key, leaf, ...) with subroot, root and proof.

    Leaves ascend by ``key`` in their group (nulls first, equal keys by leaf); groups ascend, null first. ``proof`` holds the hashes left and right of the
    row's ancestors, level by level from the leaf through the group's subroot to the root (see ``folded``); a level at which nothing
    else is in the node's run has empty ones. Repeated rows are leaves of their own. No rows, no result.
    """
    prepared(rows.sparkSession)
    if fanout < 2:
        raise ValueError("a parent has at least two slots")
    ranked = _ranked(checkpointed(rows)).withColumn("hash", F.col("leaf"))
    tops, passes = _trees(ranked, fanout)
    tops = checkpointed(tops)
    groups = positioned(tops.select("tree", F.col("top").alias("hash")), ["tree"], "at", 0)
    groups = groups.select(F.lit(0).alias("tree"), "at", F.lit(tops.count()).cast("long").alias("n"), "hash", F.col("tree").alias("of"))
    crown, upper = _trees(groups, fanout)
    whole = _joined(upper, crown.select("tree", F.col("top").alias("root"), F.array().cast(PROOF).alias("rest")), "root")
    over = whole.select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("proof").alias("rest"))
    return _joined(passes, over, "subroot", "root").select(*rows.columns, "subroot", "root", "proof")


def _joined(passes: list[DataFrame], over: DataFrame, *tell: str) -> DataFrame:
    """The first pass's rows with the columns ``tell`` of their tree and their proofs continued through all passes and ``over``."""
    for k in range(len(passes) - 1, -1, -1):
        last = k == len(passes) - 1
        rows = passes[k].join(over, ["tree"] if last else ["tree", "block"]).withColumn("proof", F.concat("proof", "rest")).drop("rest")
        if k:
            over = rows.select("tree", F.col("at").alias("block"), *tell, F.col("proof").alias("rest"))
    return rows


def of_documents(documents: DataFrame, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, bent: every row of ``documents`` as a leaf of its language's tree.

    ``bent`` is the leaf as it would be with n_chars one higher where 7 divides crc32 of the doc_id, else the leaf; a null
    doc_id or n_chars leaves it as it is. Nulls in any column are told from values; whole texts are hashed.
    """
    fields = [F.col(c) for c in FIELDS]
    more = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    leaf = leaf_hash(*fields)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = documents.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("key"), leaf.alias("leaf"), F.when(hit, leaf_hash(*more)).alias("changed"))
    return manifest(rows, fanout).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof", F.coalesce("changed", "leaf").alias("bent"))
