"""N-gram Jaccard join over a token-group matrix.

Documents whose shingle sets are equal form one class; only classes are compared. Classes that share a prefix token meet
in a run. Short runs are compared pair by pair; in long ones every class meets a few pivots, and the classes linked so far
become groups of at most ``GROUP_MOST`` members. For a class that shares a prefix token with a group it isn't linked to,
the group's token union bounds the overlap with any member; only groups whose bound reaches the threshold are opened.
The result is exact: every pair of classes with a similarity of at least 75 / 100 either is compared or is connected
already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings as P
from .common import checkpointed, prepared
from .components import components

GROUP_MOST = 256
NO_WORDS = r"id is null or text is null or not rlike(text, '[^\\x20\\x09-\\x0D]')"
"""Rows that take no part: without a doc_id, a text, or a word."""


def _fitting(large: str, small: str):
    """Whether sets of at most ``large`` tokens can be similar to sets of at least ``small``."""
    return (F.col(large) * P.DEN >= F.col(small) * P.NUM) | (F.col(large) >= P.MOST)


def _in_place(rest, nx, ny, most):
    """Positional filter: whether so many tokens from the first common one on can make sets of these sizes similar."""
    return ((P.NUM + P.DEN) * rest >= P.NUM * (nx + ny)) | (most >= P.MOST)


def _open_groups(members: DataFrame, labels: DataFrame, set_of) -> DataFrame:
    """Links across groups that the first look could not see: those of pairs that only met in long runs.

    ``set_of`` reads the sets of a table of keys.
    """
    rows = members.join(labels, "a", "left").select("token", F.col("a").alias("key"), "n", (F.col("n") - F.col("i")).alias("rest"), F.coalesce("root", "a").alias("label"))
    rows = checkpointed(rows)
    held = rows.groupBy("token", "label").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    split = held.groupBy("token").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token")
    size = rows.select("label", "key").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    held = checkpointed(held.join(split, "token").join(size, "label"))
    other = held.select("token", *(F.col(c).alias(f"o_{c}") for c in ("label", "rows", "least", "most", "rest")))
    # of two groups the one with fewer members asks, in the run of the first token that both have
    meet = held.join(other, "token").where(
        (F.struct("rows", "label") < F.struct("o_rows", "o_label")) & _fitting("most", "o_least") & _fitting("o_most", "least")
        & _in_place(F.least("rest", "o_rest"), F.col("least"), F.col("o_least"), F.greatest("most", "o_most"))
    ).select("token", "label", "o_label", "o_least", "o_most", "o_rest")
    asks = rows.join(meet, ["token", "label"]).where(
        _fitting("n", "o_least") & _fitting("o_most", "n")
        & _in_place(F.least("rest", "o_rest"), F.col("n"), F.greatest("o_least", F.ceil(F.col("n") * P.NUM / P.DEN)), F.greatest("n", "o_most"))
    )
    asks = checkpointed(asks.groupBy("key", F.col("o_label").alias("label")).agg(F.first("n").alias("n"), F.min("o_least").alias("least"), F.max("o_most").alias("most")))
    shared = rows.select("key", "token").join(asks.select("key", "label"), "key").join(held.select("token", "label"), ["token", "label"], "left_semi")
    shared = shared.groupBy("key", "label").agg(F.count(F.lit(1)).alias("shared"))
    # the bound on shared tokens is weakest at the ends of the group's sizes
    low = F.least(F.greatest("least", F.ceil(F.col("n") * P.NUM / P.DEN)), "most")
    high = F.greatest(F.least("most", F.floor(F.col("n") * P.DEN / P.NUM)), "least")
    asks = asks.join(shared, ["key", "label"]).where(P.reachable(F.col("shared"), F.col("n"), low) | P.reachable(F.col("shared"), F.col("n"), high))
    asks = checkpointed(asks.select("key", "label"))
    # the members of the asked groups, in groups of GROUP_MOST at most (on average)
    asked = labels.select(F.col("a").alias("key"), F.col("root").alias("label")).join(asks.select("label").distinct(), "label", "left_semi")
    alone = asks.select("label").distinct().join(labels.select(F.col("root").alias("label")).distinct(), "label", "left_anti")
    asked = asked.select("key", "label").unionByName(alone.select(F.col("label").alias("key"), "label"))
    sets = checkpointed(set_of(asked.select("key").unionByName(asks.select("key")).distinct()))
    width = asked.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_MOST)).cast("int").alias("width"))
    groups = asked.join(width, "label").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("width")).cast("int")).join(sets, "key")
    queries = asks.join(width, "label").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).join(sets, "key")
    queries = queries.select(F.col("label").alias("of"), F.col("chunk").alias("part"), F.col("key").alias("asking"), F.col("tokens").alias("x"))

    def opened(asking: pa.Table, holding: pa.Table) -> pa.Table:
        inside = [np.frombuffer(t.as_py(), np.uint64) for t in holding.column("tokens")]
        keys = holding.column("key").to_pylist()
        a, b = [], []
        if inside and len(asking):
            union = np.unique(np.concatenate(inside))
            for key, blob in zip(asking.column("asking").to_pylist(), asking.column("x")):
                x = np.frombuffer(blob.as_py(), np.uint64)
                if P.overlap(x, union) >= P.needed(len(x)):
                    for other, y in zip(keys, inside):
                        if P.DEN * min(len(x), len(y)) >= P.NUM * max(len(x), len(y)) and P.linked(P.overlap(x, y), len(x), len(y)):
                            a.append(key)
                            b.append(other)
                            break  # one link ties the class to this group
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return queries.groupBy("of", "part").cogroup(groups.groupBy("label", "chunk")).applyInArrow(opened, "a long, b long")


def near_groups(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), n_classes.

    Rows without words, with null text or null doc_id have no shingles and link with nothing; a null doc_id keeps a null component. Rows that
    repeat a doc_id are compared like others. Extra columns are not read. ``n_classes`` counts the different sets in the
    component.
    """
    spark = prepared(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("mark"), F.col("text").cast("string").alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = checkpointed(P.survey(texts.where("id is not null and text is not null"), P.document_sets))
    rows = seen.where(F.col("kind") == P.UNIT)
    classes = rows.groupBy("key", "sig").agg(F.min("id").alias("id"))
    volume = rows.agg(F.sum("n")).first()[0] or 0
    live = texts.where("id is not null and text is not null")
    found = checkpointed(P.candidates(P.dealt(live, P.document_sets, P.common_tokens(seen), P.buckets_for(volume, width))))
    pairs = checkpointed(P.promising(found))
    members = found.where(F.col("kind") == P.MEMBER).select("token", "a", F.col("na").alias("n"), F.col("nb").alias("i"))
    set_of = lambda keys: P.set_table(live, P.document_sets, keys.join(classes.select("key", "id"), "key"))
    sets = set_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    links = P.verified(pairs, checkpointed(sets)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    first = components(links)
    labels = first.select(F.col("node").alias("a"), "root")
    more = _open_groups(members, labels, set_of).select(F.col("a").alias("u"), F.col("b").alias("v"))
    final = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    labelled = classes.join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = labelled.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n_classes"))
    member = labelled.join(least, "root").select("key", "sig", "component_id", "n_classes")
    grouped = rows.join(member, ["key", "sig"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_classes")
    nothing = texts.where(NO_WORDS).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("n_classes"))
    return grouped.unionByName(nothing)


def first_of_groups(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of near copies: that of the smallest doc_id.

    Rows that link with nothing stay, among them those without words, text or doc_id. doc_id is the key: rows that repeat
    it stay or go together.
    """
    gone = checkpointed( near_groups(documents).where("doc_id is not null and n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct())
    if gone.count() <= P.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = documents.withColumn("__id", F.col("doc_id").cast("long")).join(gone.withColumnRenamed("doc_id", "__id"), "__id", "left_anti")
    return left.select(*documents.columns)
