"""Exact set-similarity join of lines, and the documents without the lines that it finds to be later copies.

A line is the set of its five-word shingles; one of one to four words is one shingle as a whole, so it is similar to its
copies only. Tokens are ordered by rarity over the corpus; lines
meet by prefix tokens and pass a length filter, a positional filter and a bound on shared prefix tokens before their
exact Jaccard similarity is taken. A line goes if an earlier line (by doc_id, then place) has a similarity of at least
75 / 100. Lines without a word stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import postings as P
from .common import checkpointed, prepared, unused, written

EARLIEST = 4
BROADCAST_KEYS = 1 << 20
"""A list of keys (8 bytes each) is broadcast up to so many."""
BROADCAST_CLASSES = 1 << 19
"""Classes that lose a line (48 bytes each) are broadcast up to so many, so that the lines do not move again, else joined by a shuffle."""
BROADCAST_LINES = 1 << 21
"""The list of lines to cut is broadcast up to so many (at most about 60 bytes each), else joined by a shuffle."""


def _small(keys: DataFrame) -> DataFrame:
    """A written list of keys, broadcast if it is short."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _later(links: DataFrame, place: DataFrame) -> DataFrame:
    """The later class of each link, as column key."""
    both = links.join(place.select(F.col("key").alias("a"), F.col("at").alias("at_a")), "a").join(place.select(F.col("key").alias("b"), F.col("at").alias("at_b")), "b")
    return both.select(F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("key")).distinct()


def later_lines(documents: DataFrame) -> DataFrame:
    """(id, mark, number): the lines to remove, by doc_id, hash of the text, and number of the line in it from 0."""
    spark = prepared(documents.sparkSession)
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    seen = written(P.survey(texts, P.line_sets))
    lines = seen.where(F.col("kind") == P.UNIT)
    classes = written(lines.groupBy("key", "sig").agg(F.min(F.struct("id", "mark", "number")).alias("at"), F.count(F.lit(1)).alias("lines")))
    volume = lines.agg(F.sum("n")).first()[0] or 0
    packed = P.dealt(texts, P.line_sets, P.common_tokens(seen), P.buckets_for(volume, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = checkpointed(P.candidates(packed))
    pairs = checkpointed(P.promising(found))
    members = found.where(F.col("kind") == P.MEMBER).select("token", F.col("a").alias("key"), F.col("na").alias("n"), F.col("nb").alias("i"))
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(members.select("key")).distinct()
    named = checkpointed(named)
    place = checkpointed(classes.select("key", "at").join(_small(named), "key"))  # of the classes that met another
    sets = checkpointed(P.set_table(texts, P.line_sets, place.select("key", F.col("at.id").alias("id"))))
    gone = checkpointed(_later(P.verified(pairs, sets), place))
    # classes of long runs that are left: against the earliest of their runs, then against all that come before them
    placed = checkpointed(members.join(place.select("key", "at"), "key"))
    turn = Window.partitionBy("token").orderBy("at")
    for other in (placed.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= EARLIEST).drop("turn"), placed):
        left = placed.join(gone, "key", "left_anti")
        before = other.select("token", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("at").alias("at_b"))
        most = F.least(F.col("n") - F.col("i"), F.col("nb") - F.col("ib"))
        meet = left.join(before, "token").where(
            (F.col("at_b") < F.col("at"))
            & ((F.greatest("n", "nb") >= P.MOST) | (P.DEN * F.least("n", "nb") >= P.NUM * F.greatest("n", "nb")) & ((P.NUM + P.DEN) * most >= P.NUM * (F.col("n") + F.col("nb"))))
        ).select(F.col("key").alias("a"), "b").distinct()
        gone = checkpointed(gone.unionByName(P.verified(meet, sets).select(F.col("a").alias("key"))).distinct())
    # only classes with something to remove meet their lines again
    kept = classes.join(_small(gone).withColumn("gone", F.lit(True)), "key", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    touched = written(kept.where("gone or lines > 1").select("key", "sig", "at", "gone"))
    if touched.count() <= BROADCAST_CLASSES:
        touched = F.broadcast(touched)
    return lines.join(touched, ["key", "sig"]).where(F.col("gone") | (F.struct("id", "mark", "number") != F.col("at"))).select("id", "mark", "number")


def without_later_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with the later lines cut out of ``text`` (and ``n_chars`` set anew, where there is one).

    Every row stays; a text may end up empty. Null texts, and rows with a null doc_id, stay as they are. Rows that repeat
    a doc_id and a text count as one: an exactly repeated row keeps the lines that its first keeps. Other columns go through.
    """
    gone_, mark_, id_ = unused(documents.columns, "__gone", "__mark", "__id")
    lines = checkpointed(later_lines(documents))
    gone = lines.groupBy("id", "mark").agg(F.collect_set("number").alias(gone_))
    if lines.count() <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    rows = documents.withColumn(mark_, F.xxhash64("text")).withColumn(id_, F.col("doc_id").cast("long"))
    joined = rows.join(gone.select(F.col("id").alias(id_), F.col("mark").alias(mark_), gone_), [id_, mark_], "left")
    lines = F.split("text", "\n")
    cut = F.array_join(F.filter(lines, lambda line, at: ~F.array_contains(gone_, at.cast("long"))), "\n")
    out = joined.withColumn("text", F.when(F.col(gone_).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone_).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")).cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
