"""Spelling variants: words one edit apart, by a bit-sliced position index, and the form each is a variant of.

The index of a block of words holds, for every position and letter, the set of its words with that letter there, as a
bitset. A query reads its letters from left to right and keeps three sets, all words of the block at once: those that
agree so far, those that agree but for one replaced letter, and those that agree but for one letter more, whose
positions are shifted by one. The lengths decide at the end.

Not every word meets every other. Two words one edit apart, the shorter of m letters, agree before the edit and behind it:
outside any region [s, e) of the shorter's letters that holds the edit. So words are posted under (m, s, e, their letters
outside), for the first half and for the second as the region, and a block of the index holds whole buckets of such
postings. A bucket of more than ``BUCKET_MOST`` words is dealt anew with its region halved, down to a region of one letter,
where the alphabet bounds it: no bucket grows with the vocabulary, and no pair is lost.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, prepared

RUN = "A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(65, 91)}
LEAST_LETTERS, LEAST_COUNT, RATIO, SLIPS = 7, 2, 10, 31
BLOCK_WORDS = 1024
"""Words of a block of the index; a block ends with a bucket."""
BUCKET_MOST = 1024
"""Words from which on a bucket is dealt anew with its region halved. The result does not depend on it."""
HELD = 200_000
"""Distinct words a worker counts before it hands its counts on."""
LONG_TEXT = 1 << 20
"""Characters from which on a text's runs are counted a slice at a time."""


def _runs(pattern: re.Pattern, text: str):
    if len(text) < LONG_TEXT:
        yield Counter(pattern.findall(text))
        return
    found = (m[0] for m in pattern.finditer(text))
    total: Counter = Counter()
    while some := list(islice(found, HELD)):
        total.update(some)
    yield total


def word_counts(documents: DataFrame, least: int = LEAST_LETTERS, slips: int = SLIPS) -> DataFrame:
    """(word, n): lower-cased (A-Z only) maximal runs of letters of at least ``least`` code points, and how often they occur.

    Where ``slips`` divides h, the crc32 of ``<doc_id>:<run>``, the run loses its code point h % length first; a null doc_id slips nowhere. Null texts
    hold no words. Every row counts, repeated ones too. Counts are added up in the worker before they are shuffled.
    """
    prepared(documents.sparkSession)
    pattern = re.compile(f"[{RUN}]{{{least},}}")  # a run that is too short stays so when it loses a letter

    def count(batches):
        held: dict[str, int] = {}

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for counted in _runs(pattern, (text or "").translate(LOWER)):
                    seed = None if key is None else zlib.crc32(f"{key}:".encode())
                    for run, n in counted.items():
                        if seed is not None:
                            h = zlib.crc32(run.encode(), seed)
                            if h % slips == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1 :]
                                if len(run) < least:
                                    continue
                        held[run] = held.get(run, 0) + n
                if len(held) > HELD:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _post(m: Column, s: Column, e: Column) -> Column:
    """A posting: the words of class ``m`` that agree in the letters before ``s`` and from ``e`` (of the shorter) on."""
    key = F.xxhash64(m, s, e, F.substring("word", F.lit(1), s), F.substring("word", F.length("word") - m + e + 1, m - e))
    return F.struct(m.alias("m"), s.alias("s"), e.alias("e"), key.alias("key"))


def _halved(m: Column, s: Column, e: Column) -> Column:
    middle = F.floor((s + e) / 2).cast("int")
    return F.array(_post(m, middle, e), _post(m, s, middle))


def _dealt(words: DataFrame) -> DataFrame:
    """(word, n, m, s, e, key): the postings of every word, in buckets of a bounded size; hot buckets are halved until they are."""
    length, zero = F.length("word"), F.lit(0)
    classes = F.concat(_halved(length, zero, length), _halved(length - 1, zero, length - 1))
    posts = words.select("word", "n", F.explode(classes).alias("p")).select("word", "n", "p.*")
    done = []
    while True:
        # a bucket of one word has nothing to find, and one whose region is a single letter is bounded by the alphabet
        sizes = posts.groupBy("m", "s", "e", "key").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > BUCKET_MOST) & (F.col("e") - F.col("s") > 1))
        hot = checkpointed(sizes.select("key"))
        if hot.isEmpty():
            return _union([*done, posts])
        done.append(posts.join(hot, "key", "left_anti"))
        again = posts.join(hot, "key", "left_semi")
        posts = checkpointed(again.select("word", "n", F.explode(_halved(F.col("m"), F.col("s"), F.col("e"))).alias("p")).select("word", "n", "p.*"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def near_in_block(words: list[str], bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of words of one bucket where j is i with one letter replaced or one letter more."""
    count = len(words)
    sizes = np.array([len(w) for w in words])
    longest = int(sizes.max())
    letters = np.zeros((count, longest + 1), np.uint32)
    for k, word in enumerate(words):
        letters[k, : len(word)] = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    wide = -(-count // 64) * 64

    def sets(of: np.ndarray) -> np.ndarray:
        """A bitset over the block's words for each row of booleans."""
        padded = np.zeros((len(of), wide), bool)
        padded[:, :count] = of
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def position(at: int) -> tuple[np.ndarray, np.ndarray]:
        """Position ``at`` of the index: its letters, ascending, and the bitset of each; the first is that of no letter."""
        found = np.unique(np.r_[np.uint32(0), letters[:, at]])
        return found, sets(letters[None, :, at] == found[:, None])

    named = np.unique(bucket)
    same = sets(bucket[None, :] == named[:, None])[np.searchsorted(named, bucket)]
    replaced, longer = np.zeros_like(same), np.zeros_like(same)
    of_size = {int(n): sets((sizes == n)[None, :])[0] for n in np.unique(sizes)}
    none = np.zeros(wide // 64, np.uint64)
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def end(size: int) -> None:
        """What the queries of ``size`` letters have found, once these are read."""
        ended = np.flatnonzero(sizes == size)
        if len(ended):
            hits = (replaced[ended] & of_size[size]) | ((longer[ended] | same[ended]) & of_size.get(size + 1, none))
            some = np.flatnonzero(hits.any(1))
            i, j = np.nonzero(np.unpackbits(hits[some].view(np.uint8), axis=1, bitorder="little"))
            out_i.append(ended[some[i]])
            out_j.append(j)

    here = position(0)
    end(0)
    for at in range(longest):
        after = position(at + 1)
        asked = letters[:, at]
        fits = here[1][np.searchsorted(here[0], asked)]
        place = np.searchsorted(after[0], asked)
        known = after[0][np.minimum(place, len(after[0]) - 1)] == asked
        shifted = np.where(known[:, None], after[1][np.minimum(place, len(after[0]) - 1)], np.uint64(0))
        longer = (longer | same) & shifted
        replaced = (replaced & fits) | (same & ~fits)
        same = same & fits
        end(at + 1)
        if not (same.any() or replaced.any() or longer.any()):
            break
        here = after
    return np.concatenate(out_i), np.concatenate(out_j)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every two of ``words`` (word, n; distinct) that differ by one inserted, deleted or replaced code point, both ways."""
    spark = prepared(words.sparkSession)

    def find(batches):
        held: list[tuple] = []

        def found(rows):
            keys = np.array([r[2] for r in rows])
            edge = np.r_[True, keys[1:] != keys[:-1], True]
            starts = np.flatnonzero(edge)
            lone = np.repeat(np.diff(starts) == 1, np.diff(starts))
            kept = np.flatnonzero(~lone)
            if not len(kept):
                return None
            rows, keys = [rows[k] for k in kept], keys[kept]
            i, j = near_in_block([r[0] for r in rows], keys)
            left, right = np.r_[i, j].tolist(), np.r_[j, i].tolist()
            if not left:
                return None
            return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in left], pa.string()), pa.array([rows[k][0] for k in right], pa.string()), pa.array([rows[k][1] for k in right], pa.int64())], ["word", "near", "near_n"])

        for batch in batches:
            held += zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), batch.column("key").to_pylist())
            while len(held) > BLOCK_WORDS:
                cut = BLOCK_WORDS
                while 0 < cut and held[cut][2] == held[cut - 1][2]:
                    cut -= 1
                if not cut:  # the bucket goes on: find its end
                    cut = next((k for k in range(BLOCK_WORDS, len(held)) if held[k][2] != held[0][2]), 0)
                    if not cut:
                        break
                block, held = held[:cut], held[cut:]
                if (result := found(block)) is not None:
                    yield result
        if held and (result := found(held)) is not None:
            yield result

    posts = _dealt(words)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = posts.select("word", "n", "m", "key").repartition(width, "key").sortWithinPartitions("m", "key").select("word", "n", "key")
    return spread.mapInArrow(find, "word string, near string, near_n long").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every row of ``words`` (word, n; distinct).

    ``form`` is the near word of the largest n (ties: the smallest word), if that is at least ``ratio`` times the word's own, else
    null; ``root`` follows forms to the last one. As n grows ``ratio``-fold with each form, a logarithm bounds the steps.
    """
    if ratio < 2:
        raise ValueError("forms must occur at least twice as often, or they could go in circles")
    words = checkpointed(words)
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    own = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"),
    )
    found = checkpointed(own.select("word", "n", "n_near", "f.form", "f.form_n"))
    # what a form's own form is: only words that are forms of others and have one themselves can move a root
    hops = checkpointed(found.where("form is not null").select("word", "form").join(found.where("form is not null").select(F.col("form").alias("word")).distinct(), "word", "left_semi"))
    most = found.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(2, math.log(most, ratio) + 1)))):
        step = hops.select(F.col("word").alias("form"), F.col("form").alias("further"))
        hops = checkpointed(hops.join(step, "form", "left").select("word", F.coalesce("further", "form").alias("form")))
    last = hops.select(F.col("word").alias("form"), F.col("form").alias("last"))
    return found.join(last, "form", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("last", "form", "word").alias("root"))


def of_documents(documents: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """The variants among the words of ``documents`` (doc_id, text): those of at least ``least`` code points that occur ``count`` times or more."""
    return variants(word_counts(documents, least).where(F.col("n") >= count), ratio)
