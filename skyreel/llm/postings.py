"""Prefix postings of shingle sets, dealt out by token in packed form.

A set ``x`` and a set ``y`` with a Jaccard similarity of at least NUM / DEN share one of the first
``|x| - ceil(t |x|) + 1`` tokens of ``x`` in any fixed order of all tokens, and the same holds for ``y``. The order here
puts tokens that many sets hold last (by their counts over the whole corpus), all others in hash order before them.
Postings travel as packed arrays, one row for each (task, bucket of tokens), so Spark shuffles few wide rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import checkpointed, tidied

NUM, DEN = 75, 100
SHINGLE = 5
COMMON_LEAST = 32
"""A token counts as common from so many local repeats on; this only orders tokens."""
COMMON_MOST = 1 << 17
"""Most entries of the broadcast table of common tokens (12 bytes each). Tokens beyond it keep their hash order."""
CHUNK = 1 << 19
"""Tokens a task counts or packs at once."""
BUCKET_ROWS = 400_000
BROADCAST_ROWS = 1 << 19
"""A list of rows to read again is broadcast up to so many (about 40 bytes each), else joined by a shuffle."""
LEAST_LINKED = 3
"""A smaller set is similar to equal ones only (2 of 3 is under NUM / DEN), which are of its class already: it gets no postings."""
MOST = 65_535
"""Sizes and places are kept exactly below this. A larger set passes the filters unseen and is decided by its exact
overlap; a smaller place only weakens a filter."""
POSTING = np.dtype([("token", "<u4"), ("key", "<u8"), ("n", "<u2"), ("i", "<u2")])
"""32 bits of a token besides those that choose its bucket: a chance match only makes a candidate more."""
ALL_PAIRS = 32
"""Sets that share a token are compared pair by pair up to so many, else with PIVOTS of them first."""
PIVOTS = 6


def needed(size):
    """ceil(t * size)."""
    return -(-NUM * size // DEN)


class Sets:
    """Shingle sets of a slice of rows: ``tokens`` of set ``k`` lie in ``first[k]:last[k]``, ascending by hash."""

    def __init__(self, tokens, unit):
        self.tokens, unit = hashing.sets(tokens, unit)
        self.unit, self.first, self.last = hashing.spans(unit)
        self.size = self.last - self.first
        self.key, self.check = hashing.signatures(self.tokens, self.first)


Reader = Callable[[pa.RecordBatch], Iterator[tuple[Sets, np.ndarray, np.ndarray]]]
"""Yields the sets of a slice, and for each unit number its row in the batch and its number within the row."""


def document_sets(batch: pa.RecordBatch) -> Iterator[tuple[Sets, np.ndarray, np.ndarray]]:
    """One unit a row: the row's whole text."""
    data, offsets = hashing.text_bytes(batch.column("text"))
    for a, b in hashing.pieces(data, offsets):
        part = data[offsets[a] : offsets[b]]
        starts = offsets[a:b] - offsets[a]
        words, at = hashing.word_hashes(part, starts)
        unit = np.searchsorted(starts, at, "right") - 1
        yield Sets(*hashing.shingles(words, unit, SHINGLE)), np.arange(a, b), np.zeros(b - a, np.int64)


def line_sets(batch: pa.RecordBatch) -> Iterator[tuple[Sets, np.ndarray, np.ndarray]]:
    """One unit a line with a word, numbered from 0 in its row; lines end at a newline."""
    data, offsets = hashing.text_bytes(batch.column("text"))
    for a, b in hashing.pieces(data, offsets):
        part = data[offsets[a] : offsets[b]]
        rows = offsets[a:b] - offsets[a]
        words, at = hashing.word_hashes(part, rows)
        breaks = np.flatnonzero(part == hashing.NEWLINE)
        row = np.searchsorted(rows, at, "right") - 1
        line = np.searchsorted(breaks, at, "left")  # newlines before the word, in the slice
        unit = line + row  # ascends, and differs between rows and between lines
        number = np.zeros(int(unit[-1]) + 1 if len(unit) else 0, np.int64)
        owner = np.zeros(len(number), np.int64)
        owner[unit] = row + a
        number[unit] = line - np.searchsorted(breaks, rows[row], "left")
        yield Sets(*hashing.shingles(words, unit, SHINGLE)), owner, number


UNIT, TOKEN = 0, 1


def survey(texts: DataFrame, reader: Reader) -> DataFrame:
    """One pass over (id, mark, text). UNIT rows: id, mark and number of every unit with tokens, the size n of its set and
    two hashes (key, sig) of it. TOKEN rows: tokens (key) that a task meets in several different sets of a chunk, with
    counts (n)."""

    def look(batches):
        held, total = [], 0

        def row(kind, id_, mark, number, n, key, sig):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), id_, mark, pa.array(number), pa.array(n), pa.array(key), pa.array(sig)], ["kind", "id", "mark", "number", "n", "key", "sig"])

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            twice = counts > 1
            values, counts = values[twice], counts[twice]
            none = pa.nulls(len(values), pa.int64())
            zero = np.zeros(len(values), np.int64)
            return row(TOKEN, none, none, zero, counts.astype(np.int64), values.view(np.int64), zero)

        for batch in batches:
            for found, rows, number in reader(batch):
                at = pa.array(rows[found.unit])
                yield row(UNIT, batch.column("id").take(at), batch.column("mark").take(at), number[found.unit], found.size, found.key.view(np.int64), found.check.view(np.int64))
                _, once = np.unique(found.key, return_index=True)
                fresh = np.zeros(len(found.key), bool)
                fresh[once] = True
                fresh &= found.size >= LEAST_LINKED
                held.append(found.tokens[np.repeat(fresh, found.size)])
                total += len(held[-1])
                if total >= CHUNK:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(tidied(look), "kind int, id long, mark long, number long, n long, key long, sig long")


def common_tokens(seen: DataFrame, least: int = COMMON_LEAST, most: int = COMMON_MOST) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many sets hold, with counts, ascending by token: sums of the survey's counts over the whole corpus.

    At most ``most`` of them reach the driver. The table only orders tokens: results don't depend on it.
    """
    counted = seen.where(F.col("kind") == TOKEN).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = counted.orderBy(F.desc("n"), "key").limit(most).toArrow()
    tokens, counts = got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


class Order:
    """Ranks tokens: by count among the common ones, 0 for all others."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens, self.counts = tokens, counts
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int64)
        hit = np.flatnonzero(self.maybe[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(hit) and len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens[hit]), len(self.tokens) - 1)
            same = self.tokens[at] == tokens[hit]
            out[hit[same]] = self.counts[at[same]]
        return out


def prefixes(found: Sets, order: Order, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings of the ``chosen`` sets of a slice, and their tokens, mixed."""
    if not chosen.any():
        return np.zeros(0, POSTING), np.zeros(0, np.uint64)
    tokens = found.tokens[np.repeat(chosen, found.size)]
    size, key = found.size[chosen], found.key[chosen]
    owner = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    rank = order.rank(tokens)
    late = np.flatnonzero(rank)
    if len(late):  # the common ones go behind the others of their set
        early = np.flatnonzero(rank == 0)
        moved = late[np.lexsort((tokens[late], rank[late], owner[late]))]
        ahead = np.bincount(owner[early], minlength=len(size))
        place = np.empty(len(tokens), np.int64)
        place[early] = (np.arange(len(early)) - (np.cumsum(ahead) - ahead)[owner[early]]) + first[owner[early]]
        behind = np.bincount(owner[moved], minlength=len(size))
        place[moved] = (np.arange(len(moved)) - (np.cumsum(behind) - behind)[owner[moved]]) + (first + ahead)[owner[moved]]
        ordered = np.empty_like(tokens)
        ordered[place] = tokens
        tokens = ordered
    place = np.arange(len(tokens)) - first[owner]
    keep = place < (size - needed(size) + 1)[owner]
    owner, place = owner[keep], place[keep]
    out = np.empty(len(owner), POSTING)
    out["key"], out["n"], out["i"] = key[owner], np.minimum(size, MOST)[owner], np.minimum(place, MOST)
    return out, hashing.mixed(tokens[keep])


def buckets_for(tokens: int, width: int) -> int:
    """Buckets of about BUCKET_ROWS postings, and no fewer than the session's shuffle partitions."""
    return max(width, -(-tokens // (4 * BUCKET_ROWS)))


def dealt(rows: DataFrame, reader: Reader, common: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Packed postings by token bucket, each (token, set) once for each task's chunk: columns bucket, postings."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def pack(batches):
        order = Order(*shared.value)
        held, total, met = [], 0, set()

        def flush():
            token = np.concatenate([t for _, t in held])
            by = np.argsort(token)
            part, token = np.concatenate([p for p, _ in held])[by], token[by]
            bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            part["token"] = token.astype(np.uint32)
            which, first, last = hashing.spans(bucket)
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([part[a:b].tobytes() for a, b in zip(first, last)], pa.binary())], ["bucket", "postings"])

        for batch in batches:
            for found, _, _ in reader(batch):
                chosen = np.zeros(len(found.key), bool)
                linking = np.flatnonzero(found.size >= LEAST_LINKED)
                for at, key in zip(linking.tolist(), found.key[linking].tolist()):  # a set that this chunk has had adds nothing
                    if key not in met:
                        met.add(key)
                        chosen[at] = True
                held.append(prefixes(found, order, chosen))
                total += len(held[-1][1])
                if total >= CHUNK:
                    yield flush()
                    held, total, met = [], 0, set()
        if total:
            yield flush()

    return rows.mapInArrow(tidied(pack), "bucket int, postings binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")


def whole_buckets(batches) -> Iterator[np.ndarray]:
    """The postings of each bucket whose token occurs again, sorted by token and set, each once."""
    current, held = None, []

    def done():
        part = np.concatenate([np.frombuffer(h, POSTING) for h in held])
        part = part[np.argsort(part["token"])]
        same = part["token"][1:] == part["token"][:-1]
        part = part[np.r_[False, same] | np.r_[same, False]]
        part = part[np.lexsort((part["key"], part["token"]))]
        return part[np.r_[True, (part["token"][1:] != part["token"][:-1]) | (part["key"][1:] != part["key"][:-1])]] if len(part) else part

    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("postings")):
            if bucket != current and held:
                yield done()
                held = []
            current = bucket
            held.append(blob.as_py())
    if held:
        yield done()


def fitting(nx, ny):
    """Length filter."""
    nx, ny = np.asarray(nx).astype(np.int64), np.asarray(ny).astype(np.int64)
    return (DEN * np.minimum(nx, ny) >= NUM * np.maximum(nx, ny)) | (np.maximum(nx, ny) >= MOST)


def similar_enough(nx, ny, ix, iy):
    """Length and positional filters for two sets whose first common token lies at places ``ix`` and ``iy``."""
    nx, ny, ix, iy = (np.asarray(v).astype(np.int64) for v in (nx, ny, ix, iy))
    most = np.minimum(nx - ix, ny - iy)
    return fitting(nx, ny) & (((NUM + DEN) * most >= NUM * (nx + ny)) | (np.maximum(nx, ny) >= MOST))


RUN_SCHEMA = "kind int, token long, a long, b long, na long, nb long, shared long, close boolean"
PAIR, MEMBER = 0, 1


def runs(batches) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of fitting lengths that share tokens of their prefixes: in how many they met (``shared``), and
    whether one of these passes the positional filter (``close``). Runs of more than ALL_PAIRS sets give pairs with
    their PIVOTS (the sets in which the token comes first) and one MEMBER row a set (its size in na, its place in nb), for a second look."""

    def rows(kind, token, a, b, na, nb, shared, close):
        long = lambda x: pa.array(np.ascontiguousarray(x).astype(np.uint64, copy=False).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), long(token), long(a), long(b), long(na), long(nb), long(shared), pa.array(close)],
            names=["kind", "token", "a", "b", "na", "nb", "shared", "close"],
        )

    for part in whole_buckets(batches):
        if not len(part):
            continue
        _, first, last = hashing.spans(part["token"])
        length = last - first
        many = np.repeat(length, length)
        part = part[many > 1]
        many = many[many > 1]
        found = []

        def meet(x, y, keep):
            keep = keep & fitting(x["n"], y["n"])
            x, y = x[keep], y[keep]
            turn = x["key"] > y["key"]
            a, b = np.where(turn, y, x), np.where(turn, x, y)
            found.append((a["key"], b["key"], a["n"], b["n"], similar_enough(x["n"], y["n"], x["i"], y["i"])))

        small, widest = part[many <= ALL_PAIRS], int(many[many <= ALL_PAIRS].max(initial=0))
        for step in range(1, widest):
            x, y = small[:-step], small[step:]
            meet(x, y, x["token"] == y["token"])
        large = part[many > ALL_PAIRS]
        if len(large):
            large = large[np.lexsort((large["key"], large["i"], large["token"]))]
            _, first, last = hashing.spans(large["token"])
            start = np.repeat(first, last - first)
            for k in range(PIVOTS):
                meet(large, large[start + k], np.arange(len(large)) > start + k)
            none = np.zeros(len(large), np.uint64)
            yield rows(MEMBER, large["token"], large["key"], large["key"], large["n"], large["i"], none, none.astype(bool))
        if found:
            a, b, na, nb, close = (np.concatenate(x) for x in zip(*found))
            if len(a):
                by = np.lexsort((b, a))
                a, b, na, nb, close = a[by], b[by], na[by], nb[by], close[by]
                at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                shared = np.diff(np.r_[at, len(a)])
                yield rows(PAIR, np.zeros(len(at), np.uint64), a[at], b[at], na[at], nb[at], shared, np.maximum.reduceat(close, at))


def reachable(shared: Column, nx: Column, ny: Column) -> Column:
    """Whether sets of these sizes with at most so many common prefix tokens can be similar."""
    need = lambda n: F.ceil(F.lit(NUM) * n / F.lit(DEN))
    most = shared + F.greatest(need(nx), need(ny)) - 1
    return ((NUM + DEN) * most >= NUM * (nx + ny)) | (F.greatest(nx, ny) >= MOST)


def promising(found: DataFrame) -> DataFrame:
    """The pairs (a, b) that can still be similar.

    All common tokens but those that both prefixes hold lie behind the prefix that ends first, so with ``shared`` common
    tokens in the prefixes the overlap is at most ``shared + max(ceil(t na), ceil(t nb)) - 1``. Tokens of long runs, in
    which a pair may not have met, count as shared, and may hold the first common token, for the positional filter.
    """
    pairs = found.where(F.col("kind") == PAIR).groupBy("a", "b").agg(
        F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("shared").alias("shared"), F.max("close").alias("close")
    )
    long = found.where(F.col("kind") == MEMBER).groupBy("a").agg(F.count(F.lit(1)).alias("la"))
    pairs = pairs.join(long, "a", "left").join(long.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b", "left")
    unmet = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    return pairs.where(F.col("close") | (unmet > 0)).where(reachable(F.col("shared") + unmet, F.col("na"), F.col("nb"))).select("a", "b")


def candidates(packed: DataFrame) -> DataFrame:
    return packed.mapInArrow(tidied(runs), RUN_SCHEMA)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two ascending arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def set_table(texts: DataFrame, reader: Reader, keys: DataFrame) -> DataFrame:
    """(key, tokens) of the sets named in ``keys`` (id, key): the texts of those rows are read again."""

    def pack(batches):
        for batch in batches:
            lists = batch.column("keys")
            wanted = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            asked = set(zip(owner.tolist(), wanted.tolist()))
            for found, rows, _ in reader(batch):
                key = found.key.view(np.int64)
                right = []
                for k, pair in enumerate(zip(rows[found.unit].tolist(), key.tolist())):
                    if pair in asked:
                        asked.remove(pair)
                        right.append(k)
                tokens = [found.tokens[found.first[k] : found.last[k]].tobytes() for k in right]
                yield pa.RecordBatch.from_arrays([pa.array(key[right]), pa.array(tokens, pa.binary())], ["key", "tokens"])

    named = keys.groupBy("id").agg(F.collect_set("key").alias("keys"))
    named = F.broadcast(named) if keys.count() <= BROADCAST_ROWS else named.hint("shuffle_hash")
    return texts.join(named, "id").select("id", "text", "keys").mapInArrow(tidied(pack), "key long, tokens binary")


def linked(common: int, nx: int, ny: int) -> bool:
    return DEN * common >= NUM * (nx + ny - common)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set keys that are similar, by their exact overlap. ``sets``: key, tokens (packed, ascending)."""

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(linked(overlap(x, y), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = checkpointed(pairs.select("a", "b"))
    if pairs.count() <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidied(exact), "a long, b long")
