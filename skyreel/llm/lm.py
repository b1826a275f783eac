"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The count of an n-gram is quantised to a level (1, 2, 3, 4, 6, 8, 12, ...: ``level_of``), and the n-gram goes into the filter once for each
level up to its own. A probe asks for level 1, 2, ... until one is missing, so it takes as many steps as the logarithm of the count;
a false answer can only raise a count, and by ``s`` levels only with the s-th power of the error rate. Token counts all go in, longer
n-grams from ``cutoff`` occurrences on.

A token's probability mixes orders: the n-gram's count over its context's, and what the shorter context gives, by weights for
each level of the context's count. The weights come from deleted interpolation over all training tokens: a token counts for
the order that predicts it best when it is left out of the counts.

The filter is cut into segments; an n-gram lies in one of them with all its levels. A filter of up to ``FILTER_MOST`` bytes
is broadcast. A larger one lies in files of the shared folder, which workers search one after another for the n-grams of many texts
at once; nothing of the texts is moved. Beyond ``FILES_MOST`` bytes it stays a table: the n-grams of the texts are shuffled to the segments.
Exact token counts, which the base score needs, are broadcast for at most ``COMMON_WORDS`` frequent tokens; the others are joined.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import checkpointed, prepared, shared_folder
from .hashing import PLACES, STEP, U, mixed

END = mixed(np.array([77], U))[0]
"""Stands for the end of a text, and for what comes before its first word."""
ITEM_BITS, ITEM_PROBES = 12, 4
"""Bits of the filter for each n-gram and level, and how many of them one sets (in one 64-bit word)."""
SEGMENT_WORDS = 8192
FILTER_MOST = 128 << 20
FILES_MOST = 4 << 30
SLICE_SEGMENTS = 512
"""Segments of the filter in one file (32 MB)."""
GATHERED = 12 << 20
"""Bytes of text that a worker looks up at once in the files."""
COMMON_WORDS = 1 << 20
HELD = 1 << 22
"""Tokens a worker gathers before it counts them."""
SALTS = 8
LEVELS = np.array([1, *[v << k for k in range(61) for v in (2, 3)]], np.int64)
"""The least count of each level: 1, 2, 3, and twice what lies two levels below."""
VALUES = np.r_[0.0, LEVELS[:-1] / 2 + (LEVELS[1:] - 1) / 2, float(LEVELS[-1])]
"""The count a level stands for."""


def level_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, n, "right")


def _level(n: Column) -> Column:
    """``level_of`` as a column expression."""
    bits = F.length(F.bin(n)) - 1
    return F.when(n < 2, F.lit(1)).otherwise(2 * bits + (n >= 3 * F.pow(F.lit(2.0), bits - 1)).cast("int"))


def _marks(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The word inside its segment, and the bits in it, of each n-gram at a level."""
    h = mixed(grams + U(level * int(STEP) % (1 << 64)))
    mask = np.zeros(len(h), U)
    for k in range(ITEM_PROBES):
        mask |= U(1) << ((h >> U(6 * k)) & U(63))
    return (h >> U(40)) % U(SEGMENT_WORDS), mask


def probe(bits: np.ndarray, segment: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The level of each n-gram, by probes of rising levels; ``bits``: (segments, SEGMENT_WORDS)."""
    level, open_, step = np.zeros(len(grams), np.int64), np.arange(len(grams)), 0
    while len(open_) and step < len(LEVELS):
        step += 1
        word, mask = _marks(grams[open_], step)
        open_ = open_[bits[segment[open_], word] & mask == mask]
        level[open_] = step
    return level


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some rows, each row's end behind its words, and the row of each."""
    base = offsets[0]
    words, starts = hashing.word_hashes(data[base : offsets[-1]], offsets - base)
    row = np.searchsorted(offsets - base, starts, "right") - 1
    count = len(offsets) - 1
    out = np.full(len(words) + count, END)
    out[np.arange(len(words)) + row] = words
    return out, np.sort(np.r_[row, np.arange(count)])


def _grams(tokens: np.ndarray, row: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-grams of 1 to ``order`` tokens that end at each token; a text is preceded by ends."""
    at = np.arange(len(tokens)) - np.searchsorted(row, row)
    total, out = np.zeros(len(tokens), U), []
    for k in range(order):
        back = np.r_[np.full(min(k, len(tokens)), END), tokens[: max(len(tokens) - k, 0)]]
        total = total + np.where(at >= k, back, END) * PLACES[k]
        out.append(mixed(total + U(k)))
    return out


def _before(grams: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The context of k tokens of each token, as the n-gram that ends just before it."""
    first = np.searchsorted(row, row) == np.arange(len(row))
    return np.where(first, blank(k), np.r_[grams[:1], grams[:-1]])


def blank(k: int) -> np.uint64:
    """The n-gram of k ends."""
    return mixed(np.array([sum(int(END) * int(PLACES[j]) for j in range(k)) % (1 << 64)], U) + U(k - 1))[0]


def _pieces(batch: pa.RecordBatch):
    """(first row, tokens, rows) of row ranges of bounded size."""
    data, offsets = hashing.text_bytes(batch.column("text"))
    for first, last in hashing.pieces(data, offsets):
        yield first, last, *_tokens(data, offsets[first : last + 1])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def gram_counts(documents: DataFrame, order: int) -> DataFrame:
    """(size, gram, n): how often each n-gram of 1 to ``order`` tokens occurs, n-grams as 64-bit hashes."""

    def count(batches):
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        texts = 0

        def handed():
            for k in range(order):
                grams = np.concatenate(held[k])
                if 0 < k < order - 1:
                    grams = np.r_[grams, np.full(texts, blank(k + 1))]  # contexts of first words
                found, n = np.unique(grams, return_counts=True)
                held[k] = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k + 1, np.int8)), pa.array(found.view(np.int64)), pa.array(n)], ["size", "gram", "n"])

        for batch in batches:
            for first, last, tokens, row in _pieces(batch):
                for k, grams in enumerate(_grams(tokens, row, order)):
                    held[k].append(grams)
                texts += last - first
                if sum(map(len, held[0])) > HELD:
                    yield from handed()
                    texts = 0
        if held[0]:
            yield from handed()

    return _texts(documents).mapInArrow(count, "size byte, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    order: int
    total: int
    distinct: int
    segments: int
    counts: DataFrame
    bits: DataFrame
    common: Broadcast
    least_common: int
    loaded: Broadcast | None
    files: list[str | None] | None = None
    per_file: int = 0
    weights: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self):
        """What workers get: no tables."""
        return self.__dict__ | {"counts": None, "bits": None}


def train(documents: DataFrame, order: int = 2, cutoff: int = 2) -> Model:
    """The model of ``documents`` (doc_id, text). Every row counts; null texts are empty, an empty text is one end."""
    spark = prepared(documents.sparkSession)
    counts = checkpointed(gram_counts(documents, order).where((F.col("size") == 1) | (F.col("n") >= cutoff)))
    told = counts.agg(
        F.sum(F.when(F.col("size") == 1, F.col("n"))).alias("total"), F.count(F.when(F.col("size") == 1, True)).alias("distinct"), F.sum(_level(F.col("n"))).alias("items")
    ).first()
    segments = max(1, math.ceil((told["items"] or 0) * ITEM_BITS / (64 * SEGMENT_WORDS)))
    bits = checkpointed(_filter(counts, segments))
    loaded = None
    if segments * SEGMENT_WORDS * 8 <= FILTER_MOST:  # the size is known before anything is gathered
        whole = np.zeros((segments, SEGMENT_WORDS), U)
        for batch in bits.toArrow().to_batches():
            for segment, packed in zip(batch.column("segment").to_pylist(), batch.column("bits")):
                whole[segment] = np.frombuffer(packed.as_buffer(), U)
        loaded = spark.sparkContext.broadcast(whole)
    files = _files(bits, segments, SLICE_SEGMENTS) if loaded is None and segments * SEGMENT_WORDS * 8 <= FILES_MOST else None
    tokens = counts.where(F.col("size") == 1)
    least = _least_common(tokens)
    frequent = tokens.where(F.col("n") >= least).select("gram", "n").toArrow()
    gram, n = frequent["gram"].to_numpy(), frequent["n"].to_numpy()
    by = np.argsort(gram)
    model = Model(order, told["total"] or 0, told["distinct"], segments, tokens, bits, spark.sparkContext.broadcast((gram[by], n[by])), least, loaded, files, SLICE_SEGMENTS)
    model.weights = _weights(_texts(documents), model)
    return model


def _least_common(tokens: DataFrame) -> int:
    """A power of two that at most COMMON_WORDS tokens reach in count."""
    sizes = sorted(((r["b"], r["count"]) for r in tokens.groupBy(F.length(F.bin("n")).alias("b")).count().collect()), reverse=True)
    least, held = 1 << 62, 0
    for b, count in sizes:
        held += count
        if held > COMMON_WORDS:
            break
        least = 1 << (b - 1)
    return least


def _filter(counts: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): the filter's segments. Hashes deal out n-grams evenly, so a segment's are bounded by its size."""

    def build(batches):
        for batch in batches:
            packed = []
            for entries in batch.column("entries"):
                gram = entries.values.field("gram").to_numpy().view(U)
                level = level_of(entries.values.field("n").to_numpy())
                words = np.zeros(SEGMENT_WORDS, U)
                for step in range(1, int(level.max()) + 1):
                    word, mask = _marks(gram[level >= step], step)
                    np.bitwise_or.at(words, word, mask)
                packed.append(words.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(packed, pa.binary())], ["segment", "bits"])

    grouped = counts.groupBy(F.pmod("gram", F.lit(segments)).cast("int").alias("segment")).agg(F.collect_list(F.struct("gram", "n")).alias("entries"))
    return grouped.mapInArrow(build, "segment int, bits binary")


def _files(bits: DataFrame, segments: int, per_file: int) -> list[str | None]:
    """The filter as files of ``per_file`` segments in the shared folder, in order; None where there is no n-gram.

    A task that runs again writes other files; only those named in the result count.
    """
    folder = f"{shared_folder(bits.sparkSession)}/filter-{uuid.uuid4().hex}"

    def put(batches):
        number, name, out, following = None, None, None, 0

        def ended():
            out.write(bytes(SEGMENT_WORDS * 8) * (min((number + 1) * per_file, segments) - following))
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name])], ["number", "file"])

        for batch in batches:
            for of, segment, packed in zip(*(batch.column(c).to_pylist() for c in ("number", "segment", "bits"))):
                if of != number:
                    if out is not None:
                        yield ended()
                    number, name, following = of, f"{folder}/{uuid.uuid4().hex}.bits", of * per_file
                    system, path = fs.FileSystem.from_uri(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path)
                out.write(bytes(SEGMENT_WORDS * 8) * (segment - following))
                out.write(packed)
                following = segment + 1
        if out is not None:
            yield ended()

    count = math.ceil(segments / per_file)
    dealt = bits.select(F.floor(F.col("segment") / per_file).cast("int").alias("number"), "segment", "bits").repartition(min(count, 1_000), "number")
    written = checkpointed(dealt.sortWithinPartitions("number", "segment").mapInArrow(put, "number int, file string"))
    names = {r["number"]: r["file"] for r in written.collect()}  # a row for each file
    return [names.get(k) for k in range(count)]


def _file_bits(uri: str) -> np.ndarray:
    """(segments, SEGMENT_WORDS) of a file; one on this host is mapped, not read."""
    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        held = pa.memory_map(path).read_buffer()
    else:
        with system.open_input_file(path) as source:
            held = source.read_buffer()
    return np.frombuffer(held, U).reshape(-1, SEGMENT_WORDS)


def _levels(model: Model, grams: np.ndarray) -> np.ndarray:
    """Levels by the broadcast filter or its files; each distinct n-gram is probed once."""
    found, back = np.unique(grams, return_inverse=True)
    segment = found.view(np.int64) % model.segments
    if model.loaded is not None:
        return probe(model.loaded.value, segment, found)[back]
    level = np.zeros(len(found), np.int64)
    place = segment // model.per_file
    for k, uri in enumerate(model.files):
        here = np.flatnonzero(place == k)
        if uri is not None and len(here):
            level[here] = probe(_file_bits(uri), segment[here] - k * model.per_file, found[here])
    return level[back]


def _asked(texts: DataFrame, order: int) -> DataFrame:
    """(row, times, g1.., c2..): the distinct n-grams of each row with their contexts."""
    names = [*[f"g{k}" for k in range(1, order + 1)], *[f"c{k}" for k in range(2, order + 1)]]

    def ask(batches):
        for batch in batches:
            number = batch.column("row").to_numpy()
            for first, _, tokens, row in _pieces(batch):
                grams = _grams(tokens, row, order)
                keys = [*grams, *[_before(grams[k - 2], row, k - 1) for k in range(2, order + 1)]]
                table = np.stack([number[first:][row].view(U), *keys])
                found, times = np.unique(table, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c.copy().view(np.int64)) for c in [*found, times]], ["row", *names, "times"])

    kind = ", ".join(f"{n} long" for n in ["row", *names, "times"])
    return texts.mapInArrow(ask, kind)


def _probed(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """``rows`` with the level of n-gram ``key`` in its place: rows meet their segment of the filter in a shuffle, several tasks a segment."""
    names = rows.columns
    dealt = rows.select(F.pmod(key, F.lit(model.segments)).cast("int").alias("__segment"), F.pmod("row", F.lit(SALTS)).cast("int").alias("__salt"), F.lit(None).cast("binary").alias("__bits"), *names)
    parts = model.bits.select(F.col("segment").alias("__segment"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"), F.col("bits").alias("__bits"), *[F.lit(None).cast("long").alias(n) for n in names])

    def look(batches):
        at, words = None, None
        for batch in batches:
            segment = batch.column("__segment").to_numpy()
            grams, level = batch.column(key).fill_null(0).to_numpy().view(U), np.zeros(batch.num_rows, np.int64)
            filled = np.flatnonzero(batch.column("__bits").is_valid().to_numpy(zero_copy_only=False))
            for first, last in zip(np.r_[0, filled], np.r_[filled, batch.num_rows]):
                if len(filled) and first in filled:
                    at, words = int(segment[first]), np.frombuffer(batch.column("__bits")[int(first)].as_buffer(), U)[None]
                    first += 1
                here = np.arange(first, last)
                here = here[segment[here] == at]
                level[here] = probe(words, np.zeros(len(here), np.int64), grams[here]) if len(here) else 0
            keep = batch.column("__bits").is_null()
            columns = [pa.array(level) if n == key else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = parts.unionByName(dealt).repartition(width, "__segment", "__salt").sortWithinPartitions("__segment", "__salt", F.col("__bits").isNull())
    return met.mapInArrow(look, rows.schema)


def _told(texts: DataFrame, model: Model) -> DataFrame:
    """``_asked`` with levels in place of n-grams."""
    rows = _asked(texts, model.order)
    for key in [c for c in rows.columns if c not in ("row", "times")]:
        rows = _probed(rows, model, key)
    return rows


def _wins(levels: list[np.ndarray], contexts: list[np.ndarray], total: int):
    """For every order from 2: (level of the context, whether the order predicts better than the shorter one), each token left out of the counts."""
    below = np.maximum(VALUES[levels[0]] - 1, 0) / max(total - 1, 1)
    for k in range(1, len(levels)):
        seen = VALUES[contexts[k - 1]]
        share = np.where(seen > 1, np.maximum(VALUES[levels[k]] - 1, 0) / np.maximum(seen - 1, 1), 0.0)
        yield contexts[k - 1], (share >= below) & (share > 0)
        below = share


def _weights(texts: DataFrame, model: Model) -> list[np.ndarray]:
    """A weight for each order from 2 and level of its context, from all rows."""
    order, top = model.order, len(LEVELS) + 1

    def summed(told) -> pa.RecordBatch:
        lost, won = np.zeros((order - 1, top)), np.zeros((order - 1, top))
        for levels, contexts, times in told:
            for k, (context, better) in enumerate(_wins(levels, contexts, model.total)):
                won[k] += np.bincount(context[better], None if times is None else times[better], top)
                lost[k] += np.bincount(context[~better], None if times is None else times[~better], top)
        k, level = np.nonzero(won + lost)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(level), pa.array(won[k, level]), pa.array(lost[k, level])], ["k", "level", "won", "lost"])

    def scan(batches):
        yield summed((levels, contexts, None) for batch in _gathered(model, batches) for *_, levels, contexts in _level_pieces(model, batch))

    def fold(batches):
        yield summed(
            ([b.column(f"g{k}").to_numpy() for k in range(1, order + 1)], [b.column(f"c{k}").to_numpy() for k in range(2, order + 1)], b.column("times").to_numpy()) for b in batches
        )

    kind = "k long, level long, won double, lost double"
    if _at_hand(model):
        counted = texts.mapInArrow(scan, kind)
    else:
        counted = _told(texts.select(F.monotonically_increasing_id().alias("row"), "text"), model).mapInArrow(fold, kind)
    weights = [np.zeros(top) for _ in range(order - 1)]
    for r in counted.groupBy("k", "level").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost")).collect():  # at most a row for each level
        weights[r["k"]][r["level"]] = r["won"] / (r["won"] + r["lost"] + 1)
    return weights


def _at_hand(model: Model) -> bool:
    """Whether workers reach the filter from where the texts are."""
    return model.loaded is not None or model.files is not None


def _gathered(model: Model, batches):
    """``batches``, larger ones where each look-up goes through files."""
    if model.files is None:
        yield from batches
        return
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _level_pieces(model: Model, batch: pa.RecordBatch):
    """``_pieces`` with the levels of their n-grams and of the contexts."""
    blanks = [np.array([blank(k)], U) for k in range(1, model.order)]
    if model.files is None:
        for first, last, tokens, row in _pieces(batch):
            levels = [_levels(model, g) for g in _grams(tokens, row, model.order)]
            yield first, last, tokens, row, levels, _contexts(levels, [_levels(model, b)[0] for b in blanks], row)
        return
    pieces = list(_pieces(batch))
    if not pieces:
        return
    grams = [*blanks, *(g for _, _, tokens, row in pieces for g in _grams(tokens, row, model.order))]
    ends = np.cumsum([len(g) for g in grams])
    found = np.split(_levels(model, np.concatenate(grams)), ends[:-1])
    starts, rest = [f[0] for f in found[: len(blanks)]], iter(found[len(blanks) :])
    for first, last, tokens, row in pieces:
        levels = [next(rest) for _ in range(model.order)]
        yield first, last, tokens, row, levels, _contexts(levels, starts, row)


def _contexts(levels: list[np.ndarray], starts: list[int], row: np.ndarray) -> list[np.ndarray]:
    """The level of each token's context, for every order from 2; ``starts`` are those of a text's first token."""
    first = np.searchsorted(row, row) == np.arange(len(row))
    return [np.where(first, start, np.r_[of[:1], of[:-1]]) for start, of in zip(starts, levels)]


def log10_probability(levels: list[np.ndarray], contexts: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the smoothed probability of each token."""
    p = (VALUES[levels[0]] + 0.5) / (model.total + 0.5 * (model.distinct + 1))
    p = np.minimum(p, 1.0)
    for k in range(1, model.order):
        seen = VALUES[contexts[k - 1]]
        share = np.minimum(1.0, VALUES[levels[k]] / np.maximum(seen, 1))
        weight = np.where(seen > 0, model.weights[k - 1][contexts[k - 1]], 0.0)
        p = weight * share + (1 - weight) * p
    return np.log10(p)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of ``documents`` (doc_id, text), repeated rows and null ids too.

    ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, with exact counts; ``score`` the model's log10 probabilities.
    Null and empty texts, and texts without a word, are one end.
    """
    prepared(documents.sparkSession)
    at_hand = _at_hand(model)

    def run(batches):
        known_grams, known_n = model.common.value
        logs = np.log10(known_n + 0.5)
        for batch in _gathered(model, batches):
            size = batch.num_rows
            n_tokens, n_known, base, score, rest = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), []
            for first, last, tokens, row, *told in _level_pieces(model, batch) if at_hand else _pieces(batch):
                here = slice(first, last)
                count = last - first
                n_tokens[here] = np.bincount(row, minlength=count)
                if at_hand:
                    score[here] = np.bincount(row, log10_probability(*told, model), count)
                gram = _grams(tokens, row, 1)[0].view(np.int64)
                at = np.minimum(np.searchsorted(known_grams, gram), max(len(known_grams) - 1, 0))
                common = known_grams[at] == gram if len(known_grams) else np.zeros(len(gram), bool)
                n_known[here] = np.bincount(row[common], minlength=count)
                base[here] = np.bincount(row[common], logs[at[common]], count)
                other = gram[~common]
                rest += [other[a:b] for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.searchsorted(row[~common], np.arange(count + 1))))]
            lengths = np.r_[0, np.cumsum([len(r) for r in rest])].astype(np.int32)
            flat = np.concatenate(rest) if rest else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                ["doc_id", "n_tokens", "n_known", "base", "score", "rest"],
            )

    texts = _texts(documents)
    if not at_hand:
        texts = checkpointed(texts)
    read = checkpointed(texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, score double, rest array<long>")).withColumn("row", F.monotonically_increasing_id())
    rare = model.counts.where(F.col("n") < model.least_common).select("gram", "n")
    others = read.select("row", F.explode("rest").alias("gram")).join(rare, "gram", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("found"))
    whole = read.join(others, "row", "left")
    if not at_hand:
        told = _told(texts.select(F.monotonically_increasing_id().alias("row"), "text"), model)  # the same partitions, so the same numbers
        whole = whole.drop("score").join(_mixed(told, model).groupBy("row").agg(F.sum("log10").alias("score")), "row", "left")
    norm = math.log10(model.total + 0.5 * (model.distinct + 1))
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _mixed(told: DataFrame, model: Model) -> DataFrame:
    """(row, log10): the probability of each distinct n-gram of a row, times its number."""

    def run(batches):
        for b in batches:
            levels = [b.column(f"g{k}").to_numpy() for k in range(1, model.order + 1)]
            contexts = [b.column(f"c{k}").to_numpy() for k in range(2, model.order + 1)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(log10_probability(levels, contexts, model) * b.column("times").to_numpy())], ["row", "log10"])

    return told.mapInArrow(run, "row long, log10 double")
