"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of its documents. A text is cut into blocks, each block is
compressed with every language's dictionary. A longer dictionary saves more in any text, so two languages are compared
at one length, the longest power of two that both dictionaries have; a language's standing is the sum of what it saves
against each other one, and the highest is chosen (with dictionaries of one length: the smallest total). No language's
dictionary depends on another's. The choice is marked as rejected when the margin to the second is narrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared

SAMPLE_ROWS = 80
"""Documents of each language that a dictionary is made of at most."""
LANGUAGES = 256
"""Languages that are learned at most by default, the most frequent ones."""
PIECES, PIECE = 8, 256
"""From each of these so many pieces of so many characters, spread over the whole text."""
FAINT = 1_024
"""Between languages one of which has fewer bytes than this, differences under NARROW count as none."""
BLOCK = 1_024
LEVEL = 7
NARROW = 0.02
UNKNOWN = "und"


def dictionaries(documents: DataFrame, languages: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each non-null ``lang`` of ``documents`` (doc_id, text, lang), from a bounded sample of rows.

    The driver gets a text a chosen (doc_id, lang), of several the smallest: at most SAMPLE_ROWS * PIECES * PIECE characters a
    language, for the ``languages`` with the most documents (ties: the smaller name). Rarer ones are never predicted.
    """
    prepared(documents.sparkSession)
    named = documents.where("lang is not null and text <> '' and doc_id is not null").select("doc_id", "lang").distinct()
    known = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    named = named.join(F.broadcast(known), "lang")
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = named.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= SAMPLE_ROWS)

    def cut(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text.lower()
                starts = np.linspace(0, max(0, len(text) - PIECE), PIECES if len(text) > PIECES * PIECE else max(1, len(text) // PIECE)).astype(int)
                out.append(" ".join(text[a : a + PIECE] for a in starts))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("turn"), pa.array(out, pa.string())], ["lang", "turn", "text"])

    texts = documents.select("doc_id", "lang", "text").where("text <> ''").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "turn").agg(F.min("text").alias("text"))
    got = texts.mapInArrow(cut, "lang string, turn int, text string").toArrow().to_pylist()
    out: dict[str, list[str]] = {}
    for row in sorted(got, key=lambda r: (r["lang"], -r["turn"], r["text"])):
        out.setdefault(row["lang"], []).append(row["text"])
    return {lang: "\n".join(v).encode() for lang, v in sorted(out.items())}


def _level(size: int) -> int:
    """The longest power of two that a dictionary of ``size`` bytes has."""
    return 1 << max(size, 1).bit_length() - 1


class Packers:
    """Compressors of every language at every length it is compared at."""

    def __init__(self, learned: dict[str, bytes]):
        self.names = list(learned)
        size = np.array([len(learned[n]) for n in self.names], np.int64)
        own = np.array([_level(int(n)) for n in size], np.int64)
        levels = np.unique(own)
        self.size, self.shared = size, np.searchsorted(levels, np.minimum(own[:, None], own[None, :]))  # place of the pair's length
        self.faint = np.minimum(size[:, None], size[None, :]) < FAINT
        self.packers = [[self._packer(learned[n][-int(level) :]) if level <= most else None for level in levels] for n, most in zip(self.names, own)]

    @staticmethod
    def _packer(data: bytes):
        prior = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prior.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=prior, write_content_size=False, write_dict_id=False).compress

    def choose(self, blocks: list[bytes]) -> tuple[str, float]:
        """The language and its margin to the second, as a share of the second's total."""
        count = len(self.names)
        if count == 1:
            return self.names[0], 1.0
        totals = np.array([[sum(len(pack(b)) for b in blocks) if pack else 0 for pack in row] for row in self.packers], np.int64)
        mine = totals[np.arange(count)[:, None], self.shared]
        saved = mine.T - mine  # what the row's language saves against the column's
        saved[self.faint & (np.abs(saved) < NARROW * np.maximum(mine, mine.T))] = 0
        order = np.lexsort((np.arange(count), -self.size * self.faint.any(1), -saved.sum(1)))
        best, second = int(order[0]), int(order[1])
        return self.names[best], max(0.0, float((mine[second, best] - mine[best, second]) / mine[second, best]))


PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def identified(documents: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score (the margin: how much smaller the best total is than the second, as a share), rejected.

    Null texts and texts without a letter give ``und`` with score 0, and so does everything if nothing was learned.
    Ties go to the longer dictionary where a very short one is among them, else to the language that comes first in the
    alphabet. With one language the score is 1.
    """
    spark = prepared(documents.sparkSession)
    shared = spark.sparkContext.broadcast(learned)

    def run(batches):
        packers = Packers(shared.value)
        for batch in batches:
            chosen, scores, narrow = [], [], []
            for text in batch.column("text").to_pylist():
                if not packers.names or not text or not any(map(str.isalpha, text)):
                    chosen.append(UNKNOWN)
                    scores.append(0.0)
                    narrow.append(True)
                    continue
                data = text.lower().encode()
                blocks = [data[a : a + BLOCK] for a in range(0, len(data), BLOCK)]
                name, margin = packers.choose(blocks)
                chosen.append(name)
                scores.append(margin)
                narrow.append(margin < NARROW)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chosen, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTED)
