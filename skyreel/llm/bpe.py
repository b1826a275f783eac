"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, one after another, into a deterministic automaton whose arcs carry tokens and whose accepted
paths are exactly the tokenizations that the merges produce. Its state is the token last emitted. The gadget of a merge
``a b -> ab`` removes the arc ``b`` from state ``a``, gives every state that has an arc ``a`` an arc ``ab``, and lets
state ``ab`` start as a copy of state ``b``. Copies share their arcs with what they were copied from, so a gadget is one
row of three tables (parts, birth, removal) and an arc is looked up through them.

Texts are split on white space first; a pre-split word is read once from left to right: a trie of the arc labels gives
the arcs that fit, the automaton which of them exist, and one token ends at each place. Decoding emits the arc labels.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, tidied

BASE = -1
MEMO_MOST = 100_000
"""Words and arcs whose result a worker keeps at most."""
SPACES = "\t-\r \x85\xa0  -     　"
UNUSUAL_SPLIT = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {b: chr(b) for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in stand_in):
        stand_in[b] = chr(256 + k)
    return [stand_in[b] for b in range(256)]


class Memo(dict):
    """Keeps what ``make`` returns. When full it forgets the younger half: frequent keys come early."""

    def __init__(self, make, most: int = MEMO_MOST):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            for old in list(self)[self.most // 2 :]:
                del self[old]
        value = self[key] = self.make(key)
        return value


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values()) + 1
        self.left, self.right, self.born = [BASE] * size, [BASE] * size, [BASE] * size
        self.removed: dict[tuple[int, int], int] = {}
        for step, (a, b) in enumerate(merges):
            self._gadget(step, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self.trie: list[dict[str, int]] = [{}]
        self.token_at: list[int] = [BASE]
        self.arcs = Memo(self._has_arc)

    def _gadget(self, step: int, a: int, b: int, ab: int) -> None:
        self.left[ab], self.right[ab], self.born[ab] = a, b, step
        self.removed[a, b] = step

    def arc_at(self, x: int, y: int, step: int) -> bool:
        """Whether state ``x`` has the arc ``y`` once all gadgets before ``step`` are in."""
        while True:
            if self.removed.get((x, y), step) < step:
                return False
            if self.born[x] == BASE and self.born[y] == BASE:
                return True
            if self.born[x] > self.born[y]:
                step = self.born[x]  # state x began as a copy of its right part's state
                x = self.right[x]
            else:
                step = self.born[y]  # arc y was added where its left part had an arc
                if x == self.left[y] == self.right[y]:
                    return False  # of three equal tokens the first two merge
                y = self.left[y]

    def _has_arc(self, pair: tuple[int, int]) -> bool:
        return self.arc_at(*pair, len(self.removed))

    def add_label(self, symbols: list[str], token: int) -> None:
        node = 0
        for symbol in symbols:
            following = self.trie[node].get(symbol)
            if following is None:
                following = self.trie[node][symbol] = len(self.trie)
                self.trie.append({})
                self.token_at.append(BASE)
            node = following
        self.token_at[node] = token

    def path(self, symbols: list[str]) -> list[int]:
        """The tokens of the accepted path that spells ``symbols``."""
        size = len(symbols)
        last: list[int] = [BASE] * (size + 1)
        back = [0] * (size + 1)
        for at in range(size):
            state, node = last[at], 0
            for end in range(at, size):
                node = self.trie[node].get(symbols[end])
                if node is None:
                    break
                token = self.token_at[node]
                if token != BASE and last[end + 1] == BASE and (at == 0 or self.arcs[state, token]):
                    last[end + 1], back[end + 1] = token, at
        out, at = [], size
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]


class Codec:
    """A byte-level vocabulary file with word ends, as the JSON of the public tokenizers."""

    def __init__(self, description: str, special: bool = True):
        about = json.loads(description)
        model = about["model"]
        vocabulary = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.automaton = Automaton(vocabulary, merges)
        self.symbols = byte_symbols()
        for label, token in vocabulary.items():
            whole = bool(self.end) and label.endswith(self.end) and len(label) > len(self.end)
            letters = list(label[: -len(self.end)] if whole else label)
            if whole:
                letters[-1] += self.end
            self.automaton.add_label(letters, token)
        added = {x["content"]: x["id"] for x in about["added_tokens"]}
        self.labels = _labels(about)
        self.added = {s: np.array([i], "<u4").tobytes() for s, i in added.items()} if special else {}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pattern = next(x["pattern"]["Regex"] for x in about["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACES))
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.chunks = Memo(self._chunk)
        self.pieces = Memo(self._piece)

    def _piece(self, word: str) -> bytes:
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.end
        return np.array(self.automaton.path(symbols), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.words.findall(chunk)))

    def _ordinary(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # letter by letter: no final form
        text = text.lower()
        chunks = text.split() if not UNUSUAL_SPLIT.search(text) else self.spaces.split(text)
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.between is None or "<" not in text:
            return self._ordinary(text)
        return b"".join(self.added.get(part) or self._ordinary(part) for part in self.between.split(text) if part)

    def decode(self, ids: bytes | None) -> str:
        return said(ids, self.labels)


def said(ids: bytes | None, labels: dict[int, str]) -> str:
    return " ".join([labels[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


def _labels(about: dict) -> dict[int, str]:
    """The text of each token, added ones too."""
    added = {x["content"]: x["id"] for x in about["added_tokens"]}
    return {i: s for s, i in (about["model"]["vocab"] | added).items()}


@lru_cache(maxsize=4)
def _codec(description: str, special: bool) -> Codec:
    return Codec(description, special)


@lru_cache(maxsize=4)
def _decoder(description: str) -> dict[int, str]:
    """All that a worker needs to decode: no automaton."""
    return _labels(json.loads(description))


def _text_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(rows: DataFrame, path: str, text: str = "text", ids: str = "token_ids", special: bool = True) -> DataFrame:
    """``rows`` with the column ``ids`` (packed little-endian 32-bit token ids of the whole text) in place of ``text``.

    Null and empty texts give no ids (an empty value). With ``special`` the strings of added tokens in a text become
    these tokens, otherwise they are ordinary text. Other columns go through unchanged; one named like ``ids`` is
    replaced. The vocabulary file is read on the driver and broadcast (a few MB).
    """
    spark = prepared(rows.sparkSession)
    shared = spark.sparkContext.broadcast(_text_of(path))
    others = [c for c in rows.columns if c not in (text, ids)]

    def run(batches):
        codec = _codec(shared.value, special)
        for batch in batches:
            packed = pa.array([codec.encode(t) for t in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), packed], [*others, ids])

    schema = rows.select(*others).withColumn(ids, F.lit(b"")).schema
    return rows.select(*others, F.col(text).cast("string").alias(text)).mapInArrow(tidied(run), schema)


def decode(rows: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the column ``text``: the arc labels of ``ids``, joined by blanks. No ids: an empty text."""
    spark = prepared(rows.sparkSession)
    shared = spark.sparkContext.broadcast(_text_of(path))
    kept = [c for c in rows.columns if c != text]

    def run(batches):
        labels = _decoder(shared.value)
        for batch in batches:
            told = pa.array([said(b, labels) for b in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), told], [*kept, text])

    return rows.select(*kept).mapInArrow(tidied(run), rows.select(*kept).withColumn(text, F.lit("")).schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, one row a document."""
    both = decode(encode(documents.select("doc_id", "text"), path), path)
    return both.select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
