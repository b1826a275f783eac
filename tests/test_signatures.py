"""Media types: every signature is reached, tables from files, and what the trie asks for."""

import itertools

from pyspark.sql import functions as F

from skyreel.functions import media, signatures
from skyreel.functions.constants import MAGIC_BYTES, MEDIA_TYPES


def laid(segments, filling=0x41):
    out = bytearray()
    for at, magic in segments:
        out += bytes([filling]) * (at - len(out)) + bytes.fromhex(magic)
    return out


def agrees(head, segments):
    return all(head[at : at + len(magic) // 2] == bytes.fromhex(magic) for at, magic in segments)


def plain(head):
    hits = {kind for segments, kind in MAGIC_BYTES if agrees(bytes(head[:512]), segments)}
    return hits.pop() if len(hits) == 1 else None


def detected(spark, heads):
    rows = spark.createDataFrame([(k, bytearray(h)) for k, h in enumerate(heads)], "k long, head binary")
    return [r.kind for r in rows.select("k", media.detect_type(F.col("head")).alias("kind")).orderBy("k").collect()]


def test_every_signature_is_reached(spark):
    assert detected(spark, [laid(s) + b"tail" for s, _ in MAGIC_BYTES]) == [kind for _, kind in MAGIC_BYTES]


def test_two_signatures_one_short_and_long_heads(spark):
    heads = [laid(sorted((*a, *b))) for (a, _), (b, _) in itertools.combinations(MAGIC_BYTES, 2) if not {x for x, _ in a} & {x for x, _ in b} and a[0][0] + len(a[0][1]) // 2 <= max(x for x, _ in b)]
    heads += [laid(s)[:-1] for s, _ in MAGIC_BYTES] + [b"", b"\x00", b"G" * 377, b"G" * 376, b"x" * 600, b"A" * 508 + b"%PDF"]
    assert detected(spark, heads) == [plain(h) for h in heads]
    assert sum(k is None for k in map(plain, heads)) > 20


def test_nodes_share_what_lies_before_them():
    trie = signatures.Trie([(((0, "AABBCC"),), "x"), (((0, "AABBDD"), (9, "01")), "y"), (((0, "AABB"),), "z"), (((4, "AABB"),), "w")])
    (shared, below), = trie.branches[0]
    assert shared == "AABB" and below.types == ["z"] and [m for m, _ in below.branches[2]] == ["CC", "DD"]
    assert list(trie.branches) == [0, 4]


def test_tables_of_types(spark, tmp_path):
    path = tmp_path / "mime.types"
    path.write_text("# notes\n\napplication/x-new\tnew NEWER\napplication/x-other new # more\nvideo/x-typescript ts\ntext/none\n")
    types = signatures.read_types(spark, str(path))
    assert (types["new"], types["newer"], types["ts"], types["pdf"]) == ("application/x-new", "application/x-new", "video/mp2t", "application/pdf")
    assert len(types) > len(signatures.public_types()) > len(MEDIA_TYPES) + 50
    names = spark.createDataFrame([("a.NEW",), ("b.xpm",), ("c.tar.gz",), ("d",), ("e.",), (None,)], "n string")
    got = [r[0] for r in names.select(media.guess_content_type(F.col("n"), types)).collect()]
    assert got == ["application/x-new", "image/x-xpixmap", "application/x-gzip", "application/octet-stream", "application/octet-stream", "application/octet-stream"]
