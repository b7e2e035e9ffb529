"""Archives as other readers see them, and shard draws computed anew."""

import gzip
import math
import struct
import uuid
import zlib
from pathlib import Path

import xxhash

from cueframe.llm import sharding, warc
from cueframe.llm.common import stored


def members(data):
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data)
        data = d.unused_data


def test_archives_are_warc_files(spark, tmp_path):
    rows = [(1, "http://a/ü b", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (None, None, None), (4, "http://c", "y" * 3000)]
    folder = f"file://{tmp_path}/warc"
    index = stored(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder), "index")
    seen, types = set(), []
    for path in Path(tmp_path, "warc").glob("*.warc.gz"):
        data = path.read_bytes()
        parts = list(members(data))
        assert gzip.decompress(data) == b"".join(parts)
        for k, part in enumerate(parts):
            fields, block = warc.parse(part)
            assert part.startswith(b"WARC/1.1\r\n") and part.endswith(b"\r\n\r\n")
            types.append(fields["WARC-Type"])
            assert (fields["WARC-Type"] == "warcinfo") == (k == 0)
            seen.add(uuid.UUID(fields["WARC-Record-ID"].removeprefix("<urn:uuid:").removesuffix(">")))
            assert all(c.isascii() and c.isprintable() for v in fields.values() for c in v)
            if k:
                assert block.startswith(b"HTTP/1.1 200 OK\r\n") and fields["Content-Type"] == "application/http;msgtype=response"
            assert " " not in fields.get("WARC-Target-URI", "")
    assert len(seen) == len(types) and types.count("revisit") == 2 and types.count("response") == 3
    # byte ranges of the index are whole members
    for r in index.collect():
        data = Path(tmp_path, "warc", r.archive).read_bytes()[r.offset : r.offset + r.length]
        fields, _ = warc.parse(gzip.decompress(data))
        assert fields["WARC-Type"] == r.record_type and fields.get("Page-ID") == (None if r.page_id is None else str(r.page_id))


def test_a_revisit_must_agree_with_its_response(spark):
    import pytest

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    good = [(1, 5, "S", "response", None, "u"), (2, 5, "S", "revisit", 1, "u")]
    assert {tuple(r) for r in warc.checked(spark.createDataFrame(good, kind)).collect()} == set(good)
    for wrong in ((2, 6, "S", "revisit", 1, "u"), (2, 5, "T", "revisit", 1, "u"), (2, 5, "S", "revisit", 9, "u")):
        with pytest.raises(Exception, match="does not agree"):
            warc.checked(spark.createDataFrame([good[0], wrong], kind)).collect()


def draw(key, name, weight):
    h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    h = xxhash.xxh64_intdigest(name.encode(), seed=h)
    return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight


def way_down(key, node):
    while node.shard is None:
        live = [c for c in node.children if c.weight > 0]
        node = min(live, key=lambda c: draw(key, c.name, c.weight)) if len(live) > 1 else live[0]
    return node.shard


def test_shards_as_drawn_by_hand(spark):
    ids = [*range(-50, 1500), 2**62, None]
    df = spark.createDataFrame([(i, "t", i) for i in ids], "doc_id long, text string, shard long")
    for shards, weights in ((8, None), (5, {1: 3.0, 4: 0.0}), (11, {10: 0.25})):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(df, shards, weights).collect()}
        now, grown = sharding.tree(shards, shards, weights), sharding.tree(shards + 1, shards, weights)
        assert got == {i: (way_down(i, now), way_down(i, grown)) for i in ids}
