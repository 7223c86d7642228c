import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import tiff

from . import fixtures


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE]))
def test_codecs_round_trip(data, scheme):
    assert tiff.DECODE[scheme](tiff.ENCODE[scheme](data)) == data


def test_lzw_clears_its_table():
    data = np.random.RandomState(0).bytes(60_000)
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_round_trip(scheme, predictor, tile):
    draw = np.random.RandomState(1)
    pages = [draw.randint(0, 256, (37, 50), dtype=np.uint8), draw.randint(0, 4, (5, 33, 3), dtype=np.uint8)]
    back = list(tiff.decode(tiff.encode(pages, scheme, predictor, 8, tile)))
    assert np.array_equal(back[0][:, :, 0], pages[0]) and np.array_equal(back[1], pages[1])


def test_big_endian_and_loops():
    entries = [(256, 4, 2), (257, 4, 1), (258, 3, 8 << 16), (259, 3, 1 << 16), (273, 4, 8), (279, 4, 2)]
    head = b"MM\0*" + struct.pack(">I", 10) + b"\x05\x06"
    body = struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", t, k, 1, v) for t, k, v in entries)
    assert next(tiff.decode(head + body + struct.pack(">I", 0))).ravel().tolist() == [5, 6]
    with pytest.raises(ValueError):
        list(tiff.decode(head + body + struct.pack(">I", 10)))
    with pytest.raises(ValueError):
        list(tiff.decode(b"GIF89a00"))


def test_one_row_a_page(spark):
    pages = [np.full((2, 3), k, np.uint8) for k in range(3)]
    df = spark.createDataFrame([(1, bytearray(tiff.encode(pages))), (2, None)], "doc_id long, media binary")
    rows = tiff.pages(df, "doc_id", "media").orderBy("page").collect()
    assert [(r["id"], r["page"], r["width"], r["height"], bytes(r["pixels"])) for r in rows] == [(1, k, 3, 2, bytes([k]) * 6) for k in range(3)]


def test_query_on_edge_rows(spark, tmp_path):
    fixtures.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = tiff.op6_media_tiff(spark, str(tmp_path)).collect()
    texts = {r[0]: r[1] for r in fixtures.rows()}
    assert len(rows) == len(fixtures.rows())
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())


def test_damaged_files_give_a_row_that_says_so(spark):
    good = tiff.encode([np.full((4, 5), 7, np.uint8), np.arange(400, dtype=np.uint8).reshape(20, 20)], tiff.LZW, strip_rows=4)
    (second,) = struct.unpack_from("<I", good, 4)
    big = b"II" + struct.pack("<HI", 43, 8)
    bomb = bytearray(tiff.encode([np.zeros((1, 1), np.uint8)], tiff.DEFLATE))
    rows = [(1, bytearray(b"GIF89a")), (2, bytearray(big)), (3, bytearray(good[: len(good) - 30])), (4, bytearray(good)), (5, bytearray(b"")), (6, bomb)]
    got = tiff.pages(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["id"], r["page"])):
        by.setdefault(r["id"], []).append(r)
    assert "not a TIFF" in by[1][0]["error"] and "BigTIFF" in by[2][0]["error"] and "not a TIFF" in by[5][0]["error"]
    assert by[3][-1]["error"] and [r["error"] for r in by[4]] == [None, None] and by[6][0]["error"] is None


def test_no_more_is_unpacked_than_a_block_needs():
    import zlib

    data = zlib.compress(b"x" * 5_000_000)
    assert len(tiff.DECODE[tiff.DEFLATE](data, 100)) == 100
    assert len(tiff.DECODE[tiff.PACKBITS](tiff.ENCODE[tiff.PACKBITS](b"x" * 10_000), 100)) <= 100 + 128
    assert len(tiff.DECODE[tiff.LZW](tiff.ENCODE[tiff.LZW](b"x" * 10_000), 100)) < 400


def test_short_strips_and_missing_ones_fail():
    whole = bytearray(tiff.encode([np.arange(64, dtype=np.uint8).reshape(8, 8)], tiff.NONE, strip_rows=4))
    at = whole.find(struct.pack("<HHI", tiff.LENGTH, 4, 1))
    struct.pack_into("<I", whole, at + 8, 80)
    with pytest.raises(ValueError):
        list(tiff.decode(bytes(whole)))


def test_empty_table(spark, tmp_path):
    fixtures.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert tiff.op6_media_tiff(spark, str(tmp_path)).collect() == []
