import hashlib
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dropletry.llm import op05_tiff, tiff


@pytest.mark.parametrize("compression, predictor, tile, order", list(itertools.product([1, 5, 8, 32773], [1, 2], [None, (16, 32)], "<>")))
def test_round_trip(compression, predictor, tile, order):
    r = np.random.default_rng(1)
    for kind, channels in itertools.product([np.uint8, np.uint16], [1, 3]):
        pages = [np.minimum(r.integers(0, 9, (h, w, channels)), 7).astype(kind) for h, w in ((5, 7), (70, 90))]
        raw = tiff.encode(pages, compression, predictor, strip_bytes=900, tile=tile, order=order)
        assert [p[5] for p in tiff.pages_of(raw)] == [p.tobytes() for p in pages]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data and tiff.unpack_packbits(tiff.pack_packbits(data)) == data


def test_lzw_through_a_full_table():
    data = np.random.default_rng(0).integers(0, 256, 60000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_broken_and_looping_files(spark):
    good = tiff.encode([np.arange(12, dtype=np.uint8).reshape(3, 4, 1)] * 2)
    first = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[first : first + 2], "little")
    loop = bytearray(good)
    loop[first + 2 + 12 * n : first + 6 + 12 * n] = first.to_bytes(4, "little")
    assert len(list(tiff.pages_of(bytes(loop)))) == 1
    rows = [(1, good, 5), (2, None, 5), (3, b"junk", 5), (4, good[:-20], 5), (None, good, 5), (1 << 60, b"", 5)]
    got = tiff.read_pages(spark.createDataFrame(rows, "doc_id long, media binary, width int")).collect()
    by = {k: [r for r in got if r["doc_id"] == k] for k in (1, 2, 3, 4, None, 1 << 60)}
    assert [len(by[k]) for k in (1, 2, 3, None)] == [2, 0, 1, 2]
    assert by[3][0]["error"] and by[3][0]["pixels"] is None and by[4][-1]["error"] and by[1 << 60][0]["error"]
    assert by[1][0]["width"] == 4 and by[1][1]["page"] == 1


def test_headers_that_ask_for_too_much(spark):
    good = tiff.encode([np.arange(12, dtype=np.uint8).reshape(3, 4, 1)])
    first = int.from_bytes(good[4:8], "little")
    fields = {int.from_bytes(good[a : a + 2], "little"): a for a in range(first + 2, first + 2 + 12 * int.from_bytes(good[first : first + 2], "little"), 12)}
    huge, none = bytearray(good), bytearray(good)
    for tag in (tiff.WIDTH, tiff.HEIGHT, tiff.STRIP_ROWS):
        huge[fields[tag] + 8 : fields[tag] + 12] = (1 << 24).to_bytes(4, "little")
    none[fields[tiff.SAMPLES] + 8 : fields[tiff.SAMPLES] + 10] = b"\0\0"
    for raw in (huge, none):
        assert [(p[5], p[9][:10]) for p in tiff.pages_of(bytes(raw))] == [(None, "ValueError")]
    assert tiff.read_pages(spark.createDataFrame([], "doc_id long, media binary")).count() == 0
    long = np.tile(np.arange(200, dtype=np.uint8), 50_000).reshape(-1, 100, 1)
    assert [p[5] for p in tiff.pages_of(tiff.encode([long]))] == [long.tobytes()]


def test_stored_form_is_read_by_its_definition():
    """The file taken apart by hand: header, directory and deflated strips, without the reader."""
    page = np.arange(300, dtype=np.uint8).reshape(30, 10, 1)
    raw = tiff.encode([page], strip_bytes=100)
    num = lambda a, n: int.from_bytes(raw[a : a + n], "little")
    at = num(4, 4)
    entries = {num(a, 2): (num(a + 2, 2), num(a + 4, 4), a + 8) for a in range(at + 2, at + 2 + 12 * num(at, 2), 12)}
    values = lambda tag: [num((num(entries[tag][2], 4) if entries[tag][1] > 1 else entries[tag][2]) + 4 * k, 4) for k in range(entries[tag][1])]
    assert raw[:4] == b"II*\0" and (values(256), values(257)) == ([10], [30])
    assert b"".join(zlib.decompress(raw[a : a + n]) for a, n in zip(values(273), values(279))) == page.tobytes()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op05_tiff.query(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))


def test_pages_come_one_after_another_and_a_file_has_a_bound(spark):
    page = np.zeros((100, 100, 1), np.uint8)
    raw = tiff.encode([page] * 8)
    assert [(p[0], p[9] and p[9][:10]) for p in tiff.pages_of(raw, most=35_000)] == [(0, None), (1, None), (2, None), (3, "ValueError")]
    big = tiff.encode([np.zeros((5000, 4000, 1), np.uint8)] * 4)
    rows = tiff.read_pages(spark.createDataFrame([(1, big), (2, raw)], "doc_id long, media binary")).select("doc_id", "page", "width").collect()
    assert sorted((r["doc_id"], r["page"]) for r in rows) == [(1, k) for k in range(4)] + [(2, k) for k in range(8)]
