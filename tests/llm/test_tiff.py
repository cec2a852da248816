import itertools

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillpack.llm import tiff as T


@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert T.packbits_decode(T.packbits_encode(data), len(data)) == data
    assert T.lzw_decode(T.lzw_encode(data), len(data)) == data


def test_lzw_over_many_tables():
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(0, 256, 60_000, dtype=np.uint8)) + b"ab" * 40_000
    assert T.lzw_decode(T.lzw_encode(data), len(data)) == data


def test_known_streams():
    # The example of Apple's PackBits note, and one LZW stream written out by hand: clear, 'A', 258 (= 'AA'), end.
    assert T.packbits_decode(bytes.fromhex("FEAA02800 02AFDAA03800 02A22F7AA".replace(" ", "")), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    bits = "".join(f"{c:09b}" for c in (256, 65, 258, 257))
    assert T.lzw_decode(int(bits.ljust(40, "0"), 2).to_bytes(5, "big"), 3) == b"AAA"


KINDS = list(itertools.product((T.NONE, T.PACKBITS, T.LZW, T.DEFLATE), (1, 2, 3), (np.uint8, np.uint16, np.uint32), (1, 3), (None, (16, 32)), "<>"))


@pytest.mark.parametrize("compression", (T.NONE, T.PACKBITS, T.LZW, T.DEFLATE))
def test_every_variant_round_trips(compression):
    rng = np.random.default_rng(1)
    for kind, predictor, dtype, samples, tile, order in KINDS:
        if kind != compression or (predictor == 3 and dtype is np.uint8):
            continue
        images = [rng.integers(0, 200, shape, dtype=np.uint64).astype(dtype) for shape in ((37, 53, samples), (1, 1, samples))]
        got = list(T.read_tiff(T.write_tiff(images, kind, predictor, tile, 7, order)))
        assert [g.pixels for g in got] == [i.astype(f"<u{i.itemsize}").tobytes() for i in images]
        assert (got[0].width, got[0].height, got[0].layout) == (53, 37, "tiles" if tile else "strips")


def test_float_predictor_undoes_real_floats():
    image = np.linspace(-5, 5, 24, dtype=np.float32).reshape(4, 6)
    got = next(T.read_tiff(T.write_tiff([image.view(np.uint32)], T.DEFLATE, 3)))
    assert np.frombuffer(got.pixels, dtype=np.float32).reshape(4, 6).tolist() == image.tolist()


def by_hand(fields, blocks, order="<", big=False):
    """A file of one directory, written out: fields by tag (values as longs), and the strips that tag 273 points at."""
    import struct

    word = "Q" if big else "I"
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    size = len(head) + (8 + 20 * (len(fields) + 2) + 8 if big else 2 + 12 * (len(fields) + 2) + 4)
    places = np.cumsum([0, *map(len, blocks)])[:-1]
    extra, rows = b"", {**fields}
    body_at = size + 8 * 8 * 4
    rows[273], rows[279] = [body_at + int(p) for p in places], [len(b) for b in blocks]
    out = struct.pack(order + ("Q" if big else "H"), len(rows))
    for tag in sorted(rows):
        values = rows[tag] if isinstance(rows[tag], list) else [rows[tag]]
        raw = struct.pack(f"{order}{len(values)}{word}", *values)
        out += struct.pack(order + ("HHQ" if big else "HHI"), tag, 16 if big else 4, len(values))
        if len(raw) > (8 if big else 4):
            out += struct.pack(order + word, size + len(extra))
            extra += raw
        else:
            out += raw.ljust(8 if big else 4, b"\0")
    out = head + out + bytes(8 if big else 4)
    return (out + extra).ljust(body_at, b"\0") + b"".join(blocks)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
def test_files_written_by_hand(order, big):
    def pixels(fields, blocks):
        (page,) = T.read_tiff(by_hand({256: 3, 257: 2, 259: 1, **fields}, blocks, order, big))
        assert not isinstance(page, T.TiffError), page
        return list(page.pixels)

    # Samples of 1, 2 and 4 bits: each row starts at a byte.
    assert pixels({258: 1}, [bytes([0b10100000, 0b01100000])]) == [1, 0, 1, 0, 1, 1]
    assert pixels({258: 2}, [bytes([0b11100100, 0b00011000])]) == [3, 2, 1, 0, 1, 2]
    assert pixels({258: 4}, [bytes([0xAB, 0xC0, 0x12, 0x30])]) == [10, 11, 12, 1, 2, 3]
    # Two planes, a strip each, and strips of one row.
    assert pixels({258: [8, 8], 277: 2, 284: 2}, [bytes(range(6)), bytes(range(10, 16))]) == [0, 10, 1, 11, 2, 12, 3, 13, 4, 14, 5, 15]
    assert pixels({258: 8, 278: 1}, [b"abc", b"def"]) == list(b"abcdef")
    # Bits in reverse order, plain and compressed.
    turned = bytes(int(f"{k:08b}"[::-1], 2) for k in b"abcdef")
    assert pixels({258: 8, 266: 2}, [turned]) == list(b"abcdef")
    squeezed = bytes(int(f"{k:08b}"[::-1], 2) for k in T.lzw_encode(b"aaaaaa"))
    assert pixels({258: 8, 266: 2, 259: T.LZW}, [squeezed]) == list(b"aaaaaa")
    assert isinstance(next(T.read_tiff(by_hand({256: 3, 257: 2, 259: 1, 258: 8, 266: 3}, [b"abcdef"], order, big))), T.TiffError)


def test_lzw_memory_does_not_follow_the_strip():
    import tracemalloc

    data = T.lzw_encode(bytes(np.random.default_rng(1).integers(0, 256, 400_000, dtype=np.uint8)))
    tracemalloc.start()
    out = T.lzw_decode(data, 400_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 400_000 and peak < 30 << 20


def test_damage():
    good = T.write_tiff([np.zeros((4, 4), np.uint8), np.ones((4, 4), np.uint8)])
    assert isinstance(next(T.read_tiff(b"GIF89a..")), T.TiffError)
    assert isinstance(next(T.read_tiff(good[:10])), T.TiffError)
    cut = list(T.read_tiff(good[:-20]))
    assert isinstance(cut[-1], T.TiffError) and not isinstance(cut[0], T.TiffError)
    looped = bytearray(good)
    looped[-4:] = good[4:8]  # the last directory points at the first
    assert len(list(T.read_tiff(bytes(looped)))) == 2


def test_columns(spark):
    good = T.write_tiff([np.full((3, 5), 7, np.uint8)], T.LZW)
    rows = [(1, bytearray(good)), (1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(b"no image")), (None, bytearray(good))]
    images = spark.createDataFrame(rows, "page_id long, tiff binary")
    got = T.tiff_pages(images).collect()
    assert sorted(((r.image_id, r.page, r.error is None) for r in got), key=str) == sorted([(1, 0, True), (1, 0, True), (4, 0, False), (None, 0, True)], key=str)
    assert bytes(next(r.pixels for r in got if r.image_id == 1)) == bytes([7] * 15)
    assert T.tiff_pages(images.withColumn("pixels", F.lit(1)).withColumn("page", F.lit("x"))).count() == 4
    assert T.tiff_pages(images.limit(0)).count() == 0


def test_captures_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").union(spark.createDataFrame([(900, None), (901, ""), (None, "é" * 50_000)], "page_id long, html string"))
    found = T.tiff_pages(T.captures(pages)).collect()
    text = {}
    for r in sorted(found, key=lambda r: r.page):
        assert r.error is None
        text[r.image_id] = text.get(r.image_id, b"") + bytes(r.pixels)
    want = {r.page_id: r.html.encode() for r in pages.collect() if r.html is not None}
    assert {k: v.rstrip(b"\0") for k, v in text.items()} == want
