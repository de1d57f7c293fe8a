import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from footfall.llm.tiff_media import TiffError, lzw_decode, lzw_encode, media_digest, packbits_decode, packbits_encode, read_tiff, store_texts, text_to_tiff, tiff_pages, write_tiff

from .cases import awkward


def test_codecs_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 127, 128, 129, 500, 5000, 40000):
        for data in (rng.randbytes(n), bytes(rng.choices(b"ab", k=n)), b"z" * n):
            assert lzw_decode(lzw_encode(data)) == data
            assert packbits_decode(packbits_encode(data)) == data


def test_packbits_of_the_specification():
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    assert packbits_decode(packed).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("codec", [1, 5, 8, 32773])
@pytest.mark.parametrize("tile", [None, (16, 64), (32, 16)])
def test_files_round_trip(kind, codec, tile):
    pages = [np.random.default_rng(k).integers(0, 250, (20 + 30 * k, 70 + k)).astype(kind) for k in range(3)]
    for predictor in (1, 2):
        for order in "<>":
            got = list(read_tiff(write_tiff(pages, codec, predictor, tile, order=order)))
            assert [(g.width, g.height, g.compression, g.predictor, g.tiled) for g in got] == [(p.shape[1], p.shape[0], codec, predictor, bool(tile)) for p in pages]
            assert all((g.pixels[:, :, 0] == p).all() for g, p in zip(got, pages))


def tiff(tags, data, order="<"):
    """A file of one page: data at offset 8, then the directory of (tag, type, values)."""
    kinds = {3: "H", 4: "I"}
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0) + data)
    entries = b""
    for tag, kind, values in sorted(tags):
        packed = struct.pack(f"{order}{len(values)}{kinds[kind]}", *values)
        if len(packed) > 4:
            entries += struct.pack(order + "HHII", tag, kind, len(values), len(out))
            out += packed
        else:
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    struct.pack_into(order + "I", out, 4, len(out))
    return bytes(out + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0")


def test_other_sample_layouts():
    size = [(256, 4, [10]), (257, 4, [3])]
    bits = np.random.default_rng(1).integers(0, 2, (3, 10))
    rows = np.packbits(np.pad(bits, ((0, 0), (0, 6))).astype(np.uint8), axis=1).tobytes()
    flipped = bytes(int(f"{b:08b}"[::-1], 2) for b in rows)
    for fill, data in ((1, rows), (2, flipped)):
        (got,) = read_tiff(tiff([*size, (258, 3, [1]), (266, 3, [fill]), (273, 4, [8]), (278, 4, [3]), (279, 4, [len(data)])], data))
        assert got.bits == 1 and (got.pixels[:, :, 0] == bits).all()
    rgb = np.random.default_rng(2).integers(0, 60000, (3, 10, 3)).astype(">u2")
    planes = [rgb[:, :, k].tobytes() for k in range(3)]
    (got,) = read_tiff(tiff([*size, (258, 3, [16] * 3), (277, 3, [3]), (284, 3, [2]), (273, 4, [8, 68, 128]), (278, 4, [3]), (279, 4, [60] * 3)], b"".join(planes), ">"))
    assert (got.pixels == rgb).all() and got.samples == 3
    real = np.random.default_rng(3).normal(size=(3, 10)).astype(np.float32)
    spread = real.astype(">f4").view(np.uint8).reshape(3, 10, 4).transpose(0, 2, 1).reshape(3, 40)
    coded = np.diff(spread, axis=1, prepend=np.zeros((3, 1), np.uint8)).tobytes()
    (got,) = read_tiff(tiff([*size, (258, 3, [32]), (339, 3, [3]), (317, 3, [3]), (273, 4, [8]), (278, 4, [3]), (279, 4, [120])], coded))
    assert (got.pixels[:, :, 0] == real).all()
    with pytest.raises(TiffError):
        list(read_tiff(tiff([*size, (258, 3, [12]), (273, 4, [8]), (279, 4, [120])], coded)))


def test_layout_does_not_follow_length():
    seen = {}
    for n in (5, 400, 30_000, 400_000):
        for k in range(60):
            (page, *_) = read_tiff(text_to_tiff(f"{k} " + "abc de " * (n // 7))[1])
            seen.setdefault(n, set()).add((page.compression, page.tiled))
    assert all(v == {(8, False), (8, True), (5, False), (32773, False)} for v in seen.values())


def test_null_and_broken_media_are_told(spark):
    good = write_tiff([np.arange(384, dtype=np.uint8).reshape(2, 192)] * 2, 8, 2)
    broken = write_tiff([np.arange(384, dtype=np.uint8).reshape(2, 192)] * 2, 1)[:-90]
    media = spark.createDataFrame([(1, 9, good, 0), (2, 9, None, 0), (3, 9, b"", 0), (4, 9, broken, 0), (None, 9, good, 0), (1, 9, good, 0)], "doc_id long, n_bytes long, media binary, kept0 int")
    out = sorted(media_digest(media).collect(), key=lambda r: (r.doc_id or 0))
    assert [r.doc_id for r in out] == [None, 1, 1, 2, 3, 4]
    assert [r.payload_bytes for r in out] == [768, 768, 768, None, None, None] and out[0].payload_sha256 == out[1].payload_sha256
    assert all(r.feature.startswith("error=") for r in out[3:]) and [r.media_bytes for r in out[3:]] == [None, 0, len(broken)]
    assert all(r.feature.startswith("pages=2;rows=4") for r in out[:3])


def test_broken_files_raise():
    good = write_tiff([np.ones((4, 4), np.uint8)])
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    for bad in (b"", b"II", b"XX*\0", good[: len(good) // 2], bytes(loop), struct.pack("<2sHI", b"II", 42, 9999)):
        with pytest.raises(TiffError):
            list(read_tiff(bad))


def test_pages_operator_and_errors(spark):
    two = write_tiff([np.arange(12, dtype=np.uint8).reshape(3, 4), np.zeros((2, 2), np.uint16)], 5, 2)
    media = spark.createDataFrame([(1, two, 0), (2, None, 0), (3, b"", 0), (4, two[:20], 0), (None, two, 0), (1, two, 0)], "doc_id long, media binary, page int")
    rows = tiff_pages(media).collect()
    made = sorted((r.doc_id or 0, r.page, r.width or 0, r.error is None) for r in rows)
    assert made == sorted([(1, 0, 4, True), (1, 1, 2, True)] * 2 + [(0, 0, 4, True), (0, 1, 2, True)] + [(k, 0, 0, False) for k in (2, 3, 4)])
    assert sum(r.error is not None for r in rows) == 3 and len(rows) == 9
    assert {bytes(r.pixels) for r in rows if r.page == 0 and r.error is None} == {bytes(range(12))}
    assert tiff_pages(media.limit(0)).collect() == []


def test_text_round_trip(spark):
    docs, rows = awkward(spark)
    stored = store_texts(docs)
    out = {r.doc_id: r for r in media_digest(stored).collect()}
    for key, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = out[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert out[4].media_sha256 == out[5].media_sha256 and out[4].feature == out[5].feature and out[0].feature == out[1].feature
    assert {r.n_bytes for r in stored.collect()} == {len((t or "").encode()) for _, t, *_ in rows}
    assert tiff_pages(stored).filter("error is not null").count() == 0 and media_digest(store_texts(docs.limit(0))).collect() == []
