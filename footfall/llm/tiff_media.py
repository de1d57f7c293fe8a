"""Media columns: TIFF directories walked, strips and tiles decoded, predictors undone, one row per page.

Baseline layout and codecs after the public TIFF 6.0 specification (and Deflate, Adobe tag 8).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_texts, to_arrow

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
ROW = 192
PAGE_ROWS = 512
PAGES = "page int,width int,height int,bits int,samples int,sample_format int,compression int,predictor int,tiled boolean,pixels binary,error string"
#: Pages are handed on once they hold so many bytes.
BATCH_BYTES = 1 << 22
STORED = "n_bytes long,media binary"
DIGEST = "n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string"

# Tag numbers and type sizes: fixed values of the format.
_WIDTH, _HEIGHT, _BITS, _CODEC, _PHOTOMETRIC, _STRIPS, _SAMPLES, _ROWS, _STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
_PLANAR, _PREDICTOR, _TILE_W, _TILE_H, _TILES, _TILE_BYTES = 284, 317, 322, 323, 324, 325
_FILL_ORDER, _FORMAT = 266, 339
_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}


class TiffError(ValueError):
    pass


def packbits_decode(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            if head > 128:
                out += data[at + 1 : at + 2] * (257 - head)
            at += 2 if head > 128 else 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more as repeats, all else as literals of up to 128 bytes."""
    values = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]) if len(values) else np.array([0])
    out, literal = bytearray(), 0
    lengths = np.diff(starts)
    for k in np.flatnonzero(lengths >= 3).tolist():
        a, b = int(starts[k]), int(starts[k + 1])
        for p in range(literal, a, 128):
            part = data[p : min(p + 128, a)]
            out += bytes([len(part) - 1]) + part
        literal = b
        while a < b:
            run = min(128, b - a)
            out += bytes([(257 - run) & 255 if run > 1 else 0, data[a]])
            a += run
    for p in range(literal, len(data), 128):
        part = data[p : p + 128]
        out += bytes([len(part) - 1]) + part
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widths switched one code early."""
    codes: list[int] = [256]
    widths: list[tuple[int, int]] = []  # (number of codes so far, their width)
    table: dict[int, int] = {}
    width, free, held, wide = 9, 258, -1, 511
    for value in data:
        if held < 0:
            held = value
            continue
        key = held << 8 | value
        known = table.get(key)
        if known is not None:
            held = known
            continue
        codes.append(held)
        table[key] = free
        free += 1
        held = value
        if free == 4095:
            codes.append(256)
            widths.append((len(codes), width))
            table, width, free, wide = {}, 9, 258, 511
        elif free == wide:
            widths.append((len(codes), width))
            width += 1
            wide = (1 << width) - 1
    if held >= 0:
        codes.append(held)
        if free + 1 == wide and width < 12:
            widths.append((len(codes), width))
            width += 1
    codes.append(257)
    widths.append((len(codes), width))
    each = np.repeat([w for _, w in widths], np.diff([0, *(n for n, _ in widths)]))
    shown = np.array(codes, np.int64)[:, None] >> (each[:, None] - 1 - np.arange(12)).clip(0) & 1
    return np.packbits(shown.astype(np.uint8)[np.arange(12) < each[:, None]]).tobytes()


def lzw_decode(data: bytes) -> bytes:
    out: list[bytes] = []
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(first), 9, b""
    held = bits = at = 0
    while True:
        while bits < width and at < len(data):
            held = held << 8 | data[at]
            at, bits = at + 1, bits + 8
        if bits < width:
            break
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW code without a string")
            last = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code out of range")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            last = word
        out.append(last)
        size = len(table) + 1
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    return b"".join(out)


def _decompress(data: bytes, codec: int) -> bytes:
    if codec == NONE:
        return data
    if codec == LZW:
        return lzw_decode(data)
    if codec in (DEFLATE, 32946):
        return zlib.decompress(data)
    if codec == PACKBITS:
        return packbits_decode(data)
    raise TiffError(f"compression {codec} is not supported")


def _compress(data: bytes, codec: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode}.get(codec, lambda d: zlib.compress(d, 1))(data)


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    sample_format: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def _fields(blob: bytes, at: int, order: str, big: bool) -> tuple[dict[int, list[int]], int]:
    """Values by tag of one directory, and where the next one is (0: none)."""
    head, entry, size = ("Q", "HHQ", 20) if big else ("H", "HHI", 12)
    (count,) = struct.unpack_from(order + head, blob, at)
    at += struct.calcsize(order + head)
    found: dict[int, list[int]] = {}
    room = 8 if big else 4
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + entry, blob, at + k * size)
        if kind in _TYPES:
            bytes_ = struct.calcsize(order + _TYPES[kind]) * n
            where = at + (k + 1) * size - room
            if bytes_ > room:
                (where,) = struct.unpack_from(order + ("Q" if big else "I"), blob, where)
            found[tag] = list(struct.unpack_from(f"{order}{n}{_TYPES[kind]}", blob, where))
    (following,) = struct.unpack_from(order + ("Q" if big else "I"), blob, at + count * size)
    return found, following


def _unpack(raw: bytes, shape: tuple[int, int, int], bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """One strip or tile as (rows, columns, samples), its predictor undone; samples under 8 bits become bytes."""
    rows, across, samples = shape
    line = -(-across * samples * bits // 8)
    if len(raw) < rows * line:
        raise TiffError("too little data")
    if bits < 8:
        spread = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : across * samples * bits]
        return (spread.reshape(rows, across, samples, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    if predictor == 3:
        # bytes of a row stand in planes, the most significant first, each byte less the one a sample before it
        planes = np.add.accumulate(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        whole = np.ascontiguousarray(planes.reshape(rows, kind.itemsize, across * samples).transpose(0, 2, 1))
        return whole.view(kind.newbyteorder(">")).reshape(shape)
    block = np.frombuffer(raw, kind, rows * across * samples).reshape(shape)
    if predictor == 2:
        plain = np.dtype(f"u{kind.itemsize}")
        block = np.add.accumulate(block.view(plain.newbyteorder(kind.byteorder)), axis=1, dtype=plain).view(kind.newbyteorder("="))
    return block


def _page(blob: bytes, tags: dict[int, list[int]], order: str) -> Page:
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, height, samples = one(_WIDTH), one(_HEIGHT), one(_SAMPLES, 1)
    bits, codec, predictor, shape = one(_BITS, 1), one(_CODEC, 1), one(_PREDICTOR, 1), one(_FORMAT, 1)
    letter = {1: "u", 2: "i", 3: "f", 4: "u"}.get(shape, "")
    whole = bits in ((1, 2, 4, 8, 16, 32, 64) if letter == "u" else (8, 16, 32, 64) if letter == "i" else (16, 32, 64))
    fits = predictor == 1 or predictor == 2 and bits >= 8 and letter in "ui" or predictor == 3 and letter == "f"
    if not width or not height or not letter or not whole or not fits or set(tags.get(_BITS, [bits])) != {bits} or samples < 1:
        raise TiffError("unsupported sample layout")
    kind = np.dtype(f"{order}{letter}{max(1, bits // 8)}")
    tiled, planes = _TILES in tags, samples if one(_PLANAR, 1) == 2 else 1
    each = samples // planes
    across = one(_TILE_W) if tiled else width
    down = one(_TILE_H) if tiled else min(one(_ROWS, height), height)
    offsets, sizes = tags.get(_TILES if tiled else _STRIPS), tags.get(_TILE_BYTES if tiled else _STRIP_BYTES)
    if not offsets or not sizes or not across or not down:
        raise TiffError("no strips or tiles")
    columns_, per_plane = -(-width // across), -(-width // across) * -(-height // down)
    if len(offsets) < per_plane * planes:
        raise TiffError("too few strips or tiles")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, at = divmod(k, per_plane)
        top, left = at // columns_ * down, at % columns_ * across
        if plane >= planes or offset + size > len(blob):
            raise TiffError("data outside the file")
        rows = down if tiled else min(down, height - top)
        raw = blob[offset : offset + size]
        if one(_FILL_ORDER, 1) == 2:
            raw = raw.translate(_REVERSED)
        block = _unpack(_decompress(raw, codec), (rows, across, each), bits, kind, predictor)
        out[top : top + rows, left : left + across, plane * each : (plane + 1) * each] = block[: height - top, : width - left]
    return Page(width, height, bits, samples, shape, codec, predictor, tiled, out)


_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def read_tiff(blob: bytes) -> Iterator[Page]:
    """Pages in directory order; classic and big files of either byte order. Raises TiffError."""
    try:
        order = {b"II": "<", b"MM": ">"}[blob[:2]]
        (magic,) = struct.unpack_from(order + "H", blob, 2)
        if magic not in (42, 43):
            raise TiffError("not a TIFF file")
        big = magic == 43
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), blob, 8 if big else 4)
        seen = set()
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            tags, following = _fields(blob, at, order, big)
            yield _page(blob, tags, order)
            at = following
        if not seen:
            raise TiffError("no directory")
    except TiffError:
        raise
    except (KeyError, IndexError, struct.error, zlib.error, ValueError, OverflowError, TypeError) as e:
        raise TiffError(str(e) or type(e).__name__) from e


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 64, order: str = "<") -> bytes:
    """Grey pages of unsigned 8 or 16-bit samples as a classic TIFF file."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        kind = page.dtype.newbyteorder(order)
        down, across = tile or (rows_per_strip, width)
        offsets, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = page[top : top + down, left : left + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), block.dtype))
                data = _compress(block.astype(kind, copy=False).tobytes(), compression)
                offsets.append(len(out))
                sizes.append(len(data))
                out += data + b"\0" * (len(data) & 1)
        tags: list[tuple[int, int, list[int]]] = [(_WIDTH, 4, [width]), (_HEIGHT, 4, [height]), (_BITS, 3, [page.dtype.itemsize * 8]), (_CODEC, 3, [compression]), (_PHOTOMETRIC, 3, [1])]
        if not tile:
            tags += [(_STRIPS, 4, offsets), (_SAMPLES, 3, [1]), (_ROWS, 4, [down]), (_STRIP_BYTES, 4, sizes)]
        else:
            tags += [(_SAMPLES, 3, [1])]
        tags += [(_PREDICTOR, 3, [predictor])]
        if tile:
            tags += [(_TILE_W, 4, [across]), (_TILE_H, 4, [down]), (_TILES, 4, offsets), (_TILE_BYTES, 4, sizes)]
        entries = bytearray()
        for tag, type_, values in tags:
            packed = struct.pack(f"{order}{len(values)}{_TYPES[type_]}", *values)
            if len(packed) > 4:
                entries += struct.pack(order + "HHII", tag, type_, len(values), len(out))
                out += packed
            else:
                entries += struct.pack(order + "HHI", tag, type_, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_to_tiff(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 bytes, file): the padded bytes as rows of 192 grey samples, at most ``PAGE_ROWS`` a page.

    The layout follows the content's checksum alone, whatever its length, so equal texts give equal files: five in eight
    are Deflate strips with horizontal differences, one each PackBits strips, Deflate tiles and LZW in the other byte order.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + b" " * (-len(raw) % ROW if raw else ROW)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    pages = [rows[a : a + PAGE_ROWS] for a in range(0, len(rows), PAGE_ROWS)]
    pick = zlib.crc32(payload) & 7
    if pick == 0:
        return len(raw), write_tiff(pages, PACKBITS)
    if pick == 1:
        return len(raw), write_tiff(pages, DEFLATE, 2, tile=(16, 64))
    if pick == 2:
        return len(raw), write_tiff(pages, LZW, 2, order=">")
    return len(raw), write_tiff(pages, DEFLATE, 2, rows_per_strip=128)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a TIFF file; null and empty texts as one row of blanks.

    A null id stays null, repeated rows are stored each, an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def start():
        def work(texts: list) -> dict:
            made = [text_to_tiff(t) for t in texts]
            return {"n_bytes": [n for n, _ in made], "media": [m for _, m in made]}

        return work

    return map_texts(docs, id_col, text_col, start, STORED)


def tiff_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: (id, the columns ``keep``, page, width, height, bits, samples, sample_format, compression, predictor, tiled, pixels, error).

    pixels holds the samples row by row in native byte order, samples under 8 bits as bytes. A file that is null, empty or broken gives
    one row with ``error`` at the page where reading ended (after the pages before it). A file's rows follow
    each other. Repeated rows are read each; an empty table gives no rows; other columns are ignored.
    """
    kept = [f"kept{k}" for k in range(len(keep))]
    named = columns(media, id_col, media_col, *keep).toDF("id", "media", *kept)
    kinds = [f"{n} {named.schema[n].dataType.simpleString()}" for n in ("id", *kept)]
    names = ["id", *kept, *_PAGE_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = [batch.column(n) for n in ("id", *kept)]
            at: list[int] = []
            rows: list[tuple] = []
            held = 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in head), *[pa.array(c, t) for c, t in zip(zip(*rows), _PAGE_TYPES)]], names=names)

            for k, blob in enumerate(batch.column("media")):
                n = 0
                try:
                    for p in read_tiff(blob.as_py() or b""):
                        at.append(k)
                        rows.append((n, p.width, p.height, p.bits, p.samples, p.sample_format, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None))
                        n, held = n + 1, held + len(rows[-1][-2])
                        if held >= BATCH_BYTES:
                            yield made()
                            at, rows, held = [], [], 0
                except TiffError as e:
                    at.append(k)
                    rows.append((n, *[None] * 9, str(e)))
            if rows:
                yield made()

    return named.mapInArrow(run, f"{', '.join(kinds)}, {PAGES}").withColumnsRenamed({"id": id_col, **dict(zip(kept, keep))})


_PAGE_NAMES = [p.split()[0] for p in PAGES.split(",")]
_PAGE_TYPES = [{"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}[p.split()[1]] for p in PAGES.split(",")]


class PageFold:
    """What is told of one file, gathered page by page from rows of ``tiff_pages``."""

    def __init__(self, head: tuple):
        self.head, self.error = head, None
        self.digest, self.tail, self.size = hashlib.sha256(), b"", 0
        self.pages = self.rows = self.n = self.total = self.square = self.hash = 0

    def add(self, row: dict) -> None:
        if row["error"] is not None:
            self.error = row["error"]
            return
        pixels, height = row["pixels"], row["height"]
        self.digest.update(pixels)
        self.tail, self.size = (self.tail + pixels)[-16:], self.size + len(pixels)
        letter = {2: "i", 3: "f"}.get(row["sample_format"], "u")
        flat = np.frombuffer(pixels, f"{letter}{max(1, row['bits'] // 8)}").reshape(height, -1)
        wide = flat.astype(np.float64 if letter == "f" or row["bits"] > 16 else np.int64)
        if not self.pages:
            rows, cols = (np.linspace(0, n, 9)[:8].astype(int) for n in wide.shape)
            cells = np.add.reduceat(np.add.reduceat(wide, rows, axis=0), cols, axis=1)
            self.hash = int("".join("1" if c else "0" for c in (cells * cells.size > cells.sum()).ravel()), 2)
        self.pages, self.rows, self.n = self.pages + 1, self.rows + height, self.n + wide.size
        self.total += wide.sum().item()
        self.square += np.square(wide).sum().item()

    def feature(self) -> str:
        """Counts of pages and rows, mean and spread of the samples, and an 8x8 mean hash of the first page."""
        mean = self.total / self.n
        return f"pages={self.pages};rows={self.rows};mean={mean:.4f};spread={max(0.0, self.square / self.n - mean * mean) ** 0.5:.4f};hash={self.hash:016x}"

    def told(self) -> tuple:
        doc_id, n_bytes, media_bytes, media_sha256 = self.head
        if self.error is not None:
            return doc_id, n_bytes, None, None, None, media_bytes, media_sha256, f"error={self.error}"
        return doc_id, n_bytes, self.size, self.digest.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha256, self.feature()


def media_digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per stored file (id_col, n_bytes, media): what its pages of ``tiff_pages`` give, folded in order without a shuffle.

    A null, empty or broken file gives a row with ``feature`` saying why and null payload columns. A null id stays null,
    repeated rows are told each, an empty table gives no rows; other columns are ignored.
    """
    blob = F.col("media")
    told = columns(media, id_col, "n_bytes", "media").toDF("doc_id", "n_bytes", "media")
    told = told.withColumns({"doc_id": F.col("doc_id").cast("long"), "n_bytes": F.col("n_bytes").cast("long"), "media_bytes": F.octet_length(blob).cast("long"), "media_sha256": F.sha2(blob, 256)})
    head = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    pages = tiff_pages(told, keep=head[1:])
    schema = to_arrow("doc_id long," + DIGEST)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: PageFold | None = None
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["page"] == 0:
                    if now is not None:
                        done.append(now.told())
                    now = PageFold(tuple(row[h] for h in head))
                now.add(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.told(), schema)], schema=schema)

    return pages.mapInArrow(fold, f"doc_id long, {DIGEST}")
