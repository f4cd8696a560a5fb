"""Media columns: baseline JPEG.

``encode`` stores a payload losslessly as the quantised DCT coefficients of a baseline
greyscale JPEG, 64 a block; ``read`` parses any baseline JPEG's markers, Huffman-decodes
its scan and rebuilds the luminance thumbnail from the DC coefficients alone.

Decoding runs in numpy over many entropy segments at once: every restart interval of
every image of a chunk is a lane, and each step decodes one symbol in all lanes by one
look-up in a 16-bit table. Images without restart markers are one lane each.

Null text counts as empty. Null or broken media give null features, and ``error`` says
why. Texts of any length are stored whole; repeated rows give equal results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

#: Coefficients of a block; payload bytes are padded to a multiple of UNIT blocks.
BLOCK, UNIT, PAD = 64, 9, 255
#: Blocks side by side, at least; more where the height would pass the format's 65,535 pixels.
BLOCKS_WIDE, MAX_BLOCKS_HIGH = 3, 8191
CHUNK_BYTES = 2 << 20
#: Zigzag order of the coefficients: by anti-diagonals, turning at each end.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Every coefficient written is of size class 8, whose 256 values stand for the 256 bytes.
SIZE_CLASS = 8


class MediaError(ValueError):
    """The media can't be read as a baseline JPEG."""


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    unit = UNIT * BLOCK
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _shape(blocks: int) -> tuple[int, int]:
    """Blocks side by side and one above the other that hold so many blocks."""
    wide = BLOCKS_WIDE * max(1, -(-blocks // (BLOCKS_WIDE * MAX_BLOCKS_HIGH)))
    return wide, -(-blocks // wide)


def _header(blocks: int) -> bytes:
    wide, high = _shape(blocks)
    ones = bytes([0]) + bytes([1]) * 64
    code = lambda kind, symbol: bytes([kind, 1, *[0] * 15, symbol])  # noqa: E731  one code of one bit
    return b"\xff\xd8" + b"".join(
        (
            _segment(0xFE, b"blocks=%d" % blocks),
            _segment(0xDB, ones),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)),
            _segment(0xC4, code(0x00, SIZE_CLASS) + code(0x10, SIZE_CLASS)),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload, whose length is a multiple of 64.

    A coefficient is a one-bit code followed by the byte itself as its eight magnitude
    bits, so eight of them fill nine bytes; a restart marker ends every block.
    """
    counts = np.array([len(p) // BLOCK for p in payloads])
    shapes = [_shape(int(n)) for n in counts]
    totals = np.array([w * h for w, h in shapes], np.int64)
    full = b"".join(p + bytes([PAD]) * (int(t) * BLOCK - len(p)) for p, t in zip(payloads, totals, strict=True))
    b = np.frombuffer(full, np.uint8).reshape(-1, 8)
    packed = np.empty((len(b), 9), np.uint8)
    packed[:, 0] = b[:, 0] >> 1
    for j in range(1, 8):
        packed[:, j] = (b[:, j - 1] << (8 - j)) | (b[:, j] >> (j + 1))
    packed[:, 8] = b[:, 7]
    n = len(b) // 8
    coded = np.empty((n, 74), np.uint8)
    coded[:, :72] = packed.reshape(n, 72)
    first = np.concatenate(([0], np.cumsum(totals)))
    place = np.arange(n) - np.repeat(first[:-1], totals)
    coded[:, 72] = 0xFF
    coded[:, 73] = 0xD0 + place % 8
    coded[first[1:] - 1, 73] = 0xD9  # the last block ends the image
    stuff = coded == 0xFF
    stuff[:, 72] = False
    times = stuff.ravel().astype(np.intp) + 1
    body = np.repeat(coded.ravel(), times)
    ends = np.cumsum(times)
    body[ends[stuff.ravel()] - 1] = 0
    cuts = np.concatenate(([0], ends[first[1:] * 74 - 1]))
    return [_header(int(c)) + body[a:z].tobytes() for c, a, z in zip(counts, cuts, cuts[1:], strict=False)]


@dataclass
class Image:
    """What the markers of a baseline JPEG say."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)  # class << 4 | id -> counts and symbols
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # part's index, DC table, AC table
    restart: int = 0
    comment: bytes = b""
    start: int = 0  # of the entropy-coded bytes


def parse(data: bytes) -> Image:
    """Read the markers up to the first scan."""
    if data[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    out, at = Image(), 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise MediaError("marker expected")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) < size - 2:
            raise MediaError("segment cut short")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                out.quant[k] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out.huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not out.height or not out.width or not n:
                raise MediaError("unsupported frame")
            out.parts = [(c, hv >> 4, hv & 15, q) for c, hv, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise MediaError("not baseline")
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            ids = [p[0] for p in out.parts]
            try:
                out.scan = [(ids.index(c), t >> 4, t & 15) for c, t in struct.iter_unpack("BB", body[1 : 1 + 2 * body[0]])]
            except ValueError:
                raise MediaError("scan of an unknown component") from None
            if len(out.scan) != len(out.parts):
                raise MediaError("more than one scan")
            if any(16 * k + t not in out.huffman for _, d, a in out.scan for k, t in ((0, d), (1, a))) or any(q not in out.quant for *_, q in out.parts):
                raise MediaError("a table is missing")
            out.start = at
            return out


def _lookup(spec: bytes) -> np.ndarray:
    """For each 16 leading bits: code length << 8 | symbol; 0 where no code starts so."""
    table, code, at = np.zeros(1 << 16, np.uint32), 0, 16
    for bits in range(1, 17):
        for _ in range(spec[bits - 1]):
            lo = code << (16 - bits)
            table[lo : lo + (1 << (16 - bits))] = bits << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _segments(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing or markers, and the start of each restart interval."""
    ff = np.flatnonzero(body[:-1] == 0xFF)
    after = body[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    stop = int(ends[0]) if len(ends) else len(body)
    ff, after = ff[ff < stop], after[ff < stop]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.concatenate((ff[after == 0] + 1, marks, marks + 1))
    keep = np.ones(stop, bool)
    keep[drop] = False
    before = np.cumsum(keep) - keep
    return body[:stop][keep], np.concatenate(([0], before[marks]))


def decode(images: list[bytes]) -> list[tuple[Image, np.ndarray, np.ndarray] | MediaError]:
    """Image, its coefficients [block, 64] in scan and zigzag order, and each block's component.

    Images that share their tables and sampling are decoded together, one lane for each
    restart interval.
    """
    out: list = [None] * len(images)
    groups: dict[tuple, list[tuple[int, Image]]] = {}
    for i, data in enumerate(images):
        try:
            im = parse(data)
            groups.setdefault((tuple(sorted(im.huffman.items())), tuple(im.scan), tuple(p[1:3] for p in im.parts)), []).append((i, im))
        except (MediaError, struct.error, IndexError) as e:
            out[i] = MediaError(str(e) or type(e).__name__)
    for (tables, scan, sampling), members in groups.items():
        specs = dict(tables)
        luts = np.concatenate([_lookup(specs[16 * k + t]) for _, d, a in scan for k, t in ((0, d), (1, a))])
        # the blocks of one MCU, by place in the scan
        mcu = np.array([s for s, (p, _, _) in enumerate(scan) for _ in range(sampling[p][0] * sampling[p][1] if len(scan) > 1 else 1)])
        bodies, starts, need, ids, at = [], [], [], [], 0
        for i, im in members:
            body, marks = _segments(np.frombuffer(images[i], np.uint8, offset=im.start))
            if len(scan) == 1:
                total = -(-im.width // 8) * -(-im.height // 8)
            else:
                total = -(-im.width // (8 * max(h for h, _ in sampling))) * -(-im.height // (8 * max(v for _, v in sampling)))
            each = im.restart or total
            left = np.clip(total - each * np.arange(len(marks)), 0, each)
            if left.sum() != total:
                out[i] = MediaError("restart intervals are missing")
                continue
            bodies += [body, np.zeros(8, np.uint8)]
            starts.append(marks + at)
            need.append(left)
            ids.append((i, im, total))
            at += len(body) + 8
        if not ids:
            continue
        data = np.concatenate(bodies)
        coef, ok = _lanes(data, np.concatenate(starts), np.concatenate(need), mcu, luts)
        first = 0
        for i, im, total in ids:
            n = total * len(mcu)
            out[i] = (im, coef[first : first + n], np.tile(mcu, total)) if ok[first : first + n].all() else MediaError("bad code")
            first += n
    return out


def _lanes(data: np.ndarray, start: np.ndarray, mcus: np.ndarray, mcu: np.ndarray, luts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decode all lanes in step. Returns coefficients [block, 64] and whether each block was read."""
    words = data[:-4].astype(np.uint32) << 16 | data[1:-3].astype(np.uint32) << 8 | data[2:-2]
    words = (words.astype(np.uint64) << np.uint64(16) | data[3:-1].astype(np.uint64) << np.uint64(8) | data[4:]).astype(np.int64)  # 40 bits from each byte
    blocks = mcus * len(mcu)
    first = np.concatenate(([0], np.cumsum(blocks)))
    coef, ok = np.zeros((int(first[-1]), 64), np.int16), np.ones(int(first[-1]), bool)
    flat = coef.ravel()
    limit = len(words) - 1
    pos, block, last = start.astype(np.int64) * 8, first[:-1].copy(), first[1:]
    place = np.zeros(len(start), np.int64)  # next coefficient of the lane's block
    dc = np.zeros((len(start), int(mcu.max()) + 1), np.int64)
    lane = np.flatnonzero(block < last)
    pos, block, last, place, dc, origin = (x[lane] for x in (pos, block, last, place, dc, first[:-1]))
    one = len(mcu) == 1
    while len(pos):
        part = 0 if one else mcu[(block - origin) % len(mcu)]
        word = words[np.minimum(pos >> 3, limit)]
        shift = pos & 7
        head = (word >> (24 - shift)) & 0xFFFF
        entry = luts[((2 * part + (place > 0)) << 16) + head].astype(np.int64)
        bits, symbol = entry >> 8, entry & 255
        size = symbol & 15
        # a code and its magnitude bits are 31 bits at most
        value = (word >> (40 - shift - bits - size)) & ((1 << size) - 1)
        value -= np.where(value < (1 << size >> 1), (1 << size) - 1, 0)
        pos = pos + bits + size
        is_dc = place == 0
        at = place + np.where(is_dc, 0, symbol >> 4)
        end = ~is_dc & (size == 0) & (symbol != 0xF0)  # end of block
        bad = (bits == 0) | (at > 63) & ~end
        if is_dc.any():
            rows = np.flatnonzero(is_dc)
            parts = 0 if one else part[rows]
            dc[rows, parts] += value[rows]
            value[rows] = dc[rows, parts]
        put = ~end & ~bad & (is_dc | (size > 0))
        if put.all():
            flat[block * 64 + at] = value
        else:
            flat[block[put] * 64 + at[put]] = value[put]
        place = np.where(end, 64, at + 1)
        done = place > 63
        if bad.any():
            for b, z in zip(block[bad], last[bad], strict=True):
                ok[b:z] = False
            block = np.where(bad, last, block)
            done &= ~bad
        if done.any() or bad.any():
            block = block + done
            place = np.where(done, 0, place)
            live = block < last
            if not live.all():
                pos, block, last, place, dc, origin = (x[live] for x in (pos, block, last, place, dc, origin))
    return coef, ok


def stored(image: Image, coef: np.ndarray) -> bytes:
    """The payload that ``encode`` stored: magnitude bits of the comment's number of blocks."""
    n = int(image.comment.removeprefix(b"blocks=") or len(coef))
    c = coef[:n]
    return np.where(c > 0, c, c + (1 << SIZE_CLASS) - 1).astype(np.uint8).tobytes()


def thumbnail(image: Image, coef: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size: each block's mean from its DC coefficient."""
    s = 0  # the first component of the scan is the luminance
    p, _, _ = image.scan[s]
    _, h, v, q = image.parts[p]
    dc = coef[parts == s, 0].astype(np.int32) * int(image.quant[q][0])
    if len(image.scan) == 1:
        wide, high = -(-image.width // 8), -(-image.height // 8)
        grid = dc.reshape(high, wide)
    else:
        most_h, most_v = max(x[1] for x in image.parts), max(x[2] for x in image.parts)
        mw, mh = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
        grid = dc.reshape(mh, mw, v, h).transpose(0, 2, 1, 3).reshape(mh * v, mw * h)
    return np.clip((grid + 4) // 8 + 128, 0, 255).astype(np.uint8)


def mean_hash(thumb: np.ndarray, side: int = 8) -> str:
    """64 bits: which of side x side cells of the thumbnail are at least as bright as their mean."""
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    edges = []
    for n in thumb.shape:
        cut = np.arange(side + 1) * n // side
        low = np.minimum(cut[:-1], n - 1)
        edges.append((low, np.maximum(cut[1:], low + 1)))
    (top, bottom), (left, right) = edges
    sums = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    grid = sums / ((bottom - top)[:, None] * (right - left))
    return np.packbits(grid >= grid.mean()).tobytes().hex()


def _as_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch, "text", CHUNK_BYTES):
            texts = part.column("text").to_pylist()
            sizes = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(encode([payload(t) for t in texts]), pa.binary())})


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text as a JPEG."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_as_media, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_hash string, thumb_sha256 string, error string"


def _read_one(data: bytes, got: tuple[Image, np.ndarray, np.ndarray] | MediaError) -> tuple:
    known = (len(data), hashlib.sha256(data).hexdigest())
    if isinstance(got, MediaError):
        return (None, None, None, *known, None, None, None, None, str(got))
    image, coef, parts = got
    raw = stored(image, coef) if image.comment.startswith(b"blocks=") else None
    thumb = thumbnail(image, coef, parts)
    digest = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:])) if raw is not None else (None, None, None)
    return (*digest, *known, image.width, image.height, mean_hash(thumb), hashlib.sha256(thumb.tobytes()).hexdigest(), None)


def read(media: DataFrame) -> DataFrame:
    """The rows of ``media`` (doc_id, n_bytes, media) with the features of each JPEG, without the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("thumb_hash", pa.string()), ("thumb_sha256", pa.string()), ("error", pa.string())])
        for batch in batches:
            for part in common.chunks(batch, "media", CHUNK_BYTES):
                data = part.column("media").to_pylist()
                there = [d for d in data if d is not None]
                found = iter(decode(there))
                rows = [_read_one(d, next(found)) if d is not None else (None,) * 9 + ("no media",) for d in data]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *schema.names])

    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), F.col("media").cast("binary")).mapInArrow(run, f"doc_id long, n_bytes long, {FEATURES}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(store(common.documents(spark, sf_dir)))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumb_hash", "thumb_sha256")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "width", "height", "thumb_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_media_jpeg": query}
ORACLES: dict[str, str] = {}
