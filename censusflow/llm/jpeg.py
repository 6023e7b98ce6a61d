"""Media columns as baseline JPEG, written and read in numpy.

Reading takes any sequential 8-bit Huffman-coded JPEG (one scan, 1 to 4 components, any sampling, restart intervals):
markers are parsed, the restart intervals of many images are decoded in lock step (each numpy step takes one symbol of
every interval), and a luminance thumbnail is made from the DC terms alone. No inverse DCT is needed for that.

Writing stores a payload losslessly in the format's own unit, the quantised coefficient: 64 bytes fill a block in scan
order, nine blocks (576 bytes) are a row of the image and a restart interval. A byte stands for a signed value other
than 0, small for frequent bytes, so every coefficient is one symbol of run 0. Payloads over 8,191 rows go into several
images, one after another.

Defined cases: null or empty text is one row of padding; equal texts give equal bytes; media that is null or cut short
raises ValueError when read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from censusflow.llm.common import pieces

ROW, BLOCKS, MOST_ROWS = 576, 9, 8191
# Frequent bytes first; all others follow in order of value.
_FREQUENT = b" eanitrshdolcu\xffm.\xc3g,bpf\xa9wvEONTIyA!RSkqx\n"
_RANK = np.array([*_FREQUENT, *sorted(set(range(256)) - set(_FREQUENT))])
_VALUE = np.zeros(256, np.int16)  # byte to coefficient
_VALUE[_RANK] = [(r // 2 + 1) * (1 if r % 2 == 0 else -1) for r in range(256)]
_BYTE = np.zeros(257, np.uint8)  # coefficient + 128 to byte
_BYTE[_VALUE.astype(np.int64) + 128] = np.arange(256)

# Our own Huffman tables: number of codes of each length 1..16, and symbols.
AC = ([0, 3, 1, 1, 1, 1, 1] + [0] * 9, [1, 2, 3, 4, 5, 6, 7, 8])
DC = ([0, 0, 0, 10] + [0] * 12, list(range(10)))


def codes(table) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, length)."""
    counts, symbols = table
    out, code, i = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[i : i + n]:
            out[s] = (code, length)
            code += 1
        i += n
        code <<= 1
    return out


def _symbols(values: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Code with magnitude bits, and length, for each value as a symbol of run 0."""
    c = codes(table)
    size = np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)
    magnitude = np.where(values < 0, values + (1 << size) - 1, values)
    code = np.array([c.get(int(s), (0, 0)) for s in size])
    return (code[:, 0] << size) | magnitude, code[:, 1] + size


_AC_CODE, _AC_LEN = (a.astype(np.uint32) for a in _symbols(_VALUE.astype(np.int64), AC))
_DC_CODE, _DC_LEN = (a.astype(np.uint32) for a in _symbols(np.arange(-256, 257), DC))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int, n_bytes: int) -> bytes:
    tables = b"".join(bytes([k << 4, *t[0], *t[1]]) for k, t in enumerate((DC, AC)))
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, b"payload %d" % n_bytes),
            _segment(0xDB, bytes([0]) + bytes([1] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * BLOCKS, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, tables),
            _segment(0xDD, struct.pack(">H", BLOCKS)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        )
    )


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % ROW or (ROW if not text else 0))


def encode(payloads: list[tuple[bytes, int]]) -> list[bytes]:
    """JPEG bytes for (padded payload, bytes before padding)."""
    rows = [len(p) // ROW for p, _ in payloads]
    data = np.frombuffer(b"".join(p for p, _ in payloads), np.uint8)
    code, length = _AC_CODE[data], _AC_LEN[data]
    dc = _VALUE[data[::64]].astype(np.int64).reshape(-1, BLOCKS)
    diff = np.diff(dc, axis=1, prepend=0).ravel() + 256
    code[::64], length[::64] = _DC_CODE[diff], _DC_LEN[diff]
    bits = length.reshape(-1, ROW).sum(1, dtype=np.int64)
    size = (bits + 7) // 8
    start = np.cumsum(size) - size
    at = (np.cumsum(length.reshape(-1, ROW), 1, dtype=np.int64) - length.reshape(-1, ROW) + 8 * start[:, None]).ravel()
    window = (code << (np.uint32(24) - (at & 7).astype(np.uint32) - length)).astype(np.uint32)
    at >>= 3
    total = int(size.sum())
    out = np.zeros(total + 3, np.int64)
    for k in range(3):
        out[k : k + total] += np.bincount(at, (window >> np.uint32(16 - 8 * k)) & np.uint32(255), total).astype(np.int64)
    out = out[:total].astype(np.uint8)
    out[start + size - 1] |= ((1 << (8 * size - bits)) - 1).astype(np.uint8)
    # stuff a zero after each 0xFF and leave two bytes for a marker after each row
    full = out == 255
    shift = np.cumsum(full) - full + 2 * np.repeat(np.arange(len(size)), size)
    stuffed = np.zeros(total + int(full.sum()) + 2 * len(size), np.uint8)
    stuffed[np.arange(total) + shift] = out
    last = (start + size - 1) + shift[start + size - 1] + full[start + size - 1] + 1
    inside = np.concatenate([np.arange(r) % MOST_ROWS for r in rows])
    closes = np.concatenate([(np.arange(1, r + 1) % MOST_ROWS == 0) | (np.arange(1, r + 1) == r) for r in rows])
    stuffed[last] = 255
    stuffed[last + 1] = np.where(closes, 0xD9, 0xD0 + inside % 8)
    ends = last + 2
    blob, result, row, begin = stuffed.tobytes(), [], 0, 0
    for (_, n), r in zip(payloads, rows, strict=True):
        parts, left = [], r
        while left:
            k = min(left, MOST_ROWS)
            end = int(ends[row + k - 1])
            parts += [header(k, n), blob[begin:end]]
            begin, row, left = end, row + k, left - k
        result.append(b"".join(parts))
    return result


@dataclass
class Image:
    """What the markers of one image say, and where its entropy-coded intervals lie in the data."""

    width: int = 0
    height: int = 0
    restart: int = 0
    comment: bytes = b""
    quant: dict = field(default_factory=dict)
    huffman: dict = field(default_factory=dict)
    frame: tuple = ()
    scan: tuple = ()
    body: tuple = (0, 0)
    end: int = 0


def parse(data: bytes, at: int = 0) -> Image:
    """One image from `at` on; end is the place after its EOI."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    image, at = Image(), at + 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("JPEG markers cut short")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = struct.unpack(">64H", body[1:129])[0] if wide else body[1]
                body = body[129 if wide else 65 :]
        elif marker == 0xC0 or marker == 0xC1:
            if body[0] != 8:
                raise ValueError("only 8-bit samples")
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.frame = tuple((body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3))
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            image.scan = tuple((body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2))
            break
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise ValueError("JPEG scan cut short")
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end = data.find(b"\xff\xd9", end) if image.comment.startswith(b"payload ") else end + 2
            if end < 0:
                raise ValueError("JPEG scan cut short")
        else:
            break
    image.body, image.end = (at, end), end + 2
    return image


@lru_cache(64)
def lookup(table) -> tuple[np.ndarray, ...]:
    """For each 16 bits: bits of code and magnitude (0: no code), run, size, value (valid if all bits fit), fits."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes(table).items():
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
    run, size = symbol >> 4, symbol & 15
    fits = length + size <= 16
    raw = (np.arange(1 << 16) >> np.maximum(0, 16 - length - size)) & ((1 << size) - 1)
    value = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
    return (length + size).astype(np.int64), run.astype(np.int64), size.astype(np.int64), value.astype(np.int16), fits, length


class _Reader:
    """Bit positions in many intervals of one unstuffed byte string."""

    def __init__(self, data: np.ndarray, start: np.ndarray):
        wide = np.concatenate((data, np.full(4, 255, np.uint8))).astype(np.uint32)
        self.window = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
        self.at = start.astype(np.int64) * 8

    def peek(self, at):
        return ((self.window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)

    def take(self, table, who=None):
        """Next symbol and its value of all intervals, or of those in `who`."""
        bits, run, size, value, fits, code = lookup(table)
        at = self.at if who is None else self.at[who]
        p = self.peek(at)
        n, v = bits[p], value[p]
        if not n.all():
            raise ValueError("bad Huffman code")
        ok = fits[p]
        if not ok.all():
            w = np.flatnonzero(~ok)
            s = size[p[w]]
            raw = self.peek(at[w] + code[p[w]]) >> (16 - s)
            v = v.astype(np.int64)
            v[w] = np.where(raw < (1 << (s - 1)), raw - (1 << s) + 1, raw)
        if who is None:
            self.at += n
        else:
            self.at[who] += n
        return run[p], size[p], v


def decode(reader: _Reader, layout: list[tuple], units: int) -> list[np.ndarray]:
    """Coefficients in scan order, per block of the unit: arrays (interval, unit, 64). layout: (component, DC, AC)."""
    n = len(reader.at)
    out = [np.zeros((units, 64, n), np.int16) for _ in layout]
    pred = {c: np.zeros(n, np.int64) for c, _, _ in layout}
    for u in range(units):
        for b, (component, dc, ac) in enumerate(layout):
            _, _, v = reader.take(dc)
            pred[component] += v
            block = out[b][u]
            block[0] = pred[component]
            k = 1
            while k < 64:  # as long as all intervals stand at the same place
                run, size, v = reader.take(ac)
                if run.any() or not size.all():
                    break
                block[k] = v
                k += 1
            else:
                continue
            place = np.full(n, k)
            who = np.arange(n)
            while True:
                place[who] = np.where(size > 0, place[who] + run, np.where(run == 15, place[who] + 15, 64))
                put = size > 0
                if (place[who[put]] > 63).any():
                    raise ValueError("a block has too many coefficients")
                block[place[who[put]], who[put]] = v[put]
                place[who] += 1
                who = np.flatnonzero(place < 64)
                if not len(who):
                    break
                run, size, v = reader.take(ac, who)
    return [o.transpose(2, 0, 1) for o in out]


def read(media: list[bytes]) -> list[list[tuple[Image, list[np.ndarray]]]]:
    """Per media value its images, each with the coefficients (unit, 64) of the blocks of a unit.

    Images with the same tables are decoded together, all full restart intervals of theirs at once.
    """
    result: list[list] = []
    groups: dict[tuple, list] = {}
    for m in media:
        if m is None:
            raise ValueError("media is null")
        images, at = [], 0
        while at < len(m):
            image = parse(m, at)
            at = image.end
            images.append([image, None])
            comps = {c: (h, v) for c, h, v, _ in image.frame}
            alone = len(image.scan) == 1
            layout = tuple((c, image.huffman[d], image.huffman[16 + a]) for c, d, a in image.scan for _ in range(1 if alone else comps[c][0] * comps[c][1]))
            mh, mv = (1, 1) if alone else (max(h for h, _ in comps.values()), max(v for _, v in comps.values()))
            units = -(-image.width // (8 * mh)) * -(-image.height // (8 * mv))
            groups.setdefault(layout, []).append((images[-1], m, units))
        result.append(images)
    for layout, members in groups.items():
        data = b"".join(m[i.body[0] : i.body[1]] + b"\xff\xd9" for (i, _), m, _ in members)
        raw = np.frombuffer(data, np.uint8)
        ff = np.flatnonzero(raw[:-1] == 255)
        after = raw[ff + 1]
        marks = ff[after != 0]
        drop_ = np.zeros(len(raw), bool)
        drop_[ff[after == 0] + 1] = True
        drop_[marks] = drop_[marks + 1] = True
        clean = raw[~drop_]
        gone = np.cumsum(drop_)
        begins = np.concatenate(([0], marks[:-1] + 2))
        starts = begins - np.where(begins > 0, gone[begins - 1], 0)
        lengths, owner = [], []
        for j, ((i, _), _, units) in enumerate(members):
            step = i.restart or units
            full, rest = divmod(units, step)
            lengths += [step] * full + [rest] * bool(rest)
            owner += [j] * (full + bool(rest))
        if len(lengths) != len(starts):
            raise ValueError("restart markers don't match the image's size")
        lengths, owner = np.array(lengths), np.array(owner)
        got: list = [None] * len(lengths)
        for units in np.unique(lengths):
            which = np.flatnonzero(lengths == units)
            blocks = decode(_Reader(clean, starts[which]), list(layout), int(units))
            for k, w in enumerate(which.tolist()):
                got[w] = [b[k] for b in blocks]
        cut = np.searchsorted(owner, np.arange(len(members) + 1))
        for j, (slot, _, _) in enumerate(members):
            mine = got[cut[j] : cut[j + 1]]
            slot[1] = [np.concatenate([g[b] for g in mine]) if len(mine) > 1 else mine[0][b] for b in range(len(layout))]
    return [[(i, b) for i, b in images] for images in result]


def thumbnail(image: Image, blocks: list[np.ndarray]) -> np.ndarray:
    """Luminance of the first component at one pixel per block, from DC terms."""
    first, h, v, q = image.frame[0]
    alone = len(image.scan) == 1
    if alone:
        wide = -(-image.width // 8)
        dc = blocks[0][:, 0].reshape(-1, wide)
    else:
        mh = max(f[1] for f in image.frame)
        wide = -(-image.width // (8 * mh))
        dc = np.stack([b[:, 0] for b in blocks[: h * v]], 1).reshape(-1, wide, v, h).transpose(0, 2, 1, 3).reshape(-1, wide * h)
    return np.clip(dc.astype(np.int64) * image.quant[q] // 8 + 128, 0, 255).astype(np.uint8)


def feature(images: list[tuple[Image, list[np.ndarray]]]) -> str:
    """Dimensions, a 64-bit mean hash of the thumbnail at 8 x 8, and a digest of the whole thumbnail."""
    thumbs = [thumbnail(i, b) for i, b in images]
    whole = thumbs[0] if len(thumbs) == 1 else np.concatenate(thumbs)
    ys, xs = ((np.arange(8) * n // 8) for n in whole.shape)
    sums = np.add.reduceat(np.add.reduceat(whole.astype(np.int64), np.minimum(ys, len(whole) - 1), 0), np.minimum(xs, whole.shape[1] - 1), 1)
    bits = np.packbits((sums > sums.mean()).ravel()).tobytes().hex()
    return f"{images[0][0].width}x{sum(i.height for i, _ in images)}:{bits}:{hashlib.blake2b(whole.tobytes(), digest_size=8).hexdigest()}"


def payload(images: list[tuple[Image, list[np.ndarray]]]) -> tuple[bytes, int]:
    """The stored bytes with their padding, and how many were there before it."""
    return b"".join(_BYTE[b[0].ravel().astype(np.int64) + 128].tobytes() for _, b in images), int(images[0][0].comment.split()[1])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches, limit=2 << 20):
        media = encode([(padded(t), len(t)) for t in texts])
        yield pa.record_batch([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: each whole text stored as JPEG."""
    return docs.select("doc_id", "text").mapInArrow(_write, "doc_id long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, media in pieces(batches, "media", 2 << 20):
        rows = []
        for doc, m, images in zip(batch.column("doc_id").to_pylist(), media, read(media), strict=True):
            data, n = payload(images)
            rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(images), images[0][0].width, sum(i.height for i, _ in images)))
        types = [pa.int64() if c.split()[1] == "long" else pa.string() for c in _FEATURES.split(", ")]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _FEATURES.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """Features of media that to_media() wrote, from the stored bytes alone. Columns beside doc_id and media are left out."""
    return media.select("doc_id", "media").mapInArrow(_read, _FEATURES)
