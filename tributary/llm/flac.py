"""Media columns: lossless FLAC streams, written and decoded with array operations.

`encode_payloads` stores byte payloads as mono 8-bit samples (byte - 128) in FLAC: STREAMINFO with the samples' MD5, a
SEEKTABLE, and frames of `BLOCK` samples with CRC-8 headers and CRC-16 footers. Each frame's subframe is CONSTANT,
VERBATIM or a FIXED linear predictor of order 0 to 4 with Rice-coded residuals, whichever is shortest.

`decode` reads any mono or stereo FLAC stream of 4 to 24 bits per sample with fixed or LPC predictors, both Rice methods,
escaped partitions, wasted bits and stereo decorrelation; it verifies both checksums of each frame and the MD5, and returns PCM
with each frame's first sample and byte offset, so blocks can be sought. `decode_many` decodes the frames of many streams
in lockstep: sample i of all frames is read at once, so Rice codes cost array operations, not loops over samples.
`seek` decodes only the frame that holds a sample. `pcm_blocks` makes a table of PCM blocks, each with its first sample and the byte
offset that decoding can begin at.

Null text counts as empty, whose payload is one block of bytes 255. A damaged frame raises ValueError. Equal texts give
equal bytes. Extra columns are ignored; repeated rows are answered alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 576
BITS = 8
#: Frames that are coded at once.
LANES = 2500
MAX_RICE = 7
#: Frames of a PCM block.
PCM_FRAMES = 16
#: Coefficients of the fixed predictors by order: fixed values of the format.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint16)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_many(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges in lockstep, longest first, so that finished ranges drop out at the end."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    at, left = begin[order], size[order]
    crc = np.zeros(len(size), np.uint16)
    alive = len(size)
    for i in range(int(left[0]) if len(left) else 0):
        while left[alive - 1] <= i:
            alive -= 1
        c = crc[:alive]
        crc[:alive] = (c << np.uint16(8)) ^ CRC16[(c >> np.uint16(8)) ^ data[at[:alive] + i]]
    out = np.empty(len(size), np.uint16)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """The format's variable-length code of a frame or sample number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 6
    while n >= 1 << room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room -= 1
    return bytes([(0xFF << (room + 1)) & 0xFF | n, *reversed(tail)])


_HEADERS: dict[int, bytes] = {}


def _frame_header(number: int) -> bytes:
    """Fixed block size 576 (code 2), rate from STREAMINFO, mono, 8 bits; ends with its CRC-8."""
    if number not in _HEADERS:
        head = bytes([0xFF, 0xF8, 0x20, 0x02]) + _utf8_number(number)
        if len(_HEADERS) > 4096:
            return head + bytes([crc8(head)])
        _HEADERS[number] = head + bytes([crc8(head)])
    return _HEADERS[number]


def _subframes(x: np.ndarray) -> list[bytes]:
    """The subframe of each row of samples, byte-padded."""
    n, size = x.shape
    # sum of |residual| picks the order; the Rice parameter follows from exact bit counts
    residual = [x]
    for _ in range(4):
        residual.append(np.diff(residual[-1], axis=1))
    cost = np.stack([np.abs(r[:, 4 - k :]).sum(axis=1) for k, r in enumerate(residual)])
    order = cost.argmin(axis=0)
    folded = np.zeros((n, size), np.uint32)
    for k in range(5):
        at = order == k
        if at.any():
            r = residual[k][at]
            folded[at, k:] = ((r << 1) ^ (r >> 31)).astype(np.uint32)
    live = np.arange(size) >= order[:, None]
    lengths = np.stack([((folded >> np.uint32(k)) * live).sum(axis=1, dtype=np.int64) + (size - order) * (k + 1) for k in range(MAX_RICE + 1)])
    rice = lengths.argmin(axis=0)
    bits = 8 + 8 * order + 6 + 4 + lengths.min(axis=0)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (bits >= 8 + 8 * size)
    bits[verbatim], bits[constant] = 8 + 8 * size, 16
    nbytes = -(-bits // 8)
    base = np.concatenate([[0], np.cumsum(nbytes)])
    out = np.zeros(int(base[-1]) * 8, np.uint8)  # one place a bit
    start = base[:-1] * 8

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            out[at + b] = value >> (width - 1 - b) & 1

    coded = ~constant & ~verbatim
    put(start, np.where(constant, 0, np.where(verbatim, 2, 0x10 | order << 1)), 8)
    put(start[constant] + 8, x[constant, 0] & 0xFF, 8)
    if verbatim.any():
        put((start[verbatim] + 8)[:, None] + 8 * np.arange(size), x[verbatim] & 0xFF, 8)
    rows = np.flatnonzero(coded)
    if len(rows):
        for k in range(4):
            own = rows[order[rows] > k]
            put(start[own] + 8 + 8 * k, x[own, k] & 0xFF, 8)
        head = start[rows] + 8 + 8 * order[rows]
        put(head + 6, rice[rows], 4)  # method 0 and partition order 0 are zero bits
        u, p, ok = folded[rows], rice[rows].astype(np.uint32)[:, None], live[rows]
        q = (u >> p).astype(np.int64)
        width = np.where(ok, q + 1 + p, 0)
        at = (head + 10)[:, None] + np.cumsum(width, axis=1) - width
        stop = at + q
        out[stop[ok]] = 1
        for b in range(MAX_RICE):
            # bit b of the low part, from the top
            mine = ok & (p > b)
            sel = np.flatnonzero(mine.reshape(-1))
            if len(sel):
                shift = (np.broadcast_to(p, u.shape).reshape(-1)[sel] - 1 - b).astype(np.uint32)
                out[stop.reshape(-1)[sel] + 1 + b] = u.reshape(-1)[sel] >> shift & 1
    raw = np.packbits(out).tobytes()
    base = base.tolist()
    return [raw[a:b] for a, b in zip(base, base[1:], strict=False)]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; payloads are positive multiples of BLOCK bytes."""
    frames = [len(p) // BLOCK for p in payloads]
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
    numbers = [i for n in frames for i in range(n)]
    made: list[bytes] = []
    for a in range(0, len(x), LANES):
        subs = _subframes(x[a : a + LANES])
        made += [_frame_header(i) + s for i, s in zip(numbers[a : a + LANES], subs, strict=True)]
    flat = np.frombuffer(b"".join(made), np.uint8)
    end = np.cumsum([len(m) for m in made])
    crc = crc16_many(flat, end - [len(m) for m in made], end).astype(">u2").tobytes()
    out, k = [], 0
    for p, n in zip(payloads, frames, strict=True):
        sizes = [len(m) + 2 for m in made[k : k + n]]
        body = b"".join(m + crc[2 * (k + i) : 2 * (k + i) + 2] for i, m in enumerate(made[k : k + n]))
        offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        k += n
        signed = (np.frombuffer(p, np.uint8) - np.uint8(128)).tobytes()
        low = 44100 << 44 | 0 << 41 | (BITS - 1) << 36 | len(p)
        info = BLOCK.to_bytes(2) * 2 + min(sizes).to_bytes(3) + max(sizes).to_bytes(3) + low.to_bytes(8) + hashlib.md5(signed, usedforsecurity=False).digest()
        # as many points as a metadata block holds, evenly spread
        step = -(-n // 900_000)
        points = b"".join((i * BLOCK).to_bytes(8) + int(offsets[i]).to_bytes(8) + BLOCK.to_bytes(2) for i in range(0, n, step))
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3) + info + bytes([0x83]) + len(points).to_bytes(3) + points + body)
    return out


def stream_header(data: bytes) -> tuple[dict, list[tuple[int, int]], int]:
    """STREAMINFO, seek points (sample, offset from the first frame), and where the first frame begins."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    info, points, at, last = {}, [], 4, False
    while not last:
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4])
        b = data[at + 4 : at + 4 + n]
        if kind == 0:
            low = int.from_bytes(b[10:18])
            info = {"min_block": int.from_bytes(b[0:2]), "max_block": int.from_bytes(b[2:4]), "rate": low >> 44, "channels": (low >> 41 & 7) + 1, "bits": (low >> 36 & 31) + 1, "samples": low & (1 << 36) - 1, "md5": b[18:34]}
        elif kind == 3:
            points = [(int.from_bytes(b[i : i + 8]), int.from_bytes(b[i + 8 : i + 16])) for i in range(0, n, 18) if b[i : i + 8] != b"\xff" * 8]
        at += 4 + n
    return info, points, at


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, self.at + n + 7 >> 3
        if b > len(self.data):
            raise ValueError("FLAC stream ends early")
        v = int.from_bytes(self.data[a:b]) >> (8 * b - self.at - n) & (1 << n) - 1
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        q = 0
        while not self.take(1):
            q += 1
        return q


def _header(bits: _Bits, info: dict) -> tuple[int, int, int, int]:
    """Block size, channel assignment, bits per sample and number of the frame that begins here; its CRC-8 is verified."""
    begin = bits.at // 8
    if bits.take(15) != 0x7FFC:
        raise ValueError("no frame here")
    bits.take(1)
    block, rate, channels, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    first = bits.take(8)
    more = 0
    while first >> (7 - more) & 1:
        more += 1
    number = first & (0x7F >> more)
    for _ in range(max(more - 1, 0)):
        number = number << 6 | bits.take(8) & 0x3F
    # fixed values of the format
    size = 192 if block == 1 else 576 << (block - 2) if 2 <= block <= 5 else bits.take(8) + 1 if block == 6 else bits.take(16) + 1 if block == 7 else 256 << (block - 8)
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    depth = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
    end = bits.at // 8
    if bits.take(8) != crc8(bits.data[begin:end]):
        raise ValueError("a frame's header is damaged")
    return size, channels, depth, number


def _subframe(bits: _Bits, size: int, depth: int) -> np.ndarray:
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        shift, weights = 0, FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = tuple(bits.signed(precision) for _ in range(order))
        wide = 4 + bits.take(2)
        parts = bits.take(4)
        for part in range(1 << parts):
            n = (size >> parts) - (order if part == 0 else 0)
            rice = bits.take(wide)
            escaped = rice == (1 << wide) - 1
            raw = bits.take(5) if escaped else 0
            for _ in range(n):
                if escaped:
                    e = bits.signed(raw)
                else:
                    u = bits.unary() << rice | bits.take(rice)
                    e = u >> 1 ^ -(u & 1)
                out.append(e + (sum(w * out[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("reserved subframe")
    return np.array(out, np.int64) << wasted


def decode_frame(data: bytes, at: int, info: dict) -> tuple[np.ndarray, int, int]:
    """Samples (channels x size) of the frame at a byte, its number, and the byte after it; checksums are verified."""
    bits = _Bits(data, at)
    size, channels, depth, number = _header(bits, info)
    count = 2 if channels >= 8 else channels + 1
    sub = [_subframe(bits, size, depth + ((channels, i) in ((8, 1), (9, 0), (10, 1)))) for i in range(count)]
    end = -(-bits.at // 8)
    flat = np.frombuffer(data, np.uint8)
    if int(crc16_many(flat, np.array([at]), np.array([end]))[0]) != int.from_bytes(data[end : end + 2]):
        raise ValueError("a frame is damaged")
    if channels == 8:
        sub[1] = sub[0] - sub[1]
    elif channels == 9:
        sub[0] = sub[0] + sub[1]
    elif channels == 10:
        mid = sub[0] << 1 | sub[1] & 1
        sub = [mid + sub[1] >> 1, mid - sub[1] >> 1]
    return np.stack(sub), number, end + 2


def decode(data: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """PCM (channels x samples) and, for each frame, its first sample and byte offset."""
    info, _, at = stream_header(data)
    out, index, sample = [], [], 0
    while at < len(data):
        x, _, end = decode_frame(data, at, info)
        index.append((sample, at))
        out.append(x)
        sample, at = sample + x.shape[1], end
    pcm = np.concatenate(out, axis=1) if out else np.zeros((info["channels"], 0), np.int64)
    width = -(-info["bits"] // 8)
    raw = pcm.T.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
    if info["md5"].strip(b"\0") and hashlib.md5(raw, usedforsecurity=False).digest() != info["md5"]:
        raise ValueError("the samples differ from those stored")
    return pcm, index


def seek(data: bytes, sample: int) -> tuple[np.ndarray, int]:
    """The frame's samples that hold `sample`, and the first of them; reads on from the nearest seek point before it."""
    info, points, start = stream_header(data)
    first, offset = max((p for p in points if p[0] <= sample), default=(0, 0))
    at = start + offset
    while True:
        x, _, end = decode_frame(data, at, info)
        if first <= sample < first + x.shape[1]:
            return x, first
        first, at = first + x.shape[1], end


def decode_many(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Per stream its samples as bytes (sample + 128), and each frame's first sample and byte offset. Streams of other layouts are read one by one."""
    flat = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    base, spans, alone = 0, [], {}
    for k, s in enumerate(streams):
        info, points, at = stream_header(s)
        blocks = -(-info["samples"] // BLOCK)
        if (info["channels"], info["bits"], info["min_block"], info["max_block"]) != (1, BITS, BLOCK, BLOCK) or info["samples"] % BLOCK or len(points) != blocks:
            pcm, index = decode(s)
            alone[k] = ((pcm[0] + 128).astype(np.uint8).tobytes(), index)
        else:
            ends = [at + o for _, o in points[1:]] + [len(s)]
            spans += [(k, i, base + at + o, base + e) for i, ((_, o), e) in enumerate(zip(points, ends, strict=True))]
        base += len(s)
    out = [alone.get(k, (b"", [])) for k in range(len(streams))]
    parts: dict[int, list[bytes]] = {}
    for a in range(0, len(spans), LANES):
        own = spans[a : a + LANES]
        for (k, *_), x in zip(own, _lockstep(flat, own), strict=True):
            parts.setdefault(k, []).append(x.tobytes())
    for k, p in parts.items():
        _, points, at = stream_header(streams[k])
        out[k] = (b"".join(p), [(sample, at + o) for sample, o in points])
        if hashlib.md5((np.frombuffer(out[k][0], np.uint8) - np.uint8(128)).tobytes(), usedforsecurity=False).digest() != stream_header(streams[k])[0]["md5"]:
            raise ValueError("the samples differ from those stored")
    return out


def _lockstep(flat: np.ndarray, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Samples + 128 (frames x BLOCK, bytes) of frames that lie at (stream, number, begin, end)."""
    begin, end = np.array([s[2] for s in spans]), np.array([s[3] for s in spans])
    crc = crc16_many(flat, begin, end - 2)
    if (crc != flat[end - 2].astype(np.uint16) << np.uint16(8) | flat[end - 1]).any():
        raise ValueError("a frame is damaged")
    head = np.empty(len(spans), np.int64)
    for j, (_, number, a, _) in enumerate(spans):
        expect = _frame_header(number)
        if flat[a : a + len(expect)].tobytes() != expect:
            raise ValueError("a frame's header is damaged")
        head[j] = a + len(expect)
    kind = flat[head]
    x = np.zeros((BLOCK, len(spans)), np.int32)
    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 2)
    x[:, constant] = flat[head[constant] + 1].astype(np.int8)
    x[:, verbatim] = flat[head[verbatim][None, :] + 1 + np.arange(BLOCK)[:, None]].astype(np.int8)
    rows = np.flatnonzero((kind >= 0x10) & (kind <= 0x18) & (kind & 1 == 0))
    if len(rows) + len(constant) + len(verbatim) != len(spans):
        raise ValueError("a subframe of another layout")
    if len(rows):
        order = (kind[rows].astype(np.int64) - 0x10) >> 1
        at = head[rows] + 1
        warm = np.zeros((4, len(rows)), np.int32)
        for k in range(4):
            own = order > k
            warm[k, own] = flat[at[own] + k].astype(np.int8)
        bit = 8 * (at + order)
        rice = (flat[bit >> 3].astype(np.int64) << 8 | flat[(bit >> 3) + 1]) >> 6  # method 0, order 0, parameter: ten bits
        if (rice > MAX_RICE).any():
            raise ValueError("a residual of another layout")
        bit += 10
        e = np.zeros((BLOCK, len(rows)), np.int32)
        weight = np.array([1 << s for s in range(24, -1, -8)], np.int64)
        rank = np.argsort(order, kind="stable")  # all lanes are live from sample 4 on
        order, rice, bit, rows, warm = order[rank], rice[rank], bit[rank], rows[rank], warm[:, rank]
        for i in range(BLOCK):
            n = int(np.searchsorted(order, i, side="right")) if i < 4 else len(rows)
            if not n:
                continue
            b = bit[:n]
            word = _window(flat, b, weight)
            q = np.zeros(n, np.int64)
            empty = np.flatnonzero(word == 0)
            while len(empty):  # a run of zeros longer than the window
                q[empty] += 24
                word[empty] = _window(flat, b[empty] + q[empty], weight)
                empty = empty[word[empty] == 0]
            # leading zeros of 24 bits: doubles hold them exactly, the exponent is the highest bit
            q += 24 - np.frexp(word.astype(np.float64))[1]
            p = rice[:n]
            low = _window(flat, b + q + 1, weight) >> (24 - p)
            u = q << p | low
            e[i, :n] = (u >> 1) ^ -(u & 1)
            bit[:n] = b + q + 1 + p
        y = e
        for k in range(5):
            own = slice(int(np.searchsorted(order, k)), int(np.searchsorted(order, k, side="right")))
            if own.start < own.stop:
                z = y[:, own].copy()
                w = warm[:k, own]
                # k-fold sums undo k differences; the warm-up gives where each starts
                starts = [w]
                for _ in range(k - 1):
                    starts.append(np.diff(starts[-1], axis=0))
                z = z[k:]
                for d in range(k - 1, -1, -1):
                    z = np.cumsum(np.concatenate([starts[d][-1:], z]), axis=0, dtype=np.int32)[1:]
                x[:, rows[own]] = np.concatenate([w, z]) if k else z
    return (x.T + 128).astype(np.uint8)


def _window(flat: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """24 bits of each lane from a bit on."""
    at = np.minimum(bit >> 3, len(flat) - 4)
    v = flat[at].astype(np.int64) << 24 | flat[at + 1].astype(np.int64) << 16 | flat[at + 2].astype(np.int64) << 8 | flat[at + 3]
    return v >> (8 - (bit & 7)) & 0xFFFFFF


def payload(text: str | None) -> bytes:
    """A text's UTF-8 bytes, padded with 255 to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's payload as a FLAC stream, a binary column that can be written to any table."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tokens.chunks([len(t) for t in texts], tokens.CHUNK_CHARS):
                sizes = [len(t.encode("utf-8", "replace")) for t in texts[a:b]]
                made = encode_payloads([payload(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=schema.names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(stored: DataFrame, frames: int = PCM_FRAMES) -> DataFrame:
    """The stored streams decoded: a row a PCM block of up to `frames` frames, in order, to be written to any table or read on.

    Columns: doc_id, n_bytes, media_bytes, media_sha256 (of the stream), first_sample, byte_offset (where the block's first frame
    begins in the stream), n_frames, last (of its stream), samples (a byte each: sample + 128).
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("first_sample", pa.int64()), ("byte_offset", pa.int64()), ("n_frames", pa.int64()), ("last", pa.bool_()), ("samples", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, streams = (batch.column(i).to_pylist() for i in range(3))
            for a, b in tokens.chunks([len(s) for s in streams], tokens.CHUNK_CHARS):
                rows = []
                for k, (raw, index) in enumerate(decode_many(streams[a:b]), a):
                    sha = hashlib.sha256(streams[k]).hexdigest()
                    for f in range(0, len(index), frames):
                        end = index[f + frames][0] if f + frames < len(index) else len(raw)
                        rows.append((ids[k], sizes[k], len(streams[k]), sha, *index[f], min(frames, len(index) - f), end == len(raw), raw[index[f][0] : end]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return stored.mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, first_sample long, byte_offset long, n_frames long, last boolean, samples binary")


def features(blocks: DataFrame) -> DataFrame:
    """Of PCM blocks that come in order, a row a stream: sizes, digests, and a feature (frames, mean level, crossings of zero)."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, tail, size, frames, level, crossings, before = hashlib.sha256(), b"", 0, 0, 0, 0, None
        for batch in batches:
            rows = []
            for doc, n_bytes, media_bytes, media_sha, _, _, n, last, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sha.update(raw)
                x = np.frombuffer(raw, np.uint8)
                low = x < 128
                crossings += int((low[1:] != low[:-1]).sum()) + int(before is not None and before != low[0])
                level += int(np.abs(x.astype(np.int16) - 128).sum(dtype=np.int64))
                tail, size, frames, before = raw[-32:], size + len(raw), frames + n, low[-1]
                if last:
                    rows.append((doc, n_bytes, size, sha.hexdigest(), zlib.crc32(tail), media_bytes, media_sha, f"frames={frames};level={level // size};crossings={crossings}"))
                    sha, tail, size, frames, level, crossings, before = hashlib.sha256(), b"", 0, 0, 0, 0, None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    return blocks.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as FLAC in the shared folder and read back from there."""
    return features(pcm_blocks(common.saved(media(common.table(spark, sf_dir, "documents").select("doc_id", "text")), "media")))
