"""Operator 7: FLAC media columns.

``encode`` writes 8-bit mono FLAC streams with fixed-size blocks, ``decode``
reads streams of 8-bit mono back: constant, verbatim, fixed and linear-prediction
subframes with Rice-coded residuals (any partition order), the CRC-8 of every
frame header, the CRC-16 of every frame and the MD5 of the samples. Both work on
all frames of a batch in step, as columns of NumPy arrays. ``seek`` gives the
sample offset and byte place of each block, from the seek table.

Defined cases: null and empty texts are one block of blanks; a damaged stream
raises ``ValueError`` naming the frame; equal texts give equal streams; an empty
table gives no rows; rows with equal ``doc_id`` are encoded each on its own;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE, BITS = 192, 16000, 8
#: Bits of a quantised coefficient and its shift, and the order of linear prediction.
PRECISION, SHIFT, ORDER = 10, 7, 4
#: Every how many frames the seek table has a point.
SEEK = 64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table, top = [], 1 << (bits - 1)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c & top else 0)
        table.append(c & ((1 << bits) - 1))
    return np.array(table, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of the byte spans, all in step."""
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    crc = np.zeros(len(at), np.uint32)
    mask = np.uint32((1 << bits) - 1)
    live = len(at)
    for t in range(int(size[0]) if live else 0):
        live = int(np.searchsorted(-size, -t, "left"))  # those longer than t
        c = crc[:live]
        byte = data[at[:live] + t].astype(np.uint32)
        crc[:live] = ((c << np.uint32(8)) & mask) ^ table[((c >> np.uint32(bits - 8)) ^ byte) & np.uint32(255)]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of the format, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    most = 0x1F
    while n > most:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        most >>= 1
    size = len(tail) + 1
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *tail[::-1]])


class _Bits:
    """Fields of all frames, written at a bit position of each frame."""

    def __init__(self, size: int):
        self.bits = np.zeros(size, np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            self.bits[at + j] = (value >> (width - 1 - j)) & 1


def _predict(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of order ORDER of each frame, by Levinson-Durbin, and their residuals."""
    x = samples.astype(np.float64)
    auto = np.stack([(x[:, lag:] * x[:, : x.shape[1] - lag]).sum(axis=1) for lag in range(ORDER + 1)], axis=1)
    auto[:, 0] = auto[:, 0] * (1 + 1e-9) + 1e-9
    coef = np.zeros((len(x), ORDER))
    error = auto[:, 0].copy()
    for m in range(ORDER):
        k = (auto[:, m + 1] - (coef[:, :m] * auto[:, m:0:-1]).sum(axis=1)) / error
        coef[:, :m] = coef[:, :m] - k[:, None] * coef[:, :m][:, ::-1]
        coef[:, m] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    limit = 1 << (PRECISION - 1)
    quantised = np.clip(np.rint(coef * (1 << SHIFT)), -limit, limit - 1).astype(np.int32)
    total = sum(quantised[:, j : j + 1] * samples[:, ORDER - 1 - j : samples.shape[1] - 1 - j] for j in range(ORDER))
    return quantised, samples[:, ORDER:] - (total >> SHIFT)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter (0 to 8) of each frame and the bits it takes."""
    folded = _zigzag(residual)
    cost = np.stack([(folded >> k).sum(axis=1) + folded.shape[1] * (k + 1) for k in range(9)], axis=1)
    best = cost.argmin(axis=1)
    return best, cost[np.arange(len(best)), best]


def _frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames of ``samples`` (rows of BLOCK samples) one after another, and the size of each."""
    n = len(samples)
    fixed1, fixed2 = np.diff(samples, axis=1), np.diff(samples, n=2, axis=1)
    quantised, predicted = _predict(samples)
    options = [samples, fixed1, fixed2, predicted]
    head = np.array([0, 8, 16, 8 * ORDER + 4 + 5 + PRECISION * ORDER])
    rice = [_rice(x) for x in options]
    costs = np.stack([r[1] + h + 10 for r, h in zip(rice, head)], axis=1)
    kind = costs.argmin(axis=1)
    constant = (samples == samples[:, :1]).all(axis=1)
    verbatim = ~constant & (costs.min(axis=1) >= 8 * BLOCK)
    kind = np.where(constant, 5, np.where(verbatim, 4, kind))
    coded = [_utf8_number(int(x)) for x in numbers]
    number_size = np.array([len(x) for x in coded])
    header = 4 + number_size + 1  # with its CRC
    body = 8 + np.where(kind == 5, 8, np.where(kind == 4, 8 * BLOCK, costs[np.arange(n), np.minimum(kind, 3)]))
    size = header + (body + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(size)])
    out = _Bits(int(starts[-1]) * 8)
    at = starts[:-1] * 8
    # sync code and fixed block size; 192 samples, rate from the stream's head; one channel, 8 bits
    out.put(at, np.full(n, 0xFFF81002, np.int64), 32)
    for i in range(7):
        rows = np.flatnonzero(number_size > i)
        out.put(at[rows] + 32 + 8 * i, np.array([coded[r][i] for r in rows.tolist()], np.int64), 8)
    place = at + 8 * header
    sub = np.select([kind == 5, kind == 4, kind == 3], [0, 1, 32 + ORDER - 1], 8 + kind)
    out.put(place, sub << 1, 8)
    place = place + 8
    rows = np.flatnonzero(kind == 5)
    out.put(place[rows], samples[rows, 0] & 255, 8)
    rows = np.flatnonzero(kind == 4)
    for t in range(BLOCK if len(rows) else 0):
        out.put(place[rows] + 8 * t, samples[rows, t] & 255, 8)
    for k, residual in enumerate(options):
        rows = np.flatnonzero(kind == k)
        if not len(rows):
            continue
        warm = BLOCK - residual.shape[1]
        at_, param = place[rows].copy(), rice[k][0][rows]
        for t in range(warm):
            out.put(at_, samples[rows, t] & 255, 8)
            at_ += 8
        if k == 3:
            out.put(at_, np.full(len(rows), (PRECISION - 1) << 5 | SHIFT, np.int64), 9)
            at_ += 9
            for j in range(ORDER):
                out.put(at_, quantised[rows, j] & ((1 << PRECISION) - 1), PRECISION)
                at_ += PRECISION
        out.put(at_, param, 10)  # Rice coding, one partition, its parameter
        at_ += 10
        folded = _zigzag(residual[rows])
        high = folded >> param[:, None]
        width = high + 1 + param[:, None]
        end = at_[:, None] + np.cumsum(width, axis=1)
        stop = end - param[:, None] - 1
        out.bits[stop] = 1
        for bit in range(int(param.max()) if len(param) else 0):
            some = np.flatnonzero(param > bit)
            out.bits[end[some] - 1 - bit] = (folded[some] >> bit) & 1
    data = np.packbits(out.bits)
    data[starts[:-1] + header - 1] = _crc(data, starts[:-1], header - 1, CRC8, 8)
    crc = _crc(data, starts[:-1], size - 2, CRC16, 16)
    data[starts[1:] - 2], data[starts[1:] - 1] = crc >> 8, crc & 255
    return data, size


def _head(payload: bytes, sizes: np.ndarray) -> bytes:
    """Stream marker, stream info and seek table."""
    total = len(payload)
    info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | (BITS - 1) << 36 | total).to_bytes(8, "big") + hashlib.md5(_signed(payload)).digest()
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[::SEEK]
    points = b"".join((i * SEEK * BLOCK).to_bytes(8, "big") + int(a).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i, a in enumerate(at.tolist()))
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points


def _signed(payload: bytes) -> bytes:
    return (np.frombuffer(payload, np.uint8) ^ 128).tobytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload: its bytes less 128 are the samples. Sizes are multiples of BLOCK."""
    blocks = np.array([len(x) // BLOCK for x in payloads])
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(b) for b in blocks]) if len(blocks) else np.zeros(0, np.int64)
    data, size = _frames(samples, numbers)
    ends, first, out, at = np.cumsum(blocks), 0, [], 0
    for payload, end in zip(payloads, ends.tolist()):
        own = size[first:end]
        n = int(own.sum())
        out.append(_head(payload, own) + data[at : at + n].tobytes())
        first, at = end, at + n
    return out


def seek(stream: bytes) -> list[tuple[int, int, int]]:
    """Seek points (sample, byte offset of its frame in the stream, samples of the frame)."""
    at, out, first = 4, [], None
    while first is None:
        kind, size = stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 3:
            body = stream[at + 4 : at + 4 + size]
            out = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        first = at + 4 + size if stream[at] & 128 else None
        at += 4 + size
    return [(s, first + o, n) for s, o, n in out if s != (1 << 64) - 1]


def _stream_info(stream: bytes) -> tuple[int, int, bytes]:
    """Place of the first frame, number of samples, MD5."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info, last = 4, b"", False
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + size]
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != BITS - 1 or info[:4] != BLOCK.to_bytes(2, "big") * 2:
        raise ValueError("not an 8-bit mono stream of blocks of 192 samples")
    return at, packed & ((1 << 36) - 1), info[18:34]


class _Reader:
    """A bit position in each frame of one byte array."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.bytes = np.concatenate([data, np.zeros(16, np.uint8)])
        self.at = at.astype(np.int64).copy()
        self.words = np.lib.stride_tricks.sliding_window_view(self.bytes, 8)

    def peek(self, rows: np.ndarray) -> np.ndarray:
        """The next 57 bits or more of each row's frame, left-aligned in 64."""
        at = self.at[rows]
        word = self.words[at >> 3].copy().view(">u8").ravel().astype(np.uint64)
        return word << (at & 7).astype(np.uint64)

    def take(self, rows: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        word = self.peek(rows)
        width = np.broadcast_to(np.asarray(width, np.int64), word.shape)
        value = np.where(width > 0, word >> (64 - np.maximum(width, 1)).astype(np.uint64), np.uint64(0))
        self.at[rows] += width
        return value.astype(np.int64)

    def signed(self, rows: np.ndarray, width: int) -> np.ndarray:
        value = self.take(rows, width)
        return np.where(value >> (width - 1), value - (1 << width), value)

    def rice(self, rows: np.ndarray, param: np.ndarray) -> np.ndarray:
        """The next Rice code of each row's frame, folded."""
        word = self.peek(rows)
        top = word >> np.uint64(28)  # 36 bits: exact as a float, whose exponent tells the leading one; up to 19 more hold the low bits
        lead = 36 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        long = np.flatnonzero((top == 0) | (param > 20))
        taken = lead + 1 + param
        low = (word << (lead + 1).astype(np.uint64)) >> (64 - param).astype(np.uint64)  # a shift by 64 gives 0
        out = lead << param | low.astype(np.int64)
        self.at[rows] += taken
        if len(long):
            self.at[rows[long]] -= taken[long]
            out[long] = self._long(rows[long]) << param[long] | 0
            out[long] |= self.take(rows[long], param[long])
        return out

    def _long(self, rows: np.ndarray) -> np.ndarray:
        """Zeros before the next one bit, which is passed over, where they may be many."""
        total, todo = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo):
            top = self.peek(rows[todo]) >> np.uint64(12)
            lead = 52 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
            none = top == 0
            self.at[rows[todo]] += np.where(none, 52, lead + 1)
            total[todo] += np.where(none, 52, lead)
            todo = todo[none]
            if int(total.max()) > 1 << 20:
                raise ValueError("a Rice code without an end")
        return total


def _frames_of(data: np.ndarray, first: int, end: int, blocks: int, points: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs (byte, block, number of blocks) to decode from: each frame if their sync codes are found, else the seek points."""
    part = data[first:end]
    found = first + np.flatnonzero((part[:-3] == 0xFF) & (part[1:-2] == 0xF8) & (part[2:-1] == 0x10) & (part[3:] == 0x02))
    if len(found) == blocks:
        return [(int(a), k, 1) for k, a in enumerate(found)]
    return [(byte, sample // BLOCK, after // BLOCK - sample // BLOCK) for (sample, byte), (after, _) in zip(points, [*points[1:], (blocks * BLOCK, 0)])]


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams with blocks of BLOCK samples. Checks every checksum."""
    heads = [_stream_info(x) for x in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(x) for x in streams])])
    blocks = np.array([n // BLOCK for _, n, _ in heads], np.int64)
    out = np.zeros((int(blocks.sum()), BLOCK), np.int32)
    row_of = np.concatenate([[0], np.cumsum(blocks)])
    runs = []
    for k, x in enumerate(streams):
        points = [(sample, int(base[k]) + byte) for sample, byte, _ in seek(x)] or [(0, int(base[k]) + heads[k][0])]
        runs += [(byte, int(row_of[k]) + block, n) for byte, block, n in _frames_of(data, int(base[k]) + heads[k][0], int(base[k + 1]), int(blocks[k]), points)]
    at, row, left = np.array(runs, np.int64).reshape(-1, 3).T.copy()
    reader = _Reader(data, at * 8)
    starts = np.zeros(len(out), np.int64)
    ends = np.zeros(len(out), np.int64)
    while len(live := np.flatnonzero(left > 0)):
        begin = reader.at[live] >> 3
        _decode_step(reader, live, out, row[live])
        reader.at[live] = (reader.at[live] + 7) >> 3 << 3
        starts[row[live]], ends[row[live]] = begin, reader.at[live] >> 3
        reader.at[live] += 16
        row[live] += 1
        left[live] -= 1
    wrong = _crc(data, starts, ends - starts, CRC16, 16) != (data[ends].astype(np.uint32) << 8 | data[ends + 1]) if len(starts) else np.zeros(0, bool)
    if wrong.any():
        raise ValueError(f"CRC-16 of frame {int(np.flatnonzero(wrong)[0])} of the batch is wrong")
    payload = (out + 128).astype(np.uint8)
    result = []
    for k, (_, n, md5) in enumerate(heads):
        one = payload[row_of[k] : row_of[k + 1]].tobytes()
        if len(one) != n or hashlib.md5(_signed(one)).digest() != md5:
            raise ValueError("MD5 of a stream is wrong")
        result.append(one)
    return result


def _decode_step(reader: _Reader, live: np.ndarray, out: np.ndarray, row: np.ndarray) -> None:
    """Read the next frame at each live place into its row of ``out``."""
    begin = reader.at[live] >> 3
    if (reader.take(live, 32) != 0xFFF81002).any():
        raise ValueError("a frame does not start as expected")
    lead = reader.take(live, 8)
    more = np.select([lead >= 0xFE, lead >= 0xFC, lead >= 0xF8, lead >= 0xF0, lead >= 0xE0, lead >= 0xC0], [6, 5, 4, 3, 2, 1], 0)
    reader.at[live] += 8 * more
    size = (reader.at[live] >> 3) - begin
    if (_crc(reader.bytes, begin, size, CRC8, 8) != reader.take(live, 8)).any():
        raise ValueError("CRC-8 of a frame header is wrong")
    kind = reader.take(live, 8) >> 1
    for k in (0, 1):
        some = np.flatnonzero(kind == k)
        for t in range(0 if not len(some) else BLOCK if k else 1):
            out[row[some], t if k else slice(None)] = reader.signed(live[some], BITS) if k else reader.signed(live[some], BITS)[:, None]
    some = np.flatnonzero(kind > 1)
    rows, to, kind = live[some], row[some], kind[some]
    if not len(rows):
        return
    if not (((kind >= 8) & (kind <= 12)) | (kind >= 32)).all():
        raise ValueError("reserved subframe type")
    linear = kind >= 32
    order = np.where(linear, kind - 31, kind - 8)
    most = int(order.max())
    found = np.zeros((BLOCK, len(rows)), np.int32)
    for t in range(most):
        some = np.flatnonzero(order > t)
        found[t, some] = reader.signed(rows[some], BITS)
    coefs, shift = np.zeros((most, len(rows)), np.int32), np.zeros(len(rows), np.int32)
    for k, row_ in enumerate(([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])):
        for j, value in enumerate(row_[:most]):
            coefs[j, kind == 8 + k] = value
    some = np.flatnonzero(linear)
    if len(some):
        precision = reader.take(rows[some], 4) + 1
        shift[some] = reader.take(rows[some], 5)
        for j in range(most):
            own = np.flatnonzero(order[some] > j)
            value, bits = reader.take(rows[some[own]], precision[own]), precision[own]
            coefs[j, some[own]] = np.where(value >> (bits - 1), value - (1 << bits), value)
    wide = np.where(reader.take(rows, 2) == 1, 5, 4)
    per = BLOCK // (1 << reader.take(rows, 4))
    param, whole = np.zeros(len(rows), np.int64), bool((per == BLOCK).all())
    for t in range(BLOCK):
        if t <= most or not whole:
            fresh = np.flatnonzero(((t % per == 0) & (t > order)) | (t == order))
            if len(fresh):
                param[fresh] = reader.take(rows[fresh], wide[fresh])
                if (param[fresh] == (1 << wide[fresh]) - 1).any():
                    raise ValueError("partitions without Rice coding are not supported")
        if t < most:
            on = np.flatnonzero(order <= t)
            folded = reader.rice(rows[on], param[on])
        else:
            on, folded = slice(None), reader.rice(rows, param)
        value = ((folded >> 1) ^ -(folded & 1)).astype(np.int32)
        if most and t:
            total = coefs[0, on] * found[t - 1, on]
            for j in range(1, min(most, t)):
                total += coefs[j, on] * found[t - 1 - j, on]
            value += total >> shift[on]
        found[t, on] = value
    out[to] = found.T


def features(samples: np.ndarray) -> str:
    """Peak, mean, root mean square and zero crossings of decoded samples."""
    x = samples.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={len(x) // BLOCK};peak={int(np.abs(x).max())};mean={int(x.sum()) * 1000 // len(x)};power={int((x * x).sum()) // len(x)};crossings={crossings}"


def _parts(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer one stands alone."""
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(size):
        end = max(first + 1, first + int(np.searchsorted(np.cumsum(size[first:]), most, "right")))
        yield first, end
        first = end


def media_column(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, media, blocks) of ``docs`` (doc_id, text): the text as a FLAC stream, and its seek points: sample, byte offset of its frame, samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in _parts(batch.column(1), most):
                part = [(x or "").encode() for x in batch.column(1).slice(first, end - first).to_pylist()]
                media = encode([x.ljust(max(1, -(-len(x) // BLOCK)) * BLOCK) for x in part])
                points = [[{"sample": s, "at": o, "samples": n} for s, o, n in seek(x)] for x in media]
                kinds = pa.list_(pa.struct([("sample", pa.int64()), ("at", pa.int64()), ("samples", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([len(x) for x in part], pa.int64()), pa.array(media, pa.binary()), pa.array(points, kinds)], ["doc_id", "n_bytes", "media", "blocks"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary, blocks array<struct<sample: long, at: long, samples: int>>")


def media_digests(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """What the streams of ``media_column`` decode to.

    The streams are read as they come; kept in a table first they would take 1.6
    times the input's Parquet files, as text doesn't compress as sound.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in _parts(batch.column(2), most):
                part = batch.slice(first, end - first)
                media = part.column(2).to_pylist()
                back = decode(media)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([len(x) for x in back], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()),
                        pa.array([len(x) for x in media], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                        pa.array([features(np.frombuffer(x, np.uint8).astype(np.int16) - 128) for x in back]),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return media_column(docs, most).select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
