"""FLAC media columns: lossless 8-bit PCM written as FLAC, and read back by Rice residuals and linear predictors with checksums verified."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.llm.common import arrow_batches, documents, utf8, written

#: Samples of a frame; the rate that a written stream states.
FRAME, RATE = 4096, 8000


class FlacError(ValueError):
    """A stream that breaks the format, or whose checksum differs."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[i] = c
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_T8, _T16 = _CRC8.tolist(), _CRC16.tolist()
_ZEROS = np.array([16, *(16 - int(i).bit_length() for i in range(1, 1 << 16))], np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _T8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = _T16[(c >> 8) ^ b] ^ (c << 8) & 0xFFFF
    return c


def crc16_many(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc16 of many pieces of a buffer at once: all advance by a byte together, the longest first so that the live ones are a prefix."""
    order = np.argsort(-size, kind="stable")
    at, left, crc = start[order].copy(), size[order], np.zeros(len(order), np.uint16)
    live = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for n in live.tolist():
        c = crc[:n]
        crc[:n] = _CRC16[(c >> 8) ^ buffer[at[:n]]] ^ (c << 8)
        at[:n] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 coding."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >> (5 * size + 1):
        size += 1
    tail = [0x80 | (n >> (6 * k)) & 0x3F for k in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size) & 0xFF | n >> (6 * (size - 1)), *tail])


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream (mono, 8 bits, fixed predictors, one Rice partition, seek table) for each payload of at least one sample.

    All frames of all payloads are coded together: predictor order and Rice parameter are chosen for each frame by summed costs, then every
    code word is added to the output at its bit offset.
    """
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads])
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    frames = -(-sizes // FRAME)
    doc = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    begin = np.repeat(np.cumsum(sizes) - sizes, frames) + number * FRAME
    count = np.minimum(FRAME, sizes[doc] - number * FRAME)
    inside = np.arange(len(x)) - np.repeat(begin, count)
    d1 = np.diff(x, prepend=0)
    d2 = np.diff(d1, prepend=0)
    residuals = [x, np.where(inside < 1, 0, d1), np.where(inside < 2, 0, d2)]
    cost = np.stack([np.add.reduceat(np.abs(r), begin) for r in residuals])
    cost[2, count < 3] = cost[1, count < 2] = 1 << 30
    order = cost.argmin(axis=0)
    r = np.choose(np.repeat(order, count), residuals)
    u = (r << 1) ^ (r >> 31)
    coded = inside >= np.repeat(order, count)
    bits = np.stack([np.add.reduceat(np.where(coded, (u >> k) + 1 + k, 0), begin) for k in range(10)])
    k = bits.argmin(axis=0)
    heads = []
    for n, c in zip(number.tolist(), count.tolist(), strict=True):
        h = b"\xff\xf8" + bytes([(12 if c == FRAME else 7) << 4, 0b0000_001_0]) + _coded_number(n) + (b"" if c == FRAME else (c - 1).to_bytes(2, "big"))
        heads.append(h + bytes([crc8(h)]))
    head = np.array([len(h) for h in heads])
    body = head + 1 + order  # bytes before the ten bits that open the residual
    total = body + (10 + bits[k, np.arange(len(k))] + 7) // 8 + 2
    place = np.cumsum(total) - total
    out = np.zeros(int(total.sum()) + 2, np.uint8)
    for at, h in zip(place.tolist(), heads, strict=True):
        out[at : at + len(h)] = np.frombuffer(h, np.uint8)
    out[place + head] = 0b0001_0000 | order << 1
    for o in (1, 2):
        for j in range(o):
            own = order == o
            out[place[own] + head[own] + 1 + j] = (x[begin[own] + j] & 0xFF).astype(np.uint8)
    # method 0, partition order 0, then the parameter
    out[place + body] = k >> 2
    out[place + body + 1] = (k & 3) << 6
    ks = np.repeat(k, count)
    q = np.where(coded, u >> ks, 0)
    width = np.where(coded, q + 1 + ks, 0)
    ends = np.cumsum(width)
    base = np.repeat((place + body) * 8 + 10 - (ends[begin] - width[begin]), count)
    low = (base + ends - (ks + 1))[coded]  # where the stop bit is
    ks, u = ks[coded], u[coded]
    word = ((1 << ks) | u & ((1 << ks) - 1)) << (24 - (low & 7) - (ks + 1))
    at = low >> 3
    out = np.concatenate([out, np.zeros(2, np.uint8)])
    for b in range(3):
        out += np.bincount(at + b, (word >> (16 - 8 * b)) & 0xFF, minlength=len(out)).astype(np.uint8)
    crc = crc16_many(out, place, total - 2)
    out[place + total - 2] = crc >> 8
    out[place + total - 1] = crc & 0xFF
    data, stop, result = out.tobytes(), np.cumsum(frames), []
    for i, p in enumerate(payloads):
        a, b = int(stop[i] - frames[i]), int(stop[i])
        seek = b"".join(int(begin[j] - begin[a]).to_bytes(8, "big") + int(place[j] - place[a]).to_bytes(8, "big") + int(count[j]).to_bytes(2, "big") for j in range(a, b))
        md5 = hashlib.md5(bytes((np.frombuffer(p, np.uint8) ^ 0x80).tobytes())).digest()
        blocks = (FRAME if b - a > 1 else max(16, int(count[a]))).to_bytes(2, "big")
        info = blocks * 2 + int(total[a:b].min()).to_bytes(3, "big") + int(total[a:b].max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        result.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[int(place[a]) : int(place[b - 1] + total[b - 1])])
    return result


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


def stream_info(media: bytes) -> dict:
    """The stream's facts: rate, channels, bits, samples, md5, seek points (sample, byte offset, samples) and where its frames begin."""
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, out = 4, {"seek": []}
    while True:
        if at + 4 > len(media):
            raise FlacError("metadata ends early")
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            x = int.from_bytes(body[10:18], "big")
            out |= {"rate": x >> 44, "channels": (x >> 41 & 7) + 1, "bits": (x >> 36 & 31) + 1, "samples": x & ((1 << 36) - 1), "md5": body[18:34], "block": int.from_bytes(body[:2], "big")}
        elif kind & 0x7F == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size - 17, 18)]
            out["seek"] = [p for p in points if p[0] != (1 << 64) - 1]
        at += 4 + size
        if kind & 0x80:
            break
    if "rate" not in out:
        raise FlacError("no STREAMINFO")
    return out | {"frames": at}


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise FlacError("frame ends early")
        x = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n)
        self.at += n
        return x & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.read(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


def _subframe(b: _Bits, n: int, bits: int) -> list[int]:
    if b.read(1):
        raise FlacError("bad subframe")
    kind, wasted = b.read(6), 0
    if b.read(1):
        wasted = b.unary() + 1
        bits -= wasted
    if kind == 0:
        out = [b.signed(bits)] * n
    elif kind == 1:
        out = [b.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(bits) for _ in range(order)]
        coef, shift = _FIXED[order] if kind < 32 else None, 0
        if kind >= 32:
            precision = b.read(4) + 1
            shift = b.signed(5)
            coef = [b.signed(precision) for _ in range(order)]
        method = b.read(2)
        if method > 1:
            raise FlacError("bad residual method")
        parts, width = 1 << b.read(4), 4 + method
        for p in range(parts):
            k = b.read(width)
            m = n // parts - (order if p == 0 else 0)
            if k == (1 << width) - 1:
                raw = b.read(5)
                rest = [b.signed(raw) for _ in range(m)]
            else:
                rest = []
                for _ in range(m):
                    u = b.unary() << k | b.read(k)
                    rest.append(u >> 1 ^ -(u & 1))
            for r in rest:
                out.append(r + (sum(c * out[-1 - i] for i, c in enumerate(coef)) >> shift))
    else:
        raise FlacError("unknown subframe")
    return [x << wasted for x in out]


def frame_header(media: bytes, at: int, info: dict) -> tuple[int, int, int, int, int]:
    """(bytes, samples, channel assignment, bits, first sample) of the frame header at a byte offset; its CRC-8 is verified."""
    if media[at : at + 1] != b"\xff" or at + 6 > len(media) or media[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should be")
    b = _Bits(media, at + 2)
    block, rate, channel, bits = b.read(4), b.read(4), b.read(4), b.read(3)
    b.read(1)
    lead = b.read(8)
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    number = lead if not more else lead & ((1 << (7 - more)) - 1)
    for _ in range(more - 1):
        number = number << 6 | b.read(8) & 0x3F
    n = b.read(8) + 1 if block == 6 else b.read(16) + 1 if block == 7 else 192 if block == 1 else 576 << (block - 2) if 2 <= block <= 5 else 256 << (block - 8)
    b.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
    end = b.at >> 3
    if crc8(media[at:end]) != media[end]:
        raise FlacError("frame header checksum differs")
    return end + 1 - at, n, channel, {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bits], number if media[at + 1] & 1 else number * info["block"]


def decode_frame(media: bytes, at: int, info: dict) -> tuple[list[list[int]], int, int]:
    """(samples of each channel, first sample, bytes) of the frame at a byte offset: any FLAC frame; both checksums are verified."""
    head, n, channel, bits, first = frame_header(media, at, info)
    b = _Bits(media, at + head)
    many = channel + 1 if channel < 8 else 2
    out = [_subframe(b, n, bits + (channel in (8, 10) and c == 1 or channel == 9 and c == 0)) for c in range(many)]
    if channel == 8:
        out[1] = [x - y for x, y in zip(*out, strict=True)]
    elif channel == 9:
        out[0] = [x + y for x, y in zip(*out, strict=True)]
    elif channel == 10:
        mid = [2 * m | s & 1 for m, s in zip(*out, strict=True)]
        out = [[(m + s) >> 1 for m, s in zip(mid, out[1], strict=True)], [(m - s) >> 1 for m, s in zip(mid, out[1], strict=True)]]
    end = (b.at + 7) >> 3
    if crc16(media[at:end]) != int.from_bytes(media[end : end + 2], "big"):
        raise FlacError("frame checksum differs")
    return out, first, end + 2 - at


def pcm(channels: list[list[int]], bits: int) -> bytes:
    """Samples interleaved, little-endian and signed, in whole bytes: what STREAMINFO's MD5 is of."""
    size = (bits + 7) // 8
    return b"".join(x.to_bytes(size, "little", signed=True) for row in zip(*channels, strict=True) for x in row)


def decode_any(media: bytes) -> list[dict]:
    """Blocks (sample_offset, byte_offset, n_samples, pcm) of any FLAC stream, sample by sample; the MD5 is verified where there is one."""
    info = stream_info(media)
    at, blocks, md5 = info["frames"], [], hashlib.md5()
    while at < len(media):
        channels, first, size = decode_frame(media, at, info)
        data = pcm(channels, info["bits"])
        md5.update(data)
        blocks.append({"sample_offset": first, "byte_offset": at, "n_samples": len(channels[0]), "pcm": data})
        at += size
    if any(info["md5"]) and md5.digest() != info["md5"]:
        raise FlacError("the stream's MD5 differs")
    return blocks


def decode_many(medias: list[bytes]) -> list[list[dict]]:
    """decode_any() of many streams. Frames that this module's writer makes (mono, 8 bits, fixed predictor of order 0 to 2, one Rice
    partition) and that the seek tables place are decoded together, a sample of every frame at a time; others one by one."""
    out: list = [None] * len(medias)
    jobs, infos = [], []
    for i, m in enumerate(medias):
        info = stream_info(m)
        infos.append(info)
        own = []
        if info["channels"] == 1 and info["bits"] == 8 and info["seek"]:
            for first, offset, n in info["seek"]:
                at = info["frames"] + offset
                head, count, channel, bits, number = frame_header(m, at, info)
                kind = m[at + head]
                order = (kind >> 1) - 8
                if (channel, bits, count, number) != (0, 8, n, first) or kind & 1 or order not in (0, 1, 2) or int.from_bytes(m[at + head + 1 + order : at + head + 3 + order], "big") >> 10:
                    own = []
                    break
                k = int.from_bytes(m[at + head + 1 + order : at + head + 3 + order], "big") >> 6 & 15
                if k == 15:
                    own = []
                    break
                own.append((i, at, head, count, order, k, first))
        if own and sum(j[3] for j in own) == info["samples"]:
            jobs += own
        else:
            out[i] = decode_any(m)
    if not jobs:
        return out
    jobs.sort(key=lambda j: -j[3])
    which, at, head, count, order, k, first = np.array(jobs, np.int64).T
    lengths = np.array([len(m) for m in medias])
    base = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join([*medias, bytes(16)]), np.uint8)
    window = np.zeros(len(flat) - 8, np.uint64)
    for b in range(8):
        window |= flat[b : b + len(window)].astype(np.uint64) << np.uint64(56 - 8 * b)
    start = base[which] + at
    p = (start + head + 1 + order) * 8 + 10
    limit = (base + lengths)[which] * 8
    grid = np.zeros((int(count[0]), len(jobs)), np.int32)
    for o in (1, 2):
        for j in range(o):
            own = np.flatnonzero(order == o)
            grid[j, own] = flat[(start + head + 1 + j)[own]].astype(np.int8)
    live = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), side="right")
    uk = k.astype(np.uint64)
    for t, n in enumerate(live.tolist()):
        if t < 2:  # warm-up samples stand in the grid already
            rows = np.flatnonzero(order[:n] <= t)
        else:
            rows = slice(0, n)
        q_p, kk = p[rows], uk[rows]
        if (q_p > limit[rows]).any():
            raise FlacError("frame ends early")
        w = window[q_p >> 3] << (q_p & 7).astype(np.uint64)
        q = _ZEROS[(w >> np.uint64(48)).astype(np.int64)]
        if q.max(initial=0) >= 16:  # long runs of zeros
            for z in np.flatnonzero(q >= 16).tolist():
                b = _Bits(flat.tobytes(), 0)
                b.at = int(q_p[z])
                q[z] = b.unary()
            a = q_p + q
            w = window[a >> 3] << (a & 7).astype(np.uint64)
            w <<= np.uint64(1)
        else:
            w <<= (q + 1).astype(np.uint64)
        low = ((w >> np.uint64(1)) >> (np.uint64(63) - kk)).astype(np.int64)
        u = (q << k[rows]) | low
        grid[t, rows] = (u >> 1) ^ -(u & 1)
        p[rows] = q_p + q + 1 + k[rows]
    end = (p + 7) >> 3
    crc = crc16_many(flat, start, end - start)
    if (crc != flat[end].astype(np.uint16) << 8 | flat[end + 1]).any():
        raise FlacError("frame checksum differs")
    two = order == 2
    if two.any():
        sub = grid[:, two]
        sub[1] -= sub[0]
        sub[1:] = np.cumsum(sub[1:], axis=0)
        grid[:, two] = sub
    some = order >= 1
    grid[:, some] = np.cumsum(grid[:, some], axis=0)
    data = np.ascontiguousarray(grid.T.astype(np.int8))
    for j in range(len(jobs)):
        i = int(which[j])
        out[i] = out[i] or []
        out[i].append({"sample_offset": int(first[j]), "byte_offset": int(at[j]), "n_samples": int(count[j]), "pcm": data[j, : int(count[j])].tobytes()})
    for i in {int(i) for i in which}:
        out[i].sort(key=lambda b: b["sample_offset"])
        if hashlib.md5(b"".join(b["pcm"] for b in out[i])).digest() != infos[i]["md5"]:
            raise FlacError("the stream's MD5 differs")
    return out


def seek(media: bytes, sample: int) -> dict:
    """The block that holds a sample, by the seek table: only its frame is decoded."""
    info = stream_info(media)
    at = info["frames"] + max((p for p in info["seek"] if p[0] <= sample), default=(0, 0, 0))[1]
    while at < len(media):
        channels, first, size = decode_frame(media, at, info)
        if first <= sample < first + len(channels[0]):
            return {"sample_offset": first, "byte_offset": at, "n_samples": len(channels[0]), "pcm": pcm(channels, info["bits"])}
        at += size
    raise FlacError("no such sample")


def payload(text: bytes | None) -> bytes:
    """A text's bytes with bytes 0 up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(-len(text) % 64 if text else 64)


def features(data: bytes) -> str:
    """Features of unsigned 8-bit samples: mean, deviation, mean step and share of crossings of the mean."""
    x = np.frombuffer(data, np.uint8).astype(np.float64)
    mean = x.mean()
    step = np.abs(np.diff(x))
    cross = np.mean((x[1:] > mean) != (x[:-1] > mean)) if len(x) > 1 else 0.0
    return f"mean={mean:.3f};dev={x.std():.3f};step={step.mean() if len(step) else 0:.3f};cross={cross:.4f}"


#: Bytes of texts and of streams that are coded at once: the arrays take some hundred times as much of a worker's memory.
_TEXTS, _STREAMS = 1 << 19, 1 << 20


def _slices(batch: pa.RecordBatch, column: str, most: int):
    """Parts of a batch whose values in a column have about `most` bytes together, a single longer value excepted."""
    start = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if k > start and size + n > most:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row's whole text (doc_id, text, any others) as a FLAC stream; a null text is an empty one.

    Repeated rows, and equal texts, give equal streams, a row each; other columns play no part; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "text", _TEXTS):
                texts = utf8(part, "text")
                media = encode_many([payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, sample_offset, byte_offset, n_samples, pcm) for each frame of each stream (doc_id, media); null media have none.

    Every frame's checksums and every stream's MD5 are verified; a stream that fails them fails the query.
    """

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "media", _STREAMS):
                data = part.column("media").to_pylist()
                have = [i for i, m in enumerate(data) if m is not None]
                got = decode_many([data[i] for i in have])
                rows = pa.array([i for i, blocks in zip(have, got, strict=True) for _ in blocks], pa.int64())
                flat = [b for blocks in got for b in blocks]
                cols = [pa.array([b[c] for b in flat], t) for c, t in (("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), *cols], ["doc_id", "sample_offset", "byte_offset", "n_samples", "pcm"])

    arrow_batches(media.sparkSession)
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, sample_offset long, byte_offset long, n_samples int, pcm binary")


def media_digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digests of the stored form and of what it decodes to, for each stream (doc_id, n_bytes, media)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "media", _STREAMS):
                stored = part.column("media").to_pylist()
                data = [(np.frombuffer(b"".join(b["pcm"] for b in blocks), np.uint8) ^ 0x80).tobytes() for blocks in decode_many(stored)]
                cols = [
                    pa.array([len(d) for d in data], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data]), pa.array([zlib.crc32(d[-64:]) for d in data], pa.int64()),
                    pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array([features(d) for d in data]),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *cols], names)

    arrow_batches(media.sparkSession)
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def stored_media(docs: DataFrame) -> DataFrame:
    """encode_media() as a table in the shared folder, read back: (doc_id, n_bytes, media).

    The table is about 1.3 times the documents' Parquet files: bytes of invented prose have little that a linear predictor finds.
    """
    return written(encode_media(docs), "media", compression="zstd")


def op3_media(spark, sf_dir):
    """Digests and features of every document, from the PCM blocks of its FLAC stream, which is stored and read back."""
    return media_digests(stored_media(documents(spark, sf_dir)))
