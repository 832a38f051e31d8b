import hashlib
import zlib

import numpy as np
import pytest

from groundsearch.llm import media as M


class Writer:
    """Bits to bytes, for hand-made frames."""

    def __init__(self):
        self.bits = ""

    def put(self, x, n):
        self.bits += format(x & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def done(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def rice(w, values, k):
    for r in values:
        u = 2 * r if r >= 0 else -2 * r - 1
        w.put(1, (u >> k) + 1).put(u, k)


def frame(number, n, channel, size_code, subframes, variable=False):
    h = b"\xff" + bytes([0xF9 if variable else 0xF8]) + bytes([7 << 4, channel << 4 | size_code << 1]) + M._coded_number(number) + (n - 1).to_bytes(2, "big")
    w = Writer()
    for s in subframes:
        s(w)
    body = h + bytes([M.crc8(h)]) + w.done()
    return body + M.crc16(body).to_bytes(2, "big")


def stream(frames, channels, bits, total, data, block=192):
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | total).to_bytes(8, "big") + hashlib.md5(data).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def test_lpc_partitions_escape_stereo_and_wasted_bits():
    rng = np.random.default_rng(1)
    n = 64
    left = np.cumsum(rng.integers(-9, 10, n)).tolist()
    coef, shift = [13, -5], 3

    def lpc(w):
        w.put(0b0_100001_0, 8)
        for x in left[:2]:
            w.put(x, 16)
        w.put(5, 4).put(shift, 5)
        for c in coef:
            w.put(c, 6)
        res = [left[i] - ((coef[0] * left[i - 1] + coef[1] * left[i - 2]) >> shift) for i in range(2, n)]
        w.put(1, 2).put(2, 4)  # 5-bit parameters, four partitions
        at = 0
        for p in range(4):
            m = n // 4 - (2 if p == 0 else 0)
            part = res[at : at + m]
            at += m
            if p == 1:
                w.put(31, 5).put(12, 5)
                for r in part:
                    w.put(r, 12)
            else:
                w.put(3 + p, 5)
                rice(w, part, 3 + p)

    side = [int(x) for x in rng.integers(-50, 50, n) * 4]

    def wasted(w):  # verbatim, two wasted bits, 17 bits wide
        w.put(0b0_000001_1, 8).put(1, 2)
        for x in side:
            w.put(x >> 2, 15)

    right = [a - b for a, b in zip(left, side, strict=True)]
    data = M.pcm([left, right], 16)
    second = M.pcm([[7] * n, [-3] * n], 16)
    const = [lambda w: w.put(0, 8).put(7, 16), lambda w: w.put(0, 8).put(-3, 16)]
    s = stream([frame(0, n, 8, 4, [lpc, wasted], True), frame(n, n, 1, 0, const, True)], 2, 16, 2 * n, data + second)
    blocks = M.decode_any(s)
    assert b"".join(b["pcm"] for b in blocks) == data + second and [b["sample_offset"] for b in blocks] == [0, n]
    assert M.decode_many([s]) == [blocks]


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4])
def test_fixed_predictors_and_mid_side(order):
    rng = np.random.default_rng(order)
    n = 48
    mid, side = (np.cumsum(rng.integers(-5, 6, n)).tolist() for _ in range(2))

    def fixed(x, bits):
        def put(w):
            w.put((8 + order) << 1, 8)
            for v in x[:order]:
                w.put(v, bits)
            w.put(0, 2).put(0, 4).put(2, 4)
            c = M._FIXED[order]
            rice(w, [x[i] - sum(a * x[i - 1 - j] for j, a in enumerate(c)) for i in range(order, n)], 2)

        return put

    left = [((2 * m | s & 1) + s) >> 1 for m, s in zip(mid, side, strict=True)]
    right = [((2 * m | s & 1) - s) >> 1 for m, s in zip(mid, side, strict=True)]
    data = M.pcm([left, right], 16)
    s = stream([frame(0, n, 10, 4, [fixed(mid, 16), fixed(side, 17)])], 2, 16, n, data)
    assert M.decode_any(s)[0]["pcm"] == data


def test_round_trip_seek_and_checksums():
    rng = np.random.default_rng(3)
    payloads = [bytes(64), b"a" * 64, bytes(rng.integers(0, 256, 4096 * 3 + 64, np.uint8)), ("der Satz ê " * 3000).encode()[:32000], b"\x00\xff" * 4096, bytes(range(256)) * 16, bytes([0] * 63 + [255])]
    media = M.encode_many(payloads)
    assert media == [M.encode(p) for p in payloads]
    both = M.decode_many(media)
    for p, m, blocks in zip(payloads, media, both, strict=True):
        assert (np.frombuffer(b"".join(b["pcm"] for b in blocks), np.uint8) ^ 0x80).tobytes() == p
        assert M.decode_any(m) == blocks
        for sample in (0, len(p) // 2, len(p) - 1):
            b = M.seek(m, sample)
            assert b in blocks and b["sample_offset"] <= sample < b["sample_offset"] + b["n_samples"]
    assert len(media[0]) < 64 * 2 and len(media[1]) < 150
    for at in (len(media[3]) - 40, len(media[3]) // 2, 60 + 18 * 8 + 3):
        broken = bytearray(media[3])
        broken[at] ^= 4
        with pytest.raises(M.FlacError):
            M.decode_many([bytes(broken)])
        with pytest.raises(M.FlacError):
            M.decode_any(bytes(broken))
    assert M.crc16(b"123456789") == 0xFEE8 and M.crc8(b"123456789") == 0xF4


def test_query_round_trip(spark, sf):
    docs = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = M.op3_media(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        p = M.payload(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 100000, "y"), (4, "same", None), (4, "same", None), (None, "a\x00b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    media = M.encode_media(df)
    got = M.media_digests(media).collect()
    assert len(got) == 6 and {r.payload_bytes for r in got} == {64, 200000}
    blocks = M.pcm_blocks(media).where("doc_id = 3").collect()
    assert sorted(b.sample_offset for b in blocks) == list(range(0, 200000, M.FRAME))
    assert M.pcm_blocks(media.limit(0)).count() == 0 == M.media_digests(M.encode_media(df.limit(0))).count()
    two = [r for r in got if r.doc_id == 4]
    assert two[0] == two[1]
