"""FLAC media: lossless 8-bit mono streams, written, verified and read as PCM blocks.

A payload byte is a sample (less 128). Packets hold ``BLOCK`` samples; each takes the
cheapest of fixed predictors and a quantised linear predictor, and Rice-coded residuals.
A seek table names every packet, so any block can be decoded alone. Reading checks the
CRC-8 of each header, the CRC-16 of each packet and the stream's MD5.

Packets are independent, so both directions work on many packets in step: one array
operation handles the same sample of every packet at hand. Packets of many documents, or
parts of a long one, go through in runs of ``RUN`` packets, which bounds memory.

Defined results
    null or empty text: a payload of 64 zero bytes; very long texts: stored whole;
    repeated rows and equal texts: equal media; a stream that fails a check raises
    ``ValueError``; an empty table: no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import TMP, bounded_batches

BLOCK = 1024
RUN = 1024
RATE = 8000
PAD = 64
PRECISION = 10
#: Fixed values of the format: coefficients of the fixed predictors, by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_FAR: list[np.ndarray] = [CRC16.astype(np.uint16)]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def _far(n: int) -> np.ndarray:
    """Row d: what a byte adds to the CRC-16 when d bytes follow it."""
    if len(_FAR[-1].shape) == 1 or len(_FAR[-1]) < n:
        rows = [CRC16]
        for _ in range(max(n, 2 * BLOCK) - 1):
            rows.append((rows[-1] << 8 & 0xFFFF) ^ CRC16[rows[-1] >> 8])
        _FAR.append(np.stack(rows).astype(np.uint16))
    return _FAR[-1]


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each non-empty slice [start, end) of the bytes; slices in order, apart.

    The checksum is linear: it is the exclusive or of what each byte adds on its own.
    """
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(first - starts, sizes)
    adds = _far(int(sizes.max()))[np.repeat(ends, sizes) - 1 - at, data[at]]
    return np.bitwise_xor.reduceat(adds, first)


def _number(n: int) -> bytes:
    """A packet number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(1, 7) if n < 1 << (6 * k + (6 - k)))
    tail = bytes([0x80 | n >> 6 * i & 0x3F for i in range(k - 1, -1, -1)])
    return bytes([(0xFF00 >> (k + 1)) & 0xFF | n >> 6 * k]) + tail


def _header(number: int, size: int) -> bytes:
    code = 10 if size == 1024 else 7
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0b0010]) + _number(number)
    head += struct.pack(">H", size - 1) if code == 7 else b""
    return head + bytes([crc8(head)])


def _predictors(s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised order-2 coefficients and shifts from the autocorrelation of each packet."""
    x = np.where(np.arange(s.shape[1]) < sizes[:, None], s, 0).astype(np.float64)
    r0, r1, r2 = (x * x).sum(1), (x[:, 1:] * x[:, :-1]).sum(1), (x[:, 2:] * x[:, :-2]).sum(1)
    det = np.where(r0 * r0 - r1 * r1 > 1e-6 * r0 * r0 + 1e-9, r0 * r0 - r1 * r1, np.inf)
    a = np.stack([(r0 * r1 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det], axis=1)
    top = 2 ** (PRECISION - 1) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(a).max(1), 2.0**-12))), 0, 15).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -top, top).astype(np.int64), shift


def _rice(residual: np.ndarray, order: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the Rice parameter and the bits for each packet."""
    inside = (np.arange(residual.shape[1]) >= order) & (np.arange(residual.shape[1]) < sizes[:, None])
    u = np.where(inside, residual << 1 ^ residual >> 63, 0)
    n = sizes - order
    low = np.clip(np.floor(np.log2(np.maximum(u.sum(1) / n * 0.69, 1.0))), 0, 13).astype(np.int64)
    cost = [(k + 1) * n + (u >> k[:, None]).sum(1) for k in (low, low + 1)]
    return u, np.where(cost[1] < cost[0], low + 1, low), np.minimum(*cost)


def encode_packets(blocks: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """Packets of the sample blocks (int8, at least 64 samples each)."""
    sizes = np.array([len(b) for b in blocks])
    s = np.zeros((len(blocks), int(sizes.max())), np.int64)
    for i, b in enumerate(blocks):
        s[i, : len(b)] = b
    coefs, shift = _predictors(s, sizes)
    lagged = lambda k: np.pad(s[:, :-k], ((0, 0), (k, 0)))
    residuals = {0: s, 1: s - lagged(1), 2: s - 2 * lagged(1) + lagged(2)}
    residuals[3] = s - ((coefs[:, :1] * lagged(1) + coefs[:, 1:] * lagged(2)) >> shift[:, None])  # 3: linear
    order = {0: 0, 1: 1, 2: 2, 3: 2}
    rice = {c: _rice(r, order[c], sizes) for c, r in residuals.items()}
    extra = {0: 0, 1: 8, 2: 16, 3: 16 + 9 + 2 * PRECISION}
    choice = np.argmin(np.stack([rice[c][2] + extra[c] for c in range(4)]), axis=0)
    heads = [_header(n, int(z)) for n, z in zip(numbers, sizes, strict=True)]
    head_bits = np.array([8 * len(h) for h in heads])
    # header, subpacket header, what the predictor needs, method and partition order, parameter
    lead = head_bits + 8 + np.array([extra[c] for c in range(4)])[choice] + 2 + 4 + 4
    total = lead + np.stack([rice[c][2] for c in range(4)])[choice, np.arange(len(blocks))]
    size_bytes = -(-total // 8)
    first = np.cumsum(size_bytes + 2) - size_bytes - 2
    bits = np.zeros(8 * int((size_bytes + 2).sum()), np.uint8)

    def put(at: np.ndarray, values: np.ndarray, n: int) -> None:
        for b in range(n):
            bits[at + b] = values >> (n - 1 - b) & 1

    for c in range(4):
        f = np.flatnonzero(choice == c)
        if not len(f):
            continue
        u, k, _ = (x[f] for x in rice[c])
        at = 8 * first[f] + head_bits[f]
        put(at, np.full(len(f), (0b001000 | c) << 1 if c < 3 else 0b100001 << 1), 8)
        at = at + 8
        for w in range(order[c]):
            put(at, s[f, w] & 0xFF, 8)
            at = at + 8
        if c == 3:
            put(at, np.full(len(f), PRECISION - 1), 4)
            put(at + 4, shift[f], 5)
            for w in range(2):
                put(at + 9 + w * PRECISION, coefs[f, w] & ((1 << PRECISION) - 1), PRECISION)
            at = at + 9 + 2 * PRECISION
        put(at, np.zeros(len(f), np.int64), 6)
        put(at + 6, k, 4)
        at = at + 10
        for kk in np.unique(k).tolist():
            g = np.flatnonzero(k == kk)
            inside = (np.arange(u.shape[1]) >= order[c]) & (np.arange(u.shape[1]) < sizes[f[g]][:, None])
            q = u[g] >> kk
            wide = np.where(inside, q + 1 + kk, 0)
            place = (at[g][:, None] + np.cumsum(wide, axis=1) - wide + q)[inside]
            bits[place] = 1
            put(place + 1, u[g][inside], kk)
    data = np.packbits(bits)
    for i, h in enumerate(heads):
        data[first[i] : first[i] + len(h)] = np.frombuffer(h, np.uint8)
    sums = crc16(data, first, first + size_bytes)
    data[first + size_bytes], data[first + size_bytes + 1] = sums >> 8, sums & 0xFF
    raw = data.tobytes()
    return [raw[a : a + n + 2] for a, n in zip(first.tolist(), size_bytes.tolist(), strict=True)]


def container(payload: bytes, packets: list[bytes]) -> bytes:
    """Marker, stream information and seek table, then the packets."""
    samples = (np.frombuffer(payload, np.uint8).astype(np.int16) - 128).astype(np.int8)
    n, sizes = len(payload), [len(f) for f in packets]
    info = struct.pack(">HH", min(BLOCK, n), min(BLOCK, n)) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    at, points = 0, []
    for i, f in enumerate(packets):
        points.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, n - i * BLOCK)))
        at += len(f)
    # a metadata block holds under 2^24 bytes: longer seek tables take several
    per = (1 << 24) // 18 - 1
    tables = [b"".join(points[i : i + per]) for i in range(0, len(points), per)]
    head = b"fLaC\x00" + len(info).to_bytes(3, "big") + info
    for i, t in enumerate(tables):
        head += bytes([0x83 if i == len(tables) - 1 else 0x03]) + len(t).to_bytes(3, "big") + t
    return head + b"".join(packets)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload."""
    blocks, numbers, owner = [], [], []
    packets: list[list[bytes]] = [[] for _ in payloads]

    def flush() -> None:
        for o, f in zip(owner, encode_packets(blocks, numbers) if blocks else [], strict=True):
            packets[o].append(f)
        blocks.clear(), numbers.clear(), owner.clear()

    for o, p in enumerate(payloads):
        samples = (np.frombuffer(p, np.uint8).astype(np.int16) - 128).astype(np.int8)
        for i in range(0, len(samples), BLOCK):
            blocks.append(samples[i : i + BLOCK])
            numbers.append(i // BLOCK)
            owner.append(o)
            if len(blocks) == RUN:
                flush()
    flush()
    return [container(p, f) for p, f in zip(payloads, packets, strict=True)]


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int, signed: bool = False) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("FLAC: the packet ends early")
        x = self.value >> self.left & ((1 << n) - 1)
        return x - (1 << n) if signed and n and x >> (n - 1) else x


def stream_info(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """(samples, MD5, seek points, where packets begin)."""
    if media[:4] != b"fLaC":
        raise ValueError("FLAC: no marker")
    at, last, n, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = bool(media[at] >> 7), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            n, md5 = word & ((1 << 36) - 1), body[18:34]
            if (word >> 41 & 7, word >> 36 & 31) != (0, 7):
                raise ValueError("FLAC: only 8-bit mono is read")
        elif kind == 3:
            points += [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
        at += 4 + size
    return n, md5, points, at


def _subpacket(packet: bytes) -> dict:
    """What stands before the residuals of a packet; the header's checksum is verified."""
    if packet[0] != 0xFF or packet[1] & 0xFE != 0xF8:
        raise ValueError("FLAC: a packet does not begin where the seek table says")
    at = 4
    lead = packet[at]
    at += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    code, rate = packet[2] >> 4, packet[2] & 15
    if code in (6, 7):
        size = int.from_bytes(packet[at : at + code - 5], "big") + 1
        at += code - 5
    else:
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    at += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    if crc8(packet[:at]) != packet[at]:
        raise ValueError("FLAC: wrong checksum of a packet header")
    at += 1
    kind, wasted = packet[at] >> 1 & 63, packet[at] & 1
    if wasted:
        raise ValueError("FLAC: wasted bits are not read")
    out = {"size": size, "at": 8 * (at + 1), "order": 0, "coefs": (), "shift": 0, "warm": (), "plain": None}
    if kind < 2:
        n = 1 if kind == 0 else size
        values = np.frombuffer(packet[at + 1 : at + 1 + n], np.int8)
        return out | {"plain": np.full(size, values[0], np.int8) if kind == 0 else values}
    order = kind & 7 if kind < 16 else (kind & 31) + 1
    b = _Bits(packet[at + 1 : at + 1 + order + (2 + 2 * order + 1 if kind >= 32 else 0) + 4])
    start = b.left
    warm = [b.take(8, True) for _ in range(order)]
    coefs, shift = FIXED[order] if kind < 16 else (), 0
    if kind >= 32:
        precision, shift = b.take(4) + 1, b.take(5, True)
        coefs = [b.take(precision, True) for _ in range(order)]
    method, parts = b.take(2), b.take(4)
    return out | {"at": 8 * (at + 1) + start - b.left, "order": order, "coefs": coefs, "shift": shift, "warm": warm, "method": method, "parts": parts}


def _residuals_alone(packet: bytes, sub: dict) -> np.ndarray:
    """Residuals of one packet, bit by bit; knows escaped partitions."""
    b = _Bits(packet)
    b.take(sub["at"])
    out, wide = [], 4 + sub["method"]
    for part in range(1 << sub["parts"]):
        k = b.take(wide)
        n = (sub["size"] >> sub["parts"]) - (sub["order"] if part == 0 else 0)
        if k == (1 << wide) - 1:
            raw = b.take(5)
            out += [b.take(raw, True) for _ in range(n)]
            continue
        for _ in range(n):
            q = 0
            while not b.take(1):
                q += 1
            u = q << k | b.take(k)
            out.append(u >> 1 ^ -(u & 1))
    return np.array(out, np.int64)


def _residuals(packets: list[bytes], subs: list[dict]) -> list[np.ndarray]:
    """Residuals of packets in step. Packets stand in order of falling count, so those still
    running are always the first ones."""
    counts = np.array([s["size"] - s["order"] for s in subs])
    rank = np.argsort(-counts, kind="stable")
    data = np.frombuffer(b"".join(packets) + bytes(8), np.uint8)
    starts = np.cumsum([0] + [len(f) for f in packets[:-1]])
    bits = np.unpackbits(data)
    # the place of the next 1 at or after each bit
    nxt = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    d = data.astype(np.uint32)
    window = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
    pos = (8 * starts + np.array([s["at"] for s in subs]))[rank]
    wide = np.array([4 + s["method"] for s in subs])[rank]
    each = np.array([s["size"] >> s["parts"] for s in subs])[rank]
    order = np.array([s["order"] for s in subs])[rank]
    borders = {0} | {int(x) for s in subs for x in range((s["size"] >> s["parts"]) - s["order"], s["size"] - s["order"], s["size"] >> s["parts"])}
    running = np.searchsorted(-counts[rank], -np.arange(int(counts.max())), side="left")
    k = np.zeros(len(subs), np.int64)
    out = np.zeros((int(counts.max()), len(subs)), np.int32)
    escaped = np.zeros(len(subs), bool)

    def read(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = np.minimum(p, len(bits) - 40)  # packets with escapes run astray; they are read again alone
        return window[p >> 3].astype(np.int64) >> (32 - (p & 7) - n) & ((1 << n) - 1)

    for j, a in enumerate(running.tolist()):
        p = pos[:a]
        if j in borders:
            new = np.flatnonzero((j == 0) | ((j + order[:a]) % each[:a] == 0))
            k[new] = read(p[new], wide[new])
            escaped[new] |= k[new] == (1 << wide[new]) - 1
            p[new] += wide[new]
        one = nxt[np.minimum(p, len(nxt) - 1)]
        kk = k[:a]
        u = (one - p) << kk
        p = one + 1
        u |= read(p, kk)
        out[j, :a] = u >> 1 ^ -(u & 1)
        pos[:a] = p + kk
    found: list[np.ndarray] = [np.empty(0)] * len(subs)
    for col, i in enumerate(rank.tolist()):
        if escaped[col]:
            found[i] = _residuals_alone(packets[i], subs[i])
        elif pos[col] > 8 * (starts[i] + len(packets[i])):
            raise ValueError("FLAC: the residuals overrun their packet")
        else:
            found[i] = out[: counts[i], col]
    return found


def decode_packets(packets: list[bytes]) -> list[np.ndarray]:
    """Samples (int8) of whole packets; every checksum is verified."""
    data = np.frombuffer(b"".join(packets), np.uint8)
    ends = np.cumsum([len(f) for f in packets])
    starts = ends - [len(f) for f in packets]
    sums = crc16(data, starts, ends - 2)
    if (sums != (data[ends - 2].astype(np.uint16) << 8 | data[ends - 1])).any():
        raise ValueError("FLAC: wrong checksum of a packet")
    subs = [_subpacket(f) for f in packets]
    out: list[np.ndarray] = [s["plain"] for s in subs]
    coded = [i for i, s in enumerate(subs) if s["plain"] is None]
    if not coded:
        return out
    residuals = dict(zip(coded, _residuals([packets[i] for i in coded], [subs[i] for i in coded]), strict=True))
    groups: dict[tuple[int, int], list[int]] = {}
    for i in coded:
        groups.setdefault((subs[i]["order"], subs[i]["size"]), []).append(i)
    for (order, size), own in groups.items():
        x = np.zeros((size, len(own)), np.int64)
        x[order:] = np.stack([residuals[i] for i in own], axis=1)
        if order:
            x[:order] = np.array([subs[i]["warm"] for i in own]).T
            coefs = np.array([subs[i]["coefs"] for i in own], np.int64).T[::-1]
            shift = np.array([subs[i]["shift"] for i in own])
            for n in range(order, size):
                x[n] += (coefs * x[n - order : n]).sum(axis=0) >> shift
        if x.min() < -128 or x.max() > 127:
            raise ValueError("FLAC: a sample is out of range")
        for col, i in enumerate(own):
            out[i] = x[:, col].astype(np.int8)
    return out


def packets_of(media: bytes) -> tuple[list[int], list[bytes], bytes]:
    """(sample offsets, packets, MD5) by the seek table, which has to name every packet."""
    n, md5, points, begin = stream_info(media)
    if sum(p[2] for p in points) != n or [p[0] for p in points] != list(np.cumsum([0, *[p[2] for p in points[:-1]]])):
        raise ValueError("FLAC: the seek table does not name every packet")
    at = [begin + p[1] for p in points] + [len(media)]
    return [p[0] for p in points], [media[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], md5


def decode(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks: (sample offset, unsigned 8-bit samples)."""
    out: list[list[tuple[int, bytes]]] = [[] for _ in media]
    sums = [hashlib.md5() for _ in media]
    md5s: list[bytes] = []
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        for (o, at, _), x in zip(held, decode_packets([f for _, _, f in held]), strict=True):
            sums[o].update(x.tobytes())
            out[o].append((at, (x.astype(np.int16) + 128).astype(np.uint8).tobytes()))
        held.clear()

    for o, m in enumerate(media):
        offsets, packets, md5 = packets_of(m)
        md5s.append(md5)
        for at, f in zip(offsets, packets, strict=True):
            held.append((o, at, f))
            if len(held) == RUN:
                flush()
    flush()
    if any(s.digest() != m for s, m in zip(sums, md5s, strict=True)):
        raise ValueError("FLAC: wrong MD5 of a stream")
    return out


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text padded to a positive multiple of ``PAD`` bytes)."""
    b = (text or "").encode()
    return len(b), b + bytes(-len(b) % PAD if b else PAD)


def feature(blocks: list[tuple[int, bytes]]) -> str:
    """Blocks, mean level, energy and sign changes of the signal read back."""
    x = np.frombuffer(b"".join(b for _, b in blocks), np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={len(blocks)};level={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};changes={changes}"


def encode_column(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_bytes`` and ``media``, a FLAC stream of each text."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n_bytes long, media binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        given = [payload(t) for t in texts]
        return pd.DataFrame({"n_bytes": [n for n, _ in given], "media": encode([p for _, p in given])})

    m = f"{TMP}media"
    return df.withColumn(m, run(F.col(text_col))).withColumns({"n_bytes": F.col(f"{m}.n_bytes"), "media": F.col(f"{m}.media")}).drop(m)


def pcm_blocks(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep, block, sample_offset, n_samples, pcm`` of every packet of ``media``; the
    offset is where to seek."""
    bounded_batches(media.sparkSession)

    @F.pandas_udf("array<struct<block:int,sample_offset:long,n_samples:int,pcm:binary>>")
    def run(column: pd.Series) -> pd.Series:
        rows = decode([bytes(m) for m in column])
        return pd.Series([[{"block": i, "sample_offset": at, "n_samples": len(p), "pcm": p} for i, (at, p) in enumerate(r)] for r in rows])

    return media.select(*keep, F.explode(run(F.col("media"))).alias(f"{TMP}b")).select(*keep, f"{TMP}b.*")


def media_digests(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and digests of each text's stream and of what is read back from it."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def run(media: pd.Series) -> pd.DataFrame:
        streams = [bytes(m) for m in media]
        rows = []
        for m, blocks in zip(streams, decode(streams), strict=True):
            back = b"".join(b for _, b in blocks)
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(blocks)))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    df = encode_column(docs.select(*keep, F.col(text_col).alias(f"{TMP}t")), f"{TMP}t")
    return df.select(*keep, "n_bytes", run(F.col("media")).alias(f"{TMP}r")).select(*keep, "n_bytes", f"{TMP}r.*")
