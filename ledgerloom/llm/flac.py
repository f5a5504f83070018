"""FLAC media columns: store byte payloads losslessly, read them back with every checksum verified.

``encode`` writes one FLAC stream (8 bit, mono) for each value: fixed-size frames,
the cheapest of constant, verbatim, fixed (orders 0 to 2) and linear (order 2)
predictors, Rice-coded residuals, and a seek point for every frame. ``decode`` reads
any FLAC stream of up to 8 channels and 24 bits: it finds the frames by the seek
table or by sync codes with valid header checksums, decodes many frames in step
(one numpy operation handles one sample of every frame), undoes the predictors and
the channel decorrelation, and verifies header CRC-8, frame CRC-16 and the MD5 of the
samples. Samples come back as little-endian PCM (8 bit: unsigned, as in WAV).

Frames are encoded and decoded in runs of up to ``RUN``, also within one stream, so a very long value needs a few
copies of its bytes and no more. ``digests`` does both in one Python pass.

Null values are stored as empty payloads; a null, damaged or foreign stream decodes
to null samples and a text in ``error``. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, ragged, slices

#: Samples in a frame, sample rate, bytes handled at once, padding unit of payloads.
BLOCK, RATE, SLICE_BYTES, UNIT = 1024, 8000, 2 << 20, 64
#: Frames handled at once.
RUN = 4096
#: Fixed values of the format: predictor coefficients by order, bits a sample by code, block sizes by code.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
LPC_SHIFT, LPC_PRECISION = 8, 11


def crc_table(polynomial: int, bits: int) -> np.ndarray:
    """Byte-wise table of a most-significant-bit-first CRC."""
    value = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        value = np.where(value >> (bits - 1) & 1, value << 1 ^ polynomial, value << 1) & ((1 << bits) - 1)
    return value


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crc_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each piece of ``data``, all pieces advanced by one byte a step."""
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    order = np.argsort(-lengths, kind="stable")
    at, size, crc = starts[order], lengths[order], np.zeros(len(starts), np.int64)
    alive = len(starts) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    for step in range(int(size[0])):
        n = alive[step]
        byte = data[at[:n] + step]
        crc[:n] = CRC8[crc[:n] ^ byte] if bits == 8 else (crc[:n] << 8 & 0xFFFF) ^ CRC16[crc[:n] >> 8 ^ byte]
    out[order] = crc
    return out


def number_bytes(n: int) -> bytes:
    """A frame number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF << (8 - size) & 0xFF) | n >> (6 * (size - 1))
    return bytes([lead, *(0x80 | n >> (6 * k) & 0x3F for k in range(size - 2, -1, -1))])


def frame_header(number: int, samples: int) -> bytes:
    """Header of one frame without its CRC-8: fixed block size, 8 kHz, mono, 8 bits a sample."""
    code = 10 if samples == 1024 else 7
    tail = b"" if code == 10 else struct.pack(">H", samples - 1)
    return bytes([0xFF, 0xF8, code << 4 | 4, 1 << 1]) + number_bytes(number) + tail


def put_bits(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = values >> (width - 1 - j) & 1


def encode_frames(data: np.ndarray, number: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames with these numbers and sizes, one after the other, of the 8-bit samples ``data``; and the bytes of each."""
    count = len(n)
    column = np.arange(BLOCK)
    inside = column[None, :] < n[:, None]
    s = np.zeros((count, BLOCK), np.int32)
    s[inside] = data.astype(np.int32) - 128

    constant = ((s == s[:, :1]) | ~inside).all(axis=1)
    best = np.where(constant, 16, 8 * n + 8).astype(np.int64)
    kind, rice = np.where(constant, -2, -1), np.zeros(count, np.int64)
    residual = s
    r0 = np.einsum("ij,ij->i", s, s, dtype=np.float64)
    r1 = np.einsum("ij,ij->i", s[:, 1:], s[:, :-1], dtype=np.float64)
    r2 = np.einsum("ij,ij->i", s[:, 2:], s[:, :-2], dtype=np.float64)
    gap = np.maximum(r0 * r0 - r1 * r1, 1.0)
    limit = (1 << LPC_PRECISION - 1) - 1
    a = np.stack([r1 * (r0 - r2) / gap, (r0 * r2 - r1 * r1) / gap])
    a = np.clip(np.rint(a * (1 << LPC_SHIFT)), -limit, limit).astype(np.int32)
    kept = np.zeros((count, BLOCK), np.int32)
    for choice in range(4):  # 0 to 2: fixed of that order; 3: linear of order 2
        order = min(choice, 2)
        if choice == 0:
            residual = s
        elif choice < 3:
            residual = np.concatenate([residual[:, :1], np.diff(residual, axis=1)], axis=1)
        else:
            residual = s.copy()
            residual[:, 2:] -= (a[0][:, None] * s[:, 1:-1] + a[1][:, None] * s[:, :-2]) >> LPC_SHIFT
        zigzag = (residual << 1) ^ (residual >> 31)
        zigzag[:, :order] = 0
        zigzag[~inside] = 0
        codes = np.maximum(n - order, 0)
        total = zigzag.sum(axis=1, dtype=np.int64)
        k = np.clip(np.floor(np.log2(np.maximum(total / np.maximum(codes, 1), 1))), 0, 14).astype(np.int64)
        cost = 18 + 8 * order + codes * (1 + k) + (zigzag >> k[:, None]).sum(axis=1) + (9 + 2 * LPC_PRECISION) * (choice == 3)
        better = (cost < best) & (n > order)
        best[better], kind[better], rice[better] = cost[better], choice, k[better]
        kept[better] = zigzag[better]

    headers = [frame_header(i, m) for i, m in zip(number.tolist(), n.tolist(), strict=True)]
    head = np.array([len(h) for h in headers], np.int64)
    heads = np.frombuffer(b"".join(headers), np.uint8)
    head_at = np.cumsum(head) - head
    length = head + 1 + (best + 7) // 8 + 2
    start = np.cumsum(length) - length
    bits = np.zeros(int(length.sum()) * 8, np.uint8)
    body = (start + head + 1) * 8
    order = np.where(kind == 3, 2, np.maximum(kind, 0))
    label = np.select([kind == -2, kind == -1, kind == 3], [0, 1, 33], 8 + kind)
    put_bits(bits, body, label << 1, 8)
    at = body + 8
    single = np.flatnonzero(kind == -2)
    put_bits(bits, at[single], s[single, 0], 8)
    raw = np.flatnonzero(kind == -1)
    if raw.size:
        put_bits(bits, ragged(at[raw] // 8, n[raw]) * 8, s[raw][inside[raw]], 8)
    for j in range(2):
        warm = np.flatnonzero(order > j)
        put_bits(bits, at[warm] + 8 * j, s[warm, j], 8)
    at = at + 8 * order
    linear = np.flatnonzero(kind == 3)
    put_bits(bits, at[linear], np.full(len(linear), LPC_PRECISION - 1), 4)
    put_bits(bits, at[linear] + 4, np.full(len(linear), LPC_SHIFT), 5)
    for j in range(2):
        put_bits(bits, at[linear] + 9 + LPC_PRECISION * j, a[j][linear], LPC_PRECISION)
    at = at + np.where(kind == 3, 9 + 2 * LPC_PRECISION, 0)
    coded = np.flatnonzero(kind >= 0)
    put_bits(bits, at[coded], rice[coded], 10)  # method 0, partition order 0, four bits of the parameter
    here = inside[coded] & (column[None, :] >= order[coded][:, None])
    zz = kept[coded][here].astype(np.int64)
    per = here.sum(axis=1)
    k = np.repeat(rice[coded], per)
    sizes_of = (zz >> k) + 1 + k
    ends = np.cumsum(sizes_of)
    before = np.concatenate([[0], ends])[np.cumsum(per) - per]
    stop = np.repeat(at[coded] + 10 - before, per) + ends - sizes_of + (zz >> k)
    bits[stop] = 1
    for j in range(int(k.max(initial=0))):
        some = k > j
        if some.all():
            bits[stop + 1 + j] = zz >> (k - 1 - j) & 1
        else:
            bits[stop[some] + 1 + j] = zz[some] >> (k[some] - 1 - j) & 1
    out = np.packbits(bits)
    out[ragged(start, head)] = heads
    out[start + head] = crc_of(heads, head_at, head, 8)
    crc = crc_of(out, start, length - 2, 16)
    out[start + length - 2], out[start + length - 1] = crc >> 8, crc & 0xFF

    return out.tobytes(), length


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload; a payload has at least one byte."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    data = np.frombuffer(payloads[0] if len(payloads) == 1 else b"".join(payloads), np.uint8)
    frames_of = -(-sizes // BLOCK)
    number = ragged(np.zeros(len(payloads), np.int64), frames_of)
    n = np.minimum(BLOCK, np.repeat(sizes, frames_of) - number * BLOCK)
    ends = np.cumsum(n)
    runs = [encode_frames(data[ends[lo] - n[lo] : ends[min(lo + RUN, len(n)) - 1]], number[lo : lo + RUN], n[lo : lo + RUN]) for lo in range(0, len(n), RUN)]
    raw_frames, length = b"".join(r for r, _ in runs), np.concatenate([k for _, k in runs])
    del runs
    start = np.cumsum(length) - length
    streams = []
    bounds = np.concatenate([[0], np.cumsum(frames_of)])
    byte = 0
    for d, size in enumerate(sizes.tolist()):
        lo, hi = int(bounds[d]), int(bounds[d + 1])
        begin, stop_at = int(start[lo]), int(start[hi - 1] + length[hi - 1])
        info = struct.pack(">HH", BLOCK, BLOCK) + int(length[lo:hi].min()).to_bytes(3, "big") + int(length[lo:hi].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | size).to_bytes(8, "big") + hashlib.md5((data[byte : byte + size] ^ 0x80).tobytes(), usedforsecurity=False).digest()
        points = np.zeros(hi - lo, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = number[lo:hi] * BLOCK, start[lo:hi] - begin, n[lo:hi]
        # a seek table holds as many points as its 24-bit size allows: a longer stream gets one for every second, third, ... frame
        points = points[:: 1 + len(points) * 18 // (1 << 24)]
        seek = points.tobytes()
        streams.append(b"fLaC\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw_frames[begin:stop_at])
        byte += size
    return streams


class Damaged(ValueError):
    pass


def stream_frames(data: bytes) -> tuple[dict, int, np.ndarray]:
    """Stream information, where the frames begin, and the offset of each frame from there."""
    if data[:4] != b"fLaC":
        raise Damaged("not a FLAC stream")
    at, info, points = 4, None, None
    while True:
        if at + 4 > len(data):
            raise Damaged("metadata is cut off")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if len(block) < size:
            raise Damaged("metadata is cut off")
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34], "block": int.from_bytes(block[:2], "big")}
        elif kind == 3:
            points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        at += 4 + size
        if last:
            break
    if info is None:
        raise Damaged("no stream information")
    if points is not None and len(points) and info["samples"] and int(points["n"].astype(np.int64).sum()) == info["samples"]:
        offsets = points["offset"].astype(np.int64)
        if offsets[0] == 0 and (np.diff(offsets) > 0).all() and offsets[-1] < len(data) - at:
            return info, at, offsets
    return info, at, scan_frames(np.frombuffer(data, np.uint8)[at:])


def scan_frames(data: np.ndarray) -> np.ndarray:
    """Frame offsets without a seek table: sync codes with a valid header CRC whose frame up to there has a valid CRC-16."""
    found = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] & 0xFE == 0xF8)) if len(data) > 1 else np.zeros(0, np.int64)
    marks = []
    for at in found.tolist():
        head = data[at : at + 16].tolist()
        size = header_size(head)
        if size and size < len(head) and int(crc_of(data, np.array([at]), np.array([size]), 8)[0]) == head[size]:
            marks.append(at)
    out: list[int] = []
    for at in marks:  # a mark counts if what lies between the last frame and it is whole
        if not out or crc_of(data, np.array([out[-1]]), np.array([at - out[-1]]), 16)[0] == 0:
            out.append(at)
    return np.array(out, np.int64)


def header_size(head: list[int]) -> int:
    """Bytes of a frame header before its CRC-8; 0 if it can't be one."""
    if len(head) < 6:
        return 0
    lead = head[4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    size, rate = head[2] >> 4, head[2] & 15
    return 5 + more + (size == 6) + 2 * (size == 7) + (rate == 12) + 2 * (rate in (13, 14))


class Bits:
    """Random access to the bits of a buffer for many readers at once."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * j)
        flags = np.unpackbits(data)
        self.ones = np.concatenate([np.flatnonzero(flags), [len(flags)]])
        self.rank = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned values of ``width`` (up to 56) bits."""
        width = np.asarray(width, np.int64)
        at = np.minimum(at, (len(self.words) - 1) * 8)
        shift = (64 - (at & 7) - width).clip(0, 63).astype(np.uint64)
        return (self.words[at >> 3] >> shift).astype(np.int64) & ((np.int64(1) << width) - 1)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value = self.take(at, width)
        return value - ((value >> (np.asarray(width) - 1) & 1) << np.asarray(width, np.int64))

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Where the next set bit is."""
        return self.ones[self.rank[np.minimum(at, len(self.rank) - 1)]]


def residuals(bits: Bits, at: np.ndarray, n: np.ndarray, order: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rice-coded residuals of many subframes into out[sample, subframe]; returns where each ends."""
    method, splits = bits.take(at, 2), bits.take(at + 2, 4)
    if (method > 1).any():
        raise Damaged("unknown residual coding")
    per = n >> splits
    if ((per << splits) != n).any() or (per < order).any():
        raise Damaged("bad partition order")
    at = at + 6
    wide = 4 + method
    sort = np.argsort(-(n - order), kind="stable")
    pos, size, left = at[sort], (n - order)[sort], (per - order)[sort]
    per, wide, first = per[sort], wide[sort], order[sort]
    k, escape = np.zeros(len(sort), np.int64), np.zeros(len(sort), bool)
    fresh = np.ones(len(sort), bool)
    alive = len(sort) - np.searchsorted(size[::-1], np.arange(max(int(size[0]), 0)), side="right")
    for step in range(int(size[0])):
        m = int(alive[step])
        p = pos[:m]
        if fresh[:m].any():
            while (new := np.flatnonzero(fresh[:m])).size:  # a partition may be empty, so several parameters can follow
                value = bits.take(p[new], wide[new])
                p[new] += wide[new]
                raw = value == (1 << wide[new]) - 1
                escape[new] = raw
                k[new] = np.where(raw, bits.take(p[new], 5), value)
                p[new[raw]] += 5
                fresh[new] = left[new] == 0
                left[new] = np.where(fresh[new], per[new], left[new])
        kk = k[:m]
        if escape[:m].any():
            raw = escape[:m]
            stop = np.where(raw, p - 1, bits.unary(p))
            low = bits.take(stop + 1, kk)
            zz = ((stop - p) << kk) | low
            value = np.where(raw, np.where(kk > 0, bits.signed(stop + 1, np.maximum(kk, 1)), 0), (zz >> 1) ^ -(zz & 1))
        else:
            stop = bits.ones[bits.rank[p]] if p.max(initial=0) < len(bits.rank) else bits.unary(p)
            low = bits.take(stop + 1, kk)
            zz = ((stop - p) << kk) | low
            value = (zz >> 1) ^ -(zz & 1)
        out[first[:m] + step, sort[:m]] = value
        pos[:m] = stop + 1 + kk
        left[:m] -= 1
        ended = left[:m] == 0
        fresh[:m] = ended
        left[:m] = np.where(ended, per[:m], left[:m])
    back = np.empty_like(pos)
    back[sort] = pos
    return back


def subframes(bits: Bits, at: np.ndarray, n: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [sample, frame] of one channel of many frames, and where each subframe ends."""
    count, longest = len(at), int(n.max())
    out = np.zeros((longest, count), np.int64)
    head = bits.take(at, 8)
    kind, at = head >> 1 & 63, at + 8
    wasted = np.zeros(count, np.int64)
    some = np.flatnonzero(head & 1)
    if some.size:
        stop = bits.unary(at[some])
        wasted[some] = stop - at[some] + 1
        at[some] = stop + 1
    width = width - wasted
    order = np.select([kind >= 32, (kind >= 8) & (kind <= 12)], [kind - 31, kind - 8], 0)
    if (((kind > 1) & (kind < 8)) | ((kind > 12) & (kind < 32))).any() or (order > n).any():
        raise Damaged("unknown subframe")
    same = np.flatnonzero(kind == 0)
    out[:, same] = bits.signed(at[same], width[same])[None, :]
    at[same] += width[same]
    raw = np.flatnonzero(kind == 1)
    for step in range(int(n[raw].max(initial=0))):
        now = raw[n[raw] > step]
        out[step, now] = bits.signed(at[now], width[now])
        at[now] += width[now]
    predicted = np.flatnonzero(kind >= 8)
    if predicted.size:
        for j in range(int(order[predicted].max(initial=0))):
            warm = predicted[order[predicted] > j]
            out[j, warm] = bits.signed(at[warm], width[warm])
            at[warm] += width[warm]
        linear = np.flatnonzero(kind >= 32)
        shift = np.zeros(count, np.int64)
        weights = np.zeros((int(order.max()), count), np.int64)
        if linear.size:
            precision = bits.take(at[linear], 4) + 1
            shift[linear] = bits.signed(at[linear] + 4, 5)
            at[linear] += 9
            for j in range(int(order[linear].max())):
                some = order[linear] > j
                weights[j, linear[some]] = bits.signed(at[linear[some]], precision[some])
                at[linear[some]] += precision[some]
            if (shift[linear] < 0).any():
                raise Damaged("negative predictor shift")
        for level in range(1, 5):
            fixed = np.flatnonzero(kind == 8 + level)
            if fixed.size:
                weights[:level, fixed] = np.array(FIXED[level])[:, None]
        at[predicted] = residuals(bits, at[predicted], n[predicted], order[predicted], part := np.zeros((longest, len(predicted)), np.int64))
        for j in range(int(order[predicted].max(initial=0))):
            warm = np.flatnonzero(order[predicted] > j)
            part[j, warm] = out[j, predicted[warm]]
        for level in np.unique(order[predicted]):
            group = np.flatnonzero(order[predicted] == level)
            if level:
                block, w, moved = part[:, group], weights[:level, predicted[group]], shift[predicted[group]]
                for step in range(int(level), longest):
                    block[step] += (w * block[step - level : step][::-1]).sum(axis=0) >> moved
                part[:, group] = block
        out[:, predicted] = part
    if wasted.any():
        out <<= wasted[None, :]
    return out, at


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, infos: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples [channel, sample, frame], samples of each frame, and the number each frame's header gives."""
    heads = np.zeros((len(start), 16), np.int64)
    for j in range(16):
        heads[:, j] = data[np.minimum(start + j, len(data) - 1)]
    size = np.array([header_size(h) for h in heads.tolist()], np.int64)
    if (heads[:, 0] != 0xFF).any() or (heads[:, 1] & 0xFC != 0xF8).any() or (size == 0).any() or (start + size + 3 > end).any():
        raise Damaged("no frame header")
    if (crc_of(data, start, size, 8) != heads[np.arange(len(start)), size]).any():
        raise Damaged("header checksum")
    if crc_of(data, start, end - start, 16).any():
        raise Damaged("frame checksum")
    code = heads[:, 2] >> 4
    rate = heads[:, 2] & 15
    tail = size - (rate == 12) - 2 * np.isin(rate, (13, 14))
    every = np.arange(len(start))
    short, double = heads[every, tail - 1] + 1, (heads[every, tail - 2] << 8 | heads[every, tail - 1]) + 1
    n = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << np.maximum(code - 2, 0), short, double, 256 << np.maximum(code - 8, 0)])
    assignment, depth = heads[:, 3] >> 4, heads[:, 3] >> 1 & 7
    bits = np.array([SAMPLE_BITS.get(d, info["bits"]) for d, info in zip(depth.tolist(), infos, strict=True)], np.int64)
    if (assignment > 10).any() or (n == 0).any():
        raise Damaged("reserved frame header")
    lead = heads[:, 4]
    more = tail - 5 - (code == 6) - 2 * (code == 7)
    number = np.where(more == 0, lead, lead & (0x7F >> np.maximum(more + 1, 0)))
    for j in range(6):
        number = np.where(more > j, number << 6 | heads[:, 5 + j] & 0x3F, number)
    channels = np.where(assignment < 8, assignment + 1, 2)
    reader = Bits(data)
    at = (start + size + 1) * 8
    out = np.zeros((int(channels.max()), int(n.max()), len(start)), np.int64)
    for channel in range(int(channels.max())):
        now = np.flatnonzero(channels > channel)
        extra = ((assignment[now] == 8) & (channel == 1)) | ((assignment[now] == 9) & (channel == 0)) | ((assignment[now] == 10) & (channel == 1))
        samples, at[now] = subframes(reader, at[now], n[now], bits[now] + extra)
        out[channel][: len(samples), now] = samples
    if (-(-at // 8) + 2 != end).any():
        raise Damaged("a frame does not end where the next begins")
    for kind in (8, 9, 10):
        now = np.flatnonzero(assignment == kind)
        if now.size:
            a, b = out[0][:, now], out[1][:, now]
            if kind == 8:
                out[1][:, now] = a - b
            elif kind == 9:
                out[0][:, now] = a + b
            else:
                mid = a << 1 | b & 1
                out[0][:, now], out[1][:, now] = (mid + b) >> 1, (mid - b) >> 1
    return out, n, number


def pcm_of(samples: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Interleaved samples [n, channels] as the MD5 has them, and as PCM."""
    width = -(-bits // 8)
    raw = samples.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :width]
    signed = raw.tobytes()
    return signed, (raw ^ 0x80).tobytes() if width == 1 else signed


def decode_many(streams: list[bytes | None]) -> list[dict]:
    """For each stream pcm, blocks (first sample, byte offset, samples), features and error."""
    out: list[dict] = [{"pcm": None, "blocks": None, "feature": None, "error": None} for _ in streams]
    jobs, offset = [], 0
    for d, data in enumerate(streams):
        try:
            if data is None:
                raise Damaged("null")
            info, base, frames = stream_frames(data)
            if not len(frames):
                if info["samples"]:
                    raise Damaged("no frames")
                out[d] |= {"pcm": b"", "blocks": [], "feature": "n=0"}
                continue
            jobs.append((d, info, offset + base + frames, offset + len(data)))
            offset += len(data)
        except Damaged as damage:
            out[d]["error"] = str(damage)
    if not jobs:
        return out

    def attempt(some: list, data: np.ndarray) -> None:
        try:
            start = np.concatenate([j[2] for j in some])
            end = np.concatenate([np.append(j[2][1:], j[3]) for j in some])
            owner = np.repeat(np.arange(len(some)), [len(j[2]) for j in some])
            readers = [Reader(info) for _, info, _, _ in some]
            for lo in range(0, len(start), RUN):
                hi = min(lo + RUN, len(start))
                first = start[lo]
                samples, n, number = decode_frames(data[first : end[hi - 1]], start[lo:hi] - first, end[lo:hi] - first, [some[o][1] for o in owner[lo:hi].tolist()])
                flat = samples.transpose(2, 1, 0)
                for o in np.unique(owner[lo:hi]):
                    mine = np.flatnonzero(owner[lo:hi] == o)
                    readers[o].take(flat[mine], n[mine], number[mine])
            for (d, _, _, _), reader in zip(some, readers, strict=True):
                out[d] |= reader.result()
        except Damaged as damage:
            if len(some) == 1:
                out[some[0][0]] |= {"pcm": None, "blocks": None, "feature": None, "error": str(damage)}
            else:  # find the damaged stream
                attempt(some[: len(some) // 2], data)
                attempt(some[len(some) // 2 :], data)

    attempt(jobs, np.frombuffer(streams[jobs[0][0]] if len(jobs) == 1 else b"".join(streams[j[0]] for j in jobs), np.uint8))
    return out


class Reader:
    """Puts the decoded frames of one stream together, run by run, and verifies them."""

    def __init__(self, info: dict) -> None:
        self.info, self.sum, self.pcm, self.sizes, self.numbers = info, hashlib.md5(usedforsecurity=False), [], [], []
        self.peak = self.energy = self.total = self.crossings = 0
        self.last: np.ndarray = np.zeros(0, bool)

    def take(self, frames: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> None:
        """Samples [frame, sample, channel] of the next frames."""
        part = frames[:, :, : self.info["channels"]]
        joined = part[np.arange(part.shape[1])[None, :] < sizes[:, None]]
        signed, pcm = pcm_of(joined, self.info["bits"])
        self.sum.update(signed)
        self.pcm.append(pcm)
        self.sizes.append(sizes)
        self.numbers.append(numbers)
        one = joined[:, 0]
        signs = np.concatenate([self.last, one < 0])
        self.peak, self.energy, self.total = max(self.peak, int(np.abs(one).max())), self.energy + int((one * one).sum()), self.total + int(one.sum())
        self.crossings, self.last = self.crossings + int((signs[1:] != signs[:-1]).sum()), signs[-1:]

    def result(self) -> dict:
        sizes, numbers, info = np.concatenate(self.sizes), np.concatenate(self.numbers), self.info
        count, first = int(sizes.sum()), np.cumsum(sizes) - sizes
        if info["samples"] and info["samples"] != count:
            raise Damaged("number of samples")
        if not ((numbers == np.arange(len(numbers))).all() or (numbers == first).all()):
            raise Damaged("frame numbers")
        if any(info["md5"]) and self.sum.digest() != info["md5"]:
            raise Damaged("sample checksum")
        step = info["channels"] * -(-info["bits"] // 8)
        blocks = [{"first_sample": f, "byte_offset": f * step, "n_samples": m, "n_bytes": m * step} for f, m in zip(first.tolist(), sizes.tolist(), strict=True)]
        return {"pcm": b"".join(self.pcm), "blocks": blocks, "feature": f"n={count};peak={self.peak};energy={self.energy};sum={self.total};crossings={self.crossings}"}


NEW = ["pcm", "blocks", "feature", "error"]
DECODED = "pcm binary, blocks array<struct<first_sample:bigint,byte_offset:bigint,n_samples:bigint,n_bytes:bigint>>, feature string, error string"
TYPES = (pa.binary(), pa.list_(pa.struct([(f, pa.int64()) for f in ("first_sample", "byte_offset", "n_samples", "n_bytes")])), pa.string(), pa.string())


def read_back(streams: list[bytes | None]) -> list[pa.Array]:
    found = decode_many(streams)
    return [pa.array([x[c] for x in found], t) for c, t in zip(NEW, TYPES, strict=True)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, n_bytes, media): each value as UTF-8 (binary as it is), padded with zeros to a positive multiple of ``UNIT`` bytes, as a FLAC stream.
    With ``back`` also what ``decode`` reads from the stored bytes, in the same pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload", SLICE_BYTES):
            plain = [x or b"" for x in part.column("payload").to_pylist()]
            sizes = [len(x) for x in plain]
            media = encode_many([x + bytes(max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x)) for x in plain])
            del plain
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + (read_back(media) if back else []), ["doc_id", "n_bytes", "media", *(NEW if back else [])])

    picked = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("binary").alias("payload"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary" + (f", {DECODED}" if back else ""))


def decode(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """Read FLAC streams back: all columns of ``stored`` (less those named as the new ones), with ``pcm``, ``blocks``, ``feature`` and ``error``."""
    kept = stored.select(*[named(c) for c in stored.columns if c not in NEW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media_col, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*part.columns, *read_back(part.column(media_col).to_pylist())], [*part.schema.names, *NEW])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, {DECODED}")


def pcm_blocks(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each block: (doc_id, block, first_sample, n_samples, pcm), so that a reader can seek by sample."""
    each = decoded.select(F.col(id_col).alias("doc_id"), "pcm", F.posexplode("blocks").alias("block", "b"))
    return each.select("doc_id", "block", F.col("b.first_sample").alias("first_sample"), F.col("b.n_samples").alias("n_samples"), F.expr("substring(pcm, int(b.byte_offset) + 1, int(b.n_bytes))").alias("pcm"))


def digests(docs: DataFrame) -> DataFrame:
    """Store every text as FLAC, read the stored bytes back, and derive one row of digests for each document. The tail is found by the last PCM block's offset."""
    back = encode(docs, back=True)
    last = F.element_at("blocks", -1)
    tail = F.substring("pcm", (last["byte_offset"] + last["n_bytes"] - 63).cast("int"), F.lit(64))
    return back.select("doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.size("blocks").cast("long").alias("n_blocks"), "error")
