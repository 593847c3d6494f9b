"""FLAC media columns: lossless 8-bit mono streams, written and decoded with numpy across many frames at once.

A stream is fLaC, STREAMINFO with the MD5 of its samples, a SEEKTABLE with a point for every
frame, and frames with constant, verbatim, fixed or linear predictors and Rice residuals, whichever is smallest. Decoding finds frames by
the seek table, or by sync code and checksums where that lists only some, checks each frame's CRC-8 and CRC-16 and the MD5, reads the Rice
codes of all frames of a group in step, runs the predictors, and writes PCM blocks that know their first sample and the place of
their frame. Samples are the payload's bytes minus 128.

Defined cases: a null text counts as empty; an empty payload is padded to 64 zero bytes (one constant
frame); texts of any length are cut into frames of FRAME samples; equal payloads give equal streams; a damaged
stream raises ValueError; an empty table gives an empty result; extra columns are ignored.
Not read: several channels, samples of other than 8 bits, blocks of changing size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Samples of a frame, frames that numpy works on together, and the nominal sample rate in Hz.
FRAME, GROUP, RATE = 1024, 1024, 8000
PAD = 64
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32
#: Order of the linear predictors that frames are tried with, and bits of a coefficient.
ORDER, COEF = 4, 12


def _crc_table(poly: int, width: int) -> np.ndarray:
    """Table over all values of `width` bits, the register's width."""
    x = np.arange(1 << width, dtype=np.uint32)
    for _ in range(width):
        x = (x << 1) ^ np.where(x >> (width - 1) & 1, poly | 1 << width, 0).astype(np.uint32)
    return x.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = int(CRC8[c ^ x])
    return c


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start : start + length] for many frames, two bytes a step."""
    order = np.argsort(-length)
    start, length = start[order], length[order]
    crc, pairs = np.zeros(len(start), np.uint16), length // 2
    active = len(start) - np.searchsorted(pairs[::-1], np.arange(1, pairs.max(initial=0) + 1))
    for i, n in enumerate(active):
        at = start[:n] + 2 * i
        crc[:n] = CRC16[crc[:n] ^ (data[at].astype(np.uint16) << 8 | data[at + 1])]
    odd = np.flatnonzero(length % 2)
    last = data[start[odd] + length[odd] - 1]
    crc[odd] = crc[odd] << 8 ^ CRC16[crc[odd] >> 8 ^ last]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@lru_cache(65536)
def frame_header(number: int, samples: int) -> bytes:
    """Fixed-blocksize frame header: mono, 8 bits, rate from STREAMINFO."""
    full = samples == FRAME
    head = bytes([0xFF, 0xF8, (0b1010 if full else 0b0111) << 4, 0b0000_001_0])
    if number < 0x80:
        head += bytes([number])
    else:  # as UTF-8 codes a number, up to 36 bits
        n = next(k for k in range(2, 8) if number < 1 << (5 * k + 1))
        head += bytes([(0xFF << (8 - n) & 0xFF) | number >> 6 * (n - 1)]) + bytes(0x80 | number >> 6 * i & 0x3F for i in range(n - 2, -1, -1))
    if not full:
        head += struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


@lru_cache(65536)
def parse_header(head: bytes) -> tuple[int, int]:
    """(frame number, samples) of a header as long as header_length says; checks CRC-8."""
    if crc8(head[:-1]) != head[-1] or head[:2] != b"\xff\xf8" or head[3] not in (0b0000_001_0, 0):
        raise ValueError("bad frame header")
    lead, code = head[4], head[2] >> 4
    n = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    number = lead if n == 1 else lead & (1 << (7 - n)) - 1
    for x in head[5 : 4 + n]:
        number = number << 6 | x & 0x3F
    tail = head[4 + n : 4 + n + {6: 1, 7: 2}.get(code, 0)]
    samples = 256 << code - 8 if code >= 8 else 576 << code - 2 if 2 <= code <= 5 else int.from_bytes(tail, "big") + 1
    return number, samples


def header_length(data: bytes, at: int) -> int:
    lead, code = data[at + 4], data[at + 2] >> 4
    rate = {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
    return 5 + (1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()) + {6: 1, 7: 2}.get(code, 0) + rate


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def _predicted(x: np.ndarray, coefs: tuple, shift) -> np.ndarray:
    """Predictions for columns len(coefs): from the samples before them, newest first. Coefficients and shift: numbers, or columns of one a row."""
    p = len(coefs)
    return sum(c * x[:, p - 1 - j : x.shape[1] - 1 - j] for j, c in enumerate(coefs)) >> shift


def linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (rows x ORDER, COEF bits) and shifts of each row's linear predictor: Levinson-Durbin over whole-number autocorrelations.

    Every step is exact or one IEEE operation a row, so equal rows get equal predictors wherever they are.
    """
    x = x.astype(np.int64)
    r = [(x[:, : x.shape[1] - lag] * x[:, lag:]).sum(axis=1).astype(np.float64) for lag in range(ORDER + 1)]
    a, err = [], np.maximum(r[0], 1)
    for i in range(ORDER):
        left = r[i + 1]
        for j in range(i):
            left = left - a[j] * r[i - j]
        k = left / err
        a = [a[j] - k * a[i - 1 - j] for j in range(i)] + [k]
        err = np.maximum(err * (1 - k * k), 1)
    a = np.stack(a, axis=1)
    shift = np.clip(COEF - 1 - np.frexp(np.abs(a).max(axis=1))[1], 0, 15).astype(np.int64)
    most = 1 << COEF - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most, most - 1).astype(np.int64), shift


def encode_frames(samples: np.ndarray, count: np.ndarray, number: np.ndarray, lpc: tuple[tuple[int, ...], int] | None = None) -> list[bytes]:
    """Frames of rows of samples (frames x FRAME, zero beyond count), each with its smallest predictor. lpc: (coefficients, shift) used for all frames."""
    f, x = len(count), samples.astype(np.int32)
    valid = np.arange(FRAME) < count[:, None]
    if lpc is None:
        coefs, shift = linear(x)
        tried = [((), 0, False), ((1,), 0, False), ((2, -1), 0, False), (tuple(coefs[:, j, None] for j in range(ORDER)), shift[:, None], True)]
    else:
        coefs, shift = np.tile(np.array(lpc[0], np.int64), (f, 1)), np.full(f, lpc[1])
        tried = [(tuple(np.int64(c) for c in lpc[0]), lpc[1], True)]
    best = None
    for cs, sh, is_linear in tried:
        p = len(cs)
        r = x.astype(np.int64) if is_linear else x.copy()
        r[:, p:] -= _predicted(r.copy() if is_linear else x, cs, sh) if cs else 0
        u = np.where(valid & (np.arange(FRAME) >= p), (r << 1) ^ (r >> 63 if is_linear else r >> 31), 0).astype(np.int32)
        total, n = u.sum(axis=1, dtype=np.int64), np.maximum(count - p, 1)
        k = np.clip(np.frexp(np.maximum(total / n * 0.7, 1))[1] - 1, 0, 14).astype(np.int64)  # floor of the binary logarithm
        cost = n * (k + 1) + (total >> k) + 8 * p + (9 + COEF * p if is_linear else 0)
        if best is None:
            best, best_u, best_k, order, lin = cost, u, k, np.full(f, p), np.full(f, is_linear)
        else:
            better = (cost < best) & (count > p)
            best, best_k, order, lin = np.where(better, cost, best), np.where(better, k, best_k), np.where(better, p, order), np.where(better, is_linear, lin)
            best_u[better] = u[better]
    k = best_k
    coded = valid & (np.arange(FRAME) >= order[:, None])
    q = best_u >> k[:, None]
    code_bits = np.where(coded, q + 1 + k[:, None], 0)
    lpc_bits = np.where(lin, 9 + COEF * order, 0)
    rice_bits = 8 + 8 * order + lpc_bits + 10 + code_bits.sum(axis=1)
    constant = ((x == x[:, :1]) | ~valid).all(axis=1)
    verbatim = ~constant & (rice_bits >= 8 + 8 * count) & (lpc is None)
    rice = ~constant & ~verbatim
    sub_bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * count, rice_bits))
    heads = [frame_header(int(a), int(b)) for a, b in zip(number, count, strict=True)]
    head_len = np.array([len(h) for h in heads])
    size = head_len + (sub_bits + 7) // 8 + 2
    off = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    start = (off + head_len) * 8
    kind = np.where(constant, CONSTANT, np.where(verbatim, VERBATIM, np.where(lin, LPC + order - 1, FIXED + order)))
    _put(bits, start, kind << 1, 8)
    raw = x & 0xFF
    _put(bits, start[constant] + 8, raw[constant, 0], 8)
    for i in np.flatnonzero(verbatim):
        bits[start[i] + 8 : start[i] + 8 + 8 * count[i]] = np.unpackbits(raw[i, : count[i]].astype(np.uint8))
    for j in range(int(order[rice].max(initial=0))):
        have = rice & (order > j)
        _put(bits, start[have] + 8 + 8 * j, raw[have, j], 8)
    at = start + 8 + 8 * order
    by_line = lin & rice
    _put(bits, at[by_line], np.int64(COEF - 1), 4)
    _put(bits, at[by_line] + 4, shift[by_line], 5)
    for j in range(int(order[by_line].max(initial=0))):
        _put(bits, at[by_line] + 9 + COEF * j, coefs[by_line, j] & (1 << COEF) - 1, COEF)
    at = at + np.where(by_line, lpc_bits, 0)
    _put(bits, at[rice] + 6, k[rice], 4)
    begin = (at + 10)[:, None] + np.cumsum(code_bits, axis=1) - code_bits
    use = coded & rice[:, None]
    stop, u, kk = (begin + q)[use], best_u[use], np.broadcast_to(k[:, None], use.shape)[use]
    bits[stop] = 1
    for j in range(int(kk.max(initial=0))):
        have = kk > j
        if have.all():
            bits[stop + 1 + j] = u >> (kk - 1 - j) & 1
        else:
            bits[stop[have] + 1 + j] = u[have] >> (kk[have] - 1 - j) & 1
    data = np.packbits(bits)
    for h, o in zip(heads, off, strict=True):
        data[o : o + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(data, off, size - 2)
    data[off + size - 2], data[off + size - 1] = crc >> 8, crc & 0xFF
    whole = data.tobytes()
    return [whole[o : o + n] for o, n in zip(off, size, strict=True)]


def encode(payloads: list[bytes], lpc=None) -> list[bytes]:
    """A FLAC stream for each payload; none may be empty."""
    cut = [(i, k) for i, p in enumerate(payloads) for k in range(0, len(p), FRAME)]
    frames: list[list[bytes]] = [[] for _ in payloads]
    for g in range(0, len(cut), GROUP):
        part = cut[g : g + GROUP]
        count = np.array([min(FRAME, len(payloads[i]) - k) for i, k in part])
        x = np.zeros((len(part), FRAME), np.int16)
        for row, (i, k) in enumerate(part):
            x[row, : count[row]] = np.frombuffer(payloads[i], np.uint8, count[row], k).astype(np.int16) - 128
        for (i, _), b in zip(part, encode_frames(x, count, np.array([k // FRAME for _, k in part]), lpc), strict=True):
            frames[i].append(b)
    out = []
    for p, fs in zip(payloads, frames, strict=True):
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        lengths = [len(b) for b in fs]
        info = struct.pack(">HH", FRAME, FRAME) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(len(fs), [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        points["sample"] = np.arange(len(fs)) * FRAME
        points["offset"] = np.cumsum([0, *lengths[:-1]])
        points["count"] = np.minimum(FRAME, len(p) - points["sample"].astype(np.int64))
        table = points.tobytes()
        out.append(b"".join([b"fLaC", b"\x00" + len(info).to_bytes(3, "big"), info, b"\x83" + len(table).to_bytes(3, "big"), table, *fs]))
    return out


def _metadata(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]]]:
    """(samples, MD5, frames), a frame's start and size in the stream and its samples."""
    if stream[:4] != b"fLaC":
        raise ValueError("not FLAC")
    at, last, total, md5, points = 4, False, 0, b"", None
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        at += 4 + n
    if points is not None and int(points["count"].sum()) == total:
        starts = [at + int(o) for o in points["offset"]] + [len(stream)]
        return total, md5, [(a, b - a, int(n)) for a, b, n in zip(starts, starts[1:], points["count"], strict=False)]
    return total, md5, scanned(stream, at)


def scanned(stream: bytes, at: int) -> list[tuple[int, int, int]]:
    """The frames from offset `at` on: a frame ends where its CRC-16 fits and the next number's header, or the stream's end, follows."""
    data, heads = np.frombuffer(stream, np.uint8), {}
    for a in np.flatnonzero((data[at:-1] == 0xFF) & (data[at + 1 :] == 0xF8)) + at:
        try:
            heads[int(a)] = parse_header(stream[a : a + header_length(stream, int(a))])
        except (ValueError, IndexError):
            continue
    frames = []
    while at < len(stream):
        if at not in heads or heads[at][0] != len(frames):
            raise ValueError("no frame where one should start")
        ends = [b for b, (n, _) in heads.items() if b > at + 2 and n == len(frames) + 1] + [len(stream)]
        fits = (b for b in ends if crc16(data, np.array([at]), np.array([b - 2 - at]))[0] == data[b - 2].astype(np.uint16) << 8 | data[b - 1])
        end = next(fits, None)
        if end is None:
            raise ValueError("frame checksum does not match")
        frames.append((at, end - at, heads[at][1]))
        at = end
    return frames


def _read(words: np.ndarray, at: np.ndarray, width) -> np.ndarray:
    """Up to 24 bits at bit positions `at`; words[i] holds bytes i to i + 3."""
    return (words[at >> 3] << (at & 7).astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - width)


def decode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray, head: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frames x most samples), predictor kinds and first Rice parameters (-1: none) of frames in data."""
    crc = crc16(data, start, size - 2)
    if (crc != data[start + size - 2].astype(np.uint16) << 8 | data[start + size - 1]).any():
        raise ValueError("frame checksum does not match")
    f = len(start)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint64)
    words = padded[:-3] << np.uint64(24) | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(8) | padded[3:]
    begin = (start + head) * 8
    kind = _read(words, begin, 8) >> 1 & 63
    wasted = np.zeros(f, np.int64)
    for i in np.flatnonzero(_read(words, begin, 8) & 1):
        wasted[i] = 9 - int(_read(words, begin[i : i + 1] + 8, 8)[0]).bit_length()  # zeros before a one, and it
        begin[i] += wasted[i]
    if (wasted > 7).any():
        raise ValueError("a subframe without samples")
    width = 8 - wasted
    out, rice_k = np.zeros((f, int(count.max())), np.int32), np.full(f, -1)
    signed = lambda v, width: v - (v >> (width - 1) << width)
    for i in np.flatnonzero(kind == VERBATIM):
        out[i, : count[i]] = signed(_read(words, begin[i] + 8 + width[i] * np.arange(count[i]), width[i]), width[i])
    constant = np.flatnonzero(kind == CONSTANT)
    out[constant] = signed(_read(words, begin[constant] + 8, width[constant]), width[constant])[:, None]
    order = np.where(kind >= LPC, kind - LPC + 1, np.where(kind >= FIXED, kind - FIXED, 0))
    rows = np.flatnonzero(kind >= FIXED)
    if not len(rows):
        return out << wasted[:, None], kind, rice_k
    n_res = (count - order)[rows]
    rows = rows[np.argsort(-n_res, kind="stable")]
    n_res, p = (count - order)[rows], begin[rows] + 8
    for j in range(int(order[rows].max())):
        have = order[rows] > j
        w = width[rows[have]]
        out[rows[have], j] = signed(_read(words, p[have] + w * j, w), w)
    p = p + width[rows] * order[rows]
    lpc = {}
    for o in np.unique(order[rows][kind[rows] >= LPC]):
        at = np.flatnonzero(kind[rows] == LPC + o - 1)
        w = _read(words, p[at], 4) + 1
        lpc[int(o)] = [signed(_read(words, p[at] + 9 + w * j, w), w) for j in range(o)], signed(_read(words, p[at] + 4, 5), 5)
        p[at] += 9 + w * o
    method = _read(words, p, 2)
    if (method > 1).any() or any((shift < 0).any() for _, shift in lpc.values()):
        raise ValueError("reserved value in a subframe")
    parts, kw = 1 << _read(words, p + 2, 4), 4 + method
    p = p + 6
    if (count[rows] % parts).any():
        raise ValueError("bad partition order")
    per = count[rows] // parts
    until = per - order[rows]  # residuals left in the current partition
    k, raw = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)

    def parameters(at):  # of the partitions that begin at p[at]
        k[at] = _read(words, p[at], kw[at])
        raw[at] = k[at] == (1 << kw[at]) - 1
        p[at] += kw[at]
        escaped = at[raw[at]]
        k[escaped] = _read(words, p[escaped], 5)
        p[escaped] += 5
        if (k[at] > 24).any():
            raise ValueError("residuals are wider than samples of 8 bits make them")

    parameters(np.arange(len(rows)))
    rice_k[rows] = np.where(raw, -1, k)
    bits = np.unpackbits(data)
    ones = np.flatnonzero(bits)
    before = np.cumsum(bits, dtype=np.int32) - bits  # ones before each position
    active = len(rows) - np.searchsorted(n_res[::-1], np.arange(1, int(n_res.max()) + 1))
    one_part = bool((parts == 1).all())
    stops, ks = np.zeros((len(active), len(rows)), np.int64), None if one_part else np.zeros((len(active), len(rows)), np.int64)
    quot, plain = np.zeros((len(active), len(rows)), np.int64), None if one_part else np.zeros((len(active), len(rows)), bool)
    escapes = bool(raw.any())
    for i, m in enumerate(active):
        if not one_part:
            while len(new := np.flatnonzero(until[:m] == 0)):  # again for partitions that hold the warm-up samples alone
                parameters(new)
                until[new] = per[new]
            until[:m] -= 1
            ks[i, :m], plain[i, :m] = k[:m], raw[:m]
            escapes = bool(raw[:m].any())
        t = ones[before[p[:m]]] if not escapes else ones[np.minimum(before[np.minimum(p[:m], len(before) - 1)], len(ones) - 1)]
        if escapes:  # a residual of k bits as it is, and no bit before them
            t = np.where(raw[:m], p[:m] - 1, t)
        quot[i, :m] = t - p[:m]
        stops[i, :m] = t + 1
        p[:m] = t + 1 + k[:m]
    wide, as_is = (k[None, :], raw[None, :]) if one_part else (ks, plain)
    low = _read(words, stops, wide)
    u = np.maximum(quot, 0) << wide | low
    r = (u >> 1) ^ -(u & 1)
    if as_is.any():
        r = np.where(as_is, low - (np.where(wide > 0, low >> np.maximum(wide - 1, 0), 0) << wide), r)
    r = r.T.astype(np.int32)
    valid = np.arange(r.shape[1]) < n_res[:, None]
    r = np.where(valid, r, 0)
    for o in np.unique(kind[rows]):
        at = np.flatnonzero(kind[rows] == o)
        if o < LPC:
            o = int(o) - FIXED
            full = np.concatenate([out[rows[at], :o], r[at]], axis=1)[:, : out.shape[1]]
            lead = full[:, :o].copy()
            for d in range(o, 0, -1):  # undo one difference at a time, from the d-th difference of the warm-up
                start_d = lead[:, : d] if d == 1 else np.diff(lead[:, :d], n=d - 1, axis=1)
                full[:, d - 1] = start_d[:, -1]
                full[:, d - 1 :] = np.cumsum(full[:, d - 1 :], axis=1)
            full[:, :o] = lead
            out[rows[at], : full.shape[1]] = full
            continue
        o = int(o) - LPC + 1
        coefs, shift = lpc[o]
        x, res = out[rows[at]].T.astype(np.int64), r[at].T.astype(np.int64)  # a row for each sample, so that a step reads whole rows
        for i in range(o, min(o + len(res), len(x))):
            ahead = coefs[0] * x[i - 1]
            for j in range(1, o):
                ahead += coefs[j] * x[i - 1 - j]
            x[i] = res[i - o] + (ahead >> shift)
        out[rows[at]] = x.T
    return out << wasted[:, None], kind, rice_k


def decode(streams: list[bytes]) -> list[list[tuple[int, int, int, int, int, bytes]]]:
    """The PCM blocks of each stream: (first sample, samples, frame's offset in the stream, predictor kind, first Rice parameter or -1, unsigned samples).

    Checks headers, frame checksums and the MD5.
    """
    meta, todo = [], []
    for i, s in enumerate(streams):
        total, md5, frames = _metadata(s)
        meta.append((total, md5))
        todo += [(i, *frame) for frame in frames]
    out: list[list[tuple]] = [[] for _ in streams]
    first = [0] * len(streams)
    for g in range(0, len(todo), GROUP):
        group = todo[g : g + GROUP]
        heads = []
        for number, (i, a, _, n) in zip(_numbers(group, out), group, strict=True):
            h = header_length(streams[i], a)
            if parse_header(streams[i][a : a + h]) != (number, n):
                raise ValueError("frame header disagrees with the seek table")
            heads.append(h)
        size, count = np.array([x[2] for x in group]), np.array([x[3] for x in group])
        data = np.frombuffer(b"".join(streams[i][a : a + n] for i, a, n, _ in group), np.uint8)
        x, kind, rice = decode_frames(data, np.cumsum(size) - size, size, np.array(heads), count)
        x = (x + 128).astype(np.uint8)
        for row, (i, a, _, n) in enumerate(group):
            out[i].append((first[i], n, a, int(kind[row]), int(rice[row]), x[row, :n].tobytes()))
            first[i] += n
    for (total, md5), blocks in zip(meta, out, strict=True):
        seen = hashlib.md5()
        for b in blocks:
            seen.update((np.frombuffer(b[-1], np.uint8) ^ 0x80).tobytes())
        if sum(b[1] for b in blocks) != total or seen.digest() != md5:
            raise ValueError("decoded samples do not match the stream's MD5")
    return out


def _numbers(group: list[tuple], done: list[list]) -> list[int]:
    """Frame numbers of a group whose streams have `done` blocks so far."""
    seen: dict[int, int] = {}
    out = []
    for i, *_ in group:
        seen[i] = seen.get(i, len(done[i]) - 1) + 1
        out.append(seen[i])
    return out


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every row's text as a FLAC stream."""

    def run(batches):
        for b in batches:
            ids, texts = b["doc_id"].cast(pa.int64()), b["text"].to_pylist()
            for i, j in common.by_bytes(texts, [len(t or "") for t in texts], 4 << 20):
                payloads = [payload_of(t) for t in texts[i:j]]
                n = [len((t or "").encode("utf-8", "replace")) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(n, pa.int64()), pa.array(encode(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


BLOCK = pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int64()), ("frame_offset", pa.int64()), ("kind", pa.int64()), ("rice", pa.int64()), ("pcm", pa.binary())])
STORED = ["doc_id", "n_bytes", "media"]


def block_batches(batches):
    """Arrow batches of media_column with column blocks in addition, few streams at a time."""
    for b in batches:
        sizes = pc.binary_length(b["media"]).to_pylist()
        for i, j in common.by_bytes(sizes, sizes, 4 << 20):
            blocks = decode(b["media"][i:j].to_pylist())
            starts = pa.array(np.cumsum([0, *map(len, blocks)]), pa.int32())
            fields = zip(*(x for d in blocks for x in d), strict=True)
            flat = pa.StructArray.from_arrays([pa.array(v, t.type) for v, t in zip(fields, BLOCK, strict=True)], fields=list(BLOCK))
            yield pa.RecordBatch.from_arrays([*(b[c][i:j] for c in STORED), pa.ListArray.from_arrays(starts, flat)], [*STORED, "blocks"])


def pcm_column(media: DataFrame) -> DataFrame:
    """media with column blocks: the PCM blocks of the stored stream in order, each with its first sample and the place of its frame."""
    kinds = ", ".join(f"{t.name}: {'binary' if t.name == 'pcm' else 'long'}" for t in BLOCK)
    return media.select(*STORED).mapInArrow(block_batches, f"doc_id long, n_bytes long, media binary, blocks array<struct<{kinds}>>")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, n_samples, frame_offset, pcm): a row for each block, numbered from 0."""
    return pcm_column(media).select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", *(f"b.{c}" for c in ("first_sample", "n_samples", "frame_offset", "pcm")))


def features(payload: bytes, kinds: list[int], rice: list[int]) -> str:
    x = np.frombuffer(payload, np.uint8)
    names = {CONSTANT: "constant", VERBATIM: "verbatim"}
    used = sorted({names.get(k, f"fixed{k - FIXED}" if k < LPC else f"lpc{k - LPC + 1}") for k in kinds})
    some = [k for k in rice if k >= 0]
    return f"frames={len(kinds)};predictors={'+'.join(used)};rice={min(some, default=0)}-{max(some, default=0)};sum={int(x.sum())};peak={int(x.max())}"


def media_digest(media: DataFrame) -> DataFrame:
    """Reads the stored streams back as PCM blocks: a row of digests and features of the blocks for each.

    The blocks pass from one step to the next inside the task: as a column between two steps they would double what a task holds.
    """
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches):
        for b in block_batches(batches):
            flat, starts = b["blocks"].flatten(), b["blocks"].offsets.to_numpy()
            starts = starts - starts[0]
            pcm, kind, rice = flat.field("pcm"), flat.field("kind").to_pylist(), flat.field("rice").to_pylist()
            rows = []
            for i, j, s in zip(starts, starts[1:], b["media"], strict=False):
                payload, stream = b"".join(x.as_buffer() for x in pcm[i:j]), s.as_buffer()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), stream.size, hashlib.sha256(stream).hexdigest(), features(payload, kind[i:j], rice[i:j])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], *(pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True))], ["doc_id", "n_bytes", *kinds])

    return media.select(*STORED).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9(spark, sf_dir: str) -> DataFrame:
    return media_digest(media_column(common.table(spark, sf_dir, "documents")))
