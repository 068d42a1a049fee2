"""FLAC for 8-bit mono samples: encoder and decoder, vectorised over frames.

All frames of a batch are read in step: sample i of every frame at once, so a
batch costs as many NumPy steps as a block has samples. Subframes: constant,
verbatim, fixed predictors of orders 0 to 4, linear predictors up to order 32;
Rice partitions of any order, escape codes included. Headers carry a CRC-8,
frames a CRC-16, streams an MD5; all are verified. The seek table has a point for
each frame, so any sample range is read from its own frames alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

BLOCK, LONG_BLOCK = 512, 4096
#: Payloads from here on use long blocks, so that the seek table stays within its 24-bit length.
LONG = 200 << 20
RATE = 8000
FRAMES_AT_ONCE = 4096
LPC_ORDER, LPC_BITS = 4, 10


def _crc_table(width: int, poly: int, bits: int) -> np.ndarray:
    """Remainders of `bits`-bit words followed by `width` zeros."""
    out = np.arange(1 << bits, dtype=np.int64) << (width - bits if width > bits else 0)
    top = 1 << (width - 1)
    for _ in range(bits):
        out = np.where(out & top, (out << 1) ^ poly, out << 1) & ((1 << width) - 1)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07, 8), _crc_table(16, 0x8005, 16)
_ZEROS16 = np.array([16] + [15 - i.bit_length() + 1 for i in range(1, 1 << 16)], np.int64)


def _right_aligned(data: np.ndarray, start: np.ndarray, length: np.ndarray, even: bool) -> np.ndarray:
    """Bytes of slices as rows that end in the last column; zeros before, which leave a CRC from 0 as it is."""
    wide = int(length.max())
    wide += even and wide % 2
    at = (start + length)[:, None] + np.arange(-wide, 0)
    rows = data[np.maximum(at, 0)]
    rows[at < start[:, None]] = 0
    return rows


def crc8(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), np.int64)
    for column in _right_aligned(data, start, length, False).T:
        crc = _CRC8[crc ^ column]
    return crc


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(_right_aligned(data, start, length, True))
    crc = np.zeros(len(start), np.int64)
    for column in np.ascontiguousarray(rows.view(">u2").T).astype(np.int64):
        crc = _CRC16[crc ^ column]
    return crc


def _number(n: int) -> tuple[int, int]:
    """A frame number in the coding of UTF-8, as value and bits."""
    if n < 0x80:
        return n, 8
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    out = ((0xFF << (8 - size)) & 0xFF) | (n >> (6 * (size - 1)))
    for k in range(size - 2, -1, -1):
        out = out << 8 | 0x80 | ((n >> (6 * k)) & 0x3F)
    return out, 8 * size


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Write values, highest bit first."""
    for b in range(int(width.max(initial=0))):
        own = width > b
        bits[(at + width - 1 - b)[own]] = (value[own] >> b) & 1


def _levinson(x: np.ndarray) -> np.ndarray:
    """Predictor coefficients of each row, of order LPC_ORDER."""
    x = x.astype(float)
    r = np.stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(1) for k in range(LPC_ORDER + 1)])
    error, a = np.maximum(r[0], 1e-9), np.zeros((LPC_ORDER, len(x)))
    for i in range(LPC_ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / error
        a[:i], a[i] = a[:i] - k * a[i - 1 :: -1][:i] if i else a[:0], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    return a


def _frames(samples: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Encode frames: their bytes in a row, and the length of each."""
    n, f = len(samples), len(starts)
    frame = np.repeat(np.arange(f), sizes)
    place = np.arange(n) - starts[frame]
    x = samples.astype(np.int64)
    residual = {0: x}
    for order in range(1, 5):
        d = residual[order - 1].copy()
        d[1:] -= residual[order - 1][:-1]
        residual[order] = d
    warm = {o: place < o for o in range(1, 5)}
    cost, param = [], []

    def price(u: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.add.reduceat(u, starts) / np.maximum(count, 1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931 + 0.5, 1e-9))), 0, 14).astype(np.int64)
        return np.add.reduceat(u >> k[frame], starts) + count * (1 + k), k

    folded = {}
    for order in range(5):
        u = (residual[order] << 1) ^ (residual[order] >> 63)
        if order:
            u[warm[order]] = 0
        folded[order] = u
        c, k = price(u, sizes - order)
        cost.append(c + 8 * order + 10)
        param.append(k)
    # linear prediction, for whole blocks
    whole = np.flatnonzero(sizes == block)
    coef, shift = np.zeros((LPC_ORDER, f), np.int64), np.zeros(f, np.int64)
    u = np.zeros(n, np.int64)
    c = np.full(f, 1 << 40)
    k = np.zeros(f, np.int64)
    if len(whole):
        rows = x[starts[whole][:, None] + np.arange(block)]
        a = _levinson(rows)
        most = np.maximum(np.abs(a).max(0), 1e-9)
        s = np.clip(LPC_BITS - 1 - np.ceil(np.log2(most)).astype(np.int64) - 1, 0, 15)
        q = np.clip(np.round(a * (1 << s)), -(1 << (LPC_BITS - 1)), (1 << (LPC_BITS - 1)) - 1).astype(np.int64)
        guess = sum(q[j][:, None] * rows[:, LPC_ORDER - 1 - j : block - 1 - j] for j in range(LPC_ORDER)) >> s[:, None]
        e = rows[:, LPC_ORDER:] - guess
        coef[:, whole], shift[whole] = q, s
        at = starts[whole][:, None] + np.arange(LPC_ORDER, block)
        u[at] = (e << 1) ^ (e >> 63)
        c2, k2 = price(u, sizes - LPC_ORDER)
        c[whole] = c2[whole] + 8 * LPC_ORDER + 9 + LPC_BITS * LPC_ORDER + 10
        k = k2
    cost.append(c)
    param.append(k)
    flat = np.minimum.reduceat(x, starts) == np.maximum.reduceat(x, starts)
    cost += [8 * sizes, np.where(flat, 8, 1 << 40)]
    cost = np.stack(cost)
    kind = cost.argmin(0)  # 0 to 4 fixed, 5 linear, 6 verbatim, 7 constant
    body = cost[kind, np.arange(f)]
    order = np.select([kind < 5, kind == 5], [kind, LPC_ORDER], 0)
    k = np.stack([*param, np.zeros(f, np.int64), np.zeros(f, np.int64)])[kind, np.arange(f)]
    codes = np.array([_number(int(v)) for v in np.unique(numbers)], np.int64)[np.unique(numbers, return_inverse=True)[1]]
    odd = np.where(sizes == block, 0, 16)
    head = 32 + codes[:, 1] + odd + 8
    total = (head + 8 + body + 7) // 8 * 8 + 16
    at = np.concatenate(([0], np.cumsum(total)[:-1]))
    bits = np.zeros(int(total.sum()), np.uint8)
    size_code = np.where(sizes == block, 9 if block == BLOCK else 12, 7)
    _put(bits, at, np.full(f, 0xFFF8), np.full(f, 16))
    _put(bits, at + 16, size_code << 12 | 0 << 8 | 0 << 4 | 1 << 1, np.full(f, 16))
    _put(bits, at + 32, codes[:, 0], codes[:, 1])
    _put(bits, at + 32 + codes[:, 1], sizes - 1, odd)
    sub = at + head
    types = np.select([kind < 5, kind == 5, kind == 6], [8 + kind, 32 + LPC_ORDER - 1, 1], 0)
    _put(bits, sub, types << 1, np.full(f, 8))
    raw_ = np.select([kind < 6, kind == 6], [order, sizes], 1)[frame]
    own = place < raw_
    _put(bits, (sub[frame] + 8 + 8 * place)[own], x[own] & 255, np.full(int(own.sum()), 8))
    rest = sub + 8 + 8 * order
    lpc = np.flatnonzero(kind == 5)
    if len(lpc):
        _put(bits, rest[lpc], (LPC_BITS - 1) << 5 | shift[lpc], np.full(len(lpc), 9))
        for j in range(LPC_ORDER):
            _put(bits, rest[lpc] + 9 + LPC_BITS * j, coef[j, lpc] & ((1 << LPC_BITS) - 1), np.full(len(lpc), LPC_BITS))
        rest[lpc] += 9 + LPC_BITS * LPC_ORDER
    coded = np.flatnonzero(kind < 6)
    _put(bits, rest[coded], k[coded], np.full(len(coded), 10))
    own = (kind[frame] < 6) & (place >= order[frame])
    which = frame[own]
    value = np.zeros(n, np.int64)
    for o in np.unique(kind[coded]):
        mine = kind[frame] == o
        value[mine] = (u if o == 5 else folded[int(o)])[mine]
    value = value[own]
    kk = k[which]
    quotient = value >> kk
    length = quotient + 1 + kk
    ends = np.cumsum(length)
    first = np.concatenate(([True], which[1:] != which[:-1])) if len(which) else np.zeros(0, bool)
    base = np.zeros(f, np.int64)
    base[which[first]] = (ends - length)[first]
    pos = rest[which] + 10 + ends - length - base[which]
    bits[pos + quotient] = 1
    _put(bits, pos + quotient + 1, value & ((1 << kk) - 1), kk)
    data = np.packbits(bits)
    lengths = total // 8
    byte_at = at // 8
    data[byte_at + head // 8 - 1] = crc8(data, byte_at, head // 8 - 1)
    check = crc16(data, byte_at, lengths - 2)
    data[byte_at + lengths - 2], data[byte_at + lengths - 1] = check >> 8, check & 255
    return data, lengths


def encode(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload; each byte is a sample, 128 the zero line."""
    plans = []
    for p in payloads:
        block = LONG_BLOCK if len(p) >= LONG else BLOCK
        starts = np.arange(0, len(p), block)
        plans.append((block, starts, np.minimum(block, len(p) - starts)))
    parts: list[list[bytes]] = [[] for _ in payloads]
    lengths: list[list[np.ndarray]] = [[] for _ in payloads]
    todo: list[tuple[int, int, int]] = []

    def flush() -> None:
        if not todo:
            return
        block = plans[todo[0][0]][0]
        pieces, sizes, numbers = [], [], []
        for i, a, b in todo:
            _, s, z = plans[i]
            pieces.append(np.frombuffer(payloads[i], np.uint8, int(s[b - 1] + z[b - 1] - s[a]), int(s[a])))
            sizes.append(z[a:b])
            numbers.append(np.arange(a, b))
        size = np.concatenate(sizes)
        samples = np.concatenate(pieces).astype(np.int64) - 128
        data, length = _frames(samples, np.concatenate(([0], np.cumsum(size)[:-1])), size, np.concatenate(numbers), block)
        bounds = np.concatenate(([0], np.cumsum(length)))
        at = 0
        for i, a, b in todo:
            parts[i].append(data[bounds[at] : bounds[at + b - a]].tobytes())
            lengths[i].append(length[at : at + b - a])
            at += b - a
        todo.clear()

    have = 0
    for i, (block, starts, _) in enumerate(plans):
        for a in range(0, len(starts), FRAMES_AT_ONCE):
            b = min(a + FRAMES_AT_ONCE, len(starts))
            if have + b - a > FRAMES_AT_ONCE or (todo and plans[todo[0][0]][0] != block):
                flush()
                have = 0
            todo.append((i, a, b))
            have += b - a
    flush()
    out = []
    for p, (block, starts, sizes), part, length in zip(payloads, plans, parts, lengths, strict=True):
        ln = np.concatenate(length)
        samples = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = block.to_bytes(2, "big") * 2 + int(ln.min()).to_bytes(3, "big") + int(ln.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        points = np.zeros(len(starts), [("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
        points["s"], points["o"], points["n"] = starts, np.concatenate(([0], np.cumsum(ln)[:-1])), sizes
        table = points.tobytes()
        out.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(part))
    return out


@dataclass
class Stream:
    block: int
    total: int
    md5: bytes
    points: np.ndarray
    first: int  # where frames begin


def parse(media: bytes) -> Stream:
    """The metadata of a stream."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, None, None
    while not last:
        last, kind, size = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            points = np.frombuffer(body, [("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
        at += 4 + size
    if info is None or points is None:
        raise ValueError("a stream needs its information and its seek table")
    fields = int.from_bytes(info[10:18], "big")
    if (fields >> 41) & 7 or (fields >> 36) & 31 != 7:
        raise ValueError("only 8-bit mono streams are read")
    return Stream(int.from_bytes(info[2:4], "big"), fields & ((1 << 36) - 1), info[18:34], points[points["s"] != (1 << 64) - 1], at)


class _Bits:
    """Reads bits of many frames at once; pos: a bit position for each."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint64)
        self.words = np.zeros(len(data) + 8, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + len(self.words)] << np.uint64(56 - 8 * k)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        return self.words[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, width: np.ndarray) -> np.ndarray:
        w = np.asarray(width).astype(np.uint64)
        return np.where(w > 0, self.peek(pos) >> (np.uint64(64) - np.maximum(w, np.uint64(1))), np.uint64(0)).astype(np.int64)

    def unary(self, pos: np.ndarray) -> np.ndarray:
        q = _ZEROS16[(self.peek(pos) >> np.uint64(48)).astype(np.int64)]
        more = np.flatnonzero(q == 16)
        while len(more):
            step = _ZEROS16[(self.peek(pos[more] + q[more]) >> np.uint64(48)).astype(np.int64)]
            q[more] += step
            more = more[step == 16]
        return q


def _signed(value: np.ndarray, width: np.ndarray) -> np.ndarray:
    return np.where(value >> np.maximum(width - 1, 0) & 1, value - (np.int64(1) << width), value)


def _read(data: np.ndarray, start: np.ndarray, length: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Samples of frames, a row each, the shorter ones filled up with zeros."""
    if (crc16(data, start, length - 2) != (data[start + length - 2].astype(np.int64) << 8 | data[start + length - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    bits = _Bits(data)
    if ((data[start].astype(np.int64) << 8 | data[start + 1]) != 0xFFF8).any():
        raise ValueError("a frame does not begin where the seek table says")
    code = data[start + 2].astype(np.int64) >> 4
    lead = data[start + 4].astype(np.int64)
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    odd = np.select([code == 6, code == 7], [1, 2], 0)
    head = 4 + extra + odd
    if (crc8(data, start, head) != data[start + head]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    told = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7], [192, 576 << np.clip(code - 2, 0, 3), bits.take(8 * (start + 4 + extra), np.full(len(start), 8)) + 1, bits.take(8 * (start + 4 + extra), np.full(len(start), 16)) + 1], 256 << np.clip(code - 8, 0, 7))
    number = np.where(extra == 1, lead, lead & (np.int64(0x7F) >> extra))
    for k in range(1, 7):
        number = np.where(extra > k, number << 6 | data[np.minimum(start + 4 + k, len(data) - 1)] & 0x3F, number)
    if (told != sizes).any() or (number != numbers).any():
        raise ValueError("a frame header does not agree with the seek table")
    pos = 8 * (start + head + 1)
    kind = bits.take(pos, np.full(len(pos), 8))
    if (kind & 129).any():
        raise ValueError("unsupported subframe")
    kind = kind >> 1
    pos = pos + 8
    f, wide = len(start), int(sizes.max())
    out = np.zeros((wide, f), np.int64)
    fixed, lpc, verbatim, constant = (kind >= 8) & (kind <= 12), kind >= 32, kind == 1, kind == 0
    order = np.select([fixed, lpc], [kind - 8, kind - 31], 0)
    eight = np.full(f, 8)
    for i in range(int(order.max(initial=0))):
        own = order > i
        out[i, own] = _signed(bits.take(pos, eight), eight)[own]
        pos = pos + 8 * own
    for i in range(wide if verbatim.any() else 0):
        own = np.flatnonzero(verbatim & (sizes > i))
        out[i, own] = _signed(bits.take(pos[own], eight[own]), eight[own])
        pos[own] += 8
    if constant.any():
        out[:, constant] = _signed(bits.take(pos, eight), eight)[constant] * (np.arange(wide)[:, None] < sizes[constant])
    precision, shift = np.zeros(f, np.int64), np.zeros(f, np.int64)
    coef = np.zeros((int(order[lpc].max(initial=0)), f), np.int64)
    if lpc.any():
        precision = np.where(lpc, bits.take(pos, np.full(f, 4)) + 1, 0)
        shift = np.where(lpc, bits.take(pos + 4, np.full(f, 5)), 0)
        pos = pos + 9 * lpc
        for j in range(len(coef)):
            own = lpc & (order > j)
            coef[j, own] = _signed(bits.take(pos, precision), precision)[own]
            pos = pos + precision * own
    # Rice codes of all frames that have them, the longest frames first
    coded = np.flatnonzero(fixed | lpc)
    coded = coded[np.argsort(-sizes[coded], kind="stable")]
    if len(coded):
        n, o, p = sizes[coded], order[coded], pos[coded]
        method = bits.take(p, np.full(len(p), 2))
        if (method > 1).any():
            raise ValueError("unknown residual coding")
        parts = bits.take(p + 2, np.full(len(p), 4))
        p = p + 6
        span = n >> parts
        width = 4 + method
        k, escape = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64) - 1
        alive = len(coded)
        single = not parts.any()
        for i in range(int(n[0])):
            while alive and n[alive - 1] <= i:
                alive -= 1
            a = slice(0, alive)
            if i <= 32 or not single:
                new = (i == o[a]) | ((i % span[a] == 0) & (i > o[a]))
                if new.any():
                    got = bits.take(p[a], width[a])
                    p[a] += width[a] * new
                    raw_ = new & (got == (np.int64(1) << width[a]) - 1)
                    k[a] = np.where(new, got, k[a])
                    escape[a] = np.where(new, -1, escape[a])
                    if raw_.any():
                        escape[a] = np.where(raw_, bits.take(p[a], np.full(alive, 5)), escape[a])
                        p[a] += 5 * raw_
            q = bits.unary(p[a])
            low = bits.take(p[a] + q + 1, k[a])
            u = q << k[a] | low
            e = (u >> 1) ^ -(u & 1)
            step = q + 1 + k[a]
            if (escape[a] >= 0).any():
                plain = escape[a] >= 0
                w = np.maximum(escape[a], 0)
                e = np.where(plain, _signed(bits.take(p[a], w), w), e)
                step = np.where(plain, w, step)
            if i < 32:
                own = i >= o[a]
                out[i, coded[a][own]] = e[own]
                p[a] += step * own
            else:
                out[i, coded[a]] = e
                p[a] += step
    for o in range(1, 5):
        own = np.flatnonzero(fixed & (order == o))
        if len(own):
            s = out[:, own]
            head_ = s[:o].copy()
            for _ in range(o):
                head_[1:] -= head_[:-1].copy()
            s[:o] = head_
            for _ in range(o):
                s = np.cumsum(s, 0)
            out[:, own] = s * (np.arange(wide)[:, None] < sizes[own])
    for o in np.unique(order[lpc]):
        own = np.flatnonzero(lpc & (order == o))
        s, c, h = out[:, own], coef[:o, own], shift[own]
        for i in range(int(o), wide):
            s[i] += (c * s[i - o : i][::-1]).sum(0) >> h
        out[:, own] = s * (np.arange(wide)[:, None] < sizes[own])
    if (out < -128).any() or (out > 127).any():
        raise ValueError("a sample is out of range")
    return out.T


def _blocks(media: list[bytes], streams: list[Stream], ranges: list[tuple[int, int]]) -> list[bytes]:
    """Payload bytes of whole frames a to b of each stream."""
    out: list[list[bytes]] = [[] for _ in media]
    todo: list[tuple[int, int, int]] = []

    def flush() -> None:
        if not todo:
            return
        pieces, starts, lengths, sizes, numbers, at = [], [], [], [], [], 0
        for i, a, b in todo:
            s = streams[i]
            offsets = np.append(s.points["o"].astype(np.int64), len(media[i]) - s.first)[a : b + 1]
            if (np.diff(offsets) < 8).any() or offsets[0] < 0 or s.first + offsets[-1] > len(media[i]):
                raise ValueError("the seek table's offsets are wrong")
            piece = np.frombuffer(media[i], np.uint8, int(offsets[-1] - offsets[0]), s.first + int(offsets[0]))
            pieces.append(piece)
            starts.append(offsets[:-1] - offsets[0] + at)
            lengths.append(np.diff(offsets))
            sizes.append(s.points["n"][a:b].astype(np.int64))
            numbers.append(np.arange(a, b))
            at += len(piece)
        size = np.concatenate(sizes)
        rows = _read(np.concatenate(pieces), np.concatenate(starts), np.concatenate(lengths), size, np.concatenate(numbers))
        flat = (rows[np.arange(rows.shape[1]) < size[:, None]] + 128).astype(np.uint8).tobytes()
        at = 0
        for (i, _, _), z in zip(todo, sizes, strict=True):
            n = int(z.sum())
            out[i].append(flat[at : at + n])
            at += n
        todo.clear()

    have = 0
    for i, (first, end) in enumerate(ranges):
        for a in range(first, end, FRAMES_AT_ONCE):
            b = min(a + FRAMES_AT_ONCE, end)
            if have + b - a > FRAMES_AT_ONCE:
                flush()
                have = 0
            todo.append((i, a, b))
            have += b - a
    flush()
    return [b"".join(x) for x in out]


def decode(media: list[bytes]) -> list[bytes]:
    """The payloads of streams, all checks made."""
    streams = [parse(m) for m in media]
    out = _blocks(media, streams, [(0, len(s.points)) for s in streams])
    for p, s in zip(out, streams, strict=True):
        if len(p) != s.total or hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest() != s.md5:
            raise ValueError("the samples' MD5 is wrong")
    return out


def read_samples(media: bytes, start: int, count: int) -> bytes:
    """Payload bytes start to start + count, from the frames that hold them alone."""
    s = parse(media)
    start, end = min(max(start, 0), s.total), min(max(start + count, 0), s.total)
    if start >= end:
        return b""
    firsts = s.points["s"].astype(np.int64)
    a, b = int(np.searchsorted(firsts, start, "right")) - 1, int(np.searchsorted(firsts, end, "left"))
    return _blocks([media], [s], [(a, b)])[0][start - firsts[a] : end - firsts[a]]
