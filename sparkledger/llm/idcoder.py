"""Adaptive context-mixing range coder for token ids, many independent blocks at a time.

A frame holds ids of up to 2^24 different values. Its ids are replaced by their rank by frequency, and the ranks are cut
into blocks of BLOCK_IDS. Every block starts from the same reset model and has a checksum, so it can be decoded alone;
the blocks of a frame are coded side by side, one array element each, which is what makes the coder fast in numpy.

Model of a block, before each id:
  order 2  the id predicted from the two ids before it, with a confidence from 0 to 7 (a hashed table)
  order 1  the id predicted from the one before it, likewise
  order 0  an adaptive distribution over the bit length of the rank, uniform within a length; there are as many lengths as
           the frame's number of different ids has bits
The two confidences and whether the predictions agree select two adaptive probabilities (order 2 is right; else
order 1 is right), so that the weight of each order is learnt for each state of trust. What neither predicts goes to order 0.

Layout of a frame, little-endian:
  4 bytes magic, uint32 ids, uint32 different ids, uint32 block length, uint32 crc32 of the frame's other bytes after it
  different ids by rank, uint32 each
  for each block: uint32 crc32 of its ids (as uint32), uint32 number of 16-bit words
  the blocks' words
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"IDR2"
BLOCK_IDS = 1024
#: Bits of the tables of order 1 and 2, of a probability, and of the speeds of learning.
TABLE1, TABLE2, SCALE, FAST, SLOW = 9, 10, 12, 4, 5
ONE = 1 << SCALE
#: Probabilities stay at or above LEAST and, with the speed above, below ONE - 2 * LEAST + 1; a length keeps WIDTH at least.
LEAST, WIDTH = 15, 16
#: The range stays at or above FLOOR, so that the narrowest id still leaves one; TOP bounds what is pending.
FLOOR, TOP, PENDING = np.uint64(1 << 47), np.uint64(1 << 63), np.uint64((1 << 47) - 1)
#: With so many different values the narrowest id still leaves a range of one; up to FEW_VALUES a rank and its confidence fit 16 bits.
MOST_VALUES, FEW_VALUES = 1 << 24, 1 << 13
U = np.uint64


class Corrupt(ValueError):
    """The bytes aren't a whole frame."""


class Model:
    """The state of all blocks of a frame, one lane each; the arrays that a step makes have an element for each lane."""

    def __init__(self, lanes: int, values: int):
        lengths = max(1, values.bit_length())
        self.stride, self.lane = lanes, np.arange(lanes, dtype=np.int64)
        # entries hold the predicted rank times 8 plus the confidence, in half the memory where ranks are small
        self.kind = np.uint16 if values <= FEW_VALUES else np.uint32
        self.one, self.three, self.four, self.seven = (self.kind(k) for k in (1, 3, 4, 7))
        self.t1, self.t2 = np.zeros(lanes << TABLE1, self.kind), np.zeros(lanes << TABLE2, self.kind)
        # both probabilities of a state side by side: that of order 2 in the lower 16 bits
        self.p = np.full(lanes * 128, ONE // 2 << 16 | ONE // 2, np.int32)
        spread = ONE - lengths * WIDTH
        first = [round(k * (spread / lengths + WIDTH)) for k in range(lengths)] + [ONE]
        self.cdf = np.repeat(np.array(first, np.int16)[:, None], lanes, axis=1)
        self.flat = self.cdf.reshape(-1)
        #: The distribution moves to WIDTH for each length, and to all that is left for the one that is seen.
        self.steps, self.base, self.spread = np.arange(lengths + 1, dtype=np.int8)[:, None], (WIDTH * np.arange(lengths + 1, dtype=np.int16))[:, None], np.int16(spread)
        self.b1, self.b2, self.bs = self.lane << TABLE1, self.lane << TABLE2, self.lane << 7
        self.before, self.last = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def narrow(self, lanes: int) -> None:
        """From here on only the first lanes are coded."""
        for name in ("lane", "b1", "b2", "bs", "before", "last"):
            setattr(self, name, getattr(self, name)[:lanes])
        self.cdf = self.cdf[:, :lanes]

    def look(self) -> None:
        h = self.last * np.uint32(0x9E3779B1)
        self.i1 = self.b1 + (h >> np.uint32(32 - TABLE1))
        h += self.before * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        self.i2 = self.b2 + (h >> np.uint32(32 - TABLE2))
        self.e1, self.e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.c1, self.c2 = self.e1 & self.seven, self.e2 & self.seven
        self.s1, self.s2 = self.e1 >> self.three, self.e2 >> self.three
        state = self.c2 << self.four
        state |= self.c1 << self.one
        state |= self.s1 == self.s2
        self.state = self.bs + state
        both = self.p.take(self.state)
        self.q2, self.q1 = both & np.int32(0xFFFF), both >> np.int32(16)
        self.w2, self.w1 = self.q2.astype(U), self.q1.astype(U)

    def learn(self, rank: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, miss: np.ndarray, length: np.ndarray) -> None:
        """hit2, hit1, miss: whether order 2 is right, else order 1, else neither; length: of the rank."""
        top, least, moved = np.int32(ONE - 2 * LEAST), np.int32(LEAST), []
        for q, hit in ((self.q2, hit2), (self.q1, hit1)):
            step = hit * top
            step += least
            step -= q
            step >>= FAST
            moved.append(step)
        moved[1] *= ~hit2
        both = self.q1 + moved[1]
        both <<= np.int32(16)
        both += self.q2
        both += moved[0]
        self.p[self.state] = both
        goal = (self.steps > length) * self.spread
        goal += self.base
        goal -= self.cdf
        goal >>= SLOW
        goal *= miss
        self.cdf += goal
        new = rank << self.three
        new |= self.one
        for entries, at, e, right, sure in ((self.t1, self.i1, self.e1, self.s1 == rank, self.c1), (self.t2, self.i2, self.e2, hit2, self.c2)):
            # right: surer up to 7; wrong: less sure, or replaced
            wrong = ~right
            entry = e + (right & (sure < self.seven))
            entry -= wrong
            wrong &= sure <= self.one
            np.copyto(entry, new, where=wrong)
            entries[at] = entry
        self.before, self.last = self.last, rank.astype(np.uint32)


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float32))[1].astype(np.int8)


def lanes_of(n: int, block: int) -> tuple[int, int]:
    """How many blocks there are, and the ids of the last; all others are full."""
    return -(-n // block), n % block or block


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values by rank, and the rank of each id."""
    if len(ids) and int(ids.max()) < 1 << 20:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        values = values[np.argsort(-counts[values], kind="stable")]
        rank_of = np.zeros(len(counts), np.uint32)
        rank_of[values] = np.arange(len(values), dtype=np.uint32)
        return values.astype("<u4"), rank_of[ids]
    values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank_of = np.empty(len(values), np.uint32)
    rank_of[order] = np.arange(len(values), dtype=np.uint32)
    return values[order].astype("<u4"), rank_of[inverse.ravel()]


def encode(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """A frame of ids (any integers from 0 to 2^32 - 1, of up to MOST_VALUES different values; none is a frame as well)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    values, ranks = ranked(ids)
    if len(values) > MOST_VALUES:
        raise ValueError(f"a frame holds at most {MOST_VALUES} different ids")
    lanes, last = lanes_of(n, block) if n else (0, 0)
    model, m = Model(lanes, len(values)), lanes
    grid = np.zeros((lanes, block), model.kind)
    grid.ravel()[:n] = ranks
    grid = np.ascontiguousarray(grid.T)
    lengths = bit_length(grid + np.uint32(1)) - np.int8(1)
    low, size = np.zeros(lanes, U), np.full(lanes, TOP, U)
    # the words as they come, with the bit that a carry adds to the word before, and their lanes
    digits, owners, lane_kind = [], [], np.uint16 if lanes <= 1 << 16 else np.uint32
    for t in range(min(block, n)):
        if t == last and m == lanes:
            # the last block ends here: its state is set apart
            m = lanes - 1
            model.narrow(m)
            kept_low, low, size = low[m:], low[:m], size[:m]
            if not m:
                break
        model.look()
        rank, length = grid[t, :m], lengths[t, :m]
        b = length.astype(np.int64)
        hit2 = model.s2 == rank
        hit1 = (model.s1 == rank) & ~hit2
        miss = ~(hit2 | hit1)
        first = (size >> U(SCALE)) * model.w2
        rest = size - first
        second = (rest >> U(SCALE)) * model.w1
        unit = (rest - second) >> U(SCALE)
        at = b * model.stride + model.lane
        a = model.flat.take(at)
        bits = b.view(U)
        each = unit * (model.flat.take(at + model.stride) - a).astype(U)
        each >>= bits
        inner = rank.astype(U)
        inner += U(1)
        inner -= U(1) << bits
        inner *= each
        unit *= a.astype(U)
        inner += unit
        inner += second
        inner *= miss
        inner += first
        inner *= ~hit2
        low += inner
        size = each
        np.copyto(size, second, where=hit1)
        np.copyto(size, first, where=hit2)
        model.learn(rank, hit2, hit1, miss, length)
        # what a lane has pending stays under 2^64 until its next word, so carries wait for the end
        need = size < FLOOR
        if len(small := np.flatnonzero(need)):
            owners.append(small.astype(lane_kind))
            digits.append((low.take(small) >> U(47)).astype(np.uint32))
            shift = need.astype(U)
            low &= PENDING | (shift - U(1))
            shift <<= U(4)
            low <<= shift
            size <<= shift
            # few lanes need a second word
            while len(small := small[size.take(small) < FLOOR]):
                x = low.take(small)
                owners.append(small.astype(lane_kind))
                digits.append((x >> U(47)).astype(np.uint32))
                low[small] = (x & PENDING) << U(16)
                size[small] <<= U(16)
    if m < lanes:
        low = np.concatenate((low, kept_low))
    # four words more settle what is pending
    every = np.arange(lanes, dtype=lane_kind)
    for k in range(4):
        owners.append(every)
        digits.append((low >> U(47)).astype(np.uint32))
        low = (low & PENDING) << U(16)
    owner = np.concatenate(owners)
    words, used = np.concatenate(digits)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=lanes)
    while len(over := np.flatnonzero(words >> np.uint32(16))):
        words[over] &= np.uint32(0xFFFF)
        words[over - 1] += np.uint32(1)
    head = np.empty((lanes, 2), "<u4")
    own = ids.astype("<u4", copy=False)
    head[:, 0] = [zlib.crc32(own[at : at + block]) for at in range(0, n, block)]
    head[:, 1] = used
    body = np.array([n, len(values), block], "<u4").tobytes() + values.tobytes() + head.tobytes() + words.astype("<u2").tobytes()
    return MAGIC + zlib.crc32(body).to_bytes(4, "little") + body


def decode(data: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a frame (uint32), or those of one of its blocks. Raises Corrupt where a checksum or the length is wrong."""
    if data[:4] != MAGIC or len(data) < 20:
        raise Corrupt("not a frame of ids")
    if only is None and zlib.crc32(data[8:]) != int.from_bytes(data[4:8], "little"):
        raise Corrupt("the frame's checksum is wrong")
    n, different, block = (int(x) for x in np.frombuffer(data, "<u4", 3, 8))
    lanes, last = lanes_of(n, block) if n else (0, 0)
    if len(data) < 20 + 4 * different + 8 * lanes:
        raise Corrupt("the frame is cut off")
    values = np.frombuffer(data, "<u4", different, 20)
    head = np.frombuffer(data, "<u4", 2 * lanes, 20 + 4 * different).reshape(-1, 2)
    words = np.frombuffer(data[20 + 4 * different + 8 * lanes :], "<u2")
    if len(words) != head[:, 1].sum(dtype=np.int64):
        raise Corrupt("the frame is cut off")
    starts = np.concatenate(([0], np.cumsum(head[:, 1].astype(np.int64))[:-1])) if lanes else np.empty(0, np.int64)
    sizes = np.full(lanes, block)
    if lanes:
        sizes[-1] = last
    chosen = np.arange(lanes) if only is None else np.array([only])
    sizes = sizes[chosen]
    grid = decode_lanes(np.concatenate((words, np.zeros(4, "<u2"))), starts[chosen], sizes, different)
    columns, parts = np.ascontiguousarray(grid.T), []
    for k, (lane, size) in enumerate(zip(chosen.tolist(), sizes.tolist())):
        ranks = columns[k, :size]
        if len(ranks) and ranks.max() >= different:
            raise Corrupt(f"block {lane} is damaged")
        part = values[ranks]
        if zlib.crc32(part) != int(head[lane, 0]):
            raise Corrupt(f"the checksum of block {lane} is wrong")
        parts.append(part)
    return np.concatenate(parts).astype(np.uint32, copy=False) if parts else np.empty(0, np.uint32)


def decode_lanes(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, different: int) -> np.ndarray:
    """Ranks by place and block. All blocks but the last have the largest size."""
    lanes = len(at)
    most = int(sizes.max(initial=0))
    model, m = Model(lanes, different), lanes
    grid = np.zeros((most, lanes), model.kind)
    at, limit = at.copy(), len(words) - 1
    code = np.zeros(lanes, U)
    # the top 63 bits: three words and 15 bits of the fourth, so from there each word comes one bit late
    for k in range(4):
        code = code << U(16) | words[np.minimum(at + k, limit)].astype(U)
    code >>= U(1)
    late = words >> np.uint16(1)
    late[1:] |= words[:-1] << np.uint16(15)
    at += 4
    size = np.full(lanes, TOP, U)
    for t in range(most):
        if m == lanes and t == sizes[-1]:
            m -= 1
            model.narrow(m)
            code, size, at = code[:m], size[:m], at[:m]
            if not m:
                break
        model.look()
        first = (size >> U(SCALE)) * model.w2
        hit2 = code < first
        rest = size - first
        second = (rest >> U(SCALE)) * model.w1
        inner = code - first
        hit1 = (inner < second) & ~hit2
        miss = ~(hit2 | hit1)
        unit = (rest - second) >> U(SCALE)
        deep = inner - second
        # lanes without a miss look for a place that isn't used
        target = deep // unit
        target *= miss
        target = np.minimum(target, U(ONE - 1)).astype(np.int16)
        length = np.add.reduce(model.cdf <= target, axis=0, dtype=np.int8)
        length -= np.int8(1)
        b = length.astype(np.int64)
        place = b * model.stride + model.lane
        a = model.flat.take(place)
        bits = b.view(U)
        each = unit * (model.flat.take(place + model.stride) - a).astype(U)
        each >>= bits
        unit *= a.astype(U)
        deep -= unit
        power = U(1) << bits
        power -= U(1)
        offset = deep // each
        offset *= miss
        np.minimum(offset, power, out=offset)
        deep -= each * offset
        power += offset
        rank = power.astype(model.kind)
        np.copyto(rank, model.s1, where=hit1)
        np.copyto(rank, model.s2, where=hit2)
        np.copyto(deep, inner, where=hit1)
        np.copyto(code, deep, where=~hit2)
        size = each
        np.copyto(size, second, where=hit1)
        np.copyto(size, first, where=hit2)
        grid[t, :m] = rank
        model.learn(rank, hit2, hit1, miss, length)
        need = size < FLOOR
        if len(small := np.flatnonzero(need)):
            shift = need.astype(U)
            shift <<= U(4)
            code <<= shift
            size <<= shift
            code[small] |= late.take(at.take(small), mode="clip")
            at += need
            while len(small := small[size.take(small) < FLOOR]):
                code[small] = code.take(small) << U(16) | late.take(at.take(small), mode="clip")
                size[small] <<= U(16)
                at[small] += 1
    return grid
