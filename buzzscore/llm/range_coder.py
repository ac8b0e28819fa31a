"""An adaptive context-mixing range coder for blocks of token ids, many blocks at a time.

A block is coded on its own: its model and its coder start anew.  An id is
predicted by three orders:

* order 2 and order 1 name one id each, the one that last followed the same two
  ids or the same id (in a hashed table), with a confidence that rises with a
  hit and falls with a miss;
* order 0 is the distribution of the block's ids so far, as their sorted list,
  renewed whenever the block has twice as many.

How often an order was right at each confidence is learned as the block goes
on, and these rates are mixed into the probabilities of four choices: the id of
order 2, that of order 1, an id of the list, or any other.  Orders that name
one id add up.  The choice, and then the place in the list or the id itself,
are coded by a carryless range coder of 64 bits that puts out 16 at a time.
All totals are powers of two.

Blocks are the lanes of numpy arrays: step ``t`` codes the ``t``-th id of all
of them.  Encoder and decoder run the same model.
"""

from __future__ import annotations

import numpy as np

SLOT_BITS = 11
TOTAL_BITS = 12  # of the choice's frequencies
TOTAL = 1 << TOTAL_BITS
FIRST_LIST = 16
#: Lanes whose ids are looked up in their lists at a time.
PLACED = 128
#: Steps that the encoder takes through each of its parts at a time.
STRIDE = 64
U = np.uint64
_TOP, _BOT, _WORD, _TOTAL_BITS = U(1 << 48), U(1 << 32), U(16), U(TOTAL_BITS)
_HALF, _LOW = U(32), U(0xFFFFFFFF)
_NONE = 1 << 28  # no id yet
_ONE, _TWO, _SHIFT = np.uint32(2654435761), np.uint32(2246822519), np.uint32(32 - SLOT_BITS)
# an order's confidence if it is right, 4 and the confidence if it is wrong: where its rate goes, and what its entry gains
_RATE = np.array([3968] * 4 + [32] * 4, np.int32)
_GAIN = np.array([1, 1, 1, 0, 0, -1, -1, -1], np.int32)
# of each choice: where the rate of the list goes, and whether it moves
_LISTED, _SEEN = np.array([0, 0, 4064, 32], np.int32), np.array([0, 0, -1, -1], np.int32)
# the bits of each choice's place, by those of the lists' places
_BITS = [np.array([0, 0, n, 16], U) for n in range(28)]


class _Model:
    """What is known of the lanes' ids so far."""

    def __init__(self, lanes: int):
        # orders 2 and 1 after each other, so that a step takes both at once
        self.base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) << SLOT_BITS
        # id * 4 + confidence; a slot of each order
        self.table = np.full(2 * lanes << SLOT_BITS, _NONE * 4, np.int32)
        self.rate_base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) * 4
        self.rates = np.concatenate([np.tile(np.array(r, np.int32), lanes) for r in ([400, 1600, 2600, 3600], [300, 1000, 1800, 3000])])
        self.listed = np.full(lanes, TOTAL // 2, np.int32)
        self.room = [np.empty((2, lanes), np.int32) for _ in range(2)]

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where orders 2 and 1 look after the ids ``b, a``; a row of both for each row of ``a``."""
        out = np.empty((len(a), 2, a.shape[1]), np.uint32)
        np.multiply(a, _ONE, out=out[:, 1])
        np.multiply(out[:, 1] ^ b, _TWO, out=out[:, 0])
        return (out >> _SHIFT) + self.base

    def learn(self, at: np.ndarray, entry: np.ndarray, x4: np.ndarray, key: np.ndarray) -> None:
        """Set ``key``, and let the slots know the ids ``x4 / 4``: a hit raises the confidence, a miss lowers it."""
        differ, gain = self.room
        np.bitwise_and(entry, 3, out=key)
        np.bitwise_or(key, 4, out=key)
        np.bitwise_xor(entry, x4, out=differ)  # of equal ids the confidence, else more than the key of a miss
        np.minimum(key, differ, out=key)
        _GAIN.take(key, out=gain, mode="clip")
        gain += entry
        np.copyto(gain, x4, where=key == 4)  # without any confidence left the id gives way
        self.table[at] = gain

    def rate(self, spot: np.ndarray, rate: np.ndarray, key: np.ndarray) -> None:
        goal = self.room[0]
        _RATE.take(key, out=goal, mode="clip")
        goal -= rate
        goal >>= 4
        goal += rate
        self.rates[spot] = goal

    def move_listed(self, choice: np.ndarray) -> None:
        goal = _LISTED.take(choice)
        goal -= self.listed & _SEEN.take(choice)
        goal >>= 5
        self.listed += goal

    @staticmethod
    def edges(rate: np.ndarray, same: np.ndarray, listed: np.ndarray | None, out: np.ndarray) -> None:
        """Set the three bounds between the choices: order 2, order 1, list, other; ``same`` if both orders name one id."""
        two, one = rate[..., 0, :], rate[..., 1, :]
        upto2, upto1, upto0 = out
        np.subtract(TOTAL, two, out=upto1)
        upto1 *= one
        upto1 >>= TOTAL_BITS
        upto1 += two
        upto2[:] = two
        np.copyto(upto2, upto1, where=same)
        if listed is None:
            upto0[:] = upto1
            return
        rest = TOTAL - upto1
        np.multiply(rest, listed, out=upto0)
        upto0 >>= TOTAL_BITS
        rest -= 1
        np.minimum(upto0, rest, out=upto0)
        np.maximum(upto0, 1, out=upto0)
        upto0 += upto1


def _renewed(t: int) -> bool:
    """Whether the lists are renewed before step ``t``: from the ids so far, a power of two."""
    return t >= FIRST_LIST and t & (t - 1) == 0


class _Coder:
    """The interval of each lane."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, U(0xFFFFFFFFFFFFFFFF))
        self.unit, self.part = np.empty(lanes, U), np.empty(lanes, U)

    def narrow(self, start: np.ndarray, size: np.ndarray, bits: np.ndarray | np.uint64) -> None:
        np.right_shift(self.range, bits, out=self.unit)
        np.multiply(start, self.unit, out=self.part)
        self.low += self.part
        np.multiply(size, self.unit, out=self.range)

    def settle(self) -> None:
        """Move the words that no longer change out of the intervals, so that these stay wide."""
        lanes = None
        low, rng = self.low, self.range
        while True:
            ends = low + rng
            ends ^= low
            settled = ends < _TOP
            small = rng < _BOT
            small |= settled
            move = small.nonzero()[0]
            if not len(move):
                return
            lanes = move if lanes is None else lanes.take(move)
            low, rng = low.take(move), rng.take(move)
            settled = settled.take(move)
            if not settled.all():
                rng = np.where(settled, rng, (U(0) - low) & (_BOT - U(1)))
            self.word(lanes, low)
            low <<= _WORD
            rng <<= _WORD
            self.low[lanes], self.range[lanes] = low, rng


class _Encoder(_Coder):
    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.out: list[tuple[np.ndarray, np.ndarray]] = []
        self.kind = np.uint16 if lanes <= 1 << 16 else np.uint32

    def word(self, lanes: np.ndarray, low: np.ndarray) -> None:
        self.out.append((lanes.astype(self.kind), (low >> U(48)).astype("<u2")))

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for shift in (0, 16, 32, 48):
            self.word(every, self.low << U(shift))
        lanes = np.concatenate([x for x, _ in self.out])
        words = np.concatenate([x for _, x in self.out])
        self.out = []
        words = words[np.argsort(lanes, kind="stable")].tobytes()
        ends = 2 * np.cumsum(np.bincount(lanes, minlength=len(every)))
        return [words[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


class _Decoder(_Coder):
    def __init__(self, blocks: list[bytes]):
        super().__init__(len(blocks))
        self.data = np.zeros((len(blocks), max(len(b) for b in blocks) // 2 + 8), np.uint16)
        for i, b in enumerate(blocks):
            self.data[i, : len(b) // 2] = np.frombuffer(b, "<u2", len(b) // 2)
        self.code = np.zeros(len(blocks), U)
        for k in range(4):
            self.code = self.code << _WORD | self.data[:, k].astype(U)
        # the next word of each lane, and its last
        self.next = np.arange(len(blocks)) * self.data.shape[1] + 4
        self.last = self.next + (self.data.shape[1] - 5)
        self.data = self.data.ravel()

    def word(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.next.take(lanes)
        code = self.code.take(lanes)
        code <<= _WORD
        code |= self.data.take(np.minimum(at, self.last.take(lanes)))
        self.code[lanes] = code
        at += 1
        self.next[lanes] = at

    def value(self, bits: np.ndarray | np.uint64) -> np.ndarray:
        # a damaged block may point outside: the checksum of its ids will tell
        np.right_shift(self.range, bits, out=self.unit)
        np.maximum(self.unit, U(1), out=self.unit)
        np.subtract(self.code, self.low, out=self.part)
        return np.minimum(self.part // self.unit, (U(1) << bits) - U(1))


def encode(ids: np.ndarray) -> list[bytes]:
    """The coded rows of ``ids`` (blocks x steps), each less than 2^28; ids of 2^16 and more take another half."""
    lanes, steps = ids.shape
    ids = np.ascontiguousarray(ids, np.int32)
    wide = _wide(int(ids.max(initial=0)))
    coder, model = _Encoder(lanes), _Model(lanes)
    columns = np.zeros((steps + 2, lanes), np.int32)  # two before the first
    columns[2:] = ids.T
    size_bits, t = -1, 0
    if steps > FIRST_LIST:
        number = _numbered(ids)
        counts = np.zeros(int(number.max(initial=-1)) + 1, np.int32)
        new, every = 0, np.arange(lanes, dtype=np.int32)
    while t < steps:
        if _renewed(t):
            begin, size_bits = t, t.bit_length() - 1
            counts += np.bincount(number[new:t].ravel(), minlength=len(counts)).astype(np.int32)
            new = t
            # how many ids of the lane's list are less, and how many equal; a list has t ids
            before = (np.cumsum(counts) - counts).astype(np.int32)
            asked = number[t : 2 * t]
            first, size = before.take(asked) - every * t, counts.take(asked)
        # as far as the lists stay
        n = min(STRIDE, steps - t, (FIRST_LIST if size_bits < 0 else 2 * begin) - t)
        x = columns[t + 2 : t + 2 + n]
        in_lists = (first[t - begin : t - begin + n], size[t - begin : t - begin + n], size_bits) if size_bits >= 0 else None
        _encode_some(coder, model, x, columns[t + 1 : t + 1 + n], columns[t : t + n], in_lists, wide)
        t += n
    return coder.finish()


def _encode_some(coder: _Encoder, model: _Model, x: np.ndarray, a: np.ndarray, b: np.ndarray, in_lists: tuple | None, wide: int) -> None:
    """Some steps ``x``, after ``b, a``: the orders' slots, their rates, the list's rate, the choices, the intervals."""
    n, lanes = x.shape
    at = model.slots(a.view(np.uint32), b.view(np.uint32))
    x4 = x << 2
    entry, key = np.empty((n, 2, lanes), np.int32), np.empty((n, 2, lanes), np.int32)
    for t in range(n):
        model.table.take(at[t], out=entry[t], mode="clip")
        model.learn(at[t], entry[t], x4[t], key[t])
    spot = (key & 3) + model.rate_base
    rate = np.empty((n, 2, lanes), np.int32)
    for t in range(n):
        model.rates.take(spot[t], out=rate[t], mode="clip")
        model.rate(spot[t], rate[t], key[t])
    right = key < 4
    free = ~(right[:, 0] | right[:, 1])
    listed = None
    start, width = np.where(free, x & 0xFFFF, 0), 1
    bits = np.where(free, U(16), U(0))
    choice = np.where(right[:, 0], 0, np.where(right[:, 1], 1, 3))
    if in_lists:
        first, size, size_bits = in_lists
        there = free & (size > 0)
        choice -= there
        free &= ~there
        listed = np.empty((n, lanes), np.int32)
        for t in range(n):
            listed[t] = model.listed
            model.move_listed(choice[t])
        start = np.where(there, first, start)
        width = np.where(there, size, 1)
        bits = np.where(there, U(size_bits), bits)
    bounds = np.zeros((5, n, lanes), np.int32)
    bounds[4] = TOTAL
    model.edges(rate, (entry[:, 0] ^ entry[:, 1]) < 4, listed, bounds[1:4])
    at = choice * x.size + np.arange(x.size).reshape(x.shape)
    lower = bounds.take(at)
    part = (bounds.take(at + x.size) - lower).astype(U)
    lower, start, width = lower.astype(U), start.astype(U), np.broadcast_to(np.asarray(width), x.shape).astype(U)
    for t in range(n):
        coder.narrow(lower[t], part[t], _TOTAL_BITS)
        coder.narrow(start[t], width[t], bits[t])
        coder.settle()
        if wide:
            coder.narrow(np.where(free[t], x[t] >> 16, 0).astype(U), U(1), np.where(free[t], U(wide), U(0)))
            coder.settle()


def _numbered(ids: np.ndarray) -> np.ndarray:
    """``ids`` as numbers (steps x lanes) that ascend by lane and id, without gaps."""
    lanes, steps = ids.shape
    out, upto = np.empty((steps, lanes), np.int32), 0
    for begin in range(0, lanes, PLACED):
        part = ids[begin : begin + PLACED]
        ranked = np.sort((part.astype(np.int64) << 32) + np.arange(steps), axis=1)
        new = np.ones(ranked.shape, bool)
        new[:, 1:] = np.diff(ranked >> 32, axis=1) != 0
        at = ((ranked & 0xFFFFFFFF) * lanes + np.arange(begin, begin + len(part))[:, None]).ravel()
        out.ravel()[at] = np.cumsum(new.ravel()) + (upto - 1)
        upto += int(new.sum())
    return out


def _wide(largest: int) -> int:
    """Bits of the second half of ids up to ``largest``."""
    return max(0, largest.bit_length() - 16)


def _listing(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``ids`` (steps x lanes) each lane's list; at each place the first of its id (high half), and how often it is there."""
    listed = np.sort(ids.T, axis=1)
    new = np.ones(listed.shape, bool)
    new[:, 1:] = listed[:, 1:] != listed[:, :-1]
    begins = np.flatnonzero(new)
    size = np.diff(begins, append=new.size)
    span = (begins & (len(ids) - 1)) << 32 | size
    return listed.ravel(), np.repeat(span.astype(U), size)


def decode(blocks: list[bytes], steps: int, largest: int) -> np.ndarray:
    """The ids that :func:`encode` coded, ``steps`` of each block; ``largest`` is the largest of all."""
    lanes, wide = len(blocks), _wide(largest)
    coder, model = _Decoder(blocks), _Model(lanes)
    out = np.zeros((steps + 2, lanes), np.int32)  # two before the first
    entry, key, rate = (np.empty((2, lanes), np.int32) for _ in range(3))
    every, size_bits = np.arange(lanes), -1
    bounds = np.zeros((5, lanes), np.int64)  # of the choices
    bounds[4] = TOTAL
    rows, listing = lanes * np.arange(4), None
    for t in range(steps):
        if _renewed(t):
            size_bits = t.bit_length() - 1
            listing = _listing(out[2 : t + 2])
            lane_begins = every << size_bits
        at = model.slots(out[t + 1 : t + 2].view(np.uint32), out[t : t + 1].view(np.uint32))[0]
        model.table.take(at, out=entry, mode="clip")
        spot = entry & 3
        spot = spot + model.rate_base
        model.rates.take(spot, out=rate, mode="clip")
        model.edges(rate, (entry[0] ^ entry[1]) < 4, model.listed if listing else None, bounds[1:4])
        np.right_shift(coder.range, _TOTAL_BITS, out=coder.unit)
        inside = bounds.view(U) * coder.unit
        np.subtract(coder.code, coder.low, out=coder.part)
        beyond = (coder.part >= inside[1:4]).view(np.int8)
        choice = beyond[0] + beyond[1]
        choice += beyond[2]
        spots = rows.take(choice)
        spots += every
        lower = inside.take(spots)
        spots += lanes
        coder.low += lower
        np.subtract(inside.take(spots), lower, out=coder.range)
        free = choice == 3
        bits = _BITS[max(size_bits, 0)].take(choice)
        place = coder.value(bits)
        p = place.astype(np.int32)
        named = entry >> 2
        x = np.where(choice == 0, named[0], named[1])
        np.copyto(x, p, where=free)
        width: np.ndarray | int = 1
        if listing:
            in_list = choice == 2
            some = lane_begins + np.where(in_list, p, 0)
            ids, spans = listing
            np.copyto(x, ids.take(some), where=in_list)
            span = spans.take(some)
            np.copyto(place, span >> _HALF, where=in_list)
            width = np.where(in_list, span & _LOW, U(1))
        # the place of the orders' choices is of no bits: 0
        coder.narrow(place, width, bits)
        coder.settle()
        if wide:
            bits = np.where(free, U(wide), U(0))
            top = coder.value(bits)
            coder.narrow(top, U(1), bits)
            coder.settle()
            x = np.where(free, top.astype(np.int32) << 16 | x, x)
        model.learn(at, entry, x << 2, key)
        model.rate(spot, rate, key)
        if listing:
            model.move_listed(choice)
        out[t + 2] = x
    return np.ascontiguousarray(out[2:].T)
