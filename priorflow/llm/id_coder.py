"""Adaptive context-mixing range coder for token ids, in independently reset blocks.

A file's ids are first named by *rank*: ids of like frequency in the file together, the most
frequent first. For each rank the model

* guesses the rank last seen after the two ranks before (order 2) or, where there is none,
  after the one before (order 1), or else the file's most frequent (order 0). How sure the
  guess is comes from three predictions, mixed in the logistic domain with weights that
  learn from each answer: how often in a row order 2 held here, how often order 1 did and
  whether it agrees, and how order 0 fares with ranks of the guess's size;
* takes the order-1 rank, if that is another, as its second guess, with a share of what the
  first leaves;
* gives the rest to order 0: an adaptive distribution over bins of ranks, counted anew every
  few ids, from what the whole file has. Bins are half a power of two wide, so ranks in one
  are nearly equally frequent: a place in it has equal chances, which plain bits code.

One step of the range coder (48-bit range, 16-bit words, carries added up at the end) codes
which of these it is. Every block starts from the same model, known from the file's head,
and carries the crc32 of its ids. Blocks of a file are independent, so they are worked in
step, one numpy lane each, without branches; only weights and coder go id by id in the encoder,
which knows all ids ahead. All model arithmetic is in integers, so every
machine decodes alike.

File image: ``IDCM`` and then little-endian unsigned 32-bit integers: version, vocabulary
size, block size, number of blocks, bytes of the rank table and their crc32; for each block
ids, coder words, plain words and crc32; the rank table (zlib: number of bins, ids in each
bin, all ids as steps from the one before); then each block's coder words and plain words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
_MAGIC, _VERSION = b"IDCM", 3
_SLOTS = 1024
_NONE = -1  # packed slot of no rank yet: rank -1, run 15
_FRESH = 64  # steps between counts of the bins
_SOME = 1 << 19  # ids counted together
_LANES = 256  # lanes whose contexts are looked up together
_LOW32, _LOW48 = (1 << 32) - 1, (1 << 48) - 1
_SQUASH = np.clip(np.rint(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 61440).astype(np.int32)

#: Ranks below 4 alone, then two bins for each power of two.
_N_BINS = 36
_BITS = np.maximum(np.arange(_N_BINS) // 2 - 1, 0)
_START = np.where(np.arange(_N_BINS) < 4, np.arange(_N_BINS), (2 + np.arange(_N_BINS) % 2) << _BITS)

#: Runs that held, up to 14, and 15 for an empty slot.
_RUNS, _RUN_END = np.arange(16), 14
#: Weights at a block's start, for each run where both orders agree and where they don't.
_START1 = np.stack((np.where(_RUNS < 2, -7500 + 4400 * _RUNS, -1000), np.where(_RUNS < 1, -6500, -4400)), axis=1).ravel().astype(np.int32)
_START2 = np.stack((np.where(_RUNS < 1, -3300, 2300 + 900 * _RUNS), np.where(_RUNS < 1, -7400, -1400 + 1100 * np.minimum(_RUNS, 4) + 700 * _RUNS)), axis=1).ravel().astype(np.int32)
_START1[30:], _START2[30:] = (-9000, -11800), (-4000, 0)
#: The second guess's share, in 4096ths, of what the first leaves; none where they are one.
_SHARE = np.stack((0 * _RUNS, np.where(_RUNS < 1, 110, 420)), axis=1).ravel().astype(np.int32)
_SHARE[31] = 1


class _Ranks:
    """The ids by rank, and how many ids of the file fall in each bin."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts
        self.n = len(counts)
        self.bin_of = np.repeat(np.arange(self.n), np.diff(np.append(_START[: self.n], max(len(ids), 1)))).astype(np.uint8)

    @classmethod
    def of(cls, ids: np.ndarray, vocabulary: int) -> _Ranks:
        times = np.zeros(vocabulary, np.int64)
        for k in range(0, len(ids), _SOME):
            times += np.bincount(ids[k : k + _SOME], minlength=vocabulary)
        used = np.flatnonzero(times)
        by_size = used[np.lexsort((used, -np.floor(4 * np.log2(times[used]))))]
        n = int(np.searchsorted(_START, max(len(by_size), 1)))
        return cls(by_size, np.add.reduceat(times[by_size], _START[:n]))

    def pack(self) -> bytes:
        return zlib.compress(np.concatenate(([self.n], self.counts, np.diff(self.ids, prepend=0))).astype("<i4").tobytes())

    @classmethod
    def unpack(cls, packed: bytes) -> _Ranks:
        numbers = np.frombuffer(zlib.decompress(packed), "<i4").astype(np.int64)
        n = int(numbers[0])
        return cls(np.cumsum(numbers[n + 1 :]), numbers[1 : n + 1])


class _Model:
    """States of all lanes, flat; an entry of all lanes lies together, as lanes often need the same.

    No place is out of range, so numpy's unchecked ``clip`` only saves time. What a context holds
    packs the rank last seen there and how often it held in a row (4 bits). Where :meth:`guess`
    and :meth:`bounds` take many steps at once, the lanes are their arrays' last axis.
    """

    def __init__(self, lanes: int, ranks: _Ranks):
        self.n, self.lanes, self.lane = ranks.n, lanes, np.arange(lanes)
        self.bin_of = ranks.bin_of.astype(np.intp)
        self.mix0 = (self.bin_of + 64) * lanes  # where a rank's weights begin in ``mix``, after the 32 of each order's run
        self.mix = np.concatenate((np.repeat(_START1, lanes), np.repeat(_START2, lanes), np.zeros(self.n * lanes, np.int32)))
        start = 4 + ranks.counts * 1020 // max(int(ranks.counts.sum()), 1)
        self.seen = np.repeat(start.astype(np.int32), lanes)
        self.sums = np.zeros((self.n + 1) * lanes, np.int32)
        self.met: list[np.ndarray] = []  # places in ``seen`` since it was last brought up to date

    def count(self, step: int) -> None:
        """Sums of the order-0 bins in 2048ths, anew every ``_FRESH`` steps."""
        if step % _FRESH:
            return
        if self.met:
            met = np.concatenate(self.met)
            self.seen += np.bincount(met, minlength=len(self.seen) + 1)[:-1].astype(np.int32) << 4
            self.met.clear()
        n, row = self.n, self.sums.reshape(self.n + 1, -1)
        row[0] = 0
        np.cumsum(self.seen.reshape(n, -1), axis=0, out=row[1:])
        row *= 2048 - n
        row //= row[-1] // (2048 - n)
        row += np.arange(n + 1, dtype=np.int32)[:, None]
        if step % 256 == 192:
            self.seen -= self.seen >> 1

    def guess(self, held: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First guess, second guess and its share, by what order 1 and order 2 hold; ``x`` gets the places of their weights."""
        second, first = held >> 4
        first ^= (first ^ second) & (held[1] >> 31)
        run = held & 15
        run += run
        run += second != first
        share = _SHARE.take(run[0], mode="clip")
        run[1] += 32
        np.multiply(run, self.lanes, out=x[:2])
        x[:2] += self.lane
        np.maximum(first, 0, out=first)
        np.add(self.mix0.take(first, mode="clip"), self.lane, out=x[2])
        return first, second, share

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights at ``x``, and the first guess's chance in 65536ths."""
        weights = self.mix.take(x, mode="clip")
        total = weights[0] + weights[1]
        total += weights[2]
        total += 32752
        total >>= 4
        return weights, _SQUASH.take(total, mode="clip")

    def learn(self, x: np.ndarray, weights: np.ndarray, hit: np.ndarray, p: np.ndarray) -> None:
        """``hit``: -1 where the first guess held, or 0."""
        move = hit & 65536
        move -= p
        move >>= 4
        weights -= weights >> 7
        weights[:2] += move
        move >>= 2
        weights[2] += move
        self.mix[x] = weights

    def bounds(self, p: np.ndarray, base: np.ndarray, left: np.ndarray, place: np.ndarray, hit: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size, in 65536ths, of what ``hit`` and ``rest`` (masks, 0 or -1) say was met."""
        begin = self.sums.take(place, mode="clip")
        finish = self.sums.take(place + self.lanes, mode="clip")
        for bound in (begin, finish):
            bound *= left
            bound >>= 11
            bound += base
        second = ~(hit | rest)
        begin &= rest
        begin |= p & second
        finish &= rest
        finish |= p & hit
        finish |= base & second
        finish -= begin
        return begin, finish


def _hash(ranks: np.ndarray) -> np.ndarray:
    return ranks * np.int32(0x2545F491) >> 19 & (_SLOTS - 1)


def _held(slot: np.ndarray, now: np.ndarray) -> np.ndarray:
    """What each rank of ``now`` (a row for each lane) finds in its ``slot``: packed as in the model."""
    rows, block = now.shape
    place = np.arange(block, dtype=np.int32)
    width = (block - 1).bit_length()
    key = slot.astype(np.int32 if width <= 20 else np.int64) << width
    key |= place
    key.sort(axis=1)
    at = np.arange(0, rows * block, block)[:, None] + (key & ((1 << width) - 1))
    key >>= width
    met = now.ravel().take(at, mode="clip")
    again = np.zeros(now.shape, bool)  # the slot was met before
    np.equal(key[:, 1:], key[:, :-1], out=again[:, 1:])
    other = np.ones(now.shape, bool)  # or held another rank
    np.not_equal(met[:, 1:], met[:, :-1], out=other[:, 1:])
    other |= ~again
    begun = place * other
    np.maximum.accumulate(begun, axis=1, out=begun)
    run = np.subtract(place, begun, out=begun)
    np.minimum(run, _RUN_END, out=run)
    run |= met << 4
    # the rank before left this; _NONE where the slot is new
    run += 1
    again = again.ravel()
    found = np.zeros(rows * block, np.int32)
    np.multiply(run.ravel()[:-1], again[1:], out=found[1:])
    found -= 1
    out = np.empty(rows * block, np.int32)
    out[at.ravel()] = found
    return out.reshape(rows, block)


def encode(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> bytes:
    """The file image of ``ids``, all below ``vocabulary``."""
    if not 0 < vocabulary <= 1 << 18:
        raise ValueError("vocabularies of 1 to 262144 ids are supported")
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError("an id is outside the vocabulary")
    lanes = -(-len(ids) // block)
    if not lanes:
        return _MAGIC + struct.pack("<6I", _VERSION, vocabulary, block, 0, 0, 0)
    ranks = _Ranks.of(ids, vocabulary)
    rank_of = np.zeros(vocabulary, np.int32)
    rank_of[ranks.ids] = np.arange(len(ranks.ids))
    sizes = np.full(lanes, block, np.int64)
    sizes[-1] = len(ids) - (lanes - 1) * block
    steps = int(sizes.max())
    # what contexts hold depends on the ids alone, so it is found ahead, for some lanes at once
    grid, found = np.empty((steps, lanes), np.int32), np.empty((2, steps, lanes), np.int32)
    for k in range(0, lanes, _LANES):
        some = ids[k * block : (k + _LANES) * block]
        now = np.zeros((min(_LANES, lanes - k), steps + 16), np.int32)  # wider, as rows a power of two apart share places in caches
        whole = len(some) // block
        now[:whole, :steps] = rank_of.take(some[: whole * block]).reshape(whole, block)[:, :steps]
        now[whole:, : len(some) - whole * block] = rank_of.take(some[whole * block :])
        slot1, slot2 = np.zeros((2, *now.shape), np.int32)
        slot1[:, 1:] = slot2[:, 1:] = _hash(now[:, :-1])
        slot2[:, 2:] ^= slot1[:, 1:-1] * 21 + 7 & (_SLOTS - 1)
        for a, b in ((grid, now), (found[0], _held(slot1, now)), (found[1], _held(slot2, now))):
            a[:, k : k + _LANES] = b[:, :steps].T
    bits, start = _BITS.astype(np.int32), _START.astype(np.int32)
    model = _Model(lanes, ranks)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    # words in the order (place, lane), as lanes stand at nearly the same place
    coded, plain = np.zeros((block + 2) * lanes, np.int32), np.zeros((block + 1) * lanes, np.int32)
    end, bit_end = model.lane.copy(), model.lane.copy()
    held, n_held = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for j in range(0, steps, _FRESH):
        model.count(j)
        now = grid[j : j + _FRESH]
        x, p = np.empty((len(now), 3, lanes), np.intp), np.empty(now.shape, np.int32)
        first, second, share = model.guess(found[:, j : j + _FRESH], x.swapaxes(0, 1))
        hit = -(first == now).astype(np.int32)
        rest = ~(hit | -(second == now).astype(np.int32))
        for i in range(len(now)):
            weights, p[i] = model.predict(x[i])
            model.learn(x[i], weights, hit[i], p[i])
        base = p + ((65536 - p) * share >> 12)
        at = model.bin_of.take(now, mode="clip")
        place = at * lanes + model.lane
        begin, size = (a.astype(np.int64) for a in model.bounds(p, base, 65536 - base, place, hit, rest))
        model.met.append(np.where(rest, place, len(model.seen)).ravel())
        n_bits, bit = bits.take(at, mode="clip") & rest, (now - start.take(at, mode="clip")) & rest
        for i in range(len(now)):
            m = lanes if j + i < sizes[-1] else lanes - 1
            if m < lanes:  # the last lane has ended, and keeps its state
                kept = [a[m:].copy() for a in (low, span, end, bit_end, held, n_held)]
            unit = span >> 16
            low += unit * begin[i]
            unit *= size[i]
            short = unit <= _LOW32
            shift = short.astype(np.int64)
            coded[end] = low >> 32
            end += shift * lanes
            mask = shift - 1
            mask |= _LOW48
            shift <<= 4
            low <<= shift
            low &= mask
            np.left_shift(unit, shift, out=span)
            held <<= n_bits[i]
            held |= bit[i]
            n_held += n_bits[i]
            plain[bit_end] = held >> np.maximum(n_held - 16, 0)
            bit_end += (n_held >> 4) * lanes
            n_held &= 15
            if m < lanes:
                for a, was in zip((low, span, end, bit_end, held, n_held), kept):
                    a[m:] = was
    tail = low + 65535
    coded[end], coded[end + lanes] = tail >> 32, tail >> 16 & 65535
    plain[bit_end] = held << (16 - n_held)
    words, bit_words = end // lanes + 2, bit_end // lanes + (n_held > 0)
    rows = lambda flat, sizes: np.where(np.arange(sizes.max()) < sizes[:, None], flat[: sizes.max() * lanes].reshape(-1, lanes).T, 0)
    coded, plain = rows(coded, words), rows(plain, bit_words).astype("<u2")
    while (carry := coded >> 16).any():
        coded &= 65535
        coded[:, :-1] += carry[:, 1:]
    crcs = [zlib.crc32(ids[k * block : k * block + n]) for k, n in enumerate(sizes.tolist())]
    table, names = np.stack((sizes, words, bit_words, crcs), axis=1).astype("<u4"), ranks.pack()
    coded = coded.astype("<u2")
    body = [part for k in range(lanes) for part in (coded[k, : words[k]], plain[k, : bit_words[k]])]
    head = struct.pack("<6I", _VERSION, vocabulary, block, lanes, len(names), zlib.crc32(names))
    return b"".join((_MAGIC, head, table.tobytes(), names, np.concatenate(body).tobytes()))


def decode(image: bytes) -> np.ndarray:
    """The ids of a file image; raises ValueError if a checksum doesn't hold."""
    if image[:4] != _MAGIC:
        raise ValueError("not an id file")
    version, _, block, lanes, n_names, names_crc = struct.unpack_from("<6I", image, 4)
    if version != _VERSION:
        raise ValueError(f"unknown version {version}")
    if not lanes:
        return np.zeros(0, "<u4")
    table = np.frombuffer(image, "<u4", 4 * lanes, 28).reshape(lanes, 4).astype(np.int64)
    names = image[28 + 16 * lanes :][:n_names]
    if zlib.crc32(names) != names_crc:
        raise ValueError("checksum of the rank table doesn't hold")
    ranks = _Ranks.unpack(names)
    flat = np.concatenate((np.frombuffer(image, "<u2", -1, 28 + 16 * lanes + n_names), np.zeros(4, "<u2")))
    sizes, end = table[:, 0], np.cumsum(table[:, 1] + table[:, 2])
    # words in the order (place, lane), as lanes stand at nearly the same place
    rows = lambda first, n: flat.take(np.add.outer(np.arange(n.max() + 4), first), mode="clip")
    words, plain = rows(end - table[:, 1] - table[:, 2], table[:, 1]), rows(end - table[:, 2], table[:, 2])
    words, pairs = words.ravel(), (plain[:-1].astype(np.uint32) << 16 | plain[1:]).ravel()
    bits, start = _BITS.astype(np.uint32), _START.astype(np.int32)
    model = _Model(lanes, ranks)
    lane, n = model.lane, model.n
    # the slots of order 1 and then those of order 2
    slots, of_order = np.full(2 * _SLOTS * lanes, _NONE, np.int32), np.stack((lane, lane + _SLOTS * lanes))
    slot, last = of_order.copy(), np.zeros(lanes, np.int32)
    next_word, next_pair, next_bit = lane.copy(), lane.copy(), np.zeros(lanes, np.uint32)
    code, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    for _ in range(3):
        code = code << 16 | words.take(next_word, mode="clip")
        next_word += lanes
    steps, x = int(sizes.max()), np.empty((3, lanes), np.intp)
    grid, top = np.zeros((_FRESH, lanes), np.int32), len(ranks.ids) - 1
    names, flat = ranks.ids.astype("<u4"), np.empty((lanes, steps), "<u4")
    # the last lane, once it has ended, goes on with a code of 0, and what it gives is left out
    for j in range(steps):
        if j >= sizes[-1]:
            code[-1] = 0
        model.count(j)
        if not j % _FRESH:
            inner = model.sums.reshape(n + 1, lanes)[1:n].astype(np.int16)
        held = slots.take(slot, mode="clip")
        first, second, share = model.guess(held, x)
        weights, p = model.predict(x)
        base = p + ((65536 - p) * share >> 12)
        left = 65536 - base
        unit = span >> 16
        value = np.minimum(code / unit, 65535).astype(np.int32)  # exact: both are below 2**53, and units below 2**33
        hit, rest = -(value < p).astype(np.int32), -(value >= base).astype(np.int32)
        goal = (((((value - base + 1) << 11) - 1) & rest) / left).astype(np.int16)  # exact, too
        at = np.add.reduce((inner <= goal).view(np.uint8), axis=0, dtype=np.uint8).astype(np.intp)
        place = at * lanes
        place += lane
        begin, size = model.bounds(p, base, left, place, hit, rest)
        code -= unit * begin
        unit *= size
        short = (unit <= _LOW32).astype(np.int64)
        shift = short << 4
        code <<= shift
        code |= words.take(next_word, mode="clip") & -short
        np.left_shift(unit, shift, out=span)
        short *= lanes
        next_word += short
        n_bits = bits.take(at, mode="clip")
        n_bits &= rest.view(np.uint32)
        offset = pairs.take(next_pair, mode="clip")
        offset <<= next_bit
        offset >>= 32 - n_bits  # none where that is all of them
        next_bit += n_bits
        next_pair += (next_bit >> 4) * np.int64(lanes)
        next_bit &= 15
        now = offset.view(np.int32)
        now += start.take(at, mode="clip")
        now &= rest
        now |= first & hit
        now |= second & ~(hit | rest)
        np.minimum(np.maximum(now, 0, out=now), top, out=now)  # beyond these only in a damaged block
        model.learn(x, weights, hit, p)
        model.met.append(np.where(rest, place, len(model.seen)))
        # a rank met again runs on; elsewhere ``held`` is below its packed form, or 16 and more above
        packed = now << 4
        held -= packed
        run = held.view(np.uint32)
        run += 1
        held *= run < 16
        np.minimum(held, _RUN_END, out=held)
        held += packed
        slots[slot] = held
        hashed = _hash(now)
        np.multiply(hashed, lanes, out=slot[0])
        np.multiply(hashed ^ last, lanes, out=slot[1])
        slot += of_order
        last = hashed * 21 + 7 & (_SLOTS - 1)
        grid[j % _FRESH] = now
        if j % _FRESH == _FRESH - 1 or j == steps - 1:
            since = j - j % _FRESH
            flat[:, since : j + 1] = names.take(grid[: j + 1 - since], mode="clip").T
    for k, n in enumerate(sizes.tolist()):
        if zlib.crc32(flat[k, :n]) != table[k, 3]:
            raise ValueError(f"checksum of block {k} doesn't hold")
    return flat.ravel()[: int(sizes.sum())]
