"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks that know nothing of each other. A block starts with its
alphabet (the distinct ids, ascending) and the CRC-32 of its ids; then every id
is coded by arithmetic coding from three predictions that start empty in each
block and learn as it goes:

* order 0: how often each id of the alphabet has come so far;
* order 1: the id that last followed the id before;
* order 2: the id that last followed the two ids before.

Orders 1 and 2 remember how often in a row they were right. That confidence
picks a pair of mixing weights, which are themselves learned; an id's share of
the range is its order-0 share plus the weights of the orders that name it.

Blocks are independent, so many are coded side by side: each array below has one
place per block (a lane), and one pass over the arrays codes one id of each.
Encoder and decoder run the same integer steps, so they agree on any machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PLACE = 11  # bits of a place in a block's alphabet
BLOCK = (1 << PLACE) - 1  # ids in a block
MAGIC = b"IDB1"
HEAD = "<4sIIII"  # magic, ids, alphabet bytes, words, CRC-32 of the ids
HEAD_SIZE = struct.calcsize(HEAD)
LANES = 4096  # blocks coded side by side: each step costs as much for a few as for many
PREPARED = 512  # blocks whose alphabets are made at once
STEP = 12  # order-0 weight of one occurrence; an id that has not come yet weighs 1
RENEW = 128  # ids after which order-0 shares are summed anew, sooner at the start
SURE = 3  # highest confidence
ONE, MOST = 65_536, 64_512  # mixing weights are parts of ONE and together at most MOST
RATE = 4  # a weight moves by 1/16 of its error
PAIRS = 1024  # places for pairs of ids in order 2
CODE_LOW = np.uint64(1 << 32)
WORD = np.uint64(32)


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of base-128 numbers, low digits first, and the bytes each takes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 5):
        sizes += values >= np.uint64(1 << 7 * k)
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        some = sizes > k
        digit = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[some] + k] = digit | np.where(sizes[some] > k + 1, 128, 0).astype(np.uint64)
    return out, sizes


def _from_varints(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    digit = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * digit).astype(np.uint64), first) if len(first) else raw.astype(np.uint64)


class _Model:
    """Predictions of all lanes; places are numbers within a lane's alphabet.

    Arrays of two rows hold order 1 first and order 2 second.
    """

    def __init__(self, sizes: np.ndarray):
        n = len(sizes)
        self.width = -(-(int(sizes.max()) + 1) // 256) * 256
        self.counts = (np.arange(self.width) < sizes[:, None]).astype(np.uint16)
        # Summed counts of the places before; a block's sum stays below 2 ** 16.
        self.shares = np.zeros((n, self.width), np.uint16)
        self.middle = np.zeros((n, self.width // 16), np.uint16)  # every 16th of them
        self.coarse = np.full((n, 16), 2**16 - 1, np.uint16)  # every 256th
        lane = np.arange(n)
        self.base = lane * self.width
        self.base16 = lane * (self.width // 16)
        self.base256 = lane * (self.width // 256)
        # What followed each place, then what followed each pair of places: place | confidence << PLACE.
        self.after = np.zeros(n * (self.width + PAIRS), np.uint16)
        self.base_pair = lane * PAIRS + n * self.width
        self.at = np.empty((2, n), np.int64)
        kept = np.arange(32)
        first = np.where(kept < 16, (kept & 3) * (ONE // 10), 0)
        second = (kept >> 2 & 3) * (ONE // 5)
        self.mix = np.concatenate([np.tile(first, n), np.tile(second, n)]).astype(np.int32)
        self.base_mix = np.stack([lane * 32, (lane + n) * 32])
        self.last1 = np.zeros(n, np.int64)
        self.last2 = np.zeros(n, np.int64)
        self.renew(n)

    def renew(self, m: int) -> None:
        np.cumsum(self.counts[:m, :-1], axis=1, dtype=np.uint16, out=self.shares[:m, 1:])
        self.total = self.shares[:m, -1].astype(np.int64)
        self.middle[:m] = self.shares[:m, ::16]
        self.coarse[:m, : self.width // 256] = self.middle[:m, ::16]

    def predict(self, m: int) -> None:
        """Look up what orders 1 and 2 name and how much they count for."""
        at = self.at[:, :m]
        last1, last2 = self.last1[:m], self.last2[:m]
        np.add(self.base[:m], last1, out=at[0])
        np.add(self.base_pair[:m], (last1 * 31 + last2 * 1021) & (PAIRS - 1), out=at[1])
        self.found = self.after.take(at)
        self.named = self.found & np.uint16(BLOCK)
        sure = self.found >> PLACE
        same = self.named[0] == self.named[1]
        self.mix_at = self.base_mix[:, :m] + ((same << 4) + (sure[1] << 2) + sure[0])
        self.weight = self.mix.take(self.mix_at)
        total = self.total[:m]
        scale = total / (ONE - self.weight[0] - self.weight[1])
        self.extra = (self.weight * scale).astype(np.int64)
        self.whole = total + self.extra[0] + self.extra[1]

    def interval(self, place: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each lane's ``place`` within ``whole``."""
        at = self.base[:m] + place
        flat = self.shares.reshape(-1)
        low = flat.take(at).astype(np.int64)
        self.hit = self.named == place
        before = self.extra * (self.named < place)
        own = self.extra * self.hit
        return low + before[0] + before[1], flat.take(at + 1) - low + own[0] + own[1]

    def place_of(self, value: np.ndarray, m: int) -> np.ndarray:
        """The place whose interval holds ``value``."""
        flat, base = self.shares.reshape(-1), self.base[:m]
        first, second = self.named
        swap = first >= second
        extra_a, extra_b = np.where(swap, self.extra[::-1], self.extra)
        end_a = flat.take(base + np.where(swap, second, first) + 1).astype(np.int64)
        end_b = flat.take(base + np.where(swap, first, second) + 1).astype(np.int64)
        # Take the extra widths out of the line, then look up the order-0 shares.
        value = np.where(value < end_a + extra_a, np.minimum(value, end_a - 1), value - extra_a)
        value = np.where(value < end_b + extra_b, np.minimum(value, end_b - 1), value - extra_b)
        value = value.astype(np.uint16)[:, None]

        def upto(rows: np.ndarray) -> np.ndarray:
            """How many of 16 ascending numbers are at most ``value``, less 1."""
            pair = np.bitwise_count((rows <= value).view(np.uint64))
            return pair[:, 0] + pair[:, 1] - np.int64(1)

        place = upto(self.coarse[:m])
        place = place * 16 + upto(self.middle.reshape(-1, 16).take(self.base256[:m] + place, axis=0))
        return place * 16 + upto(self.shares.reshape(-1, 16).take(self.base16[:m] + place, axis=0))

    def learn(self, place: np.ndarray, m: int) -> None:
        """Take in each lane's id after ``interval``."""
        found, hit = self.found, self.hit
        right = np.minimum(found + np.uint16(1 << PLACE), self.named | np.uint16(SURE << PLACE))
        fresh = place.astype(np.uint16) | np.uint16(1 << PLACE)
        wrong = np.where(found >= 2 << PLACE, found - np.uint16(1 << PLACE), fresh)
        self.after[self.at[:, :m]] = np.where(hit, right, wrong)
        hit[0] &= ~hit[1]
        self.mix[self.mix_at] = self.weight + ((hit * np.int32(MOST) - self.weight) >> RATE)
        self.counts.reshape(-1)[self.base[:m] + place] += np.uint16(STEP)
        self.last2[:m] = self.last1[:m]
        self.last1[:m] = place


def _renewals(n: int) -> set[int]:
    return {16, 32, 64} | set(range(RENEW, n, RENEW))


def _encode_lanes(places: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words of each lane and their number; ``lengths`` descend."""
    n, steps = places.shape
    model = _Model(sizes)
    by_step = np.ascontiguousarray(places.T)
    low, span = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    words, used = np.zeros((n, steps * 22 // 32 + 4), np.uint32), np.zeros(n, np.int64)
    flat, row = words.reshape(-1), np.arange(n) * words.shape[1]
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    renewals = _renewals(steps)
    for t in range(steps):
        m = int(active[t])
        if t in renewals:
            model.renew(m)
        place = by_step[t, :m].astype(np.int64)
        model.predict(m)
        start, width = model.interval(place, m)
        part = span[:m] // model.whole.astype(np.uint64)
        before = low[:m]
        after = before + part * start.astype(np.uint64)
        for k in np.flatnonzero(after < before):  # the sum ran over: carry into the words written
            at = row[k] + used[k] - 1
            while flat[at] == 0xFFFFFFFF:
                flat[at] = 0
                at -= 1
            flat[at] += 1
        low[:m] = after
        span[:m] = part * width.astype(np.uint64)
        short = np.flatnonzero(span[:m] < CODE_LOW)
        flat[row[short] + used[short]] = low[short] >> WORD
        used[short] += 1
        low[short] <<= WORD
        span[short] <<= WORD
        model.learn(place, m)
    for shift in (WORD, np.uint64(0)):
        flat[row + used] = (low >> shift) & np.uint64(0xFFFFFFFF)
        used += 1
    return words, used


def _decode_lanes(words: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of each lane; ``words`` has one row per lane, ``lengths`` descend."""
    n, steps = len(lengths), int(lengths.max())
    model = _Model(sizes)
    out = np.zeros((steps, n), np.uint16)
    flat, row = words.reshape(-1), np.arange(n) * words.shape[1]
    code = (words[:, 0].astype(np.uint64) << WORD) | words[:, 1]
    span, used = np.full(n, 2**64 - 1, np.uint64), row + 2
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    renewals = _renewals(steps)
    for t in range(steps):
        m = int(active[t])
        if t in renewals:
            model.renew(m)
        model.predict(m)
        part = span[:m] // model.whole.astype(np.uint64)
        value = np.minimum((code[:m] // part).astype(np.int64), model.whole - 1)
        place = model.place_of(value, m)
        start, width = model.interval(place, m)
        code[:m] -= part * start.astype(np.uint64)
        span[:m] = part * width.astype(np.uint64)
        short = np.flatnonzero(span[:m] < CODE_LOW)
        at = used[short]
        code[short] = (code[short] << WORD) | flat.take(at, mode="clip")
        used[short] = at + 1
        span[short] <<= WORD
        model.learn(place, m)
        out[t, :m] = place
    return out


def encode(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Coded blocks of each run of ``ids``, one value per run.

    ``ids`` are unsigned 32-bit; run ``k`` is ``ids[starts[k]:starts[k + 1]]``.
    A run is cut into blocks of ``BLOCK`` ids. An empty run has no block.
    """
    ids = np.ascontiguousarray(ids, np.uint32)
    begin = [np.arange(a, b, BLOCK) for a, b in zip(starts[:-1], starts[1:])]
    per_run = [len(b) for b in begin]
    first = np.concatenate([*begin, np.zeros(0, np.int64)]).astype(np.int64)
    length = np.minimum(first + BLOCK, np.repeat(np.asarray(starts[1:], np.int64), per_run)) - first
    blocks: list[bytes] = [b""] * len(first)
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), LANES):
        some = order[k : k + LANES]
        for i, block in zip(some, _encode_some(ids, first[some], length[some])):
            blocks[i] = block
    ends = np.cumsum(per_run)
    return [b"".join(blocks[e - c : e]) for e, c in zip(ends, per_run)]


def _alphabets(ids: np.ndarray, first: np.ndarray, length: np.ndarray, places: np.ndarray):
    """Distinct ids of each block as base-128 steps, their number; fills ``places``."""
    n, steps = places.shape
    column = np.arange(steps)
    inside = column < length[:, None]
    key = np.full((n, steps), 2**64 - 1, np.uint64)
    key[inside] = ids[(first[:, None] + column)[inside]]
    key = (key << np.uint64(PLACE)) | column.astype(np.uint64)
    key.sort(axis=1)  # fillers come last
    value = key >> np.uint64(PLACE)
    new = np.ones((n, steps), bool)
    new[:, 1:] = value[:, 1:] != value[:, :-1]
    new &= inside
    rank = np.cumsum(new, axis=1, dtype=np.uint16) - np.uint16(1)
    np.put_along_axis(places, (key & np.uint64(BLOCK)).astype(np.int64), rank, axis=1)
    sizes = new.sum(axis=1)
    alphabet = value[new].astype(np.int64)
    ends = np.cumsum(sizes)
    rises = np.diff(alphabet, prepend=0)
    rises[ends - sizes] = alphabet[ends - sizes]  # each alphabet starts from 0
    raw, taken = _varints(rises)
    stop = np.concatenate([[0], np.cumsum(taken)])[np.concatenate([[0], ends])]
    return [raw[a:b].tobytes() for a, b in zip(stop, stop[1:])], sizes


def _encode_some(ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> list[bytes]:
    n, steps = len(first), int(length.max())
    # Column by column, as the lanes take them.
    places, letters, sizes = np.zeros((n, steps), np.uint16, order="F"), [], []
    for k in range(0, n, PREPARED):
        part = slice(k, k + PREPARED)
        some, size = _alphabets(ids, first[part], length[part], places[part])
        letters += some
        sizes.append(size)
    words, used = _encode_lanes(places, np.concatenate(sizes), length)
    out = []
    for k in range(n):
        plain = ids[first[k] : first[k] + length[k]].astype("<u4").tobytes()
        head = struct.pack(HEAD, MAGIC, length[k], len(letters[k]), used[k], zlib.crc32(plain))
        out.append(head + letters[k] + words[k, : used[k]].astype("<u4").tobytes())
    return out


def decode(runs: list[bytes]) -> list[np.ndarray]:
    """Ids of each run; a block whose check sum is wrong is an error."""
    heads: list[tuple] = []
    for r, data in enumerate(runs):
        at = 0
        while at < len(data):
            magic, count, letters, used, check = struct.unpack_from(HEAD, data, at)
            if magic != MAGIC:
                raise ValueError("not a block of token ids")
            heads.append((r, at + HEAD_SIZE, count, letters, used, check))
            at += HEAD_SIZE + letters + 4 * used
    decoded: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(heads)
    order = sorted(range(len(heads)), key=lambda i: -heads[i][2])
    for k in range(0, len(order), LANES):
        some = order[k : k + LANES]
        for i, ids in zip(some, _decode_some(runs, [heads[i] for i in some])):
            if zlib.crc32(ids.tobytes()) != heads[i][5]:
                raise ValueError("a block of token ids fails its check sum")
            decoded[i] = ids
    out: list[list[np.ndarray]] = [[] for _ in runs]
    for head, ids in zip(heads, decoded):
        out[head[0]].append(ids)
    return [np.concatenate(parts) if parts else np.zeros(0, np.uint32) for parts in out]


def _decode_some(runs: list[bytes], heads: list[tuple]) -> list[np.ndarray]:
    alphabets = []
    words = np.zeros((len(heads), max(h[4] for h in heads) + 1), np.uint32)
    for k, (r, at, _, letters, used, _) in enumerate(heads):
        raw = np.frombuffer(runs[r], np.uint8, letters, at)
        alphabets.append(np.cumsum(_from_varints(raw)).astype("<u4"))
        words[k, :used] = np.frombuffer(runs[r], "<u4", used, at + letters)
    sizes = np.array([len(a) for a in alphabets])
    places = _decode_lanes(words, sizes, np.array([h[2] for h in heads]))
    # One alphabet place out of range would mean a broken block; the check sum finds the rest.
    return [a[np.minimum(places[: h[2], k], len(a) - 1)] for k, (a, h) in enumerate(zip(alphabets, heads))]
