"""External induced sorting of suffixes, with common-prefix values.

Suffixes are of type L or S by their next character; S suffixes behind an L suffix (S*) are sorted first: the pieces
between them are named in order, and where names repeat, the suffixes of the string of names are sorted in the same way,
by recursion, each level with half the characters at most and half the cap. The order of all L suffixes then follows by a
scan in ascending order, and that of all S suffixes by a scan in descending order: each suffix that a scan takes puts the
suffix one character longer into the priority queue of its first character (of text), or of the window of characters that
it falls in (of names). A queue entry for text is a tuple of position and common prefix with the entry before it; the
common prefix of two neighbours is one more than the least value between those that induced them. Queues keep a bounded
part in memory and the rest in a file (those of names are files), in the order in which they were filled, which is the
order in which they are taken; what a scan takes out is kept the same way; text, names and orders are memory maps. In
memory are one window of names (WINDOW of them, or the rows of one name where it has more) and LEAF pieces at once.
Common prefixes are counted up to a cap, and order is exact up to the cap.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Entries that a scan takes at once, and entries that all queues and scan outputs keep in memory.
STEP = 1 << 16
MEMORY = 1 << 24
#: Pieces that are named at once; suffixes of a window of characters that are induced at once.
LEAF, WINDOW = 1 << 20, 1 << 18


def mapped(n: int, kind: type = np.uint8) -> np.ndarray:
    """Zeros in a file that is gone with the array."""
    return np.asarray(np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(max(1, n),)))[:n]


class Pile:
    """Positions in a file."""

    def __init__(self):
        self.file, self.n = tempfile.TemporaryFile(), 0

    def push(self, pos: np.ndarray) -> None:
        self.file.seek(0, 2)
        pos.astype(np.int64).tofile(self.file)
        self.n += len(pos)

    def chunks(self, size: int = STEP) -> Iterator[np.ndarray]:
        self.file.flush()
        for at in range(0, self.n, size):
            self.file.seek(8 * at)
            yield np.fromfile(self.file, np.int64, min(size, self.n - at))

    def all(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *self.chunks()])


class Output:
    """(position, common prefix) of each bucket, in the order put; parts beyond the shared allowance are in a file."""

    def __init__(self, room: list[int]):
        self.buckets: list[list[tuple]] = [[] for _ in range(256)]
        self.room = room
        self.file = None

    def put(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.room[0] >= len(pos):
            self.room[0] -= len(pos)
            self.buckets[c].append((pos, lcp))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        self.buckets[c].append((self.file.tell(), len(pos)))
        pos.astype(np.int64).tofile(self.file)
        lcp.tofile(self.file)

    def parts(self, c: int, free: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self._read(iter(self.buckets[c]), free)
        if free:
            self.buckets[c] = []

    def back(self, c: int, free: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The parts from the last entry to the first, with common prefixes to the entry taken before (0 for the first)."""
        carry = 0
        for pos, lcp in self._read(reversed(self.buckets[c]), free):
            yield pos[::-1], np.append(np.uint8(carry), lcp[:0:-1])
            carry = lcp[0]
        if free:
            self.buckets[c] = []

    def _read(self, parts: Iterator[tuple], free: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in parts:
            if isinstance(a, int):
                self.file.flush()
                self.file.seek(a)
                yield np.fromfile(self.file, np.int64, b), np.fromfile(self.file, np.uint8, b)
            else:
                yield a, b
                if free:
                    self.room[0] += len(a)


class Queue:
    """First in, first out, of (position, common prefix); parts beyond the shared allowance are in a file."""

    def __init__(self, room: list[int]):
        self.parts: list[tuple] = []
        self.room = room
        self.file = None

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.room[0] >= len(pos):
            self.room[0] -= len(pos)
            self.parts.append((pos, lcp))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # gone with the queue
        self.file.seek(0, 2)
        at = self.file.tell()
        pos.astype(np.int64).tofile(self.file)
        lcp.tofile(self.file)
        self.parts.append((at, len(pos)))

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        """The oldest parts, about STEP entries together."""
        pos, lcp, n = [], [], 0
        while self.parts and n < STEP:
            a, b = self.parts.pop(0)
            if isinstance(a, int):
                self.file.flush()
                self.file.seek(a)
                a, b = np.fromfile(self.file, np.int64, b), np.fromfile(self.file, np.uint8, b)
            else:
                self.room[0] += len(a)
            pos.append(a)
            lcp.append(b)
            n += len(a)
        return np.concatenate(pos), np.concatenate(lcp)


def _least(lcp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value of lcp[first..last], both included."""
    if not len(first):
        return np.zeros(0, np.uint8)
    span = last - first + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(first), np.uint8)
    table = lcp
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[first[here]], table[last[here] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number; text has 64 spare bytes at its end."""
    return np.ndarray((len(text) - 8,), ">u8", buffer=text.data, strides=(1,))


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to cap."""
    words, out, open_ = _words(text), np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, cap, 8):
        x = (words[a[open_] + k] ^ words[b[open_] + k]).astype(np.uint64)
        for shift in range(56, -1, -8):
            out[open_] += (x >> np.uint64(shift)) == 0
        open_ = open_[x == 0]
        if not len(open_):
            break
    return np.minimum(out, cap).astype(np.uint8)


def _ranks(keys: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Rank of each key (equal keys share one) and the number of ranks. keys: below 2**bits. Keys are sorted together
    with their places where both fit in 64 bits, else by their upper part first."""
    keys, n = keys.astype(np.uint64), len(keys)
    own = max(1, (n - 1).bit_length())
    if bits + own <= 64:
        mixed = np.sort((keys << np.uint64(own)) | np.arange(n, dtype=np.uint64))
        order = (mixed & np.uint64((1 << own) - 1)).astype(np.int64)
        mixed >>= np.uint64(own)
        out = np.empty(n, np.int64)
        out[order[0]] = 0
        rank = np.cumsum(mixed[1:] != mixed[:-1])
        out[order[1:]] = rank
        return out, int(rank[-1]) + 1 if n > 1 else 1
    upper = 64 - own
    high, kinds = _ranks(keys >> np.uint64(bits - upper), upper)
    low = bits - upper
    while low:
        width = min(low, 64 - own - max(1, kinds.bit_length()))
        low -= width
        part = (keys >> np.uint64(low)) & np.uint64((1 << width) - 1)
        high, kinds = _ranks((high.astype(np.uint64) << np.uint64(width)) | part, max(1, kinds.bit_length()) + width)
    return high, kinds


def _types(chars: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, whether each suffix from there on is of type S, with that of the one behind), from the last stretch to the first."""
    after, high = False, n  # the last suffix is before all that go on
    while high:
        low = max(0, high - 4 * STEP)
        step = np.sign(chars[low + 1 : high + 1].astype(np.int64) - chars[low:high]).astype(np.int8)
        if high == n:
            step[-1] = -1
        where = np.minimum.accumulate(np.where(step != 0, np.arange(high - low), high - low)[::-1])[::-1]
        small = np.append(np.where(where < high - low, step[np.minimum(where, high - low - 1)] > 0, after), after)
        yield low, small
        after, high = bool(small[0]), low


def _stars(chars: np.ndarray, n: int) -> np.ndarray:
    """S* suffixes by place."""
    pile = Pile()
    for low, small in _types(chars, n):
        pile.push((np.flatnonzero(small[1:] & ~small[:-1]) + low + 1)[::-1])
    stars, at = mapped(pile.n, np.int64), pile.n
    for pos in pile.chunks():
        stars[at - len(pos) : at] = pos[::-1]
        at -= len(pos)
    return stars


def _deal(pile: Pile, value: Callable[[np.ndarray], np.ndarray], size: int) -> list[Pile]:
    """Parts of a pile by a value below size, in order; a part of more than LEAF has one such value."""
    count = np.zeros(size, np.int64)
    for own in pile.chunks():
        count += np.bincount(value(own), minlength=size)
    group, total, kinds = np.zeros(size, np.int64), 0, 0
    for v in np.flatnonzero(count).tolist():
        if total and total + count[v] > LEAF:
            total, kinds = 0, kinds + 1
        group[v] = kinds
        total += count[v]
    piles = [Pile() for _ in range(kinds + 1)]
    for own in pile.chunks():
        which = group[value(own)]
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(kinds + 2))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            piles[k].push(own[order[edges[k] : edges[k + 1]]])
    return piles


def _pieces(view: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each piece of bytes and the number of ranks. A piece that goes on where another ends comes first; eight bytes
    are always compared, which are in order with the suffixes."""
    words = _words(view)
    names, kinds = _ranks(words[at], 64)
    top = int(length.max())
    for k in range(8, top, 8):
        long = length > k
        rank = np.full(len(at), int(long.sum()), np.int64)
        rank[long] = _ranks(words[at[long] + k], 64)[0]
        b = max(1, len(at).bit_length())
        names, kinds = _ranks(names << b | rank, b + kinds.bit_length())
    b = top.bit_length()
    return _ranks(names << b | (top - length), b + kinds.bit_length())


def _named(chars: np.ndarray, stars: np.ndarray, n: int, cap: int) -> tuple[np.ndarray, int]:
    """Names, from 1 on and in order, of the pieces from each S* to the next; cut behind cap characters. Pieces are dealt by
    two bytes at a time until LEAF hold a part, which is named in memory."""
    width = chars.dtype.itemsize
    view, m = chars.view(np.uint8), len(stars)
    names, kinds = mapped(m + 64, ">u4"), 0

    def place(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = stars[own]
        ends = np.where(own + 1 < m, stars[np.minimum(own + 1, m - 1)], n)
        return at * width, np.minimum(ends - at + 1, cap + 1) * width

    whole, most = Pile(), (cap + 1) * width
    for low in range(0, m, STEP):
        whole.push(np.arange(low, min(m, low + STEP)))
    parts = [(whole, 0)]
    while parts:
        pile, depth = parts.pop()
        if pile.n <= LEAF:
            for own in pile.chunks(LEAF):
                rank, k = _pieces(view, *place(own))
                names[own] = rank + kinds + 1
                kinds += k
        elif depth > most:  # alike in length too
            kinds += 1
            for own in pile.chunks():
                names[own] = kinds
        else:

            def value(own: np.ndarray, depth: int = depth) -> np.ndarray:
                at, length = place(own)
                if depth >= most:
                    return most - length
                pair = view[at + depth].astype(np.int64) << 8 | view[at + depth + 1]
                return pair if depth < 8 else np.where(length > depth, pair, 1 << 16)

            after = depth + 2 if depth < most else most + 1
            parts += [(part, after) for part in reversed(_deal(pile, value, (1 << 16) + 1))]
    return names, kinds


def _ordered_stars(chars: np.ndarray, n: int, cap: int) -> np.ndarray:
    """S* suffixes in order up to cap characters: by the names of their pieces where these differ, else by the order of the
    suffixes of the string of names. A piece has two characters of its own at least, so half the cap is enough there."""
    stars = _stars(chars, n)
    m = len(stars)
    if not m:
        return stars
    names, kinds = _named(chars, stars, n, cap)
    out = mapped(m, np.int64)
    if kinds == m:
        for low in range(0, m, STEP):
            out[names[low : min(m, low + STEP)].astype(np.int64) - 1] = stars[low : low + STEP]
        return out
    order = _ordered(names, m, kinds, max(1, (cap + 1) // 2))
    for low in range(0, m, STEP):
        out[low : low + STEP] = stars[order[low : low + STEP]]
    return out


def _ordered(names: np.ndarray, n: int, kinds: int, cap: int) -> np.ndarray:
    """Suffixes of a string of names in order up to cap names: its S* by recursion, then both inductions."""
    if cap == 1:
        count = np.zeros(kinds + 2, np.int64)
        for low in range(0, n, STEP):
            count += np.bincount(names[low : min(n, low + STEP)].astype(np.int64) + 1, minlength=kinds + 2)[: kinds + 2]
        start, out = np.cumsum(count), mapped(n, np.int64)
        for low in range(0, n, STEP):
            own = names[low : min(n, low + STEP)].astype(np.int64)
            by = np.argsort(own, kind="stable")
            head = np.searchsorted(own[by], own[by])
            out[start[own[by]] + np.arange(len(by)) - head] = by + low
            start += np.bincount(own, minlength=kinds + 2)
        return out
    count = np.zeros(kinds + 1, np.int64)
    for low in range(0, n, STEP):
        count += np.bincount(names[low : min(n, low + STEP)].astype(np.int64), minlength=kinds + 1)
    before = np.append(0, np.cumsum(count))
    edges = [0]
    while edges[-1] <= kinds:
        edges.append(max(edges[-1] + 1, int(np.searchsorted(before, before[edges[-1]] + max(WINDOW, n >> 8), "right")) - 1))
    edges[-1] = kinds + 1
    spans = [(a, b, int(before[a]), int(before[b])) for a, b in zip(edges, edges[1:], strict=False)]
    window = np.repeat(np.arange(len(spans)), np.diff(edges)).astype(np.int16)  # few: each but the last two holds a 512th at least
    small = mapped(n, np.bool_)
    for low, part in _types(names, n):
        small[low : low + len(part) - 1] = part[:-1]
    members, seeds = {True: [Pile() for _ in spans], False: [Pile() for _ in spans]}, [Pile() for _ in spans]
    for low in range(0, n, STEP):
        part, pos = small[low : min(n, low + STEP)], np.arange(low, min(n, low + STEP))
        for up in (True, False):
            own = pos[part != up]
            _push(members[up], window[names[own].astype(np.int64)], own)
    stars = _ordered_stars(names, n, cap)
    for low in range(0, len(stars), STEP):
        pos = stars[low : low + STEP]
        _push(seeds, window[names[pos].astype(np.int64)], pos)
    out = mapped(n, np.int64)
    for up in (True, False):
        queues = [Pile() for _ in spans]
        if up:
            queues[window[int(names[n - 1])]].push(np.array([n - 1]))
        for w in range(len(spans)) if up else range(len(spans) - 1, -1, -1):
            a, b, low, high = spans[w]
            own, seed = members[up][w].all(), seeds[w].all()
            if not up:
                seed = seed[::-1]
            char = (lambda pos, a=a, b=b: (names[pos].astype(np.int64) - a if up else b - 1 - names[pos].astype(np.int64)))
            got = own[_by_chain(char, own, queues[w].all(), seed, cap)]
            both = np.concatenate([got, seed])
            code = np.concatenate([char(got) * 2, char(seed) * 2 + 1])
            both = both[np.argsort(code, kind="stable")]
            if up:
                seeds[w] = Pile()
                seeds[w].push(got)  # what the other scan meets
            else:
                out[low:high] = both[::-1]
            behind = both[both > 0] - 1
            to = window[names[behind].astype(np.int64)]
            ok = (small[behind] != up) & ((to > w) if up else (to < w))
            _push(queues, to[ok], behind[ok])
            queues[w] = None
    return out


def _push(piles: list, which: np.ndarray, pos: np.ndarray) -> None:
    if not len(pos):
        return
    order = np.argsort(which, kind="stable")
    kinds, heads = np.unique(which[order], return_index=True)
    for k, a, b in zip(kinds.tolist(), heads.tolist(), [*heads[1:].tolist(), len(which)], strict=True):
        piles[k].push(pos[order[a:b]])


def _by_chain(char: Callable[[np.ndarray], np.ndarray], own: np.ndarray, queued: np.ndarray, seed: np.ndarray, cap: int) -> np.ndarray:
    """Order of the suffixes (own, by place) of one window of characters. Each was induced from outside and is in the queue,
    or by a seed of the window, or by the next suffix if that is in own as well: such chains are compared character by
    character up to their end, which has its place in the queue or among the seeds."""
    n = len(own)
    if not n:
        return np.zeros(0, np.int64)
    last = np.append(own[1:] != own[:-1] + 1, True)
    ends = np.flatnonzero(last)
    end = ends[np.searchsorted(ends, np.arange(n))]
    depth = end - np.arange(n)
    by = np.argsort(queued)
    at = np.minimum(np.searchsorted(queued[by], own[ends]), max(0, len(by) - 1))
    arrived = queued[by[at]] == own[ends] if len(by) else np.zeros(len(ends), bool)
    turn = np.zeros(len(ends), np.int64)
    turn[arrived] = by[at[arrived]]
    to = np.argsort(seed)
    if not arrived.all():
        turn[~arrived] = to[np.searchsorted(seed[to], own[ends[~arrived]] + 1)]
    code, code_seed = char(own) * 4, char(seed) * 4 + 2
    outside = np.zeros(n, bool)
    outside[ends] = arrived
    code[~outside] += 1
    tails = np.zeros((2, n), np.int64)  # what follows the last of a chain: its place in the queue, or seed and place of that
    tails[0, ends[arrived]] = turn[arrived]
    tails[0, ends[~arrived]] = code_seed[turn[~arrived]]
    tails[1, ends[~arrived]] = turn[~arrived]

    def column(j: int, i: np.ndarray) -> np.ndarray:
        left = depth[i] - j  # steps to the end of the chain
        value = np.zeros(len(i), np.int64)
        value[left >= 0] = code[i[left >= 0] + j]
        for k in (0, 1):
            here = left == -1 - k
            value[here] = tails[k, end[i[here]]]
        return value

    everyone = np.arange(n)
    bits = max(int(code.max()), int(code_seed.max()) if len(seed) else 0, len(queued), len(seed), 1).bit_length()
    dense, kinds = _ranks(column(0, everyone) << bits | column(1, everyone), 2 * bits)
    size = np.bincount(dense)
    rank = (np.cumsum(size) - size)[dense]  # how many are before
    open_ = np.flatnonzero(size[dense] > 1)
    for j in range(2, cap + 3, 2):
        if not len(open_):
            break
        base = rank[open_]
        group, groups = _ranks(base, max(1, n.bit_length()))
        inner, k = _ranks(column(j, open_) << bits | column(j + 1, open_), 2 * bits)
        dense, kinds = _ranks(group << k.bit_length() | inner, groups.bit_length() + k.bit_length())
        size, of = np.bincount(dense), np.bincount(group)
        rank[open_] = base + (np.cumsum(size) - size)[dense] - (np.cumsum(of) - of)[group]
        open_ = open_[size[dense] > 1]
    if len(open_):
        return np.argsort(rank, kind="stable")  # alike up to the cap
    out = np.empty(n, np.int64)
    out[rank] = everyone
    return out


def _sorted_stars(text: np.ndarray, n: int, cap: int, room: list[int]) -> Output:
    """S* suffixes in order with common prefixes, by first character."""
    stars, out, last = _ordered_stars(text, n, cap), Output(room), None
    for low in range(0, len(stars), STEP):
        pos = np.array(stars[low : low + STEP])
        lcp = common(text, np.append(pos[0] if last is None else last, pos[:-1]), pos, cap)
        last, ch = pos[-1], text[pos]
        for c in np.unique(ch).tolist():
            a, b = np.searchsorted(ch, [c, c + 1])
            out.put(c, pos[a:b], lcp[a:b])
    return out


def _scan(text: np.ndarray, seeds: Callable[[int], Iterator[tuple[np.ndarray, np.ndarray]]], up: bool, cap: int, room: list[int], opening: int | None = None) -> Output:
    """One induction. seeds: for each character what the scan meets in its bucket beside what it induces there, with
    common prefixes; either way they come after it. opening: the last suffix, which nothing induces. Returns what was induced, by first character, in the order of the scan."""
    queues = [Queue(room) for _ in range(256)]
    done = Output(room)
    pushed = np.zeros(256, bool)
    if opening is not None:
        queues[text[opening]].push(np.array([opening]), np.zeros(1, np.uint8))
        pushed[text[opening]] = True
    since = np.zeros(256, np.uint8)  # least common prefix since the last push to each queue
    for c in range(256) if up else range(255, -1, -1):
        last = None

        def take(pos: np.ndarray, lcp: np.ndarray, seed: bool, c: int = c) -> None:
            at = np.flatnonzero(pos > 0)
            ch = text[pos[at] - 1]
            ok = (ch >= c if up else (ch <= c if not seed else ch < c))
            at, ch = at[ok], ch[ok]
            if not len(at):
                np.minimum(since, lcp.min(), out=since)
                return
            order = np.argsort(ch, kind="stable")
            at, ch = at[order], ch[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = ch[1:] != ch[:-1]
            low = np.empty(len(at), np.uint8)
            old = np.flatnonzero(~fresh)
            low[old] = _least(lcp, at[old - 1] + 1, at[old])
            heads = np.flatnonzero(fresh)
            before = np.minimum.accumulate(lcp)
            low[heads] = np.minimum(since[ch[heads]], before[at[heads]])
            value = np.minimum(low.astype(np.int64) + 1, cap).astype(np.uint8)
            np.minimum(since, before[-1], out=since)
            ends = np.append(heads[1:], len(at))
            behind = np.minimum.accumulate(lcp[::-1])[::-1]
            for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
                k, tail = int(ch[h]), int(at[e - 1]) + 1
                if not pushed[k]:
                    value[h] = 0  # first of its bucket
                    pushed[k] = True
                queues[k].push(pos[at[h:e]] - 1, value[h:e])
                since[k] = behind[tail] if tail < len(lcp) else 255

        since[:] = 0  # suffixes of another bucket share nothing
        while queues[c].parts:
            pos, lcp = queues[c].pop()
            done.put(c, pos, lcp)
            last = pos[-1]
            for i in range(0, len(pos), STEP):
                take(pos[i : i + STEP], lcp[i : i + STEP], False)
        queues[c] = None
        begun = False
        for pos, lcp in seeds(c):
            if not begun:
                lcp, begun = lcp.copy(), True
                lcp[0] = 0 if last is None else common(text, np.array([last]), pos[:1], cap)[0]
            for i in range(0, len(pos), STEP):
                take(pos[i : i + STEP], lcp[i : i + STEP], True)
    return done


def sorted_suffixes(data: np.ndarray, cap: int = 50) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches (positions, common prefixes with the suffix before) of all suffixes in order, exact up to cap <= 56
    characters; suffixes that agree that far stand together. data: bytes, which may be a memory map."""
    n = len(data)
    if not n:
        return
    text = mapped(n + 72)
    for low in range(0, n, 4 * STEP):
        text[low : min(n, low + 4 * STEP)] = data[low : low + 4 * STEP]
    room = [MEMORY]
    stars = _sorted_stars(text, n, cap, room)
    # the last suffix is of type L and has nothing behind it that could induce it: it opens its bucket
    first = _scan(text, lambda c: stars.parts(c, free=True), True, cap, room, n - 1)
    second = _scan(text, first.back, False, cap, room)
    for c in range(256):
        last = None
        for pos, lcp in first.parts(c, free=True):
            yield pos, lcp
            last = pos[-1]
        for k, (pos, lcp) in enumerate(second.back(c, free=True)):
            if not k and last is not None:
                lcp[0] = common(text, np.array([last]), pos[:1], cap)[0]
            yield pos, lcp
