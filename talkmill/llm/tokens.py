"""SentencePiece encoding and decoding by suffix-array matching, and token counts by a trie of pre-tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, tidy
from .pieces import BITS, NO_CHAR, SPACE, Pairs, Vocabulary, load_vocabulary, merge_plainly

#: Characters in one packed key, and keys that cover the longest piece.
IN_KEY = 4
#: Bytes of text that a task works on at a time; its arrays take some hundred times as much.
SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Units(NamedTuple):
    """code: characters of all texts on end, each behind its dummy space; number: theirs in the vocabulary; start: of each
    unit; hash: of each; doc: its text."""

    code: np.ndarray
    number: np.ndarray
    start: np.ndarray
    hash: np.ndarray
    doc: np.ndarray


def units_of(texts: pa.Array, v: Vocabulary) -> Units:
    """Texts cut where no piece can cross: before runs of spaces, and around characters that no piece holds."""
    said = [t for t in texts.to_pylist()]
    joined = "".join(SPACE + t for t in said if t).replace(" ", SPACE)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    at = np.minimum(np.searchsorted(v.chars, code), len(v.chars) - 1)
    number = np.where(v.chars[at] == code, at + 1, NO_CHAR)
    size = np.array([len(t) + 1 if t else 0 for t in said], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    n = len(code)
    cuts = np.zeros(n, bool)
    if v.splits:
        space = code == ord(SPACE)
        cuts[1:] = space[1:] & ~space[:-1]
    unknown = number == NO_CHAR
    cuts |= unknown
    cuts[1:] |= unknown[:-1]
    cuts[begin[:-1][size > 0]] = True
    start = np.flatnonzero(cuts)
    end = np.append(start[1:], n)
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 1), _BASE))))
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 1), _INVERSE))))
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * up[:n])))
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) if n else np.zeros(0, np.uint64)
    return Units(code, number, start, hashed, np.searchsorted(begin, start, "right") - 1)


# --- edges: which piece stands where --------------------------------------------------------------


class Matcher:
    """Occurrences of every piece in a text, by its suffix array."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.piece = np.flatnonzero((v.length > 1) & v.sound)
        self.keys = -(-int(v.length.max()) // IN_KEY)
        low = np.zeros((len(self.piece), self.keys * IN_KEY), np.int64)
        high = np.full_like(low, (1 << BITS) - 1)
        for i, p in enumerate(self.piece):
            low[i, : v.length[p]] = high[i, : v.length[p]] = v.text[p]
        self.low, self.high = (self._packed(x) for x in (low, high))

    def _packed(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.keys, len(x)), np.int64)
        for k in range(self.keys):
            for j in range(IN_KEY):
                out[k] = (out[k] << BITS) | x[:, k * IN_KEY + j]
        return out

    def _first(self, suffix: np.ndarray, keys: list[np.ndarray], goal: np.ndarray, above: bool) -> np.ndarray:
        """By binary search, for each piece at once, the first suffix not below (or above) its bound."""
        low, high = np.zeros(goal.shape[1], np.int64), np.full(goal.shape[1], len(suffix))
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            at = suffix[np.minimum(middle, len(suffix) - 1)]
            less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
            for k in range(self.keys):
                x = keys[0][np.minimum(at + k * IN_KEY, len(suffix))]
                less |= same & (x < goal[k])
                same &= x == goal[k]
            go = less | same if above else less
            low, high = np.where(open_ & go, middle + 1, low), np.where(open_ & ~go, middle, high)
        return low

    def edges(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of all occurrences of pieces of two characters or more."""
        n = len(number)
        padded = np.concatenate([number, np.zeros(IN_KEY, np.int64)])
        key = np.zeros(n + 1, np.int64)
        for j in range(IN_KEY):
            key[:n] = (key[:n] << BITS) | padded[j : j + n]
        # Suffixes in order of as many characters as the longest piece has: ranks of IN_KEY characters, then of pairs of ranks.
        order = np.argsort(key[:n], kind="stable")
        rank = np.zeros(n + 1, np.int64)
        rank[order] = 1 + np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        known = 1
        while known < self.keys:
            later = rank[np.minimum(np.arange(n) + known * IN_KEY, n)]
            both = rank[:n] * (n + 2) + later
            order = np.argsort(both, kind="stable")
            rank = np.zeros(n + 1, np.int64)
            rank[order] = 1 + np.concatenate(([0], np.cumsum(np.diff(both[order]) != 0)))
            known *= 2
        low, high = self._first(order, [key], self.low, False), self._first(order, [key], self.high, True)
        found = high - low
        where = np.repeat(low - np.concatenate(([0], np.cumsum(found)[:-1])), found) + np.arange(found.sum())
        return order[where], np.repeat(self.piece, found)


#: Characters up to which a unit is taken in one go; longer ones are cut into blocks of as many. Blocks that best_paths holds at once.
LONG, SIDE = 512, 128


def relax(v: Vocabulary, pairs: Pairs, unit: np.ndarray, size: np.ndarray, by_hand: np.ndarray, number: np.ndarray, start: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BPE pieces of each unit (at unit, of size characters), as (flat pieces, number of each unit's). start, piece: all
    edges of two characters or more within units.

    Every beginning of a unit has one BPE encoding, known by its last piece. Edges are taken by where they end: one
    whose piece may follow the last piece of what is before it is the last piece there. Units by_hand are merged one
    by one instead.
    """
    n = len(number)
    own = np.zeros(n, np.int64)
    own[unit] = 1
    of = np.cumsum(own) - 1
    alone = np.flatnonzero(v.single[number] >= 0)
    start, piece = np.concatenate([start, alone]), np.concatenate([piece, v.single[number[alone]]])
    mine = ~by_hand[of[start]]
    start, piece = start[mine], piece[mine]
    end = start + v.length[piece]
    step = end - unit[of[start]]
    order = np.argsort(step, kind="stable")
    start, piece, end, step = start[order], piece[order], end[order], step[order]
    bounds = np.searchsorted(step, np.arange(1, int(size[~by_hand].max(initial=0)) + 2))
    last = np.full(n + 1, -1, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        s, p, e = start[a:b], piece[a:b], end[a:b]
        first = s == unit[of[s]]
        good = first.copy()
        rest = np.flatnonzero(~first)
        before = last[s[rest] - 1]
        rest, before = rest[before >= 0], before[before >= 0]
        good[rest] = pairs(before, p[rest])
        last[e[good] - 1] = p[good]
    # Walk back from each unit's end, all units at once.
    at, live = unit + size, np.flatnonzero(~by_hand)
    unit_of, place, depth = [], [], []
    while len(live):
        p = last[at[live] - 1]
        if (p < 0).any():
            raise AssertionError("a unit has no encoding")
        unit_of.append(live)
        place.append(p)
        depth.append(np.full(len(live), -len(depth)))
        at[live] -= v.length[p]
        live = live[at[live] > unit[live]]
    for u in np.flatnonzero(by_hand):
        ids = np.array(merge_plainly(v, number[unit[u] : unit[u] + size[u]]), np.int64)
        unit_of.append(np.full(len(ids), u))
        place.append(ids)
        depth.append(np.arange(len(ids)))
    whose, flat, depth = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (unit_of, place, depth))
    order = np.lexsort((depth, whose))
    return flat[order], np.bincount(whose, minlength=len(unit))


def encode_units(v: Vocabulary, pairs: Pairs, unit: np.ndarray, size: np.ndarray, number: np.ndarray, start: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """relax() of units of any length. Units in which a piece of v.plain occurs (runs of spaces) are merged by hand.

    Longer units are cut into blocks that are encoded side by side. Two encodings stand side by side if their pieces at
    the seam may; where they may not, what lies around the seam is encoded again (_mend()).
    """
    own = np.zeros(len(number), np.int64)
    own[unit] = 1
    of = np.cumsum(own) - 1
    by_hand = np.zeros(len(unit), bool)
    by_hand[of[start[v.plain[piece]]]] = True
    long = (size > LONG) & ~by_hand
    if not long.any():
        return relax(v, pairs, unit, size, by_hand, number, start, piece)
    steady = np.array([bool(x) and _stretches(number[u : u + n]) != [] for x, u, n in zip(long, unit, size, strict=True)])
    if steady.any():
        # Runs of one or a few characters, in which blocks fit nowhere: these units are walked through, the rest goes on as before.
        order = np.argsort(start, kind="stable")
        at, ids = start[order], piece[order]
        parts: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(steady).tolist():
            a, b = np.searchsorted(at, [unit[i], unit[i] + size[i]])
            parts[i] = _walked(v, pairs, number[unit[i] : unit[i] + size[i]], at[a:b] - unit[i], ids[a:b])
        rest = ~steady
        in_rest = rest[of[start]]
        flat, total = encode_units(v, pairs, unit[rest], size[rest], number, start[in_rest], piece[in_rest]) if rest.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        split = iter(np.split(flat, np.cumsum(total)[:-1]) if rest.any() else [])
        made = [parts[i] if steady[i] else next(split) for i in range(len(unit))]
        return np.concatenate(made), np.array([len(m) for m in made], np.int64)
    blocks = np.where(long, -(-size // LONG), 1)
    whose = np.repeat(np.arange(len(unit)), blocks)
    offset = (np.arange(len(whose)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * LONG
    block, width = unit[whose] + offset, np.where(long[whose], np.minimum(LONG, size[whose] - offset), size[whose])
    end = start + v.length[piece]
    inside = end <= (block + width)[np.searchsorted(block, start, "right") - 1] if len(block) else np.zeros(0, bool)
    flat, count = relax(v, pairs, block, width, by_hand[whose], number, start[inside], piece[inside])
    to = np.cumsum(count)
    seam = to[:-1][whose[:-1] == whose[1:]]
    bad = seam[~pairs(flat[seam - 1], flat[seam])]
    total = np.bincount(whose, count, len(unit)).astype(np.int64)
    if len(bad):
        order = np.argsort(start, kind="stable")
        flat, total = _mend(v, pairs, unit, number, start[order], piece[order], flat, total, bad)
    return flat, total


#: The longest period that counts as a run, and characters from which on it does.
PERIOD, RUN = 8, 256


def _stretches(number: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, period) of the stretches of RUN characters or more that repeat with a period of PERIOD or less."""
    out: list[tuple[int, int, int]] = []
    for q in range(1, PERIOD + 1):
        same = np.concatenate(([False], number[q:] == number[:-q], [False])).astype(np.int8)
        edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for a, b in edges[np.diff(edges, axis=1)[:, 0] >= RUN].tolist():
            if not any(x <= a and b + q <= y for x, y, _ in out):
                out.append((a, b + q, q))
    return sorted(out)


def _walked(v: Vocabulary, pairs: Pairs, number: np.ndarray, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The BPE pieces of one unit, character by character: as relax(), which keeps each beginning's last piece.

    What may be last depends on the last pieces of the beginnings before it, as many as the longest piece is long, and on
    the characters. In a stretch that repeats, that state comes back sooner or later, and from then on all repeats, so
    the rest of the stretch is copied.
    """
    n, longest = len(number), int(v.length.max())
    alone = np.flatnonzero(v.single[number] >= 0)
    start, piece = np.concatenate([start, alone]), np.concatenate([piece, v.single[number[alone]]])
    end = start + v.length[piece]
    order = np.argsort(end, kind="stable")
    start, piece = start[order], piece[order]
    bounds = np.searchsorted(end[order], np.arange(n + 2))
    last = np.full(n + 1, -1, np.int64)  # by the beginning's length
    may: dict[tuple[int, int], bool] = {}
    stretches = _stretches(number)
    e, k, seen = 1, 0, {}
    while e <= n:
        while k < len(stretches) and e > stretches[k][1]:
            k, seen = k + 1, {}
        if k < len(stretches) and e - longest > stretches[k][0]:
            begin, stop, period = stretches[k]
            state = (e % period, last[e - longest : e].tobytes())
            if state in seen:
                back = e - seen[state]
                whole = (stop - e + 1) // back
                if whole > 0:
                    last[e : e + whole * back] = np.tile(last[e - back : e], whole)
                    e += whole * back
                    seen = {}
                    continue
            else:
                seen[state] = e
        for i in range(bounds[e], bounds[e + 1]):
            s, p = int(start[i]), int(piece[i])
            if s == 0:
                last[e] = p
            elif (before := int(last[s])) >= 0:
                if (before, p) not in may:
                    may[before, p] = bool(pairs(np.array([before]), np.array([p]))[0])
                if may[before, p]:
                    last[e] = p
        e += 1
    out, e = [], n
    while e:
        out.append(int(last[e]))
        e -= int(v.length[out[-1]])
    return np.array(out[::-1], np.int64)


def _mend(v: Vocabulary, pairs: Pairs, unit: np.ndarray, number: np.ndarray, start: np.ndarray, piece: np.ndarray, flat: np.ndarray, total: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat and total with right pieces around the seams `bad` (before which piece each lies). A window of pieces about
    each is encoded anew; if the new pieces may not stand beside those around it, the window grows. Windows that
    touch become one; one that fills its unit is right in any case. start is sorted."""
    to = np.cumsum(total)
    first = to - total
    of = np.searchsorted(to, bad, "right")
    pos = unit[np.repeat(np.arange(len(unit)), total)] + np.concatenate(([0], np.cumsum(v.length[flat])))[:-1]
    pos -= np.repeat(np.concatenate(([0], np.cumsum(v.length[flat])))[first.clip(max=len(flat))], total)
    reach = {}  # (first piece, piece after the last) -> new pieces
    grow = [(max(int(j) - 8, int(first[u])), min(int(j) + 8, int(to[u])), int(u)) for j, u in zip(bad, of, strict=True)]
    while grow:
        merged: list[list] = []
        for lo, hi, u in sorted([*grow, *((lo, hi, u) for (lo, hi, u) in reach)]):
            if merged and merged[-1][2] == u and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi, u])
        todo = [tuple(m) for m in merged if tuple(m) not in reach]
        reach = {tuple(m): reach[tuple(m)] for m in merged if tuple(m) in reach}
        numbers, starts, edges, begin, width, at = [], [], [], [], [], 0
        for lo, hi, u in todo:
            p = int(pos[lo])
            q = int(pos[hi - 1] + v.length[flat[hi - 1]])
            i, j = np.searchsorted(start, [p, q])
            inside = np.flatnonzero(start[i:j] + v.length[piece[i:j]] <= q) + i
            numbers.append(np.append(number[p:q], NO_CHAR))
            starts.append(start[inside] - p + at)
            edges.append(piece[inside])
            begin.append(at)
            width.append(q - p)
            at += q - p + 1
        made, n = relax(v, pairs, np.array(begin), np.array(width), np.zeros(len(todo), bool), np.concatenate(numbers), np.concatenate(starts), np.concatenate(edges))
        parts = np.split(made, np.cumsum(n)[:-1])
        grow = []
        for (lo, hi, u), ids in zip(todo, parts, strict=True):
            fits = (lo == first[u] or pairs(flat[lo - 1 : lo], ids[:1])[0]) and (hi == to[u] or pairs(ids[-1:], flat[hi : hi + 1])[0])
            if fits:
                reach[lo, hi, u] = ids
            else:
                more = hi - lo
                grow.append((max(lo - more, int(first[u])), min(hi + more, int(to[u])), u))
    out, at, total = [], 0, total.copy()
    for (lo, hi, u), ids in sorted(reach.items()):
        out += [flat[at:lo], ids]
        at = hi
        total[u] += len(ids) - (hi - lo)
    return np.concatenate([*out, flat[at:]]), total


def best_paths(v: Vocabulary, unit: np.ndarray, size: np.ndarray, number: np.ndarray, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The number of pieces of each unit's best unigram path (of equal scores the fewest), for units of any length.

    A unit is cut into blocks. SIDE of them at a time run side by side, from each place at which a piece may enter them,
    to each place beyond them at which one may leave; then they are joined in order.
    """
    longest, out = int(v.length.max()), np.zeros(len(unit), np.int64)
    alone = np.flatnonzero(v.single[number] >= 0)
    start, piece = np.concatenate([start, alone]), np.concatenate([piece, v.single[number[alone]]])
    order = np.argsort(start, kind="stable")
    start, piece = start[order], piece[order]
    for u in range(len(unit)):
        at, taken = np.full(longest, -np.inf), np.zeros(longest, np.int64)
        at[0] = 0.0
        stop = int(unit[u] + size[u])
        for begin in range(int(unit[u]), stop, LONG * SIDE):
            width = min(LONG * SIDE, stop - begin)
            i, j = np.searchsorted(start, [begin, begin + width])
            best, steps = _block_paths(v, start[i:j] - begin, piece[i:j], -(-width // LONG))
            for b in range(best.shape[2]):
                last = begin + b * LONG + LONG >= stop
                reach = [stop - begin - b * LONG] if last else range(LONG, LONG + longest)
                new = [max((at[o] + best[t, o, b], -int(taken[o] + steps[t, o, b])) for o in range(longest)) for t in reach]
                at, taken = np.array([x for x, _ in new]), np.array([-c for _, c in new])
        out[u] = taken[0]
    return out


def _block_paths(v: Vocabulary, start: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, pieces) of the best paths through n blocks, by (place reached, place entered, block); start counts from the first block's."""
    longest = int(v.length.max())
    score = np.full((longest + 1, LONG, n), -np.inf)
    score[v.length[piece], start % LONG, start // LONG] = v.score[piece]
    best = np.full((LONG + longest, longest, n), -np.inf)
    steps = np.zeros((LONG + longest, longest, n), np.int64)
    best[np.arange(longest), np.arange(longest)] = 0.0
    for t in range(LONG):
        for k in np.flatnonzero((score[:, t] > -np.inf).any(axis=1)):
            made, count = best[t] + score[k, t], steps[t] + 1
            better = (made > best[t + k]) | ((made == best[t + k]) & (count < steps[t + k]))
            best[t + k][better], steps[t + k][better] = made[better], count[better]
    return best, steps


class Encoder:
    """Units to pieces, with a memory of a bounded number of distinct units across the texts of one task."""

    def __init__(self, v: Vocabulary, most: int = 500_000):
        self.v, self.most = v, most
        self.matcher, self.pairs = Matcher(v), Pairs(v)
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.said = Said()

    def _pieces(self, u: Units, unit: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, at, n): the pieces of units, each at its place in flat."""
        size = end - unit
        known = u.number[unit] != NO_CHAR
        number, begin = apart(u.number, unit[known], size[known])
        start, piece = self.matcher.edges(number) if len(number) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat, count = encode_units(self.v, self.pairs, begin, size[known], number, start, piece)
        odd = [self.v.byte[list(chr(c).encode())] for c in u.code[unit[~known]].tolist()]
        at, n = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        n[known], n[~known] = count, [len(o) for o in odd]
        at[known], at[~known] = np.cumsum(count) - count, len(flat) + np.cumsum(n[~known]) - n[~known]
        return np.concatenate([flat.astype(np.int32), *(o.astype(np.int32) for o in odd)]), at, n

    def _learn(self, u: Units, hashes: np.ndarray, unit: np.ndarray, end: np.ndarray) -> None:
        flat, at, n = self._pieces(u, unit, end)
        hashed = np.concatenate([self.hash, hashes])
        order = np.argsort(hashed, kind="stable")
        self.hash, self.at = hashed[order], np.concatenate([self.at, at + len(self.flat)])[order]
        self.n, self.flat = np.concatenate([self.n, n])[order], np.concatenate([self.flat, flat])
        self.said.add(u, unit, end, order)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of each text's)."""
        u = units_of(texts, self.v)
        distinct, first, back = np.unique(u.hash, return_index=True, return_inverse=True)
        end = np.append(u.start[1:], len(u.code))
        new = ~np.isin(distinct, self.hash, assume_unique=True)
        if len(self.hash) + int(new.sum()) > self.most:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(u, distinct[new], u.start[first[new]], end[first[new]])
        slot = np.searchsorted(self.hash, distinct)[back]
        n, at, flat = self.n[slot], self.at[slot], self.flat
        if len(other := self.said.differ(u, end, slot)):
            more, at[other], n[other] = self._pieces(u, u.start[other], end[other])
            at[other] += len(flat)
            flat = np.concatenate([flat, more])
        where = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return flat[where], np.bincount(u.doc, n, len(texts)).astype(np.int64)


def apart(number: np.ndarray, unit: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, begin): the units on end, a character of no piece behind each."""
    span = size + 1
    begin = np.cumsum(span) - span
    where = np.repeat(unit - begin, span) + np.arange(span.sum())
    out = number[np.minimum(where, len(number) - 1)] if len(number) else number
    out[begin + span - 1] = NO_CHAR
    return out, begin


class Said:
    """The characters of the units that are remembered, to tell units of one hash apart."""

    def __init__(self):
        self.code, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, u: Units, unit: np.ndarray, end: np.ndarray, order: np.ndarray) -> None:
        size = end - unit
        where = np.repeat(unit - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.at = np.concatenate([self.at, len(self.code) + np.cumsum(size) - size])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.code = np.concatenate([self.code, u.code[where]])

    def differ(self, u: Units, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which units of u are not what is remembered at their slot."""
        size = end - u.start
        same = self.size[slot] == size
        # Units follow each other without gaps, so their characters in order are the text.
        at = np.where(same, self.at[slot], 0)
        where = np.repeat(at - u.start, size) + np.arange(len(u.code))
        wrong = self.code[np.minimum(where, max(len(self.code) - 1, 0))] != u.code if len(self.code) else np.zeros(0, bool)
        bad = ~same
        if wrong.any():
            bad[np.searchsorted(u.start, np.flatnonzero(wrong), "right") - 1] = True
        return np.flatnonzero(bad)


def decode_bytes(v: Vocabulary, raw: tuple[np.ndarray, np.ndarray], ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts on end, offsets): pieces' bytes, less the dummy space of each text. raw: see raw_table."""
    data, offset = raw
    size = offset[ids + 1] - offset[ids]
    where = np.repeat(offset[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out = data[where]
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
    full = np.flatnonzero(count > 0)
    drop = ends[full][out[ends[full]] == 32] if len(full) else np.zeros(0, np.int64)
    keep = np.ones(len(out), bool)
    keep[drop] = False
    return out[keep], ends - np.searchsorted(drop, ends)


def raw_table(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(v.raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in v.raw])))


def _texts(data: np.ndarray, offset: np.ndarray) -> pa.Array:
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offset) - 1, [None, pa.py_buffer(offset.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids, n_tokens, round_trip.

    ids are those of the BPE model in the file `model` (which must have a piece for every byte): identity normalisation,
    one dummy space ahead, spaces as U+2581, other characters as bytes. round_trip tells that decoding gives back the
    text; only a U+2581 in a text, which becomes a space, prevents it. Null and empty texts have no ids and come back
    empty (round_trip true). Null ids and repeated rows are encoded like others; texts are read whole, and a run of
    characters without spaces, however long, in blocks. No rows give no rows; other columns, whatever their names, play
    no part.

    Each task indexes the distinct units of a slice of texts by a suffix array, searches every piece in it, sorts the
    edges by where they end and relaxes them; units met before are looked up.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder, raw = Encoder(v), raw_table(v)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                texts = pa.compute.fill_null(part.column(1), "")
                ids, count = encoder(texts)
                data, offset = decode_bytes(v, raw, ids, count)
                said = "".join(texts.to_pylist()).encode()
                sizes = pa.compute.binary_length(texts).to_numpy().astype(np.int64)
                if len(data) == len(said) and (np.diff(offset) == sizes).all() and data.tobytes() == said:
                    same = np.ones(len(sizes), bool)
                else:
                    own = np.concatenate(([0], np.cumsum(sizes)))
                    out = data.tobytes()
                    same = np.array([out[offset[i] : offset[i + 1]] == said[own[i] : own[i + 1]] for i in range(len(sizes))], bool)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(count, pa.int64()), pa.array(same)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    kind = docs.select(doc_id).schema.fields[0].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def _lists_in_slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` ids."""
    count = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(count, (count[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of encoded: doc_id, text.

    Null or empty ids give an empty text; bytes that are not UTF-8 give U+FFFD. Null ids of rows and repeated rows are
    decoded like others, lists of any length in slices of some million ids (a longer list is one of its own); no rows give no rows;
    other columns, whatever their names, play no part.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        raw = raw_table(v)
        for batch in batches:
            for part in _lists_in_slices(batch):
                lists = part.column(1)
                count = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
                data, offset = decode_bytes(v, raw, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count)
                yield pa.RecordBatch.from_arrays([part.column(0), _texts(data, offset)], names=["doc_id", "text"])

    kind = encoded.select(doc_id).schema.fields[0].dataType.simpleString()
    return encoded.select(doc_id, F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


# --- counts ----------------------------------------------------------------------------------------


class Counter:
    """Numbers of tokens of units, by a trie whose nodes hold forward states. Without `unigram` only those of BPE are right."""

    def __init__(self, v: Vocabulary, most: int = 800_000, unigram: bool = True):
        self.unigram_too = unigram
        self.v, self.pairs, self.most = v, Pairs(v), most
        keys, target, self.piece = [], [], [-1]
        table: dict[tuple[int, int], int] = {}
        for p in np.flatnonzero(v.length > 0).tolist():
            at = 0
            for c in v.text[p].tolist():
                if (at, c) not in table:
                    table[at, c] = len(self.piece)
                    self.piece.append(-1)
                at = table[at, c]
            self.piece[at] = p
        for (at, c), to in table.items():
            keys.append((at << BITS) | c)
            target.append(to)
        order = np.argsort(keys)
        self.keys, self.target, self.piece = np.array(keys)[order], np.array(target)[order], np.array(self.piece)
        self._forget()

    def _forget(self) -> None:
        self.hash, self.n, self.unigram = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.said = Said()

    def edges(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of all pieces of two characters or more, by following the pieces' trie from every place at once."""
        place, live, starts, pieces = np.zeros(len(number), np.int64), np.arange(len(number)), [], []
        depth = 0
        while len(live):
            go = (place[live] << BITS) | number[live + depth]
            at = np.minimum(np.searchsorted(self.keys, go), len(self.keys) - 1)
            ok = self.keys[at] == go
            live = live[ok]
            place[live] = self.target[at[ok]]
            piece = self.piece[place[live]]
            done = (piece >= 0) & (self.v.length[piece] > 1)
            starts.append(live[done])
            pieces.append(piece[done])
            depth += 1
            live = live[live + depth < len(number)]
        return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *pieces])

    def _counts(self, u: Units, unit: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(BPE pieces, pieces of the best unigram path) of units: long ones in blocks, others by the trie of all."""
        size = end - unit
        known = u.number[unit] != NO_CHAR
        bpe, unigram = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        short, long = known & (size <= LONG), known & (size > LONG)
        bpe[short], unigram[short] = self.trie_counts(u.number, unit[short], size[short])
        if long.any():
            number, begin = apart(u.number, unit[long], size[long])
            start, piece = self.edges(number)
            sound = self.v.sound[piece]
            bpe[long] = encode_units(self.v, self.pairs, begin, size[long], number, start[sound], piece[sound])[1]
            if self.unigram_too:
                unigram[long] = best_paths(self.v, begin, size[long], number, start, piece)
        code = u.code[unit[~known]]
        bpe[~known] = unigram[~known] = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        return bpe, unigram

    def trie_counts(self, number: np.ndarray, unit: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(BPE pieces, pieces of the best unigram path) of each unit. Level by level, each node, a beginning that units
        share, gets its states once from those above: the last BPE piece and the number of pieces, the best unigram score
        (of equal ones the fewest pieces) and its number. Units read theirs off where they end."""
        v = self.v
        node = np.zeros(len(unit), np.int64)
        # There are no more nodes than the root and the units' characters.
        room, nodes = 1 + int(size.sum()), 1
        last, count, score, best = np.full(room, -1), np.zeros(room, np.int64), np.zeros(room), np.zeros(room, np.int64)
        by_hand = np.zeros(room, bool)  # a piece of v.plain occurs on the way here
        # Matches in progress at the nodes of the level above: where each began (a node), and its place in the pieces' trie.
        begun, place, holder = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bpe, unigram = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        live, depth = np.arange(len(unit)), 0
        while len(live):
            key, back = np.unique((node[live] << BITS) | number[unit[live] + depth], return_inverse=True)
            parent, char = key >> BITS, key & ((1 << BITS) - 1)
            # Each new node takes over its parent's matches, and one that begins at the parent.
            order = np.argsort(holder, kind="stable")
            begun, place, holder = begun[order], place[order], holder[order]
            low, high = np.searchsorted(holder, parent), np.searchsorted(holder, parent, "right")
            n = high - low
            take = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            whose = np.concatenate([np.repeat(np.arange(len(key)), n), np.arange(len(key))])
            begun = np.concatenate([begun[take], parent])
            place = np.concatenate([place[take], np.zeros(len(key), np.int64)])
            go = (place << BITS) | char[whose]
            at = np.minimum(np.searchsorted(self.keys, go), len(self.keys) - 1)
            ok = self.keys[at] == go
            whose, begun, place = whose[ok], begun[ok], self.target[at[ok]]
            first, nodes = nodes, nodes + len(key)
            holder = whose + first
            piece = self.piece[place]
            done = piece >= 0
            w, b, p = whose[done], begun[done], piece[done]
            hand = by_hand[parent]
            hand[w[v.plain[p]]] = True
            by_hand[first:nodes] = hand
            new_last, new_count = np.full(len(key), -1), np.zeros(len(key), np.int64)
            whole = (b == 0) & v.sound[p]
            rest = np.flatnonzero((b != 0) & (last[b] >= 0) & v.sound[p])
            good = whole.copy()
            good[rest] = self.pairs(last[b[rest]], p[rest])
            new_last[w[good]], new_count[w[good]] = p[good], count[b[good]] + 1
            last[first:nodes], count[first:nodes] = new_last, new_count
            if self.unigram_too:
                total = score[b] + v.score[p]
                order = np.lexsort((best[b], -total, w))
                w, b, total = w[order], b[order], total[order]
                lead = np.concatenate(([True], w[1:] != w[:-1])) if len(w) else np.zeros(0, bool)
                new_score, new_best = np.full(len(key), -np.inf), np.zeros(len(key), np.int64)
                new_score[w[lead]], new_best[w[lead]] = total[lead], best[b[lead]] + 1
                score[first:nodes], best[first:nodes] = new_score, new_best
            node[live] = back + first
            depth += 1
            ended = size[live] == depth
            stop = live[ended]
            bpe[stop], unigram[stop] = count[node[stop]], best[node[stop]]
            for i in stop[by_hand[node[stop]]]:
                bpe[i] = len(merge_plainly(v, number[unit[i] : unit[i] + size[i]]))
            live = live[~ended]
        return bpe, unigram

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        u = units_of(texts, self.v)
        distinct, where, back = np.unique(u.hash, return_index=True, return_inverse=True)
        end = np.append(u.start[1:], len(u.code))
        new = ~np.isin(distinct, self.hash, assume_unique=True)
        if len(self.hash) + int(new.sum()) > self.most:
            self._forget()
            new[:] = True
        if new.any():
            unit, to = u.start[where[new]], end[where[new]]
            bpe, unigram = self._counts(u, unit, to)
            hashed = np.concatenate([self.hash, distinct[new]])
            order = np.argsort(hashed, kind="stable")
            self.hash, self.n, self.unigram = hashed[order], np.concatenate([self.n, bpe])[order], np.concatenate([self.unigram, unigram])[order]
            self.said.add(u, unit, to, order)
        slot = np.searchsorted(self.hash, distinct)[back]
        n, unigram = self.n[slot], self.unigram[slot]
        if len(other := self.said.differ(u, end, slot)):
            n[other], unigram[other] = self._counts(u, u.start[other], end[other])
        return tuple(np.bincount(u.doc, x, len(texts)).astype(np.int64) for x in (n, unigram))


def counted(v: Vocabulary) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """What gives the numbers of BPE tokens of each text of a task's columns."""

    @tidy
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(v, unigram=False)
        for column in columns:
            parts = [pa.array(counter(pa.compute.fill_null(p.column(0), ""))[0], pa.int64()) for p in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0, SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.int64())

    return run


def with_token_counts(docs: DataFrame, model: str, name: str, text: str = "text") -> DataFrame:
    """docs plus `name`, count_tokens' n_tokens of each row's own text; for rows whose ids may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    @F.arrow_udf("long")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from counted(shared.value)(columns)

    return docs.withColumn(name, count(F.col(text)))


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_unigram.

    n_tokens is the number of ids that encode() gives; n_unigram that of the best path when the model's piece scores are
    read as a unigram model's (of equally good ones, the shortest). Null and empty texts have none. Null ids and repeated
    rows count like others; texts are read whole, long runs without spaces in blocks. No rows give no rows; other columns,
    whatever their names, play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                n, unigram = counter(pa.compute.fill_null(part.column(1), ""))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(unigram)], names=["doc_id", "n_tokens", "n_unigram"])

    kind = docs.select(doc_id).schema.fields[0].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_unigram long")
