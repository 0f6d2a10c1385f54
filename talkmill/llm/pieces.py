"""A SentencePiece BPE vocabulary as arrays, and what decides which of its pieces may stand side by side."""

from __future__ import annotations

import heapq
from collections import Counter
from typing import NamedTuple

import numpy as np

SPACE = "▁"
#: Bits of a character's number in packed keys, and the number of those that no piece holds.
BITS, NO_CHAR = 13, 0
NEVER = np.int64(1) << 40


class Vocabulary(NamedTuple):
    """Arrays over pieces unless said otherwise.

    chars: the characters of multi-character matching, number i + 1; text, length: the pieces as character numbers;
    score; rank: when a merge makes the piece (0: a character); left, right: what it is last merged from; sound: BPE
    turns its text into itself; single: by character number, the piece that is this character (-1: none); byte: by byte
    value, its piece; pairs, made: sorted left * size + right of all pairs that join to a piece, and that piece's rank;
    plain: pieces that DP over last pieces can't place, as they rank before a part of theirs or tie with another; index: multi-character
    pieces by text, with their scores; raw: UTF-8 of each piece with spaces restored, byte pieces as their byte; splits: no piece holds a space after
    another character, so texts fall apart before each run of spaces.
    """

    chars: np.ndarray
    text: list[np.ndarray]
    length: np.ndarray
    score: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sound: np.ndarray
    single: np.ndarray
    byte: np.ndarray
    pairs: np.ndarray
    made: np.ndarray
    plain: np.ndarray
    index: dict[str, tuple[int, float]]
    raw: list[bytes]
    splits: bool


def _merged(text: str, score: dict[str, float]) -> list[tuple[str, str, str]]:
    """What BPE does with a text, character by character: (new, left, right) of each merge, and the pieces left at last
    as (piece, '', '')."""
    parts, done = list(text), []
    while True:
        best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
        if best is None:
            return done + [(p, "", "") for p in parts]
        i = -best[1]
        done.append((parts[i] + parts[i + 1], parts[i], parts[i + 1]))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def merge_plainly(v: Vocabulary, number: np.ndarray) -> list[int]:
    """The BPE pieces of one unit by merging: best score first, leftmost of equals."""
    parts = [chr(v.chars[k - 1]) for k in number]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts) and (found := v.index.get(parts[i] + parts[after[i]])):
            heapq.heappush(heap, (-found[1], i, parts[i] + parts[after[i]]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, text = heapq.heappop(heap)
        if not parts[i] or after[i] >= len(parts) or parts[i] + parts[after[i]] != text:
            continue  # either part has merged elsewhere meanwhile
        j = after[i]
        parts[i], parts[j], after[i] = text, "", after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [v.index[p][0] if len(p) > 1 else int(v.single[int(np.searchsorted(v.chars, ord(p))) + 1]) for p in parts if p]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a BPE model with byte fallback and identity normalisation. Runs once, where the job is put together."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    byte = np.full(256, -1, np.int64)
    for i in range(n):
        if model.is_byte(i):
            byte[int(text[i][3:-1], 16)] = i
    if (byte < 0).any():
        raise ValueError("the vocabulary has no piece for every byte")
    index = {t: i for i, t in enumerate(text) if not special[i]}
    score = {t: model.get_score(i) for t, i in index.items()}
    chars = np.array(sorted({ord(c) for t in index for c in t}), np.uint32)
    if len(chars) >= (1 << BITS) - 1:
        raise ValueError("too many characters")
    number = {chr(c): k + 1 for k, c in enumerate(chars.tolist())}
    order = {t: k + 1 for k, t in enumerate(sorted((t for t in index if len(t) > 1), key=lambda t: -score[t]))}
    rank, left, right = np.zeros(n, np.int64), np.arange(n), np.arange(n)
    sound = np.zeros(n, bool)
    for t, i in index.items():
        rank[i] = order.get(t, 0)
        if len(t) == 1:
            sound[i] = True
            continue
        steps = _merged(t, score)
        sound[i] = steps[-1] == (t, "", "")
        if sound[i]:
            left[i], right[i] = index.get(steps[-2][1], i), index.get(steps[-2][2], i)
    single = np.full(len(chars) + 1, -1, np.int64)
    for c, k in number.items():
        single[k] = index.get(c, -1)
    seen = Counter(score[t] for t in order)
    plain = (rank[left] > rank) | (rank[right] > rank)
    plain[[index[t] for t in order if seen[score[t]] > 1]] = True
    joined = [(index[t[:k]] * n + index[t[k:]], order[t]) for t in order for k in range(1, len(t)) if t[:k] in index and t[k:] in index]
    pairs, made = (np.array(x, np.int64) for x in zip(*sorted(joined), strict=True))
    return Vocabulary(
        chars,
        [np.array([number[c] for c in t], np.int64) if t in index and index[t] == i else np.zeros(0, np.int64) for i, t in enumerate(text)],
        np.array([len(t) if t in index else 0 for t in text]),
        np.array([score.get(t, 0.0) for t in text]),
        rank, left, right, sound, single, byte, pairs, made, plain, {t: (index[t], score[t]) for t in order},
        [bytes([int(t[3:-1], 16)]) if model.is_byte(i) else b"" if special[i] else t.replace(SPACE, " ").encode() for i, t in enumerate(text)],
        not any(SPACE in t.lstrip(SPACE) for t in index),
    )


def compatible(v: Vocabulary, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether BPE leaves the texts of one and other, put together, as just these two pieces.

    Merges at the seam are undone latest first. If ever the parts that meet there would have merged before the part
    undone last came about, the two cannot stand side by side.
    """
    one, other = one.copy(), other.copy()
    good = np.ones(len(one), bool)
    limit = np.full(len(one), NEVER)
    live = np.arange(len(one))
    while len(live):
        a, b = one[live], other[live]
        key = a * len(v.rank) + b
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        merge = np.where(v.pairs[at] == key, v.made[at], NEVER)
        bad = merge < limit[live]
        good[live[bad]] = False
        ra, rb = v.rank[a], v.rank[b]
        undo_a = ra > rb
        limit[live] = np.where(undo_a, ra, rb + 1)
        one[live] = np.where(undo_a, v.right[a], a)
        other[live] = np.where(undo_a, b, v.left[b])
        live = live[~bad & ((ra > 0) | (rb > 0))]
    return good


class Pairs:
    """compatible() with a memory of a bounded number of pairs."""

    def __init__(self, v: Vocabulary, most: int = 2_000_000):
        self.v, self.most = v, most
        self.keys, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    def __call__(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        key, back = np.unique(one * len(self.v.rank) + other, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        good = np.zeros(len(key), bool)
        good[known] = self.good[at[known]] if known.any() else False
        new = key[~known]
        if len(new):
            good[~known] = found = compatible(self.v, new // len(self.v.rank), new % len(self.v.rank))
            if len(self.keys) + len(new) > self.most:
                self.keys, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
            keys, flags = np.concatenate([self.keys, new]), np.concatenate([self.good, found])
            order = np.argsort(keys, kind="stable")
            self.keys, self.good = keys[order], flags[order]
        return good[back]
