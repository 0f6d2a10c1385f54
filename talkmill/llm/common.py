"""What several operators share: lineage cuts, byte-level words, connected components, tiles."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import Rounds, settled


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the session's checkpoint folder, so lost executors can reread it."""
    return settled(df)


#: Groups, and bytes of their columns, up to which a table of them is broadcast; beyond, only those of more than HOT rows are (there are
#: no more of these than rows / HOT) and the rest are joined by shuffle.
BROADCAST_GROUPS, BROADCAST_BYTES, HOT = 200_000, 32 << 20, 1_000_000


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of docs has, upper or lower case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def fits(groups: DataFrame) -> bool:
    """Whether a table, computed before, is small enough to be broadcast: by its rows and by their bytes."""
    said = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in groups.dtypes if kind in ("string", "binary")]
    n, size = groups.agg(F.count("*"), F.sum(sum(said, F.lit(0)).cast("long"))).first()
    return n <= BROADCAST_GROUPS and (size or 0) + 8 * n * len(groups.columns) <= BROADCAST_BYTES


def with_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """rows left-joined with groups (key, n: how many rows of it there are, ..), which were computed before; null: no
    group. No key gathers its rows in one task: small tables go to the rows, of large ones the hot groups do."""
    if fits(groups):
        return rows.join(F.broadcast(groups), key, "left")
    key = [key] if isinstance(key, str) else key
    more = [c for c in groups.columns if c not in key]
    hot = F.broadcast(groups.where(F.col(n) > HOT))
    one = rows.join(hot, key)
    other = rows.join(hot.select(*key), key, "left_anti").join(groups.where(F.col(n) <= HOT), key, "left")
    return one.select(*rows.columns, *more).unionByName(other.select(*rows.columns, *more))


#: Bits of a bitmap of hashes: 16 MB, whatever it holds. The fuller it is, the less it keeps out.
SIEVE = 1 << 27


def bitmap_of(keys: DataFrame, name: str) -> np.ndarray:
    """A bitmap of the longs in a column, to be broadcast and asked by in_bitmap()."""
    slot = F.pmod(F.col(name), F.lit(SIEVE)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((SIEVE // 32768, 4096), np.uint8)
    for r in rows.toLocalIterator():
        out[r["at"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the longs may be in it: all that are, and some others."""
    slot = keys & (SIEVE - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be one of keys': all that are, and some others. Expressions only: a bitmap in 4,096 parts goes to
    the rows by broadcast, so that what a shuffle join would throw away need not be shuffled."""
    slot = F.pmod(F.xxhash64(key), F.lit(SIEVE)) + 1
    parts = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    met = rows.withColumns({"__part": F.bitmap_bucket_number(slot), "__at": F.bitmap_bit_position(slot).cast("int")}).join(F.broadcast(cut(parts)), "__part")
    return met.where("shiftright(cast(conv(hex(substring(__bits, __at div 8 + 1, 1)), 16, 10) as int), __at % 8) % 2 = 1").select(*rows.columns)


def ascii_lower(text):
    """Lower-case A-Z only. lower() does just that when every character is one byte; translate is for the rest."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


# --- words of UTF-8 text, as byte ranges -------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at ASCII white space, and of words of letters, digits and non-ASCII (after lower-casing).
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """bytes: lower-cased; start, end: of each word; doc: its text's number; first: each text's first word, one more at the end."""

    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offset: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and each one's offset; null is empty."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offset[0] : offset[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offset - offset[0] if len(offset) else np.zeros(1, np.int64)


def split_words(texts: pa.Array, is_word: np.ndarray) -> Words:
    raw, offset = text_bytes(texts)
    raw = LOWER[raw]
    inside = is_word[raw]
    n = len(raw)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offset[:-1][np.diff(offset) > 0]
    before[full] = False
    after[full[1:] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offset)
    doc = np.repeat(np.arange(len(offset) - 1), np.diff(first))
    return Words(raw, start, end, doc, first, offset)


def hash_words(w: Words, end: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, or of its part up to `end`: one running polynomial, shifted back to each word's start."""
    end = w.end if end is None else end
    n = len(w.bytes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[w.bytes] * _power("up", _BASE, n), out=total[1:])
    return mix((total[end] - total[w.start]) * _power("down", _BASE_INVERSE, n + 1)[w.start] + (end - w.start).astype(np.uint64))


def shingles(w: Words, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `size` words; a shorter text is one shingle, one without words none."""
    h = hash_words(w)
    factor = [np.uint64(int(v) | 1) for v in np.random.default_rng(11).integers(1, 1 << 63, size, dtype=np.uint64)]
    n = max(0, len(h) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for i, f in enumerate(factor):
        rolled += h[i : i + n] * f
    rolled = mix(rolled)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            x = np.sort(rolled[a : b - size + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            short = np.array([(h[a:b] * np.array(factor[: b - a])).sum() + np.uint64(b - a)], np.uint64)
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, so that memory follows that and the longest text."""
    at, n = 0, batch.num_rows
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) if n else []
    while at < n:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


#: The C library's own way to do so, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand memory that is free again back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which goes through a task's batches, handing memory back before and after. A Python worker serves tasks of all stages in turn; what
    stays of one lies between what goes, so it would else keep the most that each of them took, and the next adds to that."""

    @wraps(run)
    def tidied(batches):
        give_back()
        yield from run(batches)
        give_back()

    return tidied


# --- connected components ----------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (id, component): the smallest id that each node reaches.

    First every node is put under the least of its neighbours and itself, which leaves the few edges between those.
    Then large-star and small-star steps alternate. Each takes minima by partial aggregation and joins them back, so no
    node's neighbours meet in one place. Nodes without edges do not appear. Empty edges give no rows.
    """
    every = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if every.isEmpty():
        return every.select(F.col("u").alias("id"), F.col("v").alias("component"))
    both = every.unionByName(every.select(F.col("v").alias("u"), F.col("u").alias("v")))
    under = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("top")))
    tops = every.join(under, "u").select("v", F.col("top").alias("a")).join(under.withColumnsRenamed({"u": "v", "top": "b"}), "v")
    e = cut(tops.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    found = _stars(e).withColumnsRenamed({"id": "top"})
    return under.join(found, "top", "left").select(F.col("u").alias("id"), F.coalesce("component", "top").alias("component"))


def _stars(e: DataFrame) -> DataFrame:
    """components() by alternating steps; e is checkpointed, with u > v."""
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    seen, rounds = None, Rounds(e.sparkSession)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = rounds.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


# --- tiles: bounded groups of rows whose pairs are compared block against block -----------------


def tiled(rows: DataFrame, group: str, order: list[str], size: int, pack: bool = False) -> DataFrame:
    """rows plus `tile`: at most `size` neighbours in (group, order) share one; with `pack`, small groups share tiles.

    Rows are dealt by range, so one group that holds a third of all rows is spread over many tasks.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("tile", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tile, left, last = TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            tiles = np.empty(batch.num_rows, np.int64)
            for i, g in enumerate(batch.column(names.index(group)).to_pylist()):
                if left == 0 or g != last and not pack:
                    tile, left, last = tile + 1, size, g
                tiles[i], left = tile, left - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tiles)], names=[*names, "tile"])

    return rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(number, schema)


def tree(parent: np.ndarray, x: int) -> int:
    """The root of x in a union-find forest."""
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x

