"""Long repeated passages: a Burrows-Wheeler transform of each bounded unit of text, searched breadth-first backwards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, cut, fresh, in_bitmap, mix, slices, text_bytes, with_groups

#: Bytes (25ths of a window) whose smallest hash in a window says where it is compared; longer ones where that has too many texts.
ANCHORS = (8, 16, 22)
#: Bytes of text that one unit of work holds, give or take a factor of two.
UNIT = 1 << 20
#: Windows whose hashes are held at a time.
BLOCK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
#: Low bits of a packed key, which hold a place within a block.
_PLACE = np.uint64(24)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def _anchor(size: int, level: int) -> int:
    return max(1, size * ANCHORS[level] // 25) if level < len(ANCHORS) else size


# --- windows by anchor ----------------------------------------------------------------------------


def segments(raw: np.ndarray, offset: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, width, anchor's hash, text): runs of neighbouring windows of `size` bytes, each within one text, that have
    the same anchor: of the strings of `anchor` bytes in a window the one with the smallest hash, the first of equals.
    Equal windows have equal anchors, wherever they stand. A run has `width` windows and width + size - 1 bytes."""
    out = []
    last = np.repeat(offset[1:], np.diff(offset)) - size
    w = size - anchor + 1
    for a in range(0, max(0, len(raw) - size + 1), BLOCK):
        b = min(a + BLOCK, len(raw) - size + 1)
        part = raw[a : b + size - 1]
        n = len(part)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[part] * _power("up", _BASE, n), out=total[1:])
        h = mix((total[anchor:] - total[:-anchor]) * _power("down", _INVERSE, n + 1)[: n - anchor + 1])
        key = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
        # Smallest of each w neighbours: of what is left of a block border, and of what is right of it.
        x = np.concatenate([key, np.full(-len(key) % w, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
        before = np.minimum.accumulate(x, axis=1).ravel()[w - 1 : len(key)]
        after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()[: len(key) - w + 1]
        at = (np.minimum(before, after) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
        inside = np.arange(a, b) <= last[a:b]
        same = inside[1:] & inside[:-1] & (at[1:] == at[:-1])
        start = np.flatnonzero(inside & ~np.concatenate(([False], same)))
        end = np.flatnonzero(inside & ~np.concatenate((same, [False]))) + 1
        out.append((start + a, end - start, h[at[start]]))
    start, width, h = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.uint64)))
    return start, width, h.view(np.int64), np.searchsorted(offset, start, "right") - 1


def _digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes of the strings from start to end, as two columns."""
    data = memoryview(np.ascontiguousarray(raw))
    found = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


_ROW = "anchor array<long>, a array<long>, b array<long>, start array<long>, width array<long>, n array<long>, own array<struct<s:long,e:long>>"


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def _described(raw: np.ndarray, offset: np.ndarray, size: int, anchor: int, bitmap: np.ndarray | None) -> list[pa.Array]:
    """The columns of _ROW for some texts: their runs whose anchor the bitmap holds. Runs of one text with the same bytes
    come as one, n times; `own` has where these stand."""
    start, width, key, text = segments(raw, offset, size, anchor)
    if bitmap is not None:
        keep = in_bitmap(bitmap, key)
        start, width, key, text = start[keep], width[keep], key[keep], text[keep]
    ab = _digests(raw, start, start + width + size - 1)
    order = np.lexsort((start, ab[:, 1], ab[:, 0], text))
    s, a, b, t = start[order], ab[order, 0], ab[order, 1], text[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    n = np.bincount(group) if len(s) else np.zeros(0, np.int64)
    first = np.flatnonzero(new)
    twice = np.flatnonzero(n[group] > 1)
    ends = s + width[order] + size - 1
    m = len(offset) - 1
    base = offset[t]
    own = [_merged(s[i] - base[i], ends[i] - base[i]) for i in np.split(twice, np.flatnonzero(np.diff(t[twice])) + 1)] if len(twice) else []
    of = dict(zip(t[twice][np.concatenate(([True], np.diff(t[twice]) != 0))].tolist(), own, strict=True)) if len(twice) else {}
    count = np.bincount(t[first], minlength=m)
    spans = pa.array([[{"s": int(x), "e": int(y)} for x, y in zip(*of[i], strict=True)] if i in of else [] for i in range(m)], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
    columns = (key[order][first], a[first], b[first], (s - base)[first], width[order][first], n)
    return [*(_lists(count, np.asarray(c, np.int64)) for c in columns), spans]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as the maximal runs that they cover, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1])) if len(start) else np.zeros(0, bool)
    return start[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))] if len(end) else end


# --- the transform --------------------------------------------------------------------------------


def repeated_starts(text: np.ndarray, whole: np.ndarray, size: int) -> np.ndarray:
    """At which places of text begins a string of `size` bytes that begins at another place too; of places, only `whole` count.

    Suffixes are put in order to a depth of more than `size` bytes. The common prefixes of neighbours come from the
    intervals of strings of l bytes, l = 8, 9, ..: each interval is extended backwards by every byte before it, read
    from the transform, and where the new interval ends a prefix is l bytes, if none was found there before. Only intervals
    that found one go on. What is left at l = size are prefixes of that length or more. (Prefixes under eight bytes are
    read from the first eight.)
    """
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wide[j : j + n]
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order] = 1 + np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
    depth, bits = 8, n.bit_length()
    while depth <= size:
        at = 3 if 3 * bits <= 63 else 2
        both = rank.copy()
        for j in range(1, at):
            both = (both << bits) | np.concatenate([rank[j * depth :], np.zeros(min(n, j * depth), np.int64)])
        order = np.argsort(both, kind="stable")
        rank[order] = 1 + np.concatenate(([0], np.cumsum(np.diff(both[order]) != 0)))
        depth *= at
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(order > 0, place[order - 1], -1)  # LF: where the suffix one byte longer stands
    head = text[order]
    unlike = key[order][1:] ^ key[order][:-1]
    common = np.full(n + 1, -1, np.int64)
    common[0] = common[n] = 0
    some = np.flatnonzero(unlike)
    common[some + 1] = sum((unlike[some] < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(1, 8))
    high = some[common[some + 1] == 7]
    ends = np.concatenate(([-1], some))
    low = ends[np.searchsorted(some, high)] + 1
    for l in range(8, size):
        if not len(low):
            break
        many = high - low + 1
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        found = (before[at] << 32) | np.repeat(np.arange(len(low)), many)
        found = np.sort(found[found >= 0])
        to, of = found >> 32, found & 0xFFFFFFFF
        if not len(to):
            break
        byte = head[to]
        end = np.append((of[1:] != of[:-1]) | (byte[1:] != byte[:-1]), True)
        begin = np.concatenate(([True], end[:-1]))
        low, high = to[begin], to[end]
        new = common[high + 1] < 0
        low, high = low[new], high[new]
        common[high + 1] = l
    run = np.cumsum(common[:n] >= 0)
    valid = whole[order]
    twice = np.bincount(run[valid], minlength=run[-1] + 1 if n else 0) > 1
    out = np.zeros(n, bool)
    out[order[valid & twice[run]]] = True
    return out


def covered(texts: list[bytes], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the ranges covered by strings of `size` bytes that start elsewhere in these texts as well."""
    data = np.frombuffer(b"".join(t + b"\0" for t in texts) + bytes(size + 16), np.uint8)
    length = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
    left = np.zeros(len(data), np.int64)
    of = np.repeat(np.arange(len(texts)), length)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
    left[begin[of] + inside] = length[of] - inside
    start = np.flatnonzero(repeated_starts(data, left >= size, size))
    text = np.searchsorted(begin, start, "right") - 1
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [_merged(s := start[a:b] - begin[i], s + size) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


# --- jobs -----------------------------------------------------------------------------------------


def _units(kinds: DataFrame, size: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(cold, hot): kinds of anchors that several have, (anchor, unit) of those whose texts fit a unit, and (anchor) of others.

    Anchors go where the smallest text that has them goes, so neighbours in near copies stay together and overlap only once.
    One text's anchors are dealt in order, as many as fit; texts with few share units.
    """
    bytes_ = F.col("width") + size - 1
    anchors = cut(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(bytes_).alias("bytes"), F.min("first").alias("owner")).where("kinds > 1"))
    some = anchors.where(F.col("bytes") <= most)
    ordered = Window.partitionBy("owner.md5").orderBy("owner.start", "anchor")
    so_far = F.sum("bytes").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    whole = F.sum("bytes").over(Window.partitionBy("owner.md5"))
    total = some.agg(F.sum("bytes")).first()[0] or 0
    shared = F.pmod(F.xxhash64("owner.md5"), F.lit(total // most + 1))
    slot = F.floor(so_far / most)
    cold = some.select("anchor", F.when(whole <= most, shared).otherwise(F.xxhash64("owner.md5", slot)).alias("unit"), "kinds")
    return cut(cold), anchors.where(F.col("bytes") > most).select("anchor", "kinds")


def _pieces(base: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(unit, md5, start, n, piece): the bytes that wanted (md5, unit or null, start, width, n) names. Runs of one text and
    unit that overlap are one piece; without a unit each is its own. Texts come by a sieve and a join on their hash."""
    schema = "unit long, md5 binary, start long, n long, piece binary"
    lists = wanted.groupBy("md5").agg(F.collect_list(F.struct("unit", "start", "width", "n")).alias("runs"))
    lists = cut(lists)
    bitmap = base.sparkSession.sparkContext.broadcast(bitmap_of(lists.select(F.xxhash64("md5").alias("x")), "x"))

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap.value, batch.column(2).to_numpy()))).select([0, 1])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for md5, text, runs in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    text, by = text.encode(), {}
                    for r in runs:
                        by.setdefault(r["unit"], []).append((r["start"], r["start"] + r["width"] + size - 1, r["n"]))
                    for unit, ranges in by.items():
                        if unit is None:
                            rows += [(None, md5, s, n, text[s:e]) for s, e, n in ranges]
                        else:
                            s, e = _merged(*(np.array(x, np.int64) for x in list(zip(*ranges, strict=True))[:2]))
                            rows += [(unit, md5, x, 1, text[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["unit", "md5", "start", "n", "piece"])

    texts = base.select("md5", "text", F.xxhash64("md5").alias("x")).mapInArrow(sieve, "md5 binary, text string")
    return texts.join(lists, "md5").select("md5", "text", "runs").mapInArrow(take, schema)


def _search(pieces: DataFrame, size: int) -> DataFrame:
    """(md5, s, e): what is covered within each unit."""

    def run(unit: pa.Table) -> pa.Table:
        found = covered(unit.column("piece").to_pylist(), size)
        n = [len(s) for s, _ in found]
        at = np.repeat(unit.column("start").to_numpy(), n)
        s, e = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(2))
        return pa.table({"md5": unit.column("md5").combine_chunks().take(pa.array(np.repeat(np.arange(len(n)), n))), "s": at + s, "e": at + e})

    return pieces.select("unit", "md5", "start", "piece").groupBy("unit").applyInArrow(run, "md5 binary, s long, e long")


def _bound(runs: DataFrame, base: DataFrame, same: DataFrame, size: int, most: int, level: int = 0) -> list[DataFrame]:
    """Ranges (md5, s, e) from runs (md5, anchor, a, b, start, width, n): runs with the same bytes cover each other; the
    rest of what shares an anchor is compared in units, or if it is too much for one, by longer anchors."""
    kinds = cut(runs.groupBy("anchor", "a", "b", "width").agg(F.sum("n").alias("n"), F.min(F.struct("md5", "start")).alias("first")))
    again = cut(kinds.where("n > 1").select("a", "b", F.col("n").alias("copies")))
    span = (F.col("start").alias("s"), (F.col("start") + F.col("width") + size - 1).alias("e"))
    found = [with_groups(runs, again, ["a", "b"], "copies").where("copies is not null").select("md5", *span)]
    cold, hot = _units(kinds, size, most)
    wanted = with_groups(kinds, cold, "anchor", "kinds").where("unit is not null").select(F.col("first.md5").alias("md5"), "unit", F.col("first.start").alias("start"), "width", "n")
    hot = cut(hot)
    more = not hot.isEmpty()
    if more:
        far = with_groups(kinds, hot, "anchor", "kinds").where("kinds is not null")
        wanted = wanted.unionByName(far.select(F.col("first.md5").alias("md5"), F.lit(None).cast("long").alias("unit"), F.col("first.start").alias("start"), "width", "n"))
    pieces = cut(_pieces(base, wanted, size))
    if not same.isEmpty():
        # Copies of a text hand over the same pieces.
        twins = pieces.join(same.select("md5"), "md5", "left_semi").dropDuplicates(["unit", "md5", "start"])
        pieces = cut(pieces.join(same.select("md5"), "md5", "left_anti").unionByName(twins.select(pieces.columns)))
    found.append(_search(pieces.where("unit is not null"), size))
    if more:
        anchor = _anchor(size, level + 1)

        def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    offset = np.concatenate(([0], np.cumsum(pa.compute.binary_length(part.column(3)).to_numpy())))
                    raw = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8)
                    start, width, key, text = segments(raw, offset, size, anchor)
                    ab = _digests(raw, start, start + width + size - 1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(text)), pa.array(key), pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.array(start - offset[text] + part.column(1).to_numpy()[text]), pa.array(width), part.column(2).take(pa.array(text))],
                        names=["md5", "anchor", "a", "b", "start", "width", "n"],
                    )

        longer = pieces.where("unit is null").select("md5", "start", "n", "piece").mapInArrow(deeper, "md5 binary, anchor long, a long, b long, start long, width long, n long")
        found += _bound(cut(longer), base, same, size, most, level + 1)
    return found


def _spans(base: DataFrame, same: DataFrame, size: int, most: int) -> DataFrame:
    """(md5, spans, n_removed) of texts that occur once and hold something that is elsewhere too. base: (id, md5, text)."""
    texts = base.where(F.octet_length("text") >= size)
    anchor = _anchor(size, 0)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                key, n = np.unique(segments(*text_bytes(part.column(0)), size, anchor)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    common = texts.select("text").mapInArrow(anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bitmap = base.sparkSession.sparkContext.broadcast(bitmap_of(common, "anchor"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                columns = _described(*text_bytes(part.column(2)), size, anchor, bitmap.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "md5", "anchor", "a", "b", "start", "width", "n", "own"])

    kind = base.schema["id"].dataType.simpleString()
    rows = cut(texts.select("id", "md5", "text").mapInArrow(describe, f"id {kind}, md5 binary, {_ROW}").where("size(anchor) > 0"))
    told = with_groups(rows, same, "md5", "copies")
    single, twins = told.where("copies is null"), told.where("copies is not null and id <=> first_id").dropDuplicates(["md5"])
    zipped = F.explode(F.arrays_zip("anchor", "a", "b", "start", "width", "n")).alias("z")
    runs = single.unionByName(twins).select("md5", F.coalesce("copies", F.lit(1)).alias("copies"), zipped).select("md5", "z.anchor", "z.a", "z.b", "z.start", "z.width", (F.col("z.n") * F.col("copies")).alias("n"))
    found = _bound(cut(runs), base, same, size, most)
    found.append(single.select("md5", F.explode("own").alias("o")).select("md5", "o.s", "o.e"))
    ranges = found[0]
    for f in found[1:]:
        ranges = ranges.unionByName(f)
    ranges = ranges.join(same.select("md5"), "md5", "left_anti")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_merged(np.array(s, np.int64), np.array(e, np.int64)) for s, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)] for s, e in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, pa.array([int((e - s).sum()) for s, e in made], pa.int64())], names=["md5", "spans", "n_removed"])

    lists = ranges.distinct().groupBy("md5").agg(F.collect_list(F.struct("s", "e")).alias("r")).select("md5", "r.s", "r.e")
    return cut(lists.mapInArrow(merge, "md5 binary, spans array<struct<start:long,end:long>>, n_removed long"))


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 200, unit: int = UNIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans, kept_sha256.

    spans (start, end) are the maximal runs of bytes of the UTF-8 text that strings of `size` bytes cover which also start
    elsewhere: in another row, or at another place of the same, overlapping or not. n_removed is their length, kept_sha256
    the hash of the other bytes. Every such string counts as it was in the input. Null and empty texts, and those of
    fewer bytes than size, keep all they have. Repeated rows, and rows with equal texts, cover each other whole. Null ids
    are like others; texts are read whole, however long; no rows give no rows; other columns, whatever their names, play no part.

    Windows meet by their anchor, the least hash of a shorter string in them. What has an anchor of its own goes no
    further; equal runs of windows are counted; of what is left each distinct run goes once to a unit of bounded
    size, where a Burrows-Wheeler transform is searched. An anchor with more than a unit holds is split by longer ones.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("id", F.unhex(F.md5(F.encode("text", "utf-8"))).alias("md5"), "text")
    narrow = cut(base.select("id", "md5", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    same = cut(narrow.groupBy("md5").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1"))
    spans = _spans(base, same, size, unit)
    marked = with_groups(narrow, same, "md5", "copies").withColumn("whole", F.col("copies").isNotNull() & (F.col("n_bytes") >= size))
    told = marked.join(spans, "md5", "left")
    nothing = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    cut_spans = F.when(F.col("whole"), all_of_it).otherwise(F.coalesce("spans", nothing))
    plain = told.where("whole or spans is null").select("id", "n_bytes", F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.lit(0).cast("long")).alias("n_removed"), cut_spans.alias("spans"), F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"))
    partly = _kept(base, spans).select("id", F.octet_length("text").cast("long").alias("n_bytes"), "n_removed", "spans", F.sha2("kept", 256).alias("kept_sha256"))
    return plain.unionByName(partly).withColumnRenamed("id", "doc_id")


def _kept(base: DataFrame, spans: DataFrame) -> DataFrame:
    """base's rows with spans, and the bytes outside these."""
    bitmap = base.sparkSession.sparkContext.broadcast(bitmap_of(spans.select(F.xxhash64("md5").alias("x")), "x"))

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap.value, batch.column(3).to_numpy()))).select([0, 1, 2])

    kind = base.schema["id"].dataType.simpleString()
    some = base.select("id", "md5", "text", F.xxhash64("md5").alias("x")).mapInArrow(sieve, f"id {kind}, md5 binary, text string")
    return some.join(spans, "md5").withColumn("kept", _between(F.encode("text", "utf-8"), F.col("spans")))


def _between(data: Column, spans: Column) -> Column:
    """The bytes from one span's end to the next one's start."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(data).cast("long")))
    parts = F.zip_with(ends, starts, lambda a, b: F.hex(F.substring(data, (a + 1).cast("int"), (b - a).cast("int"))))
    return F.unhex(F.array_join(parts, ""))


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 200, unit: int = UNIT) -> DataFrame:
    """docs, all columns, and `kept` (with _ ahead while docs has such a column): the bytes of text that find_repeats() keeps,
    binary, as a cut may fall within a character. Rows and odd cases as there."""
    name, md5, copies, spans = fresh(docs, "kept", "md5", "copies", "spans")
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("id", F.unhex(F.md5(F.encode("text", "utf-8"))).alias("md5"), "text")
    same = cut(base.groupBy("md5").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1"))
    found = _spans(base, same, size, unit)
    marks = cut(same.select(F.col("md5").alias(md5), F.col("copies").alias(copies), F.lit(None).cast(found.schema["spans"].dataType).alias(spans)).unionByName(found.select(F.col("md5").alias(md5), F.lit(1).cast("long").alias(copies), F.col("spans").alias(spans))))
    said = F.coalesce(F.col(text), F.lit(""))
    rows = with_groups(docs.withColumn(md5, F.unhex(F.md5(F.encode(said, "utf-8")))), marks, md5, copies)
    all_ = F.encode(said, "utf-8")
    whole = (F.col(copies) > 1) & (F.octet_length(said) >= size)
    return rows.withColumn(name, F.when(whole, F.encode(F.lit(""), "utf-8")).when(F.col(spans).isNull(), all_).otherwise(_between(all_, F.col(spans)))).select(*(F.col(f"`{c}`") for c in docs.columns), name)
