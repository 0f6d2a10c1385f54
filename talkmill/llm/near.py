"""Near-duplicate documents: MinHash bands propose, odd sketches estimate similarity and sift, full shingle sets confirm."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_GROUPS, SPACED, components, cut, fresh, mix, shingles, sifted, slices, split_words, tidy, tiled, tree, with_groups

BITS = 512


class Plan(NamedTuple):
    """words a shingle; percent: least similarity; rows a band; miss: chance that a pair just similar enough shares no band."""

    words: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-8

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    def differing(self, bits):
        """How many of the samples differ, as estimated from the XOR count of two odd sketches. Each differing sample
        flips a bit in either; d of them leave BITS / 2 * (1 - exp(-4 d / BITS)) bits set on average."""
        return -BITS / 4 * np.log(np.maximum(1 - 2 * np.asarray(bits) / BITS, 1e-9))

    @property
    def most_differing(self) -> float:
        """The largest estimate that goes on to be confirmed: six standard deviations above what just similar enough pairs
        have. The variance is that of the samples, and that of bits which meet in the sketch, brought to samples."""
        k, s = self.bands * self.rows, self.percent / 100
        d = k * (1 - s)
        return d + 6 * math.sqrt(k * s * (1 - s) + 2 * d * d / BITS * math.exp(8 * d / BITS))


def _signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k MinHash samples of each (non-empty) set."""
    random = np.random.default_rng(3)
    factor, shift = (random.integers(1, 1 << 63, k, dtype=np.uint64) for _ in range(2))
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), k), np.uint32)
    for i in range(k):
        out[:, i] = np.minimum.reduceat((values * (factor[i] | np.uint64(1)) + shift[i]) >> np.uint64(32), starts)
    return out


def _sketches(signatures: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and odd sketches: each sample flips the bit that it hashes to."""
    n, k = signatures.shape
    wide = signatures.astype(np.uint64)
    factor = np.random.default_rng(5).integers(1, 1 << 63, plan.rows, dtype=np.uint64) | np.uint64(1)
    keys = mix((wide.reshape(n, plan.bands, plan.rows) * factor).sum(axis=2, dtype=np.uint64) + mix(np.arange(plan.bands, dtype=np.uint64)))
    bit = (mix(wide + (np.arange(k, dtype=np.uint64) << np.uint64(32))) & np.uint64(BITS - 1)).astype(np.int64)
    flips = np.bincount((bit + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return keys.view(np.int64), np.packbits(flips.astype(np.uint8), axis=1)


def sketch(docs: DataFrame, doc_id: str, text: str, plan: Plan) -> DataFrame:
    """(id, n_shingles, set_key, bands, odd); the last three null for documents without words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                sets = shingles(split_words(part.column(1), SPACED), plan.words)
                full = [s for s in sets if len(s)]
                keys, odd = _sketches(_signatures(full, plan.bands * plan.rows), plan) if full else ([], [])
                rows = iter(zip(keys, odd, strict=True))
                made = [(len(s), *((hashlib.md5(s.tobytes()).digest(), *((k, o.tobytes()) for k, o in [next(rows)])) if len(s) else (None, (None, None)))) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary()),
                        pa.array([m[2][0] for m in made], pa.list_(pa.int64())), pa.array([m[2][1] for m in made], pa.binary()),
                    ],
                    names=["id", "n_shingles", "set_key", "bands", "odd"],
                )

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "id long, n_shingles long, set_key binary, bands array<long>, odd binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _bits(odd) -> np.ndarray:
    return np.frombuffer(b"".join(odd), np.uint64).reshape(len(odd), -1)


class _Unit:
    """A unit's rows as arrays, and the pairs of them that may be linked."""

    def __init__(self, unit: pd.DataFrame, plan: Plan):
        self.plan, self.unit = plan, unit
        self.bits = _bits(unit["odd"])
        self.n, self.tile, self.label = (unit[c].to_numpy() for c in ("n", "tile", "label"))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By bucket, the pairs of different labels whose sizes fit and whose sketches are alike, left tile against right."""
        left, right = self.unit["left"].iloc[0], self.unit["right"].iloc[0]
        for rows in self.unit.groupby("key", sort=False).indices.values():
            one, other = rows[self.tile[rows] == left], rows[self.tile[rows] == right]
            found = np.bitwise_count(self.bits[one][:, None, :] ^ self.bits[other][None, :, :]).sum(axis=2)
            small, large = np.minimum(self.n[one][:, None], self.n[other][None, :]), np.maximum(self.n[one][:, None], self.n[other][None, :])
            may = (self.label[one][:, None] != self.label[other][None, :]) & (100 * small >= self.plan.percent * large) & (self.plan.differing(found) <= self.plan.most_differing)
            i, j = np.nonzero(may)
            yield one[i], other[j]


def _sift(unit: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """The rows of a unit, one or two tiles, that have a partner in it."""
    some = np.zeros(len(unit), bool)
    for i, j in _Unit(unit, plan).pairs():
        some[i] = some[j] = True
    return unit[some]


def _confirm(unit: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """Links that join what is apart in what _sift left of a unit, checked on full sets."""
    ids, label = unit["id"].to_numpy(), unit["label"].tolist()
    sets = [np.frombuffer(x, np.uint64) for x in unit["shingles"]]
    number = {x: i for i, x in enumerate(dict.fromkeys(label))}
    of, parent = [number[x] for x in label], np.arange(len(number))
    found = []
    for one, other in _Unit(unit, plan).pairs():
        for a, b in zip(one.tolist(), other.tolist()):
            root_a, root_b = tree(parent, of[a]), tree(parent, of[b])
            if root_a != root_b and _linked(sets[a], sets[b], plan.percent):
                parent[root_a] = root_b
                found.append((ids[a], ids[b]))
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _sets(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """(id, shingles) of wanted (id, set_key): texts are fetched by the narrow wanted, which goes to them if it is small; else a
    bitmap of it does, and only texts that this lets through are shuffled."""

    @tidy
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [s.tobytes() for s in shingles(split_words(part.column(1), SPACED), plan.words)]
                keep = [hashlib.md5(s).digest() == k for s, k in zip(sets, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"]).filter(pa.array(keep, pa.bool_()))

    wanted = cut(wanted)
    if wanted.count() <= BROADCAST_GROUPS:
        met = docs.join(F.broadcast(wanted), "id")
    else:
        met = sifted(docs, wanted, "id").join(wanted, "id")
    return met.select("id", "text", "set_key").mapInArrow(full, "id long, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles"))


#: Shingles whose sets one unit of confirmation holds.
UNIT = 1 << 21


def _confirm_pairs(pairs: DataFrame, docs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """Those of pairs (u, v, n: shingles of both) whose full sets are similar enough. Pairs are dealt by v, in as many
    parts as their sets need, so neither a v with many partners nor long texts fill a task."""
    load = cut(pairs.groupBy("v").agg(F.sum("n").alias("load"), F.count("*").alias("m")))
    parts = (load.agg(F.sum("load")).first()[0] or 0) // UNIT + 1
    unit = F.when(F.col("load") > UNIT, F.xxhash64("v", F.pmod(F.xxhash64("u"), F.ceil(F.col("load") / UNIT)))).otherwise(F.pmod(F.xxhash64("v"), F.lit(parts)))
    dealt = cut(with_groups(pairs, load, "v", "m").select("u", "v", unit.alias("unit")))
    needs = dealt.select("unit", F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = needs.select("id").distinct().join(reps.select("id", "set_key"), "id")
    held = needs.withColumnRenamed("unit", "part").join(_sets(docs, wanted, plan), "id")

    def check(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        sets = {i: np.frombuffer(s, np.uint64) for i, s in zip(held["id"], held["shingles"], strict=True)}
        good = [_linked(sets[u], sets[v], plan.percent) for u, v in zip(pairs["u"], pairs["v"], strict=True)]
        return pairs.loc[good, ["u", "v"]]

    return dealt.groupBy("unit").cogroup(held.groupBy("part")).applyInPandas(check, "u long, v long")


def _residue(members: DataFrame, docs: DataFrame, reps: DataFrame, plan: Plan, tile: int) -> DataFrame | None:
    """Links between labels within buckets: members (key, id, label, n, odd) of buckets with several labels.

    A bucket is cut into tiles of neighbours by label and size, small buckets sharing tiles. Pairs of tiles are the units
    of work, unless both hold one and the same label or sizes that don't fit: so there are about as many as strangers
    meet. Units first see sketches only; sets come to the rows that this leaves.
    """
    tiles = cut(tiled(members, "key", ["label", "n", "id"], tile, pack=True))
    sizes = tiles.groupBy("key", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("from"), F.max("label").alias("to"))
    sizes = cut(sizes)
    over = sizes.groupBy("key").agg(F.count("*").alias("tiles")).where("tiles > 1").select("key")
    more = sizes.join(over, "key")
    one, other = more.alias("one"), more.alias("other")
    apart = "not (one.from = one.to and other.from = other.to and one.from = other.from)"
    pairs = one.join(other, "key").where(f"one.tile < other.tile and {apart} and 100 * least(one.high, other.high) >= {plan.percent} * greatest(one.low, other.low)")
    pairs = pairs.select("key", F.col("one.tile").alias("left"), F.col("other.tile").alias("right"))
    both = pairs.select("key", F.explode(F.array("left", "right")).alias("tile"), "left", "right")
    itself = sizes.where("from <> to").select("key", "tile", F.col("tile").alias("left"), F.col("tile").alias("right"))
    units = tiles.join(both.unionByName(itself), ["key", "tile"]).select("left", "right", "key", "tile", "id", "label", "n", "odd")
    kind = units.schema
    left = cut(units.groupBy("left", "right").applyInPandas(lambda u: _sift(u, plan), kind))
    if left.isEmpty():
        return None
    wanted = left.select("id").distinct().join(reps.select("id", "set_key"), "id")
    return left.join(_sets(docs, wanted, plan), "id").groupBy("left", "right").applyInPandas(lambda u: _confirm(u, plan), "u long, v long")


def near_links(docs: DataFrame, reps: DataFrame, plan: Plan, tile: int) -> tuple[DataFrame, DataFrame | None]:
    """(links, components): links (u, v) connect all documents that chains of similar pairs connect; components is (id,
    component) of them where it is known on the way, else None. docs: (id, text); reps: (id, n, set_key, bands, odd), one per set.

    First each member of a bucket meets the bucket's smallest id: sketches drop what is not alike, sets confirm the
    rest, and components of that label the members. Buckets under one label are done. In the others only members of
    different labels meet (_residue()).
    """
    bands = reps.select("id", F.explode("bands").alias("key"))
    buckets = cut(bands.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1"))
    members = cut(with_groups(bands, buckets, "key", "m").where("m > 1").select("key", "id", "first", "m"))
    light = cut(reps.join(members.select("id").distinct(), "id").select("id", "n", "set_key", "odd"))
    near = members.where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct()
    mine = near.join(light.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("odd").alias("ou")), "u")
    firsts = cut(near.groupBy("v").agg(F.count("*").alias("m")).join(light.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("odd").alias("ov")), "v"))
    met = with_groups(mine, firsts, "v", "m").where(f"100 * least(nu, nv) >= {plan.percent} * greatest(nu, nv)")

    @tidy
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = np.bitwise_count(_bits(batch.column(3).to_pylist()) ^ _bits(batch.column(4).to_pylist())).sum(axis=1)
                yield batch.select([0, 1, 2]).filter(pa.array(plan.differing(bits) <= plan.most_differing))

    pairs = cut(met.select("u", "v", (F.col("nu") + F.col("nv")).alias("n"), "ou", "ov").mapInArrow(alike, "u long, v long, n long"))
    links = cut(_confirm_pairs(pairs, docs, light, plan))
    labels = cut(components(links).select("id", "component"))
    named = members.join(labels, "id", "left").select("key", "id", "m", F.coalesce("component", "id").alias("label"))
    mixed = cut(named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("m")).where("a <> b").select("key", "m"))
    if mixed.isEmpty():
        return links, labels
    strangers = with_groups(named.select("key", "id", "label"), mixed, "key", "m").where("m > 1").join(light.select("id", "n", "odd"), "id").select("key", "id", "label", "n", "odd")
    more = _residue(strangers, docs, light, plan, tile)
    return (links, labels) if more is None else (links.unionByName(more), None)


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan = Plan(), tile: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct runs of plan.words words (cut at ASCII white space, A-Z lower-cased); a
    shorter one is a single run. Documents whose sets' Jaccard similarity is plan.percent % or more are linked, and
    component_id is the smallest id reached; kept marks its document. Null, empty and blank texts link with nothing;
    a null id stays alone, with a null component, and is kept. Ids are whole numbers. Repeated rows are one document
    and get the same result; where one id comes with several texts it links them all, and if it is the smallest id of
    more than one, the text whose set's hash is smallest stands for these. Very long texts are read whole. An empty
    table gives no rows; other columns, whatever their names, play no part.

    Equal sets collapse to one; ids, hashes and sketches are shuffled, texts only fetched for pairs that sketches leave.
    """
    spread = cut(sketch(docs, doc_id, text, plan))
    rows = spread.where("id is not null and n_shingles > 0")
    same = cut(rows.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    marked = with_groups(rows, same, "set_key")
    alone = marked.where("n is null").select("id", F.col("n_shingles").alias("n"), "set_key", "bands", "odd")
    firsts = marked.where("id = rep").groupBy("set_key", "id").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    reps = cut(alone.unionByName(firsts.select("id", "n", "set_key", "bands", "odd")))
    names = cut(rows.groupBy("id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b").select("id"))
    several = not names.isEmpty()
    if several:
        order = Window.partitionBy("id").orderBy("set_key")
        reps = cut(reps.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k"))
    links, found = near_links(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), reps, plan, tile)
    if several:
        # All texts of one id hang together.
        own = with_groups(rows.join(names, "id", "left_semi"), same, "set_key").select(F.col("id").alias("u"), F.coalesce("rep", "id").alias("v")).where("u <> v")
        links, found = links.unionByName(own.distinct()), None
    found = cut(components(links).select("id", "component")) if found is None else found
    groups = cut(same.join(found, F.col("rep") == F.col("id"), "left").select("set_key", "n", F.coalesce("component", "rep").alias("of_set")))
    told = with_groups(rows.select("id", "n_shingles", "set_key"), groups, "set_key")
    many = told.where("n is not null").select("id", "n_shingles", F.col("of_set").alias("component_id"))
    few = F.broadcast(found) if found.count() <= BROADCAST_GROUPS else found
    one = told.where("n is null").join(few, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    bare = spread.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return many.unionByName(one).unionByName(bare).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """docs, all columns, without the rows whose document is not its component's smallest id.

    Nulls, empty and very long texts, repeated rows and empty tables as in near_components(): rows that repeat a kept
    document stay, blank ones too. Columns of docs may have any names.
    """
    (name,) = fresh(docs, "gone")
    gone = cut(near_components(docs, doc_id, text, plan).where("not kept").select(F.col("doc_id").alias(name)).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_GROUPS else gone
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")
