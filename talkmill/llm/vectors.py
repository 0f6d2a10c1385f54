"""Near-duplicate vectors: exact cosine links by PCA-ordered tiles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_GROUPS, components, cut, with_groups

#: Leading dimensions that a tile's box covers, dimensions accumulated at a time, vectors in the PCA's sample, tiles in a block, most tiles that one meets at once.
BOX, STEP, SAMPLE, BLOCK, PARTNERS = 8, 16, 4096, 256, 32
#: Products this near to the limit are taken again from the vectors as given.
NEAR = 1e-9


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix, in their own precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision, brought to 1 first so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bases(sample: pa.Table) -> dict[int, np.ndarray]:
    """By length of vector, the axes of largest variance first (uncentred: products are to shrink, not distances)."""
    out = {}
    lengths = pa.compute.list_value_length(sample["v"]).to_numpy()
    for d in np.unique(lengths):
        x = _unit(_rows(sample.filter(pa.array(lengths == d))["v"].combine_chunks()))
        out[int(d)] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def _links(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(mask, close): which rows of a and b have a product of `least` or more, and which come too near to tell. Products
    grow by STEP leading dimensions; what the others can add is at most the product of their norms, and pairs that
    cannot get there are given up."""
    got = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], STEP):
        got += a[:, at : at + STEP] @ b[:, at : at + STEP].T
        rest = at + STEP
        if rest >= a.shape[1]:
            break
        may = got + np.sqrt((a[:, rest:] ** 2).sum(1))[:, None] * np.sqrt((b[:, rest:] ** 2).sum(1))[None, :] >= least - NEAR
        left = int(may.sum())
        if not left:
            return may, may
        if left < 0.05 * may.size:
            i, j = np.nonzero(may)
            whole = got[i, j] + np.einsum("ij,ij->i", a[i, rest:], b[j, rest:])
            close = np.zeros_like(may)
            may[i, j], close[i, j] = whole >= least, np.abs(whole - least) <= NEAR
            return may, close
    return got >= least, np.abs(got - least) <= NEAR


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine of two vectors as they were given, in double precision; scaled first only where squares would overflow or vanish."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    big = max(np.abs(x).max(), np.abs(y).max())
    if not 1e-100 < min(np.abs(x).max(), np.abs(y).max()) <= big < 1e100:
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))


def _compare(unit: pd.DataFrame, bases: dict[int, np.ndarray], least: float) -> pd.DataFrame:
    """A tile against its partners: for each vector of them its links here, and the smallest id that these reach."""

    def part(row) -> tuple:
        given = np.frombuffer(row["vectors"], row["kind"]).reshape(len(row["ids"]), -1)
        x = _unit(given)
        return np.array(row["ids"]), np.array(row["copies"]), given, x @ bases[x.shape[1]] if x.shape[1] in bases else x

    parts = {row["tile"]: part(row) for _, row in unit.iterrows()}
    left = int(unit["left"].iloc[0])
    ids, copies, given, a = parts[left]
    out = []
    for tile, (ids2, copies2, given2, b) in parts.items():
        if tile == left and not unit.loc[unit["tile"] == left, "itself"].iloc[0]:
            continue
        mask, close = _links(a, b, least)
        for i, j in zip(*np.nonzero(close)):
            mask[i, j] = _exact(given[i], given2[j]) >= least
        if tile == left:
            np.fill_diagonal(mask, False)
            mask |= mask.T
            links, near, names = mask @ copies, mask | np.eye(len(a), dtype=bool), ids
        else:
            links = np.concatenate([mask @ copies2, mask.T @ copies])
            near = np.block([[np.eye(len(a), dtype=bool), mask], [mask.T, np.eye(len(b), dtype=bool)]])
            names = np.concatenate([ids, ids2])
        some = links > 0
        names, links, near = names[some], links[some], near[some][:, some]
        reach, before = names, None
        while len(names) and (before is None or (reach != before).any()):
            before = reach
            reach = np.where(near, reach[None, :], np.iinfo(np.int64).max).min(axis=1)
        out.append(pd.DataFrame({"id": names, "links": links, "reach": reach}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "reach": []}, dtype="int64")


def _bound(one: str, other: str) -> str:
    """The largest product that vectors of two boxes can have."""
    return f"""aggregate(transform(sequence(0, size({one}.low) - 1), i -> greatest({one}.low[i] * {other}.low[i], {one}.low[i] * {other}.high[i],
        {one}.high[i] * {other}.low[i], {one}.high[i] * {other}.high[i])), 0D, (a, x) -> a + x) + {one}.rest * {other}.rest"""


def _meetings(tiles: DataFrame, least: float) -> DataFrame:
    """(left, right) of tiles of one group whose boxes allow a link, by way of blocks of BLOCK neighbours: pairs of blocks
    are few, and their tiles are paired block by block, so the tiles of one label don't meet in one task."""
    boxes = tiles.select("tile", "group", F.floor(F.col("tile") / BLOCK).alias("block"), "low", "high", "rest")
    lead = F.max(F.size("low")).alias("d")
    sides = [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(BOX)]
    array = lambda c: F.slice(F.array(*(F.col(f"{c}{i}") for i in range(BOX))), F.lit(1), F.col("d")).alias(c)
    blocks = cut(boxes.groupBy("group", "block").agg(lead, *sides, F.max("rest").alias("rest")).select("group", "block", array("low"), array("high"), "rest"))
    one, other = blocks.alias("one"), blocks.alias("other")
    met = one.join(other, "group").where(f"one.block <= other.block and {_bound('one', 'other')} >= {least} - {NEAR}")
    met = met.select("group", F.col("one.block").alias("a"), F.col("other.block").alias("b")).repartition("group", "a", "b")
    left = met.join(boxes.select("group", F.col("block").alias("a"), F.struct("tile", "low", "high", "rest").alias("one")), ["group", "a"])
    both = left.join(boxes.select("group", F.col("block").alias("b"), F.struct("tile", "low", "high", "rest").alias("other")), ["group", "b"])
    return both.where(f"one.tile <= other.tile and {_bound('one', 'other')} >= {least} - {NEAR}").select(F.col("one.tile").alias("left"), F.col("other.tile").alias("right"))


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, tile: int = 1024
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels and equal length are linked when their cosine, in double precision, is `least` or
    more; all pairs count, found exactly: products of rotated vectors within 1e-9 of `least` are taken again from the
    vectors as given. Vectors that are null, empty or zero, or hold nulls, NaN or infinities, link with nothing, nor do
    rows with a null id (their component is null and they are kept). Repeated rows link with each other. Where one id
    comes with several vectors or labels, only the one of the smallest hash can link. Ids are whole numbers. An empty
    table gives no rows; other columns, whatever their names, play no part.

    Equal vectors collapse to one with a number of copies, by a 128-bit hash. The rest is ordered by the axes of falling
    variance (fitted on a sample of SAMPLE; they only order the work), dealt by range of the first axis into tiles of
    `tile`, and two tiles meet only if their boxes in the leading axes and the norms beyond allow a link. Only counts
    and one link for each vector and pair of tiles come back.
    """
    v = F.col(embedding)
    fine = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    inner = vectors.schema[embedding].dataType
    kind = "float32" if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.FloatType) else "float64"
    kept = v.cast("array<float>" if kind == "float32" else "array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.concat_ws("/", F.size(v), F.col(label).cast("string")).alias("group"), kept.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    bare = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x = _rows(part.column(2)) + 0.0  # -0 is 0
                keys = [hashlib.md5(f"{g}/".encode() + r.tobytes()).digest() for g, r in zip(part.column(1).to_pylist(), x, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(keys, pa.binary())], names=["id", "group", "v", "key"])

    held = "float" if kind == "float32" else "double"
    good = cut(rows.where("fine").select("id", "group", "v").mapInArrow(hashed, f"id long, group string, v array<{held}>, key binary"))
    odd = cut(good.groupBy("id").agg(F.min("key").alias("own"), F.max("key").alias("last"), F.count("*").alias("n")).where("own <> last").select("id", "own", "n"))
    if not odd.isEmpty():
        told = with_groups(good, odd, "id")
        bare = bare.unionByName(told.where("own <> key").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
        good = cut(told.where("own is null or own = key").drop("own", "n"))
    same = cut(good.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    marked = with_groups(good, same, "key")
    firsts = marked.where("id = rep").groupBy("key", "id", "group", "n").agg(F.first("v").alias("v"))
    reps = cut(marked.where("rep is null").select("id", F.lit(1).cast("long").alias("copies"), "group", "v").unionByName(firsts.select("id", F.col("n").alias("copies"), "group", "v")))
    bases = _bases(reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow())

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(3)).to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x = _rows(part.column(3))
                unit = _unit(x)
                turned = unit @ bases[int(d)][:, :1] if int(d) in bases else unit[:, :1]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(turned[:, 0]), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "copies", "group", "lead", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        names = ["tile", "group", "ids", "copies", "vectors", "low", "high", "rest"]

        def packed(held: list) -> pa.RecordBatch:
            given = b"".join(r[3] for r in held)
            x = _unit(np.frombuffer(given, kind).reshape(len(held), -1))
            x = x @ bases[x.shape[1]] if x.shape[1] in bases else x
            box = x[:, :BOX]
            rest = float(np.sqrt((x[:, BOX:] ** 2).sum(1)).max())
            made = [number, held[0][2], [r[0] for r in held], [r[1] for r in held], given, box.min(0).tolist(), box.max(0).tolist(), rest]
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([m], k) for m, k in zip(made, kinds, strict=True)], names=names)

        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "copies", "group", "x")), strict=True):
                if held and (len(held) == tile or held[0][2] != row[2]):
                    yield packed(held)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield packed(held)

    led = reps.select("id", "copies", "group", "v").mapInArrow(lead, "id long, copies long, group string, lead double, x binary")
    tiles = cut(
        led.repartitionByRange("group", "lead", "id").sortWithinPartitions("group", "lead", "id")
        .mapInArrow(pack, "tile long, group string, ids array<long>, copies array<long>, vectors binary, low array<double>, high array<double>, rest double")
    )
    # A unit is a tile and at most PARTNERS others; the tile itself comes along once for each such part.
    met = cut(_meetings(tiles, least).withColumn("part", F.floor(F.col("right") / PARTNERS)))
    own = met.groupBy("left", "part").agg(F.bool_or(F.col("left") == F.col("right")).alias("itself")).select("left", "part", F.col("left").alias("tile"), "itself")
    dealt = met.where("left <> right").select("left", "part", F.col("right").alias("tile"), F.lit(False).alias("itself")).unionByName(own)
    units = tiles.select("tile", "ids", "copies", "vectors", F.lit(kind).alias("kind")).join(dealt, "tile")
    found = cut(units.groupBy("left", "part").applyInPandas(lambda u: _compare(u, bases, least), "id long, links long, reach long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("u"), F.col("reach").alias("v")))
    linked = cut(links.join(parts, "id", "left").select("id", "links", F.coalesce("component", "id").alias("component")))
    groups = cut(
        same.join(linked, F.col("rep") == F.col("id"), "left")
        .select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("of_links"), F.coalesce("component", "rep").alias("of_component"))
    )
    told = with_groups(good.select("id", "key"), groups, "key")
    many = told.where("n is not null").select("id", F.col("of_links").alias("n_links"), F.col("of_component").alias("component_id"))
    few = F.broadcast(linked) if linked.count() <= BROADCAST_GROUPS else linked
    one = told.where("n is null").join(few, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return many.unionByName(one).unionByName(bare).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
