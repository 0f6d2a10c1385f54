"""Many probes over texts: one automaton of all keywords, run batch by batch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keywords that one automaton holds; more are searched in several passes over the texts.
MOST = 200_000


def _automaton(keywords: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, k in enumerate(keywords):
        if k:
            found.add_word(k, (i, len(k)))
    if len(found):
        found.make_automaton()
    return found


def _counts(automaton, blank: int | None, text: str | None) -> dict[int, int]:
    """By keyword: how often it occurs in the text, without overlaps, from the left; an empty one stands at every place."""
    out: dict[int, int] = {}
    if text is None:
        return out
    if blank is not None:
        out[blank] = len(text) + 1
    free: dict[int, int] = {}
    for end, (i, size) in automaton.iter(text) if len(automaton) else ():
        if end - size + 1 >= free.get(i, 0):
            free[i] = end + 1
            out[i] = out.get(i, 0) + 1
    return out


def _passes(keywords: DataFrame, keyword: str, most: int) -> Iterator[list[str]]:
    """The distinct keywords, as many at a time as an automaton may hold."""
    distinct = keywords.select(keyword).where(F.col(keyword).isNotNull()).distinct()
    parts = -(-distinct.count() // most)
    for k in range(parts):
        yield [r[0] for r in distinct.where(F.pmod(F.xxhash64(keyword), F.lit(parts)) == k).toLocalIterator()]


def keyword_hits(rows: DataFrame, keywords: DataFrame, text: str, keep: list[str], keyword: str = "keyword", most: int = MOST) -> DataFrame:
    """(keep.., keyword, n) of each row's text and each keyword that it contains, n times without overlaps; null texts
    and null keywords have no hits, repeated keywords count once. Each text is read once for all keywords of a pass."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{keyword}` string, n long"])
    out = rows.sparkSession.createDataFrame([], schema)
    for part in _passes(keywords, keyword, most):
        shared = rows.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words = shared.value
            automaton, blank = _automaton(words), words.index("") if "" in words else None
            for batch in batches:
                at, ids, n = [], [], []
                for row, said in enumerate(batch.column(len(keep)).to_pylist()):
                    found = _counts(automaton, blank, said)
                    at += [row] * len(found)
                    ids += found.keys()
                    n += found.values()
                kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([words[i] for i in ids], pa.string()), pa.array(n, pa.int64())], names=[*keep, keyword, "n"])

        out = out.unionByName(rows.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema))
    return out


def keyword_counts(rows: DataFrame, keywords: DataFrame, text: str, label: str, keyword: str = "keyword", most: int = MOST) -> DataFrame:
    """(keyword, label, rows): texts of each class that contain the keyword, counted by batch and then by partial sums."""
    kind = rows.schema[label].dataType.simpleString()
    schema = f"`{keyword}` string, `{label}` {kind}, rows long"
    out = rows.sparkSession.createDataFrame([], schema)
    for part in _passes(keywords, keyword, most):
        shared = rows.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words = shared.value
            automaton, blank = _automaton(words), words.index("") if "" in words else None
            for batch in batches:
                # By keyword and the first row of the batch with the label, so labels of any kind go back as they came.
                first: dict = {}
                total: Counter = Counter()
                for row, (of, said) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    total.update((i, first.setdefault(of, row)) for i in _counts(automaton, blank, said))
                ids, at = zip(*total) if total else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in ids], pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(total.values(), pa.int64())], names=[keyword, label, "rows"])

        out = out.unionByName(rows.select(label, F.col(text).alias("__text")).mapInArrow(run, schema))
    return out.groupBy(keyword, label).agg(F.sum("rows").alias("rows"))
