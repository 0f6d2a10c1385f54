"""Alignment of two tokenizers' tokens: a pointer into each moves on in all documents of a batch at once."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import Rounds
from .common import slices

#: Bytes of text that a task aligns at a time, and A tokens after which a long document goes on in a lane of its own.
SLICE, LANE = 1 << 21, 1024
#: Pairs of ids whose counts are broadcast (24 MB); counts of others, all smaller, are joined by shuffle.
MOST_PAIRS = 2_000_000
#: How the byte-level vocabulary cuts texts before it merges, and from how much white space on its own library does it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = re.compile(r"\s{2000}")


# --- vocabularies ---------------------------------------------------------------------------------


class Tokenizers(NamedTuple):
    """Both as they are in their files, to be broadcast."""

    a: str
    b: bytes


def read_tokenizers(a: str, b: str) -> Tokenizers:
    """a: a byte-level BPE as JSON; b: a SentencePiece model."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return Tokenizers(f.read(), g.read())


def _printable() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: bytes that print stand for themselves, the rest
    follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(rest)}


class Bytes:
    """What each id stands for."""

    def __init__(self, said: list[bytes]):
        self.size = np.array([len(x) for x in said], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(said), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Encoders:
    """The two tokenizers of a task."""

    def __init__(self, files: Tokenizers):
        import sentencepiece
        import tiktoken

        self.files, self._whole = files, None
        model = json.loads(files.a)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        byte = _printable()
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        said = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items()} | {i: t.encode() for t, i in special.items()}
        self.a = Bytes([said.get(i, b"") for i in range(max(said) + 1)])
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={said[i]: i for i in vocabulary.values()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        n = self.pieces.get_piece_size()
        name = [self.pieces.id_to_piece(i) for i in range(n)]
        self.b = Bytes([bytes([int(t[3:-1], 16)]) if self.pieces.is_byte(i) else b"" if self.pieces.is_control(i) or self.pieces.is_unknown(i) else t.replace("▁", " ").encode() for i, t in enumerate(name)])
        self.shown = Decimals(max(len(self.a.size), n))

    def ids_a(self, text: str) -> list[int]:
        if not SPACES.search(text):
            return self.fast.encode_ordinary(text)
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_str(self.files.a)
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of A and of B: (ids of all texts on end, each one's number). Texts that either doesn't give back have none."""
        a = [self.ids_a(" " + t) if t else [] for t in texts]
        b = self.pieces.encode(texts, num_threads=1) if texts else []
        flat = [np.fromiter(itertools.chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (a, b)]
        count = [np.array([len(y) for y in x], np.int64) for x in (a, b)]
        said = [(" " + t).encode() if t else b"" for t in texts]
        size = np.array([len(s) for s in said], np.int64)
        want = np.frombuffer(b"".join(said), np.uint8)
        good = size > 0
        for ids, n, table in ((flat[0], count[0], self.a), (flat[1], count[1], self.b)):
            made, to = table.joined(ids), np.concatenate(([0], np.cumsum(table.size[ids])))[np.concatenate(([0], np.cumsum(n)))]
            if len(made) != len(want) or (np.diff(to) != size).any() or (made != want).any():
                raw = made.tobytes()
                good &= np.array([raw[to[i] : to[i + 1]] == said[i] for i in range(len(texts))], bool)
        if not good.all():
            for k in range(2):
                flat[k] = flat[k][np.repeat(good, count[k])]
                count[k] = np.where(good, count[k], 0)
        return (flat[0], count[0]), (flat[1], count[1])


class Decimals:
    """Ids as decimals, eight bytes each, the first digit lowest."""

    def __init__(self, n: int):
        if n > 10**7:
            raise ValueError("ids of more than seven digits")
        self.size = np.array([len(str(i)) for i in range(n)], np.int64)
        self.word = np.array([int.from_bytes(str(i).encode(), "little") for i in range(n)], np.uint64)


# --- a batch --------------------------------------------------------------------------------------


class Aligned(NamedTuple):
    """Over documents on end. link_a, link_b: tokens that overlap; cut_a, cut_b: the last tokens of each group, in order."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def align(size_a: np.ndarray, count_a: np.ndarray, size_b: np.ndarray, count_b: np.ndarray, lane: int = LANE) -> Aligned:
    """Walk through the tokens of all documents at once. size: bytes of each token; count: tokens of each document, whose A
    and B have the same bytes.

    The state is one pair of pointers for each document. A step links the two tokens that they are at; where both end, it
    cuts; and whichever ends first, or both, moves on. Documents that are through leave the state. A document of more than
    `lane` A tokens stands in it several times, from every lane-th one on, each time with the B token that lies there.
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    first = np.cumsum(count_a) - count_a
    lanes = -(-count_a // lane)
    i = np.repeat(first, lanes) + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
    stop = np.minimum(i + lane, np.repeat(first + count_a, lanes))
    j = np.searchsorted(end_b, end_a[i] - size_a[i], "right")
    links, cuts = [], []
    while len(i):
        a, b = end_a[i], end_b[j]
        links.append((i, j))
        both = a == b
        cuts.append((i[both], j[both]))
        i, j = i + (a <= b), j + (b <= a)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    link_a, link_b, cut_a, cut_b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for found in (links, cuts) for k in range(2))
    return Aligned(link_a, link_b, np.sort(cut_a), np.sort(cut_b))


def written(ids_a: np.ndarray, count_a: np.ndarray, ids_b: np.ndarray, count_b: np.ndarray, found: Aligned, shown: Decimals) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each document's groups as `a,a|b;a|b,b`."""
    last = [np.zeros(len(x), bool) for x in (ids_a, ids_b)]
    last[0][found.cut_a], last[1][found.cut_b] = True, True
    # A token comes after all of its side before it, and the other side's of earlier groups (B: of its own, too).
    group = [np.cumsum(x) - x for x in last]
    until_a, until_b = (np.concatenate(([0], c + 1)) for c in (found.cut_a, found.cut_b))
    place = [np.arange(len(ids_a)) + until_b[group[0]], np.arange(len(ids_b)) + until_a[group[1] + 1]] if len(ids_a) else [np.zeros(0, np.int64)] * 2
    n = len(ids_a) + len(ids_b)
    ids, after = np.zeros(n, np.int64), np.full(n, ord(","), np.uint64)
    for side, (x, mark) in enumerate(((ids_a, "|"), (ids_b, ";"))):
        ids[place[side]] = x
        after[place[side][last[side]]] = ord(mark)
    total = count_a + count_b
    ends = np.cumsum(total)[total > 0] - 1
    after[ends] = 0
    digits = shown.size[ids]
    word = shown.word[ids] | (after << (np.uint64(8) * digits.astype(np.uint64)))
    size = digits + (after > 0)
    data = word.view(np.uint8).reshape(-1, 8)[np.arange(8) < size[:, None]]
    return data, np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(total)))]


def _texts(column: pa.Array) -> list[str]:
    return pa.compute.fill_null(column, "").to_pylist()


def _list(count: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(values.astype(np.int32)))


def align_tokens(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, a_ids, b_ids, link_a, link_b, cut_a, cut_b.

    a_ids are the tokens of space + text by the byte-level BPE in the file a, b_ids those of the text by the SentencePiece
    model in b, special tokens' strings being plain text. link_a and link_b tell, side by side, which tokens (numbered from
    0) share a byte; cut_a and cut_b are the last tokens of groups, which end at the same byte. Null and empty texts, and
    those that either doesn't give back byte by byte, have empty lists. Null ids and repeated rows are like others; very long
    texts are read whole; no rows give no rows; other columns, whatever their names, play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizers(a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(shared.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                (ids_a, count_a), (ids_b, count_b) = encoders(_texts(part.column(1)))
                found = align(encoders.a.size[ids_a], count_a, encoders.b.size[ids_b], count_b)
                order = np.lexsort((found.link_b, found.link_a))
                columns = []
                for at_a, at_b in ((found.link_a[order], found.link_b[order]), (found.cut_a, found.cut_b)):
                    doc = np.searchsorted(np.cumsum(count_a), at_a, "right")
                    n = np.bincount(doc, minlength=len(count_a))
                    columns += [_list(n, at_a - (np.cumsum(count_a) - count_a)[doc]), _list(n, at_b - (np.cumsum(count_b) - count_b)[doc])]
                yield pa.RecordBatch.from_arrays([part.column(0), _list(count_a, ids_a), _list(count_b, ids_b), *columns], names=["doc_id", "a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b"])

    kind = docs.select(doc_id).schema.fields[0].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b")))


def _measured(docs: DataFrame, a: str, b: str, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(rows, wide): each row's counts, groups_sha256, and its distinct linked pairs (a * wide + b) with how often; wide: ids of B."""
    files = read_tokenizers(a, b)
    wide = len(Encoders(files).b.size)
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(shared.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                (ids_a, count_a), (ids_b, count_b) = encoders(_texts(part.column(1)))
                m = len(count_a)
                found = align(encoders.a.size[ids_a], count_a, encoders.b.size[ids_b], count_b)
                doc_of = np.repeat(np.arange(m), count_a)
                doc = doc_of[found.link_a]
                # Pairs by document: document above, pair below; few enough bits as a slice has fewer documents than bytes.
                pair = ids_a[found.link_a] * wide + ids_b[found.link_b]
                both = np.sort((doc << 40) | pair)
                new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(both)))
                distinct = np.bincount(both[new] >> 40, minlength=m)
                data, to = written(ids_a, count_a, ids_b, count_b, found, encoders.shown)
                raw = memoryview(data)
                digest = [hashlib.sha256(raw[to[i] : to[i + 1]]).hexdigest() if count_a[i] else "" for i in range(m)]
                groups, links = np.bincount(doc_of[found.cut_a], minlength=m), np.bincount(doc, minlength=m)
                pairs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(distinct))), pa.int32()), pa.array(both[new] & ((1 << 40) - 1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in (count_a, count_b, groups, links)), pa.array(digest, pa.string()), pairs, _list(distinct, times)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    kind = docs.select(doc_id).schema.fields[0].dataType.simpleString()
    made = docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    return made.withColumn("row", F.monotonically_increasing_id()), wide


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): in how many rows each of `pairs` is. Counted by batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_counts(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", most: int = MOST_PAIRS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; tokens, links and odd
    cases as in align_tokens().

    An id pair's count is the number of rows that hold it linked. n_best are the row's links whose count is the highest that
    their A id has (ties included), count_sum is the sum of its links' counts. groups_sha256 is of the groups, written as
    `a1,a2|b1;a3|b2,b3`; without tokens it is empty. Rows without tokens have zeros.

    Rows are aligned once and kept with their distinct pairs. Counts of pairs come from batches, then by partial sums. The
    largest counts, no more than `most`, are broadcast with the highest of each A id; what is not among them is joined,
    so a pair that many rows hold never gathers these in one task.
    """
    spark = docs.sparkSession
    made, wide = _measured(docs, a, b, doc_id, text)
    rows = Rounds(spark).keep(made)
    counts = Rounds(spark).keep(pair_counts(rows))
    top = {r["a"]: r["n"] for r in counts.groupBy(F.floor(F.col("pair") / wide).alias("a")).agg(F.max("n").alias("n")).toLocalIterator()}
    tops = np.zeros(max(top, default=0) + 1, np.int64)
    tops[list(top)] = list(top.values())
    # Counts of one need no table. Of the others, as many powers of two from above as fit.
    level = F.floor(F.log2("n"))
    sizes = sorted(counts.where("n > 1").groupBy(level.alias("level")).count().collect(), reverse=True)
    least, room = 64, most
    for lv, n in sizes:
        if n > room:
            break
        least, room = lv, room - n
    else:
        least = 1
    hot = counts.where((F.col("n") > 1) & (level >= least)).toArrow()
    order = np.argsort(hot.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast((hot.column("pair").to_numpy()[order], hot.column("n").to_numpy()[order], tops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, known, tops = shared.value
        for batch in batches:
            lists = batch.column(1)
            n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            pair, times = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            held = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            count = np.where(held, known[at] if len(pairs) else 0, 1)
            doc = np.repeat(np.arange(len(n)), n)
            settled = held if least > 1 else np.ones(len(pair), bool)
            best = settled & (count == tops[pair // wide])
            # Sums by running totals, whole numbers throughout.
            to = np.concatenate(([0], np.cumsum(n)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[to]) for x in (np.where(best, times, 0), np.where(settled, count * times, 0))]
            open_ = ~settled
            left = np.bincount(doc[open_], minlength=len(n))
            rest = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32()), pa.array(x[open_])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s) for s in sums), *rest], names=["row", "n_best", "count_sum", "pairs", "times"])

    sums = rows.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    told = rows.drop("pairs", "times")
    if least == 1:
        # The same pass over the same rows: no join, the other columns come along.
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

        def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (found,) = run(iter([batch.select([6, 7, 8])]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), found.column(1), found.column(2)], names=[*names, "n_best", "count_sum"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.select(*names, "row", "pairs", "times").mapInArrow(along, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    sums = Rounds(spark).keep(sums)
    rest = sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), "z.times")
    cold = counts.where(level < least)
    tables = spark.createDataFrame([(int(x), int(n)) for x, n in top.items()], "a long, top long")
    joined = rest.join(cold, "pair").withColumn("a", F.floor(F.col("pair") / wide)).join(F.broadcast(tables), "a")
    more = joined.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("times")).alias("c"))
    both = told.join(sums.select("row", "n_best", "count_sum"), "row").join(more, "row", "left")
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("c", F.lit(0))).alias("count_sum"))
