"""A Merkle manifest of a dataset: digests in trees of eight, and a version of the tree for each tampered leaf."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.queues import numbered
from .common import ascii_lower, cut, with_groups

#: Children of a node, and levels of an aligned block: 8 ** 3 leaves are in one task's hands at a time.
FAN, DEEP = 8, 3
BLOCK = FAN**DEEP


def _hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields: each `-` if null, else its UTF-8 bytes' number, `:` and value."""
    said = []
    for f in fields:
        value = f.cast("string")
        said.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*said), 256)


class Block:
    """Up to BLOCK neighbouring nodes and what stands above them, as a persistent tree: a version copies the path from its
    leaf up and shares every other node with the first one."""

    def __init__(self, nodes: list[str], levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([_hash(*below[i : i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[list[str], list[str]]]:
        """Level by level, the others of the node's run, left and right."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % FAN
            out.append((nodes[first:at], nodes[at + 1 : first + FAN]))
            at //= FAN
        return out


def copied_path(leaf: str, siblings: list[tuple[list[str], list[str]]]) -> list[str]:
    """The nodes that a version with this leaf has of its own, from the leaf up to the root."""
    out = [leaf]
    for left, right in siblings:
        out.append(_hash(*left, out[-1], *right))
    return out


def _depth(n: int) -> int:
    """Levels within a block, of a tree that has n nodes at the block's lowest."""
    levels = 0
    while n > 1 and levels < DEEP:
        n, levels = -(-n // FAN), levels + 1
    return levels


#: Siblings on the way up: of each level those to the left and those to the right.
_PATH = "array<struct<l:array<string>,r:array<string>>>"


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, at, n: nodes of the tree, digest), and the tables of the same form above it, each an aligned block's root
    for BLOCK nodes below. The last has one node a tree."""
    tables = [nodes]
    while not tables[-1].where("n > 1").isEmpty():
        def up(block: pa.Table) -> pa.Table:
            block = block.sort_by("at")
            n = block.column("n")[0].as_py()
            root = Block(block.column("digest").to_pylist(), _depth(n)).root
            return pa.table({"tree": block.column("tree")[:1], "at": [block.column("at")[0].as_py() // BLOCK], "n": [-(-n // BLOCK)], "digest": [root]})

        above = tables[-1].withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "block").applyInArrow(up, "tree long, at long, n long, digest string")
        tables.append(cut(above))
    return tables


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, at, path) of nodes, from above (tree, at, path), the same of their blocks' roots."""

    def down(block: pa.Table, over: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"tree": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "path": pa.array([], over.schema.field("path").type)})
        block = block.sort_by("at")
        tree = Block(block.column("digest").to_pylist(), _depth(block.column("n")[0].as_py()))
        rest = over.column("path")[0].as_py()
        paths = [[{"l": l, "r": r} for l, r in tree.siblings(i)] + rest for i in range(block.num_rows)]
        return pa.table({"tree": block.column("tree"), "at": block.column("at"), "path": pa.array(paths, over.schema.field("path").type)})

    grouped = nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "block")
    return grouped.cogroup(above.groupBy("tree", "at")).applyInArrow(down, f"tree long, at long, path {_PATH}")


def merkle_versions(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """leaves plus subroot, root, proof_sha256, path, path_at: the tree of all leaves, and the version that each row with a
    `changed` digest makes.

    leaves has columns leaf and changed (null: no version), digests as hex text. Per value of `tree` leaves stand in the
    order given, equal rows in any; eight consecutive nodes become their hash, as long as there is more than one. What
    remains of each value, in the order of the values (null first, then by UTF-8 bytes), becomes the root likewise.
    proof_sha256 is the hash of all siblings on the way from the leaf to the root. path holds the nodes that the version
    copies, from its leaf up to its root; all others it shares with the first tree.

    Rows are numbered without one task for all; a task holds aligned blocks of 512 nodes. Block roots are handled like
    leaves, round by round, and then hand down what stands above them, so that versions go on from their block to the
    root where their leaf is. A value of `tree` that holds most rows is many blocks.
    """
    counts = cut(leaves.groupBy(tree).agg(F.count("*").alias("n")))
    trees = cut(numbered(counts, F.col(tree)).select(F.col(tree), (F.col("number") - 1).alias("tree"), "n"))
    # Nulls are one tree; a join on a struct takes them as equal.
    key = F.struct(F.col(tree).alias("v"))
    keyed = with_groups(leaves.withColumn("__key", key), trees.select(key.alias("__key"), F.col("tree").alias("__tree"), "n"), "__key").drop("__key")
    placed = numbered(keyed, *(F.col(c) for c in order), "leaf", within=("__tree",))
    placed = cut(placed.withColumns({"__at": F.col("number") - 1, "__block": F.floor((F.col("number") - 1) / BLOCK)}).drop("number"))
    nodes = placed.select(F.col("__tree").alias("tree"), F.col("__at").alias("at"), "n", F.col("leaf").alias("digest"))
    below = _climb(nodes)
    # The trees' last nodes are the leaves of the upper tree; their own number says where.
    total = counts.count()
    subroots = cut(below[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(total).cast("long").alias("n"), "digest"))
    upper = _climb(subroots)
    root = upper[-1].select("digest").first()
    paths = upper[-1].select("tree", "at", F.expr(f"cast(array() as {_PATH})").alias("path"))
    for t in reversed(upper[:-1]):
        paths = cut(_paths(t, paths))
    paths = paths.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "path")
    for t in reversed(below[1:-1]):
        paths = cut(_paths(t, paths))
    named = paths.join(below[-1].select("tree", F.col("digest").alias("subroot")), "tree").withColumn("root", F.lit(root and root[0]))
    kept = [c for c in placed.columns if c not in ("__tree", "__at", "__block", "n")]
    schema = placed.select(*kept).schema

    def versions(block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("__at")
        made = Block(block.column("leaf").to_pylist(), _depth(block.column("n")[0].as_py()) if block.num_rows else 0)
        rest = [(p["l"], p["r"]) for p in over.column("path")[0].as_py()]
        above = "".join("".join(l) + "".join(r) for l, r in rest)
        proofs, paths = [], []
        for i, changed in enumerate(block.column("changed").to_pylist()):
            siblings = made.siblings(i)
            proofs.append(_hash(*("".join(l) + "".join(r) for l, r in siblings), above))
            paths.append(None if changed is None else copied_path(changed, siblings + rest))
        n = block.num_rows
        columns = {c: block.column(c) for c in kept} | {c: pa.array(np.repeat(over.column(c)[:1].to_numpy(zero_copy_only=False), n), pa.string()) for c in ("subroot", "root")}
        return pa.table(columns | {"proof_sha256": pa.array(proofs, pa.string()), "path": pa.array(paths, pa.list_(pa.string()))})

    out = T.StructType([*schema.fields, T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("proof_sha256", T.StringType()), T.StructField("path", T.ArrayType(T.StringType()))])
    return placed.groupBy("__tree", "__block").cogroup(named.groupBy("tree", "at")).applyInArrow(versions, out)


def manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    A row's leaf is the digest of its five fields; merkle_versions() says what is above, per lang by doc_id. Where 3
    divides the crc32 of the id's digits, the row is tampered with: A-Z of its text are lower-cased. folded_root is the
    root of the version which that makes (with the original leaf elsewhere), path what it copies, and verified says whether
    the root is the same as before. A null text stays null; a null id is a field like any other, comes first, and is not
    tampered with; repeated rows are leaves side by side; a lone leaf is its lang's subroot, and alone in the table the
    root; very long texts are hashed whole; no rows give no rows; other columns, whatever their names, play no part.
    """
    fields = [F.col(c) for c in (doc_id, source, lang, n_chars)]
    tampered = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0
    leaf, changed = leaf_of(*fields, F.col(text)), F.when(tampered, leaf_of(*fields, ascii_lower(F.col(text))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), leaf.alias("leaf"), F.coalesce(changed, leaf).alias("changed"))
    made = merkle_versions(cut(rows), "lang", ["doc_id"])
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", F.element_at("path", -1).alias("folded_root"), (F.element_at("path", -1) == F.col("root")).alias("verified"), "path")
