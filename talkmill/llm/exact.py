"""Exact deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fits, fresh, sifted, with_groups


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, md5, norm): the normalised text and its 128-bit hash."""
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(doc_id).alias("id"), norm.alias("norm")).select("id", F.md5("norm").alias("md5"), "norm")


def _groups(rows: DataFrame, narrow: DataFrame, keep: str) -> tuple[DataFrame, DataFrame | None]:
    """(groups, collisions). groups: (md5, n, keep_id) of hashes that several rows share. Of these alone the texts are
    looked at: grouped by hash and bytes, with one row left per text and map task, they show whether a hash stands for
    more than one text. If any does, collisions holds (md5, norm, n, keep_id) of each such text; else it is None."""
    best = F.max("id") if keep == "max" else F.min("id")
    groups = cut(narrow.groupBy("md5").agg(F.count("*").alias("n"), best.alias("keep_id")).where("n > 1"))
    # A large table of groups is joined by shuffle; then a bitmap of it keeps most other texts out.
    some = rows if fits(groups) else sifted(rows, groups, "md5")
    members = with_groups(some, groups, "md5").where("n > 1").select("id", "md5", "norm")
    texts = members.groupBy("md5", "norm").agg(F.count("*").alias("n"), best.alias("keep_id"))
    twofold = cut(texts.groupBy("md5").agg(F.count("*").alias("texts")).where("texts > 1").select("md5"))
    if twofold.isEmpty():
        return groups, None
    return groups, cut(texts.join(twofold, "md5"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. keep: 'min' or 'max' id of
    the group stays. A repeated row is its own copy with the same id, and kept like it. Null ids never win unless a
    group has no other; then keep_id is null and its rows are kept. An empty table gives no rows; other columns of
    docs play no part. A text of any length is read whole.

    Rows go as (id, 128-bit hash, SHA-256); texts only of hashes that occur more than once, to compare their bytes.
    """
    rows = _hashed(docs, doc_id, text)
    narrow = cut(rows.select("id", "md5", F.sha2("norm", 256).alias("sha")))
    groups, collisions = _groups(rows, narrow, keep)
    alone = lambda n, k: (F.coalesce(n, F.lit(1)).alias("group_size"), F.when(n.isNull(), F.col("id")).otherwise(k).alias("keep_id"))
    if collisions is None:
        found = with_groups(narrow, groups, "md5").select("id", "sha", *alone(F.col("n"), F.col("keep_id")))
    else:
        split = F.broadcast(collisions.select("md5").distinct().withColumn("split", F.lit(True)))
        sure = with_groups(narrow.join(split, "md5", "left_anti"), groups, "md5").select("id", "sha", *alone(F.col("n"), F.col("keep_id")))
        odd = rows.join(split, "md5", "left_semi").join(collisions, ["md5", "norm"]).select("id", F.sha2("norm", 256).alias("sha"), F.col("n").alias("group_size"), "keep_id")
        found = sure.unionByName(odd)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """docs, all columns, with one row left of each group of equal texts.

    Nulls, empty and very long texts as in exact_groups(). Of rows that repeat both id and text, the one whose columns
    come first as JSON stays. No rows give no rows; columns of docs may have any names.
    """
    rows = _hashed(docs, doc_id, text)
    narrow = cut(rows.select("id", "md5"))
    groups, collisions = _groups(rows, narrow, keep)
    md5, norm, n, best, place = fresh(docs, "md5", "norm", "n", "best", "place")
    marked = docs.withColumn(norm, ascii_lower(F.coalesce(F.col(text), F.lit("")))).withColumn(md5, F.md5(norm))
    if collisions is None:
        found = with_groups(marked.drop(norm), groups.select(F.col("md5").alias(md5), F.col("n").alias(n), F.col("keep_id").alias(best)), md5, n)
    else:
        plain = groups.join(collisions, "md5", "left_anti").select(F.col("md5").alias(md5), F.lit(None).cast("string").alias(norm), F.col("n").alias(n), F.col("keep_id").alias(best))
        texts = collisions.select(F.col("md5").alias(md5), F.col("norm").alias(norm), F.col("n").alias(n), F.col("keep_id").alias(best))
        odd = F.broadcast(texts.select(md5).distinct())
        one = with_groups(marked.join(odd, md5, "left_anti").drop(norm), plain.drop(norm), md5, n)
        found = one.unionByName(marked.join(odd, md5, "left_semi").join(texts, [md5, norm]).drop(norm))
    left = found.where(F.col(n).isNull() | F.col(doc_id).eqNullSafe(F.col(best)))
    # Rows that repeat id and text are left together: if there are any, they are ranked, one per map task going on.
    if not narrow.groupBy("md5", "id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        said = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
        order = Window.partitionBy(md5, doc_id, ascii_lower(F.coalesce(F.col(text), F.lit("")))).orderBy(said)
        several = left.where(F.col(n).isNotNull()).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
        left = left.where(F.col(n).isNull()).unionByName(several)
    return left.drop(md5, n, best)
