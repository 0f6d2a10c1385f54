"""Keywords: counts, ranking, features, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .probes import keyword_counts


def keyword_features(tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, keyword, value): log1p of the keyword's count over the root of the number of tokens; rows of no hit are left out."""
    size = F.greatest(F.size("tokens"), F.lit(1))
    hits = tokens.select("doc_id", size.alias("n"), F.explode("tokens").alias("keyword")).join(F.broadcast(keywords), "keyword")
    return hits.groupBy("doc_id", "keyword").agg((F.log1p(F.count("*")) / F.sqrt(F.first("n"))).alias("value"))


def token_class_counts(tokens: DataFrame, label: str) -> DataFrame:
    """(token, label, weight, rows) from (doc_id, label, tokens, w): weighted occurrences and distinct rows."""
    long = tokens.select("doc_id", label, "w", F.explode("tokens").alias("token"))
    return long.groupBy("doc_id", label, "token").agg(F.sum("w").alias("w")).groupBy("token", label).agg(F.sum("w").alias("weight"), F.count("*").alias("rows"))


def rank_keywords(counts: DataFrame, label: str, classes: list[str], least: float, top: int | None = None, alpha: float = 0.5) -> DataFrame:
    """Keywords by log-odds x log1p(total) x sqrt(document frequency), each with the class it speaks for most; of equals the first class, then the first token."""
    counts = settled(counts)
    totals = counts.groupBy(label).agg(F.sum("weight").alias("class_total"))
    every = counts.agg(F.sum("weight").alias("grand")).crossJoin(counts.agg(F.count_distinct("token").alias("vocabulary")))
    by_token = counts.groupBy("token").agg(F.sum("weight").alias("total"), F.sum("rows").alias("doc_freq"), F.map_from_entries(F.collect_list(F.struct(label, "weight"))).alias("by_class"))
    grid = by_token.where(F.col("total") >= least).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(every))
    mine = F.coalesce(F.element_at("by_class", F.col(label)), F.lit(0.0)) + alpha
    other = F.col("total") - mine + 2 * alpha
    odds = F.log(mine / (F.col("class_total") + alpha * F.col("vocabulary"))) - F.log(other / (F.col("grand") - F.col("class_total") + alpha * F.col("vocabulary")))
    scored = grid.select("token", label, "total", "doc_freq", (odds * F.log1p("total") * F.sqrt("doc_freq")).alias("score"))
    position = F.array_position(F.array(*map(F.lit, classes)), F.col(label))
    best = scored.groupBy("token").agg(F.min(F.struct(-F.round("score", 9), position, F.col(label), "total", "doc_freq", "score")).alias("x"))
    rows = best.select("token", f"x.{label}", "x.total", "x.doc_freq", "x.score")
    return rows if top is None else rows.orderBy(F.desc(F.round("score", 9)), "token").limit(top)


def top_per_class(keywords: DataFrame, label: str, n: int, classes: int, tie: str | None = None) -> DataFrame:
    """Balanced choice of n: the best ceil(n / classes) of each class, then whatever ranks best overall."""
    share = -(-n // classes)
    each = Window.partitionBy(label).orderBy(F.desc("score"), "token")
    marked = keywords.withColumn("within", F.row_number().over(each))
    return marked.orderBy(F.col("within") > share, F.desc("score"), "token", *([tie] if tie else [])).limit(n)


def class_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """(label, n, weight): all rows over classes times the class's own."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all")))).select(label, "n", (F.col("all") / (classes * F.greatest("n", F.lit(1)))).alias("weight"))


def keyword_audit(rows: DataFrame, keywords: DataFrame, text: str, label: str) -> DataFrame:
    """(keyword, label, rows): texts of each class that contain the keyword, in one reading of the texts however many keywords there are."""
    return keyword_counts(rows, keywords, text, label)
