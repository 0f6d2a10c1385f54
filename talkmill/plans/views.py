"""The engine's tables as views over the driver's star schema, and the same in SQL.

turns: orders (a session is a customer). candidates: line items, one per order and line. messages: conversations.
examples: documents with their labels. probabilities: three numbers per document, drawn from a hash of its id.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

TAGS = ("template_low_information", "unsupported_third_party_motive", "third_party_excuse", "hard_boundary_fabrication", "adult_coaching_question")


#: Tables whose rows take long to work on, so that a single split would be felt.
TEXTS = ("documents", "conversations", "pages")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(rows) if name in TEXTS else rows

    @cached_property
    def candidates(self) -> DataFrame:
        order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]
        one = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*order)).alias("x"))
        tag = F.element_at(F.array(*map(F.lit, TAGS)), F.pmod(F.col("x.l_partkey"), F.lit(8)).cast("int") + 1)
        return one.select(
            F.col("l_orderkey").alias("turn_id"),
            F.col("l_linenumber").cast("long").alias("cand_no"),
            F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("candidate_id"),
            F.when(F.col("l_linenumber") % 2 == 1, "emotion_first").otherwise("solution_seeking").alias("orientation"),
            (F.col("x.l_partkey") % 3).cast("int").alias("er"),
            (F.col("x.l_suppkey") % 3).cast("int").alias("ip"),
            (F.col("x.l_quantity").cast("int") % 3).alias("ex"),
            (F.col("x.l_returnflag") == "R").alias("boundary"),
            F.col("x.l_linestatus").alias("linestatus"),
            F.round(F.col("x.l_discount") * 100).cast("int").alias("casel"),
            F.when(F.pmod("x.l_partkey", F.lit(8)) < len(TAGS), F.array(tag)).otherwise(F.array().cast("array<string>")).alias("tags"),
        ).withColumn("total", F.col("er") + F.col("ip") + F.col("ex") + 0.5 * (F.col("casel") / 10.0))

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("turn_id"),
            F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"),
            F.col("o_orderpriority").alias("scenario"),
            F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "O", "blocked_by_safety").otherwise("module_failed").alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.col("o_totalprice").alias("price"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").where("role <> 'system'").select(
            "conv_id", "turn", F.when(F.col("role") == "user", "student").otherwise("assistant").alias("role"), "text"
        )

    @cached_property
    def examples(self) -> DataFrame:
        return self.table("documents").join(self.table("labels"), "doc_id", "left").select(
            "doc_id", "text", F.col("lang").alias("scenario"), "source", "n_chars",
            F.when(F.col("toxic") == 1, "red").when(F.col("quality") == 0, "yellow").when(F.col("quality") == 1, "green").otherwise("reject").alias("safety"),
            F.when(F.col("quality") == 1, "exemplar").when(F.col("quality") == 0, "reference").otherwise("stats_only").alias("tier"),
            F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"),
        )

    @cached_property
    def probabilities(self) -> DataFrame:
        return drawn(self.table("documents"))


def drawn(docs: DataFrame) -> DataFrame:
    """(doc_id, text, p_green, p_yellow, p_red) of documents."""

    def draw(at: int):
        return F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), at, 4), 16, 10).cast("double") + 1

    a, b, c = draw(1), draw(5), draw(9)
    return docs.select("doc_id", "text", (a / (a + b + c)).alias("p_green"), (b / (a + b + c)).alias("p_yellow"), (c / (a + b + c)).alias("p_red"))


#: A saying for each family of safety signals; document d has those of the bits of d, so all combinations occur. Some documents say something else altogether.
SAYINGS = ("what a clown", "you moron", "I wish I was  dead", "I will kill myself", "I cut myself", "there are pills", "tonight", "I made a plan", "not really")
INSTEAD = ("Hello!", "I'm a bit tired.", "export MODE=1 make -f", "grep -r\nmain.sh", "grep -r main.sh")


def spoken(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text ..) with texts that say what SAYINGS and INSTEAD list."""
    bits = (F.when(F.shiftright("doc_id", i) % 2 == 1, F.lit(f". {s}")).otherwise("") for i, s in enumerate(SAYINGS))
    text = F.concat(F.coalesce("text", F.lit("")), *bits)
    for k, said in enumerate(INSTEAD):
        text = F.when(F.col("doc_id") % 23 == k, said).otherwise(text)
    return rows.withColumn("text", text)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SPOKEN = "spoken AS (SELECT * REPLACE (CASE doc_id % 23 " + " ".join(f"WHEN {k} THEN {_quoted(s)}" for k, s in enumerate(INSTEAD)) + " ELSE coalesce(text, '') || " + " || ".join(f"CASE WHEN (doc_id >> {i}) % 2 = 1 THEN {_quoted('. ' + s)} ELSE '' END" for i, s in enumerate(SAYINGS)) + " END AS text) FROM probabilities)"

SQL_VIEWS = """
candidates AS (SELECT *, er + ip + ex + 0.5::DOUBLE * (casel / 10.0::DOUBLE) AS total FROM (
  SELECT l_orderkey AS turn_id, l_linenumber::BIGINT AS cand_no, 'c' || l_linenumber AS candidate_id,
    CASE WHEN l_linenumber % 2 = 1 THEN 'emotion_first' ELSE 'solution_seeking' END AS orientation,
    (l_partkey % 3)::INT AS er, (l_suppkey % 3)::INT AS ip, trunc(l_quantity)::INT % 3 AS ex, l_returnflag = 'R' AS boundary, l_linestatus AS linestatus,
    round(l_discount * 100)::INT AS casel,
    CASE WHEN l_partkey % 8 < 5 THEN [['template_low_information', 'unsupported_third_party_motive', 'third_party_excuse', 'hard_boundary_fabrication', 'adult_coaching_question'][l_partkey % 8 + 1]] ELSE []::VARCHAR[] END AS tags
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus) = 1)),
turns AS (SELECT o_orderkey AS turn_id, 's' || o_custkey AS session_id, o_orderpriority AS scenario,
    CASE o_orderstatus WHEN 'F' THEN 'answered' WHEN 'O' THEN 'blocked_by_safety' ELSE 'module_failed' END AS status, o_orderdate AS created_at, o_totalprice AS price FROM orders),
messages AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'student' ELSE 'assistant' END AS role, text FROM conversations WHERE role <> 'system'),
examples AS (SELECT doc_id, text, lang AS scenario, source, n_chars,
    CASE WHEN toxic = 1 THEN 'red' WHEN quality = 0 THEN 'yellow' WHEN quality = 1 THEN 'green' ELSE 'reject' END AS safety,
    CASE quality WHEN 1 THEN 'exemplar' WHEN 0 THEN 'reference' ELSE 'stats_only' END AS tier,
    coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)),
probabilities AS (SELECT doc_id, text, a / (a + b + c) AS p_green, b / (a + b + c) AS p_yellow, c / (a + b + c) AS p_red FROM (
  SELECT doc_id, text, ('0x' || substr(h, 1, 4))::INT::DOUBLE + 1 AS a, ('0x' || substr(h, 5, 4))::INT::DOUBLE + 1 AS b, ('0x' || substr(h, 9, 4))::INT::DOUBLE + 1 AS c
  FROM (SELECT doc_id, text, md5(doc_id::VARCHAR) AS h FROM documents)))
"""
