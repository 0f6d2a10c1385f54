"""The operators over whole tables, with production parameters, as the entry point registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_counts
from .chat import format_chats, loss_text, read_back
from .common import cut
from .exact import exact_groups
from .licenses import scan_licenses
from .manifest import manifest
from .mixing import mix_hashes, mix_sources
from .near import Plan, near_components
from .repeats import find_repeats
from .tokens import count_tokens, encode, with_token_counts
from .toxicity import score_toxicity
from .urls import judge_urls
from .vectors import near_vectors


#: The public tokenizer that op1, op7 and the pipeline encode with; read on the driver, its arrays are broadcast.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: And the one that op12 aligns it with.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = score_toxicity(docs, labels, train=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_words", "passages")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), plan=Plan(words=3, percent=85))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), MODEL, "n")
    outer, inner = mix_hashes(F.col("doc_id"), F.col("text"))
    narrow = cut(docs.select("doc_id", "source", "n", outer.alias("outer"), inner.alias("inner")))
    mixed = mix_sources(narrow, tokens="n", names=("n_tokens", "epoch", "position"), hashes=("outer", "inner"))
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "position")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    probe = spark.sql(r"select -7L conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    formatted = format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(probe))
    back = formatted.select("conv_id", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE_LEVEL, MODEL)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("path")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_minhash_near_dedup, op4_url_filters, op5_embedding_near_dedup, op6_license_scans, op7_token_counts, op8_source_mixing, op9_chat_formatting, op10_exact_dedup, op11_suffix_array_dedup, op12_tokenizer_alignment, op13_merkle_manifest)}
