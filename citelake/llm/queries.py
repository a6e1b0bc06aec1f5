"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citelake.llm import chat, contamination, jaccard, lexical, lm, mixing, quality, repeats, secrets, sharding, spelling, tokens, toxicity
from citelake.llm.store import short_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_quality(spark, d):
    return quality.quality_rules(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op2_mixing(spark, d):
    return mixing.mix_sizes(table(spark, d, "documents"))


@query
def op6_jaccard_join(spark, d):
    return jaccard.near_copies(table(spark, d, "documents"))


@query
def op8_sharding(spark, d):
    return sharding.place(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query
def op10_decontamination(spark, d):
    return contamination.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_chat_formatting(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = vocabulary("byte_bpe_50k.json")
    return chat.digest(chat.assemble(chat.encode_turns(rows.unionByName(own), path)), path)


@query
def op5_token_counts(spark, d):
    return tokens.count_tokens(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op7_secret_scans(spark, d):
    return secrets.find_secrets(table(spark, d, "documents"))


@query
def op3_toxicity(spark, d):
    return toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op9_lm_scoring(spark, d):
    return lm.score_documents(table(spark, d, "documents"))


@query
def op13_spelling_variants(spark, d):
    return spelling.spelling_variants(table(spark, d, "documents"))


@query
def op11_ranked_search(spark, d):
    return lexical.rank_documents(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op12_substring_dedup(spark, d):
    return repeats.repeat_digests(table(spark, d, "documents"))
