"""Agreement between extraction profiles, on mentions before de-duplication.

Every key is first brought to one row with a bit per agent; a document then has at most one row
per bit pattern, so that nothing grows with a document's mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions.text import rounded

_ALL = 2 ** len(dims.AGENTS) - 1


def agent_keys(mentions: DataFrame) -> DataFrame:
    """Distinct (doc, agent, key)."""
    return mentions.select("doc_id", "agent", "key").distinct()


def _bit(agent: Column) -> Column:
    return F.coalesce(*[F.when(agent == a, F.lit(1 << i)) for i, a in enumerate(dims.AGENTS)])


def key_agents(mentions: DataFrame) -> DataFrame:
    """One row per (doc, key) with the bit pattern of the agents that found it."""
    return mentions.groupBy("doc_id", "key").agg(F.bit_or(_bit(F.col("agent"))).alias("agents"))


def pattern_counts(mentions: DataFrame) -> DataFrame:
    """Keys per (doc, bit pattern)."""
    return key_agents(mentions).groupBy("doc_id", "agents").agg(F.count(F.lit(1)).alias("keys"))


def consensus(mentions: DataFrame) -> DataFrame:
    """Per document: agents present, distinct keys, keys of all agents, keys of some but not all."""
    return _per_document(mentions).select("doc_id", F.bit_count("present").alias("agents_present"), *_levels())


def _per_document(mentions: DataFrame) -> DataFrame:
    """One row per document: the agents present, and the number of keys of every bit pattern."""
    return pattern_counts(mentions).groupBy("doc_id").agg(
        F.bit_or("agents").alias("present"),
        *[F.sum(F.when(F.col("agents") == p, F.col("keys")).otherwise(0)).alias(f"__k{p}") for p in range(1, _ALL + 1)],
    )


def _pattern_sum(wanted) -> Column:
    """Keys over all bit patterns for which ``wanted(pattern)`` holds."""
    parts = [
        F.when(wanted(p), F.col(f"__k{p}")).otherwise(F.lit(0)) for p in range(1, _ALL + 1)
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total.cast("long")


def _levels() -> list[Column]:
    present = F.col("present")
    return [
        _pattern_sum(lambda p: F.lit(True)).alias("distinct_keys"),
        _pattern_sum(lambda p: F.lit(p) == present).alias("total_consensus"),
        _pattern_sum(lambda p: (F.lit(p) != present) & F.lit(bin(p).count("1") >= 2)).alias("partial_consensus"),
    ]


def unique_by_agent(mentions: DataFrame) -> DataFrame:
    """Per document and agent: keys that no other agent found."""
    single = F.coalesce(*[F.when(F.col("agents") == (1 << i), F.lit(a)) for i, a in enumerate(dims.AGENTS)])
    return (
        pattern_counts(mentions)
        .withColumn("agent", single)
        .where(F.col("agent").isNotNull())
        .select("doc_id", "agent", F.col("keys").alias("unique_keys"))
    )


def agreement_metrics(mentions: DataFrame) -> DataFrame:
    """Per document: agreement percentage, and each agent's coverage of the total consensus.

    Coverage is null where there is no total consensus and for agents the document does not have.
    """
    leveled = _per_document(mentions).select("doc_id", "present", *_levels())
    # a key of the total consensus was found by every agent present, so coverage is full or undefined
    coverage = [
        F.when(
            (F.col("total_consensus") > 0) & (F.col("present").bitwiseAND(1 << i) > 0), F.lit(100.0)
        ).alias(f"coverage_{a.lower()}")
        for i, a in enumerate(dims.AGENTS)
    ]
    agreement = 100.0 * (F.col("total_consensus") + F.col("partial_consensus")) / F.col("distinct_keys")
    return leveled.select("doc_id", "distinct_keys", rounded(agreement, 6).alias("agreement"), *coverage)


def agents_union(mentions: DataFrame) -> DataFrame:
    """Keys that any agent found: the union of all agents' sets, in one scan."""
    return mentions.select("doc_id", "key").distinct()


def agents_intersect(mentions: DataFrame, left: str, right: str) -> DataFrame:
    both = (1 << dims.AGENTS.index(left)) | (1 << dims.AGENTS.index(right))
    return key_agents(mentions).where(F.col("agents").bitwiseAND(both) == both).select("doc_id", "key")


def agents_except(mentions: DataFrame, agent: str) -> DataFrame:
    """Keys that only ``agent`` found."""
    return key_agents(mentions).where(F.col("agents") == (1 << dims.AGENTS.index(agent))).select("doc_id", "key")


def agreement_matrix(mentions: DataFrame) -> DataFrame:
    """Shared and united keys of every two agents over the corpus, from the bit patterns alone."""
    counts = key_agents(mentions).groupBy("agents").agg(F.count(F.lit(1)).alias("keys"))
    pairs = F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(1 << i).alias("lb"), F.lit(1 << j).alias("rb"))
        for i, a in enumerate(dims.AGENTS) for j, b in enumerate(dims.AGENTS)
    ])
    fanned = counts.select("agents", "keys", F.inline(pairs))
    has_left, has_right = (F.col("agents").bitwiseAND(F.col(c)) > 0 for c in ("lb", "rb"))
    return (
        fanned.groupBy("left", "right")
        .agg(
            F.sum(F.when(has_left & has_right, F.col("keys")).otherwise(0)).alias("shared"),
            F.sum(F.when(has_left | has_right, F.col("keys")).otherwise(0)).alias("united"),
        )
        .withColumn("jaccard", rounded(F.col("shared") / F.col("united"), 6))
    )
