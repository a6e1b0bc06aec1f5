"""De-duplication of mentions, from exact text to the convergence fixpoint."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citelake.functions.legal import canonical_key, normalize_article
from citelake.functions.text import fold_accents, normal_text, none_if_empty, rounded, squeeze
from citelake.operators.groups import connected
from citelake.session import cut_lineage, drop_cut


def agent_rank(agent: Column) -> Column:
    """A before B before C, others last."""
    return F.when(agent == "A", 1).when(agent == "B", 2).when(agent == "C", 3).otherwise(4)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key. ``row_number() = 1`` is cut down on the map side before the shuffle,
    so a key with very many copies sends one row per task."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rn", first).where(F.col("__rn") == 1).drop("__rn")


def dedupe_exact(mentions: DataFrame) -> DataFrame:
    """First mention per document and lower-case text; empty texts are dropped."""
    keyed = mentions.withColumn("__key", normal_text(F.col("text"))).where(F.col("__key") != "")
    order = [agent_rank(F.col("agent")), F.col("start"), F.col("mention_id")]
    return keep_first(keyed, ["doc_id", "__key"], order).drop("__key")


def new_texts(new: DataFrame, previous: DataFrame, key: Callable[[Column], Column] = normal_text) -> DataFrame:
    """Mentions whose text was not seen before, each text once (``key`` says when texts are equal)."""
    keyed = new.withColumn("__key", key(F.col("text"))).where(F.col("__key") != "")
    seen = previous.select("doc_id", key(F.col("text")).alias("__key")).distinct()
    fresh = keyed.join(seen, ["doc_id", "__key"], "left_anti")
    return keep_first(fresh, ["doc_id", "__key"], [F.col("start"), F.col("mention_id")]).drop("__key")


def new_texts_squeezed(new: DataFrame, previous: DataFrame) -> DataFrame:
    return new_texts(new, previous, squeeze)


#: Documents of at most so many rows are walked one by one, in one array each; larger ones are run in passes.
WALKED = 512


def greedy_first(rows: DataFrame, values: Column, seen: DataFrame | None = None) -> DataFrame:
    """In document order, keep a row when none of its ``values`` was brought in by a kept row.

    Document order is start, then agent, then mention id: several profiles may find a mention at one
    place. ``mention_id`` names a row within its document. ``seen(doc_id, values)`` has values that are
    brought in before the first row. Nulls in ``values`` are no values; rows without a document go.

    A document of up to ``WALKED`` rows is sent once, as it is, and walked in its own short array. The rows of
    larger documents are spread over all tasks and the rule is run in passes; both give the sequential result.
    """
    rows = rows.where(F.col("doc_id").isNotNull())
    named = rows.select("doc_id") if seen is None else rows.select("doc_id").unionByName(seen.select("doc_id"))
    sizes = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.where((F.col("n") > WALKED) & F.col("doc_id").isNotNull()).select("doc_id"))
    if large.isEmpty():
        return _walked(rows, values, seen)

    def part(table: DataFrame | None, how: str) -> DataFrame | None:
        return None if table is None else table.join(large, "doc_id", how)

    walked = _walked(part(rows, "left_anti"), values, part(seen, "left_anti"))
    return walked.unionByName(_in_passes(part(rows, "left_semi"), values, part(seen, "left_semi")))


def _place() -> Column:
    return F.struct(F.col("start"), agent_rank(F.col("agent")).alias("rank"), F.col("mention_id"))


def _walked(rows: DataFrame, values: Column, seen: DataFrame | None) -> DataFrame:
    """The one-by-one rule as a fold over the rows of a document; whole rows travel, so nothing is joined back."""
    item = F.struct(_place().alias("at"), F.array_compact(values).alias("values"), F.struct(*rows.columns).alias("row"))
    dealt = rows.select("doc_id", item.alias("__item"))
    none = F.array().cast("array<string>")
    before = none
    if seen is not None:
        kind = dealt.schema["__item"].dataType
        dealt = dealt.withColumn("__seen", F.lit(None).cast("array<string>")).unionByName(
            seen.select("doc_id", F.lit(None).cast(kind).alias("__item"), F.col("values").alias("__seen"))
        )
        before = F.array_distinct(F.array_compact(F.flatten(F.collect_list("__seen"))))
    per_doc = dealt.repartition("doc_id").groupBy("doc_id").agg(
        F.sort_array(F.collect_list("__item")).alias("__items"), before.alias("__before")
    )
    ids = F.array().cast(f"array<{rows.schema['mention_id'].dataType.simpleString()}>")

    def step(state: Column, x: Column) -> Column:
        known = F.arrays_overlap(state["taken"], x["values"])
        return F.struct(
            F.when(known, state["taken"]).otherwise(F.concat(state["taken"], x["values"])).alias("taken"),
            F.when(known, state["kept"]).otherwise(F.concat(state["kept"], F.array(x["at"]["mention_id"]))).alias("kept"),
        )

    def kept(state: Column) -> Column:
        return F.filter("__items", lambda x: F.array_contains(state["kept"], x["at"]["mention_id"]))

    start = F.struct(F.col("__before").alias("taken"), ids.alias("kept"))
    return per_doc.select(F.explode(F.aggregate("__items", start, step, kept)).alias("__item")).select("__item.row.*")


def _in_passes(rows: DataFrame, values: Column, seen: DataFrame | None) -> DataFrame:
    """The order-dependent rule over whole tables: a row that is the first holder of all its values among the open
    rows must be kept; rows that share a value with it must go. The passes end when no row is open."""
    wanted = rows.select("doc_id", _place().alias("__at"), F.array_distinct(F.array_compact(values)).alias("__values"))

    def holders(table: DataFrame) -> DataFrame:
        return table.select("doc_id", "__at", "__values", F.explode("__values").alias("__value"))

    def without(table: DataFrame, taken: DataFrame) -> DataFrame:
        marked = taken.select("doc_id", "__value", F.lit(True).alias("__taken"))
        return (
            holders(table).join(marked, ["doc_id", "__value"], "left")
            .groupBy("doc_id", "__at", "__values")
            .agg(F.count("__taken").alias("__hits"))
            .where(F.col("__hits") == 0)
            .select("doc_id", "__at", "__values")
        )

    # a later row with the very same values can never be kept; a row without values always is
    items = wanted.where(F.size("__values") > 0).groupBy("doc_id", "__values").agg(F.min("__at").alias("__at"))
    if seen is not None:
        items = without(items, seen.select("doc_id", F.explode("values").alias("__value")).distinct())
    open_rows = cut_lineage(items)
    kept = wanted.where(F.size("__values") == 0).select("doc_id", "__at.mention_id")
    while not open_rows.isEmpty():
        held = holders(open_rows)
        first = held.groupBy("doc_id", "__value").agg(F.min("__at").alias("__first"))
        winners = cut_lineage(
            held.join(first, ["doc_id", "__value"])
            .groupBy("doc_id", "__at", "__values")
            .agg(F.bool_and(F.col("__first") == F.col("__at")).alias("__free"))
            .where("__free")
            .select("doc_id", "__at", "__values")
        )
        kept = kept.unionByName(winners.select("doc_id", "__at.mention_id"))
        # the winners hold their own values, so this closes them together with their rivals
        rest = cut_lineage(without(open_rows, holders(winners)))
        drop_cut(open_rows)
        open_rows = rest
    drop_cut(open_rows)
    return rows.join(kept, ["doc_id", "mention_id"], "left_semi")


def new_texts_or_laws(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Mentions whose text and law both miss the one set of earlier texts and laws, in order."""
    text, law = normal_text(F.coalesce("text", F.lit(""))), none_if_empty(normal_text(F.col("law")))
    earlier = F.array(none_if_empty(normal_text(F.col("text"))), law)
    return greedy_first(new, F.array(text, law), previous.select("doc_id", F.array_compact(earlier).alias("values")))


def dedupe_text_or_law(mentions: DataFrame) -> DataFrame:
    """The accumulator's rule as it stands: same text or same law as anything kept is a duplicate."""
    text = F.concat(F.lit("t:"), none_if_empty(normal_text(F.col("text"))))
    law = F.concat(F.lit("l:"), none_if_empty(normal_text(F.col("law"))))
    return greedy_first(mentions, F.array(text, law))


def with_key(mentions: DataFrame) -> DataFrame:
    """Comparison key by registry id, else by CELEX, normal form or law as written, where there is such a column."""
    law = F.coalesce(*[F.col(c) for c in ("celex", "law_norm", "law") if c in mentions.columns])
    return mentions.withColumn("key", canonical_key(F.col("boe_id"), law, F.col("article")))


def dedupe_canonical(mentions: DataFrame) -> DataFrame:
    """The mended rule: one mention per document and canonical key."""
    order = [agent_rank(F.col("agent")), F.col("start"), F.col("mention_id")]
    return keep_first(with_key(mentions), ["doc_id", "key"], order)


def semantic_key(identity: Column, article: Column) -> Column:
    """Same law and same article, whatever the spelling: folded law identity and plain article."""
    law = fold_accents(F.regexp_replace(F.lower(identity), r"\s+", ""))
    return F.concat_ws(":art", law, none_if_empty(normalize_article(article)))


def dedupe_semantic(mentions: DataFrame, identity: str = "identity") -> DataFrame:
    """One mention per law and article across spellings; the longest text is kept."""
    keyed = mentions.withColumn("key", semantic_key(F.col(identity), F.col("article")))
    order = [F.length("text").desc(), agent_rank(F.col("agent")), F.col("start"), F.col("mention_id")]
    return keep_first(keyed, ["doc_id", "key"], order)


def attribute_agent(mentions: DataFrame) -> DataFrame:
    """Which profile gets the credit for a text several of them found."""
    return (
        mentions.withColumn("key", normal_text(F.col("text")))
        .groupBy("doc_id", "key")
        .agg(
            F.min_by("agent", agent_rank(F.col("agent"))).alias("agent"),
            F.count(F.lit(1)).alias("copies"),
        )
    )


#: Words shorter than this, and words with digits, are compared exactly.
TYPED = 4


def name_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints that differ by one letter more, less or other in one word.

    Words are indexed by what is left of them: a word with a hole at a place meets the words with the same
    hole there, which are all one letter from each other, and a word that lost a letter meets the word that is
    so spelled. Each key has the hash of the other words, so no candidate needs a check, and each member of a
    key is linked to one member alone: no pairs are built.
    """
    split = prints.select("fingerprint", F.split("fingerprint", " ").alias("w"))
    every = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.xxhash64(x)))
    word = split.withColumn("every", every).select("fingerprint", "every", F.explode("w").alias("word"))
    word = word.where(F.col("word").rlike(f"^[a-z]{{{TYPED},}}$")).withColumn("rest", F.col("every").bitwiseXOR(F.xxhash64("word")))
    place = F.sequence(F.lit(1), F.length("word"))

    def without(i: Column, mark: str) -> Column:
        return F.concat(F.substring("word", F.lit(1), i - 1), F.lit(mark), F.substring("word", i + 1, F.length("word")))

    def key(text: Column, whole: bool) -> Column:
        return F.struct(F.xxhash64("rest", text).alias("key"), F.lit(whole).alias("whole"))

    holes = F.transform(place, lambda i: key(without(i, "*"), True))
    short = F.transform(place, lambda i: key(without(i, ""), False))
    keys = F.concat(F.array(key(F.col("word"), True)), holes, F.when(F.length("word") > TYPED, short).otherwise(F.array().cast("array<struct<key:bigint,whole:boolean>>")))
    rows = word.select("fingerprint", F.explode(F.array_distinct(keys)).alias("k")).select("fingerprint", "k.*")
    hub = rows.groupBy("key").agg(F.min(F.when(F.col("whole"), F.col("fingerprint"))).alias("hub"), F.count(F.lit(1)).alias("n"))
    hub = hub.where((F.col("n") > 1) & F.col("hub").isNotNull()).select("key", "hub")
    return rows.join(hub, "key").where(F.col("hub") != F.col("fingerprint")).select(F.col("fingerprint").alias("a"), F.col("hub").alias("b")).distinct()


def near_names(names: DataFrame, column: str) -> DataFrame:
    """Groups of law names that mean the same: apart from case, accents, punctuation, small words and word
    order, they are equal or lead to each other by single typing errors.

    Each name gets a fingerprint; distinct fingerprints are linked (``name_links``) and the groups are their
    connected components. Numbers and short words must agree. The group's name is its most frequent spelling.
    """
    small = ["de", "del", "la", "las", "el", "los", "y", "of", "the"]
    plain = F.regexp_replace(fold_accents(F.lower(column)), r"[^a-z0-9/ ]+", " ")
    words = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: ~w.isin(small) & (w != ""))
    marked = names.withColumn("fingerprint", F.array_join(F.array_sort(F.array_distinct(words)), " "))
    spelled = cut_lineage(marked.groupBy("fingerprint", column).agg(F.count(F.lit(1)).alias("n")))
    roots = connected(name_links(spelled.select("fingerprint").distinct()))
    group = F.coalesce("root", "fingerprint")
    return (
        spelled.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .groupBy(group.alias("fingerprint"))
        .agg(
            F.count(F.lit(1)).alias("spellings"),
            F.sum("n").alias("mentions"),
            F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("name"),
        )
    )


def converge(
    candidates: DataFrame,
    rungs: int,
    expand: Callable[[DataFrame], DataFrame],
    max_rounds: int | None = None,
) -> DataFrame:
    """Rounds until no new mention comes up, or ``max_rounds`` where that is asked for.

    ``candidates(doc_id, key, rung)`` come from one scan of the documents. Rounds 1 to ``rungs``
    take the candidates of that rung; later rounds take ``expand`` of the newest mentions, so a
    document without news drops out by itself. Every round is written as a table: the loop's lineage
    stays short and a lost executor costs one round. Result: (doc_id, key, round).
    """
    candidates = cut_lineage(candidates.select("doc_id", "key", "rung").distinct())
    found, newest = None, None
    for step in count(1) if max_rounds is None else range(1, max_rounds + 1):
        if step <= rungs:
            pool = candidates.where(F.col("rung") == step).select("doc_id", "key")
        else:
            pool = expand(newest if step > rungs + 1 else found).select("doc_id", "key").distinct()
        fresh = pool if found is None else pool.join(found, ["doc_id", "key"], "left_anti")
        newest = cut_lineage(fresh.withColumn("round", F.lit(step)))
        found = newest if found is None else found.unionByName(newest)
        if step > rungs and newest.isEmpty():
            break
    drop_cut(candidates)
    return found


def round_history(mentions: DataFrame) -> DataFrame:
    """Per document and round: candidates, unique, new and accumulated mentions, and convergence."""
    keyed = mentions.withColumn("__key", normal_text(F.col("text")))
    per_text = keyed.groupBy("doc_id", "__key", "round").agg(F.count(F.lit(1)).alias("__n"))
    first = F.min("round").over(W.partitionBy("doc_id", "__key"))
    per_round = (
        per_text.withColumn("__new", (first == F.col("round")).cast("long"))
        .groupBy("doc_id", "round")
        .agg(F.sum("__n").alias("candidates"), F.count(F.lit(1)).alias("unique_texts"), F.sum("__new").alias("new_texts"))
    )
    so_far = W.partitionBy("doc_id").orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    return per_round.withColumn("accumulated", F.sum("new_texts").over(so_far)).withColumn(
        "converged", F.col("new_texts") == 0
    )


def convergence_stats(mentions: DataFrame) -> DataFrame:
    """Mentions and mean confidence per agent and round, with subtotals."""
    return (
        mentions.rollup("agent", "round")
        .agg(
            F.count(F.lit(1)).alias("mentions"),
            rounded(F.avg(F.coalesce("confidence", F.lit(0))), 6).alias("mean_confidence"),
            F.grouping_id().cast("int").alias("level"),
        )
    )
