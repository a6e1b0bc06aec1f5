"""Documents to mentions. A text is walked once; every profile is evaluated on what that walk leaves, in one projection."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions.legal import is_noise
from citelake.functions.text import CLOSE, FOLD, find_in, first_group, mark, prepare

#: columns of an extracted mention
COLUMNS = ["doc_id", "mention_id", "agent", "kind", "text", "law", "article", "confidence", "implicit", "start"]


def mention_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


_NUMBER = r"\d/\d{4}"

#: a "Ley" that ends the type word of a decree-law is no law of its own
_OWN_TYPE = r"(?<!Decreto[\s-]{1,9})"


def _marked(rule: int, pattern: str) -> Column:
    guard = _OWN_TYPE if pattern.startswith("Ley") else ""
    pieces = mark(F.col("text"), FOLD + guard + pattern)
    if _NUMBER[2:] in pattern:
        pieces = F.when(F.col("__numbered"), pieces)
    if pattern[:2].isalpha():
        pieces = F.when(F.contains("__lower", F.lit(pattern[:2].lower())), pieces)
    return F.struct(F.lit(rule).alias("rule"), pieces.alias("pieces"))


def _by_rule(rules: list[tuple], value: Callable[[tuple], Column]) -> Column:
    """A column that depends on the rule a mention came from."""
    return F.coalesce(*[F.when(F.col("rule") == i, value(r)) for i, r in enumerate(rules)])


def _by_index(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule") + 1)


def _law(rule: tuple) -> Column:
    _, kind, pattern, whole, _, _ = rule
    if whole:
        return F.col("text")
    return F.lit(None).cast("string") if kind == "articulo" else F.regexp_extract("text", FOLD + pattern, 1)


def _article(rule: tuple) -> Column:
    _, kind, pattern, _, _, _ = rule
    return F.regexp_extract("text", FOLD + pattern, 1) if kind == "articulo" else F.lit(None).cast("string")


#: A place in the first word of every match of a profile, of ``ARTICLE_LAW`` and of ``EU_ACT``, and in the "Decreto" that a
#: "Ley" must not follow. All begin with one of six letters, where need be inside the word; the first two letters are
#: classes, because a class is looked up, while a folded letter converts every character of the text twice.
_ANCHOR = (
    r"(?=[aAcCdDlLpPrR])(?:"
    r"[aA](?:[rR]t(?:[íi]culo|\.)?(?=\s)|i?\b(?<=\b(?:ai|ia)))"
    r"|[cC](?:[oO]nstitución(?=\s)|[óÓ]digo(?=\s)|[eE]\b(?<=\bce)|[aA]lía\b(?<=\bfiscalía))"
    r"|[dD](?:[eE]c(?:isión|reto(?=[\s-]))|irectiva|[mM]a\b(?<=\bdma)|sa\b(?<=\bdsa)|[aA]s\b(?<=\beidas)|2\b(?<=\bpsd2))"
    r"|[lL](?:[eE](?:y(?=\s)|c\b(?<=\blec))|[aA]ecsp\b(?<=\blaecsp)|[jJ]ca\b(?<=\bljca)|[pP]ac\b(?<=\blpac)|[rR]jsp\b(?<=\blrjsp))"
    r"|[rR](?:[eE](?:al(?=\s)|glamento)|[dD]l?(?=\s)|[gG]pd\b(?<=\brgpd)|[oO]ma\b(?<=\broma)|[uU]selas\b(?<=\bbruselas)|\b(?<=\bgdpr))"
    r"|[pP]po\b(?<=\beppo))"
)

#: How a word begins that a match goes on with: a match holds the beginning of each of its words but the first.
_ONWARD = (
    r"(?:[\d()-]|de|la|ley|orgánica|real|legislativo|española|civil|penal|rd|art|constitución|código|reglamento|marco|ue|n[oº]|"
    r"ce|cc|cp|le|lpac|lrjsp|ljca|lopj|laecsp|rgpd|gdpr|roma|bruselas|i|bis|eidas|d[ms]a|ai|act|directiva|pif|pnr|psd2|"
    r"concentraciones|fiscalía|europea|eppo)"
)

#: all that the rules of this module may match, so that a text is walked once for all of them
STRETCH = rf"{_ANCHOR}\S*+(?:\s++{_ONWARD}\S*+)*+"


def _stretches_in(pieces: Column) -> Column:
    """Matches of ``STRETCH`` with the beginning of their first word, which the text before them ends with."""

    def whole(m: Column, before: Column) -> Column:
        lead = F.substring_index(F.substring_index(before, CLOSE, -1), " ", -1)
        return F.struct((m["start"] - F.length(lead)).alias("at"), F.concat(lead, m["text"]).alias("text"))

    return F.zip_with(find_in(pieces), F.slice(pieces, F.lit(1), F.size(pieces) - 1), whole)


def stretches(docs: DataFrame, keep: tuple[str, ...] = (), window: int | None = None) -> DataFrame:
    """The short parts of ``docs(doc_id, text)`` that hold all mentions: ``at``, their 0-based place, and ``text``.

    The rules are tried on these parts and find what they would find in the text: a match lies in one part, which
    begins and ends with a word. With ``window`` each part has ``wide``, the raw text up to ``window`` characters around it from
    the place ``wide_at``, and ``chars``, the length of the whole text.
    """
    raw = ["text"] if window is not None else []
    marked = docs.select("doc_id", *keep, *raw, mark(prepare(F.col("text")), FOLD + STRETCH).alias("__p"))
    if window is None:
        return marked.select("doc_id", *keep, F.inline(_stretches_in(F.col("__p"))))

    def around(m: Column) -> Column:
        wide_at = F.greatest(m["at"] - window, F.lit(0))
        wide = F.substring(F.col("text"), wide_at + 1, m["at"] + F.length(m["text"]) + window - wide_at)
        return F.struct(m["at"], m["text"], wide_at.alias("wide_at"), wide.alias("wide"))

    found = marked.select("doc_id", *keep, F.length("text").alias("chars"), "text", _stretches_in(F.col("__p")).alias("__m"))
    return found.select("doc_id", *keep, "chars", F.inline(F.transform("__m", around)))


def _placed(found: DataFrame) -> DataFrame:
    """Places in the text instead of places in its stretches."""
    return found.withColumn("start", F.col("at") + F.col("start")).drop("at")


def _cut(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs if "at" in docs.columns else stretches(docs, keep)


def extract(docs: DataFrame, agents: tuple[str, ...] = dims.AGENTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mentions of ``docs(doc_id, text)``, or of their :func:`stretches`, by the rule profiles of ``agents``.

    ``keep`` names document columns to carry along.
    """
    rules = [r for r in dims.PROFILE_PATTERNS if r[0] in agents]
    kept = [f"__{c}" for c in keep]
    whole = docs.select(*docs.columns, *[F.col(c).alias(f"__{c}") for c in keep])
    prepared = _cut(whole, tuple(kept)).withColumn("__numbered", F.col("text").rlike(_NUMBER)).withColumn("__lower", F.lower("text"))
    # one marked and cut array per pattern, in a projection of its own, so that no pattern runs
    # twice; patterns that need a norm number are not tried on a text that has none, nor those that
    # begin with two letters on a text without them (none of these letters has a third form)
    marked = prepared.select(
        "doc_id", "at", *kept, F.array(*[_marked(i, r[2]) for i, r in enumerate(rules)]).alias("__marked")
    )
    found = F.flatten(
        F.transform(
            F.filter("__marked", lambda x: F.size(x["pieces"]) > 1),
            lambda x: F.transform(
                find_in(x["pieces"]),
                lambda m: F.struct(x["rule"].alias("rule"), m["start"].alias("start"), m["text"].alias("text")),
            ),
        )
    )
    mentions = _placed(marked.select("doc_id", "at", *kept, F.inline(found)))
    described = mentions.select(
        "doc_id",
        *kept,
        _by_index([r[0] for r in rules]).alias("agent"),
        _by_index([r[1] for r in rules]).alias("kind"),
        "text",
        _by_rule(rules, _law).alias("law"),
        _by_rule(rules, _article).alias("article"),
        _by_index([r[4] for r in rules]).alias("confidence"),
        _by_index([r[5] for r in rules]).cast("boolean").alias("implicit"),
        "start",
    )
    identity = mention_id(*[F.col(c) for c in ("doc_id", "agent", "kind", "start", "text")])
    renamed = [F.col(f"__{c}").alias(f"doc_{c}" if c in COLUMNS else c) for c in keep]
    return described.withColumn("mention_id", identity).select(*COLUMNS, *renamed)


#: article, then the law it belongs to
ARTICLE_LAW = (
    r"art(?:ículo|iculo|\.)?\s+(\d+(?:\.\d+)?(?:\.[a-z])?)\s+(?:de\s+la\s+|del\s+|de\s+)?"
    r"(Ley\s+(?:Orgánica\s+)?\d+/\d{4}|Real\s+Decreto\s+\d+/\d{4}|Constitución\s+Española"
    r"|\b(?:LPAC|LRJSP|LECrim|LEC|LJCA|LOPJ|CE|CC|CP|RGPD)\b)"
)


def extract_article_law(docs: DataFrame) -> DataFrame:
    """Full-form mentions: an article together with its law."""
    pattern = FOLD + ARTICLE_LAW
    marked = _cut(docs).select("doc_id", "at", mark(F.col("text"), pattern).alias("__p"))
    return _placed(marked.select("doc_id", "at", F.inline(find_in(F.col("__p"))))).select(
        "doc_id",
        "start",
        "text",
        first_group(F.col("text"), pattern, 1).alias("article"),
        first_group(F.col("text"), pattern, 2).alias("law"),
    )


def _eu_act() -> str:
    words = "|".join(re.escape(a) for a in dims.EU_ACRONYMS)
    act = r"(?:Reglamento|Directiva|Decisión(?:\s+Marco)?)\s*\(?(?:UE|CE)?\)?\s*(?:N[oº]\.?\s*)?\d+/\d+"
    return rf"(?:art(?:ículo|iculo|\.)?\s+\d+\s+del?\s+)?(?:{act}|\b(?:{words})\b)"


#: an EU act by number or acronym, with the article in front of it
EU_ACT = _eu_act()


def extract_eu(docs: DataFrame) -> DataFrame:
    """Mentions of EU acts."""
    marked = _cut(docs).select("doc_id", "at", mark(F.col("text"), FOLD + EU_ACT).alias("__p"))
    return _placed(marked.select("doc_id", "at", F.inline(find_in(F.col("__p")))))


#: phrases that point back at a law or an article named before
ANAPHORA = (
    r"(?:la presente ley orgánica|la presente ley|la citada ley|dicha ley|esta ley|la misma|el presente código"
    r"|este código|el presente real decreto|el presente reglamento|la presente norma|esta norma|artículo anterior)"
)


def extract_anaphora(docs: DataFrame) -> DataFrame:
    """Phrases that stand for a law named before, with their offsets."""
    marked = docs.select("doc_id", mark(prepare(F.col("text")), FOLD + ANAPHORA).alias("__p"))
    return marked.select("doc_id", F.inline(find_in(F.col("__p"))))


def explode_articles(mentions: DataFrame, article: str = "article", limit: int | None = None) -> DataFrame:
    """One row per article of a list ("22 y 25", "22, 25"); ``limit`` keeps the first ones only."""
    listed = F.col(article).rlike(r" y |,")
    numbers = F.when(listed, F.regexp_extract_all(F.col(article), F.lit(r"\d+"), F.lit(0))).otherwise(F.array(article))
    if limit is not None:
        numbers = F.slice(numbers, 1, limit)
    return mentions.select("*", F.posexplode(numbers).alias("article_idx", "article_one"))


def position_in(text: Column, lowered: Column, mention: Column) -> Column:
    """1-based place of a mention: as written in any case, else with loose dots and spaces; 0 if absent.

    ``lowered`` is the text in lower case, computed once per document by the caller.
    """
    literal = F.position(F.lower(mention), lowered)
    escaped = F.regexp_replace(mention, r"([\\\[\](){}*+?^$|])", r"\\$1")
    loose = F.concat(
        F.lit(FOLD),
        F.replace(F.replace(escaped, F.lit("."), F.lit(r"\.?")), F.lit(" "), F.lit(r"\s+")),
    )
    return F.when(literal > 0, literal).otherwise(F.regexp_instr(text, loose))


def context_window(text: Column, place: Column, window: int = 1500) -> Column:
    """Up to ``window`` characters on both sides of a 1-based place, dots where the text goes on."""
    begin = F.greatest(place - 1 - window, F.lit(0))
    end = F.least(F.length(text), place - 1 + window)
    body = F.substring(text, begin + 1, end - begin)
    return F.when(
        place > 0,
        F.concat(
            F.when(begin > 0, F.lit("...")).otherwise(F.lit("")),
            body,
            F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")),
        ),
    )


def with_context(docs: DataFrame, window: int = 1500) -> DataFrame:
    """Mentions with the context of their own place. A stretch takes the text around it along; no text is shuffled."""
    parts = stretches(docs, window=window)
    carried = ("wide", "wide_at", "chars")
    placed = extract(parts, keep=carried).withColumn("place", F.col("start") + 1)
    begin = F.greatest(F.col("start") - window, F.lit(0))
    end = F.least(F.col("chars"), F.col("start") + window)
    body = F.substring(F.col("wide"), begin - F.col("wide_at") + 1, end - begin)
    before, after = F.when(begin > 0, F.lit("...")), F.when(end < F.col("chars"), F.lit("..."))
    return placed.withColumn("context", F.concat(F.coalesce(before, F.lit("")), body, F.coalesce(after, F.lit("")))).drop(*carried)


def drop_noise(mentions: DataFrame) -> DataFrame:
    return mentions.where(~is_noise(F.col("text")))
