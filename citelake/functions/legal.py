"""Expressions for laws, articles and EU acts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions.text import FOLD, contains_any, first_group, fold_accents, none_if_empty


# -- flags ------------------------------------------------------------------

def is_contextual(text: Column) -> Column:
    """Does the text point at a law named elsewhere ("la presente ley")?"""
    return contains_any(F.lower(text), dims.CONTEXTUAL_PHRASES)


def eu_pattern() -> str:
    """EU phrases, or an EU acronym as a whole word, in any case."""
    phrases = "|".join(re.escape(p) for p in dims.EU_PHRASES)
    words = "|".join(re.escape(a) for a in dims.EU_ACRONYMS)
    return rf"(?:{phrases})|\b(?:{words})\b"


def is_eu(text: Column) -> Column:
    return text.rlike(FOLD + eu_pattern())


def is_exportable(boe_id: Column, text: Column) -> Column:
    """Has a registry id, or names an EU act in one of ten exact forms."""
    has_id = boe_id.isNotNull() & (boe_id != "")
    return has_id | F.coalesce(contains_any(text, dims.EU_EXPORT_FORMS), F.lit(False))


def is_acronym(kind: Column, text: Column) -> Column:
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    return F.coalesce((F.lower(kind) == "sigla") | ((F.length(text) < 10) & upper), F.lit(False))


CASE_LAW = r"\bST[CS]\b"
GENERIC_LAW = r"^\s*(?:la|el)\s+(?:ley|norma|código|reglamento)\s*$"


def is_noise(text: Column) -> Column:
    """Case law, or a generic "la ley" that names nothing."""
    return text.rlike(CASE_LAW) | text.rlike(FOLD + GENERIC_LAW)


# -- laws -------------------------------------------------------------------

#: spelling of a norm's type word -> canonical word and law type
LAW_WORDS = {
    "ley orgánica": ("Ley Orgánica", "organica"),
    "ley": ("Ley", "ordinaria"),
    "real decreto ley": ("Real Decreto-ley", "real_decreto_ley"),
    "rdl": ("Real Decreto-ley", "real_decreto_ley"),
    "real decreto legislativo": ("Real Decreto Legislativo", "real_decreto_legislativo"),
    "rdleg": ("Real Decreto Legislativo", "real_decreto_legislativo"),
    "real decreto": ("Real Decreto", "real_decreto"),
    "rd": ("Real Decreto", "real_decreto"),
}
_LAW_FORM = FOLD + (
    r"^\s*(Ley\s+Orgánica|Ley|Real\s+Decreto[\s-]+Ley|RDLeg|RDL|Real\s+Decreto\s+Legislativo|Real\s+Decreto|RD)"
    r"\s+(\d+/\d{4})"
)


def _word_map(part: int) -> Column:
    return F.create_map(*[F.lit(x) for word, out in LAW_WORDS.items() for x in (word, out[part])])


def law_form(law: Column) -> tuple[Column, Column]:
    """Canonical law and law type of a numbered norm; both null for other forms."""
    word = F.lower(F.regexp_replace(F.regexp_extract(law, _LAW_FORM, 1), r"[\s-]+", " "))
    canonical = F.concat(F.try_element_at(_word_map(0), word), F.lit(" "), F.regexp_extract(law, _LAW_FORM, 2))
    return canonical, F.try_element_at(_word_map(1), word)


LAW_IN_TEXT = [
    r"Real\s+Decreto(?:[\s-]+Ley|\s+Legislativo)\s+(?:\d+/\d{4})",
    r"Ley\s+(?:Orgánica\s+)?(?:\d+/\d{4})",
    r"Real\s+Decreto\s+(?:Ley\s+)?(?:\d+/\d{4})",
    r"Constitución\s+Española",
]


def law_in_text(text: Column) -> Column:
    return F.coalesce(*[first_group(text, FOLD + p, 0) for p in LAW_IN_TEXT])


#: Types of numbered norms, the most specific first, and how they are written.
NUMBERED = [
    ("Real Decreto-ley", r"Real\s+Decreto[\s-]+Ley\s+"),
    ("Real Decreto Legislativo", r"Real\s+Decreto\s+Legislativo\s+"),
    ("Ley Orgánica", r"Ley\s+Orgánica\s+"),
    ("Ley", r"Ley\s+"),
    ("Real Decreto", r"Real\s+Decreto\s+"),
    ("Real Decreto", r"RD\s+"),
]


def _typed(ref: Column, number: str, types: list[tuple[str, str]]) -> list[Column]:
    return [
        F.when(ref.rlike(FOLD + p + number), dims.number_key(F.lit(kind), F.regexp_extract(ref, FOLD + p + number, 1)))
        for kind, p in types
    ]


def numbered_key(ref: Column) -> Column:
    """Registry key of the numbered norm a reference holds, the most specific type first."""
    return F.coalesce(*_typed(ref, r"(\d+/\d{4})", NUMBERED))


def number_without_year(ref: Column) -> Column:
    """Type and number of the norm a reference holds, whether or not a year follows."""
    return F.coalesce(*_typed(ref, r"(\d+)", NUMBERED))


def plain_numbers(ref: Column) -> list[Column]:
    """Registry keys of the first law, decree and abbreviated decree anywhere in a reference."""
    return _typed(ref, r"(\d+/\d{4})", NUMBERED[3:])


def clean_reference(ref: Column) -> Column:
    one_space = F.regexp_replace(F.trim(ref), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(one_space, FOLD + r"nº\s*", ""), FOLD + r"núm\.\s*", "")


def canonical_key(boe_id: Column, law: Column, article: Column) -> Column:
    """Comparison key: ``BOE:<id>``, else the law without spaces and its article."""
    law_part = F.replace(F.trim(F.lower(F.coalesce(law, F.lit("")))), F.lit(" "), F.lit(""))
    art_part = F.trim(F.lower(F.coalesce(article, F.lit(""))))
    by_name = F.when(art_part != "", F.concat(law_part, F.lit(":art"), art_part)).otherwise(law_part)
    return F.when(F.coalesce(boe_id, F.lit("")) != "", F.concat(F.lit("BOE:"), boe_id)).otherwise(by_name)


def category(kind: Column) -> Column:
    folded = fold_accents(F.lower(kind))
    return (
        F.when(folded.isin("ley", "real_decreto"), F.lit("normativa"))
        .when(folded.isin("articulo", "apartado"), F.lit("disposicion"))
        .otherwise(F.lit("otra"))
    )


# -- articles ---------------------------------------------------------------

def normalize_article(number: Column) -> Column:
    """``Art. 456`` -> ``456``, ``117.3.a`` -> ``117.3``; text without a number is only trimmed."""
    bare = F.trim(F.regexp_replace(F.lower(number), FOLD + r"^(?:artículo|art\.?)\s*", ""))
    return F.coalesce(first_group(bare, r"^(\d+(?:\.\d+)?)"), bare)


def article_base(number: Column) -> Column:
    return F.substring_index(normalize_article(number), ".", 1)


def article_format_valid(number: Column) -> Column:
    return number.rlike(r"^\d+(?:\.\d+)?(?:\.[a-z])?$")


def article_word_id(number: Column) -> Column:
    """Block id of an article written out in words: 456 -> acuatrocientoscincuentayseis."""

    def word(words: list[str], i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))

    n = number.cast("int")
    hundreds, rest = F.floor(n / 100), n % 100
    tens, units = F.floor(rest / 10), rest % 10
    head = F.when(n == 100, F.lit("cien")).otherwise(word(dims.NUMBER_WORDS_HUNDREDS, hundreds))
    tail = (
        F.when(rest < 10, word(dims.NUMBER_WORDS_UNITS, units))
        .when(rest < 20, word(dims.NUMBER_WORDS_TEENS, units))
        .when(rest == 20, F.lit("veinte"))
        .when(rest < 30, F.concat(word(dims.NUMBER_WORDS_TENS, tens), F.lit("i"), word(dims.NUMBER_WORDS_UNITS, units)))
        .when(units == 0, word(dims.NUMBER_WORDS_TENS, tens))
        .otherwise(F.concat(word(dims.NUMBER_WORDS_TENS, tens), F.lit("y"), word(dims.NUMBER_WORDS_UNITS, units)))
    )
    spelled = F.when(n < 10, word(dims.NUMBER_WORDS_ORDINAL, F.greatest(n, F.lit(0)))).otherwise(F.concat(head, tail))
    return F.when(n.between(0, 999), F.concat(F.lit("a"), spelled))


# -- EU acts ----------------------------------------------------------------

#: act word, CELEX letter; tried in this order
EU_ACTS = [("Reglamento", "R"), ("Directiva", "L"), ("Decisión", "D")]
_EU_NUMBER = r"\s*(?:\(UE\)|\(CE\)|UE|CE)?\s*(No|N[oº])?\s*(\d+)/(\d+)"


def _celex(letter: str, year: Column, number: Column) -> Column:
    return F.format_string(f"3%d{letter}%04d", year.cast("int"), number.cast("int"))


def derive_celex_raw(text: Column) -> Column:
    """The plain rule: the first number is the year when it is at least 1000."""
    out = []
    for word, letter in EU_ACTS:
        pattern = FOLD + word + _EU_NUMBER
        a, b = (F.regexp_extract(text, pattern, g).try_cast("int") for g in (2, 3))
        year_first = a >= 1000
        out.append(
            F.when(
                text.rlike(pattern),
                F.when(year_first, _celex(letter, a, b)).otherwise(_celex(letter, b, a)),
            )
        )
    return F.coalesce(*out)


def derive_celex(text: Column) -> Column:
    """CELEX with the year rule mended: ``No n/y`` has the year second, two digits mean 19xx.

    ``Decisión Marco`` (sector letter F) is an addition of this library.
    """
    out = []
    for word, letter in [("Reglamento", "R"), ("Directiva", "L"), ("Decisión Marco", "F"), ("Decisión", "D")]:
        pattern = FOLD + word.replace(" ", r"\s+") + _EU_NUMBER
        a, b = (F.regexp_extract(text, pattern, g).try_cast("int") for g in (2, 3))
        numbered = F.regexp_extract(text, pattern, 1) != ""
        full_year_first = a.between(1950, 2100) & ~numbered
        short_year_first = (a < 100) & ~numbered & ~b.between(1950, 2100)
        out.append(
            F.when(
                text.rlike(pattern),
                F.when(full_year_first, _celex(letter, a, b))
                .when(short_year_first, _celex(letter, a + 1900, b))
                .otherwise(_celex(letter, F.when(b < 100, b + 1900).otherwise(b), a)),
            )
        )
    return F.coalesce(*out)


def eu_url(celex: Column, language: Column, path: str = "TXT") -> Column:
    return F.concat(F.lit(dims.EU_URL), F.upper(language), F.lit(f"/{path}/?uri=CELEX:"), celex)


def eu_informal(text: Column) -> Column:
    """Standard form of an informal act reference (``Reg. UE 2016/679``)."""
    trimmed = F.trim(text)
    return F.coalesce(
        *[
            F.when(
                trimmed.rlike(FOLD + p),
                F.concat(
                    F.lit(word + " ("),
                    F.upper(F.regexp_extract(trimmed, FOLD + p, 1)),
                    F.lit(") "),
                    F.regexp_extract(trimmed, FOLD + p, 2),
                ),
            )
            for word, p in dims.EU_INFORMAL.items()
        ]
    )


def registry_url(boe_id: Column, article: Column | None = None) -> Column:
    url = F.concat(F.lit(dims.REGISTRY_URL), boe_id)
    if article is None:
        return url
    return F.concat(url, F.coalesce(F.concat(F.lit("#a"), none_if_empty(article)), F.lit("")))
