"""Text expressions: everything here is a Catalyst expression, evaluated inside the scan stage."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags that make a Java pattern fold case as Unicode does.
FOLD = "(?iu)"

_OPEN, CLOSE = "\u0001", "\u0002"
_BLOCK = 512


def prepare(text: Column) -> Column:
    """No-break spaces and the two marker characters become plain spaces; offsets stay the same."""
    for odd in ("\u00a0", _OPEN, CLOSE):
        text = F.replace(text, F.lit(odd), F.lit(" "))
    return text


def fold_accents(c: Column) -> Column:
    return F.translate(c, "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")


def squeeze(c: Column) -> Column:
    """Lower case, one space between words, no outer space."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def normal_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero after scaling in doubles, as SQL engines round a double. Spark's own ``round`` of a double
    goes by its shortest decimal, so 41/640 (0.0640625) differs in the sixth place."""
    scale = F.lit(10.0**digits)
    return F.round(c * scale) / scale


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def contains_any(c: Column, phrases: list[str]) -> Column:
    """One alternation, so that the text is walked once."""
    return c.rlike("|".join(re.escape(p) for p in phrases))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null when nothing matches."""
    return none_if_empty(F.regexp_extract(c, pattern, group))


def truncate_text(text: Column, limit: int, marker: str) -> Column:
    """Text limited to ``limit`` characters, with a marker where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def chunk_text(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces that together hold the whole text: array of (chunk_no, start, chunk)."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda i: F.struct(
            i.alias("chunk_no"),
            (i * step).alias("start"),
            F.substring(text, i * step + 1, F.lit(size)).alias("chunk"),
        ),
    )


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(lengths: Column) -> Column:
    """Exclusive running sums of an int array, in blocks so that long arrays stay cheap."""

    def scan(block: Column) -> Column:
        empty = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(
            block,
            empty,
            lambda acc, x: F.struct(
                (acc["total"] + x).alias("total"),
                F.concat(acc["sums"], F.array(acc["total"])).alias("sums"),
            ),
        )

    def blocks(values: Column) -> Column:
        last = F.greatest(F.ceil(F.size(values) / _BLOCK) - 1, F.lit(0)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda b: scan(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
        )

    def add_offsets(scanned: Column) -> Column:
        offsets = scan(F.transform(scanned, lambda b: b["total"]))["sums"]
        return F.flatten(
            F.zip_with(scanned, offsets, lambda b, off: F.transform(b["sums"], lambda s: s + off))
        )

    return bind(lengths, lambda values: bind(blocks(values), add_offsets))


def mark(text: Column, pattern: str) -> Column:
    """The text cut in front of every match; each match ends with a close mark.

    Select it as a column of its own before :func:`find_in`, so that the pattern runs once.
    """
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{CLOSE}"), _OPEN, -1)


def find_in(pieces: Column) -> Column:
    """Matches of a marked text with their 0-based offsets: array of (start, text)."""
    # a piece after the first is match + close mark + the text up to the next match
    lengths = F.transform(pieces, lambda p, i: F.length(p) - F.when(i > 0, F.lit(1)).otherwise(F.lit(0)))
    found = F.zip_with(
        pieces,
        prefix_sums(lengths),
        lambda p, s: F.struct(s.alias("start"), F.substring_index(p, CLOSE, 1).alias("text")),
    )
    return F.when(F.size(pieces) > 1, F.slice(found, F.lit(2), F.size(pieces) - 1)).otherwise(
        F.array().cast("array<struct<start:int,text:string>>")
    )


_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _character(name: Column) -> Column:
    """The character of a reference's name: a number after ``#``, or a named HTML 4 entity; null if unknown."""
    names = F.create_map(*[F.lit(x) for n, code in sorted(name2codepoint.items()) for x in (n, chr(code))])
    hexed = F.lower(F.substring(name, 2, 1)) == "x"
    code = F.when(hexed, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int")
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
    numbered = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    return F.when(F.startswith(name, F.lit("#")), numbered).otherwise(F.try_element_at(names, name))


def unescape(c: Column) -> Column:
    """Entities decoded in one pass: numeric references and the named ones of HTML 4; others stay."""

    def decoded(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        char = F.when(name != "", _character(name))
        rest = F.concat(char, F.substr(piece, F.length(name) + 2))
        return F.when(i == 0, piece).otherwise(F.coalesce(rest, F.concat(F.lit("&"), piece)))

    whole = F.array_join(F.transform(F.split(c, "&", -1), decoded), "")
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def strip_tags(html: Column) -> Column:
    """Markup removed, entities decoded, white space collapsed."""
    bare = unescape(F.regexp_replace(html, r"<[^>]+>", ""))
    return F.trim(F.regexp_replace(bare, r"[\s\u00a0]+", " "))


def inner_text(html: Column) -> Column:
    """Text of a fragment where every text node is trimmed on its own and nodes are joined."""
    bare = unescape(F.regexp_replace(html, r"\s*<[^>]*>\s*", ""))
    return F.trim(F.regexp_replace(bare, r"[\s\u00a0]+", " "))


def sanitize_name(c: Column, limit: int = 50) -> Column:
    """A file name: spaces to underscores, only letters, digits, ``_`` and ``-``."""
    return F.left(F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_-]", ""), F.lit(limit))


def request_key(prefix: str, text: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), F.md5(text))
