"""HTML as expressions. A page is cut in front of every block-level tag, inside its row: no DOM,
no shuffle, and unclosed tags end where the next block starts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions.text import FOLD, bind, first_group, inner_text, none_if_empty

_CUT = "\u0001"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
_BLOCK_TAGS = r"(?i)<(/?(?:h[1-6]|p|li|ul|ol|div|article|section|header|footer|nav|body|html|table|tr|td)[ >])"


def segments(html: Column) -> Column:
    """The page cut in front of every opening or closing block tag."""
    visible = F.regexp_replace(F.replace(html, F.lit(_CUT), F.lit(" ")), _HIDDEN, "")
    return F.split(F.regexp_replace(visible, _BLOCK_TAGS, _CUT + "<$1"), _CUT, -1)


def tag_of(segment: Column) -> Column:
    return F.lower(F.regexp_extract(segment, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))


def blocks(html: Column, tags: tuple[str, ...]) -> Column:
    """Blocks of the wanted tags in document order: array of (tag, attrs, text), empty texts included."""
    wanted = F.filter(segments(html), lambda s: tag_of(s).isin(*tags))
    return F.transform(
        wanted,
        lambda s: F.struct(
            tag_of(s).alias("tag"),
            F.regexp_extract(s, r"^<[^>]*>", 0).alias("attrs"),
            inner_text(s).alias("text"),
            s.alias("raw"),
        ),
    )


def clean_text(html: Column) -> Column:
    """Structured text: headings set apart, paragraphs as lines, list items with a dash."""
    kept = F.filter(blocks(html, ("h1", "h2", "h3", "p", "li")), lambda b: b["text"] != "")
    lines = F.transform(
        kept,
        lambda b: F.when(b["tag"].isin("h1", "h2"), F.concat(F.lit("\n\n"), b["text"], F.lit("\n")))
        .when(b["tag"] == "h3", F.concat(F.lit("\n"), b["text"], F.lit("\n")))
        .when(b["tag"] == "p", F.concat(b["text"], F.lit("\n")))
        .otherwise(F.concat(F.lit("- "), b["text"], F.lit("\n"))),
    )
    joined = F.regexp_replace(F.array_join(lines, ""), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def count_tag(html: Column, tag: str) -> Column:
    return F.size(F.filter(segments(html), lambda s: tag_of(s) == tag))


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def outline(html: Column) -> Column:
    """Sections with their subsections: array of (num, title, subs). Sections are h2, subsections the
    h3 up to the next h2."""
    heads = blocks(html, ("h2", "h3"))

    def build(hs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(hs) + 1), lambda i: (i > F.size(hs)) | (F.get(hs, i - 1)["tag"] == "h2"))
        return bind(
            starts,
            lambda st: F.transform(
                F.slice(st, F.lit(1), F.size(st) - 1),
                lambda begin, n: F.struct(
                    (n + 1).alias("num"),
                    F.get(hs, begin - 1)["text"].alias("title"),
                    F.transform(
                        F.slice(hs, begin + 1, F.get(st, n + 1) - begin - 1), lambda b: b["text"]
                    ).alias("subs"),
                ),
            ),
        )

    return F.when(F.size(heads) > 0, bind(heads, build)).otherwise(
        F.array().cast("array<struct<num:int,title:string,subs:array<string>>>")
    )


def main_title(html: Column) -> Column:
    return F.get(F.transform(blocks(html, ("h1",)), lambda b: b["text"]), F.lit(0))


def article_number(text: Column) -> Column:
    return F.coalesce(*[first_group(text, FOLD + p) for p in dims.ARTICLE_PATTERNS])


def article_title(text: Column) -> Column:
    """``Artículo 23. Derecho a ser informado.`` -> ``Derecho a ser informado``."""
    pattern = FOLD + r"(?:Artículo|Art\.?)\s+\d+(?:\.\d+)?(?:\.[a-z])?\s*\.\s*(.+?)(?:\.|$)"
    return none_if_empty(F.trim(F.regexp_extract(text, pattern, 1)))


_ARTICLE_CLASS = FOLD + r"class=[\"'][^\"']*(?:articulo|art\b)"


def articles(html: Column, keep: str = "first") -> Column:
    """Articles of a law page: array of (pos, number, title, body, items).

    Heads are blocks of an article class that hold a number; a page without such blocks takes every
    numbered block. A body runs to the next numbered block. Of several articles with one number the
    first is kept, or the last.
    """
    found = F.transform(
        blocks(html, ("h3", "h4", "h5", "p", "li", "div")),
        lambda b: F.struct(
            b["tag"].alias("tag"), b["text"].alias("text"), b["raw"].alias("raw"),
            article_number(b["text"]).alias("number"),
            b["attrs"].rlike(_ARTICLE_CLASS).alias("classed"),
        ),
    )

    def build(bs: Column) -> Column:
        index = F.transform(bs, lambda b, i: F.struct(i.alias("i"), b["number"].alias("number"), b["classed"].alias("classed"), b["tag"].alias("tag")))
        numbered = F.filter(index, lambda x: x["number"].isNotNull())
        return bind(numbered, lambda ns: cut(bs, ns))

    def cut(bs: Column, ns: Column) -> Column:
        # every numbered block, with the place where its body ends
        spans = F.transform(
            ns,
            lambda x, k: F.struct(
                x["i"].alias("pos"), x["number"].alias("number"), x["classed"].alias("classed"), x["tag"].alias("tag"),
                F.coalesce(F.get(F.transform(ns, lambda y: y["i"]), k + 1), F.size(bs)).alias("end"),
            ),
        )
        any_class = F.exists(ns, lambda x: x["classed"])
        heads = F.filter(spans, lambda x: F.when(any_class, x["classed"]).otherwise(x["tag"] != "li"))
        return bind(heads, lambda hs: F.transform(pick(hs), lambda h: article(bs, h)))

    def pick(hs: Column) -> Column:
        numbers = F.transform(hs, lambda h: h["number"])
        if keep == "first":
            return F.filter(hs, lambda h, k: F.array_position(numbers, h["number"]) == k + 1)
        return F.filter(hs, lambda h, k: F.array_position(F.reverse(numbers), h["number"]) == F.size(numbers) - k)

    def article(bs: Column, h: Column) -> Column:
        head = F.get(bs, h["pos"])
        rest = F.slice(bs, h["pos"] + 2, h["end"] - h["pos"] - 1)
        texts = F.filter(F.transform(rest, lambda b: b["text"]), lambda t: t != "")
        items = F.filter(
            F.transform(rest, lambda b: b["text"]), lambda t: t.rlike(r"^\s*(?:\d+\.|[a-z]\))\s+\S")
        )
        return F.struct(
            h["pos"].alias("pos"),
            h["number"].alias("number"),
            article_title(head["text"]).alias("title"),
            F.array_join(F.concat(F.array(head["text"]), texts), " ").alias("body"),
            items.alias("items"),
        )

    return bind(found, build)


def classed_texts(html: Column, tag: str, css: str) -> Column:
    """Texts of the blocks of one tag and class."""
    pattern = FOLD + rf"class=[\"'][^\"']*\b{css}\b"
    return F.transform(
        F.filter(blocks(html, (tag,)), lambda b: b["attrs"].rlike(pattern)), lambda b: b["text"]
    )


def law_metadata(html: Column) -> Column:
    """Title, publication date line and validity date line of a law page."""
    titles = F.concat(classed_texts(html, "h2", "titulo_parrafo"), F.transform(blocks(html, ("h1",)), lambda b: b["text"]))
    dates = classed_texts(html, "p", "fecha")
    return F.struct(
        F.get(titles, F.lit(0)).alias("title"),
        F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(dates, lambda d: F.lower(d).contains("publicaci"))), -1).alias("published"),
        F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(dates, lambda d: F.lower(d).contains("vigencia"))), -1).alias("in_force"),
    )


def eu_articles(html: Column) -> Column:
    """Articles of an EU act page, by element ids ``art_<n>``: array of (article, title, text, items).

    An article runs from its start tag to the next article's; items are elements with an id and no class.
    """
    marked = F.split(
        F.regexp_replace(F.replace(html, F.lit(_CUT), F.lit(" ")), r"<div id=\"art_(\d+)\"", _CUT + "$0"), _CUT, -1
    )
    bodies = F.transform(
        F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))),
        lambda m: F.regexp_replace(m, r"(?is)</article>.*$", ""),
    )

    def one(m: Column) -> Column:
        parts = F.filter(
            F.transform(segments(m), lambda s: F.struct(F.regexp_extract(s, r"^<[^>]*>", 0).alias("attrs"), inner_text(s).alias("text"))),
            lambda p: (p["text"] != "") & p["attrs"].rlike("^<div"),
        )
        return bind(
            parts,
            lambda ps: F.struct(
                F.regexp_extract(m, r"^<div id=\"art_(\d+)\"", 1).alias("article"),
                F.coalesce(F.get(F.transform(F.filter(ps, lambda p: p["attrs"].contains("eli-title")), lambda p: p["text"]), F.lit(0)), F.lit("")).alias("title"),
                F.array_join(F.transform(ps, lambda p: p["text"]), "\n").alias("text"),
                F.transform(
                    F.filter(ps, lambda p: p["attrs"].rlike(r"\sid=") & ~p["attrs"].rlike(r"\sclass=") & ~p["attrs"].rlike(r"id=\"art_")),
                    lambda p: p["text"],
                ).alias("items"),
            ),
        )

    return F.transform(bodies, one)


def eu_title(html: Column) -> Column:
    """Title of an EU act: the h1, else the DC.title tag, else the document-title element."""
    meta = first_group(html, r"(?is)<meta name=\"DC\.title\" content=\"([^\"]*)\"")
    box = none_if_empty(inner_text(F.regexp_extract(html, r"(?is)<div id=\"document-title\">(.*?)</div>", 1)))
    return F.coalesce(none_if_empty(main_title(html)), F.trim(meta), box)
