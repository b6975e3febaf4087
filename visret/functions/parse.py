"""Queries as text -> bound facets, all as column expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from visret.functions.lexicon import DEFAULT, PROMPTS, Lexicon


def words(parts) -> str:
    return "|".join(re.escape(p) for p in parts)


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def contains(text: Column, phrase: str) -> Column:
    """Whether ``text`` has the phrase as words of its own. Most texts don't have it at all, which is
    cheaper to see."""
    return F.contains(text, F.lit(phrase)) & F.regexp_like(text, F.lit(rf"(?U)(?<!\w){re.escape(phrase)}(?!\w)"))


def spans(text: Column, pattern: str) -> Column:
    """(start, end, word) of every match of ``pattern`` in order; word is its first group."""
    begin, close = "\x01", "\x02"
    parts = F.split(F.regexp_replace(F.translate(text, begin + close, "\x03\x03"), f"({pattern})", f"{begin}$1{close}"), f"[{begin}{close}]")
    each = F.transform(parts, lambda p, i: F.struct((i % 2 == 1).alias("hit"), p.alias("p")))  # what matches stands between what doesn't
    none = F.array().cast("array<struct<start: int, end: int, word: string>>")

    def step(s: Column, p: Column) -> Column:
        to = s["at"] + F.length(p["p"])
        new = F.array(F.struct(s["at"].alias("start"), to.alias("end"), F.regexp_extract(p["p"], pattern, 1).alias("word")))
        return F.struct(to.alias("at"), F.when(p["hit"], F.concat(s["found"], new)).otherwise(s["found"]).alias("found"))

    return F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]


def bindings(text: Column, lex: Lexicon = DEFAULT) -> Column:
    """Coloured garments in order, then garments without a colour, each once. A garment without a colour
    is one that overlaps no coloured one: where garments contain no colour, what is left when the
    coloured ones are blanked; else the spans of both are compared."""
    thing = words(lex.longest_first)
    coloured = rf"(?U)\b(?:({words(lex.intensifiers)})\s+)?({words(lex.colors)})\s+({thing})s?\b"
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(coloured), F.lit(k)).alias(f"p{k}") for k in (1, 2, 3)])
    phrases = F.transform(parts, lambda p: F.trim(F.concat_ws(" ", p["p1"], p["p2"], p["p3"])))
    alone = rf"(?U)\b({thing})s?\b"
    if any(re.search(rf"(?<!\w){re.escape(c)}(?!\w)", g) for g in lex.garments for c in lex.colors):
        taken = spans(text, coloured)
        free = F.filter(spans(text, alone), lambda g: ~F.exists(taken, lambda t: (g["start"] < t["end"]) & (g["end"] > t["start"])))
        bare = F.transform(free, lambda g: g["word"])
    else:
        bare = F.regexp_extract_all(F.regexp_replace(text, coloured, " | "), F.lit(alone), F.lit(1))
    return F.array_distinct(F.concat(phrases, bare))


def named(text: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Names of which any alias occurs, in the order of ``aliases``."""
    def any_of(phrases):
        out = F.lit(False)
        for p in phrases:
            out = out | contains(text, p)
        return out

    return F.array_compact(F.array(*[F.when(any_of(a), F.lit(name)) for name, a in aliases.items()]))


def negatives(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b(?:without|not wearing|no)\s+([^,.;]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^[ .,;]+|[ .,;]+$", "")))


def parsed(text: Column, lex: Lexicon = DEFAULT, normal: Column | None = None) -> dict[str, Column]:
    """Columns raw, bindings, scenes, styles, actions and negatives; null text is an empty query. Some forty
    patterns look at the normalized text; where a column has it, ``normal`` names that."""
    t = normalized(F.coalesce(text, F.lit(""))) if normal is None else normal
    return {
        "raw": F.trim(F.coalesce(text, F.lit(""))), "bindings": bindings(t, lex), "scenes": named(t, lex.scenes),
        "styles": named(t, lex.styles), "actions": named(t, {a: (a,) for a in lex.actions}), "negatives": negatives(t),
    }


def color_of(binding: Column, lex: Lexicon = DEFAULT) -> Column:
    """The first colour of the lexicon that the phrase has, else null."""
    return F.coalesce(*[F.when(contains(normalized(binding), c), F.lit(c)) for c in lex.colors])


def garment_of(binding: Column, lex: Lexicon = DEFAULT) -> Column:
    """The longest garment that the phrase has, else the phrase."""
    b = normalized(binding)
    return F.coalesce(*[F.when(contains(b, g), F.lit(g)) for g in lex.longest_first], b)


def distractors(color: Column, garment: Column, query_colors: Column, lex: Lexicon = DEFAULT) -> Column:
    """The colour on other garments, then the query's other colours on the garment, each once; none
    without a colour."""
    pairs = [x for g, others in lex.confusable.items() for x in (F.lit(g), F.array(*map(F.lit, others)))]
    known = F.try_element_at(F.create_map(*pairs), garment) if pairs else F.lit(None).cast("array<string>")
    others = F.filter(F.coalesce(known, F.array(*map(F.lit, lex.otherwise))), lambda g: g != garment)
    swapped = F.filter(query_colors, lambda c: c != color)
    phrases = F.concat(F.transform(others, lambda g: F.concat_ws(" ", color, g)), F.transform(swapped, lambda c: F.concat_ws(" ", c, garment)))
    return F.when(color.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(phrases))


def prompts(facet: Column, kind: Column | str) -> Column:
    """Prompts of a facet; a kind without templates has the facet alone."""
    made = lambda k: F.array(*[F.replace(F.lit(t), F.lit("{}"), facet) for t in PROMPTS[k]])
    if isinstance(kind, str):
        return made(kind)
    out = F.array(facet)
    for k in PROMPTS:
        out = F.when(kind == k, made(k)).otherwise(out)
    return out
