"""Scalar functions as Column expressions.

Words are ``[\\p{L}\\p{N}_]`` throughout (a bare ``\\w`` is ASCII only in the JVM), white space is
trimmed by a list (``trim`` alone takes spaces only), lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.terms import CLASS_KEYWORDS, ENTITY, ENTITY_STOPWORDS, ONTOLOGY, PRONOUNS, RESOURCE, SKIPPED_VERBS, TARGET_LABELS

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[ \t\n\r\f\x0B]"
NUMERIC_ONLY = r"\A[\p{Nd} \t\n\r\f\x0B,.%-]+\z"
# What makes a label unfit for alignment (searched for, in either case).
UNCLEAN_LABEL = (
    r"^[\p{Nd}]{1,4}$|^[\p{Nd}]{1,2}[ \t\n\r\f\x0B]+[\p{L}\p{N}_]+[ \t\n\r\f\x0B]+[\p{Nd}]{4}|^[\p{L}\p{N}_]+[ \t\n\r\f\x0B]+[\p{Nd}]{1,2},?[ \t\n\r\f\x0B]+[\p{Nd}]{4}"
    r"|^[\p{Nd}]{4}[-–][\p{Nd}]{2,4}$|^[\p{Nd}., \t\n\r\f\x0B%–-]+$|[\[\]{}]|doi:|arxiv:|bibcode:|\.[\p{Nd}]+\]$|citation|needed|verify|reflist|^[\p{Nd}]+[A-Z]\.|\.\[|[ \t\n\r\f\x0B]+[-–][ \t\n\r\f\x0B]+"
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.btrim(_c(x), F.lit(" \t\n\r\f\x0b"))


def clean_text(x: Column | str) -> Column:
    """White space runs as one space, ends trimmed."""
    return strip(F.regexp_replace(_c(x), rf"{SPACE}+", " "))


def word_count(x: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_c(x), F.lit(WORD)), F.lit(0)).cast("long")


def is_useful_page(x: Column | str, least: int = 500) -> Column:
    """Not blank, and of ``least`` words or more; null is neither."""
    return F.coalesce((F.length(strip(x)) > 0) & (word_count(x) >= least), F.lit(False))


def slugify(x: Column | str, longest: int = 80) -> Column:
    kept = F.regexp_replace(strip(x), r"[^\p{L}\p{N}_ \t\n\r\f\x0B-]", "")
    return F.substring(F.regexp_replace(kept, r"[ \t\n\r\f\x0B-]+", "_"), 1, longest)


def last_segment(x: Column | str) -> Column:
    return F.substring_index(_c(x), "/", -1)


def title_from_url(x: Column | str) -> Column:
    return F.replace(last_segment(F.regexp_replace(_c(x), "/+$", "")), F.lit("_"), F.lit(" "))


def is_target_label(label: Column | str) -> Column:
    return _c(label).isin(*TARGET_LABELS)


def is_valid_entity(text: Column | str, label: Column | str) -> Column:
    t = strip(text)
    return (F.length(t) >= 2) & ~F.lower(t).isin(*ENTITY_STOPWORDS) & ((_c(label) == "DATE") | ~F.rlike(t, F.lit(NUMERIC_ONLY)))


def is_useful_endpoint(text: Column | str) -> Column:
    t = _c(text)
    return (F.length(t) >= 2) & ~F.lower(t).isin(*PRONOUNS) & ~F.rlike(t, F.lit(NUMERIC_ONLY))


def is_predicate_verb(lemma: Column | str) -> Column:
    return ~F.lower(_c(lemma)).isin(*SKIPPED_VERBS)


def verb_label(lemma: Column | str, preposition: Column | str | None = None) -> Column:
    parts = [F.lower(_c(lemma))] + ([F.lower(_c(preposition))] if preposition is not None else [])
    return F.concat_ws("_", *parts)


def is_clean_label(x: Column | str) -> Column:
    t = strip(x)
    return F.length(t).between(3, 80) & ~F.rlike(t, F.lit(f"(?iu){UNCLEAN_LABEL}"))


def keyword_class(uri: Column | str) -> Column:
    """The first class, in order, of which a keyword is in the URI in any case; else ``Other``."""
    low = F.lower(_c(uri))
    chosen = None
    for name, words in CLASS_KEYWORDS.items():
        hit = F.lit(False)
        for w in dict.fromkeys(w.lower() for w in words):
            hit = hit | F.contains(low, F.lit(w))
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen.otherwise("Other")


def short_name(uri: Column | str) -> Column:
    u = _c(uri)
    cut = lambda ns, prefix: F.concat(F.lit(prefix), F.substring(u, len(ns) + 1, 1 << 30))
    return (
        F.when(F.startswith(u, F.lit(ONTOLOGY)), cut(ONTOLOGY, "skg-o:"))
        .when(F.startswith(u, F.lit(RESOURCE)), cut(RESOURCE, "skg-r:"))
        .when(F.startswith(u, F.lit(ENTITY)), cut(ENTITY, "wd:"))
        .otherwise(F.concat(F.lit("<"), u, F.lit(">")))
    )


def candidate_confidence(rank: Column | str, label: Column | str, found: Column | str) -> Column:
    """From 0.95 down by 0.1 a rank, and 0.1 more where the labels are equal in any case."""
    base = F.greatest(F.lit(0.0), F.lit(0.95) - F.lit(0.1) * _c(rank))
    return F.round(F.least(F.lit(1.0), base + F.when(F.lower(_c(label)) == F.lower(_c(found)), 0.1).otherwise(0.0)), 2)


def alignment_tier(confidence: Column | str) -> Column:
    return F.when(_c(confidence) >= 0.8, "sameAs").when(_c(confidence) >= 0.5, "seeAlso").otherwise("none")


def report_cell(x: Column | str, longest: int = 120) -> Column:
    return F.substring(F.translate(_c(x), "\n|", " /"), 1, longest)


def padded(x: Column | str, width: int, right: bool = False) -> Column:
    """Filled up with spaces to ``width``; longer values stay whole."""
    c = _c(x).cast("string")
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(c)))
    return F.concat(fill, c) if right else F.concat(c, fill)


def extract_sparql(x: Column | str) -> Column:
    """The query in a model's answer: a fence that begins with SELECT, else from the first SELECT on, else
    all; cut after the last brace, prefixes put before it where it names none."""
    t = _c(x)
    fenced = F.regexp_extract(t, r"(?is)```(?:sparql)?\s*(SELECT.*?)```", 1)
    bare = F.regexp_extract(t, r"(?is)(SELECT\s+.*)", 1)
    body = strip(F.when(fenced != "", fenced).when(bare != "", bare).otherwise(t))
    body = F.when(F.contains(body, F.lit("}")), F.regexp_extract(body, r"(?s)\A(.*\})", 1)).otherwise(body)
    body = strip(F.regexp_replace(body, "`+$", ""))
    head = f"PREFIX skg-o: <{ONTOLOGY}>\nPREFIX skg-r: <{RESOURCE}>\n"
    return F.when(F.contains(F.upper(body), F.lit("PREFIX")), body).otherwise(F.concat(F.lit(head), body))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays in double precision."""
    x, y = F.transform(_c(a), lambda v: v.cast("double")), F.transform(_c(b), lambda v: v.cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
