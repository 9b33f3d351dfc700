"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

SQL functions only. Positions come from the text around the matches: ``split`` by a pattern gives the
gaps, ``regexp_extract_all`` the matches, and running sums of their lengths the offsets. All patterns
run in linear time: runs are possessive and start only where a run starts (or where the last match
ended), which gives the same matches as the plain patterns they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, cheap test that a text must pass)
PATTERNS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"."),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15,}+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"+"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", None),
}
KINDS = tuple(PATTERNS)
BASE_KINDS = KINDS[:4]
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: kind -> (score without context, words nearby that raise it)
CONTEXT = {
    "email": (0.8, "mail|contact|write|kontakt|correo|courriel"),
    "ip": (0.5, "ip|host|server|address|login|network"),
    "card": (0.7, "card|visa|credit|payment|karte|carte|tarjeta"),
    "phone": (0.5, "phone|call|tel|mobile|fax|telefon|teléfono"),
    "iban": (0.8, "iban|bank|account|transfer|konto|compte|cuenta"),
}
LOWERING = "example|sample|test|dummy|fake"
WINDOW = 40
_BLOCK = 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """The remainder by 97 of an account number, its first four characters moved to the end."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return _mod97(value) == 1
    return F.lit(True)


def _score(kind: str, around: Column) -> Column:
    plain, words = CONTEXT[kind]
    near = F.lower(around)
    raised = F.when(near.rlike(rf"(?<![\p{{L}}])(?:{words})"), 0.2).otherwise(0.0)
    lowered = F.when(near.rlike(rf"(?<![\p{{L}}])(?:{LOWERING})"), 0.3).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(plain) + raised - lowered)), 2)


def _running(values: str) -> tuple[Column, Column, Column]:
    """Sums before each element of an array column, in two levels so that long arrays stay cheap:
    (sums of blocks, sums before blocks, sums before elements); each is a column of its own step."""
    blocks = F.when(F.size(values) > 0, F.sequence(F.lit(0), ((F.size(values) - 1) / _BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(F.col(values), b * _BLOCK + 1, _BLOCK), F.lit(0), lambda a, x: a + x))
    append = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    before = F.aggregate(F.col(f"{values}_sums"), F.array(F.lit(0)), append)
    each = F.flatten(
        F.transform(
            F.slice(F.col(f"{values}_before"), 1, F.size(f"{values}_sums")),
            lambda start, b: F.slice(F.aggregate(F.slice(F.col(values), b * _BLOCK + 1, _BLOCK), F.array(start), append), 1, _BLOCK),
        )
    )
    return sums, before, each


def _span(kind: str):
    """From a match and its number to a span, with the match as ``value``."""

    def span(x: Column, i: Column) -> Column:
        gap, behind = F.get(F.col(f"{kind}_gap"), i), F.get(F.col(f"{kind}_gap"), i + 1)
        start = F.get(F.col(f"{kind}_at"), i) + F.length(gap)
        around = F.concat(F.right(gap, F.lit(WINDOW)), F.lit(" "), F.left(behind, F.lit(WINDOW)))
        return F.struct(F.lit(kind).alias("kind"), start.alias("from"), (start + F.length(x)).alias("to"), _score(kind, around).alias("score"), x.alias("value"))

    return span


def _holds(kind: str):
    return lambda span: _valid(kind, span["value"])


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``doc_id, text``, the columns ``keep`` and one array per kind: ``email``, ``ip``,
    ``card``, ``phone``, ``iban``; elements have ``kind, from, to`` (code points, end exclusive) and ``score``.

    Null and empty texts have no spans. Kinds may overlap each other. Repeated rows are scanned each.
    Map-only: nothing is shuffled or collected, and no row holds more than its own matches."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    carried = ["doc_id", "text", *[f"kept_{i}" for i in range(len(keep))]]
    none = F.expr("cast(array() as array<string>)")
    cut = []
    for kind, (pattern, test) in PATTERNS.items():
        may = F.col("text").isNotNull() if test is None else F.contains(F.col("text"), F.lit(test))
        may = may & (F.col("text").rlike(pattern) if test is None else F.lit(True))
        cut.append(F.when(may, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(none).alias(f"{kind}_hit"))
        cut.append(F.when(may, F.split("text", pattern, -1)).otherwise(none).alias(f"{kind}_gap"))
    step = texts.select(*carried, *cut)
    hold = [*carried, *[f"{k}_{x}" for k in KINDS for x in ("hit", "gap")]]
    step = step.select(*hold, *[F.zip_with(F.slice(f"{k}_gap", 1, F.size(f"{k}_hit")), f"{k}_hit", lambda gap, x: F.length(gap) + F.length(x)).alias(k) for k in KINDS])
    for level, suffix in enumerate(("_sums", "_before", "_at")):
        step = step.select("*", *[_running(k)[level].alias(f"{k}{suffix}") for k in KINDS])
    spans = [F.transform(F.filter(F.transform(f"{k}_hit", _span(k)), _holds(k)), lambda s: s.dropFields("value")).alias(k) for k in KINDS]
    return step.select("doc_id", "text", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], *spans)


_CUT = 1024


def _between(a: Column, b: Column) -> Column:
    """The code points of the text from ``a`` to ``b``, out of its cuts: the cost doesn't grow with ``a``."""
    first, last = F.floor(a / _CUT).cast("int"), F.floor(b / _CUT).cast("int")
    cut = lambda i: F.coalesce(F.get(F.col("cuts"), i), F.lit(""))
    one = F.substring(cut(first), a - first * _CUT + 1, b - a)
    more = F.concat(F.substring(cut(first), a - first * _CUT + 1, F.lit(_CUT)), F.array_join(F.slice("cuts", first + 2, last - first - 1), ""), F.substring(cut(last), F.lit(1), b - last * _CUT))
    return F.when(first == last, one).otherwise(more)


def redact(docs: DataFrame, *, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """``docs`` with its columns as they are, each span of personal data in the text (overlapping ones as
    one) replaced by ``[KIND]``, the kind of the first and then longest.

    Null and empty texts stay as they are; repeated rows are redacted each; an empty table stays empty;
    other columns are carried along, whatever their names. Map-only, and linear in a text's length."""
    others = [c for c in docs.columns if c != text_col]
    own = docs.select(F.lit(0).alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"))
    found = detect(own, keep=("rest",))
    ordered = lambda s: F.struct(s["from"].alias("from"), (-s["to"]).alias("back"), s["kind"].alias("kind"))
    step = found.select("text", "rest", F.array_sort(F.transform(F.filter(F.concat(*KINDS), lambda s: s["score"] >= least_score), ordered)).alias("found"))
    n = F.size("found")
    step = step.select(
        "text",
        "rest",
        "found",
        F.when(n > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{_CUT}}}"), 0)).otherwise(F.expr("cast(array() as array<string>)")).alias("cuts"),
        F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / _BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)")).alias("blocks"),
    )
    block = lambda b: F.slice("found", b * _BLOCK + 1, _BLOCK)
    # How far the spans before each block reach; then each block's pieces by themselves.
    step = step.withColumn("tops", F.transform("blocks", lambda b: F.array_max(F.transform(block(b), lambda s: -s["back"]))))
    step = step.withColumn("upto", F.aggregate("tops", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.greatest(F.element_at(acc, -1), x))))

    def add(acc: Column, s: Column) -> Column:
        piece = F.concat(_between(acc["upto"], s["from"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        parts = F.when(s["from"] >= acc["upto"], F.array_append(acc["parts"], piece)).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["upto"], -s["back"]).alias("upto"), parts.alias("parts"))

    begin = lambda b: F.struct(F.get(F.col("upto"), b).alias("upto"), F.expr("cast(array() as array<string>)").alias("parts"))
    pieces = F.flatten(F.transform("blocks", lambda b: F.aggregate(block(b), begin(b), add, lambda acc: acc["parts"])))
    clean = F.when(n > 0, F.concat(F.array_join(pieces, ""), _between(F.element_at("upto", -1), F.length("text")))).otherwise(F.col("text"))
    done = step.select("rest", clean.alias("text"))
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[f"c{others.index(c)}"].alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")
    n = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    best = F.array_max(F.transform(F.concat(*KINDS), lambda s: s["score"]))
    return found.select("doc_id", *n[:4], F.sha2(joined(F.concat(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.concat(*KINDS)).alias("spans"), n[4], best.alias("top_score"))
