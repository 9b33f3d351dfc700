"""Information extraction: pages to mentions, relations and facts.

The language model is a provider: ``Annotator`` turns a text into tokens. The default one is rule-based
(capitalised runs, a gazetteer, dates, a verb list), so what it finds differs from a statistical model;
everything after the tokens is the same for any provider and runs as joins and windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.functions.text import clean_text, is_predicate_verb, is_target_label, is_useful_endpoint, is_useful_page, is_valid_entity, strip, title_from_url, verb_label, word_count
from graphloom.plans.fixpoint import cut
from graphloom.terms import SEEDS

#: ``sentence`` is on a sentence's first token (i = 0) alone: the others are null, so that a sentence isn't
#: stored, shuffled and sorted as often as it has words.
TOKENS = "page_id long, sent_id int, sentence string, i int, text string, lemma string, pos string, dep string, head int, label string, iob string"
_NAMES = [c.split()[0] for c in TOKENS.split(", ")]

_TOKEN_TYPE = ", ".join(f"{n}: {k}" for n, k in (c.split() for c in TOKENS.split(", ")[3:]))
#: Of an annotated page: its sentences, each with its tokens by i.
SENTENCES = f"array<struct<sent_id: int, sentence: string, tokens: array<struct<{_TOKEN_TYPE}>>>>"

#: (sent_id, sentence, i, text, lemma, pos, dep, head, label, iob) per token of a text.
Annotator = Callable[[str], list[tuple]]

_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
_DATE = re.compile(rf"\b(?:\d{{1,2}} (?:{_MONTH}) \d{{4}}|(?:{_MONTH}) \d{{1,2}}, \d{{4}}|(?:{_MONTH}) \d{{4}}|[12]\d{{3}})\b")
_SENTENCE = re.compile(r"[^.!?]+(?:[.!?](?!\s|$)[^.!?]*)*[.!?]?")
_TOKEN = re.compile(r"\w+(?:[.'’-]\w+)*|[^\w\s]")
_DIGIT = re.compile(r"\d")
_PREPOSITIONS = frozenset("in on at by to from of with for into onto during under over near".split())
_IRREGULAR = {"flew": "fly", "was": "be", "were": "be", "is": "be", "are": "be", "built": "build", "led": "lead", "left": "leave", "began": "begin", "became": "become", "had": "have", "has": "have"}
_LABEL_HINTS = (
    ("EVENT", ("apollo", "mission", "program", "gemini", "artemis")), ("PRODUCT", ("falcon", "dragon", "telescope", "shuttle", "hubble", "station")),
    ("FAC", ("center", "canaveral", "laboratory")), ("ORG", ("nasa", "esa", "spacex", "agency", "roscosmos", "jaxa", "isro", "administration", "technologies", "jpl", "csa")),
    ("LOC", ("mars", "moon", "earth", "sun", "jupiter", "saturn", "venus", "mercury", "pluto")),
)
_COUNTRIES = frozenset("united states russia france germany china india japan canada europe america".split())


def _label(name: str) -> str:
    low = name.lower()
    if _DATE.fullmatch(name):
        return "DATE"
    for label, hints in _LABEL_HINTS:
        if any(h in low.split() for h in hints):
            return label
    if low in _COUNTRIES or all(w in _COUNTRIES for w in low.split()):
        return "GPE"
    return "PERSON" if " " in name or low in SEEDS else "ORG"


def _lemma(word: str) -> str:
    low = word.lower()
    if low in _IRREGULAR:
        return _IRREGULAR[low]
    for end, cut in (("ied", "y"), ("ched", "ch"), ("shed", "sh"), ("nned", "n"), ("ted", "t"), ("ded", "d"), ("ned", "n"), ("ed", "e"), ("ies", "y"), ("ches", "ch"), ("s", "")):
        if low.endswith(end) and len(low) > len(end) + 1:
            return low[: -len(end)] + cut
    return low


def _nameless(sentence: str) -> bool:
    """Whether a sentence surely holds neither name nor date: no capital but its first letter and no digit."""
    if not sentence[1:].islower() or _DIGIT.search(sentence):
        return False
    first, second = ([t[0] for t, _ in zip(_TOKEN.finditer(sentence), range(2))] + ["", ""])[:2]
    return first.lower() not in SEEDS and not second.isdigit() and not (first.isupper() and len(first) > 1)


def default_annotator(text: str, whole: bool = True) -> list[tuple]:
    """Tokens by rule: per sentence one root verb (the first finite-looking one after a name), the name
    before it as subject, the name right after it as object, names after later prepositions. ``whole``:
    also of sentences that hold no name."""
    out = []
    for sent_id, m in enumerate(s for s in _SENTENCE.finditer(text) if s[0].strip()):
        sentence = m[0].strip()
        if not whole and _nameless(sentence):
            continue
        words = [(t.start(), t.end(), t[0]) for t in _TOKEN.finditer(sentence)]
        label, iob = [""] * len(words), ["O"] * len(words)
        for d in _DATE.finditer(sentence):
            inside = [k for k, (a, b, _) in enumerate(words) if d.start() <= a and b <= d.end()]
            for n, k in enumerate(inside):
                label[k], iob[k] = "DATE", "B" if n == 0 else "I"
        k = 0
        while k < len(words):
            j = k
            while j < len(words) and not label[j] and (words[j][2][0].isupper() or (j > k and words[j][2].isdigit())):
                j += 1
            known = j - k > 1 or (j > k and (k > 0 or words[k][2].lower() in SEEDS or words[k][2].isupper()))
            if known and len(words[k][2]) > 1:
                kind = _label(" ".join(w for *_, w in words[k:j]))
                for n in range(k, j):
                    label[n], iob[n] = kind, "B" if n == k else "I"
            k = max(j, k + 1)
        verb = lambda w: w.islower() and (w in _IRREGULAR or w.endswith(("ed", "es", "ies")) or (w.endswith("s") and not w.endswith("ss")))
        root = next((k for k, (*_, w) in enumerate(words) if verb(w) and any(x in ("B", "I") for x in iob[:k])), -1)
        dep, head = ["dep"] * len(words), [root if root >= 0 else k for k in range(len(words))]
        if root >= 0:
            dep[root] = "ROOT"
            before = [k for k in range(root) if iob[k] != "O" and (k + 1 == root or iob[k + 1] != "I")]
            if before:
                dep[before[-1]] = "nsubj"
            prep, seen = -1, False
            for k in range(root + 1, len(words)):
                if words[k][2] in _PREPOSITIONS:
                    prep, dep[k] = k, "prep"
                elif iob[k] != "O" and (k + 1 == len(words) or iob[k + 1] != "I"):
                    if prep >= 0:
                        dep[k], head[k], prep = "pobj", prep, -1
                    elif not seen:
                        dep[k], seen = "dobj", True
        for k, (*_, w) in enumerate(words):
            pos = "VERB" if k == root else "PROPN" if iob[k] != "O" else "X"
            out.append((sent_id, sentence, k, w, _lemma(w) if k == root else w.lower(), pos, dep[k], head[k], label[k], iob[k]))
    return out


#: A worker gives its pages on once it holds so many tokens.
BATCH_TOKENS = 50_000


def annotate(pages: DataFrame, annotator: Annotator = default_annotator, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """A row per page, its other columns and ``sentences`` for the text: of each its tokens in order. Only
    sentences with a tag or a label are there, as the others can't hold a fact. Each plan that reads it
    annotates anew; ``facts`` writes what it found once."""
    rest = [c for c in pages.columns if c not in (id_col, text_col)]
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), *rest, clean_text(text_col).alias("__text"))
    annotator = partial(default_annotator, whole=False) if annotator is default_annotator else annotator
    return given.mapInArrow(_annotated(annotator, lambda tokens: any(t[9] != "O" or t[8] for t in tokens)), given.drop("__text").withColumn("sentences", F.lit(None).cast(SENTENCES)).schema)


def _annotated(annotator: Annotator, keeps: Callable[[list[tuple]], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            begin, ends, sents, token_ends, tokens = 0, [0], [], [0], []
            for row in range(batch.num_rows):
                of: list[tuple] = []
                for t in [*annotator(batch.column(batch.num_columns - 1)[row].as_py() or ""), None]:
                    if of and (t is None or t[0] != of[0][0]):
                        if keeps(of):
                            sents.append(of[0][:2])
                            tokens += [x[2:] for x in of]
                            token_ends.append(len(tokens))
                        of = []
                    if t is not None:
                        of.append(t)
                ends.append(len(sents))
                if len(tokens) >= BATCH_TOKENS or row == batch.num_rows - 1:
                    columns = list(zip(*tokens, strict=True)) if tokens else [()] * len(kinds)
                    words = pa.ListArray.from_arrays(pa.array(token_ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES[3:]))
                    each = pa.StructArray.from_arrays([pa.array([s[0] for s in sents], pa.int32()), pa.array([s[1] for s in sents], pa.string()), words], names=["sent_id", "sentence", "tokens"])
                    part = batch.slice(begin, row + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=[*part.schema.names[:-1], "sentences"])
                    begin, ends, sents, token_ends, tokens = row + 1, [0], [], [0], []

    return run


def tokenize(pages: DataFrame, annotator: Annotator = default_annotator, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """The token table of ``pages``, all sentences of it. Each plan that reads it annotates anew."""
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), clean_text(text_col).alias("__text"))
    return flat(given.mapInArrow(_annotated(annotator, lambda tokens: True), f"page_id long, sentences {SENTENCES}"))


def flat(pages: DataFrame) -> DataFrame:
    """The token table of annotated pages."""
    each = pages.select("page_id", F.inline_outer("sentences")).select("page_id", "sent_id", "sentence", F.inline_outer("tokens")).where("i is not null")
    return each.withColumn("sentence", F.when(F.col("i") == 0, F.col("sentence"))).select(*_NAMES)


def nested(tokens: DataFrame) -> DataFrame:
    """Annotated pages, a row per sentence, of a token table; what is nested already stays as it is."""
    if "sentences" in tokens.columns:
        return tokens
    held = F.array_sort(F.collect_list(F.struct(*_NAMES[3:]))).alias("tokens")
    by = tokens.groupBy("page_id", "sent_id").agg(F.max(F.when(F.col("i") == 0, F.col("sentence"))).alias("sentence"), held)
    return by.select("page_id", F.array(F.struct("sent_id", "sentence", "tokens")).alias("sentences"))


def spans(tokens: DataFrame, legacy: bool = False) -> DataFrame:
    """Entity spans, one row per token of one: ``first`` position, ``span`` text. Islands of B and I tags by
    a running count within the sentence. ``legacy``: from a token that isn't the first of its span, the
    first one is left out, as a walk to the left that stops at it does."""
    sentence = Window.partitionBy("page_id", "sent_id").orderBy("i")
    inside = tokens.withColumn("island", F.sum((F.col("iob") != "I").cast("int")).over(sentence)).where("iob <> 'O'")
    whole = Window.partitionBy("page_id", "sent_id", "island")
    held = F.array_sort(F.collect_list(F.struct("i", "iob", "text")).over(whole))
    if legacy:
        held = F.when(F.col("iob") == "I", F.filter(held, lambda x: x["iob"] == "I")).otherwise(held)
    text = F.array_join(F.transform(held, lambda x: x["text"]), " ")
    return inside.withColumn("span", text).withColumn("first", F.min("i").over(whole))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _spans(tokens: Column, legacy: bool = False) -> Column:
    """The entity spans of a sentence's tokens, as in ``spans``. A span begins at a tag that goes on from
    none and ends where no I follows, so beginnings and ends pair up."""
    at = lambda keeps: F.filter(F.transform(tokens, lambda t, k: F.when((t["iob"] != "O") & keeps(t, k), k)), lambda k: k.isNotNull())
    begin = at(lambda t, k: (t["iob"] != "I") | (k == 0) | (F.get(tokens, k - 1)["iob"] == "O"))
    end = at(lambda t, k: F.coalesce(F.get(tokens, k + 1)["iob"] != "I", F.lit(True)))
    text = lambda of: F.array_join(F.transform(of, lambda t: t["text"]), " ")
    whole = lambda of: F.struct(of[0]["i"].alias("first"), F.element_at(of, -1)["i"].alias("last"), of[0]["label"].alias("label"), text(of).alias("text"), *([text(F.filter(of, lambda t: t["iob"] == "I")).alias("inner")] if legacy else []))
    return F.zip_with(begin, end, lambda a, b: _let(F.slice(tokens, a + 1, b - a + 1), whole))


def _mentions(spans: Column, sent: Column) -> Column:
    """Kind 1: the valid mentions of a sentence."""
    kept = F.filter(spans, lambda s: is_target_label(s["label"]) & is_valid_entity(s["text"], s["label"]))
    return F.transform(kept, lambda s: _found(1, sent, s["first"], s["first"], s["text"], s["label"], F.lit("mentionedIn"), F.lit(None).cast("string"), F.lit("Article")))


def _found(kind: int, sent: Column, i: Column, object_i: Column, subject: Column, subject_label: Column, predicate: Column, object_: Column, object_label: Column) -> Column:
    columns = {"kind": F.lit(kind), "sent_id": sent["sent_id"], "i": i, "object_i": object_i, "subject": subject, "subject_label": subject_label, "predicate": predicate, "object": object_, "object_label": object_label, "sentence": sent["sentence"]}
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _links(tokens: Column, spans: Column, sent: Column, legacy: bool) -> Column:
    """Kind 0: subject-verb-object and subject-verb-preposition-object of a sentence."""
    def text(t: Column) -> Column:
        whole = F.get(F.filter(spans, lambda s: (s["first"] <= t["i"]) & (t["i"] <= s["last"])), F.lit(0))
        return F.when(t["iob"] == "O", t["text"]).otherwise(_let(whole, lambda s: F.when(t["iob"] == "I", s["inner"]).otherwise(s["text"])) if legacy else whole["text"])

    def ends(found: Column) -> Column:
        named = F.transform(found, lambda t: F.struct(t["i"].alias("i"), t["head"].alias("head"), text(t).alias("text"), t["label"].alias("label")))
        return F.filter(named, lambda t: is_useful_endpoint(t["text"]))

    fact = lambda s, predicate, o: _found(0, sent, s["i"], o["i"], s["text"], s["label"], predicate, o["text"], o["label"])

    def of_verb(verb: Column) -> Column:
        return _let(F.filter(tokens, lambda t: t["head"] == verb["i"]), lambda arms: _let(objects(verb, arms), lambda known: F.when(F.size(known) > 0, pairs(arms, known))))

    def objects(verb: Column, arms: Column) -> Column:
        direct = F.filter(arms, lambda t: t["dep"].isin("dobj", "attr", "oprd") & (t["label"] != ""))
        through = lambda p, named: F.transform(F.filter(named, lambda o: o["head"] == p["i"]), lambda o: F.struct(verb_label(verb["lemma"], p["text"]).alias("predicate"), o.alias("o")))
        named = ends(F.filter(tokens, lambda t: (t["dep"] == "pobj") & (t["label"] != "")))
        indirect = _let(named, lambda x: F.flatten(F.transform(F.filter(arms, lambda t: t["dep"] == "prep"), lambda p: through(p, x))))
        return F.concat(F.transform(ends(direct), lambda o: F.struct(verb_label(verb["lemma"]).alias("predicate"), o.alias("o"))), indirect)

    def pairs(arms: Column, known: Column) -> Column:
        subjects = ends(F.filter(arms, lambda t: t["dep"].isin("nsubj", "nsubjpass") & (t["label"] != "")))
        return F.flatten(F.transform(subjects, lambda s: F.transform(known, lambda x: fact(s, x["predicate"], x["o"]))))

    roots = F.filter(tokens, lambda t: (t["dep"] == "ROOT") & (t["pos"] == "VERB") & is_predicate_verb(t["lemma"]))
    return F.flatten(F.filter(F.transform(F.slice(roots, 1, 1), of_verb), lambda x: x.isNotNull()))


def found(relations: bool = True, mentions: bool = True, legacy: bool = False) -> Column:
    """What the sentences of an annotated page hold, repeats with it: kind (0: relation, 1: mention),
    place, subject, predicate and object; a mention's object, the page's title, is null here. It is to be
    taken apart by ``inline_outer``: for ``inline`` a filter is inferred that works it all out again."""

    def of(sent: Column) -> Column:
        both = lambda spans: [*([_links(sent["tokens"], spans, sent, legacy)] if relations else []), *([_mentions(spans, sent)] if mentions else [])]
        return _let(_spans(sent["tokens"], legacy), lambda spans: F.concat(*both(spans)))

    return F.flatten(F.transform("sentences", of))


def entities(tokens: DataFrame) -> DataFrame:
    """(page_id, text, label, sentence, sent_id, i): valid mentions of the kept labels, the first of each
    (text, label) on a page. ``tokens``: a token table or annotated pages."""
    rows = nested(tokens).select("page_id", F.inline_outer(found(relations=False))).where("kind is not null")
    rows = rows.select("page_id", F.col("subject").alias("text"), F.col("subject_label").alias("label"), "sentence", "sent_id", "i")
    return first_of(rows, ["page_id", "text", "label"], ["sent_id", "i"])


def relations(tokens: DataFrame, legacy_span: bool = False) -> DataFrame:
    """Subject-verb-object and subject-verb-preposition-object facts whose ends are both entities, the first
    of each on a page. ``legacy_span`` as in ``spans``."""
    rows = nested(tokens).select("page_id", F.inline_outer(found(mentions=False, legacy=legacy_span))).where("kind is not null").withColumnRenamed("i", "subject_i")
    rows = rows.select("page_id", "subject", "subject_label", "predicate", "object", "object_label", "sentence", "sent_id", "subject_i", "object_i")
    return first_of(rows, ["page_id", "subject", "predicate", "object"], ["sent_id", "subject_i", "object_i"])


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given. One aggregation with partial results: no window sorts
    a hot key's rows."""
    rest = [*order, *[c for c in rows.columns if c not in by and c not in order]]
    chosen = rows.groupBy(*by).agg(F.min(F.struct(*rest)).alias("r"))
    return chosen.select(*[F.col(c) if c in by else F.col(f"r.{c}").alias(c) for c in rows.columns])


#: Rows that a worker packs at a time.
PACKED_ROWS = 400_000


def first_of_packed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``first_of`` for many narrow rows, most of them of different keys: they are dealt by the keys' hash as
    compressed column batches, several times smaller than rows, each less the repeats in it. The blocks are
    twice ``spark.sql.shuffle.partitions``; a task holds one."""
    spark = rows.sparkSession
    rest = [*order, *[c for c in rows.columns if c not in by and c not in order]]
    rows = rows.select(*by, *rest)
    blocks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = to_arrow_schema(rows.schema)

    def first(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in rest], null_placement="at_start"))
        at = table.select(by).append_column("__at", pa.array(np.arange(table.num_rows))).group_by(by, use_threads=False).aggregate([("__at", "min")])
        return table.take(at["__at_min"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            table = first(pa.Table.from_batches(held).combine_chunks())
            block = table["__block"].to_numpy()
            place = np.argsort(block, kind="stable")
            table, ends = table.select(schema.names).take(place).cast(schema).combine_chunks(), np.flatnonzero(np.diff(block[place], append=-1)) + 1
            options, begin, out = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 12)), 0, []
            for end in ends.tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=options) as writer:
                    writer.write_table(table.slice(begin, end - begin))
                out.append(sink.getvalue().to_pybytes())
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(block[place][ends - 1], pa.int32()), pa.array(out, pa.binary())], names=["block", "packed"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED_ROWS:
                yield from packed()
                held.clear()
        if any(b.num_rows for b in held):
            yield from packed()

    def unpack(table: pa.Table) -> pa.Table:
        return first(pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["packed"]).combine_chunks())

    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")).mapInArrow(pack, "block int, packed binary")
    return dealt.groupBy("block").applyInArrow(unpack, rows.schema)


def facts(pages: DataFrame, annotator: Annotator = default_annotator, id_col: str = "page_id", counters: Observation | None = None) -> DataFrame:
    """The fact table of pages (``page_id, url, title, text``): relations of all pages before mentions, the
    first of each (subject, predicate, object). ``counters`` observes the rows before that choice. Texts are
    annotated once: what they hold is a table in the shared folder."""
    given = pages.select(F.col(id_col).alias("page_id"), "url", "title", "text")
    return fact_rows(cut(annotate(given, annotator)), counters)


def fact_rows(pages: DataFrame, counters: Observation | None = None) -> DataFrame:
    """``facts`` of annotated pages (``page_id, url, title, sentences``)."""
    title = F.coalesce("title", "url").alias("title")
    pages = _whole(pages).select("page_id", "url", title, "__first", found().alias("__found"))
    if counters is not None:
        pages = _observed(pages, counters)
    rows = pages.select("page_id", "url", "title", F.inline_outer("__found")).where("kind is not null")
    rows = rows.withColumn("object", F.when(F.col("kind") == 1, F.col("title")).otherwise(F.col("object")))
    for c in ("subject", "predicate", "object"):
        rows = rows.withColumn(c, strip(c))
    rows = rows.select("subject", "predicate", "object", "kind", "page_id", "sent_id", "i", "object_i", "subject_label", "object_label", F.col("url").alias("source_url"), F.substring("sentence", 1, 300).alias("sentence"))
    chosen = first_of_packed(rows, ["subject", "predicate", "object"], ["kind", "page_id", "sent_id", "i", "object_i"])
    return chosen.select("subject", "subject_label", "predicate", "object", "object_label", "source_url", "sentence", F.when(F.col("kind") == 0, "relation").otherwise("ner").alias("extraction_type"))


def count_found(pages: DataFrame, counters: Observation) -> DataFrame:
    """Annotated pages, of which ``counters`` observes what ``fact_rows`` lets it, without the facts."""
    return _observed(_whole(pages).select("page_id", "__first", found().alias("__found")), counters).select("page_id")


def _observed(pages: DataFrame, counters: Observation) -> DataFrame:
    """Relations by subject, predicate and object and mentions by text and label, each once a page."""

    def once(kind: int, *parts: str) -> Column:
        key = lambda x: F.concat(*[F.concat(F.length(x[p]).cast("string"), F.lit(":"), x[p]) for p in parts])
        return F.sum(F.when(F.col("__first"), F.size(F.array_distinct(F.transform(F.filter("__found", lambda x: x["kind"] == kind), key)))).otherwise(0))

    return pages.observe(counters, F.coalesce(once(0, "subject", "predicate", "object"), F.lit(0)).alias("relations"), F.coalesce(once(1, "subject", "subject_label"), F.lit(0)).alias("mentions"))


def _whole(pages: DataFrame) -> DataFrame:
    """Annotated pages with all sentences of their id: if ids are in several rows, each of these has the
    sentences of all. ``__first`` is true in one row of an id."""
    pages = pages.withColumn("__first", F.lit(True))
    repeated = pages.groupBy("page_id").count().where("count > 1").select("page_id")
    if repeated.isEmpty():
        return pages
    at = F.row_number().over(Window.partitionBy("page_id").orderBy("url", "title")) == 1
    several = pages.join(repeated, "page_id", "left_semi")
    held = several.groupBy("page_id").agg(F.flatten(F.collect_list("sentences")).alias("sentences"))
    rows = several.select("page_id", "url", "title", at.alias("__first")).join(held, "page_id")
    return pages.join(repeated, "page_id", "left_anti").select(*rows.columns).unionByName(rows)


# --- pages ---


class _MainText(HTMLParser):
    SKIP = frozenset("script style nav aside footer header form noscript table svg".split())
    BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li article section br ul ol blockquote".split())

    def __init__(self):
        super().__init__()
        self.skip, self.article = 0, 0
        self.all: list[str] = []
        self.main: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        self.article += tag in ("article", "main")
        if tag in self.BLOCK:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag in self.BLOCK:
            self.handle_data("\n")
        self.article = max(0, self.article - (tag in ("article", "main")))

    def handle_data(self, data):
        if not self.skip:
            self.all.append(data)
            if self.article:
                self.main.append(data)


def main_text(html: str | None) -> str | None:
    """The readable text of a page: that of its article, if it has one; None if there is none."""
    if not html:
        return None
    parser = _MainText()
    parser.feed(html)
    parser.close()
    text = "".join(parser.main) if "".join(parser.main).strip() else "".join(parser.all)
    lines = [re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in text.split("\n")]
    return "\n".join(line for line in lines if line) or None


def crawl(fetched: DataFrame, least_words: int = 500) -> DataFrame:
    """Page records of fetched pages (``page_id, url, html``): main text, title from the URL, word count;
    pages without text or with fewer words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h.as_py()) for h in b.column(2)], pa.string())], names=["page_id", "url", "text"])

    texts = fetched.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
    rows = texts.where(F.col("text").isNotNull()).withColumn("word_count", word_count("text"))
    kept = rows.where(is_useful_page("text", least_words))
    return kept.select("page_id", "url", title_from_url("url").alias("title"), "text", "word_count", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("crawled_at"))
