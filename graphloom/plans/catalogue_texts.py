"""Registered queries over token tables, answers, rules and the rest of the query language.

Extraction after the annotator is the same for any tokens, so a rule that SQL can state, too, stands for the
annotator: each eight words of a text are a sentence of a name of two words, a verb, a name, a preposition
and a place of two words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import extract, rag, reason
from graphloom.plans.catalogue import CORE, W, _ask, _rules, _triples, graph_sql, mapped
from graphloom.plans.registry import query, read
from graphloom.terms import ENTITY_STOPWORDS, ONTOLOGY, OWL, PRONOUNS, QUESTIONS, RDFS, RESOURCE, SAME_AS, SKIPPED_VERBS, TARGET_LABELS, TRIPLE_SCHEMA, TYPE

R, O = RESOURCE, ONTOLOGY

# --- extraction ---

#: By place in the sentence: label, tag, relation, head.
_SHAPE = (("PERSON", "B", "compound", 1), ("PERSON", "I", "nsubj", 2), ("", "O", "ROOT", 2), ("ORG", "B", "dobj", 2), ("", "O", "prep", 2), ("GPE", "B", "pobj", 4), ("GPE", "I", "dep", 5), ("", "O", "dep", 2))


def _annotated(spark, d) -> DataFrame:
    """The documents as annotated pages: ``page_id, url, title, sentences``."""
    at = lambda part, i: F.get(F.array(*[F.lit(x[part]) for x in _SHAPE]), i)
    words = read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), F.regexp_extract_all("text", F.lit(W), 0).alias("words"))

    def token(w: Column, i: Column) -> Column:
        parts = {"i": i, "text": w, "lemma": F.lower(w), "pos": F.when(i == 2, "VERB").otherwise("X"), "dep": at(2, i), "head": at(3, i), "label": at(0, i), "iob": at(1, i)}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    sentence = lambda k: F.struct(k.alias("sent_id"), F.concat(F.lit("s"), k.cast("string")).alias("sentence"), F.transform(F.slice("words", k * 8 + 1, 8), token).alias("tokens"))
    count = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 8).cast("int")))
    return words.select("page_id", "url", "title", F.transform(count, sentence).alias("sentences"))


def _tokens(spark, d) -> DataFrame:
    return extract.flat(_annotated(spark, d))


_S = f"(SELECT doc_id AS page_id, i::INT AS sent_id, words[i * 8 + 1 : i * 8 + 8] AS w FROM (SELECT doc_id, words, unnest(range(0, (len(words) + 7) // 8)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{W}') AS words FROM documents)))"
_NAME = "CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[2] ELSE w[1] END"
_PLACE = "CASE WHEN len(w) > 6 THEN w[6] || ' ' || w[7] ELSE w[6] END"
_IN = lambda words: ", ".join(f"'{x}'" for x in words)
_NUMBERS = r"'\A[\p{Nd} \t\n\r\f\x0B,.%-]+\z'"
_END = lambda c: f"length({c}) >= 2 AND lower({c}) NOT IN ({_IN(PRONOUNS)}) AND NOT regexp_matches({c}, {_NUMBERS})"
_VALID = f"length(text) >= 2 AND lower(text) NOT IN ({_IN(ENTITY_STOPWORDS)}) AND NOT regexp_matches(text, {_NUMBERS})"
_SVO = f"""(SELECT * FROM (SELECT page_id, sent_id, w[1] || ' ' || w[2] AS subject, lower(w[3]) AS predicate, w[4] AS object, 'ORG' AS object_label, 3 AS object_i, lower(w[3]) AS verb FROM {_S} WHERE len(w) > 3
    UNION ALL SELECT page_id, sent_id, w[1] || ' ' || w[2], lower(w[3]) || '_' || lower(w[5]), {_PLACE}, 'GPE', 5, lower(w[3]) FROM {_S} WHERE len(w) > 5) WHERE verb NOT IN ({_IN(SKIPPED_VERBS)}) AND {_END("subject")} AND {_END("object")})"""
_RELATIONS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, subject, predicate, object ORDER BY sent_id, object_i) AS n FROM {_SVO}) WHERE n = 1)"
_FOUND = f"(SELECT page_id, sent_id, 0 AS i, {_NAME} AS text, 'PERSON' AS label FROM {_S} UNION ALL SELECT page_id, sent_id, 3, w[4], 'ORG' FROM {_S} WHERE len(w) > 3 UNION ALL SELECT page_id, sent_id, 5, {_PLACE}, 'GPE' FROM {_S} WHERE len(w) > 5)"
_ENTITIES = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, text, label ORDER BY sent_id, i) AS n FROM {_FOUND} WHERE {_VALID}) WHERE n = 1)"


@query(f"SELECT page_id, subject, 'PERSON' AS subject_label, predicate, object, object_label, 's' || sent_id::VARCHAR AS sentence, sent_id FROM {_RELATIONS}")
def relations_of_tokens(spark, d):
    return extract.relations(_annotated(spark, d)).select("page_id", "subject", "subject_label", "predicate", "object", "object_label", "sentence", "sent_id")


@query(f"SELECT page_id, text, label, 's' || sent_id::VARCHAR AS sentence, sent_id, i::INT AS i FROM {_ENTITIES}")
def entities_of_tokens(spark, d):
    return extract.entities(_annotated(spark, d))


@query(f"SELECT label, count(*) AS n, count(DISTINCT span) AS spans, sum(length(span))::BIGINT AS chars FROM (SELECT label, text AS span FROM {_FOUND}) GROUP BY 1")
def span_texts(spark, d):
    whole = extract.spans(_tokens(spark, d)).where("i = first")
    return whole.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("span").alias("spans"), F.sum(F.length("span")).alias("chars"))


@query(f"SELECT label, count(*) AS n, sum(length(span))::BIGINT AS chars FROM (SELECT 'PERSON' AS label, w[2] AS span FROM {_S} WHERE len(w) > 1 UNION ALL SELECT 'GPE', w[7] FROM {_S} WHERE len(w) > 6) GROUP BY 1")
def legacy_span_texts(spark, d):
    """Spans as seen from tokens that aren't their first ones: without the first word."""
    inner = extract.spans(_tokens(spark, d), legacy=True).where("i > first")
    return inner.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("span")).alias("chars"))


_FACTS = f"""(SELECT 0 AS kind, page_id, sent_id, 1 AS i, subject, predicate, object, 'relation' AS extraction_type FROM {_RELATIONS}
    UNION ALL SELECT 1, page_id, sent_id, i, e.text, 'mentionedIn', source, 'ner' FROM {_ENTITIES} e JOIN documents ON doc_id = page_id)"""


@query(f"SELECT subject, predicate, object, extraction_type, 'u' || page_id::VARCHAR AS source_url, 's' || sent_id::VARCHAR AS sentence FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY kind, page_id, sent_id, i) AS n FROM {_FACTS}) WHERE n = 1")
def facts_of_tokens(spark, d):
    """Relations of all pages, then mentions, each fact once."""
    return extract.fact_rows(_annotated(spark, d)).select("subject", "predicate", "object", "extraction_type", "source_url", "sentence")


@query(f"SELECT (SELECT count(*) FROM {_RELATIONS}) AS relations, (SELECT count(*) FROM {_ENTITIES}) AS mentions")
def extraction_counters(spark, d):
    """The counters that a run observes, before facts are chosen."""
    seen = Observation()
    extract.count_found(_annotated(spark, d), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["relations"], seen.get["mentions"])], "relations long, mentions long")


@query(f"SELECT word, lower(word) || '_of' AS verb, word IN ({_IN(TARGET_LABELS)}) AS target, {_END('word')} AS endpoint, lower(word) NOT IN ({_IN(SKIPPED_VERBS)}) AS predicate FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{W}') || ['DATE', 'he', 'Make', '12', 'x']) AS word FROM documents)")
def token_predicates(spark, d):
    words = read(spark, d, "documents").select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(W), 0), F.array(*[F.lit(x) for x in ("DATE", "he", "Make", "12", "x")]))).alias("word")).distinct()
    return words.select("word", tx.verb_label("word", F.lit("Of")).alias("verb"), tx.is_target_label("word").alias("target"), tx.is_useful_endpoint("word").alias("endpoint"), tx.is_predicate_verb("word").alias("predicate"))


# --- answers ---


@query("SELECT '  k: ' || count(*)::VARCHAR AS answer, 2 AS repairs FROM nation")
def answer_after_repairs(spark, d):
    """A model that fails twice, by syntax and by an empty result, and is then right."""
    said = iter(("SELECT broken", "SELECT ?x WHERE { ?x skg-o:none ?y }", "```sparql\nSELECT (COUNT(?n) AS ?k) WHERE { ?n a skg-o:Nation }\n```"))
    text, _, repairs = rag.answer("How many nations?", "", mapped(spark, d, *CORE), lambda prompt: next(said))
    return spark.createDataFrame([(text, repairs)], "answer string, repairs int")


@query("SELECT unnest([" + ", ".join(f"'{q}'" for q in QUESTIONS) + "]) AS question, 'Regions.' AS baseline, string_agg('  name: ' || r_name, chr(10)) AS rag_answer, 0 AS retries FROM (SELECT r_name FROM region WHERE r_regionkey = 0)")
def preset_evaluation(spark, d):
    """The preset questions to a model that always asks for one region."""
    model = lambda prompt: "Regions." if prompt.startswith("Answer briefly") else f"SELECT ?name WHERE {{ <{R}region_0> skg-o:name ?name }} LIMIT 9"
    rows = [(r["question"], r["baseline"], r["rag_answer"], r["retries"]) for r in rag.evaluate(mapped(spark, d, "region"), model)]
    return spark.createDataFrame(rows, "question string, baseline string, rag_answer string, retries int")


@query("SELECT '| n | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey::VARCHAR || ' | ' || substring(replace(replace(n_name || '|' || chr(10), chr(10), ' '), '|', '/'), 1, 120) || ' |', chr(10) ORDER BY n_nationkey) AS report FROM nation")
def markdown_report(spark, d):
    from graphloom.sources.sinks import markdown_table

    rows = read(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", F.concat("n_name", F.lit("|\n"))).collect()
    return spark.createDataFrame([(markdown_table(["n", "name"], rows),)], "report string")


@query("SELECT unnest(['baseline on', 'no idea', '  k: ' || count(*)::VARCHAR]) AS said FROM region")
def chat_transcript(spark, d):
    """The question loop: a toggle, a question with its baseline and answer, and the end."""
    from graphloom.cli import chat

    lines, said = iter(("", "baseline", "How many regions?", "quit")), []
    model = lambda prompt: "no idea" if prompt.startswith("Answer briefly") else "SELECT (COUNT(?r) AS ?k) WHERE { ?r a skg-o:Region }"
    chat(mapped(spark, d, "region"), model, read=lambda _: next(lines), write=said.append)
    return spark.createDataFrame([(line,) for text in said[1:] for line in text.split("\n") if line in ("baseline on", "no idea") or line.startswith("  k:")], "said string")


# --- rules ---


@query("SELECT unnest(['Alan Shepard', 'Neil Armstrong', 'Pete Conrad']) AS name")
def commander_demo(spark, d):
    return spark.createDataFrame([(n,) for n in reason.demo_commanders(spark)], "name string")


@query("SELECT unnest(['Alice', 'Carol']) AS s")
def age_rule_individuals(spark, d):
    """Three people of 72, 45 and 63: two are over 60."""
    rows = [(s, "uri", TYPE, f"{O}Person", "uri", "", "") for s in ("Alice", "Bob", "Carol")] + [(s, "uri", f"{O}hasAge", str(n), "literal", "", "") for s, n in (("Alice", 72), ("Bob", 45), ("Carol", 63))]
    return reason.over_age(spark.createDataFrame(rows, TRIPLE_SCHEMA), f"{O}Person", f"{O}hasAge")


@query(f"SELECT unnest(['{O}Nation', '{O}Elder']) AS s, '{OWL}Class' AS o UNION ALL SELECT '{O}hasAge', '{OWL}ObjectProperty'")
def vocabulary_bootstrap(spark, d):
    """Declarations that are there stay as they are; absent ones are added."""
    g = mapped(spark, d, "nation").unionByName(_rules(spark, [(f"{O}Nation", TYPE, f"{OWL}Class")]))
    out = reason.ensure_vocabulary(g, (f"{O}Nation", f"{O}Elder"), (f"{O}hasAge",))
    return out.where(F.startswith("o", F.lit(OWL))).select("s", "o")


_C, _O = (f"'{R}{t}_'" for t in ("customer", "orders"))


@query(f"SELECT DISTINCT s, p, o FROM (SELECT {_O} || o_orderkey::VARCHAR AS s, unnest(['{O}placedBy', '{O}concerns', '{O}touches']) AS p, {_C} || o_custkey::VARCHAR AS o FROM orders)")
def subproperty_closure(spark, d):
    g = mapped(spark, d, "orders").where(F.col("p") == f"{O}placedBy")
    rules = _rules(spark, [(f"{O}placedBy", f"{RDFS}subPropertyOf", f"{O}concerns"), (f"{O}concerns", f"{RDFS}subPropertyOf", f"{O}touches")])
    return reason.infer(g.unionByName(rules)).where(F.startswith("s", F.lit(f"{R}orders_")))


@query(f"SELECT DISTINCT {_C} || o_custkey::VARCHAR AS s FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def min_cardinality_class(spark, d):
    """A defined class: builders that have placed something."""
    links = mapped(spark, d, "orders").where(F.col("p") == f"{O}placedBy")
    placed = links.select(F.col("o").alias("s"), F.col("s_kind"), F.lit(f"{O}placed").alias("p"), F.col("s").alias("o"), "o_kind", "o_datatype", "o_lang")
    builders = mapped(spark, d, "customer").where((F.col("p") == f"{O}segment") & (F.col("o") == "BUILDING"))
    typed = builders.select("s", "s_kind", F.lit(TYPE).alias("p"), F.lit(f"{O}Builder").alias("o"), F.lit("uri").alias("o_kind"), "o_datatype", "o_lang")
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    rules = spark.createDataFrame(
        [
            (f"{O}Client", "uri", f"{OWL}equivalentClass", "_:c", "bnode", "", ""), ("_:c", "bnode", f"{OWL}intersectionOf", "_:1", "bnode", "", ""), ("_:1", "bnode", f"{rdf}first", f"{O}Builder", "uri", "", ""),
            ("_:1", "bnode", f"{rdf}rest", "_:2", "bnode", "", ""), ("_:2", "bnode", f"{rdf}first", "_:r", "bnode", "", ""), ("_:2", "bnode", f"{rdf}rest", f"{rdf}nil", "uri", "", ""),
            ("_:r", "bnode", f"{OWL}onProperty", f"{O}placed", "uri", "", ""), ("_:r", "bnode", f"{OWL}minCardinality", "1", "literal", "", ""),
        ],
        TRIPLE_SCHEMA,
    )
    return reason.typed(reason.infer(placed.unionByName(typed).unionByName(rules)), f"{O}Client")


@query("SELECT DISTINCT x || k AS s, 'in' AS p, 'r' || n_regionkey::VARCHAR AS o FROM (SELECT unnest(['n', 'm']) AS x, n_nationkey::VARCHAR AS k, n_regionkey FROM nation) UNION SELECT DISTINCT 'r' || n_regionkey::VARCHAR, 'has', x || k FROM (SELECT unnest(['n', 'm']) AS x, n_nationkey::VARCHAR AS k, n_regionkey FROM nation)")
def same_as_both_ends(spark, d):
    """Every nation has a twin, told by a property below sameAs; facts reach twins at either end."""
    n = read(spark, d, "nation")
    k, r = F.col("n_nationkey").cast("string"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    own, twin = F.concat(F.lit("n"), k), F.concat(F.lit("m"), k)
    g = _triples(n, own, "in", r).unionByName(_triples(n, r, "has", own)).unionByName(_triples(n, own, "twin", twin))
    rules = _rules(spark, [("twin", f"{RDFS}subPropertyOf", SAME_AS)])
    return reason.infer(g.unionByName(rules), same_as=True).where("p in ('in', 'has')")


# --- query language ---

_NAT, _REG = f"'{R}nation_' || n_nationkey::VARCHAR", f"'{R}region_' || n_regionkey::VARCHAR"
_ask(
    "sparql_path_star", ("nation", "region"), "SELECT ?n ?x WHERE { ?n a skg-o:Nation . ?n skg-o:inRegion* ?x }",
    f"SELECT {_NAT} AS n, {_NAT} AS x FROM nation UNION ALL SELECT {_NAT}, {_REG} FROM nation",
)
_ask(
    "sparql_path_maybe", ("nation", "region"), "SELECT ?n ?x WHERE { ?n a skg-o:Nation . ?n skg-o:inRegion? ?x }",
    f"SELECT {_NAT} AS n, {_NAT} AS x FROM nation UNION ALL SELECT {_NAT}, {_REG} FROM nation",
)
_ask(
    "sparql_path_from_constant", CORE, f"SELECT ?x WHERE {{ ?x (skg-o:locatedIn|skg-o:inRegion)+ <{R}region_1> }}",
    f"SELECT {_NAT} AS x FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '{R}customer_' || c_custkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT '{R}supplier_' || s_suppkey::VARCHAR FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1",
)
_ask(
    "sparql_avg_sample_concat", ("part",), 'SELECT ?b (ROUND(AVG(?s)) AS ?mean) (SAMPLE(?b) AS ?one) (GROUP_CONCAT(DISTINCT ?s; SEPARATOR=",") AS ?sizes) WHERE { ?p skg-o:brand ?b ; skg-o:size ?s } GROUP BY ?b',
    "SELECT p_brand AS b, floor(avg(p_size) + 0.5)::BIGINT::VARCHAR AS mean, p_brand AS one, string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) AS sizes FROM part GROUP BY 1",
)
_ask(
    "sparql_string_functions", ("part",), "SELECT ?p ?a ?b ?c WHERE { ?p skg-o:name ?n BIND(REPLACE(?n, '[aeiou]', '-') AS ?a) BIND(STRBEFORE(?n, ' ') AS ?b) BIND(STRAFTER(?n, ' ') AS ?c) }",
    f"SELECT '{R}part_' || p_partkey::VARCHAR AS p, regexp_replace(p_name, '[aeiou]', '-', 'g') AS a, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS b, CASE WHEN contains(p_name, ' ') THEN substring(p_name, position(' ' IN p_name) + 1) ELSE '' END AS c FROM part",
)
_ask(
    "sparql_two_optionals", ("customer", "nation", "supplier"), "SELECT ?n ?x ?name WHERE { ?n a skg-o:Nation OPTIONAL { ?x skg-o:locatedIn ?n ; skg-o:segment 'BUILDING' } OPTIONAL { ?x skg-o:name ?name } }",
    f"WITH o AS (SELECT {_NAT} AS n, '{R}customer_' || c_custkey::VARCHAR AS x FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'), m AS (SELECT '{R}customer_' || c_custkey::VARCHAR AS x, c_name AS name FROM customer UNION ALL SELECT {_NAT}, n_name FROM nation UNION ALL SELECT '{R}supplier_' || s_suppkey::VARCHAR, s_name FROM supplier) SELECT n, coalesce(o.x, m.x) AS x, name FROM o LEFT JOIN m ON o.x = m.x OR o.x IS NULL",
)


@query("SELECT n_nationkey::VARCHAR AS n, (1990 + n_nationkey)::VARCHAR AS y, (n_nationkey % 12 + 1)::VARCHAR AS m, (CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END) AS english FROM nation WHERE n_nationkey % 3 <> 2")
def sparql_dates_and_languages(spark, d):
    from graphloom.plans.sparql import sparql

    n = read(spark, d, "nation")
    k = F.col("n_nationkey")
    row = lambda p, o, lang: n.select(F.concat(F.lit("u:"), k.cast("string")).alias("s"), F.lit("uri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit("").alias("o_datatype"), lang.alias("o_lang"))
    date = F.concat((1990 + k).cast("string"), F.lit("-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-05"))
    lang = F.when(k % 3 == 2, "fr").when(k % 2 == 0, "en-GB").otherwise("de")
    g = row("u:date", date, F.lit("")).unionByName(row("u:name", F.col("n_name"), lang))
    text = "SELECT (STRAFTER(STR(?s), ':') AS ?n) (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (LANGMATCHES(LANG(?l), 'en') AS ?english) WHERE { ?s x:date ?d ; x:name ?l FILTER(LANG(?l) != 'fr') }"
    return sparql(g, text, {"x": "u:"})


_ask("sparql_ask", ("nation", "region"), f"ASK {{ ?n skg-o:inRegion <{R}region_1> }}", "SELECT (count(*) > 0)::VARCHAR AS answer FROM nation WHERE n_regionkey = 1")
_ask(
    "sparql_construct", ("nation", "region"), "CONSTRUCT { ?r skg-o:holds ?n ; skg-o:label ?name } WHERE { ?n skg-o:inRegion ?r ; skg-o:name ?name }",
    f"SELECT DISTINCT *, 'uri' AS s_kind, '' AS o_datatype, '' AS o_lang FROM (SELECT {_REG} AS s, '{O}holds' AS p, {_NAT} AS o, 'uri' AS o_kind FROM nation UNION ALL SELECT {_REG}, '{O}label', n_name, 'literal' FROM nation)",
)
_ask(
    "sparql_describe", ("nation", "region", "supplier"), f"DESCRIBE ?n <{R}region_0> WHERE {{ ?n skg-o:inRegion <{R}region_1> }}",
    f"SELECT s, p, o, o_kind, 'uri' AS s_kind, '' AS o_datatype, '' AS o_lang FROM {graph_sql('nation', 'region')} WHERE s IN (SELECT {_NAT} FROM nation WHERE n_regionkey = 1) OR s = '{R}region_0'",
)
