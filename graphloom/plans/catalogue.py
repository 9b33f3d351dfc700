"""The registered queries over the library's own operators, each with its SQL.

The relational test tables stand for graphs by direct mapping (``sources.tables.map_table``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import align, extract, graph, kge, rag, reason, splits, vectors
from graphloom.plans.fixpoint import scratch, transitive_closure
from graphloom.plans.registry import add, query, read
from graphloom.plans.sparql import bindings, sparql
from graphloom.sources import rdf, sinks, tables
from graphloom.sources.tables import map_table
from graphloom.terms import CLASS_KEYWORDS, ENTITY, ONTOLOGY, OWL, PREDICATE_ALIGNMENT, RDFS, RESOURCE, SUBCLASS, TRIPLE_SCHEMA, TYPE

R, O = RESOURCE, ONTOLOGY


MAPPED = {
    "region": ("r_regionkey", {"r_name": "name"}, {}),
    "nation": ("n_nationkey", {"n_name": "name"}, {"n_regionkey": ("inRegion", "region")}),
    "customer": ("c_custkey", {"c_name": "name", "c_mktsegment": "segment"}, {"c_nationkey": ("locatedIn", "nation")}),
    "supplier": ("s_suppkey", {"s_name": "name"}, {"s_nationkey": ("locatedIn", "nation")}),
    "orders": ("o_orderkey", {"o_orderstatus": "status", "o_orderpriority": "priority"}, {"o_custkey": ("placedBy", "customer")}),
    "part": ("p_partkey", {"p_name": "name", "p_brand": "brand", "p_size": "size"}, {}),
}


def mapped(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """Each table has its own subjects and one row per key, so the union is a set already."""
    parts = [map_table(read(spark, sf_dir, t), t, *MAPPED[t]) for t in tables]
    return reduce(DataFrame.unionByName, parts)


CORE = ("region", "nation", "customer", "supplier")
W = r"[\p{L}\p{N}_]+"
_STRIP = r"regexp_replace(%s, '\A[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+\z', '', 'g')"

# --- text ---


@query(f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{W}')), 0)::BIGINT AS n_words FROM documents")
def page_word_count(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.word_count("text").alias("n_words"))


@query(f"SELECT doc_id FROM documents WHERE trim(text) <> '' AND len(regexp_extract_all(text, '{W}')) >= 500")
def page_useful_filter(spark, d):
    return read(spark, d, "documents").where(tx.is_useful_page("text")).select("doc_id")


@query(
    "SELECT doc_id, substring(regexp_replace(regexp_replace("
    + _STRIP % "text"
    + r", '[^\p{L}\p{N}_ \t\n\r\f\x0B-]', '', 'g'), '[ \t\n\r\f\x0B-]+', '_', 'g'), 1, 80) AS slug FROM documents"
)
def slugify_titles(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.slugify("text").alias("slug"))


@query("SELECT page_id, replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '_', ' ') AS title FROM pages")
def title_from_url(spark, d):
    return read(spark, d, "pages").select("page_id", tx.title_from_url("url").alias("title"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '\A | \z', '', 'g')) AS digest FROM documents")
def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.clean_text("text")).alias("digest"))


_LABELS = "SELECT DISTINCT label FROM (SELECT p_name AS label FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT 'page ' || page_id::VARCHAR || ' [' || (page_id % 3)::VARCHAR || ']' FROM pages UNION ALL SELECT (1900 + page_id % 150)::VARCHAR FROM pages UNION ALL SELECT (page_id % 28 + 1)::VARCHAR || ' July 1969' FROM pages UNION ALL SELECT 'Citation ' || page_id::VARCHAR FROM pages)"


def _labels(spark, d) -> DataFrame:
    pages = read(spark, d, "pages")
    n = F.col("page_id").cast("string")
    parts = [
        read(spark, d, "part").select("p_name"),
        read(spark, d, "nation").select("n_name"),
        read(spark, d, "orders").select("o_orderpriority"),
        pages.select(F.concat(F.lit("page "), n, F.lit(" ["), (F.col("page_id") % 3).cast("string"), F.lit("]"))),
        pages.select((1900 + F.col("page_id") % 150).cast("string")),
        pages.select(F.concat((F.col("page_id") % 28 + 1).cast("string"), F.lit(" July 1969"))),
        pages.select(F.concat(F.lit("Citation "), n)),
    ]
    return reduce(DataFrame.union, parts).toDF("label").distinct()


@query(f"SELECT label FROM ({_LABELS}) WHERE length(trim(label)) BETWEEN 3 AND 80 AND NOT regexp_matches(trim(label), '(?i)" + tx.UNCLEAN_LABEL.replace("'", "''") + "')")
def clean_label_filter(spark, d):
    return _labels(spark, d).where(tx.is_clean_label("label"))


_STOP = ", ".join(f"'{w}'" for w in tx.ENTITY_STOPWORDS)


@query(
    f"SELECT label, kind FROM ({_LABELS}) CROSS JOIN (VALUES ('DATE'), ('ORG'), ('OTHER')) k(kind) WHERE length(trim(label)) >= 2 AND lower(trim(label)) NOT IN ({_STOP}) "
    r"AND (kind = 'DATE' OR NOT regexp_matches(trim(label), '\A[\p{Nd} \t\n\r\f\x0B,.%-]+\z'))"
)
def valid_entity_filter(spark, d):
    kinds = spark.createDataFrame([("DATE",), ("ORG",), ("OTHER",)], "kind string")
    return _labels(spark, d).crossJoin(F.broadcast(kinds)).where(tx.is_valid_entity("label", "kind"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS segment FROM pages")
def last_segment(spark, d):
    return read(spark, d, "pages").select("page_id", tx.last_segment("url").alias("segment"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title_extract(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query()
def html_main_text(spark, d):
    """Reading a page's markup isn't SQL; tests hold the parser."""
    found = extract.crawl(read(spark, d, "pages"), least_words=1)
    return found.select("page_id", "title", "word_count")


GAZETTEER = (("the", "ORG"), ("of", "GPE"), ("der", "PERSON"), ("les", "LOC"), ("que", "DATE"))
_GAZ = "(VALUES " + ", ".join(f"('{w}', '{k}')" for w, k in GAZETTEER) + ") g(word, label)"
_MENTIONS = rf"(SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1)::BIGINT AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS words FROM documents))"


def _mentions(spark, d) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(W), 0)
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(words).alias("pos", "word"))
    gazetteer = spark.createDataFrame(GAZETTEER, "word string, label string")
    return rows.join(F.broadcast(gazetteer), "word").select("doc_id", "word", "label", (F.col("pos") + 1).cast("long").alias("pos"))


@query(f"SELECT doc_id, label, count(*) AS n FROM {_MENTIONS} m JOIN {_GAZ} USING (word) GROUP BY 1, 2")
def mention_gazetteer_join(spark, d):
    return _mentions(spark, d).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, word, label, min(pos) AS pos FROM {_MENTIONS} m JOIN {_GAZ} USING (word) GROUP BY 1, 2, 3")
def ner_first_dedupe(spark, d):
    return extract.first_of(_mentions(spark, d), ["doc_id", "word", "label"], ["pos"])


_FACT_ROWS = "(SELECT 0 AS kind, event_id AS i, user_id::VARCHAR AS s, event_type AS p, 'relation' AS how FROM events WHERE value > 50 UNION ALL SELECT 1, event_id, user_id::VARCHAR, event_type, 'ner' FROM events)"


@query(f"SELECT s, p, kind, i, how FROM (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY kind, i) AS n FROM {_FACT_ROWS}) WHERE n = 1")
def fact_union_dedupe(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("i"), F.col("user_id").cast("string").alias("s"), F.col("event_type").alias("p"), "value")
    rel = e.where("value > 50").select(F.lit(0).alias("kind"), "i", "s", "p", F.lit("relation").alias("how"))
    ner = e.select(F.lit(1).alias("kind"), "i", "s", "p", F.lit("ner").alias("how"))
    return extract.first_of(rel.unionByName(ner), ["s", "p"], ["kind", "i"])


@query()
def extracted_facts(spark, d):
    """Rule-based extraction over whole texts; tests hold its parts."""
    pages = read(spark, d, "documents").selectExpr("doc_id as page_id", "source as url", "cast(null as string) as title", "text")
    return extract.facts(pages)


# --- graph ---


def _facts(spark, d) -> DataFrame:
    nation = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(
        F.col("n_name").alias("subject"), F.lit("GPE").alias("subject_label"), F.lit("part of").alias("predicate"), F.col("r_name").alias("object"),
        F.when(F.col("n_nationkey") % 2 == 0, "LOC").otherwise("OTHER").alias("object_label"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("http://x.org/a").alias("source_url"),
    )


def _slug(c: str) -> str:
    return rf"substring(regexp_replace(regexp_replace(trim({c}), '[^\p{{L}}\p{{N}}_ -]', '', 'g'), '[ -]+', '_', 'g'), 1, 80)"


@query(
    f"""WITH f AS (SELECT '{R}' || {_slug("n_name")} AS s, '{R}' || {_slug("r_name")} AS o, n_name, r_name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT DISTINCT * FROM (SELECT s, '{O}part_of' AS p, o, 'uri' AS o_kind FROM f UNION ALL SELECT s, 'http://www.w3.org/2000/01/rdf-schema#label', n_name, 'literal' FROM f
    UNION ALL SELECT o, 'http://www.w3.org/2000/01/rdf-schema#label', r_name, 'literal' FROM f UNION ALL SELECT s, '{TYPE}', '{O}CelestialBody', 'uri' FROM f
    UNION ALL SELECT o, '{TYPE}', '{O}CelestialBody', 'uri' FROM f WHERE k % 2 = 0 UNION ALL SELECT s, 'http://www.w3.org/ns/prov#wasDerivedFrom', 'http://x.org/a', 'uri' FROM f WHERE k % 3 <> 0)"""
)
def triple_emission(spark, d):
    return graph.build_graph(_facts(spark, d)).select("s", "p", "o", "o_kind")


def graph_sql(*tables: str) -> str:
    """The triples of ``mapped`` in SQL."""
    parts = []
    for t in tables:
        key, columns, links = MAPPED[t]
        subject = f"'{R}{t}_' || {key}::VARCHAR"
        parts.append(f"SELECT {subject} AS s, '{TYPE}' AS p, '{O}{t.capitalize()}' AS o, 'uri' AS o_kind FROM {t}")
        parts += [f"SELECT {subject}, '{O}{p}', {c}::VARCHAR, 'literal' FROM {t} WHERE {c} IS NOT NULL" for c, p in columns.items()]
        parts += [f"SELECT {subject}, '{O}{p}', '{R}{other}_' || {c}::VARCHAR, 'uri' FROM {t} WHERE {c} IS NOT NULL" for c, (p, other) in links.items()]
    return "(" + " UNION ".join(parts) + ")"


@query(f"SELECT count(*) AS n FROM {graph_sql(*CORE)}")
def triple_count(spark, d):
    return graph.merge(mapped(spark, d, *CORE)).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n FROM (SELECT s FROM {graph_sql(*CORE)} UNION SELECT o FROM {graph_sql(*CORE)} WHERE o_kind = 'uri')")
def distinct_entities(spark, d):
    return graph.entities(mapped(spark, d, *CORE)).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(DISTINCT p) AS n FROM {graph_sql(*CORE)}")
def distinct_relations(spark, d):
    return mapped(spark, d, *CORE).agg(F.count_distinct("p").alias("n"))


_CLASS = " UNION ALL ".join(f"SELECT '{O}{t.capitalize()}' AS type, count(*) AS count FROM {t}" for t in CORE)


@query(f"SELECT type, count FROM ({_CLASS}) ORDER BY count DESC, type LIMIT 10")
def type_histogram_top10(spark, d):
    return graph.type_histogram(mapped(spark, d, *CORE))


@query(
    "SELECT predicate, sum(n)::BIGINT AS count FROM (SELECT unnest(['<" + TYPE + ">', 'skg-o:status', 'skg-o:priority', 'skg-o:placedBy']) AS predicate, count(*) AS n FROM orders "
    "UNION ALL SELECT unnest(['<" + TYPE + ">', 'skg-o:name', 'skg-o:segment', 'skg-o:locatedIn']), count(*) FROM customer UNION ALL SELECT unnest(['<" + TYPE + ">', 'skg-o:name', 'skg-o:inRegion']), count(*) FROM nation) GROUP BY 1"
)
def predicate_counts(spark, d):
    return graph.predicate_counts(mapped(spark, d, "orders", "customer", "nation"))


@query(" UNION ALL ".join(f"SELECT 'skg-o:{t.capitalize()}' AS class, count(*) AS count FROM {t}" for t in ("orders", "customer", "nation")))
def class_counts(spark, d):
    return graph.class_counts(mapped(spark, d, "orders", "customer", "nation"))


@query(f"""SELECT entity FROM (SELECT DISTINCT 'skg-r:' || {_slug("n_name")} || ' rdfs:label "' || n_name || '"' AS entity FROM nation UNION SELECT 'skg-r:' || {_slug("r_name")} || ' rdfs:label "' || r_name || '"' FROM region) ORDER BY entity LIMIT 10""")
def schema_sample(spark, d):
    return graph.sample_entities(graph.build_graph(_facts(spark, d)))


@query(f"SELECT '{R}event_' || user_id::VARCHAR AS s, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def subject_frequency(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type").distinct()
    return graph.subject_frequency(map_table(e, "event", "user_id", {"event_type": "did"}).where(F.col("p") != TYPE))


@query(
    f"""WITH g AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT c_custkey AS k, c_name AS label FROM customer WHERE c_custkey % 10 <> 0)
    SELECT '{R}customer_' || k::VARCHAR AS s, label, n FROM l JOIN g USING (k) WHERE n >= 10 ORDER BY n DESC, s LIMIT 50"""
)
def frequent_subject_topk(spark, d):
    c = read(spark, d, "customer").select(F.concat(F.lit(f"{R}customer_"), F.col("c_custkey").cast("string")).alias("s"), F.col("c_name").alias("label"), "c_custkey")
    seeded = c.where("c_custkey % 10 = 0").select(F.col("s").alias("local_uri"))
    o = map_table(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "order", "o_orderkey", {}, {"o_custkey": ("placedBy", "customer")}).where(F.col("p") != TYPE)
    turned = o.select(F.col("o").alias("s"), "s_kind", "p", F.col("s").alias("o"), "o_kind", "o_datatype", "o_lang")
    return align.frequent_candidates(turned, c.select("s", "label"), seeded)


# --- alignment and expansion ---


def _seeded(spark, d) -> DataFrame:
    nation = read(spark, d, "nation")
    labels = nation.select(F.concat(F.lit(f"{R}nation_"), F.col("n_nationkey").cast("string")).alias("s"), F.col("n_name").alias("label"))
    seeds = nation.where("n_nationkey % 4 <> 3").select(F.lower("n_name").alias("key"), F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("wd_id"), F.round(1.0 - F.col("n_nationkey") * 0.03, 2).alias("confidence"))
    return align.seed_alignment(labels, seeds)


_TIER = "CASE WHEN confidence >= 0.8 THEN 'sameAs' WHEN confidence >= 0.5 THEN 'seeAlso' ELSE 'none' END"
_SEEDED = f"(SELECT *, {_TIER} AS alignment FROM (SELECT '{R}nation_' || n_nationkey::VARCHAR AS local_uri, n_name AS label, 'Q' || n_nationkey::VARCHAR AS wd_id, n_name AS wd_label, '(seed alignment)' AS wd_description, round(1.0::DOUBLE - n_nationkey * 0.03::DOUBLE, 2) AS confidence FROM nation WHERE n_nationkey % 4 <> 3))"


@query(f"SELECT * FROM {_SEEDED}")
def seed_alignment(spark, d):
    return _seeded(spark, d)


@query(f"SELECT local_uri AS s, 'http://www.w3.org/' || CASE alignment WHEN 'sameAs' THEN '2002/07/owl#sameAs' ELSE '2000/01/rdf-schema#seeAlso' END AS p, '{ENTITY}' || wd_id AS o FROM {_SEEDED} WHERE alignment <> 'none'")
def alignment_tiers(spark, d):
    return align.alignment_triples(_seeded(spark, d)).select("s", "p", "o")


@query(f"SELECT count(*) FILTER (alignment = 'sameAs') AS n_sameas, count(*) FILTER (alignment = 'seeAlso') AS n_seealso, count(*) FILTER (alignment = 'none') AS n_none, count(*) AS n_total FROM {_SEEDED}")
def alignment_summary(spark, d):
    return align.alignment_summary(_seeded(spark, d))


_SEARCH = "(SELECT n_name AS label, (s_suppkey % 5)::INT AS rank, 'Q' || s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE s_name END AS wd_label, s_name AS description FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_CONF = "round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.95::DOUBLE - 0.1::DOUBLE * rank) + CASE WHEN lower(label) = lower(wd_label) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 2)"


def _search(spark, d) -> DataFrame:
    s = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    return s.select(F.col("n_name").alias("label"), (k % 5).cast("int").alias("rank"), F.concat(F.lit("Q"), k.cast("string")).alias("id"), F.when(k % 2 == 0, F.lower("n_name")).otherwise(F.col("s_name")).alias("wd_label"), F.col("s_name").alias("description"))


@query(f"SELECT label, id, {_CONF} AS confidence FROM {_SEARCH}")
def candidate_confidence(spark, d):
    return _search(spark, d).select("label", "id", tx.candidate_confidence("rank", "label", "wd_label").alias("confidence"))


@query(
    f"""SELECT '{R}nation_' || n_nationkey::VARCHAR AS local_uri, label, id AS wd_id, wd_label, substring(description, 1, 120) AS wd_description, confidence, {_TIER} AS alignment
    FROM (SELECT *, {_CONF} AS confidence, row_number() OVER (PARTITION BY label ORDER BY rank, id) AS n FROM {_SEARCH}) JOIN nation ON label = n_name WHERE n = 1"""
)
def best_candidate(spark, d):
    labels = read(spark, d, "nation").select(F.concat(F.lit(f"{R}nation_"), F.col("n_nationkey").cast("string")).alias("s"), F.col("n_name").alias("label"))
    return align.best_candidates(labels, _search(spark, d))


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{O}{n}', '{TYPE}', '{OWL}ObjectProperty'), ('{O}{n}', '{rel}', 'http://www.wikidata.org/prop/direct/{pid}'), ('{O}{n}', 'http://www.w3.org/2000/01/rdf-schema#comment', 'Aligned to wd:{pid}. {why.replace(chr(39), chr(39) * 2)}')"
        for n, (pid, rel, why) in PREDICATE_ALIGNMENT.items()
    )
    + ") v(s, p, o)"
)
def predicate_alignment(spark, d):
    return align.predicate_alignment(spark).select("s", "p", "o")


_PIDS = ("P17", "P361", "P18", "P999", "P31")
_NEIGHBOURS = f"(SELECT 'Q' || o_custkey::VARCHAR AS qid, ['{"', '".join(_PIDS)}'][(o_orderkey % 5 + 1)::INT] AS pid, CASE o_orderkey % 3 WHEN 0 THEN '{ENTITY}Q' || (o_orderkey % 200)::VARCHAR WHEN 1 THEN 'http://y.org/' || o_orderkey::VARCHAR ELSE o_orderpriority END AS obj, CASE o_orderkey % 3 WHEN 2 THEN 'literal' ELSE 'uri' END AS obj_type FROM orders)"
_NAMES = "(VALUES ('P17', 'country'), ('P361', 'partOf'), ('P31', 'instanceOf')) w(pid, local_name)"


def _neighbours(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    pid = F.element_at(F.array(*[F.lit(p) for p in _PIDS]), (k % 5 + 1).cast("int"))
    obj = F.when(k % 3 == 0, F.concat(F.lit(f"{ENTITY}Q"), (k % 200).cast("string"))).when(k % 3 == 1, F.concat(F.lit("http://y.org/"), k.cast("string"))).otherwise(F.col("o_orderpriority"))
    return read(spark, d, "orders").select(F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("qid"), pid.alias("pid"), obj.alias("obj"), F.when(k % 3 == 2, "literal").otherwise("uri").alias("obj_type"))


def _aligned(spark, d) -> DataFrame:
    """Customers, two to an entity."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(F.concat(F.lit(f"{R}customer_"), k.cast("string")).alias("s"), F.concat(F.lit("Q"), F.floor(k / 2).cast("string")).alias("qid"))


_ALIGNED = f"(SELECT '{R}customer_' || c_custkey::VARCHAR AS s, 'Q' || (c_custkey // 2)::VARCHAR AS qid FROM customer)"


def _expanded(neighbours: str) -> str:
    return f"""SELECT DISTINCT a.s, '{O}' || w.local_name AS p,
      CASE WHEN n.obj_type = 'uri' AND n.obj LIKE '%wikidata.org/entity/Q%' THEN coalesce(l.s, '{ENTITY}' || regexp_extract(n.obj, '([^/]*)$', 1)) ELSE n.obj END AS o, CASE WHEN n.obj_type = 'literal' THEN 'literal' ELSE 'uri' END AS o_kind
      FROM {_ALIGNED} a JOIN {neighbours} n USING (qid) JOIN {_NAMES} ON w.pid = n.pid
      LEFT JOIN (SELECT qid, max(s) AS s FROM {_ALIGNED} GROUP BY 1) l ON l.qid = regexp_extract(n.obj, '([^/]*)$', 1) AND n.obj_type = 'uri' AND n.obj LIKE '%wikidata.org/entity/Q%'"""


@query(f"SELECT w.local_name AS name, count(*) AS n FROM {_NEIGHBOURS} n JOIN {_NAMES} ON w.pid = n.pid GROUP BY 1")
def expand_whitelist(spark, d):
    return _neighbours(spark, d).join(F.broadcast(align.kept_predicates(spark)), "pid").groupBy(F.col("local_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(_expanded(_NEIGHBOURS))
def expand_object_resolve(spark, d):
    return align.expansion(_aligned(spark, d), _neighbours(spark, d), per_entity=None).select("s", "p", "o", "o_kind")


@query(_expanded(f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pid, obj, obj_type) AS i FROM {_NEIGHBOURS}) WHERE i <= 5)"))
def expand_per_entity_limit(spark, d):
    return align.expansion(_aligned(spark, d), _neighbours(spark, d), per_entity=5).select("s", "p", "o", "o_kind")


@query(f"SELECT count(*) AS n FROM ({_expanded(_NEIGHBOURS)} UNION SELECT '{R}nation_' || n_nationkey::VARCHAR, '{O}name', n_name, 'literal' FROM nation)")
def expanded_union(spark, d):
    names = mapped(spark, d, "nation").where(F.col("p") == f"{O}name")
    links = _aligned(spark, d).select(F.col("s"), F.lit("uri").alias("s_kind"), F.lit(f"{OWL}sameAs").alias("p"), F.concat(F.lit(ENTITY), "qid").alias("o"), F.lit("uri").alias("o_kind"), F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"))
    return align.expand_graph(names, links, _neighbours(spark, d), per_entity=None).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT * FROM {graph_sql(*CORE)}")
def ntriples_round_trip(spark, d):
    path = scratch(spark, "graph.nt")
    sinks.write_ntriples(mapped(spark, d, *CORE), path)
    return rdf.read_graph(spark, path).select("s", "p", "o", "o_kind")


# --- SPARQL ---


def _ask(name: str, tables: tuple[str, ...], text: str, sql: str) -> None:
    def run(spark, d):
        return sparql(mapped(spark, d, *tables), text)

    add(name, run, sql)


_C, _N, _RG, _S, _OR = (f"'{R}{t}_'" for t in ("customer", "nation", "region", "supplier", "orders"))
_cust, _nat, _reg, _sup, _ord = f"{_C} || c_custkey::VARCHAR", f"{_N} || n_nationkey::VARCHAR", f"{_RG} || r_regionkey::VARCHAR", f"{_S} || s_suppkey::VARCHAR", f"{_OR} || o_orderkey::VARCHAR"

_ask("sparql_single_pattern", ("nation",), "SELECT ?n ?name WHERE { ?n skg-o:name ?name }", f"SELECT {_nat} AS n, n_name AS name FROM nation")
_ask("sparql_filter_contains", ("nation",), 'SELECT ?n ?name WHERE { ?n skg-o:name ?name . FILTER(CONTAINS(LCASE(STR(?name)), "1")) }', f"SELECT {_nat} AS n, n_name AS name FROM nation WHERE contains(lower(n_name), '1')")
_ask(
    "sparql_star_bgp", ("customer",), "SELECT ?name ?seg ?n WHERE { ?c a skg-o:Customer ; skg-o:name ?name ; skg-o:segment ?seg ; skg-o:locatedIn ?n }",
    f"SELECT c_name AS name, c_mktsegment AS seg, {_N} || c_nationkey::VARCHAR AS n FROM customer",
)
_ask(
    "sparql_chain_bgp", ("customer", "orders"), "SELECT ?seg (COUNT(?o) AS ?n) WHERE { ?o skg-o:placedBy ?c . ?c skg-o:segment ?seg } GROUP BY ?seg ORDER BY DESC(?n)",
    "SELECT c_mktsegment AS seg, count(*)::VARCHAR AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
_ask(
    "sparql_optional", ("nation", "customer"), 'SELECT ?n ?c WHERE { ?n a skg-o:Nation OPTIONAL { ?c skg-o:locatedIn ?n ; skg-o:segment ?s FILTER(?s = "MACHINERY") } }',
    f"SELECT {_nat} AS n, {_cust} AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY'",
)
_ask(
    "sparql_union", ("nation", "region"), "SELECT ?x ?name WHERE { { ?x a skg-o:Nation ; skg-o:name ?name } UNION { ?x a skg-o:Region ; skg-o:name ?name } }",
    f"SELECT {_nat} AS x, n_name AS name FROM nation UNION ALL SELECT {_reg}, r_name FROM region",
)
_ask(
    "sparql_minus", ("customer", "orders"), 'SELECT ?c WHERE { ?c a skg-o:Customer MINUS { ?o skg-o:placedBy ?c ; skg-o:status "P" } }',
    f"SELECT {_cust} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
_ask(
    "sparql_exists", ("customer", "orders"), 'SELECT ?c WHERE { ?c a skg-o:Customer FILTER EXISTS { ?o skg-o:placedBy ?c ; skg-o:status "F" } FILTER NOT EXISTS { ?o skg-o:placedBy ?c ; skg-o:status "P" } }',
    f"SELECT {_cust} AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
_ask("sparql_group_count", CORE, "SELECT ?type (COUNT(?s) AS ?count) WHERE { ?s a ?type } GROUP BY ?type ORDER BY DESC(?count)", f"SELECT type, count::VARCHAR AS count FROM ({_CLASS})")
_ask(
    "sparql_having", ("customer",), "SELECT ?n (COUNT(DISTINCT ?c) AS ?k) WHERE { ?c skg-o:locatedIn ?n } GROUP BY ?n HAVING (COUNT(DISTINCT ?c) > 5)",
    f"SELECT {_N} || c_nationkey::VARCHAR AS n, count(*)::VARCHAR AS k FROM customer GROUP BY 1 HAVING count(*) > 5",
)
_ask(
    "sparql_order_limit", ("part",), "SELECT ?p ?size WHERE { ?p skg-o:size ?size } ORDER BY DESC(?size) ?p LIMIT 20 OFFSET 5",
    f"SELECT p, size FROM (SELECT '{R}part_' || p_partkey::VARCHAR AS p, p_size::VARCHAR AS size, p_size FROM part) ORDER BY p_size DESC, p LIMIT 20 OFFSET 5",
)
_ask("sparql_distinct", ("customer",), "SELECT DISTINCT ?seg WHERE { ?c skg-o:segment ?seg }", "SELECT DISTINCT c_mktsegment AS seg FROM customer")
_ask(
    "sparql_strstarts", ("customer",), f'SELECT ?p (COUNT(*) AS ?n) WHERE {{ ?s ?p ?o FILTER(STRSTARTS(STR(?p), "{O}")) }} GROUP BY ?p',
    f"SELECT '{O}' || unnest(['name', 'segment', 'locatedIn']) AS p, count(*)::VARCHAR AS n FROM customer",
)
_ask(
    "sparql_lang_filter", ("nation",), 'SELECT ?s ?o WHERE { ?s ?p ?o FILTER(!isLiteral(?o) || lang(?o) = "en" || lang(?o) = "") FILTER(?p != rdf:type) }',
    f"SELECT {_nat} AS s, n_name AS o FROM nation UNION ALL SELECT {_nat}, {_RG} || n_regionkey::VARCHAR FROM nation",
)
_ask(
    "sparql_path_plus", CORE, "SELECT ?c ?x WHERE { ?c a skg-o:Supplier . ?c (skg-o:locatedIn|skg-o:inRegion)+ ?x }",
    f"SELECT {_sup} AS c, {_N} || s_nationkey::VARCHAR AS x FROM supplier UNION ALL SELECT {_sup}, {_RG} || n_regionkey::VARCHAR FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
_ask(
    "sparql_path_sequence", ("nation", "region", "supplier"), "SELECT ?c ?r WHERE { ?c skg-o:locatedIn/skg-o:inRegion/skg-o:name ?r }",
    "SELECT " + _sup + " AS c, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
_ask(
    "sparql_values_bind", ("customer",), 'SELECT ?c ?label WHERE { VALUES ?seg { "BUILDING" "MACHINERY" } ?c skg-o:segment ?seg BIND(CONCAT(UCASE(SUBSTR(?seg, 1, 2)), "-", STR(STRLEN(?seg) + 1)) AS ?label) }',
    f"SELECT {_cust} AS c, upper(substr(c_mktsegment, 1, 2)) || '-' || (length(c_mktsegment) + 1)::DOUBLE::VARCHAR AS label FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
_ask(
    "sparql_subselect", ("customer", "orders"), "SELECT ?name ?k WHERE { ?c skg-o:name ?name { SELECT ?c (COUNT(?o) AS ?k) WHERE { ?o skg-o:placedBy ?c } GROUP BY ?c ORDER BY DESC(?k) ?c LIMIT 10 } }",
    f"SELECT c_name AS name, k::VARCHAR AS k FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1 ORDER BY k DESC, '{R}customer_' || o_custkey::VARCHAR LIMIT 10) JOIN customer ON o_custkey = c_custkey",
)
_ask(
    "sparql_numeric_filter", ("part",), "SELECT ?p WHERE { ?p skg-o:size ?s FILTER(?s * 2 >= 60 && ?s IN (30, 35, 40) || ?s < 3) }",
    f"SELECT '{R}part_' || p_partkey::VARCHAR AS p FROM part WHERE (p_size * 2 >= 60 AND p_size IN (30, 35, 40)) OR p_size < 3",
)
_ask(
    "sparql_regex_coalesce", ("nation", "customer"), 'SELECT ?n ?s WHERE { ?n a skg-o:Nation ; skg-o:name ?name FILTER(REGEX(?name, "[0-4]$", "i")) OPTIONAL { ?n skg-o:segment ?x } BIND(COALESCE(?x, IF(STRENDS(?name, "4"), "four", "other")) AS ?s) }',
    f"SELECT {_nat} AS n, CASE WHEN n_name LIKE '%4' THEN 'four' ELSE 'other' END AS s FROM nation WHERE regexp_matches(n_name, '[0-4]$')",
)
_ask(
    "sparql_aggregates", ("part",), "SELECT ?b (SUM(?s) AS ?total) (MIN(?s) AS ?low) (MAX(?s) AS ?high) WHERE { ?p skg-o:brand ?b ; skg-o:size ?s } GROUP BY ?b",
    "SELECT p_brand AS b, sum(p_size)::BIGINT::VARCHAR AS total, min(p_size)::VARCHAR AS low, max(p_size)::VARCHAR AS high FROM part GROUP BY 1",
)
_ask(
    "sparql_inverse_path", ("nation", "region"), "SELECT ?r ?n WHERE { ?r a skg-o:Region . ?r ^skg-o:inRegion ?n }",
    f"SELECT {_RG} || n_regionkey::VARCHAR AS r, {_nat} AS n FROM nation",
)

# --- reasoning ---


def _triples(df: DataFrame, s, p, o) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(lit(s).alias("s"), F.lit("uri").alias("s_kind"), lit(p).alias("p"), lit(o).alias("o"), F.lit("uri").alias("o_kind"), F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"))


def _rules(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(s, "uri", p, o, "uri", "", "") for s, p, o in rows], TRIPLE_SCHEMA)


@query(f"SELECT '{R}part_' || p_partkey::VARCHAR AS s FROM part WHERE p_size > 40")
def rule_threshold_class(spark, d):
    return reason.over_age(mapped(spark, d, "part"), f"{O}Part", f"{O}size", 40)


@query(f"SELECT DISTINCT {_C} || o_custkey::VARCHAR AS s FROM orders JOIN customer ON c_custkey = o_custkey")
def rule_two_atom_class(spark, d):
    g = mapped(spark, d, "customer", "orders")
    placed = g.where(F.col("p") == f"{O}placedBy").select(F.col("o").alias("s"), "s_kind", F.lit(f"{O}placed").alias("p"), F.col("s").alias("o"), "o_kind", "o_datatype", "o_lang")
    return reason.commanders(g.unionByName(placed), f"{O}Customer", f"{O}placed")


#: A class tree over the part types: each kind below its family, families below one root.
@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT p_type AS a, split_part(p_type, ' ', 1) AS b FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1), 'Thing' FROM part), "
    "c AS (SELECT a, b FROM e WHERE a <> b UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a WHERE e.a <> e.b) SELECT a, b FROM c"
)
def subclass_closure(spark, d):
    kinds = read(spark, d, "part").select("p_type").distinct()
    family = F.substring_index("p_type", " ", 1)
    up = _triples(kinds.where(F.col("p_type") != family), F.col("p_type"), SUBCLASS, family).unionByName(_triples(kinds, family, SUBCLASS, "Thing"))
    return reason.subclass_closure(up.distinct())


_NEAR = "(SELECT DISTINCT 'n' || s_nationkey::VARCHAR AS a, 'n' || ((s_nationkey * 7 + s_suppkey) % 25)::VARCHAR AS b FROM supplier)"


def _near(spark, d) -> DataFrame:
    s = read(spark, d, "supplier")
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    return s.select(n(F.col("s_nationkey")).alias("a"), n((F.col("s_nationkey") * 7 + F.col("s_suppkey")) % 25).alias("b")).distinct()


@query(f"SELECT DISTINCT s, p, o FROM (SELECT a AS s, 'near' AS p, b AS o FROM {_NEAR} UNION ALL SELECT b, 'near', a FROM {_NEAR} UNION ALL SELECT a, 'by', b FROM {_NEAR} UNION ALL SELECT b, 'by', a FROM {_NEAR})")
def inverse_symmetric(spark, d):
    rows = _near(spark, d)
    g = _triples(rows, F.col("a"), "near", F.col("b")).unionByName(_rules(spark, [("near", TYPE, f"{OWL}SymmetricProperty"), ("near", f"{OWL}inverseOf", "by")]))
    return reason.infer(g).where("p in ('near', 'by')")


@query(f"WITH RECURSIVE c AS (SELECT a, b FROM {_NEAR} UNION SELECT c.a, e.b FROM c JOIN {_NEAR} e ON c.b = e.a) SELECT a, b FROM c")
def transitive_closure_pairs(spark, d):
    return transitive_closure(_near(spark, d))


@query("SELECT DISTINCT x AS s, cls AS o FROM (SELECT " + _ord + f" AS x, '{O}Order' AS cls FROM orders UNION ALL SELECT {_C} || o_custkey::VARCHAR, '{O}Buyer' FROM orders UNION ALL SELECT {_C} || o_custkey::VARCHAR, '{O}Party' FROM orders)")
def domain_range_typing(spark, d):
    g = mapped(spark, d, "orders").where(F.col("p") == f"{O}placedBy")
    rules = _rules(spark, [(f"{O}placedBy", f"{RDFS}domain", f"{O}Order"), (f"{O}placedBy", f"{RDFS}range", f"{O}Buyer"), (f"{O}Buyer", SUBCLASS, f"{O}Party")])
    return reason.infer(g.unionByName(rules)).where((F.col("p") == TYPE) & F.startswith("o", F.lit(O))).select("s", "o")


@query(f"SELECT DISTINCT {_C} || o_custkey::VARCHAR AS s FROM orders WHERE o_orderstatus = 'F'")
def some_values_from(spark, d):
    o = read(spark, d, "orders")
    order = F.concat(F.lit(f"{R}orders_"), F.col("o_orderkey").cast("string"))
    g = _triples(o, F.concat(F.lit(f"{R}customer_"), F.col("o_custkey").cast("string")), f"{O}placed", order).unionByName(_triples(o.where("o_orderstatus = 'F'"), order, TYPE, f"{O}Done"))
    rules = spark.createDataFrame(
        [(f"{O}Served", "uri", f"{OWL}equivalentClass", "_:r", "bnode", "", ""), ("_:r", "bnode", f"{OWL}onProperty", f"{O}placed", "uri", "", ""), ("_:r", "bnode", f"{OWL}someValuesFrom", f"{O}Done", "uri", "", "")],
        TRIPLE_SCHEMA,
    )
    return reason.typed(reason.infer(g.unionByName(rules)), f"{O}Served")


@query(f"SELECT {_cust} AS s, '{O}Local' AS a, '{O}Machinist' AS b FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey < 5")
def disjoint_check(spark, d):
    c = read(spark, d, "customer")
    s = F.concat(F.lit(f"{R}customer_"), F.col("c_custkey").cast("string"))
    g = _triples(c.where("c_mktsegment = 'MACHINERY'"), s, TYPE, f"{O}Machinist").unionByName(_triples(c.where("c_nationkey < 5"), s, TYPE, f"{O}Local"))
    return reason.disjoint_violations(g.unionByName(_rules(spark, [(f"{O}Machinist", f"{OWL}disjointWith", f"{O}Local")])))


@query("SELECT 'u' || user_id::VARCHAR AS s, 'did' AS p, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def functional_check(spark, d):
    e = read(spark, d, "events")
    g = _triples(e, F.concat(F.lit("u"), F.col("user_id").cast("string")), "did", F.col("event_type"))
    return reason.functional_violations(g.unionByName(_rules(spark, [("did", TYPE, f"{OWL}FunctionalProperty")])))


# --- splits and vectors ---

_TRIPLES = f"(SELECT {_ord} AS s, 'p' || o_orderpriority AS p, {_C} || o_custkey::VARCHAR AS o FROM orders)"
_KEY = "md5(s || chr(9) || p || chr(9) || o || chr(9) || '42')"
_SPLIT = f"(SELECT s, p, o, CASE WHEN n <= floor(t * 0.8) THEN 'train' WHEN n <= floor(t * 0.8) + floor(t * 0.1) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY {_KEY}) AS n, count(*) OVER () AS t FROM {_TRIPLES}))"


def _order_triples(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.concat(F.lit(f"{R}orders_"), F.col("o_orderkey").cast("string")).alias("s"), F.concat(F.lit("p"), "o_orderpriority").alias("p"), F.concat(F.lit(f"{R}customer_"), F.col("o_custkey").cast("string")).alias("o"))


@query(f"SELECT * FROM {_SPLIT}")
def split_assign(spark, d):
    return splits.assign(_order_triples(spark, d))


@query(f"SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 4) AS share FROM {_SPLIT} GROUP BY 1")
def split_sizes(spark, d):
    return splits.sizes(splits.assign(_order_triples(spark, d)))


#: Users by the hours and the kinds of their events: a graph that grows with the events.
_SOCIAL = "(SELECT DISTINCT 'u' || user_id::VARCHAR AS s, event_type AS p, 'h' || (user_id % 7)::VARCHAR || '_' || strftime(ts, '%Y-%m-%d %H') AS o FROM events)"
_SOCIAL_SPLIT = _SPLIT.replace(_TRIPLES, _SOCIAL)
_ENDS = lambda t: f"(SELECT s AS e FROM {t} UNION SELECT o FROM {t})"


def _social(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    hour = F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string"), F.lit("_"), F.date_format("ts", "yyyy-MM-dd HH"))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("s"), F.col("event_type").alias("p"), hour.alias("o")).distinct()


_RESCUED = f"""WITH sp AS {_SOCIAL_SPLIT}, tr AS (SELECT s, p, o FROM sp WHERE split = 'train'), v AS (SELECT s, p, o, s IN (SELECT e FROM {_ENDS("tr")}) AND o IN (SELECT e FROM {_ENDS("tr")}) AND p IN (SELECT p FROM tr) AS ok FROM sp WHERE split = 'valid'),
    t2 AS (SELECT * FROM tr UNION ALL SELECT s, p, o FROM v WHERE NOT ok), te AS (SELECT s, p, o, s IN (SELECT e FROM {_ENDS("t2")}) AND o IN (SELECT e FROM {_ENDS("t2")}) AND p IN (SELECT p FROM t2) AS ok FROM sp WHERE split = 'test')
    SELECT s, p, o, 'train' AS split FROM t2 UNION ALL SELECT s, p, o, 'train' FROM te WHERE NOT ok UNION ALL SELECT s, p, o, 'valid' FROM v WHERE ok UNION ALL SELECT s, p, o, 'test' FROM te WHERE ok"""


@query(_RESCUED)
def coverage_rescue(spark, d):
    return splits.enforce_coverage(splits.assign(_social(spark, d)))


_HELD = "(SELECT s AS entity FROM %s WHERE split <> 'train' UNION SELECT o FROM %s WHERE split <> 'train') EXCEPT (SELECT s FROM %s WHERE split = 'train' UNION SELECT o FROM %s WHERE split = 'train')"


@query(f"WITH raw AS {_SOCIAL_SPLIT}, kept AS ({_RESCUED}) SELECT (SELECT count(*) FROM ({_HELD.replace('%s', 'raw')})) AS before, (SELECT count(*) FROM ({_HELD.replace('%s', 'kept')})) AS after")
def orphan_check(spark, d):
    """Orphans of the plain split and of the one with coverage (none)."""
    given = splits.assign(_social(spark, d))
    n = lambda split, name: splits.orphans(split).agg(F.count(F.lit(1)).alias(name))
    return n(given, "before").crossJoin(F.broadcast(n(splits.enforce_coverage(given), "after")))


@query(f"SELECT s, p, o FROM {_TRIPLES} ORDER BY {_KEY} LIMIT 100")
def sample_exact_n(spark, d):
    return splits.sample(_order_triples(spark, d), 100)


def _knn_sql(queries_: str) -> str:
    return f"""SELECT query, neighbour, rank, round(similarity, 6) AS similarity FROM (SELECT q.vec_id AS query, v.vec_id AS neighbour, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id)::INT AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE {queries_}) WHERE rank <= 5"""


@query(_knn_sql("q.vec_id % 50 = 0"))
def knn_cosine(spark, d):
    v = read(spark, d, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 50 = 0"), 5, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query(_knn_sql("q.vec_id IN (1, 10, 100)"))
def spotlight_knn(spark, d):
    v = read(spark, d, "embeddings")
    names = v.select(F.col("vec_id").alias("id"), F.concat(F.lit(f"{R}v"), F.col("vec_id").cast("string"), F.lit("_")).alias("label"))
    wanted = vectors.resolve_spotlight(names, [f"{R}V1_", f"{R}v10_", f"{R}v100_"]).select(F.col("id").alias("vec_id"))
    return vectors.nearest(v, wanted, 5, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


_TRIPLE = "FROM embeddings h JOIN embeddings r ON r.vec_id = h.label JOIN embeddings t ON t.vec_id = h.vec_id // 2"


def _vector_triples(spark, d) -> DataFrame:
    v = read(spark, d, "embeddings")
    h = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("h"), F.col("label").cast("long").alias("r_id"), F.floor(F.col("vec_id") / 2).alias("t_id"))
    r, t = v.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("r")), v.select(F.col("vec_id").alias("t_id"), F.col("embedding").alias("t"))
    return h.join(r, "r_id").join(t, "t_id")


@query(f"SELECT h.vec_id AS id, round(-list_sum([abs(h.embedding[i]::DOUBLE + r.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) FOR i IN range(1, 65)]), 5) AS score {_TRIPLE}")
def transe_score(spark, d):
    return _vector_triples(spark, d).select("id", F.round(vectors.transe_score("h", "r", "t"), 5).alias("score"))


_X = lambda a, b, c: f"list_sum([h.embedding[i + {a}]::DOUBLE * r.embedding[i + {b}]::DOUBLE * t.embedding[i + {c}]::DOUBLE FOR i IN range(1, 33)])"


@query(f"SELECT h.vec_id AS id, round({_X(0, 0, 0)} + {_X(0, 32, 32)} + {_X(32, 0, 32)} - {_X(32, 32, 0)}, 5) AS score {_TRIPLE}")
def complex_score(spark, d):
    return _vector_triples(spark, d).select("id", F.round(vectors.complex_score("h", "r", "t"), 5).alias("score"))


@query(f"SELECT h.vec_id AS id, round(list_sum([h.embedding[i]::DOUBLE * r.embedding[i]::DOUBLE * t.embedding[i]::DOUBLE FOR i IN range(1, 65)]), 5) AS score {_TRIPLE}")
def distmult_score(spark, d):
    return _vector_triples(spark, d).select("id", F.round(vectors.distmult_score("h", "r", "t"), 5).alias("score"))


#: Customers of an order's nation as candidates for its customer, scored by name length and key.
_SCORES = "(SELECT s_suppkey AS q, CASE WHEN s_suppkey % 2 = 0 THEN 'head' ELSE 'tail' END AS side, n_nationkey AS c, (n_nationkey * 7 + s_suppkey) % 11 AS score, n_nationkey = s_nationkey AS is_true FROM supplier CROSS JOIN nation)"
_RANKED = f"(SELECT q, side, (1 + count(*) FILTER (score > x) + count(*) FILTER (score = x AND NOT is_true) / 2.0)::DOUBLE AS rank FROM (SELECT *, max(CASE WHEN is_true THEN score END) OVER (PARTITION BY q) AS x FROM %s) GROUP BY 1, 2)"
_METRICS = "SELECT coalesce(side, 'both') AS side, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT::DOUBLE), 6) AS hits_at_1, round(avg((rank <= 3)::INT::DOUBLE), 6) AS hits_at_3, round(avg((rank <= 10)::INT::DOUBLE), 6) AS hits_at_10, count(*) AS n FROM %s GROUP BY GROUPING SETS ((side), ())"


def _scores(spark, d) -> DataFrame:
    nations = F.broadcast(read(spark, d, "nation").select("n_nationkey"))
    s = read(spark, d, "supplier").crossJoin(nations)
    return s.select(F.col("s_suppkey").alias("q"), F.when(F.col("s_suppkey") % 2 == 0, "head").otherwise("tail").alias("side"), F.col("n_nationkey").alias("c"), ((F.col("n_nationkey") * 7 + F.col("s_suppkey")) % 11).alias("score"), (F.col("n_nationkey") == F.col("s_nationkey")).alias("is_true"))


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select("side", *[F.round(c, 6).alias(c) for c in ("mrr", "hits_at_1", "hits_at_3", "hits_at_10")], "n")


@query(_METRICS % (_RANKED % _SCORES))
def rank_metrics(spark, d):
    return _rounded(vectors.rank_metrics(vectors.ranks(_scores(spark, d), ["q", "side"])))


@query(_METRICS % (_RANKED % f"(SELECT * FROM {_SCORES} s WHERE is_true OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s.q AND c_nationkey = s.c))"))
def filtered_rank(spark, d):
    known = read(spark, d, "customer").select(F.col("c_custkey").alias("q"), F.col("c_nationkey").alias("c"))
    return _rounded(vectors.rank_metrics(vectors.ranks(vectors.filtered(_scores(spark, d), known, ("q", "c")), ["q", "side"])))


_CASES = " ".join(f"WHEN {' OR '.join(f'''contains(lower(u), '{w.lower()}')''' for w in words)} THEN '{name}'" for name, words in CLASS_KEYWORDS.items())


@query(f"SELECT page_id, CASE {_CASES} ELSE 'Other' END AS class FROM (SELECT page_id, url || '/' || ['Apollo_11', 'mars_rover', 'Hubble', 'x', 'Dragon', 'NASA_hq', 'ISS', 'Neil_Armstrong'][(page_id % 8 + 1)::INT] AS u FROM pages)")
def keyword_class(spark, d):
    names = F.array(*[F.lit(x) for x in ("Apollo_11", "mars_rover", "Hubble", "x", "Dragon", "NASA_hq", "ISS", "Neil_Armstrong")])
    u = F.concat("url", F.lit("/"), F.element_at(names, (F.col("page_id") % 8 + 1).cast("int")))
    return read(spark, d, "pages").select("page_id", tx.keyword_class(u).alias("class"))


# --- answers ---



@query(
    f"""SELECT conv_id, turn, 'PREFIX skg-o: <{O}>' || chr(10) || 'PREFIX skg-r: <{R}>' || chr(10) ||
    CASE conv_id % 3 WHEN 0 THEN 'SELECT ?x WHERE {{ ?x a ?t }}' WHEN 1 THEN 'select ?y where {{ ?y ?p "' || turn::VARCHAR || '" }}' ELSE 'Sure.' || chr(10) || 'nothing here' END AS query FROM conversations"""
)
def extract_sparql_text(spark, d):
    k, turn = F.col("conv_id") % 3, F.col("turn").cast("string")
    body = F.when(k == 0, "```sparql\nSELECT ?x WHERE { ?x a ?t } LIMIT 5\n```").when(k == 1, F.concat(F.lit('select ?y where { ?y ?p "'), turn, F.lit('" } trailing'))).otherwise("nothing here")
    return read(spark, d, "conversations").select("conv_id", "turn", tx.extract_sparql(F.concat(F.lit("Sure.\n"), body)).alias("query"))


@query(
    "SELECT string_agg('  name: ' || p_name || ' | size: ' || p_size::VARCHAR, chr(10) ORDER BY p_size DESC, p) FILTER (i <= 10) || chr(10) || '  … and ' || (count(*) - 10)::VARCHAR || ' more results' AS answer "
    f"FROM (SELECT *, '{R}part_' || p_partkey::VARCHAR AS p, row_number() OVER (ORDER BY p_size DESC, '{R}part_' || p_partkey::VARCHAR) AS i FROM part)"
)
def format_results_text(spark, d):
    found = sparql(mapped(spark, d, "part"), "SELECT ?name ?size WHERE { ?p skg-o:name ?name ; skg-o:size ?size } ORDER BY DESC(?size) ?p")
    return spark.createDataFrame([(rag.format_results(bindings(found, 11), total=found.count()),)], "answer string")


@query("SELECT conv_id, turn, substring(replace(replace(text, chr(10), ' '), '|', '/'), 1, 120) AS cell FROM conversations")
def report_cell(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.report_cell("text").alias("cell"))
