"""Registered queries over files: what the writers write, the readers read back; provider responses; models.

Files are written to a scratch folder of the shared one and read from there."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import align, graph, kge, splits
from graphloom.plans.catalogue import CORE, _order_triples, _SPLIT, graph_sql, mapped
from graphloom.plans.fixpoint import scratch
from graphloom.plans.registry import query, read
from graphloom.sources import rdf, remote, sinks, tables
from graphloom.terms import ENTITY, ONTOLOGY, OWL, RESOURCE, TYPE

R, O = RESOURCE, ONTOLOGY


@query("SELECT url FROM pages UNION ALL SELECT 'x' || page_id::VARCHAR FROM pages")
def seed_lines(spark, d):
    """A seed file: a URL, a blank line, a comment and a padded line for each page."""
    path = scratch(spark, "seeds")
    n = F.col("page_id").cast("string")
    lines = read(spark, d, "pages").select(F.explode(F.array("url", F.lit(""), F.lit("   "), F.concat(F.lit("# "), n), F.concat(F.lit("  x"), n, F.lit(" ")))).alias("value"))
    lines.write.text(path)
    return tables.read_seeds(spark, path)


@query("SELECT 'http://d/' || doc_id::VARCHAR AS url, CASE WHEN doc_id % 3 = 0 THEN 'http://d/' || doc_id::VARCHAR ELSE source END AS title, md5(text) AS digest, n_chars AS word_count FROM documents")
def jsonl_round_trip(spark, d):
    path = scratch(spark, "pages")
    docs = read(spark, d, "documents")
    title = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    sinks.write_pages(docs.select(F.concat(F.lit("http://d/"), F.col("doc_id").cast("string")).alias("url"), title.alias("title"), "text", F.col("n_chars").alias("word_count"), F.lit("2024-01-01T00:00:00+00:00").alias("crawled_at")), path)
    return tables.read_pages(spark, path).select("url", "title", F.md5("text").alias("digest"), "word_count")


@query("SELECT doc_id::VARCHAR AS subject, CASE doc_id % 3 WHEN 0 THEN 'NA' WHEN 1 THEN '' ELSE 'say \"x\", y' END AS object, md5(coalesce(text, '')) AS digest, lang AS subject_label FROM documents")
def csv_facts_round_trip(spark, d):
    """Facts whose values hold quotes, separators, line ends, NA and nothing."""
    path = scratch(spark, "facts")
    k = F.col("doc_id") % 3
    odd = F.when(k == 0, "NA").when(k == 1, "").otherwise('say "x", y')
    facts = read(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("subject"), F.col("lang").alias("subject_label"), F.lit("p").alias("predicate"), odd.alias("object"), F.lit("").alias("object_label"), F.col("source").alias("source_url"), F.col("text").alias("sentence"), F.lit("ner").alias("extraction_type"),
    )
    sinks.write_csv(facts, path)
    return tables.read_facts(spark, path).select("subject", "object", F.md5("sentence").alias("digest"), "subject_label")


@query(f"SELECT * FROM {graph_sql('region', 'nation', 'supplier')}")
def turtle_round_trip(spark, d):
    path = scratch(spark, "graph.ttl")
    sinks.write_turtle(mapped(spark, d, "region", "nation", "supplier"), path)
    return rdf.read_graph(spark, path).select("s", "p", "o", "o_kind")


@query(f"SELECT * FROM {graph_sql('nation', 'region')} UNION SELECT * FROM {graph_sql('nation', 'supplier')}")
def append_to_graph(spark, d):
    """A graph file and what is appended to it: a set."""
    path = scratch(spark, "graph.ttl")
    sinks.append_graph(spark, path, mapped(spark, d, "nation", "region"))
    sinks.append_graph(spark, path, mapped(spark, d, "nation", "supplier"))
    return rdf.read_graph(spark, path).select("s", "p", "o", "o_kind")


@query("SELECT 'http://x/#n' || n_nationkey::VARCHAR AS s, 'http://x/#' || unnest(['name', 'in']) AS p, unnest([n_name, 'http://x/#r' || n_regionkey::VARCHAR]) AS o, unnest(['literal', 'uri']) AS o_kind FROM nation UNION ALL SELECT 'http://x/#n' || n_nationkey::VARCHAR, '" + TYPE + "', 'http://x/#Nation', 'uri' FROM nation")
def rdfxml_scan(spark, d):
    """The nations as an RDF/XML document."""
    path = scratch(spark, "nations.owl")
    k = F.col("n_nationkey").cast("string")
    node = F.concat(F.lit('<x:Nation rdf:ID="n'), k, F.lit('"><x:name>'), "n_name", F.lit('</x:name><x:in rdf:resource="#r'), F.col("n_regionkey").cast("string"), F.lit('"/></x:Nation>'))
    body = "\n".join(r["x"] for r in read(spark, d, "nation").select(node.alias("x")).collect())
    head = '<rdf:RDF xml:base="http://x/" xmlns:x="http://x/#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
    sinks.write_text(spark, f"{head}{body}</rdf:RDF>", path)
    return rdf.read_graph(spark, path).select("s", "p", "o", "o_kind")


@query(f"SELECT s, p, o FROM {_SPLIT} WHERE split = 'valid'")
def split_file_round_trip(spark, d):
    path = scratch(spark, "valid.txt")
    sinks.write_split(splits.assign(_order_triples(spark, d)).where("split = 'valid'"), path)
    return tables.read_split(spark, path)


@query(
    f"""WITH sp AS {_SPLIT}, tr AS (SELECT * FROM sp WHERE split = 'train'), e AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS id FROM (SELECT s AS e FROM tr UNION SELECT o FROM tr)),
    r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS id FROM (SELECT DISTINCT p FROM tr))
    SELECT a.id::BIGINT AS s_id, r.id::BIGINT AS p_id, b.id::BIGINT AS o_id FROM sp JOIN e a ON a.e = s JOIN e b ON b.e = o JOIN r USING (p)"""
)
def id_encoding(spark, d):
    """Triples of every split as ids of the training terms; those with unknown terms drop."""
    split = splits.assign(_order_triples(spark, d))
    return tables.encode_ids(split, split.where("split = 'train'").select("s", "p", "o"))


@query("SELECT 'TransE' AS model, (SELECT count(*) FROM nation) / 100.0::DOUBLE AS mrr_both, (SELECT count(*) FROM region) / 100.0::DOUBLE AS mrr_head, NULL::DOUBLE AS mrr_tail, 0.25::DOUBLE AS hits_at_1, NULL::DOUBLE AS hits_at_3, (SELECT count(*) FROM region) / 10.0::DOUBLE AS hits_at_10")
def metrics_scan(spark, d):
    """The first report there is of three paths; nested keys, flat ones, absent ones."""
    n, r = (read(spark, d, t).count() for t in ("nation", "region"))
    path = scratch(spark, "results.json")
    sinks.write_json(spark, {"metrics": {"both": {"realistic": {"inverse_harmonic_mean_rank": n / 100, "hits_at_1": 0.25}}, "head.realistic.inverse_harmonic_mean_rank": r / 100, "both.realistic.hits_at_10": r / 10}}, path)
    return tables.read_metrics(spark, [f"{path}.none", path, f"{path}.later"], "TransE")


_STATS = f"(SELECT (SELECT count(*) FROM {graph_sql(*CORE)}) AS num_triples, (SELECT count(*) FROM (SELECT s FROM {graph_sql(*CORE)} UNION SELECT o FROM {graph_sql(*CORE)} WHERE o_kind = 'uri')) AS num_entities, (SELECT count(DISTINCT p) FROM {graph_sql(*CORE)}) AS num_relations)"


@query(f"SELECT *, 'core' AS source_file FROM {_STATS}")
def stats_report(spark, d):
    """Statistics as a JSON report, read back."""
    path = scratch(spark, "stats.json")
    sinks.write_json(spark, graph.graph_stats(graph.merge(mapped(spark, d, *CORE)), "core"), path)
    return spark.read.json(path, multiLine=True).select("num_triples", "num_entities", "num_relations", "source_file")


@query(
    "SELECT format('{:<12}{:>12}', 'Triples', format('{:,}', num_triples)) || chr(10) || format('{:<12}{:>12}', 'Entities', format('{:,}', num_entities)) || chr(10) || format('{:<12}{:>12}', 'Relations', format('{:,}', num_relations)) || chr(10) || 'Types' || chr(10) || "
    "(SELECT string_agg(format('  {:<30}{:>10}', regexp_extract(o, '([^/]*)$', 1), format('{:,}', n)), chr(10) ORDER BY n DESC, o) FROM "
    f"(SELECT o, count(*) AS n FROM {graph_sql(*CORE)} WHERE p = '{TYPE}' GROUP BY 1 ORDER BY n DESC, o LIMIT 5)) AS report FROM {_STATS}"
)
def stats_text(spark, d):
    path = scratch(spark, "stats.txt")
    sinks.write_text(spark, graph.format_stats(graph.graph_stats(graph.merge(mapped(spark, d, *CORE)))), path)
    return spark.read.text(path, wholetext=True).toDF("report")


_SCHEMA_TABLES = ("orders", "customer", "nation")
_SHORT = "CASE WHEN starts_with(x, '%s') THEN 'skg-o:' || substring(x, %d) ELSE '<' || x || '>' END" % (ONTOLOGY, len(ONTOLOGY) + 1)


def _counted(column: str, where: str, unit: str) -> str:
    rows = f"(SELECT {_SHORT} AS name, count(*) AS n FROM (SELECT {column} AS x FROM {graph_sql(*_SCHEMA_TABLES)} WHERE {where}) GROUP BY 1 ORDER BY n DESC, name LIMIT 20)"
    return f"(SELECT string_agg(format('  {{:<45}} {{:>6}} {unit}', name, n::VARCHAR), chr(10) ORDER BY n DESC, name) FROM {rows})"


_PREFIX_LINES = "\n".join(f"  PREFIX {p + ':':<6} <{ns}>" for p, ns in (("skg-o", O), ("skg-r", R), ("wd", ENTITY), ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"), ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"))).replace("\n", "' || chr(10) || '")


@query(
    f"SELECT '### Prefixes' || chr(10) || '{_PREFIX_LINES}' || chr(10) || chr(10) || '### Classes (instance count)' || chr(10) || "
    + _counted("o", f"p = '{TYPE}'", "instances")
    + " || chr(10) || chr(10) || '### Predicates (occurrence count)' || chr(10) || "
    + _counted("p", "true", "triples")
    + " || chr(10) AS summary"
)
def schema_summary_text(spark, d):
    return spark.createDataFrame([(graph.schema_summary(mapped(spark, d, *_SCHEMA_TABLES)),)], "summary string")


@query(f"SELECT s, p, o FROM {graph_sql(*CORE)} WHERE o_kind = 'uri'")
def uri_triples(spark, d):
    return splits.uri_triples(mapped(spark, d, *CORE))


@query("SELECT n_name AS label, (row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1)::INT AS rank, 'Q' || s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS wd_label, s_nationkey::VARCHAR AS description FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def search_response_parse(spark, d):
    """Entity-search responses: each nation's suppliers, in order, some without a label."""
    rows = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    hit = F.struct(F.concat(F.lit("Q"), k.cast("string")).alias("id"), F.when(k % 4 != 0, F.col("s_name")).alias("label"), F.col("s_nationkey").cast("string").alias("description"))
    search = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), hit.alias("hit")))), lambda x: x["hit"])
    return align.parse_search(rows.groupBy(F.col("n_name").alias("label")).agg(F.to_json(F.struct(search.alias("search"))).alias("body")))


@query("SELECT 'Q' || o_custkey::VARCHAR AS qid, 'P' || (o_orderkey % 7)::VARCHAR AS pid, o_orderpriority AS obj, CASE WHEN o_orderkey % 2 = 0 THEN 'literal' ELSE 'uri' END AS obj_type FROM orders")
def neighbour_response_parse(spark, d):
    """SPARQL JSON results: each customer's orders; an absent type is a URI; a broken response has no rows."""
    k = F.col("o_orderkey")
    prop = F.struct(F.concat(F.lit("http://p/direct/P"), (k % 7).cast("string")).alias("value"))
    obj = F.struct(F.col("o_orderpriority").alias("value"), F.when(k % 2 == 0, "literal").alias("type"))
    results = F.struct(F.struct(F.collect_list(F.struct(prop.alias("prop"), obj.alias("obj"))).alias("bindings")).alias("results"))
    fine = read(spark, d, "orders").groupBy(F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("qid")).agg(F.to_json(results).alias("body"))
    broken = read(spark, d, "nation").select(F.concat(F.lit("Q-"), F.col("n_nationkey").cast("string")).alias("qid"), F.lit('{"results": [').alias("body"))
    return align.parse_bindings(fine.unionByName(broken))


def _opened(address: str, headers: dict, seconds: float) -> tuple[int, str]:
    """A server of this catalogue's: every fourth page is gone, every fifth one breaks the connection."""
    k = int(address.rsplit("/", 1)[-1])
    if k % 4 == 0:
        return 404, ""
    if k % 5 == 0:
        raise ConnectionError("reset")
    return 200, f"<p>page {k}</p>"


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 OR page_id % 5 = 0 THEN NULL ELSE '<p>page ' || page_id::VARCHAR || '</p>' END AS body, CASE WHEN page_id % 4 = 0 THEN 'status 404' WHEN page_id % 5 = 0 THEN 'ConnectionError: reset' END AS error FROM pages")
def fetch_pages(spark, d):
    """Pages from a server that is gone for some and broken for others: rows with errors, tried again or not."""
    addresses = read(spark, d, "pages").select("page_id", F.concat(F.lit("http://x/"), F.col("page_id").cast("string")).alias("url"))
    return remote.fetch(addresses, opener=_opened, wait=lambda seconds: None).drop("url")


@query("SELECT vec_id AS id, 'v' || vec_id::VARCHAR AS label, list_sum([x::DOUBLE for x in embedding])::DOUBLE AS total FROM embeddings")
def model_tables(spark, d):
    """Embeddings with their id map as a model's tables, loaded and shown again."""
    path = scratch(spark, "model")
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    v.write.parquet(f"{path}/entities")
    v.where("id = 0").write.parquet(f"{path}/relations")
    spark.createDataFrame([("TransE",)], "kind string").write.parquet(f"{path}/kind")
    back = kge.embeddings(kge.load_model(spark, path), spark)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    labels = back.select("label", F.round(total, 6).alias("total"))
    return v.select("id", "label").join(labels, "label").select("id", "label", "total")


@query("SELECT c AS class, count(*) AS n, min(colour) AS colour FROM (SELECT CASE WHEN vec_id % 3 = 0 THEN 'CelestialBody' WHEN vec_id % 3 = 1 THEN 'SpaceMission' ELSE 'Other' END AS c, CASE WHEN vec_id % 3 = 0 THEN '#27AE60' WHEN vec_id % 3 = 1 THEN '#E67E22' ELSE '#95A5A6' END AS colour FROM embeddings) GROUP BY 1")
def plot_classes(spark, d):
    """The colours of a plot of the space (a top-n feature bounds a plot; here it shows all)."""
    v = read(spark, d, "embeddings")
    name = F.concat(F.when(F.col("vec_id") % 3 == 0, "Mars_").when(F.col("vec_id") % 3 == 1, "Apollo_").otherwise("thing_"), F.col("vec_id").cast("string"))
    shown = kge.coordinates(v.select(F.col("vec_id").alias("id"), name.alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")), "pca", most=v.count())
    return shown.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("colour").alias("colour"))


@query(f"SELECT o AS kind, count(*) AS n FROM (VALUES {', '.join(['(0)'] * 8)}) c(x), (SELECT '{OWL}Class' AS o) GROUP BY 1 UNION ALL SELECT '{OWL}ObjectProperty', 7 UNION ALL SELECT '{OWL}Ontology', 1 UNION ALL SELECT 'all', 59")
def ontology_terms(spark, d):
    """The ontology by kind of term, written and read as Turtle: eight classes, seven properties, 59 triples."""
    path = scratch(spark, "ontology.ttl")
    sinks.write_turtle(graph.build_ontology(spark), path)
    back = rdf.read_graph(spark, path)
    kinds = back.where(F.col("p") == TYPE).groupBy(F.col("o").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(back.agg(F.lit("all").alias("kind"), F.count(F.lit(1)).alias("n")))


_ALIGN = f"SELECT '{R}nation_' || n_nationkey::VARCHAR AS s, n_name AS label, count(o_custkey) + 1 AS n FROM nation LEFT JOIN (SELECT DISTINCT c_nationkey, c_custkey AS o_custkey FROM customer) ON c_nationkey = n_nationkey GROUP BY 1, 2"
_FOUND = "(SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.95::DOUBLE - 0.1::DOUBLE * rank) + CASE WHEN lower(label) = lower(wd_label) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 2) AS confidence FROM (SELECT n_name AS label, (s_suppkey % 5)::INT AS rank, 'Q' || s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE s_name END AS wd_label, repeat(s_name, 9) AS description FROM supplier JOIN nation ON s_nationkey = n_nationkey))"


@query(
    f"""SELECT c.s AS local_uri, label, b.id AS wd_id, b.wd_label, substring(b.description, 1, 120) AS wd_description, b.confidence, CASE WHEN b.confidence >= 0.8 THEN 'sameAs' WHEN b.confidence >= 0.5 THEN 'seeAlso' ELSE 'none' END AS alignment
    FROM ({_ALIGN} HAVING count(o_custkey) + 1 >= 10 ORDER BY n DESC, s LIMIT 50) c JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank, id) AS i FROM {_FOUND}) WHERE i = 1) b USING (label)"""
)
def align_entities_table(spark, d):
    """The whole alignment: labels, seeds (none of these nations is one), frequent entities, search results."""
    names = mapped(spark, d, "nation").where(F.col("p") == f"{O}name").withColumn("p", F.lit("http://www.w3.org/2000/01/rdf-schema#label"))
    links = mapped(spark, d, "customer").where(F.col("p") == f"{O}locatedIn")
    has = links.select(F.col("o").alias("s"), "s_kind", F.lit(f"{O}has").alias("p"), F.col("s").alias("o"), "o_kind", "o_datatype", "o_lang")
    rows = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    found = rows.select(F.col("n_name").alias("label"), (k % 5).cast("int").alias("rank"), F.concat(F.lit("Q"), k.cast("string")).alias("id"), F.when(k % 2 == 0, F.lower("n_name")).otherwise(F.col("s_name")).alias("wd_label"), F.repeat("s_name", F.lit(9)).alias("description"))
    return align.align_entities(names.unionByName(has), found)


@query("WITH c AS (SELECT 'c' || c_custkey::VARCHAR AS s, c_name AS label, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT s, label, n FROM c")
def subject_count_default(spark, d):
    """Labelled subjects with their triple counts, 0 for those without any."""
    labels = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("s"), F.col("c_name").alias("label"))
    o = read(spark, d, "orders")
    triples = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("s"), F.lit("uri").alias("s_kind"), F.lit("p").alias("p"), F.col("o_orderkey").cast("string").alias("o"))
    return align.frequent_candidates(triples, labels, spark.createDataFrame([], "local_uri string"), least=0, limit=None)


@query("SELECT s, max(label) AS label FROM (SELECT 'n' || (s_suppkey % 25)::VARCHAR AS s, trim(unnest([s_name, '  ' || s_name || ' b', '12', '[x]'])) AS label FROM supplier) WHERE length(label) > 2 AND label NOT LIKE '[%' GROUP BY 1")
def label_per_subject(spark, d):
    """Of several clean labels the greatest."""
    s = read(spark, d, "supplier")
    texts = F.explode(F.array("s_name", F.concat(F.lit("  "), "s_name", F.lit(" b")), F.lit("12"), F.lit("[x]")))
    rows = s.select(F.concat(F.lit("n"), (F.col("s_suppkey") % 25).cast("string")).alias("s"), F.lit("uri").alias("s_kind"), F.lit("http://www.w3.org/2000/01/rdf-schema#label").alias("p"), texts.alias("o"))
    return align.entity_labels(rows)
