"""Building the graph from facts, its statistics and its schema summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import padded, short_name, slugify
from graphloom.terms import (
    CLASSES, COMMANDER_COMMENT, COMMENT, DERIVED_FROM, DOMAIN, ENTITY, LABEL, LABEL_CLASSES, ONTOLOGY, ONTOLOGY_COMMENT, ONTOLOGY_LABEL, OWL, PROPERTIES, RANGE, RDF, RDFS, RESOURCE, SUBCLASS,
    SUBCLASSES, TRIPLE_SCHEMA, TYPE, triple,
)


def build_ontology(spark: SparkSession) -> DataFrame:
    """The ontology as triples."""
    o = lambda name: f"{ONTOLOGY}{name}"
    uri = lambda s, p, v: (s, "uri", p, v, "uri", "", "")
    text = lambda s, p, v: (s, "uri", p, v, "literal", "", "")
    rows = [uri(ONTOLOGY, TYPE, f"{OWL}Ontology"), text(ONTOLOGY, LABEL, ONTOLOGY_LABEL), text(ONTOLOGY, COMMENT, ONTOLOGY_COMMENT)]
    for name, comment in CLASSES.items():
        rows += [uri(o(name), TYPE, f"{OWL}Class"), text(o(name), LABEL, name), text(o(name), COMMENT, comment)]
    rows += [uri(o(a), SUBCLASS, o(b)) for a, b in SUBCLASSES]
    rows += [uri(o("MissionCommander"), TYPE, f"{OWL}Class"), text(o("MissionCommander"), COMMENT, COMMANDER_COMMENT)]
    rows += [uri(o("Person"), TYPE, f"{OWL}Class"), text(o("Person"), LABEL, "Person")]
    for name, (domain, range_, comment) in PROPERTIES.items():
        rows += [uri(o(name), TYPE, f"{OWL}ObjectProperty"), text(o(name), LABEL, name), text(o(name), COMMENT, comment)]
        rows += [uri(o(name), p, o(c)) for p, c in ((DOMAIN, domain), (RANGE, range_)) if c]
    return spark.createDataFrame(rows, TRIPLE_SCHEMA)


def fact_triples(facts: DataFrame) -> DataFrame:
    """Each fact as three to six triples: the relation, two labels, types where the label has a class, and
    the source where there is one. Facts with an empty slug give none. Not deduplicated."""
    slugs = facts.select("*", *[slugify(c).alias(f"{c}_slug") for c in ("subject", "predicate", "object")])
    kept = slugs.where("subject_slug <> '' and predicate_slug <> '' and object_slug <> ''")
    s, o = (F.concat(F.lit(RESOURCE), F.col(f"{c}_slug")) for c in ("subject", "object"))
    of = lambda c: F.coalesce(*[F.when(F.col(c) == label, f"{ONTOLOGY}{name}") for label, name in LABEL_CLASSES.items()])
    made = [
        triple(s, F.concat(F.lit(ONTOLOGY), F.col("predicate_slug")), o),
        triple(s, LABEL, F.col("subject"), "literal"),
        triple(o, LABEL, F.col("object"), "literal"),
        F.when(of("subject_label").isNotNull(), triple(s, TYPE, of("subject_label"))),
        F.when(of("object_label").isNotNull(), triple(o, TYPE, of("object_label"))),
        F.when(F.coalesce(F.col("source_url"), F.lit("")) != "", triple(s, DERIVED_FROM, F.col("source_url"))),
    ]
    return kept.select(F.inline(F.filter(F.array(*made), lambda t: t.isNotNull())))


def build_graph(facts: DataFrame, ontology: DataFrame | None = None) -> DataFrame:
    made = fact_triples(facts)
    return (made.unionByName(ontology) if ontology is not None else made).distinct()


def merge(*graphs: DataFrame) -> DataFrame:
    """Graphs as one set; deduplicated once."""
    whole = graphs[0]
    for g in graphs[1:]:
        whole = whole.unionByName(g)
    return whole.distinct()


def entities(graph: DataFrame) -> DataFrame:
    """Distinct URIs that are a subject or an object."""
    subjects = graph.where("s_kind = 'uri'").select(F.col("s").alias("entity"))
    return subjects.union(graph.where("o_kind = 'uri'").select("o")).distinct()


def type_histogram(graph: DataFrame, limit: int | None = 10) -> DataFrame:
    """(type, count) of rdf:type objects, most frequent first, then by name."""
    found = graph.where(F.col("p") == TYPE).groupBy(F.col("o").alias("type")).agg(F.count(F.lit(1)).alias("count"))
    ordered = found.orderBy(F.desc("count"), "type")
    return ordered if limit is None else ordered.limit(limit)


def predicate_counts(graph: DataFrame) -> DataFrame:
    return graph.groupBy(short_name("p").alias("predicate")).agg(F.count(F.lit(1)).alias("count"))


def class_counts(graph: DataFrame) -> DataFrame:
    return graph.where(F.col("p") == TYPE).groupBy(short_name("o").alias("class")).agg(F.count(F.lit(1)).alias("count"))


def subject_frequency(graph: DataFrame) -> DataFrame:
    return graph.where("s_kind = 'uri'").groupBy("s").agg(F.count(F.lit(1)).alias("n"))


def sample_entities(graph: DataFrame, limit: int = 10) -> DataFrame:
    """The first labelled URIs, by name."""
    labelled = graph.where((F.col("p") == LABEL) & (F.col("s_kind") == "uri"))
    return labelled.select(F.concat(short_name("s"), F.lit(' rdfs:label "'), "o", F.lit('"')).alias("entity")).distinct().orderBy("entity").limit(limit)


def graph_stats(graph: DataFrame, source: str = "") -> dict:
    """Triples, entities, relations and the ten most frequent types (a set of triples is expected)."""
    one = graph.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("p")).first()
    top = {r["type"]: r["count"] for r in type_histogram(graph).collect()}
    return {"num_triples": one["n"], "num_entities": entities(graph).count(), "num_relations": one["p"], "top_types": top, "source_file": source}


def format_stats(stats: dict, most: int = 5) -> str:
    lines = [f"{name:<12}{stats[key]:>12,}" for name, key in (("Triples", "num_triples"), ("Entities", "num_entities"), ("Relations", "num_relations"))]
    return "\n".join([*lines, "Types", *[f"  {t.rsplit('/', 1)[-1]:<30}{n:>10,}" for t, n in list(stats["top_types"].items())[:most]]])


def schema_summary(graph: DataFrame, top: int = 20) -> str:
    """The schema as text for a model: prefixes, classes and predicates with counts, sample entities."""
    lines = ["### Prefixes"]
    lines += [f"  PREFIX {p + ':':<6} <{ns}>" for p, ns in (("skg-o", ONTOLOGY), ("skg-r", RESOURCE), ("wd", ENTITY), ("rdf", RDF), ("rdfs", RDFS))]
    for title, counts, name, unit in (("Classes (instance count)", class_counts(graph), "class", "instances"), ("Predicates (occurrence count)", predicate_counts(graph), "predicate", "triples")):
        row = F.concat(F.lit("  "), padded(name, 45), F.lit(" "), padded("count", 6, right=True), F.lit(f" {unit}"))
        lines += ["", f"### {title}"] + [r["line"] for r in counts.orderBy(F.desc("count"), name).limit(top).select(row.alias("line")).collect()]
    sample = [r["entity"] for r in sample_entities(graph).collect()]
    if sample:
        lines += ["", "### Sample entities"] + [f"  {e}" for e in sample]
    return "\n".join([*lines, ""])
