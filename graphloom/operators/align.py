"""Aligning entities and predicates to external ids, and expanding by one hop.

Remote search and neighbours are *providers*: DataFrames ``(label, rank, id, wd_label, description)``
and ``(qid, pid, obj, obj_type)``, from whatever source fills them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import alignment_tier, candidate_confidence, is_clean_label, last_segment, strip
from graphloom.operators.graph import subject_frequency
from graphloom.terms import COMMENT, DIRECT, ENTITY, LABEL, ONTOLOGY, OWL, PREDICATE_ALIGNMENT, PREDICATES_KEPT, SAME_AS, SEE_ALSO, SEEDS, TRIPLE_SCHEMA, TYPE, triple

MAPPING = ("local_uri", "label", "wd_id", "wd_label", "wd_description", "confidence", "alignment")


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, q, c) for k, (q, c) in SEEDS.items()], "key string, wd_id string, confidence double")


def kept_predicates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, n) for p, n in PREDICATES_KEPT.items() if n], "pid string, local_name string")


def entity_labels(graph: DataFrame) -> DataFrame:
    """(s, label): clean labels of URIs; of several the greatest, so that the choice is stable."""
    clean = graph.where((F.col("p") == LABEL) & (F.col("s_kind") == "uri") & is_clean_label("o"))
    return clean.groupBy("s").agg(F.max(strip("o")).alias("label"))


def seed_alignment(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Labels that match a seed in lower case. The seed table is a constant of the library, so it is small."""
    matched = labels.join(F.broadcast(seeds), F.lower("label") == F.col("key"))
    return matched.select(
        F.col("s").alias("local_uri"), "label", "wd_id", F.col("label").alias("wd_label"), F.lit("(seed alignment)").alias("wd_description"), "confidence", alignment_tier("confidence").alias("alignment")
    )


def frequent_candidates(graph: DataFrame, labels: DataFrame, seeded: DataFrame, least: int = 10, limit: int | None = 50) -> DataFrame:
    """Unseeded labelled subjects of ``least`` triples or more (none count 0), the ``limit`` most frequent,
    then by name (None: all, in no order)."""
    counts = subject_frequency(graph)
    left = labels.join(seeded.select(F.col("local_uri").alias("s")), "s", "left_anti")
    counted = left.join(counts, "s", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    found = counted.where(F.col("n") >= least)
    return found if limit is None else found.orderBy(F.desc("n"), "s").limit(limit)


def best_candidates(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """For each candidate the lowest-rank search result of its label, with its confidence."""
    ranked = found.withColumn("confidence", candidate_confidence("rank", "label", "wd_label"))
    best = ranked.groupBy("label").agg(F.min_by(F.struct("id", "wd_label", "description", "confidence"), F.struct("rank", "id")).alias("b"))
    return candidates.join(best, "label").select(
        F.col("s").alias("local_uri"),
        "label",
        F.col("b.id").alias("wd_id"),
        F.col("b.wd_label").alias("wd_label"),
        F.substring("b.description", 1, 120).alias("wd_description"),
        F.col("b.confidence").alias("confidence"),
        alignment_tier("b.confidence").alias("alignment"),
    )


def align_entities(graph: DataFrame, found: DataFrame | None = None, least: int = 10, limit: int = 50) -> DataFrame:
    """The mapping table: seeded entities, then frequent ones by the search provider's results."""
    labels = entity_labels(graph)
    seeded = seed_alignment(labels, seed_table(graph.sparkSession))
    if found is None:
        return seeded
    return seeded.unionByName(best_candidates(frequent_candidates(graph, labels, seeded, least, limit), found))


def alignment_triples(mapping: DataFrame) -> DataFrame:
    relation = F.when(F.col("alignment") == "sameAs", SAME_AS).when(F.col("alignment") == "seeAlso", SEE_ALSO)
    rows = mapping.select(F.inline(F.array(triple(F.col("local_uri"), relation, F.concat(F.lit(ENTITY), "wd_id")))))
    return rows.where("p is not null").distinct()


def alignment_summary(mapping: DataFrame) -> DataFrame:
    tier = lambda t: F.count_if(F.col("alignment") == t).alias(f"n_{t.lower()}")
    return mapping.agg(tier("sameAs"), tier("seeAlso"), tier("none"), F.count(F.lit(1)).alias("n_total"))


def predicate_alignment(spark: SparkSession) -> DataFrame:
    rows = []
    for name, (pid, relation, why) in PREDICATE_ALIGNMENT.items():
        s = f"{ONTOLOGY}{name}"
        rows += [(s, "uri", TYPE, f"{OWL}ObjectProperty", "uri", "", ""), (s, "uri", relation, f"{DIRECT}{pid}", "uri", "", ""), (s, "uri", COMMENT, f"Aligned to wd:{pid}. {why}", "literal", "", "")]
    return spark.createDataFrame(rows, TRIPLE_SCHEMA)


def aligned_entities(alignment: DataFrame) -> DataFrame:
    """(s, qid) of the sameAs links into the entity namespace; of several the greatest."""
    links = alignment.where((F.col("p") == SAME_AS) & F.contains("o", F.lit("wikidata.org/entity/Q")))
    return links.groupBy("s").agg(F.max(last_segment("o")).alias("qid"))


def expansion(aligned: DataFrame, neighbours: DataFrame, per_entity: int | None = 200, limit_first: bool = True) -> DataFrame:
    """Triples of aligned entities from a neighbour provider, over the kept predicates.

    Objects that are aligned themselves become the local URI (of several, the greatest); other entities
    stay external; literals stay literals. ``per_entity`` bounds the rows of one entity, as a remote
    endpoint would; ``limit_first`` applies it before the predicate whitelist. The row numbers come
    from a window per entity, whose rows the provider bounds likewise."""
    spark = aligned.sparkSession
    rows = neighbours
    pick = F.broadcast(kept_predicates(spark))
    order = Window.partitionBy("qid").orderBy("pid", "obj", "obj_type")
    cap = lambda df: df if per_entity is None else df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_entity).drop("__n")
    rows = cap(rows).join(pick, "pid") if limit_first else cap(rows.join(pick, "pid"))
    local = aligned.groupBy(F.col("qid").alias("o_qid")).agg(F.max("s").alias("o_local"))
    is_entity = (F.col("obj_type") == "uri") & F.contains("obj", F.lit("wikidata.org/entity/Q"))
    hop = aligned.join(rows, "qid").withColumn("o_qid", F.when(is_entity, last_segment("obj")))
    resolved = hop.join(local, "o_qid", "left")
    o = F.when(is_entity, F.coalesce("o_local", F.concat(F.lit(ENTITY), "o_qid"))).otherwise(F.col("obj"))
    kind = F.when(F.col("obj_type") == "literal", "literal").otherwise("uri")
    return resolved.select(F.inline(F.array(triple(F.col("s"), F.concat(F.lit(ONTOLOGY), "local_name"), o, kind)))).distinct()


def expand_graph(initial: DataFrame, alignment: DataFrame, neighbours: DataFrame, **options) -> DataFrame:
    return initial.unionByName(expansion(aligned_entities(alignment), neighbours, **options)).distinct()


def parse_bindings(responses: DataFrame) -> DataFrame:
    """(qid, pid, obj, obj_type) from SPARQL JSON results in a column ``body``; bad JSON gives no rows."""
    cell = "struct<value:string,type:string>"
    schema = f"struct<results:struct<bindings:array<struct<prop:{cell},obj:{cell}>>>>"
    rows = responses.select("qid", F.explode(F.from_json("body", schema)["results"]["bindings"]).alias("b"))
    return rows.select("qid", last_segment("b.prop.value").alias("pid"), F.col("b.obj.value").alias("obj"), F.coalesce("b.obj.type", F.lit("uri")).alias("obj_type"))


def parse_search(responses: DataFrame) -> DataFrame:
    """(label, rank, id, wd_label, description) from entity-search JSON in a column ``body``."""
    schema = "struct<search:array<struct<id:string,label:string,description:string>>>"
    rows = responses.select("label", F.posexplode(F.from_json("body", schema)["search"]).alias("rank", "m"))
    return rows.select("label", "rank", F.col("m.id").alias("id"), F.coalesce("m.label", F.lit("")).alias("wd_label"), F.coalesce("m.description", F.lit("")).alias("description"))
