"""Page, fact, seed, split and metric files, and relational tables mapped to triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.plans.fixpoint import cut
from graphloom.terms import ONTOLOGY, RESOURCE, TRIPLE_COLUMNS, TYPE, triple

PAGES = "url string, title string, text string, word_count long, crawled_at string"
FACTS = ("subject", "subject_label", "predicate", "object", "object_label", "source_url", "sentence", "extraction_type")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed URLs, a line each; blank lines and lines that begin with # are skipped."""
    lines = spark.read.text(path)
    return lines.where((strip("value") != "") & ~F.startswith("value", F.lit("#"))).select(strip("value").alias("url"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records of a JSON-lines file; a missing title is the URL."""
    return spark.read.schema(PAGES).json(path).withColumn("title", F.coalesce("title", "url"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The fact table; every value stays a string, also ``NA`` and empty ones."""
    schema = ", ".join(f"{c} string" for c in FACTS)
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', nullValue="\u0000", emptyValue="")
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in FACTS])


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="s string, p string, o string", sep="\t", quote="", escape="")


def encode_ids(triples: DataFrame, train: DataFrame) -> DataFrame:
    """Triples as ids of the training terms' dictionaries (see ``dictionaries``); others drop."""
    entities, relations = dictionaries(train)
    s, o = entities.toDF("s", "s_id"), entities.toDF("o", "o_id")
    return triples.join(s, "s").join(o, "o").join(relations.toDF("p", "p_id"), "p").select("s_id", "p_id", "o_id")


def dictionaries(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense ids from 0 on, by name: (entity, id) and (relation, id)."""
    entities = train.select(F.col("s").alias("entity")).union(train.select("o")).distinct()
    relations = train.select(F.col("p").alias("relation")).distinct()
    return dense_ids(entities), dense_ids(relations)


def dense_ids(names: DataFrame) -> DataFrame:
    """(name, id): ids from 0 on in the order of names. A range sort and the sizes of its partitions give
    the ids, so no partition sees all names; the sizes (one row a partition) are gathered. The sorted rows
    are written once, with their places: a sort that runs again may cut its ranges elsewhere."""
    (column,) = names.columns
    ranged = cut(names.sort(column).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    first = ranged.groupBy("__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n")).orderBy("__part").collect()
    starts, total = [], 0
    for r in first:
        starts.append((r["__part"], r["__first"], total))
        total += r["__n"]
    if not starts:
        return names.withColumn("id", F.lit(0).cast("long"))
    offsets = names.sparkSession.createDataFrame(starts, "__part int, __first long, __start long")
    return ranged.join(F.broadcast(offsets), "__part").select(column, (F.col("__row") - F.col("__first") + F.col("__start")).alias("id"))


def read_metrics(spark: SparkSession, path: str | list[str], model: str) -> DataFrame:
    """One row of ranking metrics from a JSON document (of several paths, the first that there is): nested
    keys, else flat ones; null where absent."""
    paths = [path] if isinstance(path, str) else path
    found = next((p for p in paths if exists(spark, p)), None)
    if found is None:
        raise FileNotFoundError(f"none of {', '.join(paths)}")
    text = spark.read.text(found, wholetext=True)
    pick = lambda side, kind, name: F.coalesce(F.get_json_object("value", f"$.metrics.{side}.{kind}.{name}"), F.get_json_object("value", f"$.metrics['{side}.{kind}.{name}']")).cast("double")
    mrr = {f"mrr_{side}": pick(side, "realistic", "inverse_harmonic_mean_rank") for side in ("both", "head", "tail")}
    hits = {f"hits_at_{k}": pick("both", "realistic", f"hits_at_{k}") for k in (1, 3, 10)}
    return text.select(F.lit(model).alias("model"), *[c.alias(n) for n, c in (mrr | hits).items()])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def map_table(table: DataFrame, name: str, key: str, columns: dict[str, str], links: dict[str, tuple[str, str]] | None = None, kind: str | None = None) -> DataFrame:
    """Rows as triples: ``resource/<name>_<key>`` with a predicate per column; ``links`` (column ->
    (predicate, table)) become URI objects. One narrow pass, no shuffle."""
    subject = F.concat(F.lit(f"{RESOURCE}{name}_"), F.col(key).cast("string"))
    made = [triple(subject, TYPE, F.lit(f"{ONTOLOGY}{kind or name.capitalize()}"))]
    made += [triple(subject, f"{ONTOLOGY}{p}", F.col(c).cast("string"), "literal") for c, p in columns.items()]
    made += [triple(subject, f"{ONTOLOGY}{p}", F.concat(F.lit(f"{RESOURCE}{t}_"), F.col(c).cast("string"))) for c, (p, t) in (links or {}).items()]
    rows = table.select(F.inline(F.array(*made)))
    return rows.where("o is not null").select(*TRIPLE_COLUMNS)
