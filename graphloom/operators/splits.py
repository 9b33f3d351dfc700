"""Training splits of a graph: deterministic shuffle, coverage, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut

SEED = 42


def order_key(seed: int = SEED) -> Column:
    """The shuffle: triples in the order of a seeded digest."""
    return F.md5(F.concat_ws("\t", "s", "p", "o", F.lit(str(seed))))


def uri_triples(graph: DataFrame) -> DataFrame:
    return graph.where("s_kind = 'uri' and o_kind = 'uri'").select("s", "p", "o").distinct()


def assign(triples: DataFrame, train: float = 0.8, valid: float = 0.1, seed: int = SEED) -> DataFrame:
    """Triples with ``split``: exactly int(n * train) and int(n * valid) rows, the rest test.

    The two boundary digests are found by a distributed sort (their rows are looked up by position), so
    no single task numbers all rows."""
    keyed = cut(triples.select("s", "p", "o").withColumn("__k", order_key(seed)))
    n = keyed.count()
    first, second = int(n * train), int(n * train) + int(n * valid)
    at = _keys_at(keyed, [first, second])
    edge = lambda i: F.lit(at[i]) if at[i] is not None else F.lit("~")
    return keyed.select("s", "p", "o", F.when(F.col("__k") < edge(0), "train").when(F.col("__k") < edge(1), "valid").otherwise("test").alias("split"))


def _keys_at(keyed: DataFrame, positions: list[int]) -> list[str | None]:
    """The digests at sorted positions (None past the end): sizes of digest ranges, then one range each."""
    bins = keyed.groupBy(F.substring("__k", 1, 4).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # at most 65,536 rows
    out = []
    for position in positions:
        before, found = 0, None
        for r in bins:
            if before + r["n"] > position:
                row = keyed.where(F.startswith("__k", F.lit(r["b"]))).orderBy("__k").offset(position - before).limit(1).first()
                found = row["__k"]
                break
            before += r["n"]
        out.append(found)
    return out


def sample(triples: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows (all, if there are no more), the same ones every time."""
    return triples.orderBy(order_key(seed), "s", "p", "o").limit(size)


def _covered(rows: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    terms = train.select(F.col("s").alias("e")).union(train.select("o")).distinct()
    relations = train.select("p").distinct()
    flagged = (
        rows.join(terms.select(F.col("e").alias("s"), F.lit(True).alias("has_s")), "s", "left")
        .join(terms.select(F.col("e").alias("o"), F.lit(True).alias("has_o")), "o", "left")
        .join(relations.select("p", F.lit(True).alias("has_p")), "p", "left")
        .withColumn("ok", F.col("has_s").isNotNull() & F.col("has_o").isNotNull() & F.col("has_p").isNotNull())
    )
    flagged = cut(flagged.select("s", "p", "o", "ok"))
    return flagged.where("ok").drop("ok"), flagged.where("not ok").drop("ok")


def enforce_coverage(split: DataFrame) -> DataFrame:
    """Valid, then test, rows with a term that training lacks move to training."""
    part = lambda name: split.where(F.col("split") == name).select("s", "p", "o")
    train = part("train")
    kept = []
    for name in ("valid", "test"):
        ok, rescued = _covered(part(name), train)
        kept.append(ok.withColumn("split", F.lit(name)))
        train = train.unionByName(rescued)
    return reduce(DataFrame.unionByName, [train.withColumn("split", F.lit("train")), *kept])


def orphans(split: DataFrame) -> DataFrame:
    """Entities of valid and test that training lacks."""
    ends = lambda df: df.select(F.col("s").alias("entity")).union(df.select("o")).distinct()
    return ends(split.where("split <> 'train'")).join(ends(split.where("split = 'train'")), "entity", "left_anti")


def sizes(split: DataFrame) -> DataFrame:
    total = split.agg(F.count(F.lit(1)).alias("total"))
    counts = split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("split", "n", F.round(F.try_divide("n", "total"), 4).alias("share"))
