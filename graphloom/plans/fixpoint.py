"""Closures over pair tables as semi-naive driver loops; each round is a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that may be broadcast: reachability over so few is searched in the tasks that hold the starts.
BROADCAST_EDGES = 200_000
#: After so many rounds a closure goes on by doubling, so that long chains take few more.
LINEAR_ROUNDS = 16


def shared_dir(spark) -> str:
    """``spark.checkpoint.dir``, or in local sessions, where that is unset, a folder of our own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it has to name a shared folder")
        path = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _file_system(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and read it back from the shared folder, so that lineage ends there. The table goes
    when the driver ends, as later plans may read it until then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    df.write.parquet(path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def scratch(spark, name: str) -> str:
    """A path of its own in the shared folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{path}/{name}"


def forget(df: DataFrame) -> None:
    """Delete a cut table that no plan will read again."""
    where, files = _file_system(df.sparkSession, df.cut_path)
    files.delete(where, True)


def transitive_closure(pairs: DataFrame) -> DataFrame:
    """All (a, b) joined by one or more steps of ``pairs`` (columns a, b). Cycles end as nothing new
    appears; each round extends only the pairs that the last one found, by an edge, and after
    ``LINEAR_ROUNDS`` rounds by all that is known."""
    edges = cut(pairs.select("a", "b").where("a is not null and b is not null").distinct())
    rounds = iter(range(1 << 62))

    def step(known: DataFrame, new: DataFrame) -> DataFrame:
        on = lambda x, y: x.toDF("a", "mid").join(y.toDF("mid", "b"), "mid").select("a", "b")
        return on(new, edges) if next(rounds) < LINEAR_ROUNDS else on(new, known).unionByName(on(known, new))

    return saturate(edges, step)


def reachable(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """(a, b): what each of ``starts`` (column a) reaches by one or more steps of ``pairs``: their closure,
    but for those starts alone. Few edges are broadcast, after a count, and each start is searched where
    it is; of more, the frontier is joined with the edges until nothing new appears."""
    starts = starts.select("a").where("a is not null").distinct()
    edges = cut(pairs.select("a", "b").where("a is not null and b is not null").distinct())
    if edges.count() <= BROADCAST_EDGES:
        after: dict = {}
        plain = lambda x: tuple(x) if isinstance(x, tuple) else x
        for r in edges.collect():
            after.setdefault(plain(r["a"]), []).append(plain(r["b"]))
        return starts.mapInArrow(_search(pairs.sparkSession.sparkContext.broadcast(after), edges.schema["b"].dataType), edges.schema)
    first = starts.join(edges, "a")
    return saturate(first, lambda known, new: new.toDF("a", "mid").join(edges.toDF("mid", "b"), "mid").select("a", "b"))


def _search(shared, kind):
    from pyspark.sql.pandas.types import to_arrow_type

    most = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, arrow = shared.value, to_arrow_type(kind)
        fields = [f.name for f in kind.fields] if hasattr(kind, "fields") else None
        plain = (lambda x: dict(zip(fields, x, strict=True))) if fields else (lambda x: x)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                key = tuple(start.values()) if fields else start
                seen, queue = set(), list(after.get(key, ()))
                while queue:
                    at = queue.pop()
                    if at not in seen:
                        seen.add(at)
                        queue += after.get(at, ())
                found = list(seen)
                for i in range(0, len(found), most):
                    ends = found[i : i + most]
                    yield pa.RecordBatch.from_arrays([pa.array([start] * len(ends), arrow), pa.array([plain(x) for x in ends], arrow)], names=["a", "b"])

    return run


def saturate(facts: DataFrame, step, max_rounds: int | None = None) -> DataFrame:
    """Least set of rows that holds ``facts`` and everything ``step(known, new)`` derives from it.

    ``step`` gets all known rows and those that the last round found, and returns candidate rows. Over
    finitely many terms the loop ends by itself; ``max_rounds`` is for steps that may make new ones."""
    known = delta = cut(facts.distinct())
    done = 0
    while max_rounds is None or done < max_rounds:
        new = cut(step(known, delta).distinct().join(known, known.columns, "left_anti"))
        if new.isEmpty():
            forget(new)
            return known
        # What is known is the union of the rounds' tables; none is written twice.
        known, delta, done = known.unionByName(new), new, done + 1
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
