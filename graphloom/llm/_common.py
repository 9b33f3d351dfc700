"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own
    where that is unset (local sessions and tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it has to name a shared folder")
        path = tempfile.mkdtemp(prefix="graphloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage with a reliable checkpoint in the shared folder.

    Spark's cleaner removes the files when the plans that read them are gone."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and checkpoints of plans that nothing refers to any
    more. The cleaner works when the driver's heap is collected, which may not be before a job's end."""
    gc.collect()
    spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project ``df`` to our own names, so that extra columns, whatever they are called, can't clash.

    ``pick(df, doc_id="id", text="body")`` reads the columns ``id`` and ``body``."""
    return df.select(*[df[name].alias(alias) for alias, name in columns.items()])


def rows_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


#: Up to so many ids (8 bytes each) are broadcast rather than joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """``docs`` less the rows whose id is in ``dropped`` (one column). The ids are counted first: few
    are broadcast, so that the texts aren't shuffled; more are joined by a shuffle."""
    dropped = materialize(dropped.toDF("__dropped_id").distinct())
    if rows_of(dropped) <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs[id_col].eqNullSafe(dropped["__dropped_id"]), "left_anti")


def filter_batches(owner: str, docs: DataFrame, text_col: str, keep) -> DataFrame:
    """``docs``, all columns, less the rows that ``keep`` gives false for. Map-only.

    ``keep(batches, place)`` gets Arrow batches of ``docs``, with the text at column ``place``, and yields
    the same batches, each with a mask of its rows."""
    place = docs.columns.index(text_col)

    @worker(owner)
    def run(batches):
        for batch, chosen in keep(batches, place):
            yield batch.filter(pa.array(chosen))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # Arrow functions don't take names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


#: What this Python worker keeps between tasks, by operator.
_OWNED: dict[str, object] = {}


def worker_cache(owner: str, build):
    """What ``build`` makes, kept in the Python worker for the next tasks of the same operator."""
    if owner not in _OWNED:
        _OWNED[owner] = build()
    return _OWNED[owner]


def worker(owner: str):
    """For functions that run in Python workers: a worker that comes from another operator first drops
    what that one kept, and freed memory goes back to the system when the task or group ends."""

    def wrap(function):
        def held(*args):
            _take_over(owner)
            out = function(*args)
            _release()
            return out

        def batches(it):
            _take_over(owner)
            yield from function(_trimmed(it))
            _release()

        # Spark looks at how many arguments a function of groups takes.
        if inspect.isgeneratorfunction(function):
            return batches
        if function.__code__.co_argcount == 1:
            return lambda table: held(table)
        return lambda key, table: held(key, table)

    return wrap


def _take_over(owner: str) -> None:
    if not _OWNED.get("__libc"):
        # Arrays of a megabyte or more are mapped and unmapped singly, so they leave no holes.
        _libc("mallopt", -3, 1 << 20)
    if any(other not in (owner, "__libc") for other in _OWNED):
        _OWNED.clear()
        _release()
    _OWNED["__libc"] = True


def _trimmed(batches):
    for batch in batches:
        yield batch
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim", 0)


def _libc(name: str, *args: int) -> None:
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has these
        getattr(ctypes.CDLL(None), name)(*args)


class Kept(dict):
    """A bounded cache that keeps what comes first: in text, frequent pieces come early. Once it has
    turned away many times its size, the text has changed, and it starts anew."""

    def __init__(self, size: int, refresh: int = 12):
        super().__init__()
        self.size, self.refresh, self.turned_away = size, refresh, 0

    def keep(self, key, value) -> None:
        if len(self) < self.size:
            self[key] = value
        else:
            self.turned_away += 1
            if self.turned_away > self.refresh * self.size:
                self.clear()
                self.turned_away = 0
