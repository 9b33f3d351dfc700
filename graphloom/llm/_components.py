"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, rows_of, worker

#: Graphs of at most so many edges (16 bytes each) are finished in one executor task.
LOCAL_EDGES = 1_000_000
_PACK = 1 << 16


def _solve(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component), by minimum hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]


@worker("components")
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), _PACK):
            part = batch.slice(at, _PACK)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *[pa.array([part.column(c).to_numpy().tobytes()], pa.binary()) for c in ("u", "v")]], names=["all", "u", "v"])


@worker("components")
def _solve_group(table: pa.Table) -> pa.Table:
    u, v = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column(c)]) for c in ("u", "v"))
    nodes, roots = _solve(u, v)
    return pa.table({"node": nodes, "comp": roots})


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``edges``: columns u, v (long, not null). Returns ``node, comp`` for every node with an edge to
    another one; ``comp`` is the smallest node of the component.

    While the graph has more than ``local_edges`` edges, each node hooks to its smallest neighbour,
    the hooks are followed to their ends and the edges contracted, which at least halves the nodes; the
    rest is solved in one task of bounded size. Nothing is collected."""
    spark = edges.sparkSession
    clean = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = materialize(clean)
    mapped = None
    while rows_of(left) > local_edges:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")))
        while True:
            up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
            jumped = materialize(hook.join(up, "comp").select("node", F.col("higher").alias("comp"), (F.col("higher") != F.col("comp")).alias("moved")))
            hook = jumped.select("node", "comp")
            if jumped.where("moved").isEmpty():
                break
        mapped = hook if mapped is None else _through(mapped, hook)
        a = hook.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
        b = hook.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
        met = left.join(a, "u").join(b, "v").where("cu <> cv")
        left = materialize(met.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
    packed = left.mapInArrow(_pack, "all int, u binary, v binary")
    last = packed.groupBy("all").applyInArrow(_solve_group, "node long, comp long")
    if mapped is None:
        return materialize(last)
    return materialize(_through(mapped, last))


def _through(first: DataFrame, then: DataFrame) -> DataFrame:
    step = then.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
    return first.join(step, "comp", "left").select("node", F.coalesce("further", "comp").alias("comp"))
