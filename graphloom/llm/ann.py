"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Vectors are centred, reduced to their principal axes and turned by learned rotations so that the signs
make balanced codes. A code is cut into substrings and each substring is the key of one table. What
shares a key (and a label) is compared by cosine of the original vectors, in blocks, each pair in its
first common table only. Tasks put out sums and spanning edges, never pairs.

The length of a key follows the number of vectors, so that buckets stay of one size; the number of tables
follows the share of pairs at the threshold that meet in some table, measured on the sample: codes of
further rotations are added until it is reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, parallelism, pick, worker
from ._components import _solve, components

SAMPLE_ROWS = 20_000
#: The sample holds at most so many numbers.
SAMPLE_VALUES = 1 << 23
#: Bits of a rotation, and of keys at least and at most.
CODE_BITS = 64
KEY_BITS = (4, 24)
#: Vectors of the largest label that a bucket of balanced codes should hold.
BUCKET = 512
#: The share of pairs at the threshold that should meet in some table, and the most tables for it; where
#: that many don't do, keys become shorter.
RECALL, MOST_TABLES = 0.99, 64
#: Larger buckets are dealt as pairs of blocks of about this many vectors.
BLOCK = 1024


@dataclass
class Quantizer:
    mean: np.ndarray
    turn: np.ndarray  # dimension x bits: principal axes and rotations in one
    key_bits: int = 1
    tables: int = 0
    recall: float = 0.0  # measured on the sample, of pairs at the threshold

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vector, table) keys of normalised vectors."""
        bits = ((x - self.mean) @ self.turn[:, : self.tables * self.key_bits]) >= 0
        return (bits.reshape(len(x), self.tables, self.key_bits) @ (1 << np.arange(self.key_bits))).astype(np.int32)


def _axes(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.atleast_2d(np.cov((x - mean).T)) if len(x) > 1 else np.eye(x.shape[1]))
    return mean, axes[:, ::-1][:, :bits]


def _rotation(v: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """In turn, the best signs for a rotation and the best rotation (orthogonal Procrustes) for the signs."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ signs)
        turn = left @ right
    return turn


def _partners(x: np.ndarray, cosine: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors at ``cosine``: apart in any direction, and towards other vectors of the sample."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))[:4000]]
    out = []
    for away in (rng.normal(size=x.shape), x[rng.permutation(len(x))]):
        away = away - (away * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1)
        ok = size > 1e-9
        if ok.any():
            out.append((x[ok], cosine * x[ok] + np.sqrt(max(0.0, 1 - cosine * cosine)) * away[ok] / size[ok, None]))
    return out


def fit(sample: np.ndarray, *, vectors: int = 0, least_cosine: float = 0.93, recall: float = RECALL, rounds: int = 40, seed: int = 11) -> Quantizer:
    """Codes for ``vectors`` vectors of one label like those of ``sample``: keys of log2(vectors / ``BUCKET``)
    bits, and so many tables that ``recall`` of the sample's pairs at ``least_cosine`` share a key."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    mean, axes = _axes(x, min(CODE_BITS, x.shape[1]))
    v = (x - mean) @ axes
    pairs = _partners(x, least_cosine, seed)
    turns: list[np.ndarray] = []
    low, high = KEY_BITS
    wanted = int(np.clip(np.ceil(np.log2(max(vectors, 1) / BUCKET)), low, high))
    for key_bits in range(wanted, 0, -1):
        tables = 0
        while tables < MOST_TABLES:
            tables += 1
            while len(turns) * axes.shape[1] < tables * key_bits:
                turns.append(axes @ _rotation(v, rounds, seed + len(turns)))
            # A table's bits: the next of the rotations' in a row.
            made = Quantizer(mean, np.concatenate(turns, 1), key_bits, tables)
            if tables % 2 and tables > 1:
                continue
            made.recall = min([float((made.keys(a) == made.keys(b)).any(1).mean()) for a, b in pairs], default=1.0)
            if made.recall >= recall:
                return made
    return made


def _normal(raw: list[bytes], width: int) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(raw), f"<f{width}").reshape(len(raw), -1).astype(np.float64))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # first to within range, so that squares don't overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _tables(shared, width: int):
    @worker("ann")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer: Quantizer = shared.value
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(f"<f{width}").reshape(n, -1)
            raw = [row.tobytes() for row in flat]
            keys = quantizer.keys(_normal(raw, width))
            packed = pa.array([row.tobytes() for row in keys.astype("<i4")], pa.binary())
            for t in range(quantizer.tables):
                bucket = (t << 32) + keys[:, t].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(bucket), batch.column("node"), batch.column("copies"), packed, pa.array(raw, pa.binary())],
                    names=["label", "bucket", "node", "copies", "keys", "vector"],
                )

    return run


def _compare(least: float, width: int):
    def links(rows: pa.Table) -> pa.RecordBatch:
        table = int(rows.column("bucket")[0].as_py()) >> 32
        side = rows.column("side").to_numpy()
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), "<i4").reshape(len(node), -1)
        x = _normal(rows.column("vector").to_pylist(), width)
        a, b = np.flatnonzero(side <= 0), np.flatnonzero(side != 0)
        if not (side == 0).any():
            a, b = np.flatnonzero(side < 0), np.flatnonzero(side > 0)
            hit = x[a] @ x[b].T >= least
        else:
            a = b = np.arange(len(node))
            hit = np.triu(x @ x.T >= least, 1)
        i, j = np.nonzero(hit)
        i, j = a[i], b[j]
        for t in range(table):  # pairs that meet in an earlier table are counted there
            new = keys[i, t] != keys[j, t]
            i, j = i[new], j[new]
        count = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
        root = np.arange(len(node))
        if len(i):
            at, top = _solve(i, j)
            root[at] = top
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some].astype(np.int64)), pa.array(node[root[some]])], names=["node", "links", "other"])

    @worker("ann")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("label", "bucket", "low", "high")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(batch)]
            for p, q in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[p])
                if held and key != last:
                    yield links(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(batch.slice(p, q - p))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.93, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK
) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``.

    Rows link if their labels are equal and not null and the cosine (double precision) is at least
    ``least_cosine``. Null, zero, null-holding or non-finite vectors, and those of another dimension
    than most, link with nothing and are kept; so are rows without a label. Equal vectors of a label are
    compared once and counted as often as they occur; rows that repeat an id are rows of their own, a
    null id is nobody's smallest. Only a sample of ``sample_rows`` distinct vectors (those of least hash;
    ``SAMPLE_VALUES`` numbers at most) is fitted on; every vector is indexed. A pair is found if it shares
    a key: ``RECALL`` of those at the threshold, by the sample's measure, and more of those above."""
    spark = vectors.sparkSession
    own = pick(vectors, vec_id=id_col, embedding=vector_col, label=label_col)
    width = 4 if own.schema["embedding"].dataType.elementType.typeName() == "float" else 8
    size = own.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(
        F.col("label").isNotNull() & (F.size("embedding") == (size["d"] if size else 0)) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    rows = own.select("vec_id", "embedding", "label", usable.alias("usable"), F.xxhash64("label", "embedding").alias("node"))
    good = rows.where("usable")
    labels = F.xxhash64("label") if own.schema["label"].dataType.typeName() not in ("integer", "long") else F.col("label").cast("long")
    nodes = materialize(good.groupBy("node").agg(F.first("embedding").alias("embedding"), F.first(labels).alias("label"), F.count(F.lit(1)).alias("copies")))
    most = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if not most:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sampled = min(sample_rows, max(1, SAMPLE_VALUES // size["d"]))
    sample = nodes.orderBy("node").limit(sampled).select("embedding").toPandas()["embedding"]
    quantizer = fit(_unit(np.stack([np.asarray(x, np.float64) for x in sample])), vectors=most, least_cosine=least_cosine)
    indexed = materialize(nodes.mapInArrow(_tables(spark.sparkContext.broadcast(quantizer), width), "label long, bucket long, node long, copies long, keys binary, vector binary"))
    large = indexed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n")).select("label", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = indexed.join(large, ["label", "bucket"]).withColumn("mine", F.pmod("node", "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), -1).otherwise(1)
    dealt = dealt.select("label", "bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), side.alias("side"), "node", "copies", "keys", "vector")
    keys = ["label", "bucket", "low", "high"]
    found = materialize(dealt.repartition(parallelism(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_compare(least_cosine, width), "node long, links long, other long"))
    comp = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    copies = nodes.select("node", "copies")
    per_node = copies.join(links, "node", "left").join(comp, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    # The smallest ids are a table of their own before they are joined, so that the optimizer may split
    # a component that holds a large share of all rows.
    placed = materialize(good.select("vec_id", "node").join(materialize(per_node), "node"))
    least_id = materialize(placed.groupBy("comp").agg(F.min("vec_id").alias("component_id")))
    linked = placed.join(least_id, "comp").select("vec_id", F.col("n_links").cast("long"), "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
