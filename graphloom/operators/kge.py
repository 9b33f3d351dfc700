"""Embedding training (TransE, DistMult, ComplEx), evaluation, sensitivity runs and 2-d maps.

Rounds of data-parallel training: each worker runs some epochs of minibatch Adam on its part of the
triples from the shared parameters, and the results are averaged. The parameter tables are what a
model is; ``max_parameters`` bounds them, since each worker holds them whole."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import keyword_class
from graphloom.operators import splits
from graphloom.plans.fixpoint import cut
from graphloom.sources.tables import dictionaries, encode_ids
from graphloom.terms import CLASS_COLOURS

MODELS = ("TransE", "DistMult", "ComplEx")


@dataclass
class Model:
    kind: str
    entities: np.ndarray
    relations: np.ndarray
    entity_ids: dict[str, int]
    relation_ids: dict[str, int]


def score(kind: str, h: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Scores over the last axis; ComplEx rows hold real then imaginary halves."""
    if kind == "TransE":
        return -np.abs(h + r - t).sum(-1)
    if kind == "DistMult":
        return (h * r * t).sum(-1)
    n = h.shape[-1] // 2
    a, b, c, d, e, f = h[..., :n], h[..., n:], r[..., :n], r[..., n:], t[..., :n], t[..., n:]
    return (a * c * e + a * d * f + b * c * f - b * d * e).sum(-1)


def gradients(kind: str, h: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if kind == "TransE":
        g = -np.sign(h + r - t)
        return g, g, -g
    if kind == "DistMult":
        return r * t, h * t, h * r
    n = h.shape[-1] // 2
    a, b, c, d, e, f = h[..., :n], h[..., n:], r[..., :n], r[..., n:], t[..., :n], t[..., n:]
    j = lambda x, y: np.concatenate((x, y), -1)
    return j(c * e + d * f, c * f - d * e), j(a * e + b * f, a * f - b * e), j(a * c - b * d, a * d + b * c)


def corrupt(triples: np.ndarray, n_entities: int, rng: np.random.Generator) -> np.ndarray:
    """One negative each: head or tail replaced."""
    bad = triples.copy()
    head = rng.random(len(bad)) < 0.5
    other = rng.integers(0, n_entities, len(bad))
    bad[head, 0], bad[~head, 2] = other[head], other[~head]
    return bad


@dataclass
class Adam:
    """Moments of a parameter table; rows that a batch doesn't touch stay as they are."""

    mean: np.ndarray
    square: np.ndarray
    steps: int = 0

    @classmethod
    def of(cls, parameters: np.ndarray) -> "Adam":
        return cls(np.zeros_like(parameters), np.zeros_like(parameters))

    def step(self, parameters: np.ndarray, rows: np.ndarray, gradient: np.ndarray, lr: float) -> None:
        self.steps += 1
        self.mean[rows] = 0.9 * self.mean[rows] + 0.1 * gradient
        self.square[rows] = 0.999 * self.square[rows] + 0.001 * gradient * gradient
        mean, square = self.mean[rows] / (1 - 0.9**self.steps), self.square[rows] / (1 - 0.999**self.steps)
        parameters[rows] -= lr * mean / (np.sqrt(square) + 1e-8)


def run_epoch(kind: str, e: np.ndarray, r: np.ndarray, triples: np.ndarray, lr: float, batch: int, margin: float, seed: int, adam: tuple[Adam, Adam] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass of minibatch Adam on the margin loss (TransE) or the logistic loss (others)."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(triples))
    adam = adam or (Adam.of(e), Adam.of(r))
    loss = 0.0
    for at in range(0, len(order), batch):
        pos = triples[order[at : at + batch]]
        neg = corrupt(pos, len(e), rng)
        sides = [(x, score(kind, e[x[:, 0]], r[x[:, 1]], e[x[:, 2]])) for x in (pos, neg)]
        if kind == "TransE":
            slack = margin - sides[0][1] + sides[1][1]
            loss += np.maximum(slack, 0).sum()
            active = (slack > 0).astype(float)
            weights = (-active, active)
        else:
            p = [1 / (1 + np.exp(-np.clip(s, -30, 30))) for _, s in sides]
            loss -= np.log(p[0] + 1e-12).sum() + np.log(1 - p[1] + 1e-12).sum()
            weights = (p[0] - 1, p[1])
        found = ([], [])
        for (x, _), w in zip(sides, weights, strict=True):
            h, q, t = gradients(kind, e[x[:, 0]], r[x[:, 1]], e[x[:, 2]])
            found[0].extend(((x[:, 0], w[:, None] * h), (x[:, 2], w[:, None] * t)))
            found[1].append((x[:, 1], w[:, None] * q))
        for table, state, parts in zip((e, r), adam, found, strict=True):
            rows, place = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
            gradient = np.zeros((len(rows), table.shape[1]))
            np.add.at(gradient, place, np.concatenate([g for _, g in parts]))
            state.step(table, rows, gradient / len(pos), lr)
    if kind == "TransE":
        e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1.0)
    return e, r, loss / max(1, len(triples))


def train(
    spark: SparkSession, train_triples: DataFrame, kind: str = "TransE", dim: int = 128, lr: float = 0.01, batch: int = 512, epochs: int = 100, margin: float = 1.0, seed: int = 42, workers: int = 1,
    local_epochs: int = 10, max_parameters: int = 200_000_000,
) -> tuple[Model, list[float]]:
    """Fit a model; returns it and the loss by epoch. Given the workers, a run is deterministic.

    A round is ``local_epochs`` epochs of every worker on its part of the triples, with Adam's moments kept
    through the round (with one worker, through all rounds, which are one); then the workers' parameters
    are averaged, weighted by their rows, in an aggregation by blocks of rows, not at the driver."""
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}")
    entities, relations = dictionaries(train_triples)
    ids = lambda df: {r[0]: r["id"] for r in df.toLocalIterator()}
    width = 2 * dim if kind == "ComplEx" else dim
    n = entities.count()
    if n * width > max_parameters:
        raise ValueError(f"{n * width} parameters; the bound is {max_parameters}")
    entity_ids, relation_ids = ids(entities), ids(relations)
    rng = np.random.default_rng(seed)
    scale = 6 / np.sqrt(width)
    e = rng.uniform(-scale, scale, (len(entity_ids), width))
    r = rng.uniform(-scale, scale, (len(relation_ids), width))
    encoded = cut(encode_ids(train_triples, train_triples).withColumn("w", F.pmod(F.xxhash64("s_id", "p_id", "o_id"), F.lit(workers)).cast("int")))
    losses: list[float] = []
    per_round = epochs if workers == 1 else local_epochs
    for first in range(0, epochs, per_round):
        shared = spark.sparkContext.broadcast((e, r))
        work = _round(kind, shared, range(first, min(epochs, first + per_round)), lr, batch, margin, seed)
        made = encoded.groupBy("w").applyInArrow(work, "block long, weight long, numbers binary").groupBy("block").applyInArrow(_mean, "block long, numbers binary")
        for row in made.toLocalIterator():
            values, at = np.frombuffer(row["numbers"]), row["block"] & ((1 << 40) - 1)
            if row["block"] >> 40 == 2:
                losses += values.tolist()
            else:
                target = (e, r)[row["block"] >> 40]
                target[at * ROWS : (at + 1) * ROWS] = values.reshape(-1, width)
        shared.unpersist()
    return Model(kind, e, r, entity_ids, relation_ids), losses


#: Rows of a parameter table that are averaged and sent together.
ROWS = 4096


def _round(kind: str, shared, epochs: range, lr: float, batch: int, margin: float, seed: int):
    """A worker's epochs over its triples: its parameters and losses, by blocks, times its rows."""

    def work(table):
        rows = np.stack([table.column(c).to_numpy() for c in ("s_id", "p_id", "o_id")], 1)
        rows = rows[np.lexsort(rows.T)]
        e, r = (x.copy() for x in shared.value)
        adam, lost = (Adam.of(e), Adam.of(r)), []
        for epoch in epochs:
            e, r, loss = run_epoch(kind, e, r, rows, lr, batch, margin, seed * 100_003 + epoch, adam)
            lost.append(loss)
        blocks = [(name << 40 | at // ROWS, values[at : at + ROWS]) for name, values in ((0, e), (1, r)) for at in range(0, len(values), ROWS)]
        blocks.append((2 << 40, np.array(lost)))
        columns = {"block": [b for b, _ in blocks], "weight": [len(rows)] * len(blocks), "numbers": [(x * len(rows)).tobytes() for _, x in blocks]}
        return pa.table(columns, pa.schema([("block", pa.int64()), ("weight", pa.int64()), ("numbers", pa.binary())]))

    return work


def _mean(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("numbers")) / sum(table.column("weight").to_pylist())
    return pa.table({"block": table.column("block")[:1], "numbers": pa.array([total.tobytes()], pa.binary())})


def evaluate(model: Model, test: DataFrame, known: DataFrame) -> dict[str, float]:
    """Filtered realistic ranks of both sides over ``test``, as MRR and hits. Test rows are scored in Arrow
    batches against all entities; the known triples of each test row come along, grouped by its pair."""
    spark = test.sparkSession
    maps = spark.sparkContext.broadcast((model.entity_ids, model.relation_ids))
    shared = spark.sparkContext.broadcast((model.kind, model.entities, model.relations))
    asked = test.select("s", "p", "o")
    # Only pairs that test rows ask about are gathered; a list is at most all entities, which a worker holds anyway.
    tails = known.join(asked.select("s", "p").distinct(), ["s", "p"], "left_semi").groupBy("s", "p").agg(F.collect_set("o").alias("tails"))
    heads = known.join(asked.select("p", "o").distinct(), ["p", "o"], "left_semi").groupBy("p", "o").agg(F.collect_set("s").alias("heads"))
    rows = test.select("s", "p", "o").join(tails, ["s", "p"], "left").join(heads, ["p", "o"], "left").select("s", "p", "o", "heads", "tails")

    def run(batches):
        kind, e, r = shared.value
        entity, relation = maps.value
        for b in batches:
            sides, found = [], []
            for row in b.to_pylist():
                if row["s"] not in entity or row["o"] not in entity or row["p"] not in relation:
                    continue
                s, p, o = entity[row["s"]], relation[row["p"]], entity[row["o"]]
                for side, scores, true, others in (("head", score(kind, e, r[p], e[o]), s, row["heads"]), ("tail", score(kind, e[s], r[p], e), o, row["tails"])):
                    skip = [entity[x] for x in others or () if x in entity and entity[x] != true]
                    x = scores[true]
                    scores = np.delete(scores, [*skip, true])
                    sides.append(side)
                    found.append(1 + float((scores > x).sum()) + float((scores == x).sum()) / 2)
            yield pa.RecordBatch.from_arrays([pa.array(sides, pa.string()), pa.array(found, pa.float64())], names=["side", "rank"])

    from graphloom.operators.vectors import rank_metrics

    by = {m["side"]: m for m in rank_metrics(rows.mapInArrow(run, "side string, rank double")).collect()}
    out = {f"mrr_{side}": by[side]["mrr"] if side in by else None for side in ("both", "head", "tail")}
    return {"model": model.kind} | out | {f"hits_at_{k}": by["both"][f"hits_at_{k}"] if "both" in by else None for k in (1, 3, 10)}


def sensitivity(spark: SparkSession, train_triples: DataFrame, test: DataFrame, known: DataFrame, sizes: tuple[int | None, ...] = (20_000, 50_000, None), kinds: tuple[str, ...] = ("TransE", "ComplEx"), **options) -> list[dict]:
    """A model per size (None: all) and kind; sizes at or over all rows are the same experiment."""
    rows = []
    for size in sizes:
        part = train_triples if size is None else splits.sample(train_triples, size)
        n = part.count()
        for kind in kinds:
            model, _ = train(spark, part, kind, **options)
            m = evaluate(model, test, known)
            rows.append({"model": kind, "subset": "full" if size is None else f"{size:,}", "n_train": n, "mrr": m["mrr_both"], "hits_10": m["hits_at_10"]})
    return rows


def embeddings(model: Model, spark: SparkSession) -> DataFrame:
    names = sorted(model.entity_ids, key=model.entity_ids.get)
    return spark.createDataFrame([(i, n, [float(x) for x in model.entities[i]]) for i, n in enumerate(names)], "id long, label string, vector array<double>")


def save_model(model: Model, spark: SparkSession, path: str) -> None:
    """A model as tables: entities and relations (id, label, vector) and its kind."""
    embeddings(model, spark).write.mode("overwrite").parquet(f"{path}/entities")
    names = sorted(model.relation_ids, key=model.relation_ids.get)
    relations = [(i, n, [float(x) for x in model.relations[i]]) for i, n in enumerate(names)]
    spark.createDataFrame(relations, "id long, label string, vector array<double>").write.mode("overwrite").parquet(f"{path}/relations")
    spark.createDataFrame([(model.kind,)], "kind string").write.mode("overwrite").parquet(f"{path}/kind")


def load_model(spark: SparkSession, path: str, max_parameters: int = 200_000_000) -> Model:
    """What ``save_model`` wrote; labels are the ids as text where a table has none."""
    found = {}
    for part in ("entities", "relations"):
        table = spark.read.parquet(f"{path}/{part}")
        label = F.col("label") if "label" in table.columns else F.col("id").cast("string")
        width = table.select(F.size("vector").alias("w")).first()["w"]
        if table.count() * width > max_parameters:
            raise ValueError(f"more than {max_parameters} parameters")
        rows = sorted(table.select("id", label.alias("label"), "vector").toLocalIterator(), key=lambda r: r["id"])
        found[part] = (np.array([r["vector"] for r in rows]), {r["label"]: i for i, r in enumerate(rows)})
    kind = spark.read.parquet(f"{path}/kind").first()["kind"]
    return Model(kind, found["entities"][0], found["relations"][0], found["entities"][1], found["relations"][1])


def coordinates(vectors: DataFrame, method: str = "tsne", most: int = 2000, **options) -> DataFrame:
    """(id, label, x, y, class, colour) of at most ``most`` embeddings (``id, label, vector``), by a hash of
    the label where there are more: what a plot of the space shows."""
    spark = vectors.sparkSession
    rows = vectors.orderBy(F.xxhash64("label"), "id").limit(most).collect()
    xy = project(np.array([r["vector"] for r in rows], float), method, **options) if rows else []
    out = spark.createDataFrame([(r["id"], r["label"], float(a), float(b)) for r, (a, b) in zip(rows, xy, strict=True)], "id long, label string, x double, y double")
    colours = F.create_map(*[F.lit(v) for pair in CLASS_COLOURS.items() for v in pair])
    return out.withColumn("class", keyword_class("label")).withColumn("colour", colours[F.col("class")])


def project(vectors: np.ndarray, method: str = "tsne", perplexity: float | None = None, rounds: int = 1000, seed: int = 42) -> np.ndarray:
    """2-d coordinates of a bounded set of vectors: PCA, or t-SNE started from it."""
    x = vectors - vectors.mean(0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    y = x @ axes[:2].T
    if method == "pca" or len(x) < 4:
        return y
    n = len(x)
    perplexity = perplexity or min(30, max(5, n // 3))
    d = np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            w = np.exp(-(d[i] - np.delete(d[i], i).min()) * beta)
            w[i] = 0
            w /= w.sum()
            entropy = -(w[w > 0] * np.log(w[w > 0])).sum()
            if abs(entropy - np.log(min(perplexity, n - 1))) < 1e-5:
                break
            if entropy > np.log(perplexity):
                low, beta = beta, beta * 2 if high == np.inf else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i] = w
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = y / (np.abs(y).max() + 1e-12) * 1e-2 + np.random.default_rng(seed).normal(size=y.shape) * 1e-4
    step, gain = np.zeros_like(y), np.ones_like(y)
    for it in range(rounds):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(q, 0)
        force = (p * (12 if it < 250 else 1) - np.maximum(q / q.sum(), 1e-12)) * q
        grad = 4 * ((force.sum(1)[:, None] * y) - force @ y)
        gain = np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8).clip(0.01)
        step = (0.5 if it < 250 else 0.8) * step - max(n / 48, 50) * gain * grad
        y = y + step
        y -= y.mean(0)
    return y


def format_comparison(reports: list[dict]) -> str:
    names = ("mrr_both", "mrr_head", "mrr_tail", "hits_at_1", "hits_at_3", "hits_at_10")
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "n/a"
    return "\n".join([f"{'model':<10}" + "".join(f"{n:>12}" for n in names), *(f"{r['model']:<10}" + "".join(f"{show(r.get(n)):>12}" for n in names) for r in reports)])
