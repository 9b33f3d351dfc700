"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed letter n-grams (one to three bytes, lower case) of its words;
addresses, numbers and keys don't count. Each
language has several centroids, from spherical k-means over a bounded sample of labelled texts, which is
drawn and clustered where the data is: the driver gets centroids alone. A text
gets the language of the centroid nearest by cosine, and is rejected where even that one is too far for
a text of so many n-grams: each language has a bound of its own, from its labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import filter_batches, materialize, pick, worker
from ._text import LOWER, SLICE_BYTES, text_slices

DIMENSIONS = 4096
_BATCH = 256
UNKNOWN = "und"
#: The cosine of texts with fewer distinct n-grams than this falls with the root of their number.
_FULL = 256
#: The share of a language's labelled rows that may be odd: they don't count for its bound.
_ODD = 0.02

#: Bytes that may be in letters: a-z and all of UTF-8 beyond ASCII; others become a space.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


#: Bytes that words of no language hold: digits, @, _, /, =.
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[*range(48, 58), 64, 95, 47, 61]] = True


def _prose(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of texts, with spaces for addresses, numbers, keys and the like: all that stands between
    white space and holds an odd byte."""
    word = (data <= 32).astype(np.int32)
    begin = offsets[:-1]
    word[begin[begin < len(data)]] = 1  # a text begins a word
    word = np.cumsum(word, dtype=np.int32)
    odd = np.zeros(int(word[-1]) + 1, bool)
    odd[word[_ODD_BYTE[data]]] = True
    return np.where(odd[word], np.uint8(32), data)


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of the one, two and three bytes from each position on (0: nothing but spaces)."""
    b = LOWER[data]
    # Capitals of Latin-1 are C3 80-9E in UTF-8, their small letters 20 further on.
    capital = np.zeros(len(b), bool)
    capital[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    b = _LETTER[b + capital.astype(np.uint8) * np.uint8(32)].astype(np.uint32)
    out = []
    gram = np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        gram = gram[: len(b) - n + 1] << np.uint32(8) | b[n - 1 :] if n > 1 else b
        blank = {1: 32, 2: 32 << 8 | 32, 3: 32 << 16 | 32 << 8 | 32}[n]
        code = ((gram + np.uint32(n << 24)) * np.uint32(0x9E3779B1) >> np.uint32(32 - 12)).astype(np.int32)
        code[(gram == blank) | (code == 0)] = 0
        out.append(code)
    return tuple(out)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts): a row of n-gram counts per text, in blocks. Long texts are counted a window at
    a time, each with the byte before and the two after that its n-grams look at."""
    for first, data, offsets in text_slices(column):
        if not len(data):
            yield first, np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
            continue
        data = _prose(data, offsets)
        if len(offsets) == 2:
            total = np.zeros((1, DIMENSIONS), np.float32)
            for a in range(0, len(data), SLICE_BYTES):
                back = min(a, 1)
                for n, code in enumerate(_codes(data[a - back : a + SLICE_BYTES + 2])):
                    total[0] += np.bincount(code[back : min(back + SLICE_BYTES, len(data) - n - a + back)], minlength=DIMENSIONS)
            total[:, 0] = 0
            yield first, total
            continue
        codes = _codes(data)
        for at in range(0, len(offsets) - 1, _BATCH):
            to = min(at + _BATCH, len(offsets) - 1)
            block = np.zeros((to - at, DIMENSIONS), np.float32)
            for row in range(at, to):
                a, b = offsets[row], offsets[row + 1]
                for n, code in enumerate(codes):
                    if b - n > a:
                        block[row - at] += np.bincount(code[a : b - n], minlength=DIMENSIONS)
            block[:, 0] = 0
            yield first + at, block


@dataclass
class Centroids:
    idf: np.ndarray
    centers: np.ndarray  # normalised rows
    language: list[str]  # of each center
    nearest_least: np.ndarray  # of each center: nearness under which a text is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)


def _nearness(cosine: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cosines as of texts with n-grams enough: short ones are far from every centroid."""
    return cosine / np.sqrt(np.clip((counts > 0).sum(1), 1, _FULL) / _FULL)


def _idf(texts: int, holding: np.ndarray) -> np.ndarray:
    return np.log((1 + texts) / (1 + holding)).astype(np.float32) + 1


def _cluster(counts: np.ndarray, idf: np.ndarray, clusters: int, rounds: int, reject_share: float, seed: int) -> tuple[np.ndarray, float]:
    """(normalised centers, nearness under which a text is rejected) of one language's counts."""
    x = Centroids(idf, np.zeros((0, DIMENSIONS)), [], np.zeros(0)).vectors(counts)
    center = x[np.random.default_rng(seed).choice(len(x), min(clusters, len(x)), replace=False)]
    for _ in range(rounds):
        best = (x @ center.T).argmax(1)
        sums = np.stack([x[best == k].sum(0) if (best == k).any() else center[k] for k in range(len(center))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        center = sums / np.where(norm > 0, norm, 1)
    near = _nearness((x @ center.T).max(1), counts)
    return center.astype(np.float32), reject_share * float(np.quantile(near, _ODD, method="higher"))


def _model(idf: np.ndarray, parts: list[tuple[str, np.ndarray, float]]) -> Centroids:
    if not parts:
        return Centroids(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    return Centroids(
        idf,
        np.concatenate([center for _, center, _ in parts]),
        [language for language, center, _ in parts for _ in center],
        np.concatenate([np.full(len(center), least) for _, center, least in parts]),
    )


def fit(texts: list[str], languages: list[str], *, clusters: int = 4, rounds: int = 12, reject_share: float = 0.5, seed: int = 7) -> Centroids:
    """Centroids of labelled texts in memory. ``reject_share``: a text is rejected if its nearness is under
    this share of the least one among the labelled texts of the language, but for the ``_ODD`` least (one
    at least, where there are several)."""
    counts = np.concatenate([c for _, c in features(pa.array(texts, pa.large_string()))]) if texts else np.zeros((0, DIMENSIONS), np.float32)
    idf = _idf(len(counts), (counts > 0).sum(0))
    label = np.array(languages, object)
    return _model(idf, [(x, *_cluster(counts[label == x], idf, clusters, rounds, reject_share, seed)) for x in sorted(set(languages))])


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


@worker("langid")
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, counts in features(batch.column("text")):
            part = batch.slice(first, len(counts))
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.array([row.tobytes() for row in counts], pa.binary())], names=["lang", "place", "counts"])


def _counts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIMENSIONS)


@worker("langid")
def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature is; feature 0, which no text has, stands for all texts."""
    total = np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        if len(batch):
            total += (_counts(batch.column("counts")) > 0).sum(0)
            total[0] += len(batch)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["feature", "n"])


def learn(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1000, clusters: int = 4, rounds: int = 12, reject_share: float = 0.5, seed: int = 7
) -> Centroids:
    """Fit on ``rows_per_language`` distinct labelled texts (whole ones) of every language, or all where
    there are fewer: those with the least hashes, so copies don't count twice. Held-out rows, null labels
    and texts without a letter are left out; other options as in ``fit``.

    The texts are counted and drawn by hash, whatever their number, become vectors of fixed size in the
    map stage, and are clustered in one task a language (16 KB a text). The driver gets the centroids,
    ``clusters`` a language, which are the model."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.coalesce(held_out("doc_id"), F.lit(False)))
    rows = rows.select(F.col("lang").cast("string"), "text", F.shiftrightunsigned(F.xxhash64("text"), 2).alias("place"))
    number = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")))
    # Twice as many as are wanted, as the number is an estimate; the window takes what is over.
    upto = number.select("lang", (F.least(F.lit(1.0), F.lit(2.0 * rows_per_language) / F.col("n")) * float(1 << 62)).cast("long").alias("upto"))
    drawn = rows.join(F.broadcast(upto), "lang").where("place <= upto").groupBy("lang", "place").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("place")
    counted = drawn.mapInArrow(_count, "lang string, place long, counts binary").withColumn("at", F.row_number().over(first)).where(F.col("at") <= rows_per_language)
    sample = materialize(counted.select("lang", "place", "counts"))
    holding = np.zeros(DIMENSIONS, np.int64)
    for r in sample.select("counts").mapInArrow(_holding, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        holding[r["feature"]] = r["n"]
    texts, holding[0] = int(holding[0]), 0
    idf = _idf(texts, holding)

    @worker("langid")
    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        center, least = _cluster(_counts(table.column("counts")), idf, clusters, rounds, reject_share, seed)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "centers": [center.tobytes()], "least": [least]})

    found = sample.groupBy("lang").applyInArrow(cluster, "lang string, centers binary, least double").collect()
    return _model(idf, [(r["lang"], np.frombuffer(r["centers"], np.float32).reshape(-1, DIMENSIONS), r["least"]) for r in sorted(found, key=lambda r: r["lang"])])


def judge(column: pa.Array, model: Centroids) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, languages, scores, rejections) of the texts of a column, in blocks."""
    names = np.array([*model.language, UNKNOWN], object)
    known = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    for first, counts in features(column):
        n = len(counts)
        if len(model.centers):
            cosine = model.vectors(counts) @ model.centers.T
            best = cosine.argmax(1)
            score = np.clip(cosine[np.arange(n), best].astype(np.float64), 0, 1)
            far = _nearness(score, counts) < model.nearest_least[best]
        else:
            best, score, far = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
        ok = known[first : first + n] & (len(model.centers) > 0)
        score = np.where(ok, score, 0.0)
        yield first, names[np.where(ok, best, len(names) - 1)], score, ~ok | far


def identify(docs: DataFrame, model: Centroids, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, lang_pred, score, rejected``.

    ``und`` (score 0, rejected) for texts that are null or have no letter, and for all where nothing
    was learned. ``score``: cosine with the nearest centroid; equal ones go to the first language by
    name. ``rejected``: the score, raised for texts of few n-grams, is under the language's bound. Whole texts; map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @worker("langid")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, best, score, rejected in judge(batch.column("text"), shared.value):
                ids = batch.column("doc_id").slice(first, len(best))
                yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that ``identify`` doesn't reject, all columns as they are. Each row is judged by
    its own text, repeated ids too; null texts, texts without a letter and, where no row has a label, all
    texts go. Map-only after the fit."""
    model = learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            yield batch, ~np.concatenate([r for *_, r in judge(batch.column(place), shared.value)] or [np.zeros(0, bool)])

    return filter_batches("langid", docs, text_col, keep)
