"""Benchmark decontamination by winnowing.

A *span* is ``span`` consecutive words of a benchmark item (an item of fewer words, but not none, is
one span). Of every run of ``span - k + 1`` k-gram hashes the smallest is kept, in the items and in
the texts alike, so each shared span leaves at least one shared fingerprint; each shared fingerprint
is then extended word by word, left and right, and counts only if the equal stretch covers a whole
span. Spans of different lengths (short items) are winnowed apart, by the same rule.

The benchmark side is a stated query set: it is taken in blocks of bounded size, and each block's
fingerprint index is broadcast. The texts pass once, map-side and without a shuffle: a worker takes a
bounded run of texts through one index after the other, so a row's hits meet where the row is and the
number of blocks changes nothing in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import filter_batches, pick, worker
from ._text import U64, Words, byte_class, grams, text_slices

#: Words are runs of a-z (after lower-casing A-Z), 0-9 and everything beyond ASCII.
WORD_BYTES = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
MAX_GRAM = 5
#: Texts that a worker takes through all blocks before the next ones, where there are several blocks.
RUN_BYTES = 32 << 20
_FAR = U64(2**64 - 1)


def _winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the k-gram hashes that are the smallest of some run of ``window`` of them."""
    if len(g) < window:
        return np.zeros(0, np.int64)
    low, width = g, 1
    while width < window:  # minimum over runs, by doubling
        step = min(width, window - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    padded = np.zeros(len(low) + 2 * (window - 1), U64)
    padded[window - 1 : window - 1 + len(low)] = low
    high, width = padded, 1
    while width < window:
        step = min(width, window - width)
        high, width = np.maximum(high[:-step], high[step:]), width + step
    return np.flatnonzero((high == g) & (g != _FAR))


def _fingerprints(words: Words, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, hashes) kept for spans of ``length`` words."""
    k = min(MAX_GRAM, length)
    g = grams(h, k)
    if len(g):
        g[words.text[: len(g)] != words.text[k - 1 :]] = _FAR
    at = _winnow(g, length - k + 1)
    return at, g[at]


class SpanIndex:
    """Fingerprints of a block of benchmark items and their words, for exact extension; all in arrays."""

    def __init__(self, items: list[tuple[str | None, str]], span: int):
        self.ids = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.large_string())
        texts, starts, ends, counts = [b""], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        posted: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0
        for first, data, offsets in text_slices(column):
            words = Words(data, offsets, WORD_BYTES)
            texts.append(words.data.tobytes())
            starts.append(words.start + size)
            ends.append(words.end + size)
            counts.append(words.count)
            size += len(words.data)
            h = words.hashes()
            lengths = np.minimum(words.count, span)
            for length in np.unique(lengths[lengths > 0]).tolist():
                at, hashes = _fingerprints(words, h, length)
                owner = words.text[at]
                own = lengths[owner] == length
                posted.setdefault(length, []).append((hashes[own], first + owner[own], (at - words.first[owner])[own]))
        self.text = b"".join(texts)
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        #: length -> (distinct fingerprints, where each one's postings begin and end, items, positions)
        self.found = {}
        for length, parts in posted.items():
            hashes, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, item, hashes))
            keys, begin = np.unique(hashes[order], return_index=True)
            self.found[length] = (keys, np.append(begin, len(order)), item[order], place[order])

    def word(self, i: int) -> bytes:
        return self.text[self.start[i] : self.end[i]]


def _scan(words: Words, index: SpanIndex) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """Per text the hit word ranges (relative to the text) and the items that occur."""
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(words.texts)]
    items: list[set[int]] = [set() for _ in range(words.texts)]
    h = words.hashes()
    cache: dict[int, bytes] = {}

    def word(i: int) -> bytes:
        if i not in cache:
            cache[i] = words.word(i)
        return cache[i]

    for length, (keys, begin, posted_items, posted_places) in index.found.items():
        at, g = _fingerprints(words, h, length)
        where = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = keys[where] == g
        done: dict[tuple[int, int], int] = {}  # (item, diagonal): words up to here are compared
        for p, key in zip(at[hit].tolist(), where[hit].tolist(), strict=True):
            text = int(words.text[p])
            first, last = int(words.first[text]), int(words.first[text + 1])
            postings = slice(int(begin[key]), int(begin[key + 1]))
            for item, q in zip(posted_items[postings].tolist(), posted_places[postings].tolist(), strict=True):
                if done.get((item, p - q), -1) > p:
                    continue
                base, size = int(index.first[item]), int(index.first[item + 1] - index.first[item])
                left, right = 0, 0
                while left < min(p - first, q) and word(p - left - 1) == index.word(base + q - left - 1):
                    left += 1
                while right < min(last - p, size - q) and word(p + right) == index.word(base + q + right):
                    right += 1
                done[item, p - q] = p + max(right, 1)
                if left + right >= length:
                    ranges[text].append((p - left - first, p + right - first))
                    items[text].add(item)
    return ranges, items


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _hits(batches: Iterator[pa.RecordBatch], place: int, blocks: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list, list]]:
    """Each batch with its texts' word counts, hit ranges (a union) and names of items that occur.

    One block stays in memory; of several, each is loaded for a run of texts and let go."""
    several = len(blocks) > 1
    held: list[pa.RecordBatch] = []
    size = 0

    def through() -> Iterator[tuple[pa.RecordBatch, np.ndarray, list, list]]:
        count = [np.zeros(len(b), np.int64) for b in held]
        ranges = [[[] for _ in range(len(b))] for b in held]
        names: list[list[set]] = [[set() for _ in range(len(b))] for b in held]
        for block in blocks:
            index: SpanIndex = block.value
            for k, batch in enumerate(held):
                for first, data, offsets in text_slices(batch.column(place)):
                    words = Words(data, offsets, WORD_BYTES)
                    count[k][first : first + words.texts] = words.count
                    found, items = _scan(words, index)
                    for t in range(words.texts):
                        if found[t]:
                            ranges[k][first + t] += found[t]
                            names[k][first + t].update((index.ids[i] is not None, index.ids[i] if index.ids[i] is not None else i) for i in items[t])
            if several:
                del index
                vars(block).pop("_value", None)
        for k, batch in enumerate(held):
            yield batch, count[k], [_union(r) for r in ranges[k]], [sorted(n for named, n in x if named) + [None] * any(not named for named, _ in x) for x in names[k]]

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if not several or size >= RUN_BYTES:
            yield from through()
            held, size = [], 0
    if held:
        yield from through()


def _blocks(benchmark: DataFrame, block_bytes: int, span: int) -> list[Broadcast]:
    """The benchmark's indexes, built one at a time and broadcast; at least one, if an empty one."""
    sc = benchmark.sparkSession.sparkContext
    out, block, size = [], [], 0
    for row in benchmark.toLocalIterator():
        if row["text"] is None:
            continue
        if block and size + len(row["text"]) > block_bytes:
            out.append(sc.broadcast(SpanIndex(block, span)))
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block or not out:
        out.append(sc.broadcast(SpanIndex(block, span)))
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 13,
    min_share: tuple[int, int] = (1, 20),
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items (array), hits (array of word
    ranges), contaminated``. ``contaminated``: some word is hit and n_hit / n_words >= ``min_share``.

    Each row is judged by itself, repeated ids too. Null or wordless texts have zero words and no hits;
    an empty benchmark hits nothing; items without words (or null) never occur; equal items all occur.
    Several item rows with one id count once; items without an id count once together and are null in
    ``items``. Memory: ``block_bytes`` bounds the benchmark text that is indexed and held at a time,
    ``RUN_BYTES`` the texts (one longer text is a run of its own)."""
    ids = docs.schema[id_col].dataType
    texts = pick(docs, doc_id=id_col, text=text_col)
    items = pick(benchmark, item_id=item_id_col, text=item_text_col).select(F.col("item_id").cast("string"), "text")
    blocks = _blocks(items, block_bytes, span)
    ranges = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    @worker("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, count, hits, names in _hits(batches, 1, blocks):
            spans = pa.array([[{"from": a, "to": b} for a, b in r] for r in hits], ranges)
            n_hit = pa.array([sum(b - a for a, b in r) for r in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), n_hit, pa.array(names, pa.list_(pa.string())), spans], names=["doc_id", "n_words", "n_hit", "items", "hits"])

    top, bottom = min_share
    return (
        texts.mapInArrow(run, f"doc_id {ids.simpleString()}, n_words long, n_hit long, items array<string>, hits array<struct<from:int,to:int>>")
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "hits")
        .withColumn("contaminated", (F.col("n_hit") > 0) & (bottom * F.col("n_hit") >= top * F.col("n_words")))
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_text_col: str = "text",
    span: int = 13,
    min_share: tuple[int, int] = (1, 20),
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of ``docs`` that ``contamination`` doesn't call contaminated, all columns as they are.

    Each row is kept or dropped by its own text, whatever its id; null and wordless texts stay, and an
    empty ``docs`` or benchmark is no special case. Rows are filtered as they are scanned."""
    items = pick(benchmark, text=item_text_col).select(F.lit(None).cast("string").alias("item_id"), "text")
    blocks = _blocks(items, block_bytes, span)
    top, bottom = min_share

    def keep(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch, count, hits, _ in _hits(batches, place, blocks):
            hit = np.array([sum(b - a for a, b in r) for r in hits], np.int64)
            yield batch, (hit == 0) | (bottom * hit < top * count)

    return filter_batches("decontaminate", docs, text_col, keep)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

