"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word stand in a doubly linked list; a heap holds the adjacent pairs that have a
merge rank. The lowest-rank pair (leftmost among equals) is popped again and again, stale entries are
skipped, its two symbols become one and the two new neighbours are pushed. The count is the number
of initial symbols less the number of merges; no identifier is looked up or emitted.

Words recur: each worker keeps the counts of a bounded number of pieces.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Kept, pick, worker, worker_cache

#: The split that byte-level vocabularies of this family use before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a worker keeps.
CACHE_PIECES = 400_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable bytes stand for themselves, the others, in
    order, for the code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class MergeCounter:
    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        stand_in = byte_symbols()
        number: dict[str, int] = {stand_in[b]: b for b in range(256)}
        #: (left << 32 | right) -> (rank, merged symbol)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = number.setdefault(left + right, len(number))
            self.merges.setdefault(number[left] << 32 | number[right], (rank, made))
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added = added
        self.split = regex.compile(SPLIT)
        self.counts = Kept(cache_pieces)
        self.pieces = Kept(cache_pieces // 2)

    def merged(self, piece: str) -> int:
        """Tokens of one piece of the split."""
        symbol = list(piece.encode("utf-8"))
        n = len(symbol)
        if n == 1:
            return 1
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(symbol[i] << 32 | symbol[i + 1])
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = made, -1
            left -= 1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                found = merges.get(made << 32 | symbol[k])
                if found:
                    heapq.heappush(heap, (found[0], i, made, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get(symbol[h] << 32 | made)
                if found:
                    heapq.heappush(heap, (found[0], h, symbol[h], made, found[1]))
        return left

    def _run(self, text: str) -> int:
        """Tokens of a text that the split cuts as it stands."""
        total, pieces = 0, self.pieces
        for piece in self.split.findall(text):
            n = pieces.get(piece)
            if n is None:
                n = self.merged(piece)
                if len(piece) <= 64:
                    pieces.keep(piece, n)
            total += n
        return total

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings. A space between two characters that aren't white
        space always begins a new piece, so the text can be cut there first and known parts looked up."""
        parts = text.split(" ")
        counts = self.counts
        try:
            total = sum([counts[p] for p in parts[1:]])
        except KeyError:
            total = 0
            for p in parts[1:]:
                n = counts.get(p)
                if n is None:
                    if not p or p[0].isspace() or p[-1].isspace():
                        return self._run(text)
                    n = self._run(" " + p)
                    if len(p) <= 64:
                        counts.keep(p, n)
                total += n
        head = parts[0]
        if len(parts) > 1 and (not head or head[-1].isspace()):
            return self._run(text)
        return total + (self._run(head) if head else 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not any(s in text for s in self.added):
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += 1 + (self._plain(text[at : m.start()]) if m.start() > at else 0)
            at = m.end()
        return total + (self._plain(text[at:]) if at < len(text) else 0)


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > ``limit``).

    ``vocabulary``: path of a byte-level BPE file in the JSON form, on every worker. A null or empty
    text has no bytes and no tokens; special strings inside a text count one token each; repeated
    rows give repeated results. Map-only: no shuffle, memory bounded by the cache and one batch."""
    key = f"tokens:{vocabulary}"

    @worker(key)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(key, lambda: MergeCounter(vocabulary))
        for batch in batches:
            column = batch.column("text")
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            n = np.fromiter((counter.count(t.as_py()) for t in column), np.int64, len(column))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    texts = pick(docs, doc_id=id_col, text=text_col)
    counted = texts.mapInArrow(count, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
