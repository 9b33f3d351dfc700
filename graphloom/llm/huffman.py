"""Token-id files: canonical length-limited Huffman codes of ids, in independent blocks.

The code is made from the counts of all ids of the corpus (package-merge bounds its lengths) and is
canonical, so a file set keeps code lengths only. A block holds whole documents in ascending id
order, the bits of their ids, and the bit offset of every ``stride``-th id; a reader starts at all
checkpoints of a block at once and steps through them with one table look-up per id.

On disk a file set is two Parquet folders: ``blocks`` (a row per block) and ``code`` (id, length).
"""

from __future__ import annotations

import json
import os
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, parallelism, pick, shared_dir, worker, worker_cache
from ._pieces import PieceStore, per_text
from ._text import Words, byte_class, text_slices

MAX_LENGTH = 18
BLOCK_TOKENS = 1 << 18
STRIDE = 128
CACHE_PIECES = 1_500_000
#: Pieces are runs of anything but ASCII white space.
PIECE_BYTES = byte_class(lambda b: b != 32 and not 9 <= b <= 13)

BLOCKS = "part int, block int, start long, doc_ids array<long>, doc_tokens array<int>, checkpoints array<long>, payload binary"


# --- the code -------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur.

    A single id gets one bit. Ties go to the smaller id."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64 if counts.sum() > 1 << 56 else np.int64)
    is_leaf, packages = [], leaves[:0]
    for _ in range(limit):
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        is_leaf.append(rank < len(leaves))
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaves) - 2
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """Canonical code: codes ascend with (length, id)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.width = int(lengths.max()) if len(used) else 1
        # As left-aligned fractions of 2**width, codes are the running sum of 2**(width - length).
        spans = (1 << (self.width - lengths[order])).astype(np.int64)
        begins = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = begins.astype(np.uint64) >> (self.width - lengths[order]).astype(np.uint64)
        self.table_id = np.zeros(1 << self.width, np.uint32)
        self.table_length = np.ones(1 << self.width, np.int64)
        n = int(spans.sum())
        self.table_id[:n] = np.repeat(order, spans)
        self.table_length[:n] = np.repeat(lengths[order], spans)

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every ``stride``-th id)."""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        at = ends - length
        if not len(ids):
            return b"", at
        words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        value = self.codes[ids] << (64 - length - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: int(ends[-1] + 7) >> 3], at[::stride]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, stride: int = STRIDE) -> np.ndarray:
        b = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at, last = np.array(checkpoints, np.int64), len(window) - 1
        out = np.empty((stride, len(at)), np.uint32)
        shift = np.uint32(32 - self.width)
        for step in range(min(stride, n)):
            look = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift
            out[step] = self.table_id[look]
            at += self.table_length[look]
        return out.T.reshape(-1)[:n]


# --- the tokenizer --------------------------------------------------------------------------------


class CachedTokenizer:
    """A word-level tokenizer of the ``tokenizers`` library that drops white space: no token reaches
    over it, so the pieces between are encoded once and looked up from then on, whole slices of texts
    at a time. The most pieces that are kept is ``cache_pieces``; those that come first are."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        # The last token of a word carries the word end.
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.lowers = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.store = PieceStore(self.kind, cache_pieces)

    # --- the library ---

    def _encode_singly(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of Latin-1 words of letters alone, in one call; word ends tell where each one's are."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._encode_singly(words)
        raw, at = ids.tobytes(), [0, *(cuts * self.width).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Beyond Latin-1, lower-casing may cut a word. Punctuation after letters is a word of its own, so
        "word.," is put together from "word" and ".,"."""
        words, tails, others, plan = {}, {}, {}, []
        for p in pieces:
            word = p.rstrip(string.punctuation)
            if word.isalpha() and (word.isascii() or max(word) < "Ā"):
                tail = p[len(word) :]
                plan.append((words.setdefault(word, len(words)), tails.setdefault(tail, len(tails)) if tail else -1))
            else:
                plan.append((-1, others.setdefault(p, len(others))))
        encoded = self._encode_words(list(words)) if words else []
        singly = self._encode_singly([*tails, *others])
        made_tails, made_others = singly[: len(tails)], singly[len(tails) :]
        join = lambda w, t: made_others[t] if w < 0 else encoded[w] if t < 0 else encoded[w] + made_tails[t]
        return [join(w, t) for w, t in plan]

    # --- slices ---

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of a slice of texts."""
        words = Words(data, offsets, PIECE_BYTES, lower=self.lowers)
        if not len(words.start):
            return np.zeros(0, self.kind), np.zeros(words.texts, np.int64)

        def learn(at: list[int]) -> list[bytes | None]:
            pieces = words.strings(at)
            if self.lowers:  # lower-casing may have made a special string: such texts go as they are
                joined = "\n".join(pieces)
                special = [x for x in self.special if x in joined]
                odd = [any(x in p for x in special) for p in pieces] if special else []
                if any(odd):
                    return [None if o else b"" for o in odd]
            return self._learn(pieces)

        made = self.store.encode(words, learn)
        if isinstance(made, tuple):
            return made[0], per_text(words, made[1])
        return self._apart(data, offsets, set(range(words.texts)) if made is None else set(words.text[made].tolist()))

    def _apart(self, data: np.ndarray, offsets: np.ndarray, odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for t in range(len(offsets) - 1):
            text = data[offsets[t] : offsets[t + 1]]
            x = np.frombuffer(self._encode_singly([bytes(text).decode("utf-8")])[0], self.kind) if t in odd else self._slice(text, np.array([0, len(text)]))[0]
            ids.append(x)
            counts.append(len(x))
        return np.concatenate(ids), np.array(counts, np.int64)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ids per text) of runs of a column's texts; nulls are empty."""
        for first, data, offsets in text_slices(column):
            yield first, *self._slice(data, offsets)


# --- writing and reading --------------------------------------------------------------------------


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    key = f"huffman:{tokenizer}"

    @worker(key)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(key, lambda: CachedTokenizer(tokenizer))
        width = encoder.width
        end, cuts = np.array([end_id], f"<u{width}").tobytes(), np.array(bounds, np.int64)
        counts = np.zeros(max(end_id + 1, len(encoder.ends)), np.int64)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for first, flat, n in encoder.encode(batch.column("text")):
                counts += np.bincount(flat, minlength=len(counts))
                counts[end_id] += len(n)
                ends = np.cumsum(n)
                ids = [flat[b - k : b].tobytes() + end for k, b in zip(n.tolist(), ends.tolist(), strict=True)]
                part = doc_ids.slice(first, len(n))
                place = np.searchsorted(cuts, part.fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
                columns = [part, place, n + 1, np.full(len(n), width), [pa.compress(x, codec="zstd", asbytes=True) for x in ids]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds, strict=True)], names=names)
        # The last row of a task has no part; it holds what the task has counted.
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, None, None, counts.tobytes()), kinds, strict=True)], names=names)

    names, kinds = ["doc_id", "part", "n", "width", "ids"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return docs.mapInArrow(run, "doc_id long, part int, n int, width int, ids binary")


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for n, width, ids in zip(batch.column("n").to_pylist(), batch.column("width").to_pylist(), batch.column("ids"), strict=True):
        yield np.frombuffer(pa.decompress(ids.as_py(), n * width, codec="zstd"), f"<u{width}")


@worker("huffman")
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("ids"):
            total = np.frombuffer(x.as_py(), np.int64)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def _block_writer(lengths: np.ndarray, starts: dict[int, int], block_tokens: int):
    @worker("huffman")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        part, number, start = None, 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start, size
            payload, checkpoints = code.encode(np.concatenate(held).astype(np.int64))
            row = [[part], [number], [start], [list(doc_ids)], [[len(x) for x in held]], [checkpoints.tolist()], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            number, start = number + 1, start + size
            doc_ids.clear()
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "start", "doc_ids", "doc_tokens", "checkpoints", "payload"])

        for batch in batches:
            for doc_id, p, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), _ids(batch), strict=True):
                if p != part:
                    if held:
                        yield flush()
                    part, number, start = p, 0, starts[p]
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of all texts, each followed by ``end_id``, to a file set at ``path``.

    Null texts are empty and give the end id alone; equal doc_ids stay neighbours, in order of
    length; null doc_ids come first; an empty table makes an empty file set; other columns play no part.
    Ids are long. Texts are tokenised once; what is dealt by id range is compressed ids. The driver holds one count per vocabulary
    entry and one total per part."""
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col)
    parts = parallelism(spark)
    cuts = texts.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts")).first()["cuts"] or []
    made = materialize(_tokenized(texts, tokenizer, end_id, sorted(set(cuts))))
    ids = made.where("part is not null")
    counted = made.where("part is null").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_length)
    starts, total = {}, 0
    for r in sorted(ids.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        starts[r["part"]] = total
        total += r["n"]
    dealt = ids.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "n", "ids")
    dealt.mapInArrow(_block_writer(lengths, starts, block_tokens), BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths).tolist()
    spark.createDataFrame([(i, int(lengths[i])) for i in used], "id long, length int").coalesce(1).write.mode("overwrite").parquet(f"{path}/code")


def _decoded(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    table = {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/code").collect()}
    lengths = np.zeros(max(table, default=0) + 1, np.int64)
    lengths[list(table)] = list(table.values())
    return spark.read.parquet(f"{path}/blocks"), lengths


def _reader(lengths: np.ndarray, emit, names: list[str], kinds: list[pa.DataType]):
    @worker("huffman")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c, row=row, batch=batch: batch.column(c)[row]
                sizes = get("doc_tokens").values.to_numpy()
                ids = code.decode(get("payload").as_py(), get("checkpoints").values.to_numpy(), int(sizes.sum()))
                ends = np.cumsum(sizes)
                made = [emit(ids[b - n : b]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                start = get("start").as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays([get("doc_ids").values, pa.array(start), pa.array(sizes.astype(np.int64)), pa.array(made, kinds[-1])], names=names)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: ``doc_id, start, n_tokens, ids`` (array), in no order. Null and repeated
    doc_ids come back as they were written; an empty file set has no rows. A task holds one block."""
    blocks, lengths = _decoded(spark, path)
    names = ["doc_id", "start", "n_tokens", "ids"]
    return blocks.mapInArrow(_reader(lengths, lambda x: x.astype(np.int64), names, [pa.list_(pa.int64())]), "doc_id long, start long, n_tokens long, ids array<long>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: ``doc_id, start, n_tokens, ids_crc32`` (unsigned, of the ids as
    little-endian unsigned 32-bit integers); rows as in ``read``."""
    blocks, lengths = _decoded(spark, path)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return blocks.mapInArrow(_reader(lengths, lambda x: zlib.crc32(x.astype("<u4").tobytes()), names, [pa.int64()]), "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, which goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path
