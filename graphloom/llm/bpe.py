"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a piece has exactly one valid last token: the token that ends the encoding of
that prefix. For the next byte the candidates are the tokens that end there; the valid one is the
one that the last token of the shorter prefix may stand before (the pair encodes to itself). So an
encoding is a walk back along last tokens, appending a byte never changes what is stored, and after
an edit only prefixes from the edit on are computed again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Kept, pick, worker, worker_cache
from ._pieces import PieceStore, per_text
from ._text import Words, byte_class, text_slices

CACHE_PIECES = 600_000
CACHE_PARTS = 100_000
CACHE_PAIRS = 200_000
#: Between two of these a space doesn't surely begin a piece: ASCII white space and separators.
_BLANK = byte_class(lambda b: b == 32 or 9 <= b <= 13 or 28 <= b <= 31)
_NOT_SPACE = byte_class(lambda b: b != 32)
#: UTF-8 of white space beyond ASCII: lead byte, second byte, third bytes.
_WIDE = ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,)))


class PrefixEncoder:
    def __init__(self, path: str, pattern: str, cache_pieces: int = CACHE_PIECES, cache_pairs: int = CACHE_PAIRS):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.token = {r: t for t, r in self.rank.items()}
        self.split = regex.compile(pattern)
        self.store, self.parts, self.pairs = PieceStore("<u4", cache_pieces), Kept(CACHE_PARTS), Kept(cache_pairs)
        #: By its last four bytes, the lengths of the tokens that may end a prefix, longest first.
        self.short_tails = [3, 2, 1]
        tails: dict[bytes, set[int]] = {}
        for t in self.rank:
            if len(t) > 3:
                tails.setdefault(t[-4:], set()).add(len(t))
        self.long_tails = {k: sorted(v, reverse=True) + self.short_tails for k, v in tails.items()}
        #: Of each token, the two tokens it is merged from at last (itself alone if it is a byte).
        self.made_of: dict[int, tuple[int, int]] = {}
        for t, r in self.rank.items():
            self.made_of[r] = self._halves(t, r)

    def _halves(self, t: bytes, r: int) -> tuple[int, int]:
        """The last merge that makes token ``t``: merge its bytes by rank until two parts are left."""
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] >= r:
                return r, r
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else (r, r)

    def may_precede(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens ``a`` and ``b`` encode to just these two.

        No merge across the seam may come before the merges that make either side. Both are taken
        apart, the later merge first; a token over the seam with a lower rank refutes the pair."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = self._seam_holds(a, b)
            self.pairs.keep(key, known)
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        rank, token, made_of = self.rank, self.token, self.made_of
        bound = 1 << 40  # merges from this rank on happen too late to matter
        while True:
            over = rank.get(token[a] + token[b])
            if over is not None and over < bound:
                return False
            a_whole, b_whole = made_of[a] == (a, a), made_of[b] == (b, b)
            if a_whole and b_whole:
                return True
            # Undo the later of the two last merges. Equal ones run from left to right: one on the
            # seam comes after its equal on the left and before its equal on the right.
            if b_whole or (a > b and not a_whole):
                bound, a = a, made_of[a][1]
            else:
                bound, b = b + 1, made_of[b][0]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Append to ``last`` the last token of every longer prefix of ``piece``: entry i belongs to
        the first i + 1 bytes. Entries that are there already stay as they are."""
        rank, long_tails, short_tails, pairs = self.rank, self.long_tails, self.short_tails, self.pairs
        for end in range(len(last) + 1, len(piece) + 1):
            lengths = long_tails.get(piece[end - 4 : end], short_tails) if end > 3 else short_tails
            for n in lengths:
                at = end - n
                if at < 0:
                    continue
                t = rank.get(piece[at:end])
                if t is None:
                    continue
                if at == 0:
                    fits = n == 1 or self._whole(t)
                else:
                    fits = pairs.get(last[at - 1] << 20 | t)
                    if fits is None:
                        fits = self.may_precede(last[at - 1], t)
                if fits:
                    last.append(t)
                    break
            else:
                raise ValueError("a byte has no token in the rank file")
        return last

    def _whole(self, t: int) -> bool:
        """Whether merging the bytes of a token gives that token."""
        return len(self.token[t]) == 1 or self.made_of[t] != (t, t)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        return self.walk(piece, self.extend(piece, []))

    def walk(self, piece: bytes, last: list[int]) -> list[int]:
        out, at = [], len(piece)
        while at:
            t = last[at - 1]
            out.append(t)
            at -= len(self.token[t])
        return out[::-1]

    def edit(self, old: bytes, last: list[int], new: bytes) -> list[int]:
        """Last tokens of ``new``, given those of ``old``: only prefixes beyond the first difference
        are computed."""
        same = 0
        while same < min(len(old), len(new)) and old[same] == new[same]:
            same += 1
        return self.extend(new, last[:same])

    def _run(self, text: str) -> bytes:
        out = []
        for piece in self.split.findall(text):
            ids = self.parts.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode("utf-8")), "<u4").tobytes()
                if len(piece) <= 64:
                    self.parts.keep(piece, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self._run(text) if text else b""

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """(first row, ids of each text) of runs of a column's texts; nulls are empty.

        A space between two characters that aren't white space always begins a new piece, so texts
        whose spaces are all like that are cut there, and what is between is looked up."""
        for first, data, offsets in text_slices(column):
            plain = ~_blank_beside_space(data, offsets)
            words = Words(data, offsets, _NOT_SPACE, lower=False)
            if not len(words.start):
                yield first, [self.encode(bytes(data[a:b]).decode("utf-8")) for a, b in zip(offsets, offsets[1:], strict=False)]
                continue
            leads = words.start == offsets[words.text]

            def learn(at: list[int], words=words, leads=leads) -> list[bytes]:
                return [self._run(("" if leads[i] else " ") + words.word(i).decode("utf-8")) for i in at]

            made = self.store.encode(words, learn, leads)
            if not isinstance(made, tuple):
                plain[:] = False
                ends = np.zeros(words.texts + 1, np.int64)
            else:
                ends = np.concatenate(([0], np.cumsum(per_text(words, made[1]))))
            out = []
            for t, (a, b, is_plain) in enumerate(zip(ends.tolist(), ends[1:].tolist(), plain.tolist(), strict=False)):
                out.append(made[0][a:b].tobytes() if is_plain else self.encode(bytes(data[offsets[t] : offsets[t + 1]]).decode("utf-8")))
            yield first, out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _blank_beside_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that begin or end with a space, or have white space beside one, or any beyond ASCII."""
    blank, space = _BLANK[data], data == 32
    odd = np.zeros(len(data), bool)
    odd[1:] = space[1:] & blank[:-1]
    odd[:-1] |= space[:-1] & blank[1:]
    for lead, seconds, thirds in _WIDE:
        at = np.flatnonzero(data[:-1] == lead)
        at = at[np.isin(data[at + 1], seconds)]
        if thirds is not None and len(at):
            at = at[at + 2 < len(data)]
            at = at[np.isin(data[at + 2], thirds)]
        odd[at] = True
    filled = np.flatnonzero(offsets[:-1] < offsets[1:])
    odd[offsets[filled]] |= space[offsets[filled]]
    odd[offsets[filled + 1] - 1] |= space[offsets[filled + 1] - 1]
    sums = np.concatenate(([0], np.cumsum(odd)))
    return sums[offsets[1:]] > sums[offsets[:-1]]


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids`` (binary, little-endian unsigned 32-bit).

    ``ranks``: path of a rank file on every worker. A null or empty text has no ids. Repeated rows
    give repeated results. Map-only; memory is bounded by the caches and one batch."""
    key = f"bpe:{ranks}"

    @worker(key)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(key, lambda: PrefixEncoder(ranks, pattern))
        for batch in batches:
            for at, ids in encoder.encode_column(batch.column("text")):
                part = batch.slice(at, len(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ``encode``'s result: ``doc_id, bytes``. Null ids decode to no bytes."""
    key = f"bpe:{ranks}"

    @worker(key)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(key, lambda: PrefixEncoder(ranks, pattern))
        for batch in batches:
            texts = [encoder.decode(x.as_py() or b"") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return pick(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, bytes binary")


def with_ids(docs: DataFrame, ranks: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, with ``n_tokens`` and ``ids``. Every text is decoded again and
    compared; one that doesn't come back fails the task. Columns of these names are replaced. Null and
    empty texts have no ids; repeated rows are encoded each; an empty table stays empty."""
    key = f"bpe:{ranks}"
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])  # Arrow functions don't take names with dots
    place, names = kept.index(text_col), [*docs.columns, "n_tokens", "ids"]

    @worker(key)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(key, lambda: PrefixEncoder(ranks, pattern))
        for batch in batches:
            for at, ids in encoder.encode_column(batch.column(place)):
                part = batch.slice(at, len(ids))
                texts = [t or "" for t in part.column(place).to_pylist()]
                if any(encoder.decode(x) != t.encode("utf-8") for x, t in zip(ids, texts, strict=True)):
                    raise ValueError("a text doesn't come back from its ids")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=names)

    schema = T.StructType([*docs.schema, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.mapInArrow(run, schema).toDF(*kept, "n_tokens", "ids")


def round_trip(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, keeping digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Rows are as in ``encode``: null and empty texts have no ids and no bytes, whose digests are those of
    nothing; repeated rows give repeated results; an empty table gives none."""
    key = f"bpe:{ranks}"

    @worker(key)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(key, lambda: PrefixEncoder(ranks, pattern))
        for batch in batches:
            n, a, b = [], [], []
            for _, texts in encoder.encode_column(batch.column("text")):
                n += [len(ids) // 4 for ids in texts]
                a += [hashlib.sha256(ids).hexdigest() for ids in texts]
                b += [hashlib.sha256(encoder.decode(ids)).hexdigest() for ids in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
