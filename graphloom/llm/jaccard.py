"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Each text becomes its set of distinct word n-grams (56-bit hashes); equal sets are one node.
2. The few n-grams that a large share of all sets holds are found first and stay with their sets. The
   others are dealt by hash in packed blocks to count in how many sets each occurs. N-grams of one set
   can't link anything and stop here; the others go back to their sets.
3. A set orders its n-grams rare first. Sets that link must share an n-gram within their prefixes, so
   only prefix n-grams become postings.
4. Only components are asked for, so each posting list is first compared with one pivot; what that
   links is contracted, and then every pair of a posting list that is still in different components is
   taken, once, if lengths, positions and the suffix bound allow it, and verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_IDS, materialize, parallelism, pick, release, rows_of, without_ids, worker
from ._components import components
from ._text import U64, Words, byte_class, grams, mix, text_slices

#: Words are runs of anything but the space and the five control characters of ASCII white space.
WORD_BYTES = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
TOKEN_BYTES = 7
#: N-grams that a task packs together before it deals them out.
PACK_TOKENS = 1 << 19
#: N-grams in more than one of so many sets aren't dealt out to be counted: they stay with their sets and
#: count as the most frequent ones.
HEAVY_SHARE = 32
HEAVY_COUNT = (1 << 32) - 1
#: N-grams that a task should hold at a time: there are so many buckets of n-grams and parts of sets.
TASK_TOKENS = 1 << 21
#: Pivot candidates per node.
PIVOTS = 4

_PACKED = "slot int, ids array<long>, nodes binary, sizes binary, tokens binary, counts binary"
_NAMES = ["slot", "ids", "nodes", "sizes", "tokens", "counts"]
_KINDS = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _row(slot: int, ids=None, nodes=b"", sizes=b"", tokens=b"", counts=b"") -> pa.RecordBatch:
    values = [[slot], [ids], [nodes], [sizes], [tokens], [counts]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, _KINDS, strict=True)], names=_NAMES)


def _squeeze(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _narrow(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view("<u8").reshape(-1)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each distinct n-gram, its hash), by text and hash. A text of fewer than ``n`` words,
    but some, has its whole sequence as its one n-gram."""
    h = words.hashes()
    g = grams(h, n) >> U64(8)
    text = words.text[: len(g)]
    inside = text == words.text[n - 1 :] if len(g) else np.zeros(0, bool)
    g, text = g[inside], text[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        own = np.array([grams(h[words.first[t] : words.first[t + 1]], int(words.count[t]))[0] for t in short], U64) >> U64(8)
        g, text = np.concatenate((g, own)), np.concatenate((text, short))
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return text[new], g[new]


class _Pack:
    """Sets of some texts, held until they are enough to be sent on."""

    def __init__(self):
        self.ids, self.size, self.node, self.token, self.tokens = [], [], [], [], 0

    def add(self, ids: pa.Array, words: Words, n: int) -> None:
        text, g = shingle_sets(words, n)
        size = np.bincount(text, minlength=words.texts)
        # A set's own hash: a sum over its mixed n-grams, mixed again with its size.
        sums = np.zeros(words.texts, U64)
        np.add.at(sums, text, mix(g * U64(0xC2B2AE3D27D4EB4F) + U64(1)))
        for held, made in ((self.ids, ids), (self.size, size), (self.node, mix(sums ^ size.astype(U64))), (self.token, g)):
            held.append(made)
        self.tokens += len(g)

    def take(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, nodes, owners, n-grams): of equal sets only the first has its n-grams listed."""
        size, node, token = (np.concatenate(x) for x in (self.size, self.node, self.token))
        owner = np.repeat(np.arange(len(node)), size)
        first = np.zeros(len(node), bool)
        first[np.unique(node, return_index=True)[1]] = True
        keep = first[owner]
        return pa.concat_arrays(self.ids), size, node, owner[keep], token[keep]


def _packs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[_Pack]:
    pack = _Pack()
    for batch in batches:
        ids = batch.column("doc_id")
        for first, data, offsets in text_slices(batch.column("text")):
            words = Words(data, offsets, WORD_BYTES)
            pack.add(ids.slice(first, words.texts), words, n)
            if pack.tokens >= PACK_TOKENS:
                yield pack
                pack = _Pack()
    if pack.ids:
        yield pack


def _often(n: int):
    """N-grams in many sets of a pack, with how many; and, without an n-gram, the sets of the pack and
    all its n-grams."""

    @worker("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches, n):
            _, _, node, _, token = pack.take()
            sets = len(np.unique(node))
            found, many = np.unique(token, return_counts=True)
            often = many >= max(16, sets // HEAVY_SHARE)
            named = found[often].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *named], pa.int64()), pa.array([sets, *many[often].tolist()], pa.int64()), pa.array([len(token), *[0] * len(named)], pa.int64())], names=["token", "n", "size"]
            )

    return run


def measure(texts: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The n-grams of so many sets that one task shouldn't gather them, and how many n-grams there are. As
    sets hold a mean of m n-grams, at most ``HEAVY_SHARE`` * m n-grams can be in that share of them, so the
    list is short."""
    counted = texts.mapInArrow(_often(n), "token long, n long, size long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    counted = materialize(counted)
    sets = counted.where("token is null").first()
    if sets is None:
        return np.zeros(0, U64), 0
    rows = counted.where((F.col("token").isNotNull()) & (F.col("n") * HEAVY_SHARE >= sets["n"])).select("token").collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(U64)), sets["size"]


def _among(token: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(token), bool)
    return heavy[np.minimum(np.searchsorted(heavy, token), len(heavy) - 1)] == token


def _sets(n: int, buckets: int, parts: int, shared):
    """Texts to packed blocks: n-grams by bucket (slots from 0 on), and what each text is, with the heavy
    n-grams of its set, by part (slots below 0)."""
    shift = U64(8 * TOKEN_BYTES - (buckets.bit_length() - 1))

    @worker("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches, n):
            ids, size, node, owner, token = pack.take()
            is_heavy = _among(token, shared.value)
            weight = np.bincount(owner[is_heavy], minlength=len(node))
            heavy = token[is_heavy]
            part = (node % U64(parts)).astype(np.int64)
            heavy_part = part[owner[is_heavy]]
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                yield _row(-1 - p, ids.take(pa.array(mine)).to_pylist(), node[mine].tobytes(), size[mine].astype("<u4").tobytes(), _narrow(heavy[heavy_part == p]), weight[mine].astype("<u4").tobytes())
            owner, token = owner[~is_heavy], token[~is_heavy]
            bucket = (token >> shift).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                mine = order[cuts[b] : cuts[b + 1]]
                if len(mine):
                    who = owner[mine]
                    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                    many = np.diff(np.append(first, len(who)))
                    yield _row(b, None, node[who[first]].tobytes(), _squeeze(many.astype("<u4")), _narrow(token[mine]))

    return run


def _shared(parts: int):
    """One bucket: keep n-grams of two sets or more, with their counts, and send them to their sets' parts."""

    @worker("jaccard")
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(_NAMES)
        nodes, tokens = [], []
        for node, size, token in zip(table.column("nodes"), table.column("sizes"), table.column("tokens"), strict=True):
            who = np.frombuffer(node.as_py(), U64)
            nodes.append(np.repeat(who, np.frombuffer(pa.decompress(size.as_py(), 4 * len(who), codec="zstd"), "<u4")))
            tokens.append(_wide(token.as_py()))
        node, token = np.concatenate(nodes), np.concatenate(tokens)
        del nodes, tokens
        order = np.argsort(token, kind="stable")
        token, node = token[order], node[order]
        same = token[1:] == token[:-1]
        often = np.zeros(len(token), bool)
        often[1:] |= same
        often[:-1] |= same
        token, node = token[often], node[often]
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node = token[new], node[new]  # copies of a set are one
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        many = np.diff(np.append(begin, len(token)))
        count = np.repeat(many, many)
        token, node, count = token[count > 1], node[count > 1], count[count > 1]
        part = (node % U64(parts)).astype(np.int64)
        order = np.lexsort((node, part))
        token, node, count, part = token[order], node[order], count[order], part[order]
        rows = []
        for p in np.unique(part).tolist():
            a, b = np.searchsorted(part, [p, p + 1])
            first = np.flatnonzero(np.concatenate(([True], node[a + 1 : b] != node[a : b - 1])))
            each = np.diff(np.append(first, b - a))
            rows.append(_row(-1 - p, None, node[a:b][first].tobytes(), _squeeze(each.astype("<u4")), _narrow(token[a:b]), _squeeze(count[a:b].astype("<u4"))))
        return pa.Table.from_batches(rows, pa.schema(list(zip(_NAMES, _KINDS, strict=True))))

    return run


_PREFIX = "kind int, doc_id long, node long, size long, token long, pos int, place int, tokens binary"


def prefix_length(size: np.ndarray, top: int, bottom: int) -> np.ndarray:
    """How many n-grams of a set of ``size`` a linked set must share one of (Jaccard >= top/bottom)."""
    return size - -(-top * size // bottom) + 1


def _prefixes(top: int, bottom: int):
    """One part: rows of kind 0 (a text and its set), 1 (a posting) and 2 (a set with postings)."""

    @worker("jaccard")
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, nodes, sizes, owners, tokens, counts = [], [], [], [], [], []
        for row in table.select(_NAMES[1:]).to_pylist():
            who = np.frombuffer(row["nodes"], U64)
            if row["ids"] is not None:
                ids += row["ids"]
                nodes.append(who)
                sizes.append(np.frombuffer(row["sizes"], "<u4").astype(np.int64))
                owners.append(np.repeat(who, np.frombuffer(row["counts"], "<u4")))
                tokens.append(_wide(row["tokens"]))
                counts.append(np.full(len(tokens[-1]), HEAVY_COUNT, np.uint32))
            else:
                owners.append(np.repeat(who, np.frombuffer(pa.decompress(row["sizes"], 4 * len(who), codec="zstd"), "<u4")))
                tokens.append(_wide(row["tokens"]))
                counts.append(np.frombuffer(pa.decompress(row["counts"], 4 * len(tokens[-1]), codec="zstd"), "<u4"))
        node, size = np.concatenate(nodes or [np.zeros(0, U64)]), np.concatenate(sizes or [np.zeros(0, np.int64)])
        out = {"kind": np.zeros(len(node), np.int32), "doc_id": pa.array(ids, pa.int64()), "node": node.view(np.int64), "size": size}
        made = [_prefix_table(out)]
        if sum(map(len, owners)):
            owner, token, count = np.concatenate(owners), np.concatenate(tokens), np.concatenate(counts)
            order = np.lexsort((token, count, owner))
            owner, token = owner[order], token[order]
            new = np.ones(len(owner), bool)  # heavy n-grams come once from every pack with the set
            new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
            owner, token = owner[new], token[new]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            many = np.diff(np.append(first, len(owner)))
            distinct, at = np.unique(node, return_index=True)
            whole = size[at][np.searchsorted(distinct, owner[first])]
            place = np.arange(len(owner)) - np.repeat(first, many)
            pos = place + np.repeat(whole - many, many)
            in_prefix = pos < np.repeat(prefix_length(whole, top, bottom), many)
            made.append(
                _prefix_table(
                    {
                        "kind": np.ones(int(in_prefix.sum()), np.int32),
                        "node": owner[in_prefix].view(np.int64),
                        "size": np.repeat(whole, many)[in_prefix],
                        "token": token[in_prefix].view(np.int64),
                        "pos": pos[in_prefix].astype(np.int32),
                        "place": place[in_prefix].astype(np.int32),
                    }
                )
            )
            posted = np.flatnonzero(in_prefix[first])
            sets = [np.sort(token[first[i] : first[i] + many[i]]) for i in posted]
            made.append(
                _prefix_table(
                    {"kind": np.full(len(posted), 2, np.int32), "node": owner[first][posted].view(np.int64), "size": whole[posted], "tokens": pa.array([_narrow(s) for s in sets], pa.binary())}
                )
            )
        return pa.concat_tables(made)

    return run


def _prefix_table(columns: dict) -> pa.Table:
    n = len(columns["kind"])
    kinds = {"kind": pa.int32(), "doc_id": pa.int64(), "node": pa.int64(), "size": pa.int64(), "token": pa.int64(), "pos": pa.int32(), "place": pa.int32(), "tokens": pa.binary()}
    return pa.table({c: columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()})


def _verifier(top: int, bottom: int):
    """Keep pairs with intersection / union >= top/bottom. Sets hold their shared n-grams only: others
    are in no intersection."""
    ranges = (np.arange(1, 16, dtype=U64) << U64(8 * TOKEN_BYTES - 4)).astype("<u8")

    @worker("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, raw_a, raw_b in zip(*(batch.column(c).to_pylist() for c in ("size_a", "size_b", "tokens_a", "tokens_b")), strict=True):
                a, b = _wide(raw_a), _wide(raw_b)
                need = -(-top * (n_a + n_b) // (top + bottom))
                # Suffix bound: what both can share, range of hashes by range of hashes.
                cuts = [np.diff(np.concatenate(([0], np.searchsorted(x, ranges), [len(x)]))) for x in (a, b)]
                if np.minimum(*cuts).sum() < need:
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int((a[at] == b).sum())
                keep.append(bottom * both >= top * (n_a + n_b - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("u", "v")], names=["u", "v"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    a = sets.select(F.col("node").alias("u"), F.col("size").alias("size_a"), F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("node").alias("v"), F.col("size").alias("size_b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(a, "u").join(b, "v").mapInArrow(_verifier(*threshold), "u long, v long")


def join_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``. Rows link whose n-gram sets have a
    Jaccard similarity of at least ``threshold``; ``component_id`` is the smallest doc_id reachable.

    Texts without words (null, empty, white space) have no set, link with nothing and are their own
    component. Equal sets always link, repeated rows included; null ids take part, and a component of
    null ids only has a null id; other columns play no part, and an empty table gives no rows. Ids are
    long. Memory: a bucket of n-grams, a part of sets, a pair of sets at a time; there are as many buckets
    and parts as the measured number of n-grams asks for.
    """
    spark = docs.sparkSession
    top, bottom = threshold
    texts = pick(docs, doc_id=id_col, text=text_col)
    found, total = measure(texts, n)
    heavy = spark.sparkContext.broadcast(found)
    parts = max(parallelism(spark), -(-total // TASK_TOKENS))
    buckets = 1 << max(4, (parts - 1).bit_length())  # a set is named in every bucket, so no more than needed
    packed = texts.mapInArrow(_sets(n, buckets, parts, heavy), _PACKED)
    # As many tasks as there are blocks to gather, whatever the session's number of shuffle partitions is.
    shared = packed.repartition(buckets + parts, "slot").groupBy("slot").applyInArrow(_shared(parts), _PACKED)
    table = materialize(shared.repartition(parts, "slot").groupBy("slot").applyInArrow(_prefixes(top, bottom), _PREFIX))
    del packed, shared
    release(spark)  # the dealt n-grams are the largest thing on disk

    rows = table.where("kind = 0").select("doc_id", "node", "size")
    postings = table.where("kind = 1").select("token", "node", "size", "pos", "place")
    sets = table.where("kind = 2").select("node", "size", "tokens")
    near = lambda a, b: (F.lit(bottom) * F.least(a, b)) >= (F.lit(top) * F.greatest(a, b))

    # What a posting list has most in common is in the set with the fewest n-grams of its own, such as
    # the text that others were copied from.
    own = F.struct((F.col("pos") - F.col("place")).alias("own"), "node", "size")
    pivots = postings.groupBy("token").agg(F.min(own).alias("p"), F.count(F.lit(1)).alias("many")).where("many > 1").select("token", "p")
    first = (
        postings.where(F.col("place") < PIVOTS)
        .join(pivots, "token")
        .where((F.col("node") != F.col("p.node")) & near(F.col("size"), F.col("p.size")))
        .select(F.least("node", "p.node").alias("u"), F.greatest("node", "p.node").alias("v"))
        .distinct()
    )
    links = materialize(_links(first, sets, threshold))
    comp = components(links)

    # Every other pair, at the first n-gram that both prefixes hold.
    prefix = postings.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("prefix"))
    placed = postings.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    open_ = materialize(placed.join(mixed, "token").join(prefix, "node").select("token", "node", "size", "pos", "comp", F.slice("prefix", 1, F.col("place")).alias("before")))
    a = open_.select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "pos", "comp", "before")])
    b = open_.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "pos", "comp", "before")])
    need = F.ceil(F.lit(top) * (F.col("size_a") + F.col("size_b")) / F.lit(top + bottom))
    room = F.lit(1) + F.least(F.col("size_a") - F.col("pos_a") - 1, F.col("size_b") - F.col("pos_b") - 1)
    rest = a.join(
        b,
        (a["token"] == b["token"])
        & (F.col("node_a") < F.col("node_b"))
        & (F.col("comp_a") != F.col("comp_b"))
        & near(F.col("size_a"), F.col("size_b"))
        & (room >= need)
        & ~F.arrays_overlap("before_a", "before_b"),
    ).select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    more = materialize(_links(rest, sets, threshold))
    whole = components(links.unionByName(more)) if not more.isEmpty() else comp

    # The smallest ids are a table of their own before they are joined, so that the optimizer may split
    # a component that holds a large share of all rows.
    classed = materialize(rows.where("size > 0").join(whole, "node", "left").select("doc_id", "size", F.coalesce("comp", "node").alias("comp")))
    least = materialize(classed.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    linked = classed.join(least, "comp").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    alone = rows.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``docs``, all columns kept: the one with the smallest id, null ids
    last; of equal ids that of the text with the least hash.

    Rows are known by the hash of id and text, never by their place, so ``docs`` may be read again in any
    layout: rows of one id are judged each by its own text, and of rows that repeat both id and text one
    stays, the one with the least hash of its other columns. Texts without words (null, empty, white
    space) all stay. Few ids that go are broadcast; more are joined."""
    keyed = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text_col)))
    classed = materialize(join_classes(keyed, id_col="__key", text_col=text_col, **options).where("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("copies")))
    classed = classed.withColumnRenamed("doc_id", "__key")
    named = classed.join(keyed.select("__key", F.col(id_col).alias("id")).distinct(), "__key")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "__key", "copies"))
    kept = materialize(named.groupBy("component_id").agg(first.alias("first")).select("first.__key", "first.copies"))
    left = without_ids(keyed, classed.select("__key").join(kept, "__key", "left_anti"), "__key")
    repeated = kept.where("copies > 1").select("__key")
    if repeated.isEmpty():
        return left.drop("__key")
    rest = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")])
    # Repeated rows meet in one aggregation with partial results, so copies collapse where they are.
    small = F.broadcast(repeated) if rows_of(repeated) <= BROADCAST_IDS else repeated
    one = left.join(small, "__key", "left_semi").groupBy("__key").agg(F.min_by(F.struct(*rest), hashed).alias("row"))
    others = left.join(small, "__key", "left_anti").drop("__key")
    return others.unionByName(one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
