"""Secret scans with corpus-wide ownership frequency.

Patterns propose candidates in every text. The hash of each candidate's value is then aggregated over
the corpus: in how many distinct repositories, and of how many distinct owners, does it occur? A
value that several owners carry, or that one owner repeats in many repositories, is a copied example;
one that is its owner's alone and in few repositories is a live-looking credential. Unlabelled
high-entropy strings are proposed too, and become spans only where their value is live-looking.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, pick, worker

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: Unlabelled strings, also right after an equals sign: at least so long, with letters of both cases and digits, and so many bits a character.
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
ENTROPY_BITS = 4.0

#: Values with more than one of so many spans are hot, so there are fewer of them than this: they are
#: broadcast to their spans, where a join by value would gather all spans of one in a task.
HOT_VALUES = 1000

SPAN = "struct<kind:string,from:int,to:int,hash:string>"


def _hash(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def _bits(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, from, to, value) in code points, end exclusive."""
    if not text:
        return []
    out = []
    folded = text.lower()
    if any(k in folded for k in KEYWORDS):
        out += [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = _Taken((a, b) for _, a, b, _ in out)
    for m in BARE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and value.lower() != value != value.upper() and _bits(value) >= ENTROPY_BITS and not taken.meets(m.start(), m.end()):
            out.append(("entropy", m.start(), m.end(), value))
    return out


class _Taken:
    """Ranges, some perhaps overlapping, that can be asked whether another one meets them."""

    def __init__(self, ranges):
        ordered = sorted(ranges)
        self.starts, self.ends = [a for a, _ in ordered], list(accumulate((b for _, b in ordered), max))

    def meets(self, a: int, b: int) -> bool:
        before = bisect.bisect_left(self.starts, b)
        return before > 0 and self.ends[before - 1] > a


@worker("secrets")
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("kind", pa.string()), ("from", pa.int32()), ("to", pa.int32()), ("hash", pa.string())])
    for batch in batches:
        spans = [[{"kind": k, "from": a, "to": b, "hash": _hash(v)} for k, a, b, v in candidates(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("repository"), batch.column("owner"), pa.array(spans, pa.list_(struct))],
            names=["doc_id", "repository", "owner", "found"],
        )


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1, max_repositories: int = 20
) -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array of ``kind, from, to, hash, repositories, owners,
    verdict``; ``verdict`` is ``live`` for a value of at most ``max_owners`` owners that is in at most
    ``max_repositories`` repositories, else ``example``.

    ``repository_col`` and ``owner_col`` are two roles and should be two columns; by default a document
    stands for a repository and its source for the owner. Unlabelled strings (kind ``entropy``) are kept
    only if ``live``. A null or empty text has no spans; null repositories or owners count as one unnamed
    one each; repeated rows are scanned each and are one repository; other columns play no part. Texts
    are read once: what the corpus aggregation shuffles is hashes, pre-aggregated per value, repository
    and owner. The counts of values in a large share of all spans, fewer than ``HOT_VALUES``, are broadcast
    to their spans; others are joined by value."""
    source = pick(docs, doc_id=id_col, text=text_col, repository=repository_col, owner=owner_col)
    found = materialize(
        source.select("doc_id", "text", F.col("repository").cast("string"), F.col("owner").cast("string"))
        .mapInArrow(_scan, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, repository string, owner string, found array<{SPAN}>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    one = found.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("s"))
    # No repository is named as an unnamed one, nor is any owner.
    held = one.select(F.col("s.hash").alias("hash"), *[F.struct(F.col(c).isNull(), F.coalesce(c, F.lit(""))).alias(c) for c in ("repository", "owner")])
    held = held.groupBy("hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    frequency = materialize(held.groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("n")))
    total = frequency.agg(F.sum("n").alias("n")).first()["n"] or 0
    is_hot = F.col("n") * HOT_VALUES > total
    hot, others = F.broadcast(frequency.where(is_hot).drop("n")), frequency.where(~is_hot).drop("n")
    named = one.select("row", "s", F.col("s.hash").alias("hash"))
    judged = named.join(hot, "hash").unionByName(named.join(hot, "hash", "left_anti").join(others, "hash"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    kept = judged.where((F.col("s.kind") != "entropy") | live)
    verdict = F.when(live, "live").otherwise("example")
    spans = kept.groupBy("row").agg(
        F.collect_list(F.struct("s.kind", "s.from", "s.to", "s.hash", "repositories", "owners", verdict.alias("verdict"))).alias("spans")
    )
    nothing = F.expr(f"cast(array() as {spans.schema['spans'].dataType.simpleString()})")
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", nothing).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["from"].alias("from"), rank[s["kind"]].alias("rank"), s["to"].alias("to"), s["kind"].alias("kind"), s["verdict"].alias("verdict"))))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")
    with_order = scanned.select("doc_id", ordered.alias("o"))
    n = lambda kind: F.size(F.filter("o", lambda s: s["kind"] == kind)).cast("long")
    return with_order.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(F.filter("o", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        joined(F.col("o")).alias("spans"),
        F.size(F.filter("o", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("o", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
    )
