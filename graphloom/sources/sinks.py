"""Writers: JSON lines, CSV, Turtle, N-Triples, TSV, JSON and Markdown reports, append to a graph."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut
from graphloom.terms import PREFIXES, TYPE


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_split(triples: DataFrame, path: str) -> None:
    triples.select("s", "p", "o").write.mode("overwrite").csv(path, sep="\t", quote="", escape="", emptyValue="")


def _escaped(c: Column) -> Column:
    for char, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(safe))
    return c


def _object(uri: Column) -> Column:
    tail = F.when(F.coalesce("o_lang", F.lit("")) != "", F.concat(F.lit("@"), F.col("o_lang"))).when(F.coalesce("o_datatype", F.lit("")) != "", F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")
    return F.when(F.col("o_kind") == "uri", uri).when(F.col("o_kind") == "bnode", F.col("o")).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail))


def _iri(c: str) -> Column:
    return F.concat(F.lit("<"), F.col(c), F.lit(">"))


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """The graph (a set) as N-Triples lines."""
    subject = F.when(F.col("s_kind") == "bnode", F.col("s")).otherwise(_iri("s"))
    return triples.distinct().select(F.concat(subject, F.lit(" "), _iri("p"), F.lit(" "), _object(_iri("o")), F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.mode("overwrite").text(path)


def _compact(c: str) -> Column:
    """A prefixed name where the rest is plain, else the IRI in brackets."""
    out = _iri(c)
    for prefix, ns in PREFIXES.items():
        rest = F.substring(F.col(c), len(ns) + 1, 1 << 30)
        out = F.when(F.startswith(c, F.lit(ns)) & F.rlike(rest, F.lit("^[A-Za-z_][A-Za-z0-9_]*$")), F.concat(F.lit(f"{prefix}:"), rest)).otherwise(out)
    return out


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """A block of Turtle per subject, predicates and objects in order."""
    verb = F.when(F.col("p") == TYPE, "a").otherwise(_compact("p"))
    line = F.concat(verb, F.lit(" "), _object(_compact("o")))
    subject = F.when(F.col("s_kind") == "bnode", F.col("s")).otherwise(_compact("s"))
    lines = triples.distinct().select(subject.alias("s"), F.struct((F.col("p") != TYPE).alias("k"), line.alias("line")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), " ;\n    ")
    return lines.groupBy("s").agg(body.alias("body")).select(F.concat("s", F.lit(" "), "body", F.lit(" .\n")).alias("value"))


def write_turtle(triples: DataFrame, path: str) -> None:
    """One Turtle file (a header, then a block per subject, streamed through the driver); for small graphs
    such as ontologies and alignments."""

    def chunks() -> Iterable[str]:
        yield "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in PREFIXES.items()) + "\n"
        for row in turtle_blocks(triples).orderBy("value").toLocalIterator():
            yield row["value"] + "\n"

    save_text(triples.sparkSession, chunks(), path)


def save_text(spark: SparkSession, chunks: Iterable[str], path: str) -> None:
    """A file of the cluster's file system (or a local one, by its URI), replaced once the new one is whole."""
    jvm = spark._jvm
    target, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(new, True)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk.encode("utf-8")))
    finally:
        out.close()
    files.delete(target, True)
    if not files.rename(new, target):
        raise OSError(f"couldn't replace {path}")


def append_graph(spark, path: str, more: DataFrame) -> int:
    """Union ``more`` into a Turtle file; returns the triples it then holds. The file is replaced once the
    new one is whole."""
    from graphloom.sources.rdf import read_graph
    from graphloom.sources.tables import exists

    whole = cut((read_graph(spark, path).unionByName(more) if exists(spark, path) else more).distinct())
    write_turtle(whole, path)
    return whole.count()


def write_json(spark: SparkSession, report: dict | list, path: str) -> None:
    save_text(spark, [json.dumps(report, indent=2, ensure_ascii=False)], path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    save_text(spark, [text], path)


def cell(text: str, longest: int = 120) -> str:
    return text.replace("\n", " ").replace("|", "/")[:longest]


def markdown_table(head: Iterable[str], rows: Iterable[Iterable[object]]) -> str:
    head = list(head)
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(cell(str(x)) for x in row) + " |" for row in rows])
