"""RDF text: N-Triples (distributed, by line), Turtle and RDF/XML (small files, parsed at the driver)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.sparql_parser import Const, Parser
from graphloom.terms import RDF, TRIPLE_SCHEMA

LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*\.\s*(?:#.*)?$'

NO_TRIPLE = r"^\s*(#.*)?$"


def _unescaped(c: Column) -> Column:
    """Backslash escapes undone: the common ones left to right by splitting, code points by number."""
    simple = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'"}
    pieces = F.split(c, r"\\\\", -1)  # at escaped backslashes, so that the rest can be replaced one by one

    def one(piece: Column) -> Column:
        for letter, char in simple.items():
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(char))
        parts = F.split(piece, r"(?=\\u[0-9A-Fa-f]{4})|(?=\\U[0-9A-Fa-f]{8})", -1)
        point = lambda hexa: F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")
        return F.array_join(
            F.transform(
                parts,
                lambda p: F.when(F.rlike(p, F.lit(r"^\\u[0-9A-Fa-f]{4}")), F.concat(point(F.substring(p, 3, 4)), F.substring(p, 7, 1 << 30)))
                .when(F.rlike(p, F.lit(r"^\\U[0-9A-Fa-f]{8}")), F.concat(point(F.substring(p, 3, 8)), F.substring(p, 11, 1 << 30)))
                .otherwise(p),
            ),
            "",
        )

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(pieces, one), "\\")).otherwise(c)


def parse_ntriples(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Triples of N-Triples lines; blank lines and comments are skipped. A line that doesn't parse fails the
    query, or is skipped where ``strict`` is false (``bad_lines`` tells which)."""
    part = lambda i: F.regexp_extract(column, LINE, i)
    fine = F.rlike(column, F.lit(LINE))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("not a line of N-Triples: "), F.substring(F.col(column), 1, 200))).cast("boolean")
        fine = F.when(fine, True).when(F.rlike(column, F.lit(NO_TRIPLE)), False).otherwise(wrong)
    raw = lines.where(fine).select(*[part(i).alias(f"g{i}") for i in range(1, 8)])
    uri_s = F.startswith("g1", F.lit("<"))
    return raw.select(
        F.when(uri_s, _unescaped(F.expr("substring(g1, 2, length(g1) - 2)"))).otherwise(F.col("g1")).alias("s"),
        F.when(uri_s, "uri").otherwise("bnode").alias("s_kind"),
        _unescaped(F.col("g2")).alias("p"),
        F.when(F.col("g3") != "", _unescaped(F.col("g3"))).when(F.col("g4") != "", F.col("g4")).otherwise(_unescaped(F.col("g5"))).alias("o"),
        F.when(F.col("g3") != "", "uri").when(F.col("g4") != "", "bnode").otherwise("literal").alias("o_kind"),
        F.col("g6").alias("o_datatype"),
        F.lower("g7").alias("o_lang"),
    )


def bad_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are neither a triple nor blank nor a comment."""
    return lines.where(~F.rlike(column, F.lit(LINE)) & ~F.rlike(column, F.lit(NO_TRIPLE)))


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_ntriples(spark.read.text(path), strict=strict).distinct()


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: ``.nt`` N-Triples, ``.owl``, ``.rdf`` and ``.xml`` RDF/XML, else Turtle."""
    if path.endswith(".nt"):
        return read_ntriples(spark, path)
    text = spark.read.text(path, wholetext=True).first()["value"]
    made = parse_rdfxml(text) if path.endswith((".owl", ".rdf", ".xml")) else parse_turtle(text)
    return spark.createDataFrame(sorted(set(made)), TRIPLE_SCHEMA)


def read_graphs(spark: SparkSession, *paths: str) -> DataFrame:
    """Several files as one graph (a set)."""
    found = read_graph(spark, paths[0])
    for path in paths[1:]:
        found = found.unionByName(read_graph(spark, path))
    return found.distinct()


class _Turtle(Parser):
    """Turtle by the query parser's term and property rules; blank nodes are constants here."""

    def __init__(self, text: str):
        text = re.sub(r"@(prefix|base)\b", r"\1", text, flags=re.IGNORECASE)
        super().__init__(text, {})
        self.triples_: list[tuple] = []

    def new_var(self):
        self.fresh += 1
        return Const("bnode", f"_:b{self.fresh}")

    def node(self):
        if self.peek()[0] == "blank":
            return Const("bnode", self.next()[1])
        if self.op("("):
            return self.collection()
        return super().node()

    def collection(self):
        items = []
        while not self.op(")"):
            items.append(self.subject(self.sink))
        last = Const("uri", f"{RDF}nil")
        for item in reversed(items):
            cell = self.new_var()
            self.sink.elements += [("triple", cell, Const("uri", f"{RDF}first"), item), ("triple", cell, Const("uri", f"{RDF}rest"), last)]
            last = cell
        return last

    class _Sink:
        def __init__(self):
            self.elements = []

    def document(self) -> list[tuple]:
        self.sink = sink = self._Sink()
        while self.peek()[0] != "end":
            if word := self.word("PREFIX", "BASE"):
                if word == "BASE":
                    self.base = self.next()[1][1:-1]
                else:
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.iri(self.next()[1][1:-1])
                self.op(".")
                continue
            self.triples(sink)
            self.need(".")
        return [(s.value, s.kind, p.value, o.value, o.kind, o.datatype, o.lang) for _, s, p, o in sink.elements]


def parse_turtle(text: str) -> list[tuple]:
    return _Turtle(text).document()


def parse_rdfxml(text: str) -> list[tuple]:
    """Triples of an RDF/XML document: node and property elements, rdf:about, ID, resource, nodeID,
    datatype, parseType Collection and Resource, property attributes, entities and xml:base."""
    entities = dict(re.findall(r'<!ENTITY\s+(\S+)\s+"([^"]*)"', text))
    body = re.sub(r"<!DOCTYPE[^\[>]*(\[.*?\])?\s*>", "", text, flags=re.DOTALL)
    for name, value in entities.items():
        body = body.replace(f"&{name};", value)
    root = ET.fromstring(body)
    xml = "{http://www.w3.org/XML/1998/namespace}"
    r = f"{{{RDF}}}"
    base = root.get(f"{xml}base", "")
    out: list[tuple] = []
    fresh = iter(range(1, 1 << 60))
    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag
    full = lambda iri: base.rstrip("#") + iri if iri.startswith("#") else iri or base

    def add(s, p, o, datatype="", lang=""):
        out.append((s[1], s[0], p, o[1], o[0], datatype, lang))

    def node(e) -> tuple:
        if e.get(f"{r}about") is not None:
            s = ("uri", full(e.get(f"{r}about")))
        elif e.get(f"{r}ID") is not None:
            s = ("uri", full("#" + e.get(f"{r}ID")))
        else:
            s = ("bnode", "_:" + (e.get(f"{r}nodeID") or f"x{next(fresh)}"))
        if e.tag != f"{r}Description":
            add(s, f"{RDF}type", ("uri", name(e.tag)))
        for key, value in e.attrib.items():
            if not key.startswith((r, xml)):
                add(s, name(key), ("literal", value))
        for child in e:
            prop(s, child)
        return s

    def prop(s, e) -> None:
        p, kind = name(e.tag), e.get(f"{r}parseType")
        if e.get(f"{r}resource") is not None:
            add(s, p, ("uri", full(e.get(f"{r}resource"))))
        elif e.get(f"{r}nodeID") is not None:
            add(s, p, ("bnode", "_:" + e.get(f"{r}nodeID")))
        elif kind == "Collection":
            last = ("uri", f"{RDF}nil")
            for item in reversed([node(c) for c in e]):
                cell = ("bnode", f"_:x{next(fresh)}")
                add(cell, f"{RDF}first", item)
                add(cell, f"{RDF}rest", last)
                last = cell
            add(s, p, last)
        elif kind == "Resource":
            inner = ("bnode", f"_:x{next(fresh)}")
            add(s, p, inner)
            for child in e:
                prop(inner, child)
        elif len(e):
            add(s, p, node(e[0]))
        else:
            add(s, p, ("literal", e.text or ""), e.get(f"{r}datatype", ""), (e.get(f"{xml}lang") or "").lower())

    for child in root if root.tag == f"{r}RDF" else [root]:
        node(child)
    return out

