"""Command line: from pages to a graph, its alignment, expansion and closure, questions, and models of it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from graphloom.operators import align, extract, graph, kge, rag, reason, splits, vectors
from graphloom.plans.fixpoint import cut
from graphloom.plans.sparql import bindings, sparql
from graphloom.session import local_session, ship
from graphloom.sources import rdf, remote, sinks, tables
from graphloom.terms import SPOTLIGHT

HELP = "Ask a question, or: help, schema, baseline (on and off), quit."


def chat(triples, model=rag.template_model, read=input, write=print) -> None:
    """The question loop: q, quit or exit ends it."""
    schema, compare = graph.schema_summary(triples), False
    write(HELP)
    while (line := read("> ").strip()).lower() not in ("q", "quit", "exit"):
        match line.lower():
            case "":
                continue
            case "help":
                write(HELP)
            case "schema":
                write(schema)
            case "baseline":
                compare = not compare
                write(f"baseline {'on' if compare else 'off'}")
            case _:
                if compare:
                    write(rag.baseline(line, model))
                text, query, repairs = rag.answer(line, schema, triples, model)
                write(f"{query}\n{text}\n({repairs} repairs)")


def run(question: str, triples, model=rag.template_model, compare: bool = False, write=print) -> None:
    """One question: the query, the answer and the repairs, and with ``compare`` the model's own answer."""
    if compare:
        write(f"baseline: {rag.baseline(question, model)}")
    text, query, repairs = rag.answer(question, graph.schema_summary(triples), triples, model)
    write(f"{query}\n{text}\n({repairs} repairs)")


#: Command -> its arguments; those in brackets are options with their defaults.
COMMANDS = {
    "crawl": ("seeds", "out", ("min_words", 500), ("delay", 1.5)),
    "facts": ("pages", "out"),
    "ontology": ("out",),
    "build": ("facts", "out"),
    "align": ("graph", "responses", "out", ("min_count", 10), ("limit", 50)),
    "predicates": ("graph",),
    "expand": ("graph", "alignment", "responses", "out"),
    "reason": ("graph", "out"),
    "stats": ("graph", "out"),
    "schema": ("graph", ("out", "")),
    "query": ("graph", "sparql"),
    "ask": ("graph", "question"),
    "run": ("graph", "question", ("compare", 0)),
    "chat": ("graph",),
    "evaluate": ("graph", "out"),
    "split": ("graph", "out"),
    "train": ("splits", "out", ("model", "TransE"), ("dim", 128), ("lr", 0.01), ("batch", 512), ("epochs", 100)),
    "metrics": ("out", "reports"),
    "sensitivity": ("splits", "out", ("epochs", 50)),
    "neighbours": ("model", ("k", 5)),
    "plot": ("model", "out", ("most", 2000)),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graphloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        p = sub.add_parser(name)
        for x in arguments:
            if isinstance(x, str):
                p.add_argument(x, nargs="+" if (name, x) == ("metrics", "reports") else None)
            else:
                p.add_argument(f"--{x[0].replace('_', '-')}", dest=x[0], type=type(x[1]), default=x[1])
    args = parser.parse_args(argv)
    spark = ship(local_session())
    (_files if args.command in _FILES else _models if args.command in _MODELS else _graphs)(spark, args)


_FILES = ("crawl", "facts", "ontology", "build")
_MODELS = ("split", "train", "metrics", "sensitivity", "neighbours", "plot")


def _files(spark, args) -> None:
    match args.command:
        case "crawl":
            fetched = remote.fetch(tables.read_seeds(spark, args.seeds), delay=args.delay)
            pages = fetched.selectExpr("xxhash64(url) as page_id", "url", "body as html")
            sinks.write_pages(extract.crawl(pages, args.min_words).drop("page_id"), args.out)
        case "facts":
            sinks.write_csv(extract.facts(tables.read_pages(spark, args.pages).selectExpr("xxhash64(url) as page_id", "*")), args.out)
        case "ontology":
            sinks.write_turtle(graph.build_ontology(spark), args.out)
        case "build":
            sinks.write_turtle(graph.build_graph(tables.read_facts(spark, args.facts), graph.build_ontology(spark)), args.out)


def _graphs(spark, args) -> None:
    triples = rdf.read_graph(spark, args.graph)
    match args.command:
        case "align":
            # Search responses: JSON lines of label and body, as a search service gave them.
            found = align.parse_search(spark.read.schema("label string, body string").json(args.responses))
            mapping = align.align_entities(triples, found, args.min_count, args.limit)
            sinks.write_turtle(align.alignment_triples(mapping), args.out)
            sinks.write_csv(mapping, f"{args.out}.csv")
            print(align.alignment_summary(mapping).first().asDict())
        case "predicates":
            print(sinks.append_graph(spark, args.graph, align.predicate_alignment(spark)), "triples")
        case "expand":
            hops = align.parse_bindings(spark.read.schema("qid string, body string").json(args.responses))
            sinks.write_ntriples(align.expand_graph(triples, rdf.read_graph(spark, args.alignment), hops), args.out)
        case "reason":
            closed = reason.infer(triples)
            closed.write.mode("overwrite").parquet(args.out)
            print(reason.commanders(spark.read.parquet(args.out)).count(), "commanders")
        case "stats":
            stats = graph.graph_stats(triples, args.graph)
            sinks.write_json(spark, stats, args.out)
            print(graph.format_stats(stats))
        case "schema":
            text = graph.schema_summary(triples)
            print(text)
            if args.out:
                sinks.write_text(spark, text, args.out)
        case "query":
            print(json.dumps(bindings(sparql(triples, args.sparql)), indent=2, ensure_ascii=False))
        case "ask":
            print(rag.answer(args.question, graph.schema_summary(triples), triples)[0])
        case "run":
            run(args.question, triples, compare=bool(args.compare))
        case "chat":
            chat(triples)
        case "evaluate":
            sinks.write_text(spark, rag.report(rag.evaluate(triples)), args.out)


def _models(spark, args) -> None:
    parts = lambda folder: {p: tables.read_split(spark, f"{folder}/{p}") for p in ("train", "valid", "test")}
    match args.command:
        case "split":
            kept = cut(splits.enforce_coverage(splits.assign(splits.uri_triples(rdf.read_graph(spark, args.graph)))))
            for part in ("train", "valid", "test"):
                sinks.write_split(kept.where(F.col("split") == part), f"{args.out}/{part}")
            for r in splits.sizes(kept).orderBy("split").collect():
                print(f"{r['split']:<8}{r['n']:>10,}{r['share']:>8.2%}")
            print(splits.orphans(kept).count(), "orphans")
        case "train":
            given = parts(args.splits)
            known = given["train"].unionByName(given["valid"]).unionByName(given["test"])
            model, losses = kge.train(spark, given["train"], args.model, dim=args.dim, lr=args.lr, batch=args.batch, epochs=args.epochs)
            kge.save_model(model, spark, f"{args.out}/model")
            found = kge.evaluate(model, given["test"], known)
            sinks.write_json(spark, found | {"losses": losses}, f"{args.out}/results.json")
            print(kge.format_comparison([found]))
        case "metrics":
            rows = [json.loads(spark.read.text(p, wholetext=True).first()["value"]) for p in args.reports]
            sinks.write_json(spark, rows, args.out)
            print(kge.format_comparison(rows))
        case "sensitivity":
            given = parts(args.splits)
            known = given["train"].unionByName(given["valid"]).unionByName(given["test"])
            rows = kge.sensitivity(spark, given["train"], given["test"], known, epochs=args.epochs)
            sinks.write_json(spark, rows, args.out)
            for r in rows:
                print(f"{r['model']:<10}{r['subset']:>10}{r['n_train']:>10,}{r['mrr']:>10.4f}{r['hits_10']:>10.4f}")
        case "neighbours":
            space = spark.read.parquet(f"{args.model}/entities")
            wanted = vectors.resolve_spotlight(space, list(SPOTLIGHT)).select("id")
            names = space.select(F.col("id").alias("neighbour"), "label")
            for r in vectors.nearest(space, wanted, args.k).join(names, "neighbour").orderBy("query", "rank").collect():
                print(f"{r['query']:>8} {r['rank']:>2} {r['similarity']:.4f} {r['label']}")
        case "plot":
            kge.coordinates(spark.read.parquet(f"{args.model}/entities"), most=args.most).write.mode("overwrite").csv(args.out, header=True)


if __name__ == "__main__":
    main()
