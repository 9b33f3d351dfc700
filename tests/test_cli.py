"""The command line, end to end on small files."""

import json

from graphloom import cli
from graphloom.terms import RESOURCE


def test_from_pages_to_models(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    people = ("Neil Armstrong", "Buzz Aldrin", "Alan Shepard", "John Glenn", "Pete Conrad", "Chris Hadfield")
    text = " ".join(f"In 19{60 + i} {p} visited {place}." for i, p in enumerate(people) for place in ("Cape Canaveral", "Johnson Center", "Mars Station"))
    (tmp_path / "pages.jsonl").write_text(json.dumps({"url": "http://w/Visits", "text": text}) + "\n")
    cli.main(["facts", at("pages.jsonl"), at("facts")])
    cli.main(["build", at("facts"), at("kg.ttl")])
    (tmp_path / "search.jsonl").write_text(json.dumps({"label": "Pete Conrad", "body": json.dumps({"search": [{"id": "Q1", "label": "Pete Conrad"}]})}) + "\n")
    cli.main(["align", at("kg.ttl"), at("search.jsonl"), at("alignment.ttl"), "--min-count", "1"])
    cli.main(["predicates", at("alignment.ttl")])
    hop = {"results": {"bindings": [{"prop": {"value": "http://p/P361"}, "obj": {"value": "http://x.org/Crew", "type": "uri"}}]}}
    (tmp_path / "hops.jsonl").write_text(json.dumps({"qid": "Q1615", "body": json.dumps(hop)}) + "\n")
    cli.main(["expand", at("kg.ttl"), at("alignment.ttl"), at("hops.jsonl"), at("expanded.nt")])
    cli.main(["reason", at("kg.ttl"), at("closed")])
    cli.main(["stats", at("expanded.nt"), at("stats.json")])
    cli.main(["schema", at("expanded.nt"), "--out", at("schema.txt")])
    cli.main(["query", at("expanded.nt"), f"SELECT ?o WHERE {{ <{RESOURCE}Neil_Armstrong> skg-o:partOf ?o }}"])
    cli.main(["run", at("expanded.nt"), "What is Neil Armstrong part of?", "--compare", "1"])
    cli.main(["split", at("expanded.nt"), at("splits")])
    cli.main(["train", at("splits"), at("transe"), "--dim", "8", "--epochs", "3"])
    cli.main(["metrics", at("metrics.json"), at("transe/results.json")])
    cli.main(["plot", at("transe/model"), at("plot")])
    cli.main(["neighbours", at("transe/model"), "--k", "2"])
    said = capsys.readouterr().out
    assert json.loads((tmp_path / "stats.json").read_text())["num_triples"] > 60 and "skg-o:visit" in (tmp_path / "schema.txt").read_text()
    assert "http://x.org/Crew" in said and "0 orphans" in said and "baseline" in said and "TransE" in said and "'n_total'" in said
    assert json.loads((tmp_path / "metrics.json").read_text())[0]["model"] == "TransE"
