"""Graph building, files, alignment, reasoning and splits against goldens and invariants."""

import json
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import align, graph, reason, splits
from graphloom.plans.fixpoint import saturate, transitive_closure
from graphloom.sources import rdf, sinks, tables
from graphloom.terms import ENTITY, LABEL, ONTOLOGY, OWL, RESOURCE, SAME_AS, SEEDS, TRIPLE_SCHEMA, TYPE

#: A family of our own: Ann and Bo have Cid and Dot, Cid has Eve; Fay is Dot's sister.
FAMILY = """<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [<!ENTITY owl "http://www.w3.org/2002/07/owl#"> <!ENTITY xsd "http://www.w3.org/2001/XMLSchema#">]>
<rdf:RDF xml:base="http://f/kin" xmlns="http://f/kin#" xmlns:k="http://f/kin#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
  <owl:Class rdf:ID="Woman"><rdfs:subClassOf rdf:resource="#Human"/></owl:Class>
  <owl:Class rdf:ID="Man"><rdfs:subClassOf rdf:resource="#Human"/><owl:disjointWith rdf:resource="#Woman"/></owl:Class>
  <owl:Class rdf:ID="Elder">
    <owl:equivalentClass><owl:Restriction><owl:onProperty rdf:resource="#raised"/><owl:minCardinality rdf:datatype="&xsd;int">1</owl:minCardinality></owl:Restriction></owl:equivalentClass>
  </owl:Class>
  <owl:Class rdf:ID="Dad">
    <owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection">
      <owl:Class rdf:about="#Man"/>
      <owl:Restriction><owl:onProperty rdf:resource="#raised"/><owl:minCardinality rdf:datatype="&xsd;int">1</owl:minCardinality></owl:Restriction>
    </owl:intersectionOf></owl:Class></owl:equivalentClass>
  </owl:Class>
  <owl:Class rdf:ID="Grandma">
    <owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection">
      <rdf:Description rdf:about="#Woman"/>
      <owl:Restriction><owl:onProperty rdf:resource="#raised"/><owl:someValuesFrom rdf:resource="#Elder"/></owl:Restriction>
    </owl:intersectionOf></owl:Class></owl:equivalentClass>
  </owl:Class>
  <owl:ObjectProperty rdf:ID="raised"><owl:inverseOf rdf:resource="#raisedBy"/><rdfs:domain rdf:resource="#Human"/></owl:ObjectProperty>
  <owl:ObjectProperty rdf:ID="raisedBy"><rdfs:range rdf:resource="#Human"/></owl:ObjectProperty>
  <owl:ObjectProperty rdf:ID="sisterOf"><rdf:type rdf:resource="&owl;TransitiveProperty"/><rdf:type rdf:resource="&owl;SymmetricProperty"/><rdfs:subPropertyOf rdf:resource="#kinOf"/></owl:ObjectProperty>
  <Woman rdf:about="#Ann"><raised rdf:resource="#Cid"/><age rdf:datatype="&xsd;int">70</age></Woman>
  <Man rdf:about="#Bo" k:age="61"><raised rdf:resource="#Dot"/></Man>
  <Man rdf:about="#Cid"><age rdf:datatype="&xsd;int">40</age></Man>
  <Woman rdf:about="#Dot"><sisterOf rdf:resource="#Fay"/></Woman>
  <Woman rdf:about="#Eve"><raisedBy rdf:resource="#Cid"/></Woman>
  <Woman rdf:about="#Fay"><sisterOf><Woman rdf:about="#Gil"/></sisterOf></Woman>
</rdf:RDF>"""


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def triples(spark, *spo):
    return spark.createDataFrame([(s, "uri", p, o, "literal" if o.startswith('"') else "uri", "", "") for s, p, o in spo], TRIPLE_SCHEMA)


# --- functions ---


def test_text_functions_equal_python(spark):
    texts = ["", " a ", "Neil  Armstrong\n", "U.K.", "a-b c_d", "  é\tü  ", "x" * 100, "1,2 3", "The", "NASA", "12 July 1969", "1969–70", "a [b]", "Citation x", "日本 語"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(
        "t", tx.word_count("t").alias("n"), tx.slugify("t").alias("slug"), tx.clean_text("t").alias("clean"), tx.is_valid_entity("t", F.lit("ORG")).alias("ok"), tx.is_useful_endpoint("t").alias("end"), tx.is_clean_label("t").alias("label")
    ).collect()
    for r in got:
        t = r["t"]
        assert r["n"] == len(re.findall(r"\b\w+\b", t))
        assert r["slug"] == re.sub(r"[\s-]+", "_", re.sub(r"[^\w\s-]", "", t.strip()))[:80]
        assert r["clean"] == re.sub(r"\s+", " ", t).strip()
        assert r["ok"] == (len(t.strip()) >= 2 and t.strip().lower() not in ("the",) and not re.fullmatch(r"[\d\s,.%-]+", t.strip()))
        assert r["end"] == (len(t) >= 2 and not re.fullmatch(r"[\d\s,.%-]+", t))
    assert {r["t"] for r in got if r["label"]} == {"Neil  Armstrong\n", "U.K.", "a-b c_d", "  é\tü  ", "The", "NASA", "日本 語"}


def test_page_filter_and_titles(spark):
    df = spark.createDataFrame([("word " * 600, "http://x/wiki/Apollo_11/"), ("just a few words", "http://x/a"), (None, "b"), (" ", "http://x/c?d=e_f")], "t string, u string")
    got = df.select(tx.is_useful_page("t").alias("ok"), tx.title_from_url("u").alias("title")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False]
    assert [r["title"] for r in got] == ["Apollo 11", "a", "b", "c?d=e f"]


def test_confidence_tiers_and_padding(spark):
    df = spark.createDataFrame([(0, "Mars", "mars"), (0, "a", "b"), (9, "a", "a"), (3, "a", "b")], "r int, a string, b string")
    got = df.select(tx.candidate_confidence("r", "a", "b").alias("c")).select("c", tx.alignment_tier("c").alias("t"), tx.padded("t", 8).alias("p")).collect()
    assert [(r["c"], r["t"]) for r in got] == [(1.0, "sameAs"), (0.95, "sameAs"), (0.15, "none"), (0.65, "seeAlso")]
    assert got[0]["p"] == "sameAs  "


def test_keyword_class_order(spark):
    names = {"x/Mercury": "SpaceMission", "x/mission_iss": "SpaceMission", "x/ISS": "Spacecraft", "x/Hubble": "Telescope", "x/q": "Other", "x/Neil_Armstrong": "Astronaut", "x/Mars": "CelestialBody"}
    df = spark.createDataFrame([(n,) for n in names], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", tx.keyword_class("u").alias("c")).collect()} == names


# --- graph ---


def test_ontology_has_59_triples(spark):
    onto = graph.build_ontology(spark)
    assert onto.count() == 59 == onto.distinct().count()


def test_facts_become_triples(spark):
    facts = spark.createDataFrame(
        [("Neil Armstrong", "PERSON", "command", "Apollo 11", "EVENT", "http://w/a", "s", "relation"), ("?!", "PERSON", "x", "y", "", "", "s", "ner"), ("Mars", "", "mentionedIn", "Mars", "Article", "", "s", "ner")],
        ", ".join(f"{c} string" for c in tables.FACTS),
    )
    got = rows(graph.build_graph(facts), "s", "p", "o", "o_kind")
    a, b = f"{RESOURCE}Neil_Armstrong", f"{RESOURCE}Apollo_11"
    assert (a, f"{ONTOLOGY}command", b, "uri") in got and (a, LABEL, "Neil Armstrong", "literal") in got and (b, TYPE, f"{ONTOLOGY}SpaceMission", "uri") in got
    assert len(got) == 6 + 3
    stats = graph.graph_stats(graph.build_graph(facts, graph.build_ontology(spark)), "f")
    assert stats["num_triples"] == 9 + 59 and stats["top_types"][f"{OWL}Class"] == 8
    text = graph.schema_summary(graph.build_graph(facts))
    assert "skg-o:SpaceMission" in text and 'skg-r:Mars rdfs:label "Mars"' in text


def test_graph_files_round_trip(spark, tmp_path):
    odd = 'a "quote" \\ back\nline\ttab é \\u0041 日本'
    g = spark.createDataFrame(
        [(f"{RESOURCE}a", "uri", LABEL, odd, "literal", "", "en"), (f"{RESOURCE}a", "uri", TYPE, f"{ONTOLOGY}X", "uri", "", ""), ("_:b", "bnode", f"{ONTOLOGY}p", "5", "literal", "http://www.w3.org/2001/XMLSchema#int", ""), (f"{RESOURCE}a-b.c", "uri", f"{ONTOLOGY}p", "_:b", "bnode", "", "")],
        TRIPLE_SCHEMA,
    )
    columns = g.columns
    sinks.write_ntriples(g.unionByName(g), str(tmp_path / "g.nt"))
    assert rows(rdf.read_ntriples(spark, str(tmp_path / "g.nt")), *columns) == rows(g, *columns)
    sinks.write_turtle(g, str(tmp_path / "g.ttl"))
    assert rows(rdf.read_graph(spark, str(tmp_path / "g.ttl")), *columns) == rows(g, *columns)
    assert sinks.append_graph(spark, str(tmp_path / "g.ttl"), triples(spark, ("x:a", "x:p", "x:b"), (f"{RESOURCE}a", TYPE, f"{ONTOLOGY}X"))) == 5
    assert rows(rdf.read_graphs(spark, str(tmp_path / "g.ttl"), str(tmp_path / "g.nt")), "s").__len__() == 5


def test_ntriples_lines(spark):
    lines = ['<a> <b> "x\\u00e9\\U0001F600" .', "# comment", "", '<a> <b> "5"^^<t> . # tail', "_:x <b> _:y .", "bad line", '<a> <b> "t"@EN .']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    with pytest.raises(Exception, match="bad line"):
        rdf.parse_ntriples(df).collect()
    assert [r["value"] for r in rdf.bad_lines(df).collect()] == ["bad line"]
    got = rows(rdf.parse_ntriples(df, strict=False), "s", "o", "o_kind", "o_datatype", "o_lang")
    assert got == sorted([("a", "xé😀", "literal", "", ""), ("a", "5", "literal", "t", ""), ("_:x", "_:y", "bnode", "", ""), ("a", "t", "literal", "", "en")])


def test_turtle_forms():
    text = '@prefix x: <http://x/> .\nPREFIX y: <http://y/>\nx:a a x:C ; y:p "l"@en, 5, true ; y:q [ y:r x:b ] .\nx:l y:m ( x:a "z" ) .'
    got = rdf.parse_turtle(text)
    assert ("http://x/a", "uri", TYPE, "http://x/C", "uri", "", "") in got and len(got) == 4 + 2 + 5
    assert ("http://x/a", "uri", "http://y/p", "l", "literal", "", "en") in got


def test_table_files(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("http://a\n\n# no\n  # kept\n http://b \n")
    assert [r["url"] for r in tables.read_seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["http://a", "# kept", "http://b"]
    (tmp_path / "p.jsonl").write_text(json.dumps({"url": "u", "text": "t"}) + "\n\n")
    assert tables.read_pages(spark, str(tmp_path / "p.jsonl")).first()["title"] == "u"
    (tmp_path / "f.csv").write_text(",".join(tables.FACTS) + '\nNA,,p,"o ""q"", x",,,"two\nlines",ner\n')
    r = tables.read_facts(spark, str(tmp_path / "f.csv")).first()
    assert (r["subject"], r["subject_label"], r["object"], r["sentence"]) == ("NA", "", 'o "q", x', "two\nlines")
    t = triples(spark, ("a", "p", "b"), ("b", "p", "c"))
    sinks.write_split(t, str(tmp_path / "s"))
    assert rows(tables.read_split(spark, str(tmp_path / "s")), "s", "p", "o") == [("a", "p", "b"), ("b", "p", "c")]
    entities, relations = tables.dictionaries(t)
    assert rows(entities, "entity", "id") == [("a", 0), ("b", 1), ("c", 2)] and relations.count() == 1
    assert tables.encode_ids(triples(spark, ("a", "p", "c"), ("a", "q", "c")), t).count() == 1
    nested = {"metrics": {"both": {"realistic": {"inverse_harmonic_mean_rank": 0.5, "hits_at_1": 0.1}}, "head.realistic.inverse_harmonic_mean_rank": 0.25}}
    (tmp_path / "m.json").write_text(json.dumps(nested))
    m = tables.read_metrics(spark, str(tmp_path / "m.json"), "TransE").first()
    assert (m["mrr_both"], m["mrr_head"], m["mrr_tail"], m["hits_at_1"]) == (0.5, 0.25, None, 0.1)


# --- alignment ---


def test_alignment_and_expansion(spark):
    g = triples(spark, *[(f"{RESOURCE}{n}", LABEL, f'"{n}') for n in ("Mars", "Hubble")], *[(f"{RESOURCE}Busy", f"{ONTOLOGY}p", f"x:{i}") for i in range(12)])
    g = g.withColumn("o", F.regexp_replace("o", '^"', "")).unionByName(triples(spark, (f"{RESOURCE}Busy", LABEL, '"Busy')).withColumn("o", F.lit("Busy")))
    found = spark.createDataFrame([("Busy", 1, "Q9", "x", "d"), ("Busy", 0, "Q8", "busy", "d" * 100)], "label string, rank int, id string, wd_label string, description string")
    mapping = align.align_entities(g, found)
    got = {r["label"]: r for r in mapping.collect()}
    assert got["Mars"]["wd_id"] == SEEDS["mars"][0] and got["Busy"]["wd_id"] == "Q8" and got["Busy"]["confidence"] == 1.0 and got["Busy"]["wd_description"] == "d" * 100
    links = align.alignment_triples(mapping)
    assert rows(links, "p") == [(SAME_AS,)] * 3
    hop = spark.createDataFrame([("Q111", "P361", f"{ENTITY}Q2513", "uri"), ("Q111", "P31", f"{ENTITY}Q77", "uri"), ("Q111", "P18", "pic", "literal"), ("Q111", "P571", "1969", "literal"), ("Q111", "P9", "x", "uri")], "qid string, pid string, obj string, obj_type string")
    out = rows(align.expansion(align.aligned_entities(links), hop), "s", "p", "o", "o_kind")
    assert out == sorted([(f"{RESOURCE}Mars", f"{ONTOLOGY}partOf", f"{RESOURCE}Hubble", "uri"), (f"{RESOURCE}Mars", f"{ONTOLOGY}instanceOf", f"{ENTITY}Q77", "uri"), (f"{RESOURCE}Mars", f"{ONTOLOGY}foundedDate", "1969", "literal")])
    assert align.predicate_alignment(spark).count() == 21
    s = align.alignment_summary(mapping).first()
    assert (s["n_sameas"], s["n_none"], s["n_total"]) == (3, 0, 3)


def test_descriptions_of_search_results_are_cut_at_120(spark):
    found = spark.createDataFrame([("a", 0, "Q1", "a", "é" * 130), ("b", 0, "Q2", "b", "d" * 100)], "label string, rank int, id string, wd_label string, description string")
    mapping = align.best_candidates(spark.createDataFrame([("x:a", "a"), ("x:b", "b")], "s string, label string"), found)
    assert {r["label"]: r["wd_description"] for r in mapping.collect()} == {"a": "é" * 120, "b": "d" * 100}


def test_provider_responses(spark):
    body = json.dumps({"results": {"bindings": [{"prop": {"value": "http://p/P31"}, "obj": {"value": "v", "type": "literal"}}]}})
    df = spark.createDataFrame([("Q1", body), ("Q2", "not json")], "qid string, body string")
    assert rows(align.parse_bindings(df), "qid", "pid", "obj", "obj_type") == [("Q1", "P31", "v", "literal")]
    found = spark.createDataFrame([("Mars", json.dumps({"search": [{"id": "Q111", "label": "Mars"}, {"id": "Q2"}]}))], "label string, body string")
    assert rows(align.parse_search(found), "rank", "id", "wd_label") == [(0, "Q111", "Mars"), (1, "Q2", "")]


# --- reasoning ---


def local(iri):
    return iri.rsplit("#", 1)[-1]


def test_family_closure(spark, tmp_path):
    (tmp_path / "kin.owl").write_text(FAMILY)
    g = rdf.read_graph(spark, str(tmp_path / "kin.owl"))
    closed = reason.infer(g).cache()
    members, kin = {}, set()
    for s, p, o in rows(closed, "s", "p", "o"):
        if p == TYPE:
            members.setdefault(local(o), set()).add(local(s))
        if local(p) == "kinOf":
            kin.add((local(s), local(o)))
    assert members["Human"] == {"Ann", "Bo", "Cid", "Dot", "Eve", "Fay", "Gil"}
    assert members["Elder"] == {"Ann", "Bo", "Cid"} and members["Dad"] == {"Bo", "Cid"} and members["Grandma"] == {"Ann"}
    assert kin == {(a, b) for a in ("Dot", "Fay", "Gil") for b in ("Dot", "Fay", "Gil")}
    old = reason.over_age(closed.withColumn("s_kind", F.lit("uri")), "http://f/kin#Human", "http://f/kin#age")
    assert rows(old, "s") == [("http://f/kin#Ann",), ("http://f/kin#Bo",)]
    assert reason.disjoint_violations(closed).count() == 0


def test_rules(spark):
    g = triples(spark, ("Alice", TYPE, "Person"), ("Bob", TYPE, "Person"), ("Carol", TYPE, "Person"), ("Alice", "hasAge", "72"), ("Bob", "hasAge", "45"), ("Carol", "hasAge", "63"), ("Dan", "hasAge", "90"), ("Bob", "hasAge", "60"))
    assert rows(reason.over_age(g, "Person", "hasAge"), "s") == [("Alice",), ("Carol",)]
    assert reason.demo_commanders(spark) == ["Alan Shepard", "Neil Armstrong", "Pete Conrad"]
    onto = graph.build_ontology(spark).unionByName(triples(spark, ("Neil", f"{ONTOLOGY}isCommanderOf", "Apollo11")))
    assert rows(reason.commanders(reason.infer(onto)), "s") == [("Neil",)]


def test_closures_end_on_cycles_and_are_idempotent(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "a string, b string")
    once = transitive_closure(pairs)
    assert once.count() == 10 and rows(transitive_closure(once), "a", "b") == rows(once, "a", "b")
    with pytest.raises(RuntimeError):
        saturate(spark.range(1).selectExpr("cast(id as int) as x"), lambda known, new: new.select((F.col("x") + 1).alias("x")), max_rounds=3)


def test_equal_individuals_at_both_ends(spark):
    g = triples(spark, ("q", "http://www.w3.org/2000/01/rdf-schema#subPropertyOf", SAME_AS), ("a", "q", "b"), ("a", "p", "x"), ("z", "r", "a"), ("b", SAME_AS, "c"), ("a", "says", '"a'))
    got = set(rows(reason.infer(g, same_as=True), "s", "p", "o"))
    assert {("b", "p", "x"), ("c", "p", "x"), ("z", "r", "b"), ("z", "r", "c"), ("c", "says", '"a')} <= got and ("c", "says", "b") not in got


def test_large_ontologies_are_tables(spark, tmp_path, monkeypatch):
    (tmp_path / "kin.owl").write_text(FAMILY)
    g = rdf.read_graph(spark, str(tmp_path / "kin.owl"))
    small = set(rows(reason.infer(g), "s", "p", "o"))
    monkeypatch.setattr(reason, "SMALL_ONTOLOGY", 3)
    assert set(rows(reason.infer(g), "s", "p", "o")) == small


def test_turned_and_literal_ends(spark):
    rdfs = "http://www.w3.org/2000/01/rdf-schema#"
    g = triples(spark, ("p", f"{OWL}inverseOf", "q"), ("q", f"{rdfs}domain", "D"), ("q", f"{rdfs}range", "R"), ("r", f"{rdfs}subPropertyOf", "p"), ("R", f"{rdfs}subClassOf", "S"), ("a", "r", "b"), ("c", "p", '"lit'))
    got = set(rows(reason.infer(g).where("p not like '%#sub%'"), "s", "p", "o"))
    assert {("a", "p", "b"), ("b", "q", "a"), ("b", TYPE, "D"), ("a", TYPE, "R"), ("a", TYPE, "S")} <= got
    assert not any(s == "c" and p == TYPE for s, p, o in got) and not any(s == '"lit' for s, p, o in got)


def test_long_chains(spark):
    from graphloom.plans.fixpoint import reachable

    chain = spark.range(10_000).selectExpr("concat('n', id) as a", "concat('n', id + 1) as b")
    start = spark.createDataFrame([("n9000",), ("n3",), ("x",)], "a string")
    assert {r["a"]: r["count"] for r in reachable(chain, start).groupBy("a").count().collect()} == {"n9000": 1000, "n3": 9997}
    short = chain.where("a in ('n%s')" % "','n".join(map(str, range(60))))
    assert transitive_closure(short).count() == 60 * 61 // 2
    from graphloom.plans import fixpoint

    before, fixpoint.BROADCAST_EDGES = fixpoint.BROADCAST_EDGES, 0
    try:
        assert reachable(short.where("cast(substr(a, 2) as int) < 14"), start).count() == 11
    finally:
        fixpoint.BROADCAST_EDGES = before


def test_equal_individuals_and_checks(spark):
    g = triples(spark, ("a", SAME_AS, "b"), ("a", "p", "x"), ("p", f"{OWL}equivalentProperty", "q"), ("a", TYPE, "C"), ("b", TYPE, "D"), ("C", f"{OWL}disjointWith", "D"), ("p", TYPE, f"{OWL}FunctionalProperty"), ("a", "p", "y"))
    closed = reason.infer(g, same_as=True)
    assert {("b", "p", "x"), ("b", "q", "x"), ("a", TYPE, "D")} <= set(rows(closed, "s", "p", "o"))
    assert rows(reason.disjoint_violations(closed), "s") == [("a",), ("b",)]
    assert rows(reason.functional_violations(g), "s", "n") == [("a", 2)]


# --- splits ---


def test_split_invariants(spark):
    g = triples(spark, *[(f"e{i % 37}", f"r{i % 5}", f"e{(i * 7) % 41}") for i in range(400)])
    t = splits.uri_triples(g)
    n = t.count()
    parts = {r["split"]: r["n"] for r in splits.sizes(splits.assign(t)).collect()}
    assert parts == {"train": int(n * 0.8), "valid": int(n * 0.1), "test": n - int(n * 0.8) - int(n * 0.1)}
    kept = splits.enforce_coverage(splits.assign(t))
    assert splits.orphans(kept).count() == 0 and rows(kept, "s", "p", "o") == rows(t, "s", "p", "o")
    assert rows(splits.sample(t, 10), "s", "p", "o") == rows(splits.sample(t, 10), "s", "p", "o") and splits.sample(t, 10_000).count() == n
    assert splits.assign(t.limit(0)).count() == 0


def test_vocabulary_and_stats_text(spark):
    g = triples(spark, ("C", TYPE, f"{OWL}Class"), ("a", TYPE, "C"))
    out = reason.ensure_vocabulary(g, ("C", "oldPerson"), ("hasAge",))
    assert {("oldPerson", f"{OWL}Class"), ("hasAge", f"{OWL}ObjectProperty")} <= set(rows(out, "s", "o")) and out.count() == 4
    assert "Triples" in graph.format_stats(graph.graph_stats(g))
