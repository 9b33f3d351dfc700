"""The query language against hand-made answers."""

import pytest

from graphloom.operators import rag
from graphloom.plans.sparql import SparqlError, bindings, sparql
from graphloom.plans.sparql_parser import parse
from graphloom.terms import ENTITY, LABEL, ONTOLOGY, RESOURCE, TRIPLE_SCHEMA, TYPE


@pytest.fixture(scope="module")
def mini(spark):
    """A graph that holds what the published answers imply."""
    r, o, w = RESOURCE, ONTOLOGY, ENTITY
    uri = [
        (f"{r}Apollo_11", f"{o}hasAstronaut", f"{r}Buzz_Aldrin"), (f"{r}Apollo_11", f"{o}hasAstronaut", f"{r}Neil_Armstrong"), (f"{r}Apollo_11", f"{o}hasAstronaut", f"{w}Q104859"),
        *[(f"{r}{h}", f"{o}{p}", f"{w}{q}") for h in ("Hubble", "Hubble_Space_Telescope") for p, q in (("partOf", "Q901553"), ("launchedBy", "Q52152"), ("launchedBy", "Q1540619"), ("instanceOf", "Q148578"))],
        (f"{r}SpaceX", TYPE, f"{o}SpaceAgency"), (f"{r}Hubble", TYPE, f"{o}Telescope"),
    ]
    text = [(f"{r}SpaceX", LABEL, "SpaceX", "en"), (f"{r}SpaceX", f"{o}foundedDate", "2002-03-14", ""), (f"{r}Hubble", LABEL, "Hubble", "fr"), (f"{r}SpaceX", f"{o}size", "12", "")]
    rows = [(s, "uri", p, v, "uri", "", "") for s, p, v in uri] + [(s, "uri", p, v, "literal", "", lang) for s, p, v, lang in text]
    return spark.createDataFrame(rows, TRIPLE_SCHEMA).cache()


def ask(g, text):
    return sorted(tuple(r.values()) for r in bindings(sparql(g, text)))


def short(rows):
    return sorted(v.rsplit("/", 1)[-1] for (v,) in rows)


def test_published_answers(mini):
    assert short(ask(mini, rag.simple_query("a", "m", "hasAstronaut", "apollo"))) == ["Buzz_Aldrin", "Neil_Armstrong", "Q104859"]
    assert short(ask(mini, rag.simple_query("g", "t", "partOf", "hubble"))) == ["Q901553"] * 2
    assert short(ask(mini, rag.simple_query("g", "t", "launchedBy", "hubble"))) == ["Q1540619"] * 2 + ["Q52152"] * 2
    assert short(ask(mini, rag.simple_query("g", "t", "instanceOf", "hubble"))) == ["Q148578"] * 2
    assert ask(mini, 'SELECT ?c WHERE { ?x skg-o:isAssociatedWith ?c FILTER(CONTAINS(LCASE(STR(?x)), "spacex")) FILTER(CONTAINS(LCASE(STR(?c)), "usa")) }') == []


@pytest.mark.parametrize(
    "text,answer",
    [
        ("SELECT ?l WHERE { skg-r:SpaceX rdfs:label ?l FILTER(LANG(?l) = 'en') }", [("SpaceX",)]),
        ("SELECT (YEAR(?d) AS ?y) WHERE { ?s skg-o:foundedDate ?d }", [("2002",)]),
        ("SELECT ?s WHERE { ?s skg-o:size ?n FILTER(?n > 9) }", [(f"{RESOURCE}SpaceX",)]),
        ("SELECT ?s WHERE { ?s skg-o:foundedDate ?n FILTER(?n + 1 > 0) }", []),
        ("SELECT ?x WHERE { VALUES ?x { 'a' 'b' } FILTER(?x != 'a') }", [("b",)]),
        ("SELECT ?s ?z WHERE { ?s a skg-o:SpaceAgency OPTIONAL { ?s skg-o:none ?z } }", [(f"{RESOURCE}SpaceX", "None")]),
        ("SELECT ?s WHERE { ?s a ?t MINUS { ?s skg-o:size ?n } }", [(f"{RESOURCE}Hubble",)]),
        ("SELECT ?s WHERE { ?s a ?t MINUS { ?q skg-o:size ?n } }", [(f"{RESOURCE}Hubble",), (f"{RESOURCE}SpaceX",)]),
        ("SELECT (COUNT(*) AS ?n) WHERE { ?s skg-o:launchedBy ?o }", [("4",)]),
        ("SELECT (COUNT(DISTINCT ?o) AS ?n) (GROUP_CONCAT(DISTINCT ?o; SEPARATOR=',') AS ?g) WHERE { ?s skg-o:partOf ?o }", [("1", f"{ENTITY}Q901553")]),
        ("SELECT ?x WHERE { ?x ^skg-o:partOf skg-r:Hubble }", [(f"{ENTITY}Q901553",)]),
        ("SELECT ?x WHERE { skg-r:Hubble skg-o:partOf? ?x }", [(f"{RESOURCE}Hubble",), (f"{ENTITY}Q901553",)]),
        ("SELECT (IF(BOUND(?q), 'y', 'n') AS ?b) WHERE { ?s skg-o:size ?n OPTIONAL { ?s skg-o:none ?q } }", [("n",)]),
        ("SELECT (STRAFTER(STR(?s), 'resource/') AS ?x) WHERE { ?s skg-o:size ?n }", [("SpaceX",)]),
        ("SELECT (REPLACE(?l, 'x$', 'Y', 'i') AS ?x) WHERE { ?s skg-o:size ?n ; rdfs:label ?l }", [("SpaceY",)]),
        ("SELECT ?s WHERE { ?s skg-o:size ?n FILTER(!(?n IN (1, 2))) FILTER(?n NOT IN (3)) }", [(f"{RESOURCE}SpaceX",)]),
        ("SELECT ?s WHERE { { SELECT ?s WHERE { ?s skg-o:size ?n } LIMIT 1 } }", [(f"{RESOURCE}SpaceX",)]),
        ("SELECT ?s WHERE { ?s rdfs:label ?l FILTER EXISTS { ?s skg-o:size ?n FILTER(STRLEN(?l) = 6) } }", [(f"{RESOURCE}SpaceX",)]),
    ],
)
def test_constructs(mini, text, answer):
    assert ask(mini, text) == sorted(answer)


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT ?x WHERE { ?x ?y }", "ASK", "CONSTRUCT { ?s ?p ?o OPTIONAL { ?a ?b ?c } } WHERE { ?s ?p ?o }", "DESCRIBE WHERE { ?s ?p ?o }", "SELECT ?x WHERE { ?x nope:p ?y }", "SELECT ?x { ?x a ?t } LIMIT x", "SELECT (FROB(?x) AS ?y) WHERE { ?x a ?t }"])
def test_errors(mini, text):
    with pytest.raises(SparqlError):
        sparql(mini, text)


UNSURE = [
    ("a", "p", "1"), ("b", "p", "2"), ("c", "p", "1"), ("a", "q", "x"), ("b", "r", "y"), ("x", "n", "k"), ("y", "n", "m"), ("z", "n", "k"), ("c", "s", "z"),
]


@pytest.mark.parametrize(
    "text,answer",
    [
        ("SELECT ?s ?v ?k WHERE { ?s x:p ?i OPTIONAL { ?s x:q ?v } OPTIONAL { ?v x:n ?k } }", [("a", "x", "k"), *[(s, v, k) for s in "bc" for v, k in (("x", "k"), ("y", "m"), ("z", "k"))]]),
        ("SELECT ?s ?v WHERE { ?s x:p ?i OPTIONAL { ?s x:q ?v } OPTIONAL { ?s x:r ?v } }", [("a", "x"), ("b", "y"), ("c", "None")]),
        ("SELECT ?s ?v WHERE { ?s x:p ?i OPTIONAL { ?s x:q ?v } { ?s x:p ?i OPTIONAL { ?s x:r ?v } } }", [("a", "x"), ("b", "y"), ("c", "None")]),
        ("SELECT ?s ?v WHERE { ?s x:p ?i OPTIONAL { ?s x:q ?v } MINUS { ?v x:n ?k } }", [("b", "None"), ("c", "None")]),
        ("SELECT ?s ?v WHERE { ?s x:p ?i OPTIONAL { ?s x:q ?v } FILTER EXISTS { ?v x:n ?k . ?w x:p ?i } }", [("a", "x"), ("b", "None"), ("c", "None")]),
        ("SELECT ?s ?v WHERE { ?s x:p ?i OPTIONAL { ?s x:q ?v } FILTER NOT EXISTS { ?v x:n 'none' } }", [("a", "x"), ("b", "None"), ("c", "None")]),
        ("SELECT ?v ?k WHERE { ?v x:n ?k OPTIONAL { ?s x:q ?v OPTIONAL { ?s x:zz ?k } } }", [("x", "k"), ("y", "m"), ("z", "k")]),
    ],
)
def test_variables_that_may_be_unbound(spark, text, answer):
    g = spark.createDataFrame([(f"u:{s}", "uri", f"u:{p}", f"u:{o}", "uri", "", "") for s, p, o in UNSURE], TRIPLE_SCHEMA)
    found = sparql(g, text.replace("'none'", "x:none"), {"x": "u:"})
    assert sorted(tuple(v.removeprefix("u:") for v in r.values()) for r in bindings(found)) == sorted(answer)


def test_optionals_of_unsure_variables_join_by_equality(spark):
    g = spark.createDataFrame([(f"u:{s}", "uri", f"u:{p}", f"u:{o}", "uri", "", "") for s, p, o in UNSURE], TRIPLE_SCHEMA)
    text = "SELECT ?s ?v WHERE { ?s x:p ?i OPTIONAL { ?s x:q ?v } OPTIONAL { ?s x:r ?v } }"
    assert "NestedLoop" not in sparql(g, text, {"x": "u:"})._jdf.queryExecution().executedPlan().toString()


def test_paths_from_bound_ends(spark):
    n = 10_000
    chain = [(f"u:n{i}", "uri", "u:next", f"u:n{i + 1}", "uri", "", "") for i in range(n)] + [("u:n9990", "uri", "u:is", "u:late", "uri", "", "")]
    g = spark.createDataFrame(chain, TRIPLE_SCHEMA).cache()
    count = lambda text: int(bindings(sparql(g, text, {"x": "u:"}))[0]["n"])
    assert count("SELECT (COUNT(?b) AS ?n) WHERE { x:n0 x:next+ ?b }") == n
    assert count("SELECT (COUNT(?a) AS ?n) WHERE { ?a x:next+ x:n25 }") == 25
    assert count("SELECT (COUNT(?b) AS ?n) WHERE { ?a x:is x:late . ?a x:next+ ?b }") == 10
    assert count("SELECT (COUNT(?b) AS ?n) WHERE { ?a x:is x:late . ?b x:next+ ?a }") == 9990
    assert count("SELECT (COUNT(*) AS ?n) WHERE { x:n0 x:next+ x:n10000 }") == 1


def test_the_driver_gets_a_bounded_answer(mini):
    assert len(bindings(sparql(mini, "SELECT ?s WHERE { ?s ?p ?o }"), 3)) == 3
    text, _, _ = rag.answer("q?", "s", mini, lambda p: "SELECT ?s WHERE { ?s ?p ?o }")
    assert text.endswith(f"… and {mini.count() - 10} more results")
    assert "skg-o:launchedBy" in rag.prompt("q?", "  skg-o:launchedBy    4 triples") and "Question: q?" in rag.prompt("q?", "")


def test_other_forms(mini):
    assert ask(mini, "ASK { skg-r:SpaceX a skg-o:SpaceAgency }") == [("true",)] and ask(mini, "ASK WHERE { skg-r:SpaceX a skg-o:Telescope }") == [("false",)]
    made = sparql(mini, "CONSTRUCT { ?o skg-o:crewOf ?m . ?m skg-o:has [ skg-o:is ?o ] } WHERE { ?m skg-o:hasAstronaut ?o }")
    assert made.columns == mini.columns and made.count() == 9 and made.where("s_kind = 'bnode'").count() == 3
    assert sparql(mini, "CONSTRUCT WHERE { ?s skg-o:partOf ?o }").count() == 2 and sparql(mini, "CONSTRUCT { ?l a ?s } WHERE { ?s rdfs:label ?l }").count() == 0
    assert sparql(mini, "DESCRIBE skg-r:SpaceX").count() == 4 and sparql(mini, "DESCRIBE ?t WHERE { ?t a skg-o:Telescope }").count() == 6
    assert sparql(mini, "DESCRIBE * WHERE { ?t skg-o:size ?n }").count() == 4


def test_joins_use_equal_keys(mini):
    plan = sparql(mini, "SELECT ?a WHERE { ?m skg-o:hasAstronaut ?a . ?m a ?t . ?a rdfs:label ?l }")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.count("Join Inner") == 2
    assert len(parse("SELECT * WHERE { ?s ?p ?o }", {}).where.elements) == 1


# --- answers ---


def test_query_extraction():
    head = rag.HEADER
    assert rag.extract_query("x\n```sparql\nSELECT ?a WHERE { ?a ?b ?c } LIMIT 5\n```") == f"{head}SELECT ?a WHERE {{ ?a ?b ?c }}"
    assert rag.extract_query("sure: select ?a where { ?a ?b ?c } bye") == f"{head}select ?a where {{ ?a ?b ?c }}"
    assert rag.extract_query("```\nPREFIX x: <y>\nSELECT ?a WHERE {}\n```") == f"{head}SELECT ?a WHERE {{}}"
    assert rag.extract_query("nothing") == head + "nothing"


def test_answers_and_repairs(mini):
    calls = []

    def model(prompt):
        calls.append(prompt)
        return ["SELECT broken", "SELECT ?x WHERE { ?x skg-o:none ?y }", rag.simple_query("g", "t", "partOf", "hubble")][len(calls) - 1]

    text, _, repairs = rag.answer("q?", "schema", mini, model)
    assert repairs == 2 and "Q901553" in text and "no results" in calls[2]
    text, _, repairs = rag.answer("q?", "schema", mini, lambda p: "SELECT ?x WHERE { ?x skg-o:none ?y }")
    assert repairs == 3 and text.startswith("No answer")
    with pytest.raises(ZeroDivisionError):
        rag.answer("q?", "s", mini, lambda p: 1 / 0)
    assert rag.baseline("q", lambda p: 1 / 0).startswith("(model error")


def test_preset_questions(mini):
    results = rag.evaluate(mini)
    assert [bool("Q" in r["rag_answer"] or "Armstrong" in r["rag_answer"]) and r["retries"] == 0 for r in results] == [True, True, True, True, False]
    assert results[4]["retries"] == 3
    assert rag.report(results).count("## Q") == 5
    assert rag.format_results([{"a": str(i)} for i in range(12)]).endswith("… and 2 more results") and rag.format_results([]) == "(No results found)"


def test_chat_loop(mini):
    from graphloom.cli import chat

    lines, said = iter(["help", "schema", "baseline", "What is the Hubble Space Telescope part of?", "", "quit"]), []
    chat(mini, read=lambda _: next(lines), write=said.append)
    assert any("Q901553" in s for s in said) and "baseline on" in said
