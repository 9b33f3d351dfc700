"""Rules and ontology inference as joins iterated to a fixpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut, reachable, saturate, transitive_closure
from graphloom.terms import DOMAIN, EQUIVALENT_PROPERTY, ONTOLOGY, OWL, RANGE, RDF, SAME_AS, SUBCLASS, SUBPROPERTY, TYPE

SPO = ("s", "p", "o")


def typed(graph: DataFrame, cls: str) -> DataFrame:
    return graph.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()


def over_age(graph: DataFrame, person: str, age: str, least: float = 60) -> DataFrame:
    """Person(x), age(x, a), a > ``least``: strictly, and any of several ages will do."""
    ages = graph.where((F.col("p") == age) & (F.col("o").try_cast("double") > least)).select("s").distinct()
    return typed(graph, person).join(ages, "s", "left_semi")


def commanders(graph: DataFrame, astronaut: str = f"{ONTOLOGY}Astronaut", commands: str = f"{ONTOLOGY}isCommanderOf") -> DataFrame:
    """Astronaut(x), isCommanderOf(x, m)."""
    return typed(graph, astronaut).join(graph.where(F.col("p") == commands).select("s"), "s", "left_semi")


def ensure_vocabulary(graph: DataFrame, classes: tuple[str, ...] = (), properties: tuple[str, ...] = ()) -> DataFrame:
    """The graph with a declaration of each class and property that it lacks."""
    wanted = [(c, f"{OWL}Class") for c in classes] + [(p, f"{OWL}ObjectProperty") for p in properties]
    rows = graph.sparkSession.createDataFrame([(s, "uri", TYPE, o, "uri", "", "") for s, o in wanted], graph.schema)
    declared = graph.where(F.col("p") == TYPE).select("s")
    return graph.unionByName(rows.join(declared, "s", "left_anti").select(*graph.columns))


def demo_commanders(spark: SparkSession) -> list[str]:
    """The rule on a constant example, for where there is no ontology."""
    astronauts = spark.createDataFrame([(a,) for a in ("Neil Armstrong", "Pete Conrad", "Alan Shepard", "John Young")], "name string")
    missions = spark.createDataFrame([("Neil Armstrong", "Apollo 11"), ("Pete Conrad", "Apollo 12"), ("Alan Shepard", "Apollo 14")], "name string, mission string")
    return [r["name"] for r in astronauts.join(missions, "name", "left_semi").orderBy("name").collect()]


def subclass_closure(graph: DataFrame) -> DataFrame:
    """(a, b): a is below b, directly or not."""
    return transitive_closure(graph.where(F.col("p") == SUBCLASS).select(F.col("s").alias("a"), F.col("o").alias("b")))


def restrictions(graph: DataFrame) -> DataFrame:
    """(cls, on, filler): defined classes ``cls`` = base and some ``on`` filler (null filler: at least one)."""
    owl = lambda name: F.col("p") == f"{OWL}{name}"
    of = lambda name, column: graph.where(owl(name)).select(F.col("s").alias("r"), F.col("o").alias(column))
    least = graph.where(owl("minCardinality") | owl("minQualifiedCardinality")).select(F.col("s").alias("r"), F.lit(None).cast("string").alias("filler"))
    return of("onProperty", "on").join(of("someValuesFrom", "filler").unionByName(least), "r")


def definitions(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cls, part) named parts, (cls, on, filler) restriction parts) of classes that are equivalent to an
    intersection. Lists are followed over rdf:rest from their heads."""
    heads = graph.where(F.col("p") == f"{OWL}intersectionOf").select(F.col("s").alias("x"), F.col("o").alias("cell"))
    rest = graph.where(F.col("p") == f"{RDF}rest").select(F.col("s").alias("a"), F.col("o").alias("b"))
    rest = reachable(rest, heads.select(F.col("cell").alias("a")))
    cells = heads.unionByName(heads.join(rest, F.col("cell") == F.col("a")).select("x", F.col("b").alias("cell")))
    first = graph.where(F.col("p") == f"{RDF}first").select(F.col("s").alias("cell"), F.col("o").alias("part"), F.col("o_kind").alias("kind"))
    members = cells.join(first, "cell").select("x", "part", "kind")
    equivalent = graph.where(F.col("p") == f"{OWL}equivalentClass").select(F.col("s").alias("cls"), F.col("o").alias("x"), F.col("o_kind").alias("x_kind"))
    named = equivalent.join(members, "x").unionByName(graph.where(F.col("p") == f"{OWL}intersectionOf").select("s").distinct().join(members, F.col("s") == F.col("x")).where("s not like '_:%'").select("x", F.col("s").alias("cls"), F.lit("uri").alias("x_kind"), "part", "kind"))
    bare = equivalent.where("x_kind = 'bnode'").join(members.select("x").distinct(), "x", "left_anti").select("cls", F.col("x").alias("part"))
    parts = named.where("kind = 'uri'").select("cls", "part").distinct()
    some = named.where("kind = 'bnode'").select("cls", "part").unionByName(bare)
    return parts, some.join(restrictions(graph), some["part"] == F.col("r")).select("cls", "on", "filler").distinct()


def _small_definitions(rows: list) -> tuple[set, set]:
    """``definitions`` of an ontology's rows in memory."""
    owl = lambda name: [(r["s"], r["o"], r["o_kind"]) for r in rows if r["p"] == f"{OWL}{name}"]
    after = _closed({(r["s"], r["o"]) for r in rows if r["p"] == f"{RDF}rest"})
    first: dict = {}
    for r in rows:
        if r["p"] == f"{RDF}first":
            first.setdefault(r["s"], set()).add((r["o"], r["o_kind"]))
    members: dict = {}
    for x, head, _ in owl("intersectionOf"):
        for cell in {head} | after.get(head, set()):
            members.setdefault(x, set()).update(first.get(cell, ()))
    held = {(cls, m) for cls, x, _ in owl("equivalentClass") for m in members.get(x, ())} | {(x, m) for x, found in members.items() if not x.startswith("_:") for m in found}
    inner = {(cls, part) for cls, (part, kind) in held if kind == "bnode"} | {(cls, x) for cls, x, kind in owl("equivalentClass") if kind == "bnode" and x not in members}
    fillers = [(r, f) for r, f, _ in owl("someValuesFrom")] + [(r, None) for name in ("minCardinality", "minQualifiedCardinality") for r, _, _ in owl(name)]
    some = {(cls, on, filler) for cls, part in inner for r, on, _ in owl("onProperty") if r == part for q, filler in fillers if q == r}
    return {(cls, part) for cls, (part, kind) in held if kind == "uri"}, some


#: Predicates that say something about classes and properties, and kinds of properties.
VOCABULARY = (SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, EQUIVALENT_PROPERTY, f"{RDF}first", f"{RDF}rest", *(f"{OWL}{n}" for n in ("inverseOf", "equivalentClass", "intersectionOf", "onProperty", "someValuesFrom", "minCardinality", "minQualifiedCardinality")))
PROPERTY_KINDS = (f"{OWL}SymmetricProperty", f"{OWL}TransitiveProperty")
#: Ontologies of at most so many statements are closed at the driver, and rule tables of at most so many
#: rows become constants of the plan and are broadcast; larger ones are tables.
SMALL_ONTOLOGY = 50_000
SMALL_RULES = 500_000


def _closed(edges: set[tuple]) -> dict:
    """What each node reaches, itself left out unless it is on a cycle."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in after:
        seen, queue = set(), list(after[a])
        while queue:
            if (x := queue.pop()) not in seen:
                seen.add(x)
                queue += after.get(x, ())
        out[a] = seen
    return out


def _small_rules(rows: list[tuple[str, str, str]], same_as: bool) -> tuple[set, set, set]:
    """``_rule_tables`` of an ontology's rows in memory."""
    of = lambda *p: {(s, o) for s, q, o in rows if q in p}
    equal = of(EQUIVALENT_PROPERTY) if same_as else set()
    up = of(SUBPROPERTY) | equal | {(b, a) for a, b in equal}
    inverse = of(f"{OWL}inverseOf")
    turned = inverse | {(b, a) for a, b in inverse} | {(s, s) for s, q, o in rows if q == TYPE and o == PROPERTY_KINDS[0]}
    # A property, as it stands (False) or turned round (True).
    steps = {((a, t), (b, t)) for a, b in up for t in (False, True)} | {((a, t), (b, not t)) for a, b in turned for t in (False, True)}
    properties = {(a, b, back) for (a, t), found in _closed(steps).items() if not t for b, back in found} - {(a, a, False) for a, _ in up | turned}
    above = _closed(of(SUBCLASS))
    classes = {(a, b) for a, found in above.items() for b in found if a != b}
    ends = [(p, end, c) for kind, end in ((DOMAIN, "s"), (RANGE, "o")) for p, c in of(kind)]
    other = {"s": "o", "o": "s"}
    # (property, end that gets the class, class, whether the fact that calls for it is a turned one)
    types = {(p, end, c, False) for p, end, c in ends}
    types |= {(a, other[end] if back else end, c, back) for a, b, back in properties for p, end, c in ends if p == b}
    types |= {(p, end, up_, back) for p, end, c, back in types for up_ in above.get(c, ())}
    return properties, classes, types


def _rule_tables(rules: DataFrame, rows: list | None, same_as: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What follows without recursion over facts: ``properties`` (p, other, turned), ``classes`` (o, up) and
    ``types`` (p, end, cls, turned), all closed: hierarchies, inverses and symmetry are followed to their
    ends in the tables, so that one join with the facts gives everything."""
    spark = rules.sparkSession
    schemas = ("p string, other string, turned boolean", "o string, up string", "p string, end string, cls string, turned boolean")
    if rows is not None:
        made = _small_rules([(r["s"], r["p"], r["o"]) for r in rows], same_as)
        return tuple(F.broadcast(df) if len(x) <= SMALL_RULES else df for x, schema in zip(made, schemas, strict=True) for df in [spark.createDataFrame(sorted(x), schema)])
    of = lambda p, a, b: rules.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    up, turned = of(SUBPROPERTY, "x", "y"), of(f"{OWL}inverseOf", "x", "y")
    if same_as:
        equal = of(EQUIVALENT_PROPERTY, "x", "y")
        up = up.unionByName(equal).unionByName(equal.select(F.col("y").alias("x"), F.col("x").alias("y")))
    turned = turned.unionByName(turned.select(F.col("y").alias("x"), F.col("x").alias("y")))
    turned = turned.unionByName(rules.where((F.col("p") == TYPE) & (F.col("o") == PROPERTY_KINDS[0])).select(F.col("s").alias("x"), F.col("s").alias("y")))
    at = lambda c, t: F.struct(F.col(c).alias("p"), F.lit(t).alias("t"))
    steps = [edges.select(at("x", t).alias("a"), at("y", t != back).alias("b")) for edges, back in ((up, False), (turned, True)) for t in (False, True)]
    closed = transitive_closure(reduce(DataFrame.unionByName, steps)).where("not a.t and a <> b")
    properties = closed.select(F.col("a.p").alias("p"), F.col("b.p").alias("other"), F.col("b.t").alias("turned"))
    classes = transitive_closure(of(SUBCLASS, "a", "b")).where("a <> b").toDF("o", "up")
    ends = of(DOMAIN, "p", "cls").withColumn("end", F.lit("s")).unionByName(of(RANGE, "p", "cls").withColumn("end", F.lit("o")))
    through = properties.join(ends.withColumnRenamed("p", "other"), "other")
    swapped = F.when(F.col("turned"), F.when(F.col("end") == "s", "o").otherwise("s")).otherwise(F.col("end"))
    types = ends.select("p", "end", "cls", F.lit(False).alias("turned")).unionByName(through.select("p", swapped.alias("end"), "cls", "turned"))
    types = types.unionByName(types.join(classes.toDF("cls", "up"), "cls").select("p", "end", F.col("up").alias("cls"), "turned")).distinct()
    return properties, classes, types


def _vocabulary(graph: DataFrame) -> tuple[DataFrame, list | None]:
    """The statements about the vocabulary, and, if they are few, their rows."""
    rules = graph.where(F.col("p").isin(*VOCABULARY) | ((F.col("p") == TYPE) & F.col("o").isin(*PROPERTY_KINDS)))
    rows = rules.limit(SMALL_ONTOLOGY + 1).collect()
    if len(rows) > SMALL_ONTOLOGY:
        return cut(rules), None
    return graph.sparkSession.createDataFrame(rows, graph.schema), rows


def infer(graph: DataFrame, same_as: bool = False) -> DataFrame:
    """The closure of a graph under its own ontology, as (s, p, o) rows, those given included: class and
    property hierarchies, domains and ranges, inverse, symmetric and transitive properties, classes
    defined by cardinality or existential restrictions; optionally equal individuals and properties.

    What needs no recursion over facts is one join with closed rule tables. Transitive properties,
    definitions and equal individuals, where the ontology has any, are rounds: each starts from what the
    last one found. If no rule can use what the definitions derive, there is one round."""
    # Objects that are literals neither get types nor turn round.
    facts = graph.select("s", "p", "o", (F.col("o_kind") != "literal").alias("node")).distinct()
    rules, rows = _vocabulary(graph)
    has = lambda *predicates: rows is None or any(r["p"] in predicates for r in rows)
    properties, classes, types_of = _rule_tables(rules, rows, same_as)
    node = F.lit(True).alias("node")

    def closed(found: DataFrame) -> DataFrame:
        """``found`` and what follows from each of its facts by itself."""
        out = [found]
        links, types = found.where(F.col("p") != TYPE), found.where(F.col("p") == TYPE)
        if has(SUBPROPERTY, f"{OWL}inverseOf", TYPE, EQUIVALENT_PROPERTY):
            more = links.join(properties, "p").where("node or not turned")
            out.append(more.select(*[F.when(F.col("turned"), F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("o", "s"), ("s", "o"))], F.col("other").alias("p"), "node").select("s", "p", "o", "node"))
        if has(DOMAIN, RANGE):
            typed_ends = links.join(types_of, "p").where("node or (end = 's' and not turned)")
            out.append(typed_ends.select(F.when(F.col("end") == "s", F.col("s")).otherwise(F.col("o")).alias("s"), F.lit(TYPE).alias("p"), F.col("cls").alias("o"), node))
        if has(SUBCLASS):
            out.append(types.join(classes, "o").select("s", "p", F.col("up").alias("o"), "node"))
        return reduce(DataFrame.unionByName, out)

    transitive = rules.where((F.col("p") == TYPE) & (F.col("o") == PROPERTY_KINDS[1])).select(F.col("s").alias("p")).distinct()
    has_transitive = rows is None or any(r["p"] == TYPE and r["o"] == PROPERTY_KINDS[1] for r in rows)
    has_definitions = has(f"{OWL}equivalentClass", f"{OWL}intersectionOf")
    once = not has_transitive and not same_as
    if has_definitions and rows is None:
        parts, some = (cut(x) for x in definitions(rules))
        wanted = cut(parts.groupBy("cls").agg(F.count(F.lit(1)).alias("n_parts")).join(some.groupBy("cls").agg(F.count(F.lit(1)).alias("n_some")), "cls", "full").fillna(0))
        has_definitions, once = not wanted.isEmpty(), False
    elif has_definitions:
        named_parts, some_parts = _small_definitions(rows)
        defined = sorted({x[0] for x in named_parts | some_parts})
        counts = [(c, sum(x[0] == c for x in named_parts), sum(x[0] == c for x in some_parts)) for c in defined]
        table = lambda x, schema: F.broadcast(graph.sparkSession.createDataFrame(x, schema))
        parts, some = table(sorted(named_parts), "cls string, part string"), table(sorted(some_parts, key=str), "cls string, on string, filler string")
        wanted = table(counts, "cls string, n_parts long, n_some long")
        # One round does where no definition asks for a defined class or one above it.
        above = _closed({(r["s"], r["o"]) for r in rows if r["p"] == SUBCLASS})
        asked = {x[1] for x in named_parts} | {x[2] for x in some_parts}
        has_definitions = bool(defined)
        once = once and not asked & {up for c in defined for up in {c} | above.get(c, set())} and TYPE not in {x[1] for x in some_parts}
    if not (has_transitive or has_definitions or same_as):
        return closed(facts).select(*SPO).distinct()

    def step(known: DataFrame, new: DataFrame) -> DataFrame:
        out = []
        if has_transitive:
            chain = lambda df: df.where(F.col("p") != TYPE).join(transitive, "p", "left_semi").where("node").select("p", "s", "o")
            tail = lambda x, y: x.select("p", "s", F.col("o").alias("mid")).join(y.select("p", F.col("s").alias("mid"), "o"), ["p", "mid"]).select("s", "p", "o", node)
            out += [tail(chain(new), chain(known)), tail(chain(known), chain(new))]
        if has_definitions:
            out.append(_defined(known, new, parts, some, wanted))
        if same_as:
            twins = lambda df: df.where((F.col("p") == SAME_AS) & F.col("node")).select(F.col("s").alias("x"), F.col("o").alias("twin")).unionByName(df.where((F.col("p") == SAME_AS) & F.col("node")).select(F.col("o").alias("x"), F.col("s").alias("twin"))).where("x <> twin").distinct()
            for facts_, equal in ((new, twins(known)), (known, twins(new))):
                out.append(facts_.join(equal, facts_["s"] == equal["x"]).select(F.col("twin").alias("s"), "p", "o", "node"))
                ends = facts_.where("node")
                out.append(ends.join(equal, ends["o"] == equal["x"]).select("s", "p", F.col("twin").alias("o"), "node"))
        return closed(reduce(DataFrame.unionByName, out))

    base = cut(closed(facts).distinct())
    if once:
        return base.unionByName(step(base, base)).select(*SPO).distinct()
    return saturate(base, step).select(*SPO)


def _defined(known: DataFrame, new: DataFrame, parts: DataFrame, some: DataFrame, wanted: DataFrame) -> DataFrame:
    """Types that definitions give to the subjects that something new may concern."""
    part_types = lambda df: df.where(F.col("p") == TYPE).join(parts.select(F.col("part").alias("o"), "cls"), "o").select("s", "cls", "o")
    edges = lambda df: df.join(some, df["p"] == some["on"]).select("s", F.col("o").alias("end"), "cls", "on", "filler")
    fillers = lambda df: df.where(F.col("p") == TYPE).select(F.col("s").alias("end"), F.col("o").alias("filler"))
    all_edges = edges(known)
    touched = part_types(new).select("s").unionByName(edges(new).select("s")).unionByName(all_edges.join(fillers(new), ["end", "filler"]).select("s")).distinct()
    named = part_types(known.join(touched, "s", "left_semi")).groupBy("s", "cls").agg(F.count_distinct("o").alias("have_parts"))
    mine = all_edges.join(touched, "s", "left_semi")
    met = mine.join(fillers(known), ["end", "filler"]).select("s", "cls", "on", "filler").unionByName(mine.where("filler is null").select("s", "cls", "on", "filler"))
    met = met.distinct().groupBy("s", "cls").agg(F.count(F.lit(1)).alias("have_some"))
    both = named.join(met, ["s", "cls"], "full").join(wanted, "cls").fillna(0, ["have_parts", "have_some"])
    return both.where("have_parts = n_parts and have_some = n_some").select("s", F.lit(TYPE).alias("p"), F.col("cls").alias("o"), F.lit(True).alias("node")).distinct()


def disjoint_violations(closed: DataFrame) -> DataFrame:
    """(s, a, b): members of two classes that are declared disjoint."""
    pairs = closed.where(F.col("p") == f"{OWL}disjointWith").select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    types = closed.where(F.col("p") == TYPE).select("s", "o")
    in_a, in_b = types.toDF("s", "a"), types.toDF("s", "b")
    return in_a.join(pairs, "a").join(in_b, ["s", "b"]).select("s", "a", "b")


def functional_violations(graph: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """(s, p, n): subjects with more than one value of a functional property."""
    if properties is None:
        properties = graph.where((F.col("p") == TYPE) & (F.col("o") == f"{OWL}FunctionalProperty")).select(F.col("s").alias("p"))
    return graph.join(properties, "p", "left_semi").groupBy("s", "p").agg(F.count_distinct("o").alias("n")).where("n > 1")
