"""SPARQL queries as DataFrame plans.

Every variable is a column of term structs (null: unbound). A basic graph pattern becomes self-joins
of the triple table on shared variables, most selective and connected pattern first; each scan keeps
its constants as plain filters, which reach the Parquet reader. OPTIONAL, UNION, MINUS and EXISTS are
left, union and semi or anti joins. Joins are by equality: where a shared variable may be unbound, each side
is split into rows with and without it, and each pair of parts joins on what both have bound. Expression
errors are nulls, so a filter on one is false."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import reachable, transitive_closure
from graphloom.plans.sparql_parser import Const, Group, Select, SparqlError, Var, parse
from graphloom.terms import PREFIXES, TERM_TYPE, XSD, constant, term

NUMERIC = tuple(f"{XSD}{t}" for t in ("integer", "decimal", "double", "float", "int", "long"))


class Solutions:
    """A DataFrame of term columns; ``sure`` are the variables that no row leaves unbound."""

    def __init__(self, df: DataFrame | None, names: list[str], sure: set[str]):
        self.df, self.names, self.sure = df, names, sure


class Lowering:
    def __init__(self, triples: DataFrame, predicate_counts: dict[str, int] | None = None):
        self.triples = triples
        self.spark = triples.sparkSession
        self.counts = predicate_counts or {}
        self.marks = 0

    # --- patterns ---

    def unit(self) -> Solutions:
        return Solutions(None, [], set())

    def group(self, group: Group, outer: Solutions | None = None) -> Solutions:
        found = outer or self.unit()
        filters, run = [], []
        for element in [*group.elements, ("end",)]:
            if element[0] == "triple":
                run.append(element[1:])
                continue
            if element[0] == "filter":
                filters.append(element[1])
                continue
            if run:
                found = self.join(found, self.bgp(run))
                run = []
            match element:
                case ("optional", inner):
                    found = self.optional(found, inner)
                case ("union", parts):
                    found = self.join(found, reduce(self.union, [self.group(p) for p in parts]))
                case ("group", inner):
                    found = self.join(found, self.group(inner))
                case ("minus", inner):
                    found = self.minus(found, self.group(inner))
                case ("select", query):
                    found = self.join(found, self.select(query))
                case ("values", names, rows):
                    found = self.join(found, self.values(names, rows))
                case ("bind", e, name):
                    base = self.frame(found)
                    found = Solutions(base.withColumn(name, self.term(e, found)), [*found.names, name], set(found.sure))
        for e in filters:
            found = self.filter(found, e)
        return found

    def frame(self, found: Solutions) -> DataFrame:
        return found.df if found.df is not None else self.spark.range(1).select()

    def scan(self, s, p, o) -> Solutions:
        df, names = self.triples, {}
        parts = {
            "s": (s, term(F.col("s_kind"), F.col("s"), F.lit(""), F.lit(""))),
            "p": (p, term(F.lit("uri"), F.col("p"), F.lit(""), F.lit(""))),
            "o": (o, term(F.col("o_kind"), F.col("o"), F.col("o_datatype"), F.col("o_lang"))),
        }
        for column, (x, made) in parts.items():
            if isinstance(x, Const):
                df = df.where(F.col(column) == x.value)
                if column == "s":
                    df = df.where(F.col("s_kind") == x.kind)
                if column == "o":
                    df = df.where((F.col("o_kind") == x.kind) & (F.coalesce("o_datatype", F.lit("")) == x.datatype) & (F.coalesce("o_lang", F.lit("")) == x.lang))
            elif x.name in names:
                df = df.where(names[x.name] == made)
            else:
                names[x.name] = made
        return Solutions(df.select(*[c.alias(n) for n, c in names.items()]), list(names), set(names))

    def pattern(self, s, path, o, before: Solutions | None = None) -> Solutions:
        """Solutions of one pattern. A repeated path is followed from an end that is a constant, or that
        ``before`` binds, and only otherwise from everywhere."""
        if isinstance(path, (Var, Const)):
            return self.scan(s, path, o)
        pairs = self.seeded(s, path, o, before) if path[0] == "repeat" and path[2] == "+" else self.pairs(path)
        ends = {"a": s, "b": o}
        names = {}
        for column, x in ends.items():
            if isinstance(x, Const):
                pairs = pairs.where(F.col(column) == constant(x.kind, x.value, x.datatype, x.lang))
            elif x.name in names:
                pairs = pairs.where(F.col(names[x.name]) == F.col(column))
            else:
                names[x.name] = column
        return Solutions(pairs.select(*[F.col(c).alias(n) for n, c in names.items()]), list(names), set(names))

    def seeded(self, s, path, o, before: Solutions | None) -> DataFrame:
        steps = self.pairs(path[1])
        known = lambda x: isinstance(x, Const) or before is not None and before.df is not None and x.name in before.sure

        def starts(x) -> DataFrame:
            if isinstance(x, Const):
                return self.spark.range(1).select(constant(x.kind, x.value, x.datatype, x.lang).alias("a"))
            return before.df.select(F.col(x.name).alias("a")).distinct()

        if isinstance(s, Const) or known(s) and not isinstance(o, Const):
            return reachable(steps, starts(s))
        if known(o):
            return reachable(steps.select(F.col("b").alias("a"), F.col("a").alias("b")), starts(o)).select(F.col("b").alias("a"), F.col("a").alias("b"))
        return transitive_closure(steps)

    def pairs(self, path) -> DataFrame:
        """(a, b) term pairs that a property path joins."""
        if isinstance(path, Const):
            return self.scan(Var("a"), path, Var("b")).df
        match path:
            case ("inverse", inner):
                return self.pairs(inner).select(F.col("b").alias("a"), F.col("a").alias("b"))
            case ("alternative", parts):
                return reduce(DataFrame.unionByName, [self.pairs(p) for p in parts])
            case ("sequence", parts):
                step = lambda x, y: x.alias("x").join(y.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
                return reduce(step, [self.pairs(p) for p in parts])
            case ("repeat", inner, many):
                pairs = self.pairs(inner)
                pairs = pairs.distinct() if many == "?" else transitive_closure(pairs)
                if many == "+":
                    return pairs
                nodes = self.scan(Var("a"), Var("p"), Var("b")).df
                nodes = nodes.select("a").unionByName(nodes.select(F.col("b").alias("a"))).distinct()
                return pairs.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()
        raise SparqlError(f"unknown path {path!r}")

    def bgp(self, patterns: list[tuple]) -> Solutions:
        """Cheapest pattern first, then always one that shares a variable, if there is any."""

        def cost(pattern: tuple) -> tuple:
            s, p, o = pattern
            fixed = 4 * isinstance(s, Const) + 2 * isinstance(o, Const) + isinstance(p, Const)
            return (-fixed, self.counts.get(p.value, 1 << 40) if isinstance(p, Const) else 1 << 50)

        left = list(patterns)
        found = self.unit()
        while left:
            variables = lambda t: {x.name for x in t if isinstance(x, Var)}
            linked = [t for t in left if variables(t) & set(found.names)] or left
            best = min(linked, key=cost)
            left.remove(best)
            found = self.join(found, self.pattern(*best, before=found))
        return found

    # --- joins ---

    def split(self, x: Solutions, names: list[str], side: str) -> Iterator[tuple[set[str], DataFrame]]:
        """The rows of ``x`` by which of ``names`` they bind; one part where all are sure."""
        unsure = [n for n in names if n not in x.sure]
        for bound in product((True, False), repeat=len(unsure)):
            part = self.frame(x)
            for n, is_bound in zip(unsure, bound, strict=True):
                part = part.where(F.col(n).isNotNull() if is_bound else F.col(n).isNull())
            yield set(names) - {n for n, is_bound in zip(unsure, bound, strict=True) if not is_bound}, part.alias(side)

    def matches(self, a: Solutions, b: Solutions, shared: list[str], extra: Column | None) -> Iterator[tuple[DataFrame, list[tuple[DataFrame, Column | None, set[str]]]]]:
        """Each part of ``a`` with the parts of ``b``, the condition (equality of what both bind, and
        ``extra``) and the names in it."""
        for has_a, left in self.split(a, shared, "l"):
            parts = []
            for has_b, right in self.split(b, sorted(has_a), "r"):
                on = [F.col(f"l.{n}") == F.col(f"r.{n}") for n in shared if n in has_a & has_b]
                on += [extra] if extra is not None else []
                parts.append((right, reduce(Column.__and__, on) if on else None, has_a & has_b))
            yield left, parts

    def join(self, a: Solutions, b: Solutions, how: str = "inner", extra: Column | None = None) -> Solutions:
        if a.df is None and how == "inner":
            return b
        if b.df is None:
            return a
        shared = [n for n in a.names if n in b.names]
        names = [*a.names, *[n for n in b.names if n not in shared]]
        columns = [(F.coalesce(F.col(f"l.{n}"), F.col(f"r.{n}")) if n in shared and n not in a.sure else F.col(f"l.{n}")).alias(n) for n in a.names]
        columns += [F.col(f"r.{n}") for n in b.names if n not in shared]
        out = []
        for left, parts in self.matches(a, b, shared, extra):
            if how == "left" and len(parts) == 1:
                right, on, _ = parts[0]
                out.append(left.join(right, on if on is not None else F.lit(True), "left").select(*columns))
                continue
            for right, on, _ in parts:
                out.append((left.crossJoin(right) if on is None else left.join(right, on)).select(*columns))
            if how == "left":
                for right, on, _ in parts:
                    left = left.join(right, on if on is not None else F.lit(True), "left_anti").alias("l")
                out.append(left.select(*[F.col(f"l.{n}") for n in a.names], *[F.lit(None).cast(TERM_TYPE).alias(n) for n in names[len(a.names) :]]))
        sure = a.sure | b.sure if how == "inner" else set(a.sure)
        return Solutions(reduce(DataFrame.unionByName, out), names, sure)

    def having(self, a: Solutions, b: Solutions, shared: list[str], extra: Column | None, positive: bool, must_share: bool = False) -> Solutions:
        """Rows of ``a`` that match some row of ``b`` (or none); with ``must_share``, rows that bind nothing
        in common don't match."""
        out = []
        for left, parts in self.matches(a, b, shared, extra):
            for right, on, names in parts:
                if must_share and not names:
                    continue
                on = on if on is not None else F.lit(True)
                if positive:
                    out.append(left.join(right, on, "left_semi").select("l.*"))
                left = left.join(right, on, "left_anti").alias("l")
            if not positive:
                out.append(left.select("l.*"))
        return Solutions(reduce(DataFrame.unionByName, out), a.names, a.sure)

    def optional(self, a: Solutions, inner: Group) -> Solutions:
        filters = [e[1] for e in inner.elements if e[0] == "filter"]
        b = self.group(Group([e for e in inner.elements if e[0] != "filter"]))
        if a.df is None:
            a = Solutions(self.frame(a), [], set())
        both = Solutions(None, [*a.names, *[n for n in b.names if n not in a.names]], set())
        side = {n: F.col(f"l.{n}") if n in a.names else F.col(f"r.{n}") for n in both.names}
        extra = reduce(Column.__and__, [F.coalesce(self.truth(e, both, side), F.lit(False)) for e in filters]) if filters else None
        return self.join(a, b, "left", extra)

    def union(self, a: Solutions, b: Solutions) -> Solutions:
        names = [*a.names, *[n for n in b.names if n not in a.names]]
        fill = lambda x: self.frame(x).select(*[F.col(n) if n in x.names else F.lit(None).cast(TERM_TYPE).alias(n) for n in names])
        return Solutions(fill(a).unionByName(fill(b)), names, a.sure & b.sure)

    def minus(self, a: Solutions, b: Solutions) -> Solutions:
        shared = [n for n in a.names if n in b.names]
        return self.having(a, b, shared, None, positive=False, must_share=True) if shared else a

    def values(self, names: list[str], rows: list) -> Solutions:
        data = [tuple((x.kind, x.value, x.datatype, x.lang) if x else None for x in row) for row in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` {TERM_TYPE}" for n in names))
        return Solutions(df, names, {n for i, n in enumerate(names) if all(row[i] for row in rows)})

    def filter(self, found: Solutions, e) -> Solutions:
        if e[0] == "op" and e[1] == "&&":
            return self.filter(self.filter(found, e[2][0]), e[2][1])
        positive = True
        while e[0] == "op" and e[1] == "!" and e[2][0][0] == "exists":
            e, positive = e[2][0], not positive
        if e[0] == "exists":
            return self.exists(found, e[1], e[2] == positive)
        bound = found.sure | ({e[2][0][1]} if e[0] == "call" and e[1] == "BOUND" else set())
        return Solutions(self.frame(found).where(F.coalesce(self.truth(e, found), F.lit(False))), found.names, bound)

    def exists(self, found: Solutions, group: Group, positive: bool) -> Solutions:
        """Rows with (or without) a solution of the group that agrees with them. Filters of the group may
        use the row's variables, so they belong to the join."""
        filters = [e[1] for e in group.elements if e[0] == "filter" and e[1][0] != "exists"]
        b = self.group(Group([e for e in group.elements if not (e[0] == "filter" and e[1][0] != "exists")]))
        shared = [n for n in found.names if n in b.names]
        both = Solutions(None, [*found.names, *[n for n in b.names if n not in shared]], set())
        side = {n: F.col(f"l.{n}") if n in found.names else F.col(f"r.{n}") for n in both.names}
        extra = reduce(Column.__and__, [F.coalesce(self.truth(e, both, side), F.lit(False)) for e in filters]) if filters else None
        return self.having(found, b, shared, extra, positive)

    # --- queries ---

    def select(self, query: Select) -> Solutions:
        found = self.group(query.where)
        items = query.items if query.items is not None else [(n, None) for n in found.names if not n.startswith("__")]
        has_aggregate = query.group_by or any(e is not None and holds_aggregate(e) for _, e in items) or any(holds_aggregate(e) for e in query.having)
        if has_aggregate:
            found, items, order = self.aggregate(query, found, items)
        else:
            order = query.order_by
            df = self.frame(found)
            for name, e in items:
                if e is not None:
                    df = df.withColumn(name, self.term(e, found))
                    found = Solutions(df, [*found.names, name], found.sure)
        df = self.frame(found)
        names = [n for n, _ in items]
        keys = []
        for i, (e, down) in enumerate(order):
            t = self.term(e, found)
            rank = F.when(t.isNull(), 0).when(t["kind"] == "bnode", 1).when(t["kind"] == "uri", 2).otherwise(3)
            number = try_number(t)
            parts = [rank, number, t["value"]]
            for j, part in enumerate(parts):
                df = df.withColumn(f"__o{i}_{j}", part)
                keys.append(F.col(f"__o{i}_{j}").desc_nulls_last() if down else F.col(f"__o{i}_{j}").asc_nulls_first())
        absent = [F.lit(None).cast(TERM_TYPE).alias(n) for n in names if n not in found.names]
        present = [F.col(n) for n in names if n in found.names]
        ordering = [f"__o{i}_{j}" for i in range(len(order)) for j in range(3)]
        df = df.select(*present, *absent, *ordering)
        if query.distinct:
            df = df.distinct() if not ordering else df.dropDuplicates(names)
        if keys:
            df = df.orderBy(*keys)
        if query.offset:
            df = df.offset(query.offset)
        if query.limit is not None:
            df = df.limit(query.limit)
        return Solutions(df.select(*names), names, {n for n in names if n in found.sure})

    def construct(self, query: Select) -> DataFrame:
        """The template's triples for every solution, as a set; those with an unbound or misplaced term are
        left out. A blank node of the template is a new one for each distinct solution."""
        found = self.select(query)
        base = self.frame(found)
        row = F.xxhash64(*[F.to_json(F.struct(F.col(n))) for n in found.names]) if found.names else F.lit(0)

        def made(x) -> Column:
            if isinstance(x, Const):
                return constant(x.kind, x.value, x.datatype, x.lang)
            if x.name.startswith("__"):
                return term(F.lit("bnode"), F.concat(F.lit(f"_:{x.name.strip('_')}x"), F.hex(row)), F.lit(""), F.lit(""))
            return F.col(x.name) if x.name in found.names else F.lit(None).cast(TERM_TYPE)

        rows = base.select(F.explode(F.array(*[F.struct(made(s).alias("s"), made(p).alias("p"), made(o).alias("o")) for s, p, o in query.template])).alias("t"))
        fine = rows.where((F.col("t.s.kind") != "literal") & (F.col("t.p.kind") == "uri") & F.col("t.o").isNotNull())
        return fine.select(
            F.col("t.s.value").alias("s"), F.col("t.s.kind").alias("s_kind"), F.col("t.p.value").alias("p"), F.col("t.o.value").alias("o"), F.col("t.o.kind").alias("o_kind"),
            F.col("t.o.datatype").alias("o_datatype"), F.col("t.o.lang").alias("o_lang"),
        ).distinct()

    def describe(self, query: Select) -> DataFrame:
        """All triples about the things that are named or found: those that they are subjects of."""
        found = self.select(query) if query.where.elements else self.unit()
        wanted = query.template or [Var(n) for n in found.names]
        parts = [self.spark.createDataFrame([(x.value, x.kind)], "s string, s_kind string") for x in wanted if isinstance(x, Const)]
        parts += [found.df.select(F.col(x.name)["value"].alias("s"), F.col(x.name)["kind"].alias("s_kind")) for x in wanted if isinstance(x, Var) and x.name in found.names]
        if not parts:
            return self.triples.limit(0)
        things = reduce(DataFrame.unionByName, parts).where("s_kind <> 'literal'").distinct()
        return self.triples.join(things, ["s", "s_kind"], "left_semi").select(*self.triples.columns).distinct()

    def aggregate(self, query: Select, found: Solutions, items: list) -> tuple[Solutions, list, list]:
        keys, key_names = [], []
        for i, (e, name) in enumerate(query.group_by):
            name = name or f"__g{i}"
            keys.append(self.term(e, found).alias(name))
            key_names.append((name, e))
        made: dict[str, Column] = {}

        def lift(e):
            """The expression with its aggregates replaced by columns of the grouped table."""
            for name, key in key_names:
                if e == key:
                    return ("var", name)
            if e[0] == "aggregate":
                name = f"__a{len(made)}"
                made[name] = self.aggregated(e, found).alias(name)
                return ("var", name)
            if e[0] in ("op", "call"):
                return (e[0], e[1], [lift(x) for x in e[2]])
            return e

        lifted = [(n, lift(e) if e is not None else ("var", n)) for n, e in items]
        having = [lift(e) for e in query.having]
        order = [(lift(e), down) for e, down in query.order_by]
        base = self.frame(found)
        grouped = base.groupBy(*keys).agg(*made.values()) if made else base.select(*keys).distinct()
        names = [n for n, _ in key_names] + list(made)
        out = Solutions(grouped, names, set())
        for e in having:
            out = self.filter(out, e)
        df = out.df
        for name, e in lifted:
            if e != ("var", name):
                df = df.withColumn(name, self.term(e, out))
                names = [*names, name]
                out = Solutions(df, names, set())
        return out, items, order

    def aggregated(self, e, found: Solutions) -> Column:
        _, name, inner, distinct, separator = e
        if name == "COUNT":
            if inner is None:
                row = F.struct(*[F.coalesce(F.to_json(F.col(n)), F.lit("")) for n in found.names])
                n = F.count_distinct(row) if distinct else F.count(F.lit(1))
            else:
                t = self.term(inner, found)
                n = F.count_distinct(t) if distinct else F.count(t)
            return number_term(n, "integer")
        t = self.term(inner, found)
        if name == "SAMPLE":
            return F.min(t)
        if name == "GROUP_CONCAT":
            values = F.collect_set(t["value"]) if distinct else F.collect_list(t["value"])
            return text_term(F.array_join(F.array_sort(values), separator))
        if name in ("MIN", "MAX"):
            key = F.struct(try_number(t).alias("n"), *[t[c].alias(c) for c in ("value", "kind", "datatype", "lang")])
            best = (F.min if name == "MIN" else F.max)(F.when(t["kind"].isNotNull(), key))
            return F.when(best.isNotNull(), term(best["kind"], best["value"], best["datatype"], best["lang"]))
        n = try_number(t)
        if distinct:
            return number_term((F.sum_distinct if name == "SUM" else lambda c: F.sum_distinct(c) / F.count_distinct(c))(n), "double")
        return number_term(F.coalesce(F.sum(n), F.lit(0.0)) if name == "SUM" else F.coalesce(F.avg(n), F.lit(0.0)), "double")

    # --- expressions: pairs of (sort, column), sort one of term, text, number, truth ---

    def term(self, e, found: Solutions, side: dict | None = None) -> Column:
        sort, c = self.value(e, found, side)
        if sort == "term":
            return c
        if sort == "text":
            return text_term(c)
        if sort == "truth":
            return F.when(c.isNotNull(), term(F.lit("literal"), c.cast("string"), F.lit(f"{XSD}boolean"), F.lit("")))
        return number_term(c, "double")

    def text(self, e, found, side) -> Column:
        sort, c = self.value(e, found, side)
        return c["value"] if sort == "term" else c.cast("string")

    def number(self, e, found, side) -> Column:
        sort, c = self.value(e, found, side)
        return try_number(c) if sort == "term" else c.try_cast("double")

    def truth(self, e, found: Solutions, side: dict | None = None) -> Column:
        sort, c = self.value(e, found, side)
        if sort == "truth":
            return c
        if sort == "number":
            return c != 0
        if sort == "text":
            return F.length(c) > 0
        numeric = c["datatype"].isin(*NUMERIC)
        plain = (c["kind"] == "literal") & c["datatype"].isin("", f"{XSD}string")
        return F.when(c["datatype"] == f"{XSD}boolean", c["value"].isin("true", "1")).when(numeric, try_number(c) != 0).when(plain, F.length(c["value"]) > 0)

    def value(self, e, found: Solutions, side: dict | None = None) -> tuple[str, Column]:
        match e:
            case ("var", name):
                if name not in found.names:
                    return "term", F.lit(None).cast(TERM_TYPE)
                return "term", side[name] if side else F.col(name)
            case ("const", c):
                if isinstance(c, Var):
                    return self.value(("var", c.name), found, side)
                return "term", constant(c.kind, c.value, c.datatype, c.lang)
            case ("op", name, args):
                return self.operator(name, args, found, side)
            case ("call", name, args):
                return self.call(name, args, found, side)
        raise SparqlError(f"{e[0]} can't stand here")

    def operator(self, name: str, args: list, found, side) -> tuple[str, Column]:
        if name == "!":
            return "truth", ~self.truth(args[0], found, side)
        if name in ("&&", "||"):
            a, b = (self.truth(x, found, side) for x in args)
            return "truth", a & b if name == "&&" else a | b
        if name == "neg":
            return "number", -self.number(args[0], found, side)
        if name in ("+", "-", "*", "/"):
            a, b = (self.number(x, found, side) for x in args)
            return "number", F.try_divide(a, b) if name == "/" else {"+": a + b, "-": a - b, "*": a * b}[name]
        if name == "in":
            hits = [self.operator("=", [args[0], x], found, side)[1] for x in args[1:]]
            return "truth", reduce(Column.__or__, hits) if hits else F.lit(False)
        a, b = (self.term(x, found, side) for x in args)
        literal = (a["kind"] == "literal") & (b["kind"] == "literal")
        m, n = try_number(a), try_number(b)
        numbers = literal & m.isNotNull() & n.isNotNull()
        if name in ("=", "!="):
            # Plain and xsd:string literals are one kind; no datatype survives ingest, so numbers compare as numbers.
            same = F.when(numbers, m == n).otherwise((a["kind"] == b["kind"]) & (a["value"] == b["value"]) & (a["lang"] == b["lang"]))
            return "truth", same if name == "=" else ~same
        compare = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[name]
        return "truth", F.when(numbers, compare(m, n)).when(literal, compare(a["value"], b["value"]))

    def call(self, name: str, args: list, found, side) -> tuple[str, Column]:
        text = lambda i: self.text(args[i], found, side)
        number = lambda i: self.number(args[i], found, side)
        t = lambda i: self.term(args[i], found, side)
        date = lambda i: F.regexp_extract(text(i), r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})", {"YEAR": 1, "MONTH": 2, "DAY": 3}[name]).try_cast("int").cast("double")
        flags = lambda i: F.lit(f"(?{''.join(f for f in args[i][1].value if f in 'imsx')})") if len(args) > i and args[i][1].value else F.lit("")
        table = {
            "BOUND": lambda: ("truth", t(0).isNotNull()),
            "STR": lambda: ("text", text(0)),
            "LCASE": lambda: ("text", F.lower(text(0))),
            "UCASE": lambda: ("text", F.upper(text(0))),
            "STRLEN": lambda: ("number", F.length(text(0)).cast("double")),
            "CONTAINS": lambda: ("truth", F.contains(text(0), text(1))),
            "STRSTARTS": lambda: ("truth", F.startswith(text(0), text(1))),
            "STRENDS": lambda: ("truth", F.endswith(text(0), text(1))),
            "STRBEFORE": lambda: ("text", F.when(F.contains(text(0), text(1)), F.substring_index(text(0), args[1][1].value, 1) if args[1][0] == "const" and args[1][1].value else F.lit("")).otherwise("")),
            "STRAFTER": lambda: ("text", F.when(F.contains(text(0), text(1)), F.substring(text(0), F.locate(args[1][1].value, text(0)) + F.length(text(1)), F.length(text(0)))).otherwise("")),
            "SUBSTR": lambda: ("text", F.substring(text(0), number(1).cast("int"), number(2).cast("int") if len(args) > 2 else F.length(text(0)))),
            "CONCAT": lambda: ("text", F.concat(*[text(i) for i in range(len(args))])),
            "REPLACE": lambda: ("text", F.regexp_replace(text(0), F.concat(flags(3), text(1)), text(2))),
            "REGEX": lambda: ("truth", F.regexp_like(text(0), F.concat(flags(2), text(1)))),
            "LANG": lambda: ("text", F.when(t(0)["kind"] == "literal", t(0)["lang"])),
            "DATATYPE": lambda: ("term", term(F.lit("uri"), F.when(t(0)["datatype"] == "", f"{XSD}string").otherwise(t(0)["datatype"]), F.lit(""), F.lit(""))),
            "LANGMATCHES": lambda: ("truth", F.when(text(1) == "*", text(0) != "").otherwise((F.lower(text(0)) == F.lower(text(1))) | F.startswith(F.lower(text(0)), F.concat(F.lower(text(1)), F.lit("-"))))),
            "ISURI": lambda: ("truth", t(0)["kind"] == "uri"),
            "ISIRI": lambda: ("truth", t(0)["kind"] == "uri"),
            "ISLITERAL": lambda: ("truth", t(0)["kind"] == "literal"),
            "ISBLANK": lambda: ("truth", t(0)["kind"] == "bnode"),
            "ISNUMERIC": lambda: ("truth", t(0)["datatype"].isin(*NUMERIC)),
            "SAMETERM": lambda: ("truth", t(0) == t(1)),
            "COALESCE": lambda: ("term", F.coalesce(*[t(i) for i in range(len(args))])),
            "IF": lambda: ("term", F.when(self.truth(args[0], found, side), t(1)).when(~self.truth(args[0], found, side), t(2))),
            "URI": lambda: ("term", term(F.lit("uri"), text(0), F.lit(""), F.lit(""))),
            "IRI": lambda: ("term", term(F.lit("uri"), text(0), F.lit(""), F.lit(""))),
            "ABS": lambda: ("number", F.abs(number(0))),
            "ROUND": lambda: ("number", F.floor(number(0) + 0.5).cast("double")),
            "CEIL": lambda: ("number", F.ceil(number(0)).cast("double")),
            "FLOOR": lambda: ("number", F.floor(number(0)).cast("double")),
            "YEAR": lambda: ("number", date(0)),
            "MONTH": lambda: ("number", date(0)),
            "DAY": lambda: ("number", date(0)),
        }
        if name.startswith("CAST:"):
            return ("text", text(0)) if name.endswith("#string") else ("number", number(0))
        if name not in table:
            raise SparqlError(f"unknown function {name}")
        return table[name]()


def holds_aggregate(e) -> bool:
    return e[0] == "aggregate" or (e[0] in ("op", "call") and any(holds_aggregate(x) for x in e[2]))


def try_number(t: Column) -> Column:
    return F.when(t["kind"] == "literal", t["value"].try_cast("double"))


def text_term(c: Column) -> Column:
    return F.when(c.isNotNull(), term(F.lit("literal"), c, F.lit(""), F.lit("")))


def number_term(c: Column, kind: str) -> Column:
    whole = F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")) if kind == "double" else c.cast("string")
    return F.when(c.isNotNull(), term(F.lit("literal"), whole, F.lit(f"{XSD}{kind}"), F.lit("")))


def sparql(triples: DataFrame, text: str, prefixes: dict[str, str] | None = None, predicate_counts: dict[str, int] | None = None) -> DataFrame:
    """Answer a query over a triple table. SELECT: one string column per variable, null where unbound; ASK:
    one row, ``answer``, of true or false; CONSTRUCT and DESCRIBE: a graph, as a triple table.

    ``predicate_counts`` (from the graph's own statistics) orders joins; any or none gives the same rows."""
    query = parse(text, PREFIXES | (prefixes or {}))
    lowering = Lowering(triples, predicate_counts)
    if query.form == "CONSTRUCT":
        return lowering.construct(query)
    if query.form == "DESCRIBE":
        return lowering.describe(query)
    found = lowering.select(query)
    if query.form == "ASK":
        some = lowering.frame(found).select(F.lit(1).alias("x")).limit(1)
        return some.agg((F.count("x") > 0).cast("string").alias("answer"))
    return found.df.select(*[F.col(n)["value"].alias(n) for n in found.names])


#: Rows of an answer that come to the driver unless more are asked for.
MOST_BINDINGS = 10_000


def bindings(answer: DataFrame, most: int = MOST_BINDINGS) -> list[dict[str, str]]:
    """The first ``most`` rows as dictionaries of strings; an unbound variable reads ``None``. The answer
    itself is a DataFrame, so that larger ones can be written from executors."""
    return [{k: str(v) for k, v in row.asDict().items()} for row in answer.limit(most).collect()]


