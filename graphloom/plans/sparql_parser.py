"""A recursive-descent parser of SPARQL 1.1 SELECT into plain tuples and small classes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from graphloom.terms import RDF, XSD

TOKEN = re.compile(
    r"""\s+|\#[^\n]*
  |(?P<iri><[^<>"{}|^`\\\s]*>)
  |(?P<var>[?$][A-Za-z0-9_]+)
  |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<number>[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+(?:[eE][+-]?[0-9]+)?)
  |(?P<blank>_:[A-Za-z0-9_]+)
  |(?P<name>[A-Za-z][\w.-]*?:(?:[\w-]|\.(?=[\w-])|%[0-9A-Fa-f]{2})*|:(?:[\w-]|\.(?=[\w-])|%[0-9A-Fa-f]{2})*|[A-Za-z_]\w*)
  |(?P<op>\^\^|\|\||&&|!=|<=|>=|[{}()\[\].;,=<>!+\-*/|^?])""",
    re.VERBOSE,
)
ESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class SparqlError(ValueError):
    """The text is no query that this engine can read."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    kind: str
    value: str
    datatype: str = ""
    lang: str = ""


@dataclass
class Group:
    """Elements in order: ("triple", s, path, o), ("filter", e), ("optional", g), ("union", [g]),
    ("minus", g), ("bind", e, name), ("values", names, rows), ("select", q), ("group", g)."""

    elements: list = field(default_factory=list)


@dataclass
class Select:
    items: list | None  # (name, expression or None); None is *
    where: Group
    distinct: bool = False
    group_by: list = field(default_factory=list)  # (expression, name or None)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0
    form: str = "SELECT"  # or ASK, CONSTRUCT, DESCRIBE
    template: list = field(default_factory=list)  # CONSTRUCT: triples; DESCRIBE: variables and constants


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1] or "0", 16))
        if m[2]:
            return chr(int(m[2], 16))
        return ESCAPE.get(m[3], m[3])

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.DOTALL)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.prefixes, self.base, self.fresh = dict(prefixes or {}), "", 0
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    # --- tokens ---

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.peek(-1)

    def word(self, *words: str) -> str | None:
        kind, text = self.peek()
        if kind == "name" and text.upper() in words:
            self.at += 1
            return text.upper()
        return None

    def op(self, *ops: str) -> str | None:
        kind, text = self.peek()
        if kind == "op" and text in ops:
            self.at += 1
            return text
        return None

    def need(self, what: str) -> None:
        if not (self.op(what) or self.word(what)):
            raise SparqlError(f"expected {what} at {self.peek()[1]!r}")

    def new_var(self) -> Var:
        self.fresh += 1
        return Var(f"__{self.fresh}")

    # --- query ---

    def query(self) -> Select:
        while word := self.word("PREFIX", "BASE"):
            if word == "BASE":
                self.base = self.next()[1][1:-1]
                continue
            name, iri = self.next()[1], self.next()
            if not name.endswith(":") or iri[0] != "iri":
                raise SparqlError("bad PREFIX")
            self.prefixes[name[:-1]] = iri[1][1:-1]
        form = self.word("ASK", "CONSTRUCT", "DESCRIBE")
        query = getattr(self, form.lower())() if form else self.select()
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return query

    def ask(self) -> Select:
        self.word("WHERE")
        return self.modifiers(Select(None, self.group(), form="ASK"))

    def construct(self) -> Select:
        template = None if self.word("WHERE") else self.group()
        if template is not None:
            self.need("WHERE")
        where = self.group()
        triples = (template or where).elements
        if any(e[0] != "triple" for e in triples) or any(not isinstance(e[2], (Var, Const)) for e in triples):
            raise SparqlError("a template holds plain triples")
        return self.modifiers(Select(None, where, form="CONSTRUCT", template=[e[1:] for e in triples]))

    def describe(self) -> Select:
        wanted: list = []
        if not self.op("*"):
            while self.peek()[0] in ("var", "iri", "pname") or (self.peek()[0] == "name" and ":" in self.peek()[1]):
                wanted.append(self.node())
            if not wanted:
                raise SparqlError("nothing is described")
        has_where = self.word("WHERE") or self.peek()[1] == "{"
        where = self.group() if has_where else Group()
        return self.modifiers(Select(None, where, form="DESCRIBE", template=wanted))

    def select(self) -> Select:
        self.need("SELECT")
        distinct = self.word("DISTINCT", "REDUCED") == "DISTINCT"
        items: list | None = []
        if self.op("*"):
            items = None
        else:
            while True:
                kind, text = self.peek()
                if kind == "var":
                    items.append((self.next()[1][1:], None))
                elif self.op("("):
                    e = self.expression()
                    self.need("AS")
                    items.append((self.next()[1][1:], e))
                    self.need(")")
                elif kind == "name" and text.upper() in AGGREGATES:  # a bare aggregate with AS
                    e = self.expression()
                    self.need("AS")
                    items.append((self.next()[1][1:], e))
                else:
                    break
            if not items:
                raise SparqlError("nothing is selected")
        self.word("WHERE")
        return self.modifiers(Select(items, self.group(), distinct))

    def modifiers(self, query: Select) -> Select:
        if self.word("GROUP"):
            self.need("BY")
            while True:
                if self.peek()[0] == "var":
                    name = self.next()[1][1:]
                    query.group_by.append((("var", name), name))
                elif self.op("("):
                    e, name = self.expression(), None
                    if self.word("AS"):
                        name = self.next()[1][1:]
                    self.need(")")
                    query.group_by.append((e, name))
                elif self.peek()[0] == "name" and self.peek(1)[1] == "(" and self.peek()[1].upper() != "HAVING":
                    query.group_by.append((self.primary(), None))
                else:
                    break
        if self.word("HAVING"):
            while self.peek()[1] == "(" or (self.peek()[0] == "name" and self.peek(1)[1] == "("):
                query.having.append(self.primary())
        if self.word("ORDER"):
            self.need("BY")
            while True:
                if way := self.word("ASC", "DESC"):
                    self.need("(")
                    query.order_by.append((self.expression(), way == "DESC"))
                    self.need(")")
                elif self.peek()[0] == "var":
                    query.order_by.append((("var", self.next()[1][1:]), False))
                elif self.peek()[1] == "(" or (self.peek()[0] == "name" and self.peek(1)[1] == "("):
                    query.order_by.append((self.primary(), False))
                else:
                    break
        while word := self.word("LIMIT", "OFFSET"):
            kind, n = self.next()
            if kind != "number" or not n.isdigit():
                raise SparqlError(f"bad {word}")
            if word == "LIMIT":
                query.limit = int(n)
            else:
                query.offset = int(n)
        if self.word("VALUES"):
            query.where.elements.append(self.values())
        return query

    # --- patterns ---

    def group(self) -> Group:
        self.need("{")
        if self.peek()[0] == "name" and self.peek()[1].upper() == "SELECT":
            inner = self.select()
            self.need("}")
            return Group([("select", inner)])
        group = Group()
        while not self.op("}"):
            if self.op("."):
                continue
            if self.word("FILTER"):
                group.elements.append(("filter", self.constraint()))
            elif self.word("OPTIONAL"):
                group.elements.append(("optional", self.group()))
            elif self.word("MINUS"):
                group.elements.append(("minus", self.group()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                group.elements.append(("bind", e, self.next()[1][1:]))
                self.need(")")
            elif self.word("VALUES"):
                group.elements.append(self.values())
            elif self.peek()[1] == "{":
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                group.elements.append(("union", parts) if len(parts) > 1 else ("group", parts[0]))
            else:
                self.triples(group)
        return group

    def values(self) -> tuple:
        names = []
        if self.op("("):
            while not self.op(")"):
                names.append(self.next()[1][1:])
            single = False
        else:
            names, single = [self.next()[1][1:]], True
        self.need("{")
        rows = []
        while not self.op("}"):
            if single:
                rows.append([self.value()])
            else:
                self.need("(")
                row = []
                while not self.op(")"):
                    row.append(self.value())
                rows.append(row)
        return ("values", names, rows)

    def value(self) -> Const | None:
        return None if self.word("UNDEF") else self.node()

    def triples(self, group: Group) -> None:
        subject = self.subject(group)
        if self.peek()[1] in (".", "}"):
            return
        self.properties(subject, group)

    def properties(self, subject, group: Group) -> None:
        while True:
            path = self.verb()
            while True:
                group.elements.append(("triple", subject, path, self.subject(group)))
                if not self.op(","):
                    break
            while self.op(";"):
                if self.peek()[1] in (".", "}", "]", ";"):
                    continue
                break
            else:
                return
            if self.peek()[1] in (".", "}", "]"):
                return

    def subject(self, group: Group):
        if self.op("["):
            node = self.new_var()
            if not self.op("]"):
                self.properties(node, group)
                self.need("]")
            return node
        return self.node()

    def verb(self):
        if self.peek()[0] == "var":
            return Var(self.next()[1][1:])
        return self.path()

    def path(self):
        parts = [self.sequence()]
        while self.op("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alternative", parts)

    def sequence(self):
        parts = [self.step()]
        while self.op("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("sequence", parts)

    def step(self):
        inverse = bool(self.op("^"))
        if self.op("("):
            step = self.path()
            self.need(")")
        elif self.peek() == ("name", "a"):
            self.next()
            step = Const("uri", f"{RDF}type")
        else:
            step = self.node()
            if not isinstance(step, Const) or step.kind != "uri":
                raise SparqlError("a predicate must be an IRI or a variable")
        if many := self.op("*", "+", "?"):
            step = ("repeat", step, many)
        return ("inverse", step) if inverse else step

    def iri(self, text: str) -> str:
        return self.base + text if self.base and "://" not in text else text

    def node(self):
        kind, text = self.next()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            return Const("uri", self.iri(unescape(text[1:-1])))
        if kind == "blank":
            return Var(f"__{text[2:]}")
        if kind == "string":
            return self.literal(text)
        if kind == "number":
            return self.number(text)
        if kind == "op" and text in "+-" and self.peek()[0] == "number":
            return self.number((text if text == "-" else "") + self.next()[1])
        if kind == "name":
            if text in ("true", "false"):
                return Const("literal", text, f"{XSD}boolean")
            if ":" in text:
                prefix, _, local = text.partition(":")
                if prefix not in self.prefixes:
                    raise SparqlError(f"unknown prefix {prefix!r}")
                return Const("uri", self.prefixes[prefix] + local)
        raise SparqlError(f"unexpected {text!r}")

    def literal(self, text: str) -> Const:
        body = unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
        if self.peek()[0] == "lang":
            return Const("literal", body, "", self.next()[1][1:].lower())
        if self.op("^^"):
            return Const("literal", body, self.node().value)
        return Const("literal", body)

    @staticmethod
    def number(text: str) -> Const:
        kind = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
        return Const("literal", text, f"{XSD}{kind}")

    # --- expressions: ("var", n), ("const", c), ("op", name, args), ("call", NAME, args),
    # ("exists", group, positive), ("aggregate", NAME, expression or None, distinct, separator) ---

    def constraint(self):
        if self.peek()[1] == "(":
            self.need("(")
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self):
        left = self.conjunction()
        while self.op("||"):
            left = ("op", "||", [left, self.conjunction()])
        return left

    def conjunction(self):
        left = self.relation()
        while self.op("&&"):
            left = ("op", "&&", [left, self.relation()])
        return left

    def relation(self):
        left = self.sum()
        if what := self.op("=", "!=", "<", ">", "<=", ">="):
            return ("op", what, [left, self.sum()])
        negated = self.word("NOT")
        if self.word("IN"):
            self.need("(")
            args = [left]
            while not self.op(")"):
                args.append(self.expression())
                self.op(",")
            found = ("op", "in", args)
            return ("op", "!", [found]) if negated else found
        if negated:
            self.at -= 1
        return left

    def sum(self):
        left = self.product()
        while what := self.op("+", "-"):
            left = ("op", what, [left, self.product()])
        return left

    def product(self):
        left = self.unary()
        while what := self.op("*", "/"):
            left = ("op", what, [left, self.unary()])
        return left

    def unary(self):
        if self.op("!"):
            return ("op", "!", [self.unary()])
        if self.op("-"):
            return ("op", "neg", [self.unary()])
        self.op("+")
        return self.primary()

    def primary(self):
        if self.op("("):
            e = self.expression()
            self.need(")")
            return e
        kind, text = self.peek()
        if kind == "var":
            return ("var", self.next()[1][1:])
        if kind == "name" and ":" not in text and text not in ("true", "false"):
            name = self.next()[1].upper()
            if name == "NOT" or name == "EXISTS":
                if name == "NOT":
                    self.need("EXISTS")
                return ("exists", self.group(), name == "EXISTS")
            self.need("(")
            if name in AGGREGATES:
                distinct, separator, inner = bool(self.word("DISTINCT")), " ", None
                if not self.op("*"):
                    inner = self.expression()
                if self.op(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    separator = self.node().value
                self.need(")")
                return ("aggregate", name, inner, distinct, separator)
            args = []
            while not self.op(")"):
                args.append(self.expression())
                self.op(",")
            return ("call", name, args)
        node = self.node()
        if isinstance(node, Const) and node.kind == "uri" and self.op("("):  # a cast such as xsd:integer(?x)
            e = self.expression()
            self.need(")")
            return ("call", "CAST:" + node.value, [e])
        return ("const", node)


def parse(text: str, prefixes: dict[str, str] | None = None) -> Select:
    return Parser(text, prefixes).query()
