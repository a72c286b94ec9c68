"""SHACL Compact Syntax: shapes as short text, to and from quads."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from quadspark.plans.parser import ParseError
from quadspark.sources.rdf_text import TurtleParser
from quadspark.terms import BNODE, INTEGER, IRI, RDF, RDFS, XSD, Term, iri, literal

SH, OWL = "http://www.w3.org/ns/shacl#", "http://www.w3.org/2002/07/owl#"
#: Prefixes that are there without being declared, parameters, kinds of nodes.
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "sh": SH, "xsd": XSD, "owl": OWL}
NODE_PARAMS = ("targetNode", "targetObjectsOf", "targetSubjectsOf", "deactivated", "severity", "message", "class", "datatype", "nodeKind", "minExclusive", "minInclusive", "maxExclusive", "maxInclusive", "minLength", "maxLength", "pattern", "flags", "languageIn", "equals", "disjoint", "closed", "ignoredProperties", "hasValue", "in")
PROPERTY_PARAMS = (*NODE_PARAMS[3:], "uniqueLang", "lessThan", "lessThanOrEquals", "qualifiedValueShape", "qualifiedMinCount", "qualifiedMaxCount", "qualifiedValueShapesDisjoint")
NODE_KINDS = ("BlankNode", "IRI", "Literal", "BlankNodeOrIRI", "BlankNodeOrLiteral", "IRIOrLiteral")


class ShaclcParser(TurtleParser):
    def __init__(self, text: str, base: str | None = None, scope: str = "") -> None:
        super().__init__(re.sub(r"\[\s*(\d+)\s*\.\.\s*(\d+|\*)\s*\]", r" [ \1 \2 ] ", text), base, scope)
        self.prefixes = dict(PREFIXES)
        self.out: list = []

    def add(self, s: Term, p: str, o: Term) -> None:
        self.out.append((s, p if ":" in p else SH + p, o, ""))

    def list_of(self, items: list[Term]) -> Term:
        head = iri(RDF + "nil")
        for x in reversed(items):
            cell = self.blank()
            self.add(cell, RDF + "first", x), self.add(cell, RDF + "rest", head)
            head = cell
        return head

    def quads(self) -> Iterator:
        doc = iri(self.base or "urn:x-base:default")
        while self.kind() != "end":
            if self.take("BASE"):
                self.base = self.next()[1:-1]
                doc = iri(self.base)
            elif self.take("IMPORTS"):
                self.add(doc, OWL + "imports", iri(self.iri()))
            elif self.take("PREFIX"):
                name = self.next()
                self.prefixes[name[:-1]] = self.resolve(self.next()[1:-1])
            elif self.is_("SHAPE", "SHAPECLASS"):
                whole = self.next().upper() == "SHAPECLASS"
                s = iri(self.iri())
                self.add(s, RDF + "type", iri(SH + "NodeShape"))
                if whole:
                    self.add(s, RDF + "type", iri(RDFS + "Class"))
                if self.take("-"):
                    self.expect(">")
                    while self.kind() in ("iri", "pname"):
                        self.add(s, "targetClass", iri(self.iri()))
                self.body(s)
            else:
                raise self.fail("a shape")
        self.out.append((doc, RDF + "type", iri(OWL + "Ontology"), ""))
        yield from self.out

    def body(self, s: Term) -> None:
        self.expect("{")
        while not self.take("}"):
            if self.kind() == "word" and self.peek(1) == "=" or self.is_("!") and self.kind(1) == "word" and self.peek(2) == "=":
                while not self.is_("."):
                    self.alternatives(s, NODE_PARAMS)
            else:
                self.property(s)
            self.expect(".")

    def property(self, s: Term) -> None:
        p = self.blank()
        self.add(s, "property", p)
        self.add(p, "path", self.path_term(self.path()))
        while not self.is_("."):
            if self.take("["):
                least, most = self.next(), self.next()
                if least != "0":
                    self.add(p, "minCount", literal(least, INTEGER))
                if most != "*":
                    self.add(p, "maxCount", literal(most, INTEGER))
                self.expect("]")
            else:
                self.alternatives(p, PROPERTY_PARAMS)

    def path_term(self, p: object) -> Term:
        from quadspark.plans.algebra import Alt, Closure, Inv, Link, Seq

        match p:
            case Link():
                return iri(p.iri)
            case Seq():
                return self.list_of([self.path_term(x) for x in p.parts])
        b = self.blank()
        match p:
            case Inv():
                self.add(b, "inversePath", self.path_term(p.path))
            case Alt():
                self.add(b, "alternativePath", self.list_of([self.path_term(x) for x in p.parts]))
            case Closure():
                self.add(b, {"?": "zeroOrOnePath", "+": "oneOrMorePath", "*": "zeroOrMorePath"}[p.kind], self.path_term(p.path))
        return b

    def alternatives(self, s: Term, params: tuple[str, ...]) -> None:
        """One constraint on s, or sh:or of several."""
        start = self.i
        self.out, kept = [], self.out
        self.negated(s, params)
        if not self.is_("|"):
            self.out = kept + self.out
            return
        self.i, self.out = start, kept
        items = []
        while True:
            b = self.blank()
            items.append(b)
            self.negated(b, params)
            if not self.take("|"):
                break
        self.add(s, "or", self.list_of(items))

    def negated(self, s: Term, params: tuple[str, ...]) -> None:
        if self.take("!"):
            b = self.blank()
            self.add(s, "not", b)
            s = b
        kind, word = self.kind(), self.peek()
        if kind == "word" and self.peek(1) == "=":
            if word not in params:
                raise ParseError(f"no such parameter: {word}")
            self.next(), self.next()
            self.add(s, word, self.values())
        elif kind == "word" and word in NODE_KINDS:
            self.next()
            self.add(s, "nodeKind", iri(SH + word))
        elif kind == "lang":  # @prefix:Name
            self.next()
            prefix = word[1:]
            self.add(s, "node", iri(self.prefixes[prefix] + self.next()[1:]))
        elif self.is_("{"):
            b = self.blank()
            self.add(s, "node", b)
            self.body(b)
        else:
            name = self.iri()
            self.add(s, "datatype" if name.startswith(XSD) or name == RDF + "langString" else "class", iri(name))

    def values(self) -> Term:
        if not self.take("["):
            return self.one()
        items = []
        while not self.take("]"):
            items.append(self.one())
        return self.list_of(items)

    def one(self) -> Term:
        return iri(self.iri()) if self.kind() in ("iri", "pname") else self.literal()


def parse_shaclc(text: str, base: str | None = None, scope: str = "") -> Iterator:
    return ShaclcParser(text, base, scope).quads()


def shaclc_text(quads: list, prefixes: dict[str, str] | None = None) -> str:
    """Compact text of shapes, from (s, p, o, g) terms; ValueError for what it can't say."""
    facts: dict[Term, dict[str, list[Term]]] = defaultdict(lambda: defaultdict(list))
    for s, p, o, _ in quads:
        facts[s][p].append(o)
    known = (prefixes or {}) | PREFIXES

    def name(v: str) -> str:
        for k, u in known.items():
            if v.startswith(u) and re.fullmatch(r"[\w-]+", v[len(u) :]):
                return f"{k}:{v[len(u):]}"
        return f"<{v}>"

    def term(t: Term) -> str:
        return name(t.v) if t.k == IRI else t.v if t.dt in (INTEGER, XSD + "boolean", XSD + "decimal") else t.n3()

    def items(t: Term) -> list[Term]:
        out = []
        while t.v != RDF + "nil":
            out.append(facts[t][RDF + "first"][0])
            t = facts[t][RDF + "rest"][0]
        return out

    def is_list(t: Term) -> bool:
        return t.v == RDF + "nil" or RDF + "first" in facts.get(t, {})

    def path(t: Term) -> str:
        if t.k == IRI:
            return name(t.v)
        if is_list(t):
            return "/".join(f"({path(x)})" if x.k == BNODE else path(x) for x in items(t))
        for p, form in (("inversePath", "^{}"), ("zeroOrOnePath", "{}?"), ("oneOrMorePath", "{}+"), ("zeroOrMorePath", "{}*")):
            if SH + p in facts[t]:
                inner = facts[t][SH + p][0]
                return form.format(path(inner) if inner.k == IRI else f"({path(inner)})")
        return "|".join(path(x) for x in items(facts[t][SH + "alternativePath"][0]))

    def constraints(t: Term, skip: set[str]) -> list[str]:
        out = []
        for p, os in facts[t].items():
            short = p.removeprefix(SH)
            if short in skip or p == RDF + "type":
                continue
            for o in os:
                if short in ("datatype", "class") and o.k == IRI:
                    out.append(name(o.v))
                elif short == "nodeKind":
                    out.append(o.v.removeprefix(SH))
                elif short == "node" and o.k == IRI:
                    out.append("@" + name(o.v))
                elif short == "node":
                    out.append(body(o, "    "))
                elif short == "not":
                    out.append("!" + " ".join(constraints(o, set())))
                elif short == "or":
                    out.append("|".join(" ".join(constraints(x, set())) for x in items(o)))
                elif short in PROPERTY_PARAMS or short in NODE_PARAMS:
                    out.append(f"{short}=" + ("[" + " ".join(map(term, items(o))) + "]" if is_list(o) else term(o)))
                else:
                    raise ValueError(f"{p} can't be said in compact syntax")
        return out

    def body(s: Term, pad: str = "") -> str:
        lines = [f"{pad}  {c} ." for c in constraints(s, {"targetClass", "property"})]
        for p in facts[s].get(SH + "property", []):
            f = facts[p]
            least, most = (f.get(SH + k, [None])[0] for k in ("minCount", "maxCount"))
            count = [f"[{least.v if least else 0}..{most.v if most else '*'}]"] if least or most else []
            lines.append(f"{pad}  " + " ".join([path(f[SH + "path"][0]), *constraints(p, {"path", "minCount", "maxCount"}), *count]) + " .")
        return "{\n" + "\n".join(lines) + f"\n{pad}}}"

    out = [f"PREFIX {k}: <{u}>" for k, u in sorted((prefixes or {}).items())]
    for s in list(facts):
        kinds = {t.v for t in facts[s].get(RDF + "type", [])}
        if s.k == IRI and SH + "NodeShape" in kinds:
            target = [name(t.v) for t in facts[s].get(SH + "targetClass", [])]
            word = "shapeClass" if RDFS + "Class" in kinds else "shape"
            out.append(f"{word} {name(s.v)} {'-> ' + ' '.join(target) + ' ' if target else ''}{body(s)}")
    return "\n".join(out) + "\n"
