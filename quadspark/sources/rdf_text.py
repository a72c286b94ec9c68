"""Parsers of RDF documents, text to quads (s, p, o, g) of Terms: Turtle, TriG, N-Triples, N-Quads,
JSON-LD (inline contexts), RDF/XML, and RDF inside HTML (data blocks, RDFa and Microdata)."""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from quadspark.plans.parser import ParseError, Parser
from quadspark.terms import BNODE, BOOLEAN, DOUBLE, INTEGER, RDF, STRING, Term, iri, literal

Quad = tuple[Term, str, Term, str]


class TurtleParser(Parser):
    """Turtle and TriG with the tokens of the query parser."""

    data = True

    def __init__(self, text: str, base: str | None = None, scope: str = "") -> None:
        # directives are written with @ in Turtle; the tokenizer takes them for language tags
        super().__init__(text, base)
        self.scope = scope

    def bnode(self) -> object:
        return Term(BNODE, self.scope + self.next()[2:])

    def blank(self) -> object:
        self.fresh += 1
        return Term(BNODE, f"{self.scope}genid{self.fresh}")

    def directive(self) -> bool:
        at = self.kind() == "lang" and self.peek() in ("@prefix", "@base")
        if not at and not self.is_("PREFIX", "BASE"):
            return False
        word = self.next().lstrip("@").lower()
        if word == "prefix":
            name = self.next()
            self.prefixes[name[:-1]] = self.resolve(self.next()[1:-1])
        else:
            self.base = self.resolve(self.next()[1:-1])
        if at:
            self.expect(".")
        return True

    def quads(self) -> Iterator[Quad]:
        graph = ""
        while self.kind() != "end":
            if self.directive():
                continue
            if self.take("GRAPH") or self.is_("{") or (self.kind() in ("iri", "pname", "bnode") and self.peek(1) == "{"):
                graph = "" if self.is_("{") else self.term([]).v
                self.expect("{")
                while not self.take("}"):
                    if not self.take("."):
                        yield from self.emit(self.triples_block(), graph)
                graph = ""
                continue
            out: list = []
            start = self.i
            s = self.term(out)
            if not (self.tokens[start][1] in ("[", "<<") and self.is_(".")):
                self.properties(s, out)
            self.expect(".")
            yield from self.emit(out, "")

    @staticmethod
    def emit(triples: list, graph: str) -> Iterator[Quad]:
        for s, p, o in triples:
            if not isinstance(p, Term):
                raise ParseError("a path stands where a predicate must")
            yield s, p.v, o, graph


def parse_turtle(text: str, base: str | None = None, scope: str = "") -> Iterator[Quad]:
    return TurtleParser(text, base, scope).quads()


_NT = re.compile(r'\s*(<[^>]*>|_:\S+|<<\(.*?\)>>)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s.]+(?:\.[^\s.]+)*|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?|<<\(.*\)>>)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$')


def parse_nquads(text: str, base: str | None = None, scope: str = "") -> Iterator[Quad]:
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            yield from TurtleParser(_as_trig(line), base, scope).quads()


def _as_trig(line: str) -> str:
    m = _NT.match(line)
    if not m:
        raise ParseError(f"no quad: {line[:80]}")
    s, p, o, g = m.groups()
    return f"{g} {{ {s} <{p}> {o} }}" if g else f"{s} <{p}> {o} ."


# JSON-LD


class JsonLd:
    """Expansion with inline contexts: prefixes, @vocab, @base, @language, term types and containers."""

    def __init__(self, base: str | None, scope: str) -> None:
        self.base, self.scope, self.n = base, scope, 0

    def blank(self) -> Term:
        self.n += 1
        return Term(BNODE, f"{self.scope}jb{self.n}")

    def context(self, old: dict, new: object) -> dict:
        if new is None:
            return {}
        if isinstance(new, list):
            for x in new:
                old = self.context(old, x)
            return old
        if isinstance(new, str):
            raise ValueError(f"remote context {new}")
        return old | new

    def expand(self, name: str, c: dict, vocab: bool = True) -> str:
        if name.startswith("@"):
            return name
        if vocab and name in c:
            d = c[name]
            target = d.get("@id", name) if isinstance(d, dict) else d
            if target is None or target == name:
                return (c.get("@vocab") or "") + name if ":" not in name else name
            return self.expand(target, {k: v for k, v in c.items() if k != name})
        prefix, sep, rest = name.partition(":")
        if sep and prefix != "_" and not rest.startswith("//") and prefix in c:
            d = c[prefix]
            return self.expand(d["@id"] if isinstance(d, dict) else d, {k: v for k, v in c.items() if k != prefix}) + rest
        if sep:
            return name
        if vocab:
            return (c.get("@vocab") or "") + name
        base = c.get("@base", self.base)
        return urljoin(base, name) if base else name

    def node(self, name: str, c: dict) -> Term:
        return Term(BNODE, self.scope + name[2:]) if name.startswith("_:") else iri(self.expand(name, c, False))

    def value(self, v: object, d: dict, c: dict, graph: str) -> tuple[Term | None, list[Quad]]:
        kind = d.get("@type")
        if isinstance(v, dict) and "@value" in v:
            raw, t = v["@value"], v.get("@type")
            if "@language" in v:
                return literal(str(raw), lang=v["@language"], direction=v.get("@direction")), []
            return self.scalar(raw, self.expand(t, c) if t else None), []
        if isinstance(v, dict) and "@list" in v:
            return self.list_(v["@list"], d, c, graph)
        if isinstance(v, dict) and "@set" in v:
            return None, []
        if isinstance(v, dict):
            out = list(self.object(v, c, graph))
            return out[0], out[1]
        if kind in ("@id", "@vocab") and isinstance(v, str):
            return (self.node(v, c) if kind == "@id" else iri(self.expand(v, c))), []
        if isinstance(v, str) and not kind:
            tag = d.get("@language", c.get("@language"))
            return literal(v, lang=tag) if tag else literal(v), []
        return self.scalar(v, self.expand(kind, c) if kind else None), []

    @staticmethod
    def scalar(v: object, dt: str | None) -> Term:
        if isinstance(v, bool):
            return literal("true" if v else "false", dt or BOOLEAN)
        if isinstance(v, int) or isinstance(v, float) and v.is_integer() and abs(v) < 1e21 and dt != DOUBLE:
            return literal(str(int(v)), dt or INTEGER)
        if isinstance(v, float):
            return literal(re.sub(r"(\d)0*E([+-])?0*", r"\1E\2", f"{v:.15E}").replace("E+", "E"), dt or DOUBLE)
        return literal(str(v), dt or STRING)

    def list_(self, items: list, d: dict, c: dict, graph: str) -> tuple[Term, list[Quad]]:
        head, out = iri(RDF + "nil"), []
        for x in reversed(items):
            o, more = self.value(x, d, c, graph)
            cell = self.blank()
            out += [*more, (cell, RDF + "first", o, graph), (cell, RDF + "rest", head, graph)]
            head = cell
        return head, out

    def object(self, x: dict, c: dict, graph: str) -> tuple[Term, list[Quad]]:
        if "@context" in x:
            c = self.context(c, x["@context"])
        alias = {k: self.expand(k, c) for k in x}
        ids = [x[k] for k, e in alias.items() if e == "@id"]
        s = self.node(ids[0], c) if ids else self.blank()
        out: list[Quad] = []
        for k, v in x.items():
            e = alias[k]
            d = c.get(k) if isinstance(c.get(k), dict) else {}
            if e == "@type":
                out += [(s, RDF + "type", Term(BNODE, self.scope + t[2:]) if t.startswith("_:") else iri(self.expand(t, c)), graph) for t in (v if isinstance(v, list) else [v])]
            elif e == "@graph":
                named = s.v if len([a for a in alias.values() if a not in ("@graph", "@context")]) else graph
                for y in v if isinstance(v, list) else [v]:
                    out += self.object(y, c, named)[1]
            elif e == "@reverse":
                for p, others in v.items():
                    for y in others if isinstance(others, list) else [others]:
                        o, more = self.object(y, c, graph) if isinstance(y, dict) else (self.node(y, c), [])
                        out += [*more, (o, self.expand(p, c), s, graph)]
            elif not e.startswith("@") and ":" in e:
                if d.get("@container") == "@list" and not (isinstance(v, dict) and "@list" in v):
                    o, more = self.list_(v if isinstance(v, list) else [v], d, c, graph)
                    out += [*more, (s, e, o, graph)]
                    continue
                if d.get("@container") == "@language" and isinstance(v, dict):
                    out += [(s, e, literal(t, lang=tag), graph) for tag, ts in v.items() for t in (ts if isinstance(ts, list) else [ts])]
                    continue
                values = v["@set"] if isinstance(v, dict) and "@set" in v else v
                for y in values if isinstance(values, list) else [values]:
                    if y is None:
                        continue
                    o, more = self.value(y, d, c, graph)
                    if o is not None:
                        out += [*more, (s, e, o, graph)]
        return s, out


def parse_jsonld(text: str, base: str | None = None, scope: str = "") -> Iterator[Quad]:
    doc = json.loads(text)
    p = JsonLd(base, scope)
    for x in doc if isinstance(doc, list) else [doc]:
        yield from p.object(x, {}, "")[1]


# RDF/XML

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


def parse_rdfxml(text: str, base: str | None = None, scope: str = "") -> Iterator[Quad]:
    root = ET.fromstring(text)
    n = 0
    out: list[Quad] = []

    def blank() -> Term:
        nonlocal n
        n += 1
        return Term(BNODE, f"{scope}xb{n}")

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def resolve(ref: str, b: str | None) -> str:
        return urljoin(b, ref) if b else ref

    def scope_of(e: ET.Element, b: str | None, lang: str | None) -> tuple[str | None, str | None]:
        return e.get(_XML + "base", b), e.get(_XML + "lang", lang)

    def node(e: ET.Element, b: str | None, lang: str | None) -> Term:
        b, lang = scope_of(e, b, lang)
        if e.get(_R + "about") is not None:
            s = iri(resolve(e.get(_R + "about"), b))
        elif e.get(_R + "ID") is not None:
            s = iri(resolve("#" + e.get(_R + "ID"), b))
        else:
            s = Term(BNODE, scope + e.get(_R + "nodeID")) if e.get(_R + "nodeID") else blank()
        if e.tag != _R + "Description":
            out.append((s, RDF + "type", iri(name(e.tag)), ""))
        attributes(e, s, lang)
        members = 0
        for child in e:
            p = name(child.tag)
            if child.tag == _R + "li":
                members += 1
                p = f"{RDF}_{members}"
            prop(child, s, p, b, lang)
        return s

    def attributes(e: ET.Element, s: Term, lang: str | None) -> None:
        for k, v in e.attrib.items():
            if k == _R + "type":
                out.append((s, RDF + "type", iri(v), ""))
            elif not k.startswith((_R, _XML)) and k.startswith("{"):
                out.append((s, name(k), literal(v, lang=lang) if lang else literal(v), ""))

    def prop(e: ET.Element, s: Term, p: str, b: str | None, lang: str | None) -> None:
        b, lang = scope_of(e, b, lang)
        kind = e.get(_R + "parseType")
        if kind == "Resource":
            o = blank()
            for child in e:
                prop(child, o, name(child.tag), b, lang)
        elif kind == "Collection":
            o = iri(RDF + "nil")
            for child in reversed(list(e)):
                cell = blank()
                out.extend([(cell, RDF + "first", node(child, b, lang), ""), (cell, RDF + "rest", o, "")])
                o = cell
        elif kind == "Literal":
            o = literal("".join([e.text or "", *(ET.tostring(c, encoding="unicode") for c in e)]), RDF + "XMLLiteral")
        elif e.get(_R + "resource") is not None:
            o = iri(resolve(e.get(_R + "resource"), b))
            attributes(e, o, lang)
        elif e.get(_R + "nodeID") is not None:
            o = Term(BNODE, scope + e.get(_R + "nodeID"))
        elif len(e):
            o = node(e[0], b, lang)
        elif any(k.startswith("{") and not k.startswith((_R, _XML)) for k in e.attrib):
            o = blank()
            attributes(e, o, lang)
        else:
            dt = e.get(_R + "datatype")
            o = literal(e.text or "", dt) if dt else literal(e.text or "", lang=lang) if lang else literal(e.text or "")
        out.append((s, p, o, ""))
        if e.get(_R + "ID"):
            r = iri(resolve("#" + e.get(_R + "ID"), b))
            out.extend([(r, RDF + "type", iri(RDF + "Statement"), ""), (r, RDF + "subject", s, ""), (r, RDF + "predicate", iri(p), ""), (r, RDF + "object", o, "")])

    for e in root if root.tag == _R + "RDF" else [root]:
        node(e, root.get(_XML + "base", base), root.get(_XML + "lang"))
    yield from out


# HTML


class _Html(HTMLParser):
    """Data blocks (script), Microdata and the plain parts of RDFa."""

    VOID = {"meta", "link", "img", "br", "hr", "input", "source", "area", "base", "col", "embed", "track", "wbr"}

    def __init__(self, base: str | None, scope: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.scope, self.n, self.out = base, scope, 0, []
        self.script: tuple[str, list[str]] | None = None
        self.stack: list[dict] = []

    def blank(self) -> Term:
        self.n += 1
        return Term(BNODE, f"{self.scope}hb{self.n}")

    def up(self, key: str) -> object:
        return next((f[key] for f in reversed(self.stack) if key in f), None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "script":
            self.script = (a.get("type", ""), [])
            return
        if tag == "base" and "href" in a:
            self.base = a["href"]
        f: dict = {"tag": tag, "text": []}
        link = a.get("href") or a.get("src")
        at = urljoin(self.base or "", link) if link is not None else None
        if "vocab" in a:
            f["vocab"] = a["vocab"]
        if "prefix" in a:
            parts = a["prefix"].split()
            f["prefixes"] = {**(self.up("prefixes") or {}), **{p[:-1]: u for p, u in zip(parts[::2], parts[1::2], strict=False)}}
        outer = self.up("subject")
        if "itemscope" in a:
            item = iri(urljoin(self.base or "", a["itemid"])) if a.get("itemid") else self.blank()
            kind = a.get("itemtype", "").split()
            for t in kind:
                self.out.append((item, RDF + "type", iri(t), ""))
            if "itemprop" in a and outer is not None:
                self.item(outer, a["itemprop"], item)
            f["subject"] = item
            if kind:
                f["vocab"] = re.sub(r"[^/#]*$", "", kind[0])
        elif "itemprop" in a and outer is not None:
            if "content" in a or "datetime" in a:
                self.item(outer, a["itemprop"], literal(a.get("content", a.get("datetime"))))
            elif at is not None:
                self.item(outer, a["itemprop"], iri(at))
            else:
                f["want"] = (outer, [self.name(p) for p in a["itemprop"].split()], None, None)
        elif any(k in a for k in ("about", "typeof", "property", "rel", "resource")) and (self.up("vocab") or self.up("prefixes") or "vocab" in f or "prefixes" in f or ":" in a.get("property", a.get("typeof", ""))):
            self.stack.append(f)
            subject = iri(urljoin(self.base or "", a["about"])) if "about" in a else outer
            new = iri(urljoin(self.base or "", a["resource"])) if "resource" in a else None
            if "typeof" in a:
                target = subject if "about" in a else new or (iri(at) if at is not None and "property" not in a else self.blank())
                for t in a["typeof"].split():
                    self.out.append((target, RDF + "type", iri(self.name(t)), ""))
                if "property" in a and outer is not None:
                    for p in a["property"].split():
                        self.out.append((outer, self.name(p), target, ""))
                f["subject"] = target
            else:
                subject = subject if subject is not None else iri(self.base or "")
                if "about" in a:
                    f["subject"] = subject
                for p in a.get("rel", "").split() if ("rel" in a and (at is not None or new is not None) and "property" not in a) else []:
                    self.out.append((subject, self.name(p), new or iri(at), ""))
                if "property" in a:
                    names = [self.name(p) for p in a["property"].split()]
                    if "content" in a:
                        self.out += [(subject, p, literal(a["content"], self.name(a["datatype"]) if a.get("datatype") else None), "") for p in names]
                    elif new is not None or at is not None:
                        self.out += [(subject, p, new or iri(at), "") for p in names]
                    else:
                        f["want"] = (subject, names, self.name(a["datatype"]) if a.get("datatype") else None, a.get("lang"))
            self.stack.pop()
        if tag not in self.VOID:
            self.stack.append(f)

    def name(self, p: str) -> str:
        if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://", p):
            return p
        prefix, sep, rest = p.partition(":")
        known = self.up("prefixes") or {}
        if sep and prefix in known:
            return known[prefix] + rest
        return p if sep else str(self.up("vocab") or "") + p

    def item(self, s: Term, names: str, o: Term) -> None:
        self.out += [(s, self.name(p), o, "") for p in names.split()]

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.script is not None:
            kind, text = self.script[0].split(";")[0].strip().lower(), "".join(self.script[1])
            self.script = None
            if kind in ISLANDS:
                self.n += 1
                try:
                    self.out += ISLANDS[kind](text, self.base, f"{self.scope}s{self.n}")
                except (ValueError, KeyError, TypeError, AttributeError):  # a broken block is no reason to lose the page
                    pass
            return
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i]["tag"] == tag), None)
        if at is None:
            return
        for f in self.stack[at:]:
            if "want" in f:
                s, names, dt, lang = f["want"]
                v = "".join(f["text"])
                self.out += [(s, p, literal(v, lang=lang) if lang else literal(v, dt), "") for p in names]
        del self.stack[at:]

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script[1].append(data)
        for f in self.stack:
            if "want" in f:
                f["text"].append(data)


ISLANDS = {"application/ld+json": lambda t, b, s: list(parse_jsonld(t, b, s)), "text/turtle": lambda t, b, s: list(parse_turtle(t, b, s)), "application/trig": lambda t, b, s: list(parse_turtle(t, b, s)), "application/n-triples": lambda t, b, s: list(parse_nquads(t, b, s)), "application/n-quads": lambda t, b, s: list(parse_nquads(t, b, s)), "application/rdf+xml": lambda t, b, s: list(parse_rdfxml(t, b, s))}


def parse_html(text: str, base: str | None = None, scope: str = "") -> Iterator[Quad]:
    p = _Html(base, scope)
    p.feed(text)
    p.close()
    yield from p.out


PARSERS = {
    "text/turtle": parse_turtle, "application/trig": parse_turtle, "text/n3": parse_turtle, "application/n-triples": parse_nquads, "application/n-quads": parse_nquads, "application/ld+json": parse_jsonld, "application/json": parse_jsonld, "application/rdf+xml": parse_rdfxml,
    "text/html": parse_html, "application/xhtml+xml": parse_html, "image/svg+xml": parse_html, "application/xml": parse_html, "text/xml": parse_html,
}
EXTENSIONS = {"ttl": "text/turtle", "turtle": "text/turtle", "trig": "application/trig", "n3": "text/n3", "nt": "application/n-triples", "nq": "application/n-quads", "jsonld": "application/ld+json", "json": "application/ld+json", "rdf": "application/rdf+xml", "rdfxml": "application/rdf+xml", "owl": "application/rdf+xml", "xml": "application/rdf+xml", "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "svg": "image/svg+xml", "shaclc": "text/shaclc", "shc": "text/shaclc"}


def parse(text: str, media_type: str, base: str | None = None) -> list[Quad]:
    """Blank node labels are made unique for the document."""
    if media_type == "text/shaclc":
        from quadspark.sources.shaclc import parse_shaclc

        return list(parse_shaclc(text, base, "d" + hashlib.sha1(text.encode()).hexdigest()[:10] + "x"))
    if media_type not in PARSERS:
        raise ValueError(f"no parser for {media_type}")
    scope = "d" + hashlib.sha1((base or "").encode() + text.encode()).hexdigest()[:10] + "x"
    return list(PARSERS[media_type](text, base, scope))
