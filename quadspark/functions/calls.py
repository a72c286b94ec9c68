"""The expression compiler: dispatch of operators and functions by name."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadspark.functions import expr as X
from quadspark.functions.expr import Context, Val
from quadspark.plans.algebra import Call, Const, Exists, TripleTerm, Var
from quadspark.terms import (
    BNODE, BOOLEAN, DATE, DATETIME, DAY_TIME, DIR_LANG_STRING, IRI, LANG_STRING, LITERAL, STRING, TERM_DDL, TIME, TRIPLE, Enc, Term, lexical, n3_col, term_col,
)


def compile_expr(e: object, scope: dict[str, tuple[Column, Enc]], c: Context) -> Val:
    """scope: the columns and encodings of the variables."""
    match e:
        case Var():
            if e.name not in scope:
                return Val(X.NULL(TERM_DDL), "term")
            col, enc = scope[e.name]
            if enc.kind == "iri":
                return Val(col, "iri", enc.template, key=enc.dt)
            if enc.kind == "lit" and enc.dt in X.TYPE_OF:
                return Val(col, X.TYPE_OF[enc.dt])
            return Val(X.box(col, enc), "term")
        case Const():
            return X.constant(e.term)
        case TripleTerm():
            return triple_of(*(compile_expr(x if isinstance(x, (Var, TripleTerm)) else Const(x), scope, c) for x in (e.s, e.p, e.o)))
        case Exists():
            return Val(c.exists[id(e)], "boolean")
        case Call():
            return call(e, scope, c)
    raise TypeError(f"no expression: {e!r}")


def call(e: Call, scope: dict, c: Context) -> Val:
    name = e.name
    if name == "BOUND":
        v = e.args[0]
        return Val(scope[v.name][0].isNotNull() if v.name in scope else F.lit(False), "boolean")
    args = [compile_expr(a, scope, c) for a in e.args]
    if name in OPERATORS:
        return OPERATORS[name](c, *args)
    if name in X.CASTS:
        return X.cast(name, args[0])
    function = c.extensions.get(name) or (c.creator(name) if c.creator else None)
    if function is not None:
        out = function(*[a.col if a.t != "term" else a.col["v"] for a in args])
        return out if isinstance(out, Val) else Val(out.cast("string"), "string") if not isinstance(out, tuple) else Val(*out)
    raise ValueError(f"unknown function {name}")


def boolean(f: Callable[..., Column]) -> Callable[..., Val]:
    return lambda c, *a: Val(f(c, *a), "boolean")


def common(vals: list[Val]) -> tuple[list[Column], str, str | None]:
    """The values as columns of one encoding."""
    kinds = {(v.t, v.template, v.key) for v in vals}
    if len(kinds) == 1 and "term" not in {v.t for v in vals}:
        return [v.col for v in vals], vals[0].t, vals[0].template
    if all(v.t in X.NUMERIC and v.t == vals[0].t for v in vals):
        return [v.col for v in vals], vals[0].t, None
    return [v.term() for v in vals], "term", None


def if_(c: Context, test: Val, a: Val, b: Val) -> Val:
    (x, y), t, template = common([a, b])
    ok = X.ebv(test)
    return Val(F.when(ok, x).when(~ok, y), t, template)


def coalesce(c: Context, *args: Val) -> Val:
    cols, t, template = common(list(args))
    return Val(F.coalesce(*cols), t, template)


def in_(c: Context, x: Val, *others: Val) -> Val:
    if not others:
        return Val(F.lit(False), "boolean")
    if x.t in X.TYPE_OF.values() and all(o.const is not None and o.t == x.t for o in others) and x.t not in ("float", "double"):
        return Val(x.col.isin(*[o.col for o in others]) if len(others) > 1 else x.col == others[0].col, "boolean")
    out = X.eq(x, others[0])
    for o in others[1:]:
        out = out | X.eq(x, o)
    return Val(out, "boolean")


def same_term(c: Context, a: Val, b: Val) -> Column:
    if a.t == b.t != "term" and a.template == b.template and a.const is None and b.const is None:
        return a.col == b.col
    x, y = a.term(), b.term()
    return F.when(x.isNotNull() & y.isNotNull(), (x["k"] == y["k"]) & (x["v"] == y["v"]) & x["dt"].eqNullSafe(y["dt"]) & x["lang"].eqNullSafe(y["lang"]) & x["dir"].eqNullSafe(y["dir"]))


def concat(c: Context, *args: Val) -> Val:
    if not args:
        return Val(F.lit(""), "string")
    v = F.concat(*[X.text(a) for a in args])
    if all(a.t == "string" for a in args):
        return Val(v, "string")
    terms = [a.term() for a in args]
    agree = F.lit(True)
    for t in terms[1:]:
        agree = agree & t["lang"].eqNullSafe(terms[0]["lang"]) & t["dir"].eqNullSafe(terms[0]["dir"])
    lang = F.when(agree, terms[0]["lang"])
    direction = F.when(agree, terms[0]["dir"])
    dt = F.when(lang.isNull(), STRING).when(direction.isNull(), LANG_STRING).otherwise(DIR_LANG_STRING)
    return Val(F.when(v.isNotNull(), term_col(LITERAL, v, dt, lang, direction)), "term")


def kind(k: int) -> Callable[..., Column]:
    def test(c: Context, x: Val) -> Column:
        if x.t == "term" and x.const is None:
            return x.col["k"] == k
        own = x.const.k if x.const is not None else IRI if x.t == "iri" else LITERAL
        return F.when(x.col.isNotNull(), own == k)

    return test


def is_numeric(c: Context, x: Val) -> Column:
    if x.t in X.NUMERIC:
        return F.when(x.col.isNotNull(), True)
    t = x.term()
    return F.when(t.isNotNull(), X.term_number(t).isNotNull())


def lang(c: Context, x: Val) -> Val:
    t = x.term()
    return Val(F.when(t["k"] == LITERAL, F.coalesce(t["lang"], F.lit(""))), "string")


def langdir(c: Context, x: Val) -> Val:
    t = x.term()
    return Val(F.when(t["k"] == LITERAL, F.coalesce(t["dir"], F.lit(""))), "string")


def datatype(c: Context, x: Val) -> Val:
    t = x.term()
    return Val(F.when(t["k"] == LITERAL, t["dt"]), "iri")


def to_iri(c: Context, x: Val) -> Val:
    if x.t == "iri":
        return x
    if x.const is not None:
        v = x.const.v
        return Val(F.lit(urljoin(c.base, v) if c.base else v), "iri") if x.t in ("string", "term") else Val(X.NULL(), "iri")
    t = x.term()
    v = F.when((t["k"] == IRI) | X.is_string(t), t["v"])
    if c.base:
        root = urljoin(c.base, "/").rstrip("/")
        folder = urljoin(c.base, ".")
        bare = c.base.split("#")[0]
        v = F.when(v.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), v).when(v.startswith("//"), F.concat(F.lit(c.base.split("//")[0]), v)).when(v.startswith("/"), F.concat(F.lit(root), v)).when(v.startswith("#"), F.concat(F.lit(bare), v)).when(v == "", F.lit(bare)).otherwise(F.concat(F.lit(folder), v))
    return Val(v, "iri")


def strlang(c: Context, s: Val, tag: Val, direction: Val | None = None) -> Val:
    v, g = X.plain(s), X.plain(tag)
    ok = v.isNotNull() & (g != "")
    if direction is None:
        return Val(F.when(ok, term_col(LITERAL, v, F.lit(LANG_STRING), F.lower(g))), "term")
    d = X.plain(direction)
    return Val(F.when(ok & d.isin("ltr", "rtl"), term_col(LITERAL, v, F.lit(DIR_LANG_STRING), F.lower(g), d)), "term")


def strdt(c: Context, s: Val, dt: Val) -> Val:
    v, d = X.plain(s), dt.iri_text() if dt.t == "iri" else F.when(dt.term()["k"] == IRI, dt.term()["v"])
    return Val(F.when(v.isNotNull() & d.isNotNull(), term_col(LITERAL, v, d)), "term")


def substr(c: Context, s: Val, start: Val, length: Val | None = None) -> Val:
    v = X.text(s)
    first = F.floor(X.cast(X.DOUBLE, start).col + 0.5).cast("int")
    if length is None:
        return X.like(s, F.substring(v, F.greatest(first, F.lit(1)), F.length(v)))
    n = F.floor(X.cast(X.DOUBLE, length).col + 0.5).cast("int")
    begin = F.greatest(first, F.lit(1))
    return X.like(s, F.substring(v, begin, F.greatest(first + n - begin, F.lit(0))))


def searched(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda c, a, b: F.when(X.compatible(a, b), f(X.text(a), X.text(b)))


def before(c: Context, a: Val, b: Val) -> Val:
    return _part(a, b, lambda v, w, at: F.substring(v, F.lit(1), at - 1))


def after(c: Context, a: Val, b: Val) -> Val:
    return _part(a, b, lambda v, w, at: F.substring(v, at + F.length(w), F.length(v)))


def _part(a: Val, b: Val, cut: Callable[[Column, Column, Column], Column]) -> Val:
    v, w = X.text(a), X.text(b)
    at = F.call_function("locate", w, v)
    found = F.when(X.compatible(a, b) & (at > 0), cut(v, w, at))
    if a.t == "string":
        return Val(F.when(v.isNotNull() & w.isNotNull() & X.compatible(a, b), F.coalesce(found, F.lit(""))), "string")
    hit, miss = X.like(a, found).col, term_col(LITERAL, F.lit(""), F.lit(STRING))
    return Val(F.when(X.compatible(a, b) & v.isNotNull() & w.isNotNull(), F.when(at > 0, hit).otherwise(miss)), "term")


def regex(c: Context, s: Val, p: Val, flags: Val | None = None) -> Column:
    fixed, col = X.java_pattern(p, flags)
    return X.text(s).rlike(fixed) if fixed is not None else F.rlike(X.text(s), col)


def replace(c: Context, s: Val, p: Val, r: Val, flags: Val | None = None) -> Val:
    _, col = X.java_pattern(p, flags)
    return X.like(s, F.regexp_replace(X.text(s), col, X.text(r)))


def round_half_up(x: Column, t: str) -> Column:
    if t == "integer":
        return x
    return F.floor(x + F.lit(0.5).cast("decimal(2,1)")) if t == "decimal" else F.when(F.isnan(x) | (F.abs(x) > 2**52), x).otherwise(F.floor(x + 0.5))


def whole(f: Callable[[Column], Column]) -> Callable[[Column, str], Column]:
    return lambda x, t: x if t == "integer" else f(x) if t == "decimal" else F.when(F.isnan(x) | (F.abs(x) > 2**52), x).otherwise(f(x))


def date_field(native: Callable[[Column], Column], pattern: str, types: tuple[str, ...]) -> Callable[..., Val]:
    """A field in the literal's own zone: the lexical form is read, or the native (UTC) value."""

    def get(c: Context, x: Val) -> Val:
        if x.t in ("dateTime", "date") and x.const is None:
            return Val(native(x.col).cast("bigint"), "integer")
        t = x.term()
        v = F.regexp_extract(t["v"], pattern, 1)
        return Val(F.when(t["dt"].isin(*types) & (v != ""), v.try_cast("bigint")), "integer")

    return get


def seconds(c: Context, x: Val) -> Val:
    if x.t == "dateTime" and x.const is None:
        return Val(F.expr("0").cast("decimal(38,18)") + F.date_part(F.lit("SECOND"), x.col).cast("decimal(38,18)"), "decimal")
    t = x.term()
    v = F.regexp_extract(t["v"], r"(?:T|^)[0-9]{2}:[0-9]{2}:([0-9]{2}(?:\.[0-9]+)?)", 1)
    return Val(F.when(t["dt"].isin(DATETIME, TIME) & (v != ""), v.try_cast("decimal(38,18)")), "decimal")


def timezone(c: Context, x: Val) -> Val:
    t = x.term()
    z = X.zone_seconds(t["v"])
    return X.lit_term(F.when(t["dt"].isin(DATETIME, DATE, TIME), X.seconds_text(z)), DAY_TIME)


def tz(c: Context, x: Val) -> Val:
    t = x.term()
    return Val(F.when(t["dt"].isin(DATETIME, DATE, TIME), F.regexp_extract(t["v"], X._ZONE, 1)), "string")


def digest(f: Callable[[Column], Column]) -> Callable[..., Val]:
    return lambda c, x: Val(f(X.plain(x)), "string")


def triple_of(s: Val, p: Val, o: Val) -> Val:
    a, b, d = s.term(), p.term(), o.term()
    ok = a["k"].isin(IRI, BNODE, TRIPLE) & (b["k"] == IRI) & d.isNotNull()
    return Val(F.when(ok, term_col(TRIPLE, F.concat(F.lit("<<( "), n3_col(a), F.lit(" "), n3_col(b), F.lit(" "), n3_col(d), F.lit(" )>>")))), "term")


#: Text of one term in N-Triples; of a triple term up to two levels deep.
_ONE = r'<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?|<<\( (?:[^"<>]|"(?:[^"\\]|\\.)*"|<[^<>]*>)* \)>>'


def component(i: int) -> Callable[..., Val]:
    def get(c: Context, x: Val) -> Val:
        t = x.term()
        piece = F.regexp_extract(t["v"], rf"^<<\( ({_ONE}) (<[^>]*>) ({_ONE}) \)>>$", i)
        return Val(F.when((t["k"] == TRIPLE) & (piece != ""), parse_n3(piece)), "term")

    return get


def parse_n3(s: Column) -> Column:
    """A term from its N-Triples text."""
    raw = F.regexp_extract(s, r'^"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    # escapes are those of JSON strings
    read = F.from_json(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "v string", {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"})["v"]
    raw = F.when(F.instr(raw, "\\") > 0, read).otherwise(raw)
    tag = F.regexp_extract(s, r'"@([A-Za-z0-9-]+?)(?:--(ltr|rtl))?$', 1)
    way = F.regexp_extract(s, r'"@([A-Za-z0-9-]+?)(?:--(ltr|rtl))?$', 2)
    dt = F.regexp_extract(s, r'"\^\^<([^>]*)>$', 1)
    lang_dt = F.when(way != "", DIR_LANG_STRING).otherwise(LANG_STRING)
    lit = F.when(tag != "", term_col(LITERAL, raw, lang_dt, F.lower(tag), F.when(way != "", way))).otherwise(term_col(LITERAL, raw, F.when(dt != "", dt).otherwise(STRING)))
    return F.when(s.startswith("<<("), term_col(TRIPLE, s)).when(s.startswith("<"), term_col(IRI, F.substring(s, F.lit(2), F.length(s) - 2))).when(s.startswith("_:"), term_col(BNODE, F.substring(s, F.lit(3), F.length(s)))).when(s.startswith('"'), lit)


def bnode(c: Context, label: Val | None = None) -> Val:
    """Fresh for each row; the same for equal labels in a row."""
    uid = F.monotonically_increasing_id().cast("string")
    if label is None:
        return Val(term_col(BNODE, F.concat(F.lit("b"), F.regexp_replace(F.uuid(), "-", ""))), "term")
    v = X.plain(label)
    return Val(F.when(v.isNotNull(), term_col(BNODE, F.concat(F.lit("r"), uid, F.lit("x"), F.hex(v)))), "term")


OPERATORS: dict[str, Callable[..., Val]] = {
    "&&": boolean(lambda c, a, b: X.ebv(a) & X.ebv(b)), "||": boolean(lambda c, a, b: X.ebv(a) | X.ebv(b)), "!": boolean(lambda c, a: ~X.ebv(a)),
    "=": boolean(lambda c, a, b: X.eq(a, b, c.lexical_comparison)), "!=": boolean(lambda c, a, b: ~X.eq(a, b, c.lexical_comparison)), "<": boolean(lambda c, a, b: X.lt(a, b, c)), ">": boolean(lambda c, a, b: X.lt(b, a, c)),
    "<=": boolean(lambda c, a, b: X.le(a, b, c)), ">=": boolean(lambda c, a, b: X.le(b, a, c)),
    "+": lambda c, a, b: X.arithmetic("+", a, b), "-": lambda c, a, b: X.arithmetic("-", a, b), "*": lambda c, a, b: X.arithmetic("*", a, b), "/": lambda c, a, b: X.arithmetic("/", a, b),
    "u-": lambda c, a: X.unary_number(a, lambda x, t: -x), "u+": lambda c, a: X.unary_number(a, lambda x, t: x),
    "IF": if_, "COALESCE": coalesce, "IN": in_, "SAMETERM": boolean(same_term), "CONCAT": concat,
    "ISIRI": boolean(kind(IRI)), "ISURI": boolean(kind(IRI)), "ISBLANK": boolean(kind(BNODE)), "ISLITERAL": boolean(kind(LITERAL)), "ISTRIPLE": boolean(kind(TRIPLE)), "ISNUMERIC": boolean(is_numeric),
    "STR": lambda c, x: Val(X.str_of(x), "string"), "LANG": lang, "LANGDIR": langdir, "HASLANG": boolean(lambda c, x: F.when(x.term().isNotNull(), x.term()["lang"].isNotNull())), "HASLANGDIR": boolean(lambda c, x: F.when(x.term().isNotNull(), x.term()["dir"].isNotNull())),
    "DATATYPE": datatype, "IRI": to_iri, "URI": to_iri, "STRDT": strdt, "STRLANG": strlang, "STRLANGDIR": strlang, "BNODE": bnode,
    "UUID": lambda c: Val(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri"), "STRUUID": lambda c: Val(F.uuid(), "string"), "RAND": lambda c: Val(F.rand(), "double"), "NOW": lambda c: X.constant(Term(LITERAL, c.now, DATETIME)),
    "STRLEN": lambda c, x: Val(F.char_length(X.text(x)).cast("bigint"), "integer"), "SUBSTR": substr, "UCASE": lambda c, x: X.like(x, F.upper(X.text(x))), "LCASE": lambda c, x: X.like(x, F.lower(X.text(x))),
    "STRSTARTS": boolean(searched(lambda a, b: F.startswith(a, b))), "STRENDS": boolean(searched(lambda a, b: F.endswith(a, b))), "CONTAINS": boolean(searched(lambda a, b: F.contains(a, b))), "STRBEFORE": before, "STRAFTER": after,
    "ENCODE_FOR_URI": lambda c, x: Val(X.encode_for_uri(X.text(x), c.reference_encoding), "string"), "LANGMATCHES": boolean(lambda c, a, b: X.lang_matches(X.text(a), b)), "REGEX": boolean(regex), "REPLACE": replace,
    "ABS": lambda c, x: X.unary_number(x, lambda v, t: F.abs(v)), "ROUND": lambda c, x: X.unary_number(x, round_half_up), "CEIL": lambda c, x: X.unary_number(x, whole(F.ceil)), "FLOOR": lambda c, x: X.unary_number(x, whole(F.floor)),
    "YEAR": date_field(F.year, r"^(-?[0-9]{4,})-", (DATETIME, DATE)), "MONTH": date_field(F.month, r"^-?[0-9]{4,}-([0-9]{2})", (DATETIME, DATE)), "DAY": date_field(F.dayofmonth, r"^-?[0-9]{4,}-[0-9]{2}-([0-9]{2})", (DATETIME, DATE)),
    "HOURS": date_field(F.hour, r"(?:T|^)([0-9]{2}):[0-9]{2}:", (DATETIME, TIME)), "MINUTES": date_field(F.minute, r"(?:T|^)[0-9]{2}:([0-9]{2}):", (DATETIME, TIME)), "SECONDS": seconds, "TIMEZONE": timezone, "TZ": tz,
    "MD5": digest(F.md5), "SHA1": digest(F.sha1), "SHA256": digest(lambda v: F.sha2(v, 256)), "SHA384": digest(lambda v: F.sha2(v, 384)), "SHA512": digest(lambda v: F.sha2(v, 512)),
    "TRIPLE": lambda c, s, p, o: triple_of(s, p, o), "SUBJECT": component(1), "PREDICATE": component(2), "OBJECT": component(3),
}
