"""RDF terms: their encoding as Spark columns, namespaces, and N-Triples text.

A variable's column is one of: the struct TERM (any term); a native value whose datatype is
known (`lit`); or the key from which an IRI is made by a template (`iri`). NULL is unbound.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
LANG_STRING, DIR_LANG_STRING = RDF + "langString", RDF + "dirLangString"
STRING, BOOLEAN, INTEGER, DECIMAL, FLOAT, DOUBLE = (XSD + n for n in ("string", "boolean", "integer", "decimal", "float", "double"))
DATETIME, DATE, TIME = (XSD + n for n in ("dateTime", "date", "time"))
DURATION, DAY_TIME, YEAR_MONTH = (XSD + n for n in ("duration", "dayTimeDuration", "yearMonthDuration"))
#: Datatypes derived from others.
INTEGER_TYPES = tuple(XSD + n for n in ("integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger"))
STRING_TYPES = tuple(XSD + n for n in ("string", "normalizedString", "token", "language", "NMTOKEN", "Name", "NCName", "ENTITY", "ID", "IDREF", "untypedAtomic", "anyURI"))
NUMERIC_TYPES = (*INTEGER_TYPES, DECIMAL, FLOAT, DOUBLE)

BNODE, IRI, LITERAL, TRIPLE = 0, 1, 2, 3
TERM = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("dir", T.StringType())])
TERM_DDL = "struct<k:int,v:string,dt:string,lang:string,dir:string>"


@dataclass(frozen=True)
class Term:
    """A constant term. For a triple term v is its N-Triples text."""

    k: int
    v: str
    dt: str | None = None
    lang: str | None = None
    dir: str | None = None

    def n3(self) -> str:
        if self.k == IRI:
            return f"<{self.v}>"
        if self.k == BNODE:
            return f"_:{self.v}"
        if self.k == TRIPLE:
            return self.v
        body = '"' + escape(self.v) + '"'
        if self.lang:
            return f"{body}@{self.lang}" + (f"--{self.dir}" if self.dir else "")
        return body if self.dt in (None, STRING) else f"{body}^^<{self.dt}>"


def iri(v: str) -> Term:
    return Term(IRI, v)


def literal(v: str, dt: str | None = None, lang: str | None = None, direction: str | None = None) -> Term:
    if lang:
        return Term(LITERAL, v, DIR_LANG_STRING if direction else LANG_STRING, lang.lower(), direction)
    return Term(LITERAL, v, dt or STRING)


def triple(s: Term, p: Term, o: Term) -> Term:
    return Term(TRIPLE, f"<<( {s.n3()} {p.n3()} {o.n3()} )>>")


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), s, flags=re.S)


def lit_col(t: Term) -> Column:
    """A constant as TERM."""
    return term_col(F.lit(t.k), F.lit(t.v), F.lit(t.dt).cast("string"), F.lit(t.lang).cast("string"), F.lit(t.dir).cast("string"))


def term_col(k, v, dt=None, lang=None, direction=None) -> Column:  # noqa: ANN001
    none = F.lit(None).cast("string")
    return F.struct((k if isinstance(k, Column) else F.lit(k)).cast("int").alias("k"), v.alias("v"), (none if dt is None else dt).alias("dt"), (none if lang is None else lang).alias("lang"), (none if direction is None else direction).alias("dir"))


def n3_col(t: Column) -> Column:
    """N-Triples text of a TERM."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t["v"], r"\\", r"\\\\"), '"', '\\\\"'), "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t")
    quoted = F.concat(F.lit('"'), v, F.lit('"'))
    lang = F.concat(quoted, F.lit("@"), t["lang"], F.when(t["dir"].isNotNull(), F.concat(F.lit("--"), t["dir"])).otherwise(""))
    lit = F.when(t["lang"].isNotNull(), lang).when(t["dt"].isNull() | (t["dt"] == STRING), quoted).otherwise(F.concat(quoted, F.lit("^^<"), t["dt"], F.lit(">")))
    return F.when(t["k"] == IRI, F.concat(F.lit("<"), t["v"], F.lit(">"))).when(t["k"] == BNODE, F.concat(F.lit("_:"), t["v"])).when(t["k"] == TRIPLE, t["v"]).when(t.isNotNull(), lit)


@dataclass(frozen=True)
class Enc:
    """How a variable's column is encoded. kind: term, iri or lit. template: what precedes an
    IRI's key (None: the column is the IRI). dt: a literal's datatype, or that of the key."""

    kind: str
    template: str | None = None
    dt: str | None = None


ANY = Enc("term")
FULL_IRI = Enc("iri")


def lexical(c: Column, dt: str | None) -> Column:
    """Lexical form of a native value."""
    if dt in (DATETIME,):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.regexp_replace(F.date_format(c, "SSSSSS"), "0+$", "")
        return F.concat(text, F.when(micros != "", F.concat(F.lit("."), micros)).otherwise(""))
    if dt == DECIMAL:
        s = c.cast("string")
        trimmed = F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1")
        return F.regexp_replace(trimmed, r"\.$", "")
    if dt in (DOUBLE, FLOAT):
        return double_text(c)
    return c.cast("string")


def double_text(c: Column) -> Column:
    """Plain decimals as they are, others in exponent form; INF and NaN as XSD writes them."""
    s = c.cast("string")
    return F.when(F.isnan(c), "NaN").when(s == "Infinity", "INF").when(s == "-Infinity", "-INF").otherwise(F.regexp_replace(s, r"\.0$", ""))


def box(c: Column, enc: Enc) -> Column:
    """Any column as TERM."""
    if enc.kind == "term":
        return c
    if enc.kind == "iri":
        v = F.concat(F.lit(enc.template), c.cast("string")) if enc.template else c
        return F.when(c.isNotNull(), term_col(IRI, v))
    return F.when(c.isNotNull(), term_col(LITERAL, lexical(c, enc.dt), F.lit(enc.dt)))


def value(c: Column, enc: Enc) -> Column:
    """A column for results: native values, full IRIs, lexical forms."""
    if enc.kind == "iri" and enc.template:
        return F.concat(F.lit(enc.template), c.cast("string"))
    return c["v"] if enc.kind == "term" else c


def datatype_of(t: T.DataType) -> str | None:
    """Of a native column."""
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(t, T.DecimalType):
        return INTEGER if t.scale == 0 else DECIMAL
    if isinstance(t, T.FloatType):
        return FLOAT
    if isinstance(t, T.DoubleType):
        return DOUBLE
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(t, T.DateType):
        return DATE
    return None
