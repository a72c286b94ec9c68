"""Expressions to columns.

An error and an unbound variable are both NULL. SPARQL's three-valued logic is SQL's. A value
whose type is known stays a native column; anything else is a TERM, and is dispatched on its
datatype at run time.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadspark.plans.algebra import Aggregate, Call, Const, Exists, TripleTerm, Var
from quadspark.terms import (
    BNODE, BOOLEAN, DATE, DATETIME, DAY_TIME, DECIMAL, DIR_LANG_STRING, DOUBLE, DURATION, FLOAT, INTEGER, INTEGER_TYPES, IRI, LANG_STRING, LITERAL, NUMERIC_TYPES, STRING, STRING_TYPES, TIME, TRIPLE, XSD, YEAR_MONTH, Enc, Term, box, escape, lexical,
    lit_col, literal, n3_col, term_col,
)

NUMERIC = ("integer", "decimal", "float", "double")
TYPE_OF = {STRING: "string", BOOLEAN: "boolean", INTEGER: "integer", DECIMAL: "decimal", FLOAT: "float", DOUBLE: "double", DATETIME: "dateTime", DATE: "date"}
DT_OF = {v: k for k, v in TYPE_OF.items()}
SPARK = {"integer": "bigint", "decimal": "decimal(38,18)", "float": "float", "double": "double"}


@dataclass
class Val:
    """A compiled expression. t: a key of DT_OF, or iri, or term."""

    col: Column
    t: str
    template: str | None = None
    const: Term | None = None
    key: str | None = None  # the datatype of a template's key, where it is known

    def term(self) -> Column:
        if self.const is not None:
            return lit_col(self.const)
        if self.t == "term":
            return self.col
        return box(self.col, Enc("iri", self.template) if self.t == "iri" else Enc("lit", None, DT_OF[self.t]))

    @property
    def enc(self) -> Enc:
        if self.t == "term":
            return Enc("term")
        return Enc("iri", self.template, self.key) if self.t == "iri" else Enc("lit", None, DT_OF[self.t])

    def iri_text(self) -> Column:
        return F.concat(F.lit(self.template), self.col.cast("string")) if self.template else self.col


NULL = lambda kind="string": F.lit(None).cast(kind)


@dataclass
class Context:
    """What a query's expressions need besides their rows."""

    base: str | None = None
    now: str = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"))
    extensions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    full_comparison: bool = False
    lexical_comparison: bool = False  # literals of one datatype that are ill-typed compare by their text
    creator: Callable[[str], Callable[..., Column] | None] | None = None  # makes extension functions by name
    reference_encoding: bool = False  # ENCODE_FOR_URI leaves reserved characters
    exists: dict[int, Column] = field(default_factory=dict)


def constant(t: Term) -> Val:
    """A constant, native if its lexical form is right."""
    if t.k == IRI:
        return Val(F.lit(t.v), "iri", None, t)
    if t.k == LITERAL:
        try:
            if t.dt == STRING:
                return Val(F.lit(t.v), "string", None, t)
            if t.dt == INTEGER:
                n = int(t.v)
                return Val(F.lit(n).cast("bigint" if abs(n) < 2**63 else "decimal(38,0)"), "integer", None, t)
            if t.dt == DECIMAL:
                return Val(F.lit(Decimal(t.v)).cast(SPARK["decimal"]), "decimal", None, t)
            if t.dt in (DOUBLE, FLOAT):
                kind = "double" if t.dt == DOUBLE else "float"
                return Val(F.lit(float(t.v.replace("INF", "inf"))).cast(kind), kind, None, t)
            if t.dt == BOOLEAN and t.v in ("true", "false", "1", "0"):
                return Val(F.lit(t.v in ("true", "1")), "boolean", None, t)
            if t.dt == DATETIME:
                d = dt.datetime.fromisoformat(t.v.replace("Z", "+00:00"))
                if d.tzinfo:
                    d = d.astimezone(dt.timezone.utc).replace(tzinfo=None)
                return Val(F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz"), "dateTime", None, t)
        except (ValueError, InvalidOperation, OverflowError):
            pass
    return Val(lit_col(t), "term", None, t)


# Parts of terms

def is_numeric_dt(d: Column) -> Column:
    return d.isin(*NUMERIC_TYPES)


_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
_DOUBLE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def double_of(v: Column) -> Column:
    """XSD's lexical forms of double."""
    return F.when(v.rlike(_DOUBLE), v.try_cast("double")).when(v.isin("INF", "+INF"), F.lit(float("inf"))).when(v == "-INF", F.lit(float("-inf"))).when(v == "NaN", F.lit(float("nan")))


def term_number(t: Column) -> Column:
    """Double value of a numeric TERM; NULL for others."""
    whole = t["dt"].isin(*INTEGER_TYPES)
    return F.when(t["k"] == LITERAL, F.when(whole, F.when(t["v"].rlike(r"^[+-]?[0-9]+$"), t["v"].try_cast("double"))).when(t["dt"] == DECIMAL, F.when(t["v"].rlike(_NUMBER), t["v"].try_cast("double"))).when(t["dt"].isin(FLOAT, DOUBLE), double_of(t["v"])))


def term_decimal(t: Column) -> Column:
    """Exact value of an integer or decimal TERM."""
    return F.when((t["k"] == LITERAL) & t["dt"].isin(*INTEGER_TYPES, DECIMAL) & t["v"].rlike(_NUMBER), t["v"].try_cast("decimal(38,18)"))


def term_rank(t: Column) -> Column:
    """0 integer, 1 decimal, 2 float, 3 double."""
    return F.when(t["dt"].isin(*INTEGER_TYPES), 0).when(t["dt"] == DECIMAL, 1).when(t["dt"] == FLOAT, 2).when(t["dt"] == DOUBLE, 3)


def is_string(t: Column) -> Column:
    return (t["k"] == LITERAL) & t["dt"].isin(*STRING_TYPES)


def is_stringly(t: Column) -> Column:
    return (t["k"] == LITERAL) & t["dt"].isin(*STRING_TYPES, LANG_STRING, DIR_LANG_STRING)


def boolean_of(v: Column) -> Column:
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)


_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def instant_of(v: Column) -> Column:
    """UTC instant, as timestamp_ntz, of a lexical dateTime or date."""
    full = F.when(v.rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T"), v).when(v.rlike(rf"^-?[0-9]{{4,}}-[0-9]{{2}}-[0-9]{{2}}({_ZONE[:-1]})?$"), F.concat(F.substring(v, 1, 10), F.lit("T00:00:00"), F.regexp_extract(v, _ZONE, 1)))
    zoned = F.when(full.rlike(_ZONE), full).otherwise(F.concat(full, F.lit("Z")))
    return zoned.try_cast("timestamp").cast("timestamp_ntz")


def time_of(v: Column) -> Column:
    """Seconds of day in UTC of a lexical time."""
    part = lambda i: F.regexp_extract(v, r"^([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)", i).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) - F.coalesce(zone_seconds(v), F.lit(0))


def zone_seconds(v: Column) -> Column:
    z = F.regexp_extract(v, _ZONE, 1)
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    return F.when(z == "Z", F.lit(0)).when(z != "", sign * (F.substring(z, 2, 2).try_cast("int") * 3600 + F.substring(z, 5, 2).try_cast("int") * 60))


_DURATION = r"^(-?)P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?$"


def duration_of(v: Column) -> tuple[Column, Column]:
    """(months, seconds) of a lexical duration."""
    ok = v.rlike(_DURATION) & ~v.rlike("(P|T)$")
    part = lambda i: F.coalesce(F.regexp_extract(v, _DURATION, i).try_cast("double"), F.lit(0.0))
    sign = F.when(F.regexp_extract(v, _DURATION, 1) == "-", -1).otherwise(1)
    return F.when(ok, (sign * (part(2) * 12 + part(3))).cast("int")), F.when(ok, sign * (part(4) * 86400 + part(5) * 3600 + part(6) * 60 + part(7)))


def seconds_text(s: Column) -> Column:
    """A dayTimeDuration's lexical form."""
    a = F.abs(s)
    d, h, m = F.floor(a / 86400), F.floor(a % 86400 / 3600), F.floor(a % 3600 / 60)
    rest = F.regexp_replace(F.regexp_replace(F.round(a % 60, 6).cast("decimal(10,6)").cast("string"), "0+$", ""), r"\.$", "")
    some = lambda n, u: F.when(n > 0, F.concat(n.cast("string"), F.lit(u))).otherwise("")
    secs = F.when(F.round(a % 60, 6) > 0, F.concat(rest, F.lit("S"))).otherwise("")
    clock = F.concat(some(h, "H"), some(m, "M"), secs)
    body = F.concat(some(d, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.when(s == 0, "PT0S").when(s.isNotNull(), F.concat(F.when(s < 0, "-P").otherwise("P"), body))


def months_text(m: Column) -> Column:
    a = F.abs(m)
    y, r = F.floor(a / 12), a % 12
    body = F.concat(F.when(y > 0, F.concat(y.cast("string"), F.lit("Y"))).otherwise(""), F.when(r > 0, F.concat(r.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(m == 0, "P0M").when(m.isNotNull(), F.concat(F.when(m < 0, "-P").otherwise("P"), body))


def lit_term(v: Column, datatype: str) -> Val:
    return Val(F.when(v.isNotNull(), term_col(LITERAL, v, F.lit(datatype))), "term")


# Logic and comparison

def ebv(x: Val) -> Column:
    if x.t == "boolean":
        return x.col
    if x.t == "string":
        return F.length(x.col) > 0
    if x.t in NUMERIC:
        return (x.col != 0) & ~F.isnan(x.col) if x.t in ("float", "double") else x.col != 0
    if x.t == "term":
        t = x.col
        n = term_number(t)
        return F.when(t["dt"] == BOOLEAN, F.coalesce(boolean_of(t["v"]), F.lit(False))).when(is_string(t), F.length(t["v"]) > 0).when(is_numeric_dt(t["dt"]), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))
    return NULL("boolean")


def promote(a: Val, b: Val) -> tuple[Column, Column, str]:
    t = NUMERIC[max(NUMERIC.index(a.t), NUMERIC.index(b.t))]
    kind = SPARK[t] if t != "integer" else "bigint"
    return (a.col if a.t == t else a.col.cast(kind)), (b.col if b.t == t else b.col.cast(kind)), t


def _no_nan(a: Column, b: Column, t: str, result: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), False).otherwise(result) if t in ("float", "double") else result


def eq(a: Val, b: Val, lexical_too: bool = False) -> Column:
    if a.t in NUMERIC and b.t in NUMERIC:
        x, y, t = promote(a, b)
        # Spark's NaN equals itself; with a constant that is a number it makes no difference
        number = any(v.const is not None and v.const.v != "NaN" for v in (a, b))
        return x == y if number else _no_nan(x, y, t, x == y)
    if a.t == b.t and a.t in ("string", "boolean", "dateTime", "date"):
        return a.col == b.col
    if a.t == b.t == "iri":
        for x, y in ((a, b), (b, a)):
            if x.key == INTEGER and y.const is not None:  # a constant's key, so that the scan can use it
                rest = y.const.v.removeprefix(x.template)
                known = y.const.v.startswith(x.template) and len(rest) < 19 and rest.lstrip("-").isdigit() and str(int(rest)) == rest
                return x.col == F.lit(int(rest)) if known else F.when(x.col.isNotNull(), False)
        return a.col == b.col if a.template == b.template else a.iri_text() == b.iri_text()
    if "term" not in (a.t, b.t):
        if "iri" in (a.t, b.t):
            return F.when(a.col.isNotNull() & b.col.isNotNull(), False)
        return NULL("boolean")
    return eq_terms(a.term(), b.term(), lexical_too)


def eq_terms(x: Column, y: Column, lexical_too: bool = False) -> Column:
    nx, ny = term_number(x), term_number(y)
    lits = (x["k"] == LITERAL) & (y["k"] == LITERAL)
    same_dt = x["dt"] == y["dt"]
    mx, sx = duration_of(x["v"])
    my, sy = duration_of(y["v"])
    durations = (DURATION, DAY_TIME, YEAR_MONTH)
    same = (x["k"] == y["k"]) & (x["v"] == y["v"]) & x["dt"].eqNullSafe(y["dt"]) & x["lang"].eqNullSafe(y["lang"]) & x["dir"].eqNullSafe(y["dir"])
    return (
        F.when(~lits, same)
        .when(is_numeric_dt(x["dt"]) & is_numeric_dt(y["dt"]), F.when(F.isnan(nx) | F.isnan(ny), False).otherwise(nx == ny))
        .when(is_string(x) & is_string(y), x["v"] == y["v"])
        .when(is_stringly(x) & is_stringly(y), same)
        .when(same_dt & (x["dt"] == BOOLEAN), boolean_of(x["v"]) == boolean_of(y["v"]))
        .when(same_dt & x["dt"].isin(DATETIME, DATE), instant_of(x["v"]) == instant_of(y["v"]))
        .when(same_dt & (x["dt"] == TIME), time_of(x["v"]) == time_of(y["v"]))
        .when(x["dt"].isin(*durations) & y["dt"].isin(*durations), (mx == my) & (sx == sy))
        .when(same, True)
        .when(F.lit(False) if not lexical_too else same_dt, False)
    )


def lt(a: Val, b: Val, c: Context) -> Column:
    if a.t in NUMERIC and b.t in NUMERIC:
        x, y, t = promote(a, b)
        if t in ("float", "double"):  # Spark puts NaN above all others
            return (x < y) & ~F.isnan(y) if b.const is None or b.const.v == "NaN" else x < y
        return x < y
    if a.t == b.t and a.t in ("string", "boolean", "dateTime", "date"):
        return a.col < b.col
    if "term" not in (a.t, b.t) and not c.full_comparison:
        return NULL("boolean")
    x, y = a.term(), b.term()
    if c.full_comparison:
        return F.when(x.isNotNull() & y.isNotNull(), sort_key(x) < sort_key(y))
    nx, ny = term_number(x), term_number(y)
    same_dt = x["dt"] == y["dt"]
    mx, sx = duration_of(x["v"])
    my, sy = duration_of(y["v"])
    return (
        F.when(is_numeric_dt(x["dt"]) & is_numeric_dt(y["dt"]), F.when(F.isnan(nx) | F.isnan(ny), False).otherwise(nx < ny))
        .when(is_string(x) & is_string(y), x["v"] < y["v"])
        .when(same_dt & (x["dt"] == BOOLEAN), boolean_of(x["v"]) < boolean_of(y["v"]))
        .when(same_dt & x["dt"].isin(DATETIME, DATE), instant_of(x["v"]) < instant_of(y["v"]))
        .when(same_dt & (x["dt"] == TIME), time_of(x["v"]) < time_of(y["v"]))
        .when(same_dt & (x["dt"] == YEAR_MONTH), mx < my)
        .when(same_dt & (x["dt"] == DAY_TIME), sx < sy)
        .when((x["k"] == TRIPLE) & (y["k"] == TRIPLE), x["v"] < y["v"])
        .when(same_dt if c.lexical_comparison else F.lit(False), x["v"] < y["v"])
    )


def le(a: Val, b: Val, c: Context) -> Column:
    if a.t in NUMERIC and b.t in NUMERIC:
        x, y, t = promote(a, b)
        return (x <= y) & ~F.isnan(y) if t in ("float", "double") and (b.const is None or b.const.v == "NaN") else x <= y
    if a.t == b.t and a.t in ("string", "boolean", "dateTime", "date"):
        return a.col <= b.col
    return lt(a, b, c) | eq(a, b, c.lexical_comparison)


def sort_key(t: Column) -> Column:
    """Orders any terms: unbound, blank nodes, IRIs, literals by class and value, triple terms."""
    n = term_number(t)
    when = F.when(t["dt"].isin(DATETIME, DATE), F.unix_micros(instant_of(t["v"]).cast("timestamp"))).cast("double")
    months, secs = duration_of(t["v"])
    cls = F.when(n.isNotNull(), 0).when(is_string(t), 1).when(t["dt"] == BOOLEAN, 2).when(t["dt"].isin(DATETIME, DATE), 3).otherwise(4)
    rank = F.coalesce(n, when, F.when(t["dt"] == TIME, time_of(t["v"])), F.when(t["dt"].isin(DURATION, DAY_TIME, YEAR_MONTH), months * 2629746.0 + secs))
    literal_part = t["k"] == LITERAL
    return F.when(t.isNotNull(), F.struct(t["k"].alias("k"), F.when(literal_part, cls).alias("c"), F.when(literal_part & (cls == 4), t["dt"]).alias("d"), F.when(literal_part, rank).alias("n"), t["v"].alias("v"), F.coalesce(t["lang"], F.lit("")).alias("l")))


def order_column(x: Val) -> Column:
    if x.t == "iri":
        return x.iri_text()
    return sort_key(x.col) if x.t == "term" else x.col


# Arithmetic

def arithmetic(op: str, a: Val, b: Val) -> Val:
    if a.t in NUMERIC and b.t in NUMERIC:
        x, y, t = promote(a, b)
        if op == "/":
            if t in ("integer", "decimal"):
                top = a.col.cast("decimal(38,18)")
                low = b.col.cast("decimal(20,0)" if b.t == "integer" else "decimal(38,18)")
                return Val(F.try_divide(top, low).cast("decimal(38,18)"), "decimal")
            q = F.when((y == 0) & (x == 0), F.lit(float("nan"))).when(y == 0, F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(x)).otherwise(F.try_divide(x, y))
            return Val(q.cast(SPARK[t]), t)
        r = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        return Val(r.cast(SPARK[t]) if t != "integer" else r, t)
    known = native_dates(op, a, b)
    if known is not None:
        return known
    dated = a.t in ("dateTime", "date") or b.t in ("dateTime", "date")
    return Val(bound(lambda x, y: dates(op, x, y) if dated else _arithmetic(op, x, y), a, b), "term")


def _arithmetic(op: str, x: Column, y: Column) -> Column:
    """Of terms whose types aren't known."""
    rank = F.greatest(term_rank(x), term_rank(y))
    dx, dy, ex, ey = term_number(x), term_number(y), term_decimal(x), term_decimal(y)
    if op == "/":
        exact = F.try_divide(ex, ey.cast("decimal(38,10)")).cast("decimal(38,18)")
        approx = F.when((dy == 0) & (dx == 0), F.lit(float("nan"))).when(dy == 0, F.when(dx > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.try_divide(dx, dy))
        rank = F.greatest(rank, F.lit(1))
    else:
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        exact, approx = f(ex, ey), f(dx, dy)
    v = F.when(rank == 0, F.regexp_replace(exact.cast("string"), r"\.0*$", "")).when(rank == 1, lexical(exact, DECIMAL)).otherwise(lexical(approx, DOUBLE))
    datatype = F.when(rank == 0, INTEGER).when(rank == 1, DECIMAL).when(rank == 2, FLOAT).otherwise(DOUBLE)
    number = F.when(dx.isNotNull() & dy.isNotNull() & v.isNotNull(), term_col(LITERAL, v, datatype))
    return F.coalesce(number, dates(op, x, y)) if op in "+-" else number


def bound(f: Callable[[Column, Column], Column], a: Val, b: Val) -> Column:
    """f of two values as terms, each computed once; constants stay constants."""
    parts = [v.term() for v in (a, b) if v.const is None]
    if not parts:
        return f(a.term(), b.term())

    def whole(*known: Column) -> Column:
        it = iter(known)
        return f(*[v.term() if v.const is not None else next(it) for v in (a, b)])

    return let(whole, *parts)


def let(f: Callable[..., Column], *cols: Column) -> Column:
    """f of the columns, each of which is computed once a row, however often f names it: written
    out at each place, expressions that hold one another grow by powers."""
    return F.transform(F.array(F.struct(*[c.alias(f"x{i}") for i, c in enumerate(cols)])), lambda s: f(*[s[f"x{i}"] for i in range(len(cols))]))[0]


#: Months and seconds up to which a constant duration becomes an interval.
MOST_MONTHS, MOST_SECONDS = 12 * 9_000, 86_400 * 3_000_000


def constant_duration(x: Val) -> tuple[int, Decimal] | None:
    """(months, seconds) of a constant duration; None if it is none, or a very long one."""
    if x.const is None or x.const.dt not in (DURATION, DAY_TIME, YEAR_MONTH):
        return None
    m = re.match(_DURATION, x.const.v, re.A)
    if m is None or x.const.v[-1] in "PT\n":
        return None
    part = [Decimal(m[i] or 0) for i in range(2, 8)]
    months, seconds = part[0] * 12 + part[1], part[2] * 86400 + part[3] * 3600 + part[4] * 60 + part[5]
    if months > MOST_MONTHS or seconds > MOST_SECONDS:
        return None
    sign = -1 if m[1] else 1
    return int(sign * months), sign * seconds


def native_dates(op: str, a: Val, b: Val) -> Val | None:
    """Where both types are known: a date and a constant duration, or the difference of two dates
    and times. None for all else; a constant that isn't native, or has a zone to keep, is among it."""
    if op not in "+-" or a.t not in ("dateTime", "date") or a.const is not None:
        return None
    if op == "-" and b.t == a.t:
        micros = lambda v: F.unix_micros(v.col.cast("timestamp"))
        return lit_term(let(seconds_text, (micros(a) - micros(b)) / 1_000_000), DAY_TIME)
    by = constant_duration(b)
    if by is None:
        return None
    sign = 1 if op == "+" else -1
    at = a.col.cast("timestamp_ntz")
    if by[0]:
        at = at + F.make_ym_interval(F.lit(0), F.lit(by[0] * sign))
    if by[1]:
        at = at + F.lit(dt.timedelta(microseconds=int(by[1] * 1_000_000) * sign))
    return Val(at.cast("date") if a.t == "date" else at, a.t)


def dates(op: str, x: Column, y: Column) -> Column:
    """Dates and times with durations, differences of dates, sums of durations."""
    (mx, sx), (my, sy) = duration_of(x["v"]), duration_of(y["v"])
    parts = instant_of(x["v"]), instant_of(y["v"]), F.regexp_extract(x["v"], _ZONE, 1), mx, sx, my, sy
    out = let(lambda *known: _dates(op, x, y, *known), *parts)
    return F.when(x.isNotNull() & y.isNotNull(), let(lambda t: F.when(t["v"].isNotNull(), t), out))


def _dates(op: str, x: Column, y: Column, ix: Column, iy: Column, zone: Column, mx: Column, sx: Column, my: Column, sy: Column) -> Column:
    times, durations = (DATETIME, DATE), (DURATION, DAY_TIME, YEAR_MONTH)
    sign = 1 if op == "+" else -1
    moved = F.add_months(ix.cast("date"), my * sign)
    clock = F.unix_micros(ix.cast("timestamp")) - F.unix_micros(ix.cast("date").cast("timestamp"))
    at = F.unix_micros(moved.cast("timestamp")) + clock + (sy * 1_000_000 * sign).cast("long")
    local = F.timestamp_micros(at + F.coalesce(zone_seconds(x["v"]), F.lit(0)) * 1_000_000).cast("timestamp_ntz")
    text = let(lambda t: F.when(x["dt"] == DATE, F.date_format(t, "yyyy-MM-dd")).otherwise(lexical(t, DATETIME)), local)
    out = F.when(x["dt"].isin(*times) & y["dt"].isin(*durations), term_col(LITERAL, F.concat(text, zone), x["dt"]))
    total = F.pmod(time_of(x["v"]) + F.coalesce(zone_seconds(x["v"]), F.lit(0)) + sy * sign, F.lit(86400.0))
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    clock_text = let(lambda t: F.concat_ws(":", two(t / 3600), two(t % 3600 / 60), two(t % 60)), total)
    out = out.when((x["dt"] == TIME) & (y["dt"] == DAY_TIME), term_col(LITERAL, F.concat(clock_text, zone), F.lit(TIME)))
    seconds = lambda s: term_col(LITERAL, let(seconds_text, s), F.lit(DAY_TIME))
    if op == "-":
        gap = (F.unix_micros(ix.cast("timestamp")) - F.unix_micros(iy.cast("timestamp"))) / 1_000_000
        out = out.when(x["dt"].isin(*times) & (x["dt"] == y["dt"]), seconds(gap))
        out = out.when((x["dt"] == TIME) & (y["dt"] == TIME), seconds(time_of(x["v"]) - time_of(y["v"])))
    out = out.when((x["dt"] == DAY_TIME) & (y["dt"] == DAY_TIME), seconds(sx + sy * sign))
    return out.when((x["dt"] == YEAR_MONTH) & (y["dt"] == YEAR_MONTH), term_col(LITERAL, let(months_text, mx + my * sign), F.lit(YEAR_MONTH)))


def unary_number(x: Val, native: Callable[[Column, str], Column]) -> Val:
    """A function that keeps the numeric type."""
    if x.t in NUMERIC:
        r = native(x.col, x.t)
        return Val(r.cast(SPARK[x.t]) if x.t != "integer" else r.cast("bigint"), x.t)
    t = x.term()
    rank, exact, approx = term_rank(t), term_decimal(t), term_number(t)
    e, a = native(exact, "decimal"), native(approx, "double")
    v = F.when(rank == 0, F.regexp_replace(e.cast("string"), r"\.0*$", "")).when(rank == 1, lexical(e.cast("decimal(38,18)"), DECIMAL)).otherwise(lexical(a.cast("double"), DOUBLE))
    return Val(F.when(approx.isNotNull(), term_col(LITERAL, v, F.when(rank == 0, INTEGER).otherwise(t["dt"]))), "term")


# Strings

def text(x: Val) -> Column:
    """Lexical value of a string literal, with or without language; NULL for others."""
    if x.t == "string":
        return x.col
    if x.t == "term":
        return F.when(is_stringly(x.col), x.col["v"])
    return NULL()


def plain(x: Val) -> Column:
    """Lexical value of a literal without language."""
    if x.t == "string":
        return x.col
    return F.when(is_string(x.col), x.col["v"]) if x.t == "term" else NULL()


def like(x: Val, v: Column) -> Val:
    """v with the language and direction of x."""
    if x.t == "string":
        return Val(v, "string")
    t = x.term()
    return Val(F.when(v.isNotNull() & is_stringly(t), term_col(LITERAL, v, t["dt"], t["lang"], t["dir"])), "term")


def compatible(a: Val, b: Val) -> Column:
    """Whether b can be searched in a: b has no language, or a's."""
    if b.t == "string":
        return F.lit(True)
    x, y = a.term(), b.term()
    return y["lang"].isNull() | (y["lang"].eqNullSafe(x["lang"]) & y["dir"].eqNullSafe(x["dir"]))


def str_of(x: Val) -> Column:
    if x.const is not None:
        return F.lit(x.const.v) if x.const.k != BNODE else NULL()
    if x.t == "iri":
        return x.iri_text()
    if x.t == "term":
        return F.when(x.col["k"] != BNODE, x.col["v"])
    return lexical(x.col, DT_OF[x.t])


FLAGS = {"i", "m", "s", "x", "q"}


def java_pattern(p: Val, flags: Val | None) -> tuple[str | None, Column]:
    """(constant pattern or None, column). Unknown or repeated flags end the query."""
    f = ""
    if flags is not None:
        if flags.const is None:
            raise ValueError("regex flags must be constant")
        f = flags.const.v
        if len(set(f)) != len(f) or set(f) - FLAGS:
            raise ValueError(f"regex flags {f!r}")
    head = f"(?{''.join(c for c in f if c != 'q')})" if set(f) - {"q"} else ""
    if p.const is not None:
        body = "\\Q" + p.const.v.replace("\\E", "\\E\\\\E\\Q") + "\\E" if "q" in f else p.const.v
        return head + body, F.lit(head + body)
    c = text(p)
    c = F.concat(F.lit("\\Q"), c, F.lit("\\E")) if "q" in f else c
    return None, F.concat(F.lit(head), c)


ENCODED = {"*": "%2A", "+": "%20"}


def encode_for_uri(c: Column, reference: bool) -> Column:
    out = F.url_encode(c)
    for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        out = F.regexp_replace(out, a, b)
    if reference:
        for ch in "/?#&=+:@,;$!*'()":
            out = F.regexp_replace(out, f"%{ord(ch):02X}", "\\" + ch if ch == "$" else ch)
    return out


def lang_matches(tag: Column, wanted: Val) -> Column:
    """Extended filtering: subtags of the range occur in order; * stands for any."""
    tag = F.lower(tag)
    if wanted.const is not None:
        r = wanted.const.v.lower()
        if r == "*":
            return tag != ""
        parts = r.split("-")
        first = "[a-z0-9]+" if parts[0] == "*" else parts[0]
        rest = "".join("" if p == "*" else f"(-[a-z0-9]{{2,}})*?-{p}" for p in parts[1:])
        return (tag != "") & tag.rlike(f"^{first}{rest}(-.*)?$")
    r = F.lower(text(wanted))
    return F.when(r == "*", tag != "").otherwise((tag == r) | tag.startswith(F.concat(r, F.lit("-"))))


# Casts

def cast(datatype: str, x: Val) -> Val:
    t, v = x.term(), str_of(x)
    is_str = F.lit(True) if x.t == "string" else is_string(t) if x.t == "term" else F.lit(False)
    if datatype == STRING:
        return Val(v, "string")
    if datatype == BOOLEAN:
        if x.t in ("boolean", *NUMERIC):
            return Val(ebv(x), "boolean")
        n = term_number(t)
        return Val(F.when(is_str | (t["dt"] == BOOLEAN), boolean_of(v)).when(n.isNotNull(), (n != 0) & ~F.isnan(n)), "boolean")
    flag = F.when(t["dt"] == BOOLEAN, boolean_of(v).cast("int"))
    if datatype in (INTEGER, DECIMAL):
        if x.t in NUMERIC:
            if datatype == INTEGER:
                return Val(x.col if x.t == "integer" else F.when(F.abs(x.col) < 9.2e18, x.col.try_cast("bigint")), "integer")
            return Val(x.col.try_cast("decimal(38,18)"), "decimal")
        pattern = r"^[+-]?[0-9]+$" if datatype == INTEGER else _NUMBER
        parsed = F.when(is_str & v.rlike(pattern), v.try_cast("decimal(38,18)"))
        number = F.coalesce(term_decimal(t), F.when(t["dt"].isin(FLOAT, DOUBLE), term_number(t)).try_cast("decimal(38,18)"))
        out = F.coalesce(parsed, number, flag.cast("decimal(38,18)"))
        return Val(out.try_cast("bigint") if datatype == INTEGER else out, "integer" if datatype == INTEGER else "decimal")
    if datatype in (FLOAT, DOUBLE):
        kind = "double" if datatype == DOUBLE else "float"
        if x.t in NUMERIC:
            return Val(x.col.cast(kind), kind)
        return Val(F.coalesce(F.when(is_str, double_of(v)), term_number(t), flag.cast("double")).cast(kind), kind)
    if datatype in (DATETIME, DATE):
        if x.t == "dateTime" and x.const is None:
            return x if datatype == DATETIME else Val(x.col.cast("date"), "date")
        ok = is_str | t["dt"].isin(DATETIME, DATE)
        zone = F.regexp_extract(v, _ZONE, 1)
        if datatype == DATETIME:
            out = F.when(v.rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"), v).when(v.rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}"), F.concat(F.substring(v, 1, 10), F.lit("T00:00:00"), zone))
        else:
            out = F.when(v.rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}"), F.concat(F.substring(v, 1, 10), zone))
        return lit_term(F.when(ok & instant_of(v).isNotNull(), out), datatype)
    if datatype == TIME:
        clock = F.regexp_extract(v, r"(?:^|T)([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)$", 1)
        return lit_term(F.when(clock != "", clock), TIME)
    if datatype in (DURATION, DAY_TIME, YEAR_MONTH):
        months, secs = duration_of(v)
        out = F.when(months.isNotNull(), v)
        if datatype != DURATION:
            out = F.when(months.isNotNull(), seconds_text(secs) if datatype == DAY_TIME else months_text(months))
        return lit_term(out, datatype)
    return Val(NULL("struct<k:int,v:string,dt:string,lang:string,dir:string>"), "term")


CASTS = {STRING, BOOLEAN, INTEGER, DECIMAL, FLOAT, DOUBLE, DATETIME, DATE, TIME, DURATION, DAY_TIME, YEAR_MONTH}
