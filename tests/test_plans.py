"""What Spark is given: keys for joins, the order of joins, one flag a row."""

import pytest
from pyspark.sql import functions as F

from quadspark.engine import Engine
from quadspark.operators import paths
from quadspark.operators.lower import Entry, join_order
from quadspark.operators.update import Store
from quadspark.plans.algebra import Const, Exists
from quadspark.queries import CHAIN, SPARQL, tree
from quadspark.sources.quads import QuadSource, rows
from quadspark.sources.rdf_files import from_text, read_bad_lines, read_rdf
from quadspark.sources.results import write_nquads, write_turtle
from quadspark.terms import iri, literal


def plan(spark, small, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return Engine.over_tables(spark, small).explain(SPARQL[name][0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["minus_undef", "minus_two_unbound", "optional_then_join", "exists_unbound_key", "values_undef"])
def test_unbound_keys_have_equalities(spark, small, name):
    """Nested loops are only left where a row without a value meets all others."""
    text = plan(spark, small, name)
    assert "BroadcastNestedLoopJoin LeftAnti" not in text and "BroadcastNestedLoopJoin LeftOuter" not in text
    if name != "exists_unbound_key":
        assert "NestedLoop" not in text or name == "values_undef"


def test_cycle_keeps_joins_small(spark, small):
    """lineitem leads to orders by key, then each join has a key of one side; the nations come last, with the customer's key."""
    text = Engine.over_tables(spark, small).explain(SPARQL["bgp_cycle"][0])
    assert "Cartesian" not in text and "NestedLoop" not in text
    line, orders, supplier, customer = Entry({"l", "o", "s"}, 6e6, {"l": 6e6, "o": 1.5e6, "s": 1e4}), Entry({"o", "c"}, 1.5e6, {"o": 1.5e6, "c": 1.5e5}), Entry({"s", "n"}, 1e4, {"s": 1e4, "n": 25}), Entry({"c", "n"}, 1.5e5, {"c": 1.5e5, "n": 25})
    order = join_order([customer, supplier, orders, line])
    assert order[0] == 3 and order.index(0) > order.index(2)  # customers only after their key is known


def test_order_begins_with_what_is_selective():
    few, many, other = Entry({"a"}, 3, {"a": 3}), Entry({"a", "b"}, 1e6, {"a": 1e6, "b": 1e6}), Entry({"b", "c"}, 1e6, {"b": 1e6, "c": 1e6})
    assert join_order([other, many, few])[-1] == 0  # the unrelated large one last
    assert join_order([]) == [] and join_order([few]) == [0]
    apart = Entry({"z"}, 2, {"z": 2})
    assert join_order([apart, many, other])[-1] == 0  # no cross product before it must be


def test_flags_keep_the_rows(spark, small):
    e = Engine.over_tables(spark, small)
    n = e.query("SELECT ?k { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:toxic ?t } }").count()
    assert e.query("SELECT ?k ?e { ?d documents:doc_id ?k OPTIONAL { ?l labels:docRef ?d ; labels:toxic ?t } BIND(EXISTS { ?m labels:toxic ?t } AS ?e) }").count() == n


def test_exists_writes_values_in(spark):
    """Outer variables stand for their values in optional parts, unions and MINUS."""
    text = "<http://x/a> <http://x/p> 1 ; <http://x/q> 5 . <http://x/b> <http://x/p> 2 ; <http://x/q> 6 ; <http://x/r> 1 ."
    e = Engine(spark, from_text(spark, text), prefixes={"": "http://x/"})
    ask = lambda inner: sorted(r.s for r in e.query(f"SELECT ?s {{ ?s :p ?v FILTER EXISTS {{ {inner} }} }}").collect())
    a, b = "http://x/a", "http://x/b"
    assert ask("?s :q ?w OPTIONAL { ?s :r ?v }") == [a, b]  # an optional part takes nothing away
    assert ask("?s :q ?w MINUS { ?s :r ?u }") == [a, b]  # no variable is shared once values are in
    assert ask("?s :q ?w MINUS { ?z :r ?v }") == [a, b]
    assert ask("{ ?s :q ?w FILTER(?v > 1) } UNION { ?s :none ?w }") == [b]
    assert ask("?s :q ?w BIND(?v + 4 AS ?x) FILTER(?x = ?w)") == [a, b]
    assert ask("?s :q ?w FILTER NOT EXISTS { ?s :r ?u FILTER(?v = 2) }") == [a]
    with pytest.raises(ValueError):
        ask("?s :q ?w BIND(?v AS ?v)")
    assert e.query("SELECT (SUM(IF(EXISTS { ?s :r ?u }, 1, 0)) AS ?n) { ?s :p ?v }").first().n == "1" or e.query("SELECT (SUM(IF(EXISTS { ?s :r ?u }, 1, 0)) AS ?n) { ?s :p ?v }").first().n == 1
    assert [r.s for r in e.query("SELECT ?s { ?s :p ?v } ORDER BY (EXISTS { ?s :r ?u })").collect()] == [a, b]
    assert Exists(Const(iri("http://x/"))) is not None


def test_strict_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://x/a> <http://x/p> "v" . # note\n\n# note\nbroken\n<http://x/a> <http://x/p> .\n')
    path = str(tmp_path / "a.nt")
    assert read_rdf(spark, path, lenient=True).count() == 1 and read_bad_lines(spark, path).count() == 2
    with pytest.raises(Exception, match="no quad"):
        read_rdf(spark, path).collect()
    with pytest.raises(Exception, match="no quad"):
        Engine(spark, read_rdf(spark, path)).query("SELECT ?s { ?s ?p ?o }").collect()


def test_text_survives_lines(spark, tmp_path):
    """Escapes of every kind, and literals of a million characters."""
    values = ["C:\\temp\\new", 'a "quoted"\tline\r\nnext', "\\", "\\\\n", "é𝒳", "x" * 1_000_000, "back\\\\slash\\t", "a\nb\n" * 3000]
    quads = rows(spark, [(iri(f"http://x/{i}"), "http://x/p", literal(v), "") for i, v in enumerate(values)])
    write_nquads(quads, str(tmp_path / "n"))
    got = {r.s.v: r.o.v for r in read_rdf(spark, str(tmp_path / "n"), "application/n-quads").collect()}
    assert [got[f"http://x/{i}"] for i in range(len(values))] == values
    (tmp_path / "u.nt").write_text('<http://x/a> <http://x/p> "\\u00e9\\n\\"" .\n')
    assert read_rdf(spark, str(tmp_path / "u.nt")).first().o.v == 'é\n"'
    write_turtle(quads, str(tmp_path / "t"), {"x": "http://x/"}, 3)
    assert {r.o.v for r in read_rdf(spark, str(tmp_path / "t"), "text/turtle").collect()} == set(values)


def test_long_closures_double(spark, small, monkeypatch):
    e = Engine(spark, QuadSource(tree(spark, small, True)))
    monkeypatch.setattr(paths, "DOUBLE_AFTER", 3)
    assert e.query(f"SELECT ?a ?b {{ ?a <{CHAIN}>+ ?b }}").distinct().count() == 300 * 299 // 2
    ring = rows(spark, [(iri(f"http://x/{i}"), "http://x/p", iri(f"http://x/{(i + 1) % 37}"), "") for i in range(37)])
    e = Engine(spark, QuadSource(ring))
    assert e.query("SELECT ?a ?b { ?a <http://x/p>+ ?b }").count() == 37 * 37
    assert e.query("SELECT ?b { <http://x/5> <http://x/p>* ?b }").count() == 37


def test_graphs_of_a_store(spark):
    s = Store(spark, from_text(spark, "<http://x/g> { <http://x/a> <http://x/b> 1 } <http://x/h> { <http://x/a> <http://x/b> 2 }", "application/trig"))
    e = Engine(spark, s, prefixes={"": "http://x/"})
    e.update("CLEAR NAMED")
    assert s.has("http://x/g") and s.has("http://x/h") and not s.has("http://x/i") and s.quads.isEmpty()
    with pytest.raises(KeyError):
        e.update("CREATE GRAPH :g")
    e.update("DROP GRAPH :g ; CREATE GRAPH :g ; DROP ALL")
    assert not s.has("http://x/g")
    with pytest.raises(KeyError):
        e.update("DROP GRAPH :h")
    assert e.sources[0].quads.where(F.lit(True)).isEmpty()
