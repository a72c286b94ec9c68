"""Arithmetic of dates: the same whether types are known or not, and plans that stay small."""

import pytest

from quadspark.engine import Engine

MONTHS, DAYS = "'{}'^^xsd:yearMonthDuration", "'{}'^^xsd:dayTimeDuration"
BY = ["- " + MONTHS.format("P1M"), "+ " + DAYS.format("-PT0.25S"), "+ 'P1M1DT1H'^^xsd:duration"]


def _quads(spark):
    from pyspark.sql import functions as F

    times = ["2020-01-31 23:59:59.5", "2020-02-29 00:00:00", "1999-12-31 12:00:00", "1969-12-31 23:59:59.999999", "0031-03-31 01:02:03"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "k long, t string").select("k", F.col("t").cast("timestamp_ntz").alias("at"), F.col("t").cast("timestamp_ntz").cast("date").alias("day"))


def _engine(spark):
    from quadspark.sources.virtual import TableMap, TableSource

    return Engine(spark, TableSource(lambda name: _quads(spark), (TableMap("x", ("k",)),), "http://t/"), prefixes={"x": "http://t/x#", "xsd": "http://www.w3.org/2001/XMLSchema#"})


@pytest.mark.parametrize("by", BY)
def test_durations_of_known_and_unknown_dates(spark, by):
    found = _engine(spark).query(f"SELECT (STR(?t {by}) AS ?a) (STR(xsd:dateTime(STR(?t)) {by}) AS ?b) (STR(?d {by}) AS ?c) (STR(xsd:date(STR(?d)) {by}) AS ?e) (DATATYPE(?t {by}) AS ?kind) WHERE {{ ?x x:at ?t ; x:day ?d }}").collect()
    assert len(found) == 5
    for r in found:
        assert r["a"] is not None and r["a"] == r["b"] and r["c"] is not None and r["c"] == r["e"]
        assert r["kind"].endswith("#dateTime")


def test_differences_of_known_and_unknown_dates(spark):
    at = "'2000-01-01T01:00:00+01:00'^^xsd:dateTime"
    found = _engine(spark).query(f"SELECT (STR(?t - {at}) AS ?a) (STR(xsd:dateTime(STR(?t)) - {at}) AS ?b) (STR(?t - ?t) AS ?z) (STR(?d - ?d) AS ?y) (DATATYPE(?t - {at}) AS ?kind) WHERE {{ ?x x:at ?t ; x:day ?d }}").collect()
    assert len(found) == 5 and "P7335DT23H59M59.5S" in {r["a"] for r in found}
    for r in found:
        assert r["a"] == r["b"] and r["z"] == r["y"] == "PT0S" and r["kind"].endswith("#dayTimeDuration")


def test_bad_operands_are_errors(spark):
    found = _engine(spark).query("SELECT (STR(?t + 'P'^^xsd:duration) AS ?a) (STR(?t + 1) AS ?b) (STR(?t + ?t) AS ?c) (STR(?d - ?t) AS ?e) (STR(?t - 'x') AS ?f) WHERE { ?x x:at ?t ; x:day ?d }").collect()
    assert [tuple(r) for r in found] == [(None,) * 5] * 5


@pytest.mark.parametrize("e", ["?d + 'P1DT2H'^^xsd:dayTimeDuration", "?d - 'P1M'^^xsd:yearMonthDuration", "?d - '1995-01-01T00:00:00'^^xsd:dateTime"])
def test_plans_stay_small(spark, small, e):
    text = f"SELECT ?k (STR({e}) AS ?a) WHERE {{ ?o orders:o_orderkey ?k ; orders:o_orderdate ?d }}"
    df = Engine.over_tables(spark, small).query(text)
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 10_000
