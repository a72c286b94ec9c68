"""DESCRIBE reads only what can hold its subjects."""

from quadspark.engine import Engine


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_describe_reads_tables_of_its_subjects(spark, small):
    df = Engine.over_tables(spark, small).query("DESCRIBE ?r WHERE { ?r region:r_name 'ASIA' }")
    assert _scans(df) == 2 and df.count() == 3


def test_describe_of_terms_reads_all(spark, small):
    text = "DESCRIBE ?x WHERE {{ {{ ?x region:r_name 'ASIA' }} UNION {{ ?y nation:n_name 'NATION_3' ; {} ?x }} }}"
    e = Engine.over_tables(spark, small)
    assert e.query(text.format("nation:regionRef")).select("s").distinct().count() == len(set(e.query("SELECT ?x WHERE { { ?x region:r_name 'ASIA' } UNION { ?y nation:n_name 'NATION_3' ; nation:regionRef ?x } }").collect()))
    names = Engine.over_tables(spark, small).query("DESCRIBE ?n WHERE { ?x nation:n_name ?n }")
    assert names.count() == 0


def test_written_ranges_are_sampled_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from quadspark.sources.results import jsonld_lines, turtle_lines
    from quadspark.terms import IRI, term_col

    node = lambda c: term_col(IRI, F.concat(F.lit("http://x/"), c.cast("string")))
    quads = spark.range(0, 4000, 1, 1).select(node(F.col("id") % 7).alias("s"), F.lit("http://x/p").alias("p"), node(F.col("id")).alias("o"), F.lit("").alias("g"))
    for lines in (turtle_lines, jsonld_lines):
        df = lines(quads, rows_per_task=100)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [s" in plan and plan.count("RepartitionByExpression") == 2
        assert df.rdd.getNumPartitions() == 40
