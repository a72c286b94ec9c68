"""SPARQL expressions as Spark columns."""
