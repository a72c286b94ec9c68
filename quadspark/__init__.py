"""quadspark: RDF and SPARQL analytics on Spark DataFrames."""
