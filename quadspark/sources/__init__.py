"""Sources of triples, readers of RDF files, and writers of results."""
