"""graphloom: documents to knowledge graph, vectors, retrieval and evaluation as Spark plans."""
