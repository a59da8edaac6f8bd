"""corpuslake: corpus, retrieval and evaluation analytics as Spark plans."""
