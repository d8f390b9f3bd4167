"""corpusloom: corpus analytics as Spark plans."""
