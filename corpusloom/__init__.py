"""corpusloom: Spark jobs that prepare and analyse text training corpora."""
