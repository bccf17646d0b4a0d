"""lexmere: document collections to structured, traceable events, as Spark jobs."""
