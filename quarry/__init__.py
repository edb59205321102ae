"""quarry: document ingestion, retrieval and corpus analytics as Spark plans."""
