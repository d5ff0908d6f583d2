"""tessera: Spark jobs for code-context retrieval and training-data preparation."""
