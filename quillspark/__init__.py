"""quillspark: a Spark-first analytics engine for document corpora."""
