"""textquarry: Spark-first analytics over text corpora, conversations, code and event metrics."""
