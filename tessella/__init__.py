"""tessella: a Spark-first engine for HTML token analytics."""
