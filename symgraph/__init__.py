"""symgraph: code and documentation intelligence as Spark DataFrame jobs."""
