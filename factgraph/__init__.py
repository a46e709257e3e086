"""factgraph: governed fact graphs as Spark tables and jobs."""
