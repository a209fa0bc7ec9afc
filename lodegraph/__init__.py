"""lodegraph: graph, text and vector analytics expressed as Spark plans."""
