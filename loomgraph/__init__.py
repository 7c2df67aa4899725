"""loomgraph: graph, text and history analytics written as Spark DataFrame plans."""
