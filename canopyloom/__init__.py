"""canopyloom: hierarchical, graph-assisted retrieval and corpus processing on PySpark."""
