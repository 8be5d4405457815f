"""quillgraph: document, knowledge-graph and note analytics on PySpark DataFrames."""

__version__ = "0.1.0"
