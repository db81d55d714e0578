"""quire: document-collection analytics on PySpark DataFrames."""
