"""Evidence retrieval and text processing on PySpark DataFrames."""
