"""Image-reference extraction and querying over collections of web pages, on PySpark DataFrames."""
