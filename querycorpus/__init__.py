"""Query-corpus analytics on Spark.

Data work around natural-language querying of databases, written as DataFrame
transformations: every operator takes DataFrames and returns a DataFrame.
"""
