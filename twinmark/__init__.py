"""twinmark: sentence-pair matching features as Spark jobs.

Layout
------
sources/    readers and writers (parquet tables, pair views, text pair files, feature matrices)
functions/  Column-expression builders (text cleaning, tokens, n-grams, distances, maths)
operators/  DataFrame jobs (pair features, corpus tables, matching joins, sampling, stacking)
plans/      the registered queries and their DuckDB oracle SQL
streaming/  the same stateless features over a streaming pair source
"""

__all__ = ["session"]
