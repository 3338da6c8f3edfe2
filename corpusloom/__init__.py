"""Spark-native analytics over collections of source repositories and documents.

Every operator is a function from DataFrames to a DataFrame; ``repo_id`` is an ordinary column, so
one job works on all repositories at once.
"""
