"""Corpus operators for training-data pipelines.

Every operator takes DataFrames and returns a DataFrame.  Nothing outside
this subpackage imports it; the queries that apply the operators to the
stock tables live in ``trajspark.llm.queries``.
"""
