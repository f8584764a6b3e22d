"""Lexical search and pack building on Apache Spark.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to DataFrame), ``sources``
(dump readers), ``streaming``, ``plans`` (registered queries and their SQL twins) and ``llm`` (operators for
training-data pipelines; nothing outside ``llm`` imports it).
"""
