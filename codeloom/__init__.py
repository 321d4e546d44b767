"""codeloom: code-graph analytics on Spark.

``sources`` reads tables and text, ``functions`` holds column expressions,
``operators`` the relational and graph operators, ``plans`` the named queries
with their SQL twins, ``streaming`` the incremental extension and ``llm`` the
training-data operators, which nothing else here imports.
"""
