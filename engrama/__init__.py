"""Memory-graph analytics as pure functions from DataFrames to DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (relational,
graph, search, fact and maintenance operators), ``sources`` (crawling,
snapshots, vector collections), ``plans`` (named queries and their SQL twins),
``streaming`` (file-change and maintenance streams).  Training-data operators
are kept in the optional sub-package ``llm``; nothing else imports it.
"""
