"""labelforge: corpus labelling and label evaluation on Spark.

- ``functions``: column expressions (Python text semantics, score/label codecs)
- ``operators``: DataFrame operators (quality, corpus, sampling, joins,
  reshape, metrics, agreement, inference, ml)
- ``sources``: table readers, file sources/sinks, derived fixture views
- ``streaming``: Structured Streaming jobs
- ``plans``: the named queries (Spark builder + DuckDB oracle SQL)
"""

__version__ = "0.1.0"
