"""featherloom: feature learning and sparse matrix analytics on Spark DataFrames.

Sparse word/document tables, dense vector tables and sparse matrices are plain
DataFrames; every operator is a function from DataFrame to DataFrame (or a small
estimator around such functions), so Catalyst plans the whole query.
"""

from featherloom import functions, operators, plans, sources, streaming

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
__version__ = "0.1.0"
