"""Relational operators: documents, scaling, masks, splits, joins, matrix product, metrics."""

from featherloom.operators import documents, joins, masks, matmul, metrics, order, pairs, scaling, splits

__all__ = ["documents", "joins", "masks", "matmul", "metrics", "order", "pairs", "scaling", "splits"]
