"""Named queries over the driver tables, each with its SQL where SQL can say it."""

from featherloom.catalog import (  # noqa: F401
    denoising,
    documents,
    linear,
    matrices,
    networks,
    sparse_autoencoder,
    splits,
    storage,
    vectors,
)
from featherloom.catalog.registry import QUERIES, queries, sql

__all__ = ["QUERIES", "queries", "sql"]
