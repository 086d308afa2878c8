"""Readers and writers: triples, labels, vectors, matrices, models, samples."""

from featherloom.sources import matrices, models, samples, tables, vectors

__all__ = ["matrices", "models", "samples", "tables", "vectors"]
