"""Column functions: activations, vector algebra, seeded draws, test functions."""

from featherloom.functions import activations, seeded, surfaces, vectors

__all__ = ["activations", "seeded", "surfaces", "vectors"]
