"""Learning plans: networks, autoencoders, linear models, experiments."""

from featherloom.plans import (
    classifiers,
    denoise,
    estimator,
    experiments,
    feedforward,
    settings,
    sparse_ae,
    svm,
)

__all__ = [
    "classifiers",
    "denoise",
    "estimator",
    "experiments",
    "feedforward",
    "settings",
    "sparse_ae",
    "svm",
]
