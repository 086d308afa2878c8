"""Validated hyper-parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class NetworkSettings:
    """Feed-forward network; change a copy with ``with_(name=value)``."""

    sizes: tuple[int, ...] = (10, 5, 1)
    activation: str = "sigm"
    output: str = "linear"
    learning_rate: float = 2.0
    momentum: float = 0.5
    rate_scaling: float = 1.0
    l2: float = 0.0
    sparsity_penalty: float = 0.0
    sparsity_target: float = 0.05
    input_mask: float = 0.0
    dropout: float = 0.0
    l2_on_gradient: bool = False
    activation_gain: float = 0.01
    activation_decay: float = 0.09
    dtype: str = "float64"
    seed: int = 42

    def __post_init__(self) -> None:
        _require(len(self.sizes) >= 2 and min(self.sizes) >= 1, "sizes needs two or more positive entries")
        _require(self.activation in ("sigm", "tanh_opt"), f"unknown activation {self.activation!r}")
        _require(self.output in ("sigm", "linear", "softmax"), f"unknown output {self.output!r}")
        for name in ("learning_rate", "momentum", "rate_scaling", "l2", "sparsity_penalty"):
            _require(getattr(self, name) >= 0, f"{name} must not be negative")
        _require(0 < self.sparsity_target < 1, "sparsity_target must lie in (0, 1)")
        _require(0 <= self.input_mask <= 1, "input_mask must lie in [0, 1]")
        _require(0 <= self.dropout < 1, "dropout must lie in [0, 1)")
        _require(self.dtype in ("float32", "float64"), "dtype must be float32 or float64")

    def with_(self, **changes) -> NetworkSettings:
        return replace(self, **changes)


@dataclass(frozen=True)
class SparseAutoencoderSettings:
    """Autoencoder on sparse documents.

    ``decay_in``/``decay_out`` multiply twice the weight of every touched column;
    ``decay_bias`` multiplies twice the hidden bias, and the output bias once.
    """

    hidden: int = 10
    learning_rate: float = 0.1
    iterations: int = 10
    decay_in: float = 1.0
    decay_out: float = 1.0
    decay_bias: float = 1.0
    weight_low: float = -0.5
    weight_high: float = 0.5
    seed: int = 42

    def __post_init__(self) -> None:
        _require(self.hidden >= 1, "hidden must be at least 1")
        _require(self.iterations >= 1, "iterations must be at least 1")
        _require(self.learning_rate >= 0, "learning_rate must not be negative")
        _require(min(self.decay_in, self.decay_out, self.decay_bias) >= 0, "decay must not be negative")
        _require(self.weight_low < self.weight_high, "weight_low must be below weight_high")

    def with_(self, **changes) -> SparseAutoencoderSettings:
        return replace(self, **changes)


@dataclass(frozen=True)
class SvmSettings:
    """Linear SVM by gradient descent on the hinge loss."""

    iterations: int = 100
    step: float = 1.0
    reg: float = 0.01
    fraction: float = 1.0
    tolerance: float = 0.001
    seed: int = 42

    def __post_init__(self) -> None:
        _require(self.iterations >= 1, "iterations must be at least 1")
        _require(self.step > 0, "step must be positive")
        _require(self.reg >= 0, "reg must not be negative")
        _require(0 < self.fraction <= 1, "fraction must lie in (0, 1]")
        _require(self.tolerance >= 0, "tolerance must not be negative")

    def with_(self, **changes) -> SvmSettings:
        return replace(self, **changes)


@dataclass(frozen=True)
class DenoiseSettings:
    """Denoising autoencoder with tied weights."""

    hidden: int = 5
    learning_rate: float = 0.1
    corruption: float = 0.3
    epochs: int = 100
    seed: int = 42

    def __post_init__(self) -> None:
        _require(self.hidden >= 1, "hidden must be at least 1")
        _require(self.epochs >= 1, "epochs must be at least 1")
        _require(self.learning_rate >= 0, "learning_rate must not be negative")
        _require(0 <= self.corruption <= 1, "corruption must lie in [0, 1]")

    def with_(self, **changes) -> DenoiseSettings:
        return replace(self, **changes)
