"""Options and enumerations of the engine."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Frame(str, Enum):
    """How a stored response at a sample is carried to the query source."""

    IDENTITY = "identity"
    TRANSLATION = "translation"
    MEAN_TRANSLATION = "mean_translation"
    WHITENED_AFFINE = "whitened_affine"


class Scaling(str, Enum):
    """Scalar correction of a carried response."""

    NONE = "none"
    VOLUME = "volume"
    VOLUME_DET = "volume_det"


class Support(str, Enum):
    """Whether values beyond tau standard deviations of a response are zero."""

    NONE = "none"
    ELLIPSOID = "ellipsoid"


class SymmetricCombine(str, Enum):
    POOLED = "pooled"
    CRISSCROSS = "crisscross"


class RBFKernel(str, Enum):
    GAUSSIAN = "gaussian"
    MULTIQUADRIC = "multiquadric"
    INVERSE_MULTIQUADRIC = "inverse_multiquadric"
    LINEAR = "linear"
    THIN_PLATE_SPLINE = "thin_plate_spline"
    CUBIC = "cubic"


class CompressionMethod(str, Enum):
    AUTOMATIC = "automatic"
    DENSE_SVD = "dense_svd"
    ACA = "aca"


#: Lowest polynomial tail degree for which interpolation is solvable.
MIN_DEGREE = {RBFKernel.GAUSSIAN: -1, RBFKernel.INVERSE_MULTIQUADRIC: -1, RBFKernel.MULTIQUADRIC: 0, RBFKernel.LINEAR: 0, RBFKernel.THIN_PLATE_SPLINE: 1, RBFKernel.CUBIC: 1}


def rbf_min_degree(kernel: RBFKernel | str) -> int:
    return MIN_DEGREE[RBFKernel(kernel)]


def coerce(self, **kinds) -> None:
    """Let fields of a frozen dataclass be given as plain strings."""
    for name, kind in kinds.items():
        object.__setattr__(self, name, kind(getattr(self, name)))


@dataclass(frozen=True)
class EvalConfig:
    frame: Frame = Frame.MEAN_TRANSLATION
    scaling: Scaling = Scaling.VOLUME
    support: Support = Support.ELLIPSOID
    tau: float = 3.0
    num_neighbors: int = 10
    symmetric_combine: SymmetricCombine = SymmetricCombine.POOLED

    def __post_init__(self):
        coerce(self, frame=Frame, scaling=Scaling, support=Support, symmetric_combine=SymmetricCombine)

    @property
    def needs_mu(self) -> bool:
        return self.frame in (Frame.MEAN_TRANSLATION, Frame.WHITENED_AFFINE)

    @property
    def needs_w(self) -> bool:
        return self.frame is Frame.WHITENED_AFFINE or self.scaling is Scaling.VOLUME_DET

    @property
    def needs_v(self) -> bool:
        return self.scaling is not Scaling.NONE

    @property
    def needs_fields(self) -> bool:
        return self.needs_mu or self.needs_w or self.needs_v

    @property
    def gated(self) -> bool:
        return self.support is Support.ELLIPSOID


@dataclass(frozen=True)
class RBFScheme:
    kernel: RBFKernel = RBFKernel.GAUSSIAN
    shape: float = 3.0
    degree: int = 1
    smoothing: float = 0.0

    def __post_init__(self):
        coerce(self, kernel=RBFKernel)
        if not self.shape > 0:
            raise ValueError("RBFScheme: shape must be > 0")
        if not self.smoothing >= 0:
            raise ValueError("RBFScheme: smoothing must be >= 0")
        if self.degree not in (-1, 0, 1):
            raise ValueError("RBFScheme: degree must be -1, 0 or 1")
        if self.degree < MIN_DEGREE[self.kernel]:
            raise ValueError(f"RBFScheme: degree {self.degree} is below {MIN_DEGREE[self.kernel]}, the least of kernel {self.kernel.value}")


@dataclass(frozen=True)
class ACAOptions:
    max_rank: int = -1
    aca_safety_factor: float = 0.25
    recompress_safety_factor: float = 0.75
    required_consecutive_successes: int = 10
    recompress: bool = True
    seed: int = 0


@dataclass(frozen=True)
class RSVDOptions:
    oversampling: int = 10
    power_iterations: int = 1
    rtol: float = 0.0
    seed: int = 0


@dataclass(frozen=True)
class KernelLowRankOptions:
    method: CompressionMethod = CompressionMethod.AUTOMATIC
    max_rank: int = -1
    dense_min_dim: int = 128
    aca_safety_factor: float = 0.25
    recompress_safety_factor: float = 0.75
    required_consecutive_successes: int = 10
    seed: int = 0

    def __post_init__(self):
        coerce(self, method=CompressionMethod)

    def aca(self, shift: int = 0) -> ACAOptions:
        return ACAOptions(self.max_rank, self.aca_safety_factor, self.recompress_safety_factor, self.required_consecutive_successes, True, self.seed + shift)

    def uses_aca(self, rows: int, cols: int) -> bool:
        return self.method is CompressionMethod.ACA or self.method is CompressionMethod.AUTOMATIC and min(rows, cols) > self.dense_min_dim
