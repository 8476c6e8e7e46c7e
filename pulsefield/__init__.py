"""Spark-first evaluation and compression of spatially varying integral kernels.

The public names load on first use, so that importing the package starts nothing.
"""

from importlib import import_module

_PLACES = {
    "pulsefield.config": "ACAOptions CompressionMethod EvalConfig Frame KernelLowRankOptions RBFKernel RBFScheme RSVDOptions Scaling Support SymmetricCombine rbf_min_degree",
    "pulsefield.functions.spd": "clamp_spd",
    "pulsefield.functions.rbf": "rbf_functional rbf_interpolate",
    "pulsefield.functions.lowrank": "ACAResult LowRank aca randomized_svd recompress truncated_svd",
    "pulsefield.operators.mesh": "Mesh mesh_of unit_cube unit_grid unit_interval",
    "pulsefield.operators.field": "ImpulseResponseField",
    "pulsefield.operators.predictions": "predictions predictions_over_targets support_ellipsoids",
    "pulsefield.operators.kernel": "KernelEvaluator",
    "pulsefield.operators.partition": "block_target_sets recursive_bisection_partition",
    "pulsefield.operators.blocks": "Block BlockBuildInfo BlockLowRank BlockLowRankBuildResult KernelLowRankResult block_low_rank block_low_rank_result kernel_low_rank kernel_low_rank_result randomized_svd_blocks",
}
_WHERE = {name: place for place, names in _PLACES.items() for name in names.split()}
__all__ = sorted(_WHERE)
__version__ = "0.1.0"


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(_WHERE[name]), name)
    raise AttributeError(name)
