"""Edge costs as column expressions over descriptor columns.

Each scorer is a function from named descriptors to one Column, so costs are computed in a
projection next to the candidates and changing a scorer never maps a pair again. A missing
descriptor counts as zero, a rejected candidate has a null cost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Term of the linear cost, its descriptor, divisor, cap and default weight.
LINEAR_TERMS = (
    ("softcore_atoms", "n_softcore_max_heavy", 8.0, 8.0, 1.00),
    ("softcore_asymmetry", "softcore_asymmetry", 8.0, 4.0, 0.25),
    ("heavy_atom_delta", "heavy_atom_delta", 8.0, 4.0, 0.25),
    ("charge_delta", "charge_delta", 1.0, 2.0, 4.00),
    ("ring_delta", "ring_delta", 1.0, 3.0, 1.00),
    ("ring_atoms_in_softcore", "n_ring_atoms_in_softcore", 6.0, 4.0, 0.50),
    ("mcs_deficit", "mcs_fraction", 1.0, 1.0, 2.00),
    ("core_rmsd", "core_rmsd", 1.0, 3.0, 1.00),
    ("rotatable_delta", "rotatable_delta", 3.0, 3.0, 0.20),
    ("repair_cost", "n_demoted_atoms", 6.0, 4.0, 0.75),
    ("logp_delta", "logp_delta", 2.0, 3.0, 0.10),
)
#: Factors of the multiplicative cost, and the least similarity.
LOMAP_FACTORS = {"beta": 0.10, "charge_penalty": 0.10, "ring_penalty": 0.40, "ring_atom_penalty": 0.90, "rmsd_penalty": 0.70}
LEAST_SIMILARITY = 1e-9
#: Weights of the predicted standard deviation.
VARIANCE_WEIGHTS = {"intercept": 1.0, "softcore_heavy": 1.0, "total_heavy": 0.5}

Descriptors = Mapping[str, Column]


def _merged(defaults: Mapping[str, float], given: Mapping[str, float] | None, what: str) -> dict[str, float]:
    unknown = sorted(set(given or ()) - set(defaults))
    if unknown:
        raise ValueError(f"unknown {what} {unknown}; there are {sorted(defaults)}")
    return {**defaults, **{k: float(v) for k, v in (given or {}).items()}}


def _value(d: Descriptors, name: str) -> Column:
    return F.coalesce(d[name].cast("double"), F.lit(0.0)) if name in d else F.lit(0.0)


def linear_contributions(d: Descriptors, weights: Mapping[str, float] | None = None) -> dict[str, Column]:
    """Weighted, clipped terms; terms of weight zero are left out."""
    chosen = _merged({t: w for t, *_, w in LINEAR_TERMS}, weights, "terms")
    out = {}
    for term, descriptor, divisor, cap, _ in LINEAR_TERMS:
        if chosen[term]:
            x = _value(d, descriptor)
            x = 1.0 - x if term == "mcs_deficit" else x / divisor
            out[term] = F.least(F.greatest(x, F.lit(0.0)), F.lit(cap)) * chosen[term]
    return out


def _sum(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total


def linear(d: Descriptors, weights: Mapping[str, float] | None = None) -> Column:
    return _sum(list(linear_contributions(d, weights).values()))


def _lomap_logs(d: Descriptors, factors: Mapping[str, float] | None) -> dict[str, Column]:
    f = _merged(LOMAP_FACTORS, factors, "factors")
    logs = {"softcore": _value(d, "n_softcore_max_heavy") * f["beta"]}
    for name, factor, descriptor in (("charge", "charge_penalty", "charge_delta"), ("ring", "ring_penalty", "ring_delta"), ("ring_atoms", "ring_atom_penalty", "n_ring_atoms_in_softcore"), ("geometry", "rmsd_penalty", "core_rmsd")):
        logs[name] = _value(d, descriptor) * -math.log(f[factor])
    return logs


def lomaplike(d: Descriptors, factors: Mapping[str, float] | None = None) -> Column:
    """Minus the log of a product of penalties: a sum of logs, cut at the least similarity."""
    return F.least(_sum(list(_lomap_logs(d, factors).values())), F.lit(-math.log(LEAST_SIMILARITY)))


def lomaplike_contributions(d: Descriptors, factors: Mapping[str, float] | None = None) -> dict[str, Column]:
    """Each factor's share, scaled so that the shares add up to the total."""
    most = F.lit(-math.log(LEAST_SIMILARITY))
    parts = {k: F.least(v, most) for k, v in _lomap_logs(d, factors).items()}
    whole = _sum(list(parts.values()))
    return {k: F.when(whole > 0, v * lomaplike(d, factors) / whole).otherwise(v) for k, v in parts.items()}


def softcore_size(d: Descriptors) -> Column:
    return _value(d, "n_softcore_max_heavy")


def variance(d: Descriptors, weights: Mapping[str, float] | None = None) -> Column:
    """Predicted standard deviation of an edge; weights may not be negative."""
    w = _merged(VARIANCE_WEIGHTS, weights, "weights")
    if bad := sorted(k for k, v in w.items() if v < 0):
        raise ValueError(f"negative weights {bad}: a standard deviation must stay positive")
    soft = F.greatest(_value(d, "n_softcore_max_heavy"), F.lit(0.0))
    heavy = F.greatest(_value(d, "n_heavy_1"), _value(d, "n_heavy_2"), F.lit(0.0))
    return w["intercept"] + w["softcore_heavy"] * F.sqrt(soft) + w["total_heavy"] * F.sqrt(heavy)


SCORERS: dict[str, Callable[..., Column]] = {"linear": linear, "lomaplike": lomaplike, "softcore-size": softcore_size, "variance": variance}


def score(d: Descriptors, rejections: Column, scorer: str = "linear", weights: Mapping[str, float] | None = None) -> Column:
    """Struct (total, feasible, scorer) of a candidate with its array of rejections."""
    fine = F.size(F.coalesce(rejections, F.array().cast("array<string>"))) == 0
    total = SCORERS[scorer](d) if scorer == "softcore-size" else SCORERS[scorer](d, weights)
    return F.struct(F.when(fine, total).alias("total"), fine.alias("feasible"), F.lit(scorer).alias("scorer"))
