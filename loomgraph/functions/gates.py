"""Feasibility gates as ordered CASE expressions: the first rule that fails is the reason.

Reasons are plain strings (``REASONS``); null means that the candidate passes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.plans.options import SoftcorePolicy

#: All reasons for which a candidate is rejected.
REASONS = (
    "softcore_fragmented", "softcore_multiple_attachments", "softcore_too_large", "softcore_fraction_exceeded", "core_too_small", "no_common_core",
    "mcs_fraction_too_low", "net_charge_change", "core_geometry_mismatch", "repair_did_not_converge", "mapper_failed",
)


def precheck(core_heavy: Column, heavy_1: Column, heavy_2: Column, charge_1: Column, charge_2: Column, policy: SoftcorePolicy) -> Column:
    """Cheap rules before the repair: some core, enough of it, and (if asked) equal charges."""
    smaller = F.least(heavy_1, heavy_2)
    out = F.when(core_heavy == 0, "no_common_core").when((smaller > 0) & (core_heavy / smaller < policy.min_mcs_fraction), "mcs_fraction_too_low")
    if policy.charge_change_policy == "reject":
        out = out.when(charge_1 != charge_2, "net_charge_change")
    return out


def budget(all_soft: Column, core_heavy: Column, soft_1: Column, soft_2: Column, heavy_1: Column, heavy_2: Column, policy: SoftcorePolicy) -> Column:
    """Rules on the sizes of the changed regions, the most basic first. ``all_soft``: a side
    has nothing but changed atoms."""

    def over(soft: Column, heavy: Column) -> Column:
        return (heavy > 0) & (soft / heavy > policy.max_softcore_fraction)

    return (
        F.when(all_soft, "no_common_core")
        .when(core_heavy < policy.min_core_atoms, "core_too_small")
        .when(F.greatest(soft_1, soft_2) > policy.max_softcore_atoms, "softcore_too_large")
        .when(over(soft_1, heavy_1) | over(soft_2, heavy_2), "softcore_fraction_exceeded")
    )


def attachments(soft: Column, bonds: Column) -> Column:
    """Number of bonds (array of structs a, b) with exactly one end in the region."""
    return F.size(F.filter(bonds, lambda x: F.array_contains(soft, x["a"]) != F.array_contains(soft, x["b"])))


def attachment(soft_1: Column, bonds_1: Column, soft_2: Column, bonds_2: Column) -> Column:
    """A changed region hangs on the rest by exactly one bond."""
    bad = F.lit(False)
    for soft, bonds in ((soft_1, bonds_1), (soft_2, bonds_2)):
        bad = bad | ((F.size(soft) > 0) & (attachments(soft, bonds) != 1))
    return F.when(bad, "softcore_multiple_attachments")


def geometry(core_rmsd: Column, repair_reason: Column, policy: SoftcorePolicy) -> Column:
    """Judged only where the repair had nothing against the pair."""
    return F.when(repair_reason.isNull() & (core_rmsd > policy.core_rmsd_threshold), "core_geometry_mismatch")


def rejections(*reasons: Column) -> Column:
    """The reasons that hold, as an array without nulls."""
    return F.filter(F.array(*reasons), lambda x: x.isNotNull())
