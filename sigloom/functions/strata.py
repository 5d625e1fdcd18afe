"""Reporting strata of subjects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
PTSD = "ptsd"
SOMATOFORM = "somatoform"
AGEING = "control_ageing"
CONTROL_A = "control_A"
CONTROL_B = "control_B"
CONTROL_B_SUPPLEMENT = "control_B_supplement"
CONTROL_C = "control_C"
SPECIFICITY_STRATA = (AGEING, SOMATOFORM)


def stratum(case: Column, holdout: Column, other: Column, has_task: Column, family: Column) -> Column:
    """Case, then hold-out age, then the other disorder, then controls by export family and release."""
    control = F.concat(F.lit("control_"), family)
    return (
        F.when(case, PTSD)
        .when(holdout, AGEING)
        .when(other, SOMATOFORM)
        .when(~has_task, F.concat(control, F.lit("_supplement")))
        .otherwise(control)
    )
