"""The registered training procedures and their training tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import strata
from sigloom.operators import features, spectral
from sigloom.operators.nested import C_GRID, NEGATIVES, Candidate, Protocol

CORE = ("O1", "Fp1", "Fp2")
TEMPORAL = (*CORE, "T3", "T4")
ALPHA = ("rest_iaf_O1", "rest_alpha_peak_O1")
YOUNG_CONTROLS = (strata.CONTROL_A, strata.CONTROL_B, strata.CONTROL_B_SUPPLEMENT)


def _relative(prefix: str, bands: dict[str, tuple[float, float]], channels: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"{prefix}_{band}_{ch}" for band in bands for ch in channels)


def _sets_full() -> dict[str, tuple[str, ...]]:
    out = {}
    for name, channels in (("rest_O1Fp", CORE), ("rest_O1FpT", TEMPORAL)):
        base = (*_relative("rest_relpow", spectral.BANDS, channels), *ALPHA)
        out[name] = base
        out[f"{name}_exp"] = (*base, *(f"rest_exponent_{ch}" for ch in channels))
    return out


def _sets_20() -> dict[str, tuple[str, ...]]:
    base = (*_relative("rest_relpow20", spectral.BANDS_20, CORE), "rest_iaf20_O1", "rest_alpha_peak20_O1")
    return {"rest20": base, "rest20_slope": (*base, *(f"rest_slope20_{ch}" for ch in CORE))}


def _grid(names: tuple[str, ...], weights: tuple[float, ...] = (1.0,)) -> tuple[Candidate, ...]:
    return tuple(Candidate(c, n, f, w) for w in weights for f in names for n in NEGATIVES for c in C_GRID)


@dataclass(frozen=True)
class Registered:
    """A procedure together with the population it trains on."""

    procedure: Protocol
    include_ageing: bool = False
    include_rest_only: bool = True


_P2 = _sets_full()
_P7 = {k: (*v, "rest_faa") for k, v in _P2.items()}
_ALL_CONTROLS = (*YOUNG_CONTROLS, strata.CONTROL_C)
_UNCALIBRATED = {"calibrate": False, "calibration_balanced": False, "equal_error": False}
_P1 = Protocol(
    "protocol1", {"native": features.FEATURE_NAMES[:39], "requantized": tuple(f"rq_{n}" for n in features.FEATURE_NAMES[:39])}, _grid(("native", "requantized")),
    (*_ALL_CONTROLS, strata.AGEING), ((strata.SOMATOFORM,),), threshold_free=False, **_UNCALIBRATED,
)
_P6 = Protocol("protocol6", _P2, _grid(tuple(_P2)), _ALL_CONTROLS, calibration_balanced=False, equal_error=False)
PROTOCOLS: dict[str, Registered] = {
    "protocol1": Registered(_P1, include_rest_only=False),
    "protocol2": Registered(
        Protocol(
            "protocol2", _P2, _grid(tuple(_P2)), (*YOUNG_CONTROLS, strata.SOMATOFORM),
            ((strata.CONTROL_A,), (strata.CONTROL_B, strata.CONTROL_B_SUPPLEMENT), (strata.SOMATOFORM,)), threshold_free=False, **_UNCALIBRATED,
        )
    ),
    "protocol3": Registered(
        Protocol(
            "protocol3", _sets_20(), _grid(tuple(_sets_20())), YOUNG_CONTROLS, ((strata.AGEING,), (strata.SOMATOFORM,)), threshold_free=False,
            calibration_balanced=False, equal_error=False,
        ),
        include_ageing=True,
    ),
    "protocol6": Registered(_P6, include_ageing=True),
    "protocol7": Registered(replace(_P6, name="protocol7", feature_sets=_P7, calibration_balanced=True), include_ageing=True),
    "protocol8": Registered(
        replace(_P6, name="protocol8", feature_sets=_P7, candidates=_grid(tuple(_P7), (1.0, 3.0)), calibration_balanced=True, equal_error=True), include_ageing=True
    ),
}


# what a model of export settings alone sees
METADATA = ("meta_family_A", "meta_family_B", "meta_family_C", "meta_notch_share", "meta_share_125")


def export_descriptors(subjects: DataFrame) -> DataFrame:
    """Subjects with their export family as one flag a family, the share of notch-filtered files and of files at the target rate."""
    flags = {f"meta_family_{f}": F.coalesce((F.col("export_family") == f).cast("double"), F.lit(0.0)) for f in "ABC"}
    shares = {"meta_notch_share": F.coalesce("notch_share", F.lit(0.0)), "meta_share_125": F.coalesce("share_125", F.lit(0.0))}
    return subjects.withColumns(flags | shares)


def training_table(subjects: DataFrame, table: DataFrame, registered: Registered, requantized: DataFrame | None = None) -> DataFrame:
    """Rows for ``nested.nested_oof``: subjects of the population with their features, label, group and stratum."""
    keep = (~F.col("holdout") | F.lit(registered.include_ageing)) & (F.col("has_task_files") | F.lit(registered.include_rest_only))
    rows = export_descriptors(subjects.filter(keep)).join(table, "subject_key")
    if requantized is not None:
        rows = rows.join(requantized.select("subject_key", *[F.col(n).alias(f"rq_{n}") for n in features.FEATURE_NAMES]), "subject_key", "left")
    # subject keys are unique: their hash stands in for a row number
    return rows.select(
        F.xxhash64("subject_key").alias("row"), "subject_key", F.col("split_group").alias("grp"), F.col("label").alias("y"), "stratum", "export_family",
        F.col("age").cast("double").alias("age"), *METADATA, *registered.procedure.features,
    )
