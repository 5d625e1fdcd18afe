"""Causal filters over signals of any length, cut into pieces.

A recurrence is a chain of affine maps of its state. Every piece gives the state it would leave behind from rest, and the matrix that
carries an incoming state through it. The table of these, one small row a piece, is chained per signal; then each piece is filtered
once more from its true incoming state. Samples stay where they are: only states are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.session import checkpointed


def highpass_pieces(df: DataFrame, keys: Sequence[str], piece: str, value: str, sfreq: float, order: int, cutoff: float, name: str = "filtered") -> DataFrame:
    """Adds ``name``: the causal Butterworth high-pass of the signal that the pieces of a key form in the order of ``piece``."""
    if order == 0:
        return df.withColumn(name, F.col(value))
    keys = list(keys)
    flat = lambda state: np.concatenate([state.real, state.imag]).tolist()

    @F.pandas_udf("array<double>")
    def left(values: pd.Series) -> pd.Series:
        return pd.Series([flat(signal.highpass_from(np.asarray(v, dtype=float), sfreq, order, cutoff)[1]) for v in values])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, start, carried = pdf.sort_values(piece), np.zeros(order + 1, complex), [], {}
        for n, own in zip(pdf["_n"], pdf["_s"]):
            start.append(flat(state))
            if n not in carried:
                carried[n] = signal.highpass_transition(int(n), sfreq, order, cutoff)
            state = carried[n] @ state + np.asarray(own[: order + 1]) + 1j * np.asarray(own[order + 1 :])
        return pd.DataFrame({**{k: pdf[k] for k in keys}, piece: pdf[piece], "_start": start})

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for v, s in zip(values, start):
            state = np.asarray(s[: order + 1]) + 1j * np.asarray(s[order + 1 :])
            out.append(signal.highpass_from(np.asarray(v, dtype=float), sfreq, order, cutoff, state)[0])
        return pd.Series(out)

    kinds = dict(df.dtypes)
    states = df.select(*keys, piece, F.size(value).alias("_n"), left(F.col(value)).alias("_s"))
    schema = "".join(f"{k} {kinds[k]}, " for k in [*keys, piece]) + "_start array<double>"
    # one row of a few numbers a piece
    starts = checkpointed((states.groupBy(*keys) if keys else states.groupBy()).applyInPandas(chain, schema))
    return df.join(starts, [*keys, piece]).withColumn(name, run(F.col(value), F.col("_start"))).drop("_start")
