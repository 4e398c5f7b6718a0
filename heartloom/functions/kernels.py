"""Arrow-backed column functions over the signal kernels; NaN results become NULL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from heartloom.functions import dsp
from heartloom.schemas import BAND_HZ


def _doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


RATE = _doubles("rppg_hr_bpm", "spectral_peak_fraction", "spectral_entropy", "rppg_signal_std")
BOTH = _doubles(*(f"{m}_{c}" for m in ("pos", "chrom") for c in RATE.names))
CONTACT = _doubles("time_hr_bpm", "frequency_hr_bpm")


#: Rates must be above this for the band to lie below half the rate.
LEAST_RATE = 2 * BAND_HZ[1]


def estimates(rates: np.ndarray, times: list[np.ndarray], colours: list[np.ndarray], methods: tuple[str, ...]) -> np.ndarray:
    """RATE (method, window, value) of windows by their rates, times and colours (sample, colour); NaN is none.

    Missing samples are filled linearly. Windows of one length and inner window are worked through together. There is no
    estimate of a window of too low a rate for the band.
    """
    out = np.full((len(methods), len(rates), len(RATE.names)), np.nan)
    groups: dict[tuple[int, int], list[int]] = {}
    filled: dict[int, np.ndarray] = {}
    for i, (rate, t, rgb) in enumerate(zip(rates.tolist(), times, colours, strict=True)):
        if not rate > LEAST_RATE:
            continue
        good = np.isfinite(rgb).all(axis=1)
        filled[i] = rgb if good.all() else np.column_stack([np.interp(t, t[good], rgb[good, c]) for c in range(3)])
        groups.setdefault((len(t), dsp.subwindow(rate)), []).append(i)
    for rows in groups.values():
        for at in range(0, len(rows), dsp.BATCH):
            some = rows[at : at + dsp.BATCH]
            rgb, fs = np.stack([filled[i] for i in some]), rates[some]
            for found, method in zip(out, methods, strict=True):
                found[some] = dsp.spectral_features(dsp.pulse(rgb, fs, method), fs)
    return out


def _of_columns(status: pd.Series, fs: pd.Series, t: pd.Series, colours: tuple[pd.Series, ...], methods: tuple[str, ...]) -> list[pd.DataFrame]:
    """A frame of RATE for each method; windows that aren't ok have no estimate."""
    rates = np.where(status == "ok", fs, np.nan).astype(float)
    ok = np.flatnonzero(rates > LEAST_RATE)
    rgb = [np.column_stack([np.asarray(c.iloc[i], float) for c in colours]) for i in ok]
    out = np.full((len(methods), len(rates), len(RATE.names)), np.nan)
    out[:, ok] = estimates(rates[ok], [np.asarray(t.iloc[i], float) for i in ok], rgb, methods)
    return [pd.DataFrame(x, columns=RATE.names) for x in out]


def _udf(method: str):  # noqa: ANN202
    @pandas_udf(RATE)
    def rate(status: pd.Series, fs: pd.Series, t: pd.Series, r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        return _of_columns(status, fs, t, (r, g, b), (method,))[0]

    return rate


pos_rate, chrom_rate = _udf("POS"), _udf("CHROM")


@pandas_udf(BOTH)
def both_rates(status: pd.Series, fs: pd.Series, t: pd.Series, r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Both methods' estimates from one transfer of the samples."""
    pos, chrom = _of_columns(status, fs, t, (r, g, b), ("POS", "CHROM"))
    return pd.concat([pos.add_prefix("pos_"), chrom.add_prefix("chrom_")], axis=1)


@pandas_udf(CONTACT)
def contact_rate(t: pd.Series, ppg: pd.Series) -> pd.DataFrame:
    arrays = lambda s: [np.asarray(a if a is not None else (), float) for a in s]
    return pd.DataFrame(dsp.contact_rates(arrays(t), arrays(ppg)), columns=CONTACT.names)


def register(spark: SparkSession) -> None:
    """Make the kernels usable from SQL."""
    for name, f in (("pos_rate", pos_rate), ("chrom_rate", chrom_rate), ("both_rates", both_rates), ("contact_rate", contact_rate)):
        spark.udf.register(name, f)
