"""Filters, spectra and phases: a row per signal (or per sample for phases), kernels in Arrow batches.

The only shuffle is the one that gathers a signal's cells; a signal is one trial's channel, so rows stay small
and samples spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.functions import signal
from coordspark.operators.base import Transform
from coordspark.operators.select import remaining_freq_ranges

#: The bands in Hz.
BANDS = {"theta": (4, 8), "alpha": (8, 12), "beta": (12, 30), "low_gamma": (30, 55), "high_gamma": (65, 100)}


def signals(frame: LabeledFrame, time_dim: str) -> tuple[DataFrame, list[str]]:
    """``(other dims, their coordinates, times, values)``: a row per signal in order of time.

    Filters and spectra take samples at even steps, so signals that differ in length, or hold a null, are an error.
    """
    keys = frame.others(time_dim)
    held = [*keys, *frame.coords_of(*keys)]
    cell = F.array_sort(F.collect_list(F.struct(time_dim, VALUE)))
    steps = frame.cells.agg(F.count_distinct(time_dim).alias("_steps"))
    rows = frame.cells.groupBy(*held).agg(cell.alias("_s")).crossJoin(F.broadcast(steps))  # one number
    values = F.col(f"_s.{VALUE}")
    missing = (F.size("_s") != F.col("_steps")) | F.exists(values, lambda x: x.isNull())
    wrong = F.raise_error(F.lit(f"a signal lacks cells along {time_dim}")).cast("array<double>")
    return rows.select(*held, F.col(f"_s.{time_dim}").alias("times"), F.when(missing, wrong).otherwise(values).alias("values")), held


class Bandpass(Transform):
    """Butterworth band-pass along time, without phase shift unless ``causal``."""

    keeps_shape = True

    def __init__(self, lowcut: float, highcut: float, fs: float = 500, order: int = 4, causal: bool = False, time_dim: str = "time", **kw: Any):
        super().__init__(**kw)
        if highcut >= fs / 2:
            raise ValueError("highcut must be below half of fs")
        self.lowcut, self.highcut, self.fs, self.order, self.causal, self.time_dim = lowcut, highcut, fs, order, causal, time_dim

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        low, high, fs, order, causal = self.lowcut, self.highcut, self.fs, self.order, self.causal
        bandpass = signal.bandpass

        @F.pandas_udf("array<double>")
        def filtered(xs: pd.Series) -> pd.Series:
            out: list = [None] * len(xs)
            for n in set(xs.str.len()):
                at = [i for i, x in enumerate(xs) if len(x) == n]
                for i, y in zip(at, bandpass(np.array([xs.iloc[i] for i in at], float), low, high, fs, order, causal), strict=True):
                    out[i] = y
            return pd.Series(out)

        rows, held = signals(frame, self.time_dim)
        zipped = F.explode(F.arrays_zip("times", "out")).alias("_z")
        cells = rows.withColumn("out", filtered("values")).select(*held, zipped).select(*held, F.col("_z.times").alias(self.time_dim), F.col("_z.out").alias(VALUE))
        return frame.with_cells(cells)


class MultiTaper(Transform):
    """Multitaper power: tapers, then windows, then bands are averaged as asked (after the logarithm)."""

    def __init__(self, fs: float, time_halfbandwidth_product: float = 3.5, num_time_windows: int = 4, window_step_frac: float = 0.5, n_fft: int = 512, detrend: str | None = "constant", log_transform: bool = True, avg_over_tapers: bool = True, avg_over_time_windows: bool = False, avg_within_freq_bands: bool = False, freq_ranges: Mapping[str, tuple[float, float]] | None = None, time_dim: str = "time", **kw: Any):
        super().__init__(**kw)
        self.fs, self.time_halfbandwidth_product, self.num_time_windows, self.window_step_frac = fs, time_halfbandwidth_product, num_time_windows, window_step_frac
        self.n_fft, self.detrend, self.log_transform = n_fft, detrend, log_transform
        self.avg_over_tapers, self.avg_over_time_windows, self.avg_within_freq_bands = avg_over_tapers, avg_over_time_windows, avg_within_freq_bands
        self.freq_ranges, self.time_dim = freq_ranges, time_dim

    def added_dims(self) -> list[tuple[str, str]]:
        return [("freq_band", "string") if self.avg_within_freq_bands else ("frequency", "double"), *([] if self.avg_over_time_windows else [("time_window", "double")]), *([] if self.avg_over_tapers else [("taper", "int")])]

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        return (*(d for d in dims if d != self.time_dim), *(n for n, _ in self.added_dims()))

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        rows, held = signals(frame, self.time_dim)
        p = self.get_params()
        ranges, added = dict(self.freq_ranges or BANDS), [n for n, _ in self.added_dims()]
        multitaper, band_means = signal.multitaper, signal.band_means

        def spectra(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for n, g in f.groupby(f["values"].str.len()):
                    if not n:
                        continue
                    power, freqs, centres = multitaper(np.array(g["values"].tolist(), float), p["fs"], p["time_halfbandwidth_product"], p["num_time_windows"], p["window_step_frac"], p["n_fft"], p["detrend"], p["log_transform"])
                    axes: list[tuple[str, Any]] = [("time_window", None), ("taper", np.arange(power.shape[2])), ("frequency", freqs)]
                    if p["avg_over_tapers"]:
                        power, axes = power.mean(axis=2), [axes[0], axes[2]]
                    if p["avg_over_time_windows"]:
                        power, axes = power.mean(axis=1), axes[1:]
                    if p["avg_within_freq_bands"]:
                        power, names = band_means(power, freqs, ranges)
                        axes[-1] = ("freq_band", np.array(names, object))
                    power = power.astype(np.float32).astype(float)
                    for i in range(len(g)):
                        row = g.iloc[i]
                        at = np.minimum(centres.astype(int), n - 1)
                        labels = [np.asarray(row["times"], float)[at] if name == "time_window" else x for name, x in axes]
                        grid = np.meshgrid(*labels, indexing="ij")
                        out = {h: [row[h]] * power[i].size for h in held} | {name: m.ravel() for (name, _), m in zip(axes, grid, strict=True)} | {VALUE: power[i].ravel()}
                        yield pd.DataFrame(out)[[*held, *added, VALUE]]

        kinds = ", ".join([*(f"`{h}` {rows.schema[h].dataType.simpleString()}" for h in held), *(f"{n} {t}" for n, t in self.added_dims()), f"{VALUE} double"])
        dims = self.output_dims(frame.dims)
        return frame.with_cells(rows.mapInPandas(spectra, kinds), dims)


class HilbertPhase(Transform):
    """Instantaneous phase per band: at time points, or against the channels' circular mean over a window.

    ``timepoints``: the phase at the samples nearest to start, start + step, ... end (dim ``time``).
    ``relative_average``: the mean of the wrapped difference over [start, end]; an empty window gives null.
    """

    def __init__(self, fs: float, mode: str = "timepoints", step_ms: float = 100, start_ms: float | None = None, end_ms: float | None = None, remove_low: int = 0, remove_high: int = 1, pad_ms: float = 0, channel_dim: str = "channel", time_dim: str = "time", bands: Mapping[str, tuple[float, float]] | None = None, order: int = 4, **kw: Any):
        super().__init__(**kw)
        if mode not in ("timepoints", "relative_average"):
            raise ValueError(f"unknown mode {mode!r}")
        self.fs, self.mode, self.step_ms, self.start_ms, self.end_ms = fs, mode, step_ms, start_ms, end_ms
        self.remove_low, self.remove_high, self.pad_ms, self.channel_dim, self.time_dim, self.bands, self.order = remove_low, remove_high, pad_ms, channel_dim, time_dim, bands, order
        for name, (_, high) in self.used_bands().items():
            if high >= fs / 2:
                raise ValueError(f"band {name} reaches half of fs")

    def used_bands(self) -> dict[str, tuple[float, float]]:
        return remaining_freq_ranges(remaining_freq_ranges(self.bands or BANDS, self.remove_high), self.remove_low, remove_high=False)

    def output_dims(self, dims: tuple[str, ...]) -> tuple[str, ...]:
        rest = tuple(d for d in dims if d != self.time_dim)
        return (*rest, "freq_band", *([self.time_dim] if self.mode == "timepoints" else []))

    def _transform(self, frame: LabeledFrame) -> LabeledFrame:
        keys = [d for d in frame.others(self.channel_dim) if d != self.time_dim]
        held = [*keys, *frame.coords_of(*keys)]
        rows, _ = signals(frame, self.time_dim)
        grouped = rows.groupBy(*held).agg(F.array_sort(F.collect_list(F.struct(self.channel_dim, "times", "values"))).alias("s")).select(*held, F.col(f"s.{self.channel_dim}").alias("channels"), F.col("s.times").getItem(0).alias("times"), F.col("s.values").alias("x"))
        fs, bands, order, mode, pad = self.fs, self.used_bands(), self.order, self.mode, int(self.pad_ms * self.fs / 1000)
        start, end, step, channel, time = self.start_ms, self.end_ms, self.step_ms, self.channel_dim, self.time_dim
        bandpass, analytic, relative, nearest = signal.bandpass, signal.analytic, signal.relative_phase, signal.nearest
        columns = [*held, channel, "freq_band", *([time] if mode == "timepoints" else []), VALUE]

        def phases(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for _, r in f.iterrows():
                    x, times = np.array(r["x"].tolist(), float), np.asarray(r["times"], float)
                    wide = np.pad(x, ((0, 0), (pad, pad)), mode="reflect") if pad else x
                    lo, hi = times[0] if start is None else start, times[-1] if end is None else end
                    for name, (low, high) in bands.items():
                        phase = np.angle(analytic(bandpass(wide, low, high, fs, order)))
                        phase = phase[:, pad : phase.shape[1] - pad] if pad else phase
                        same = {h: r[h] for h in held} | {"freq_band": name}
                        if mode == "timepoints":
                            at = nearest(times, np.arange(lo, hi + step / 1e6, step))
                            for ch, row in zip(r["channels"], phase, strict=True):
                                yield pd.DataFrame({**same, channel: ch, time: times[at], VALUE: row[at]})[columns]
                        else:
                            inside = (times >= lo) & (times <= hi)
                            mean = relative(phase)[:, inside].mean(axis=1) if inside.any() else [None] * len(phase)
                            yield pd.DataFrame({**{k: [v] * len(phase) for k, v in same.items()}, channel: list(r["channels"]), VALUE: mean})[columns]

        types = {c: frame.cells.schema[c].dataType.simpleString() for c in (*held, channel)} | {"freq_band": "string", time: "double", VALUE: "double"}
        out = grouped.mapInPandas(phases, ", ".join(f"`{c}` {types[c]}" for c in columns))
        return frame.with_cells(out, self.output_dims(frame.dims))
