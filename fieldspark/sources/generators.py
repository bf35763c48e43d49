"""Synthetic fields: one row of a range a sample, or closed forms in SQL functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators import tensor


def gaussian_field(rng: np.random.Generator, dim: int, size: int, alpha: float = 2.0, tau: float = 3.0, sigma: float | None = None) -> np.ndarray:
    """A periodic Gaussian random field with spectrum sigma (4 pi^2 |k|^2 + tau^2)^(-alpha / 2) and mean 0."""
    if dim not in (1, 2, 3):
        raise ValueError("one to three dimensions")
    sigma = tau ** (0.5 * (2 * alpha - dim)) if sigma is None else sigma
    k = np.fft.fftfreq(size, 1 / size)
    k2 = sum(np.meshgrid(*[k * k] * dim, indexing="ij"))
    spectrum = size**dim * math.sqrt(2) * sigma * (4 * math.pi**2 * k2 + tau**2) ** (-alpha / 2)
    spectrum.flat[0] = 0
    noise = rng.standard_normal((size,) * dim) + 1j * rng.standard_normal((size,) * dim)
    return np.fft.ifftn(spectrum * noise).real


def navier_stokes(w: np.ndarray, forcing: np.ndarray, viscosity: float, until: float, dt: float, records: int) -> np.ndarray:
    """Vorticity on the unit torus: pseudo-spectral, Crank-Nicolson diffusion, products cut at two thirds."""
    n = w.shape[0]
    k = np.fft.fftfreq(n, 1 / n)
    kx, ky = np.meshgrid(k, k, indexing="ij")
    lap = 4 * math.pi**2 * (kx**2 + ky**2)
    inverse = np.where(lap == 0, 1.0, lap)
    keep = (np.abs(kx) <= 2 / 3 * (n // 2)) & (np.abs(ky) <= 2 / 3 * (n // 2))
    wh, fh = np.fft.fft2(w), np.fft.fft2(forcing)
    steps = math.ceil(until / dt)
    every, out = max(1, steps // records), []
    for j in range(1, steps + 1):
        psi = wh / inverse
        u, v = np.fft.ifft2(2j * math.pi * ky * psi).real, np.fft.ifft2(-2j * math.pi * kx * psi).real
        wx, wy = np.fft.ifft2(2j * math.pi * kx * wh).real, np.fft.ifft2(2j * math.pi * ky * wh).real
        flux = np.fft.fft2(u * wx + v * wy) * keep
        wh = (-dt * flux + dt * fh + (1 - 0.5 * dt * viscosity * lap) * wh) / (1 + 0.5 * dt * viscosity * lap)
        if j % every == 0 and len(out) < records:
            out.append(np.fft.ifft2(wh).real)
    return np.stack(out, axis=-1)


def field_samples(spark: SparkSession, samples: int, dim: int = 2, size: int = 32, seed: int = 0, **kw) -> DataFrame:
    """sample, cell, v of random fields, each from its own seed."""

    def run(batches):
        for t in batches:
            for i in t["id"]:
                x = gaussian_field(np.random.default_rng([seed, int(i)]), dim, size, **kw)
                yield pd.DataFrame({"sample": i, "cell": np.arange(x.size), "v": x.ravel()})

    return spark.range(samples).mapInPandas(run, "sample long, cell long, v double")


def navier_stokes_samples(spark: SparkSession, samples: int, size: int = 32, records: int = 10, until: float = 1.0, dt: float = 1e-2, viscosity: float = 1e-3, seed: int = 0) -> DataFrame:
    """sample, i0, i1, t, v of vorticity runs from random starts, forced by 0.1 (sin + cos)(2 pi (x + y))."""

    def run(batches):
        g = np.linspace(0, 1, size + 1)[:-1]
        s = 2 * math.pi * (g[:, None] + g[None, :])
        forcing = 0.1 * (np.sin(s) + np.cos(s))
        for t in batches:
            for i in t["id"]:
                start = gaussian_field(np.random.default_rng([seed, int(i)]), 2, size, 2.5, 7.0)
                x = navier_stokes(start, forcing, viscosity, until, dt, records)
                a, b, c = np.indices(x.shape)
                yield pd.DataFrame({"sample": i, "i0": a.ravel(), "i1": b.ravel(), "t": c.ravel(), "v": x.ravel()})

    return spark.range(samples).mapInPandas(run, "sample long, i0 int, i1 int, t int, v double")


def linear_field(spark: SparkSession, height: int, width: int) -> DataFrame:
    """x + 2 y on the unit square."""
    x = F.col("i1") / F.lit(float(width - 1))
    y = F.col("i0") / F.lit(float(height - 1))
    return tensor.grid(spark, {"i0": height, "i1": width}).withColumn("v", x + F.lit(2.0) * y)


def vortex(spark: SparkSession, height: int, width: int, steps: int) -> DataFrame:
    """A decaying rotating vortex: exp(-r^2 / .1) cos(angle + 2 pi t / T) exp(-t / T)."""
    x, y = F.col("i1") / F.lit(float(width - 1)) - 0.5, F.col("i0") / F.lit(float(height - 1)) - 0.5
    s = F.col("t") / F.lit(float(steps))
    v = F.exp(-(x * x + y * y) / F.lit(0.1)) * F.cos(F.atan2(y, x) + F.lit(2 * math.pi) * s) * F.exp(-s)
    return tensor.grid(spark, {"i0": height, "i1": width, "t": steps}).withColumn("v", v)


def cosine_factor(spark: SparkSession, rows: int, ranks: int) -> DataFrame:
    """The first columns of the orthonormal cosine basis as row, rank, u."""
    scale = F.when(F.col("rank") == 0, math.sqrt(1 / rows)).otherwise(math.sqrt(2 / rows))
    angle = F.lit(math.pi) * (F.col("row").cast("double") + 0.5) * F.col("rank").cast("double") / F.lit(float(rows))
    return tensor.grid(spark, {"row": rows, "rank": ranks}).withColumn("u", scale * F.cos(angle))
