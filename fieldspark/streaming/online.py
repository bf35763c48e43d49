"""Reconstruction of fields from a stream of measurements, micro-batch by micro-batch."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.operators import sensing


def reconstruct(stream: DataFrame, tubes: DataFrame, sensors: DataFrame, gram: np.ndarray, keys: list[str], sink, cfg: K.Sensing = K.Sensing(), checkpoint: str | None = None):
    """Start a query over rows (keys..., cell, v): each micro-batch holds whole right-hand sides, which
    are solved and handed to ``sink(solutions, batch_id)``. The basis stays a static table."""
    rows = tubes.join(sensors.select("cell").distinct(), "cell", "left_semi").cache()

    def batch(measured: DataFrame, n: int) -> None:
        sides = sensing.right_sides(rows, measured.join(sensors.select("cell").distinct(), "cell", "left_semi"), keys)
        sink(sensing.solve(sides, gram, keys, cfg), n)

    writer = stream.writeStream.foreachBatch(batch)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def tracked(sides: DataFrame, key: str, gram: np.ndarray, cfg: K.Sensing = K.Sensing()) -> DataFrame:
    """A stream of right-hand sides (key, step, aty, yty, reset) to solutions (key, step, iterations, converged, x): each key's state stays
    between them, so a solve begins where the key's last one ended (``reset`` begins anew). Those of a key that come together
    are solved in the order of ``step``."""
    shared = sides.sparkSession.sparkContext.broadcast((gram, asdict(cfg)))
    kind = dict(sides.dtypes)[key]

    def run(at, parts, state):
        g, c = shared.value
        c = K.Sensing(**c)
        solver = K.Solver(g, c.solver, c.reg)
        now = K.State(*(np.asarray(x, float) for x in state.get[:2]), float(state.get[2]), list(state.get[3])) if state.exists else None
        for r in pd.concat(list(parts)).sort_values("step").itertuples():
            found = K.admm(g, np.asarray(r.aty, float), float(r.yty), c, None, solver, state=None if r.reset else now)
            now = found.state()
            now.history = now.history[-c.window :]  # what the stop policies look at
            yield pd.DataFrame({key: [at[0]], "step": [r.step], "iterations": [found.iterations], "converged": [found.converged], "x": [found.x.tolist()]})
        state.update((now.d.tolist(), now.p.tolist(), now.delta, now.history))

    return sides.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, step long, iterations int, converged boolean, x array<double>", "d array<double>, p array<double>, delta double, history array<double>", "append", "NoTimeout")


def activity(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Sums by user, kind and event-time window of a stream of events, late rows up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id", "event_type").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
