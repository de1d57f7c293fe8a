"""Thresholds that follow a stream: each store's last samples as keyed state, settled at every 200th entry or exit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import calibration
from ..schema import ENTRY, EXIT

#: Parameters that samples of the log set, with their rules.
RULES = {"reid_confidence_threshold": calibration.REID, "queue_join_dwell_sec": calibration.QUEUE, "dwell_threshold_ms": calibration.DWELL}
OUTPUT = "store_id string, parameter string, calibrations long, seq long, value double, observations long"


def kth_smallest(samples: list[float], rule: tuple) -> float | None:
    """``calibration.order_statistic`` of the samples; nothing where they are too few."""
    _, _, _, _, least, quantile, _ = rule
    return sorted(samples)[max(1, int(quantile * len(samples))) - 1] if len(samples) >= least else None


class Ring(StatefulProcessor):
    """The newest samples of one parameter of a store, and how many entries and exits the store has had."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("ring", "seen long, samples array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, samples = self.held.get() if self.held.exists() else (0, [])
        samples, rule = list(samples), RULES[key[1]]
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        told = None
        for seq, x, counts in zip(batch["seq"], batch["x"], batch["counts"]):
            if x == x and x is not None:
                samples.append(float(x))
                if len(samples) >= 2 * rule[3]:
                    del samples[: -rule[3]]
            seen += bool(counts)
            if counts and seen % self.every == 0:
                newest = samples[-rule[3] :]
                told = (key[0], key[1], seen // self.every, int(seq), kth_smallest(newest, rule), len(newest))
        self.held.update((seen, samples[-rule[3] :]))
        if told:
            yield pd.DataFrame([told], columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"value": "float64"})

    def close(self) -> None:
        pass


def threshold_updates(events: DataFrame, every: int = calibration.EVERY) -> DataFrame:
    """(store_id, parameter, calibrations, seq, value, observations): a parameter's order statistic at the newest recalibration of each micro-batch.

    ``events`` is a stream of the log whose batches follow each other in order of arrival. A store's parameters are keys of their own; each holds
    its rule's number of samples. Rows without an id of a store are left out. Needs the state store named by ``passports.PROVIDER``.
    """
    inputs = calibration.threshold_samples(F.col("event_type"))
    samples = F.array(*[F.struct(F.lit(n).alias("parameter"), inputs[n].cast("double").alias("x")) for n in RULES])
    counts = F.col("event_type").isin(ENTRY, EXIT)
    rows = events.filter("store_id is not null").select("store_id", F.col("arrival_seq").alias("seq"), counts.alias("counts"), F.explode(samples).alias("s")).select("store_id", "s.parameter", "seq", "s.x", "counts")
    return rows.filter(F.col("counts") | F.col("x").isNotNull()).groupBy("store_id", "parameter").transformWithStateInPandas(Ring(every), OUTPUT, "Update", "None")


def latest_thresholds(updates: DataFrame, stores: DataFrame) -> DataFrame:
    """``calibration.store_thresholds`` out of the stored updates, for ``stores(store_id)``; defaults where a store has not recalibrated."""
    newest = updates.groupBy("store_id", "parameter").agg(F.max_by(F.struct("calibrations", "value"), "seq").alias("u"))
    by = newest.groupBy("store_id").agg(F.max("u.calibrations").alias("calibrations"), *[F.max(F.when(F.col("parameter") == n, F.col("u.value"))).alias(n) for n in RULES])
    known = stores.select("store_id").distinct().join(by, "store_id", "left")
    settled = {n: calibration.setting(F.col(n), rule) for n, rule in RULES.items()}
    return known.withColumns({**settled, "calibrations": F.coalesce("calibrations", F.lit(0)), "staff_confidence_threshold": F.lit(calibration.STAFF[0])})
