"""The questions a store asks, as one object over an event log and its transactions."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import cached_property
from typing import ClassVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import shared_folder
from .operators import audit, calibration, correlation, ingest, projections, sessions, verifier
from .sources.event_store import EventStore

PERIOD_US = 86_400_000_000


class StoreNotFound(LookupError):
    pass


class VisitorNotFound(LookupError):
    pass


class ReplayRunning(RuntimeError):
    """A replay of the same source is still under way."""


@dataclass
class ReplayResult:
    """What a replay took in; ``progress`` can be read while it runs, from another thread.

    Until the counts are known ``pct`` is the share of finished tasks among those that Spark has begun or planned for the replay.
    """

    source: str
    total: int = 0
    accepted: int = 0
    duplicates: int = 0
    rejected: int = 0
    elapsed_sec: float = 0.0
    running: bool = True
    begun: float = field(default_factory=time.monotonic, repr=False)
    group: str = field(default_factory=lambda: f"replay-{uuid.uuid4().hex}", repr=False)

    def done(self, counts: dict[str, int]) -> ReplayResult:
        self.accepted, self.duplicates, self.rejected = counts["accepted"], counts["duplicate"], counts["rejected"]
        self.total, self.running = sum(counts.values()), False
        self.elapsed_sec = round(time.monotonic() - self.begun, 3)
        return self

    def tasks(self, spark: SparkSession) -> tuple[int, int]:
        """(finished, known) tasks of the replay's jobs."""
        tracker, ended, known = spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            told = tracker.getJobInfo(job)
            for stage in told.stageIds if told else []:
                info = tracker.getStageInfo(stage)
                if info:
                    ended, known = ended + info.numCompletedTasks, known + info.numTasks
        return ended, known

    def progress(self) -> dict:
        replayed = self.accepted + self.duplicates + self.rejected
        pct = 100 * replayed / max(1, self.total)
        spark = SparkSession.getActiveSession() or SparkSession._instantiatedSession
        if self.running and spark is not None:
            ended, known = self.tasks(spark)
            pct = min(99.9, 100 * ended / max(1, known))
        return {"is_replaying": self.running, "replayed": replayed, "total": self.total, "pct": round(pct, 1)}

    def to_dict(self) -> dict:
        return {k: getattr(self, k) for k in ("source", "total", "accepted", "duplicates", "rejected", "elapsed_sec")}


class StoreAnalytics:
    """Answers are lazy DataFrames; ``as_of_us`` stands for the clock, so that answers can be repeated.

    Sessions are worked out once per object and kept in memory or on disk as far as they are used, until ``close``.
    """

    _replays: ClassVar[dict[str, ReplayResult]] = {}

    def __init__(self, events: DataFrame, pos: DataFrame, as_of_us: int, replayed: ReplayResult | None = None, log: EventStore | None = None):
        self.events, self.pos, self.as_of_us, self.replayed, self.log = ingest.log_columns(events), pos, as_of_us, replayed, log

    def __enter__(self) -> StoreAnalytics:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Gives back what the sessions hold."""
        if "sessions" in self.__dict__:
            self.__dict__.pop("sessions").unpersist()

    @classmethod
    def replay(cls, spark: SparkSession, path: str, pos: DataFrame, as_of_us: int, store_id: str | None = None, folder: str | None = None) -> StoreAnalytics:
        """A fresh state out of a JSONL log, sorted by time; ``replayed`` tells how many lines were taken.

        The log is written once to an ``EventStore`` in ``folder``, a new one (by default one that goes with the driver), which later
        batches are added to. A path without files raises FileNotFoundError, one that is being replayed ReplayRunning.
        """
        running = cls._replays.get(path)
        if running is not None and running.running:
            raise ReplayRunning(path)
        result = cls._replays[path] = ReplayResult(path)
        context = spark.sparkContext
        before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")
        context.setJobGroup(result.group, f"replay of {path}")
        try:
            log = EventStore(spark, folder or shared_folder(spark))
            if log.last() is not None:
                raise ValueError(f"{folder} holds a log already")
            result.done(log.replay(path, as_of_us, store_id).counts())
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                raise FileNotFoundError(path) from e
            raise
        finally:
            result.running = False
            for name, value in zip(("spark.jobGroup.id", "spark.job.description"), before):
                context.setLocalProperty(name, value)
        return cls(log.events(), pos, as_of_us, result, log)

    @classmethod
    def stored(cls, spark: SparkSession, folder: str, pos: DataFrame, as_of_us: int) -> StoreAnalytics:
        """The state of a log that an earlier run has left in ``folder``."""
        log = EventStore(spark, folder)
        return cls(log.events(), pos, as_of_us, None, log)

    @classmethod
    def progress(cls, path: str) -> dict:
        """How far the replay of a path is."""
        found = cls._replays.get(path)
        return found.progress() if found else {"is_replaying": False, "replayed": 0, "total": 0, "pct": 0.0}

    def ingest(self, raw: DataFrame) -> tuple[StoreAnalytics, DataFrame, DataFrame]:
        """(state with the batch, rejected, summary) for ``raw(arrival_seq, value)`` of 1 to 500 lines.

        The batch arrives after all that is stored, whatever its own numbers begin with. With a stored log it is appended there and
        asks only for its own ids; a log that is a plain table is read through for them, and the new state is the union.
        """
        if self.log is not None:
            commit = self.log.append(raw, self.as_of_us)
            summary = raw.sparkSession.createDataFrame([tuple(commit.counts().values())], "accepted long, duplicate long, rejected long")
            return StoreAnalytics(self.log.events(), self.pos, self.as_of_us, self.replayed, self.log), self.log.rejected(commit.batch), summary
        ingest.batch_size(raw)
        checked = ingest.with_status(ingest.validate(raw, self.as_of_us), self.events, bounded=True)
        last = self.events.agg(F.coalesce(F.max("arrival_seq") + 1, F.lit(0)).alias("n")).first().n
        least = raw.agg(F.coalesce(F.min("arrival_seq"), F.lit(0)).alias("n")).first().n
        placed = ingest.log_columns(checked.filter("status = 'accepted'").withColumn("arrival_seq", F.col("arrival_seq") + F.lit(last - least).cast("long")))
        return StoreAnalytics(self.events.unionByName(placed), self.pos, self.as_of_us), ingest.rejected(checked), ingest.summary(checked)

    @cached_property
    def numbered(self) -> DataFrame:
        return sessions.number_sessions(self.events)

    @cached_property
    def sessions(self) -> DataFrame:
        return correlation.with_conversion(sessions.sessions(self.numbered), self.pos).persist()

    @cached_property
    def stores(self) -> DataFrame:
        return projections.known_stores(self.events, self.pos)

    def _of(self, table: DataFrame, store_id: str | None) -> DataFrame:
        if store_id is None:
            return table
        if self.stores.filter(F.col("store_id") == store_id).isEmpty():
            raise StoreNotFound(store_id)
        return table.filter(F.col("store_id") == store_id)

    def metrics(self, store_id: str | None = None) -> DataFrame:
        return self._of(projections.metrics(self.sessions, self.stores), store_id)

    def funnel(self, store_id: str | None = None, pos_only: bool = False) -> DataFrame:
        return self._of(projections.funnel(self.sessions, self.stores, pos_only), store_id)

    def heatmap(self, store_id: str | None = None) -> DataFrame:
        return self._of(projections.heatmap(self.sessions, sessions.session_dwell(self.numbered)), store_id)

    def anomalies(self, store_id: str | None = None, period_us: int = PERIOD_US) -> DataFrame:
        return self._of(projections.anomalies(self.sessions, verifier.newest_by_store(verifier.warnings(self.events)), self.as_of_us, period_us), store_id)

    def health(self) -> DataFrame:
        return projections.health(self.events, self.sessions, self.as_of_us)

    def audit(self, visitor_id: str) -> DataFrame:
        """A visitor's records in order; the store does not narrow them."""
        own = self.events.filter(F.col("visitor_id") == visitor_id)
        if own.isEmpty():
            raise VisitorNotFound(visitor_id)
        return audit.audit_timeline(own).orderBy("arrival_seq", "sub_seq")

    def calibration(self, store_id: str | None = None) -> DataFrame:
        """Thresholds of one store, defaults if nothing was seen of it, or of all known stores."""
        return calibration.store_thresholds(self.events) if store_id is None else calibration.profile_of(self.events, store_id)

    def get_threshold(self, store_id: str, parameter: str) -> float:
        """One threshold of a store, its default as long as too little was seen; .5 for a parameter nobody knows."""
        if parameter not in calibration.PARAMETERS:
            return calibration.UNKNOWN_PARAMETER
        profile = self.calibration(store_id)
        return float(profile.first()[parameter] if parameter in profile.columns else calibration.PARAMETERS[parameter][0])

    def all_profiles(self) -> DataFrame:
        return self.calibration()

    def calibrate_all(self) -> DataFrame:
        """(store_id, parameter, before, after) of every threshold that left its default."""
        return calibration.changes(self.calibration())

    def camera_trust(self, store_id: str | None = None) -> DataFrame:
        return self._of(calibration.camera_trust(self.events), store_id)

    def json(self, table: DataFrame) -> DataFrame:
        """One JSON text per store."""
        return projections.as_json(table)
