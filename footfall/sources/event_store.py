"""A growing event log on storage: numbered batches, an id index in buckets, and a commit for each batch."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest
from ..schema import EVENT, MAX_BATCH
from . import readers

#: Folders that the ids are dealt to, many more than a small batch has ids: such a batch reads those of its own ids only.
BUCKETS = 4096
#: Small batches whose ids lie in a file each, in the folder of FRESH, before they are dealt to the buckets together.
FRESH_BATCHES, FRESH = 1024, -1
#: Ids that one task writes to a bucket.
IDS_A_FILE = 4_000_000
LINES = T.StructType([*EVENT.fields, T.StructField("metadata", T.VariantType()), T.StructField("error", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("status", T.StringType())])
IDS = "event_id string, bucket int, batch long"


@dataclass(frozen=True)
class Commit:
    """What a batch took in. ``next_seq`` is where the next one's arrival numbers begin, ``fresh_from`` the first batch whose ids are not yet dealt."""

    batch: int
    accepted: int
    duplicate: int
    rejected: int
    next_seq: int
    fresh_from: int

    def counts(self) -> dict[str, int]:
        return {k: getattr(self, k) for k in ("accepted", "duplicate", "rejected")}


class EventStore:
    """The log in ``path``: ``lines`` by batch and status, ``ids`` by bucket and batch, ``commits`` with a small file a batch.

    A batch counts once its commit is there, which is written last and whole; readers see committed batches only. What a batch that
    failed midway left is cleared when it is run again, and one that is committed is not run again, so a number writes once.
    One writer at a time. Lines are parsed once, when they are written, and arrival numbers are those that were written.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fresh_batches: int = FRESH_BATCHES):
        self.spark, self.path, self.buckets, self.fresh_batches = spark, path.rstrip("/"), buckets, fresh_batches

    # ------------------------------------------------------------ commits

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._at(f"commits/{name}")

    def _commit_of(self, batch: int) -> Commit | None:
        where, files = self._file(f"{batch:012d}.json")
        if not files.exists(where):
            return None
        reader = files.open(where)
        try:
            return Commit(**json.loads(reader.readAllBytes().decode()))
        finally:
            reader.close()

    def last(self) -> Commit | None:
        """The newest commit; batches are committed in order of their numbers."""
        where, files = self._at("commits")
        if not files.exists(where):
            return None
        names = [f.getPath().getName() for f in files.listStatus(where)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        return self._commit_of(max(numbers)) if numbers else None

    def _put(self, commit: Commit) -> None:
        where, files = self._file(f"{commit.batch:012d}.json")
        draft, _ = self._file(f"{commit.batch:012d}.draft")
        out = files.create(draft, True)
        try:
            out.write(bytearray(json.dumps(asdict(commit)).encode()))
        finally:
            out.close()
        if not files.rename(draft, where):
            raise OSError(f"batch {commit.batch} could not be committed")

    # ------------------------------------------------------------ reading

    def _table(self, name: str, schema) -> DataFrame:
        last = self.last()
        where, files = self._at(name)
        if last is None or not files.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("batch") <= last.batch)

    def lines(self) -> DataFrame:
        """Every line of the committed batches with its batch and status; ``error`` of rejected ones."""
        return self._table("lines", LINES)

    def events(self) -> DataFrame:
        """The accepted events, with their whole metadata."""
        return self.lines().filter("status = 'accepted'").select(*EVENT.fieldNames(), "metadata")

    def rejected(self, batch: int | None = None) -> DataFrame:
        found = self.lines().filter("status = 'rejected'")
        return (found if batch is None else found.filter(F.col("batch") == batch)).select("arrival_seq", "event_id", "error")

    def bucket(self, event_id):
        return F.pmod(F.xxhash64(event_id), F.lit(self.buckets)).cast("int")

    def ids(self, asked: list[str] | None = None) -> DataFrame:
        """(event_id, bucket, batch) of the log. With ``asked``, at most a batch's, only the fresh ids and those of their buckets are read."""
        last = self.last()
        dealt = (F.col("bucket") != FRESH) | (F.col("batch") >= (last.fresh_from if last else 0))
        known = self._table("ids", IDS).filter(dealt)
        if asked is None:
            return known
        ours = self.spark.createDataFrame([(i,) for i in asked], "event_id string").select(self.bucket(F.col("event_id"))).distinct().collect()
        return known.filter(F.col("bucket").isin([FRESH, *(r[0] for r in ours)]))

    # ------------------------------------------------------------ writing

    def _clear(self, batch: int) -> None:
        """Takes away what an attempt at a batch left that was never committed."""
        where, files = self._at(f"lines/batch={batch}")
        if files.exists(where):
            files.delete(where, True)
            found = files.globStatus(self._at(f"ids/bucket=*/batch={batch}")[0])
            for left in found or []:
                files.delete(left.getPath(), True)

    def _deal(self, ids: DataFrame, rows: int, batch: int) -> None:
        """Ids to their buckets, under the number of ``batch``."""
        pieces = 1 + rows // (self.buckets * IDS_A_FILE)
        dealt = ids.select("event_id", self.bucket(F.col("event_id")).alias("bucket"), F.lit(batch).cast("long").alias("batch"))
        dealt = dealt.repartition("bucket", F.pmod(F.hash("event_id"), F.lit(pieces))).sortWithinPartitions("bucket", "event_id")
        dealt.write.mode("append").partitionBy("bucket", "batch").parquet(f"{self.path}/ids")

    def _write(self, checked: DataFrame, batch: int) -> Commit:
        """Writes ``checked``, whose arrival numbers are final, and its ids, and commits."""
        last = self.last()
        self._clear(batch)
        made = checked.withColumns({"metadata": F.col("meta"), "error": F.when(F.col("status") == "rejected", F.array_join("errors", "; ")), "batch": F.lit(batch).cast("long")})
        # a folder a status: the log of accepted events is one of them, and duplicates do not lie between its rows
        made.select(*LINES.fieldNames()).sortWithinPartitions("status", "arrival_seq").write.mode("append").partitionBy("batch", "status").parquet(f"{self.path}/lines")
        where, files = self._at("lines")
        told = self.spark.read.schema(LINES).parquet(where.toString()).filter(F.col("batch") == batch) if files.exists(where) else self.spark.createDataFrame([], LINES)
        counts = told.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate", "rejected")], (F.coalesce(F.max("arrival_seq"), F.lit(-1)) + 1).alias("next_seq")).first().asDict()
        new, fresh_from = told.filter("status = 'accepted'").select("event_id", "batch"), last.fresh_from if last else 0
        if counts["accepted"] > MAX_BATCH:
            self._deal(new, counts["accepted"], batch)
        elif counts["accepted"]:
            new.withColumn("bucket", F.lit(FRESH)).coalesce(1).write.mode("append").partitionBy("bucket", "batch").parquet(f"{self.path}/ids")
        if batch - fresh_from >= self.fresh_batches:
            fresh = self.ids([]).filter(F.col("bucket") == FRESH)
            self._deal(fresh, 0, batch)
            fresh_from = batch
        counts["next_seq"] = max(counts["next_seq"], last.next_seq if last else 0)
        commit = Commit(batch=batch, **counts, fresh_from=fresh_from)
        self._put(commit)
        return commit

    def _begin(self, number: int | None) -> tuple[int, int, Commit | None]:
        """(number, first arrival number, commit if that batch is done)."""
        last = self.last()
        number = (last.batch + 1 if last else 0) if number is None else number
        done = self._commit_of(number) if last and number <= last.batch else None
        if last and number <= last.batch and done is None:
            raise ValueError(f"batch {number} comes after batch {last.batch} was committed")
        return number, last.next_seq if last else 0, done

    def append(self, raw: DataFrame, as_of_us, number: int | None = None, limit: int | None = MAX_BATCH) -> Commit:
        """Takes in ``raw(arrival_seq, value)`` after all that is stored. Lines of an id that is stored are duplicates.

        A batch holds 1 to ``limit`` lines; its ids are asked in their own buckets. With None it may be of any size, and its ids meet the
        stored ones by a shuffle of both. ``number``, as a stream gives it, makes a batch that is run again write once.
        """
        number, first, done = self._begin(number)
        if done:
            return done
        if limit is not None:
            ingest.batch_size(raw, limit)
        validated = ingest.validate(raw, as_of_us)
        bounded = limit is not None and limit <= MAX_BATCH
        known = self.ids([r[0] for r in validated.filter(F.size("errors") == 0).select("event_id").collect()] if bounded else None)
        checked = ingest.with_status(validated, known, bounded)
        least = raw.agg(F.coalesce(F.min("arrival_seq"), F.lit(0))).first()[0]
        return self._write(checked.withColumn("arrival_seq", F.col("arrival_seq") + F.lit(first - least).cast("long")), number)

    def replay(self, path: str, as_of_us: int, store_id: str | None = None) -> Commit:
        """Takes in the files of a JSONL log as one batch in order of time."""
        number, first, _ = self._begin(None)
        checked = readers.replay_lines(self.spark, path, as_of_us, store_id)
        if first:
            known = self.ids().select("event_id", F.lit(True).alias("known_"))
            checked = checked.join(known, "event_id", "left").withColumn("status", F.when(F.col("known_") & (F.col("status") == "accepted"), "duplicate").otherwise(F.col("status"))).drop("known_")
        return self._write(checked.withColumn("arrival_seq", F.col("arrival_seq") + first), number)

    def compact(self, into: EventStore) -> None:
        """Writes all committed batches as one of a new store, a few files a bucket: many small batches make many small files."""
        if into.last() is not None:
            raise ValueError("the store to compact into is not empty")
        last = self.last()
        if last is None:
            return
        self.lines().withColumn("batch", F.lit(0).cast("long")).repartitionByRange("status", "arrival_seq").sortWithinPartitions("status", "arrival_seq").write.partitionBy("batch", "status").parquet(f"{into.path}/lines")
        counts = self.lines().agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate", "rejected")]).first().asDict()
        into._deal(self.ids(), counts["accepted"], 0)
        into._put(Commit(batch=0, **counts, next_seq=last.next_seq, fresh_from=0))


def keep_each_batch(store: EventStore, as_of_us=None):
    """A function for ``foreachBatch`` over lines: each micro-batch is one of the store's, under its own number."""

    def work(batch: DataFrame, number: int) -> None:
        lines = batch.select("value", F.monotonically_increasing_id().alias("arrival_seq"))
        store.append(lines, ingest.clock() if as_of_us is None else as_of_us, number, None)

    return work
