"""Helpers shared by the corpus operators: scratch storage, streamed groups, column hygiene."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_base

class Scratch:
    """Tables written to the shared folder to cut lineage; survives lost executors.

    All tables of an application lie in one folder, which goes when the driver ends; ``since`` frees them earlier.
    """

    _written = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_base(spark)}/footfall-{spark.sparkContext.applicationId}"
        where, files = self._at(self.base)
        files.deleteOnExit(where)

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @classmethod
    def _paths(cls) -> list[str]:
        if not hasattr(cls._written, "paths"):
            cls._written.paths = []
        return cls._written.paths

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._paths().append(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def numbered(self, df: DataFrame, name: str) -> DataFrame:
        """The rows with a number of their own each, written once so that every later read sees the same."""
        return self.keep(df.withColumn(name, F.monotonically_increasing_id()))

    def drop(self, path: str) -> None:
        where, files = self._at(path)
        files.delete(where, True)
        if path in self._paths():
            self._paths().remove(path)

    def mark(self) -> int:
        """How many tables this thread has written, for ``since``."""
        return len(self._paths())

    def since(self, mark: int) -> list[str]:
        """The tables that this thread has written after ``mark`` and not dropped."""
        return self._paths()[mark:]


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def document_fold(doc_id, folds: int):
    """crc32 of the id's decimal text modulo ``folds``: fixes train and held-out rows (null id: -1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def sorted_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Runs of equal ``key`` out of batches that arrive sorted by it; holds one group at a time."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        values = frame[key].to_numpy()
        cuts = [0, *(i + 1 for i in (values[1:] != values[:-1]).nonzero()[0].tolist()), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if held and values[a] != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[a:b])
            last = values[a]
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def map_groups(df: DataFrame, key: str, work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Apply ``work`` to every group of ``key``; many small groups share one Arrow stream."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        rows = 0
        for group in sorted_groups(frames, key):
            made = work(group)
            if made is not None and len(made):
                out.append(made)
                rows += len(made)
            if rows >= 8192:
                yield pd.concat(out, ignore_index=True)
                out, rows = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInPandas(run, schema)


def map_texts(docs: DataFrame, id_col: str, text_col: str, start: Callable[[], Callable[[list], dict]], schema: str) -> DataFrame:
    """Stream (doc_id, text) through Python in Arrow batches; ids pass untouched, nulls included.

    ``start`` runs once a task and returns a function from a list of texts to named output columns of
    equal length; ``schema`` names those columns and their types, after doc_id.
    """
    named = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    types = to_arrow(schema)
    schema = schema.replace("longs", "array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if batch.num_rows:
                made = work(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(made[f.name], f.type) for f in types]], names=["doc_id", *types.names])

    return named.mapInArrow(run, f"doc_id long, {schema}")


def to_arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "longs": pa.list_(pa.int64())}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(","))])
