"""Raw JSON lines to accepted events: strict checks, reasons, and first-arrival dedup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import EVENT, EVENT_TYPES, FUTURE_SLACK_US, MAX_BATCH

_TEXT, _WHOLE, _FLAG = "STRING", "BIGINT", "BOOLEAN"


_FIELDS = ("event_id", "store_id", "camera_id", "visitor_id", "event_type", "timestamp", "zone_id", "dwell_ms", "is_staff", "confidence", "metadata", "metadata.queue_depth")


def _kind(field: str) -> Column:
    """The JSON type of a field as written: a quoted number is STRING; missing and null give null."""
    return F.nullif(F.col(f"`kind {field}`"), F.lit("VOID"))


def _value(field: str, kind: str) -> Column:
    return F.try_variant_get(F.col(f"`part {field}`"), "$", kind)


def _text(field: str) -> Column:
    return F.when(_kind(field) == _TEXT, _value(field, "string"))


def _reason(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(text))


def parse_timestamp_us(text: Column) -> Column:
    """Microseconds since 1970 of an ISO-8601 text with an offset; null for all else."""
    has_offset = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|z|[+-]\d{2}:?\d{2})$")
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    offset = F.when(text.endswith("Z"), text).otherwise(F.regexp_replace(colon, "z$", "Z"))
    return F.when(has_offset, F.unix_micros(F.try_to_timestamp(offset)))


def parse_line(text: Column) -> Column:
    """The VARIANT of a line, null where it is no JSON, as ``try_parse_json`` reads it.

    ``from_json``, held to the same strictness, keeps one factory of parsers for all lines, where ``try_parse_json`` makes one for each.
    """
    return F.from_json(text, "variant", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})


def validate(raw: DataFrame, as_of_us: int | Column, value: str = "value", order: str = "arrival_seq") -> DataFrame:
    """Each line with its typed fields and ``errors``, the reasons why it is not an event (empty: it is one).

    Types are those of the JSON text, nothing is converted: ``"500"`` is no number and ``"True"`` no flag. ``as_of_us`` is
    the clock; a stream gives ``clock()``, which moves on with its batches. ``metadata`` is told as JSON text, and whole as
    VARIANT in ``meta``.
    """
    parsed = raw.select(F.col(order).alias("arrival_seq"), F.col(value).alias("raw"), parse_line(F.col(value)).alias("v"))
    # each in a step of its own, so that a field is looked up once, its type told once and its value read once, however many checks name them
    parts = parsed.select("arrival_seq", "raw", F.col("v").isNotNull().alias("json"), *[F.try_variant_get("v", f"$.{f}", "variant").alias(f"part {f}") for f in _FIELDS])
    told = parts.select("*", *[F.schema_of_variant(F.col(f"`part {f}`")).alias(f"kind {f}") for f in _FIELDS])
    dwell, staff, sure, depth = _kind("dwell_ms"), _kind("is_staff"), _kind("confidence"), _kind("metadata.queue_depth")
    required = ("event_id", "store_id", "camera_id", "visitor_id")
    read = told.select(
        "*",
        *[F.trim(_text(name)).alias(name) for name in required],
        _text("event_type").alias("event_type"),
        parse_timestamp_us(F.trim(_text("timestamp"))).alias("ts_us"),
        _text("zone_id").alias("zone_id"),
        F.when(dwell == _WHOLE, _value("dwell_ms", "long")).alias("dwell"),
        F.when(staff == _FLAG, _value("is_staff", "boolean")).alias("staff"),
        F.when(sure.isin("BIGINT", "DOUBLE", "FLOAT") | sure.startswith("DECIMAL"), _value("confidence", "double")).alias("confidence"),
        F.when(depth == _WHOLE, _value("metadata.queue_depth", "long")).alias("queue_depth"),
    )
    # the first sign of a text that is JSON tells whether it is an object
    is_object = F.col("json") & F.coalesce(F.col("raw").rlike(r"^[\x00-\x20\x{FEFF}]*\{"), F.lit(False))
    checks = []
    for name in required:
        kind = _kind(name)
        checks += [_reason(kind.isNull(), f"{name}: field required"), _reason(kind != _TEXT, f"{name}: must be a string"), _reason(F.col(name) == "", f"{name}: must not be empty")]
    plain_id = F.regexp_replace(F.regexp_replace("event_id", "^(urn:)?(uuid:)?", ""), "[{}-]", "")
    checks.append(_reason((F.col("event_id") != "") & ~plain_id.rlike("^[0-9a-fA-F]{32}$"), "event_id: must be a valid UUID"))
    kind, at, number = _kind("event_type"), F.col("ts_us"), F.col("confidence")
    checks += [_reason(kind.isNull(), "event_type: field required"), _reason(kind.isNotNull() & ~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "event_type: not a known type")]
    checks += [
        _reason(_kind("timestamp").isNull(), "timestamp: field required"),
        _reason(_kind("timestamp").isNotNull() & at.isNull(), "timestamp: must be ISO-8601 with an offset"),
        _reason(at > (as_of_us if isinstance(as_of_us, Column) else F.lit(as_of_us)) + FUTURE_SLACK_US, "timestamp: too far in the future"),
    ]
    checks += [
        _reason(dwell != _WHOLE, "dwell_ms: must be an integer"),
        _reason(F.col("dwell") < 0, "dwell_ms: must not be negative"),
        _reason(staff != _FLAG, "is_staff: must be a boolean"),
        _reason(sure.isNull(), "confidence: field required"),
        _reason(sure.isNotNull() & number.isNull(), "confidence: must be a number"),
        _reason((number < 0) | (number > 1), "confidence: must be from 0 to 1"),
        _reason(_kind("zone_id") != _TEXT, "zone_id: must be a string"),
        _reason(~_kind("metadata").startswith("OBJECT"), "metadata: must be an object"),
        _reason(depth != _WHOLE, "metadata.queue_depth: must be an integer"),
    ]
    # most lines are sound: only for the others are the reasons listed, which Spark does without compiled code
    sound = is_object & ~reduce(lambda a, b: a | b, [c.isNotNull() for c in checks])
    reasons = F.when(sound, F.array().cast("array<string>")).when(is_object, F.filter(F.array(*checks), lambda r: r.isNotNull())).otherwise(F.array(F.lit("Event must be a JSON object")))
    meta = F.col("`part metadata`")
    return read.select(
        "arrival_seq",
        "raw",
        reasons.alias("errors"),
        *required,
        "event_type",
        "ts_us",
        "zone_id",
        F.coalesce("dwell", F.lit(0)).alias("dwell_ms"),
        F.coalesce("staff", F.lit(False)).alias("is_staff"),
        "confidence",
        "queue_depth",
        F.try_variant_get(meta, "$.wait_duration_ms", "long").alias("wait_ms"),
        F.try_variant_get(meta, "$.reid_score", "double").alias("reid_score"),
        F.to_json(meta).alias("metadata"),
        meta.alias("meta"),
    )


def clock() -> Column:
    """The time in microseconds since 1970, in a stream that of each batch."""
    return F.unix_micros(F.current_timestamp())


def with_status(validated: DataFrame, stored: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """Adds ``status``: rejected, duplicate or accepted. Of valid lines with one event id the first arrival is accepted,
    unless ``stored(event_id)`` has the id already.

    ``bounded`` says that there are at most MAX_BATCH lines: their ids then go to the stored ones, which are read without a shuffle.
    """
    valid = F.size("errors") == 0
    # lines without an event's id are keys of their own, so that a feed of broken lines is no single window
    keyed = validated.withColumn("dedup_key", F.when(valid, F.col("event_id")).otherwise(F.concat(F.lit("#"), F.col("arrival_seq").cast("string"))))
    rows = keyed.withColumn("first_seq", F.min("arrival_seq").over(Window.partitionBy("dedup_key")))
    known = F.lit(False)
    if stored is not None:
        ids = stored.select(F.col("event_id").alias("dedup_key"))
        if bounded:
            ids = ids.join(F.broadcast(keyed.filter(valid).select("dedup_key").distinct()), "dedup_key", "left_semi")
        met = ids.distinct().withColumn("known", F.lit(True))
        rows = rows.join(F.broadcast(met) if bounded else met, "dedup_key", "left")
        known = F.coalesce("known", F.lit(False))
    status = F.when(~valid, "rejected").when(known | (F.col("arrival_seq") != F.col("first_seq")), "duplicate").otherwise("accepted")
    return rows.withColumn("status", status).drop("first_seq", "known", "dedup_key")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter("status = 'accepted'").drop("errors", "status", "raw", "meta")


def log_columns(events: DataFrame) -> DataFrame:
    """A log's columns alone: those of ``schema.EVENT`` and ``metadata`` as VARIANT, null where the table has none."""
    kind = dict(events.dtypes).get("metadata")
    whole = F.col("meta") if "meta" in events.columns else F.lit(None).cast("variant") if kind is None else F.try_parse_json("metadata") if kind == "string" else F.col("metadata")
    return events.select(*EVENT.fieldNames(), whole.alias("metadata"))


def rejected(checked: DataFrame) -> DataFrame:
    """(arrival_seq, event_id, error): reasons joined by ``; ``, with the id as far as it could be read."""
    return checked.filter("status = 'rejected'").select("arrival_seq", "event_id", F.array_join("errors", "; ").alias("error"))


def summary(checked: DataFrame) -> DataFrame:
    return checked.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate", "rejected")])


def dedup(events: DataFrame) -> DataFrame:
    """The first arrival of each event id."""
    order = Window.partitionBy("event_id").orderBy("arrival_seq")
    return events.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def batch_size(raw: DataFrame, limit: int = MAX_BATCH) -> int:
    """Lines of a batch, which must hold 1 to ``limit``."""
    n = raw.limit(limit + 1).count()
    if not 1 <= n <= limit:
        raise ValueError(f"a batch holds 1 to {limit} events")
    return n


def ingest(raw: DataFrame, as_of_us: int | Column, stored: DataFrame | None = None, batch_limit: int | None = MAX_BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, summary) of one batch; a batch must hold 1 to ``batch_limit`` lines (None: any number)."""
    if batch_limit is not None:
        batch_size(raw, batch_limit)
    checked = with_status(validate(raw, as_of_us), stored, bounded=batch_limit is not None and batch_limit <= MAX_BATCH)
    return accepted(checked), rejected(checked), summary(checked)


def replay_order(events: DataFrame) -> DataFrame:
    """Arrival numbers by time, then file order (``file_seq``, else the arrival so far), for a replay: a range-partitioned sort and no single window.

    Numbers grow with the order but are not dense, which is all that the window operators ask for. They are those of one run of the
    plan, so a table that is read more than once is to be written first.
    """
    named = events if "file_seq" in events.columns else events.withColumn("file_seq", F.col("arrival_seq"))
    ordered = named.drop("arrival_seq").repartitionByRange("ts_us", "file_seq").sortWithinPartitions("ts_us", "file_seq")
    return ordered.withColumn("arrival_seq", F.monotonically_increasing_id())
