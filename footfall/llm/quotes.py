"""Quotation linking: nested quotes parsed, their passages hashed and joined to the messages they come from."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

_MARK = re.compile(r"(?:[ \t]{0,3}>)+[ \t]?")
#: Rows that one window of the numbering holds at most, by the turns it spans.
ORDER_TURNS = 1024
#: Sentence marks that a passage may lose at its ends.
MARKS = ".,;:!?…"
#: Runs of up to so many words are hashed whole, longer ones meet on so many first words.
HEAD = 8


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, quoted passages): a passage is a run of lines of one quote level, with that level."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        level = m[0].count(">") if m else 0
        if not level:
            own.append(line)
        elif level == last:
            quoted[-1][1].append(line[m.end() :])
        else:
            quoted.append((level, [line[m.end() :]]))
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in quoted]


def normalised(passage: str) -> str:
    """Lower case, white space runs as one blank, no blanks or sentence marks at the ends."""
    return " ".join(passage.lower().split()).strip(" " + MARKS)


def passage_hash(passage: str) -> int | None:
    text = normalised(passage)
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) if text else None


def own_runs(own: str) -> tuple[list[str], list[int], list[int]]:
    """(words, starts, ends): what others can quote of a message is words[start:end], a run of whole lines.

    A run begins at the first word of a line and ends after the last word of one; as in ``normalised``,
    sentence marks that stand alone count for neither, and where the lines break plays no part.
    """
    words: list[str] = []
    starts, ends = set(), set()
    for line in own.split("\n"):
        made = line.lower().split()
        real = [k for k, w in enumerate(made) if w.strip(MARKS)]
        if real:
            starts.add(len(words) + real[0])
            ends.add(len(words) + real[-1] + 1)
        words += made
    return words, sorted(starts), sorted(ends)


def head_hash(words: list[str]) -> int:
    """Of a run's first HEAD words, where longer runs meet before they are compared whole."""
    return xxhash.xxh64_intdigest(" ".join(words[:HEAD]).lstrip(" " + MARKS).encode("utf-8", "surrogatepass"), 1) - (1 << 63)


def own_keys(own: str) -> list[int]:
    """Hashes of a message's runs of up to HEAD words and heads of its longer ones."""
    words, starts, ends = own_runs(own)
    made = set()
    for at in starts:
        for to in ends[bisect_right(ends, at) :]:
            if to - at > HEAD:
                made.add(head_hash(words[at : at + HEAD]))
                break
            made.add(passage_hash(" ".join(words[at:to])))
    return sorted(made)


def long_runs(own: str, asked: list[tuple[int, int]]) -> list[int]:
    """Hashes of the message's runs that begin with one of the ``asked`` heads and have the length asked beside it."""
    lengths: dict[int, list[int]] = {}
    for head, n in asked:
        lengths.setdefault(head, []).append(n)
    words, starts, ends = own_runs(own)
    closes = set(ends)
    return sorted({passage_hash(" ".join(words[at : at + n])) for at in starts for n in lengths.get(head_hash(words[at : at + HEAD]), ()) if at + n in closes})


PARSED = "key long,conv_id long,turn long,role string,body string,quotes array<struct<level:int,hash:long,meet:long,words:int>>,own array<long>"
_TYPE = pa.schema([
    pa.field("key", pa.int64()), pa.field("conv_id", pa.int64()), pa.field("turn", pa.int64()), pa.field("role", pa.string()), pa.field("body", pa.string()),
    pa.field("quotes", pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("meet", pa.int64()), ("words", pa.int32())]))), pa.field("own", pa.list_(pa.int64())),
])


def parse_messages(messages: DataFrame) -> DataFrame:
    """``messages(key, conv_id, turn, role, text)`` -> body without quotes, hashed quotes by level, hashes others may quote.

    A quote meets its sources at its own hash, or at that of its head if it has over HEAD words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, quotes, own = [], [], []
            for text in batch.column("text").to_pylist():
                body, quoted = split_quotes(text)
                asked = []
                for level, passage in quoted:
                    h, words = passage_hash(passage), normalised(passage).split()
                    if h is not None:
                        asked.append({"level": level, "hash": h, "meet": h if len(words) <= HEAD else head_hash(words), "words": len(words)})
                bodies.append(body)
                quotes.append(asked)
                own.append(own_keys(body))
            made = [pa.array(bodies, pa.string()), pa.array(quotes, _TYPE.field("quotes").type), pa.array(own, _TYPE.field("own").type)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "conv_id", "turn", "role")), *made], schema=_TYPE)

    return messages.select("key", "conv_id", "turn", "role", "text").mapInArrow(run, PARSED)


def find_long(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, from_turn, body, asked)`` -> (conv_id, from_turn, hash) of the long runs asked for."""
    schema = pa.schema([("conv_id", pa.int64()), ("from_turn", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, turn, h) for conv, turn, body, asked in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "from_turn", "body", "asked"))) for h in long_runs(body, [(a["meet"], a["words"]) for a in asked])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], schema=schema)

    return messages.select("conv_id", "from_turn", "body", "asked").mapInArrow(run, "conv_id long,from_turn long,hash long")


def link_quotes(conversations: DataFrame, order_turns: int = ORDER_TURNS) -> DataFrame:
    """One row per message in reply order: (conv_id, turn, role, body, n_quotes, n_linked, parent_turn, position).

    A quoted passage links to the latest earlier turn of its conversation that holds it as a run of whole
    lines of its own text (blank lines and line breaks aside). The parent is the latest turn among the links of the shallowest
    linked level, else the preceding turn (null at a conversation's start). Messages are placed by their
    parent's turn, then their own, so an original stands before its replies; position counts from 0 in
    each conversation. Null texts are empty bodies, a null turn sorts first and links with nothing, rows
    that repeat a turn are messages of their own, a null conv_id is one conversation without links; an
    empty table gives no rows; other columns are ignored. Rows of equal parent and own turn are ordered by role and body, unless
    they are too many for one task; see ``reply_positions``.
    """
    scratch = Scratch(conversations.sparkSession)
    named = conversations.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    # equal rows find equal links, so a hash of the content beside its conversation and turn keys a message
    parsed = scratch.keep(parse_messages(named.withColumn("key", F.xxhash64("conv_id", "turn", "role", "text"))))
    keyed = parsed.filter("conv_id is not null and turn is not null")
    asked = keyed.select("key", "conv_id", "turn", F.posexplode("quotes").alias("nth", "quote"))
    asked = asked.select("key", "conv_id", "turn", "nth", "quote.*").dropDuplicates(["conv_id", "turn", "key", "nth"])
    # only passages that are quoted at all need their sources; a source's turns are listed once per passage
    wanted = scratch.keep(asked)
    sources = keyed.select("key", "conv_id", F.col("turn").alias("from_turn"), F.explode("own").alias("meet"))
    held = sources.join(wanted.filter(F.col("words") <= HEAD).select("conv_id", "meet").distinct(), ["conv_id", "meet"], "left_semi").select("conv_id", "from_turn", F.col("meet").alias("hash"))
    long = wanted.filter(F.col("words") > HEAD).select("conv_id", "meet", "words").distinct()
    if not long.isEmpty():
        # a long passage is looked for in the messages that hold its head; equal rows hold the same
        heads = sources.join(long, ["conv_id", "meet"]).groupBy("conv_id", "from_turn", "key").agg(F.collect_set(F.struct("meet", "words")).alias("asked"))
        texts = keyed.select("key", "conv_id", F.col("turn").alias("from_turn"), "body")
        held = held.unionByName(find_long(texts.join(heads, ["conv_id", "from_turn", "key"])))
    found = latest_before(wanted, held.join(wanted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct(), order_turns)
    per = found.groupBy("conv_id", "turn", "key").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.min(F.when(F.col("origin").isNotNull(), F.struct(F.col("level"), (-F.col("origin")).alias("minus")))).alias("best"),
    )
    joined = parsed.select("key", "conv_id", "turn", "role", "body").join(per, ["conv_id", "turn", "key"], "left")
    # the preceding turn that exists: turns of a conversation, once each
    steps = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    spans = steps.withColumn("span", F.floor(F.col("turn") / order_turns))
    ends = spans.groupBy("conv_id", "span").agg(F.max("turn").alias("end"))
    ends = ends.select("conv_id", "span", F.lag("end").over(Window.partitionBy("conv_id").orderBy("span")).alias("before"))
    previous = spans.join(ends, ["conv_id", "span"]).select("conv_id", "turn", F.coalesce(F.lag("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn")), F.col("before")).alias("previous"))
    joined = joined.join(previous, ["conv_id", "turn"], "left")
    parent = F.coalesce(-F.col("best.minus"), F.col("previous"))
    made = joined.select("conv_id", "turn", "role", "body", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), parent.alias("parent_turn"))
    return reply_positions(scratch.numbered(made, "nth"), order_turns, scratch)


def latest_before(asked: DataFrame, held: DataFrame, span: int) -> DataFrame:
    """``asked(conv_id, hash, turn, ...)`` with ``origin``, the latest turn before its own at which ``held(conv_id, hash, from_turn)`` has the passage.

    As-of by running maxima: turns are cut into spans, the spans' latest turns are carried on first, and rows then meet in their span
    only, so a passage that stands in every turn is no single window and no list.
    """
    own = [c for c in asked.columns if c not in ("conv_id", "hash", "turn")]
    told = held.select("conv_id", "hash", F.col("from_turn").alias("turn"), F.lit(1).alias("kind"), F.col("from_turn").alias("at"))
    both = asked.withColumns({"kind": F.lit(0), "at": F.lit(None).cast("long")}).unionByName(told, allowMissingColumns=True).withColumn("span", F.floor(F.col("turn") / span))
    ends = both.groupBy("conv_id", "hash", "span").agg(F.max("at").alias("end"))
    carried = F.max("end").over(Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select("conv_id", "hash", "span", carried.alias("carry"))
    # of one turn the asking rows come first: a turn is no origin of itself
    within = Window.partitionBy("conv_id", "hash", "span").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("near", F.max("at").over(within)).filter("kind = 0").join(carry, ["conv_id", "hash", "span"])
    return met.select("conv_id", "hash", "turn", *own, F.coalesce("near", "carry").alias("origin"))


def reply_positions(made: DataFrame, order_turns: int, scratch: Scratch) -> DataFrame:
    """Adds ``position`` to ``made(conv_id, turn, role, body, ..., parent_turn, nth)``, whose ``nth`` numbers the rows.

    A conversation's rows are counted in spans of parent turns and numbered within them. Spans that hold over four times
    ``order_turns`` rows are cut by parent turn and span of own turns, and what still is too large, which is the replies of equal
    turns to one turn, is dealt by the rows' numbers, so that their order among themselves is that of the deal.
    """
    low = F.lit(-(1 << 63)).cast("long")
    at = lambda c: F.coalesce(F.floor(F.col(c) / order_turns), low)
    cell = ["conv_id", "span", "parent", "own", "deal"]
    zero = F.lit(0).cast("long")
    dealt = made.withColumns({"span": F.coalesce(F.floor(F.coalesce("parent_turn", "turn") / order_turns), low), "parent": zero, "own": zero, "deal": zero})

    def counts(table: DataFrame) -> DataFrame:
        return scratch.keep(table.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")))

    def finer(table: DataFrame, sizes: DataFrame, change: dict) -> DataFrame | None:
        hot = sizes.filter(F.col("n") > 4 * order_turns).select(*[F.col(c).alias(f"{c}_") for c in cell], F.col("n").alias("rows_"))
        if hot.isEmpty():
            return None
        same = F.lit(True)
        for c in cell:
            same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
        met = table.join(hot, same, "left")
        return met.withColumns({k: F.when(F.col("rows_").isNotNull(), v).otherwise(F.col(k)) for k, v in change.items()}).drop(*hot.columns)

    sizes = counts(dealt)
    for change in ({"parent": F.coalesce("parent_turn", low), "own": at("turn")}, {"deal": F.pmod(F.xxhash64("nth"), F.ceil(F.col("rows_") / order_turns)).cast("long")}):
        cut = finer(dealt, sizes, change)
        if cut is None:
            break
        dealt, sizes = cut, counts(cut)
    before = Window.partitionBy("conv_id").orderBy(*cell[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv_id").alias("c"), *[F.col(k).alias(f"{k}_") for k in cell[1:]], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    for k in cell[1:]:
        same &= F.col(k) == F.col(f"{k}_")
    within = Window.partitionBy(*cell).orderBy(F.col("parent_turn").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("body"), "nth")
    placed = dealt.join(offsets, same)
    return placed.select("conv_id", "turn", "role", "body", "n_quotes", "n_linked", "parent_turn", (F.col("offset") + F.row_number().over(within) - 1).alias("position"))


def oracle() -> str:
    """The same result as a DuckDB statement over ``conversations``, with passages compared as texts.

    It knows a passage as a whole body, a paragraph or a line only, so runs of several lines are beyond it.
    """
    plain = lambda x: f"trim(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), ' .,;:!?…')"
    return f"""
WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER () AS rid FROM conversations),
sp AS (SELECT rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM m),
ln AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM sp),
mk AS (SELECT *, regexp_extract(line, '^(?:[ \\t]{{0,3}}>)+[ \\t]?') AS mark FROM ln),
lv AS (SELECT rid, pos, line, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS rest FROM mk),
bd AS (SELECT rid, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), ''), '^\\s+|\\s+$', '', 'g') AS body FROM lv GROUP BY rid),
rn AS (SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY pos) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY rid ORDER BY pos) AS before FROM lv)),
ps AS (SELECT rid, run, level, string_agg(rest, chr(10) ORDER BY pos) AS raw FROM rn WHERE level > 0 GROUP BY ALL),
qt AS (SELECT rid, run, level, {plain("raw")} AS p FROM ps),
ow AS (SELECT rid, unnest(list_concat([body], regexp_split_to_array(body, '\\n[ \\t]*\\n'), string_split(body, chr(10)))) AS raw FROM bd),
src AS (SELECT DISTINCT conv_id, turn, {plain("raw")} AS p FROM ow JOIN m USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
ask AS (SELECT rid, run, level, p, conv_id, turn FROM qt JOIN m USING (rid) WHERE p <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
org AS (SELECT a.rid, a.run, a.level, max(s.turn) AS origin FROM ask a LEFT JOIN src s ON s.conv_id = a.conv_id AND s.p = a.p AND s.turn < a.turn GROUP BY ALL),
per AS (SELECT rid, count(*) AS n_quotes, count(origin) AS n_linked, min(level) FILTER (origin IS NOT NULL) AS best FROM org GROUP BY rid),
top AS (SELECT o.rid, max(o.origin) AS origin FROM org o JOIN per p ON p.rid = o.rid AND p.best = o.level GROUP BY ALL),
st AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
al AS (SELECT m.conv_id, m.turn, role, body, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(origin, previous) AS parent_turn
  FROM m JOIN bd USING (rid) LEFT JOIN per USING (rid) LEFT JOIN top USING (rid) LEFT JOIN st ON st.conv_id = m.conv_id AND st.turn = m.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY parent_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, body NULLS FIRST) - 1 AS position FROM al
"""
