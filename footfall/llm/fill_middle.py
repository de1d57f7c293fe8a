"""Fill-in-the-middle samples: a rope is split at two unit ranks and its parts joined in another order, and back."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain, and so many of the others put the suffix first.
PLAIN_SHARE, SUFFIX_FIRST_SHARE = 10, 20
SEED = "1"
#: Units a leaf is built with.
LEAF = 1024
#: Type and order of the columns that Python adds.
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True, slots=True)
class Rope:
    """A text as a balanced tree. Every node caches how many units and code points lie below it.

    ``starts`` of a leaf are the places of its units within its text; None where each code point is a unit.
    """

    units: int
    chars: int
    height: int = 0
    text: str = ""
    starts: tuple[int, ...] | None = None
    left: Rope | None = None
    right: Rope | None = None

    @staticmethod
    def leaf(text: str, starts: tuple[int, ...] | None = None) -> Rope:
        return Rope(len(text) if starts is None else len(starts), len(text), 0, text, starts)

    @staticmethod
    def of(text: str, unit: str | None = None, leaf: int = LEAF) -> Rope:
        """The rope of a text; ``unit`` is a pattern matched left to right, and what lies between matches belongs to the match before
        (at the start: to the first). No pattern: every code point is a unit."""
        if unit is None:
            leaves = [Rope.leaf(text[at : at + leaf]) for at in range(0, len(text), leaf)]
        else:
            starts = [m.start() for m in re.finditer(unit, text, re.DOTALL) if m.end() > m.start()]
            starts[:1] = [0] if text else []
            ends = [*starts[leaf::leaf], len(text)]
            leaves = [Rope.leaf(text[a:b], tuple(s - a for s in starts[k * leaf : (k + 1) * leaf])) for k, (a, b) in enumerate(zip(starts[::leaf], ends))]
        if not leaves:
            return Rope.leaf("", None if unit is None else ())
        return Rope.over(leaves)

    @staticmethod
    def over(leaves: list[Rope]) -> Rope:
        """A tree whose halves hold equally many leaves, or one less on the left."""
        if len(leaves) == 1:
            return leaves[0]
        half = len(leaves) // 2
        return Rope.node(Rope.over(leaves[:half]), Rope.over(leaves[half:]))

    @staticmethod
    def node(left: Rope, right: Rope) -> Rope:
        return Rope(left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height), "", None, left, right)

    @staticmethod
    def balanced(left: Rope, right: Rope) -> Rope:
        """A node over two ropes whose heights differ by two at most, turned so that they differ by one."""
        if left.height > right.height + 1:
            if left.left.height < left.right.height:
                inner = left.right
                return Rope.node(Rope.node(left.left, inner.left), Rope.node(inner.right, right))
            return Rope.node(left.left, Rope.node(left.right, right))
        if right.height > left.height + 1:
            if right.right.height < right.left.height:
                inner = right.left
                return Rope.node(Rope.node(left, inner.left), Rope.node(inner.right, right.right))
            return Rope.node(Rope.node(left, right.left), right.right)
        return Rope.node(left, right)

    def __add__(self, other: Rope) -> Rope:
        """Both, one after the other; the shorter tree is hung into the taller one's rim."""
        if not self.chars:
            return other
        if not other.chars:
            return self
        if self.height > other.height + 1:
            return Rope.balanced(self.left, self.right + other)
        if other.height > self.height + 1:
            return Rope.balanced(self + other.left, other.right)
        return Rope.node(self, other)

    def split(self, rank: int, by: str = "units") -> tuple[Rope, Rope]:
        """What lies before the unit (or, by ``chars``, the code point) of this rank, and the rest.

        A unit that is cut in two counts as one in each half.
        """
        if self.left is not None:
            first = getattr(self.left, by)
            if rank <= first:
                a, b = self.left.split(rank, by)
                return a, b + self.right
            a, b = self.right.split(rank - first, by)
            return self.left + a, b
        if self.starts is None:
            return Rope.leaf(self.text[:rank]), Rope.leaf(self.text[rank:])
        at = rank if by == "chars" else self.starts[rank] if rank < len(self.starts) else self.chars
        k = bisect_left(self.starts, at)
        tail = tuple(s - at for s in self.starts[k:])
        if at < self.chars and tail[:1] != (0,):
            tail = (0, *tail)
        return Rope.leaf(self.text[:at], self.starts[:k]), Rope.leaf(self.text[at:], tail)

    def leaves(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            if node.left is None:
                yield node.text
            else:
                waiting += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def rearrange(text: str, cut: tuple[int, int], form: str, unit: str | None = None) -> tuple[str, int, int, int]:
    """(output, units, code points of the prefix, of the middle) of a text cut at two ranks modulo its units + 1."""
    whole = Rope.of(text, unit)
    if form == "plain":
        return text, whole.units, 0, 0
    a, b = sorted(c % (whole.units + 1) for c in cut)
    head, suffix = whole.split(b)
    prefix, middle = head.split(a)
    p, s, m = map(Rope.leaf, (PREFIX, SUFFIX, MIDDLE))
    made = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
    return str(made), whole.units, prefix.chars, middle.chars


def restore(output: str, form: str) -> str:
    """The text that ``rearrange`` was given: the output's tree split at the sentinels and joined again."""
    if form == "plain":
        return output
    second = PREFIX if form == "spm" else SUFFIX
    whole = Rope.of(output)
    # no sentinel is in the text, and none begins with what another ends with, so the first of each is the one put there
    at = [output.index(second), output.index(MIDDLE)]
    head, middle = whole.split(at[1], "chars")
    one, two = head.split(at[0], "chars")
    parts = [x.split(len(PREFIX), "chars")[1] for x in (one, two, middle)]
    prefix, suffix = (parts[1], parts[0]) if form == "spm" else (parts[0], parts[1])
    return str(prefix + parts[2] + suffix)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None, seed: str = SEED) -> DataFrame:
    """One row per document: (doc_id, n, form, prefix_chars, middle_chars, output).

    The draws are four numbers out of sha256 of the seed and the id. A narrow pass without a shuffle. Null texts are empty and, as all
    empty ones, plain; so are texts that hold a sentinel. Equal texts with different ids are cut apart, repeated rows alike; a null
    doc_id stays null and is drawn as an empty id; an empty table gives no rows; other columns are ignored.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("key", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = columns(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"))
    stays = (F.col("text") == "") | (F.col("h3") % 100 >= 100 - PLAIN_SHARE)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        stays |= F.contains("text", F.lit(sentinel))
    drawn = named.select("doc_id", "text", *draws).withColumn("form", F.when(stays, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST_SHARE, "spm").otherwise("psm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, h1, h2 = (batch.column(c).to_pylist() for c in ("form", "h1", "h2"))
            outputs, counts = [], []
            for text, f, *cut in zip(batch.column("text"), form, h1, h2):
                made, *count = rearrange(text.as_py(), tuple(cut), f, unit)
                outputs.append(made)
                counts.append(count if f != "plain" else (count[0], None, None))
            n, prefix, middle = (pa.array((c[k] for c in counts), pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, batch.column("form"), prefix, middle, pa.array(outputs, pa.string())], names=["doc_id", *(c.split()[0] for c in MADE.split(", "))])

    return drawn.select("doc_id", "text", "form", "h1", "h2").mapInArrow(run, f"doc_id long, {MADE}")


def restored(samples: DataFrame) -> DataFrame:
    """The samples of ``fill_middle`` with the text rebuilt from ``output`` and ``form`` alone, as column ``restored``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(o.as_py(), f) for o, f in zip(batch.column("output"), batch.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "restored"])

    return samples.mapInArrow(run, f"{schema}, restored string")


def digest(samples: DataFrame) -> DataFrame:
    """Checksums of the samples of ``restored`` in place of their texts."""
    return samples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def oracle() -> str:
    """DuckDB SQL for ``digest``; the text itself stands for the restored one."""
    draws = ", ".join(f"('0x' || substr(k, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""
WITH keyed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
drawn AS (SELECT doc_id, t, length(t)::BIGINT AS n, {draws} FROM keyed),
cut AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN_SHARE} THEN 'plain'
       WHEN h4 % 100 < {SUFFIX_FIRST_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts"""
