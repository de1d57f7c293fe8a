import random
import zlib

from footfall.llm.sharding import minimax_starts, shard_by_bytes

from .cases import awkward


def best(sizes, shards):
    """Smallest capacity for runs of several groups, by trying every one."""

    def need(c):
        n = load = 0
        for s in sizes:
            if s > c:
                n, load = n + 1, 0
            elif load and load + s <= c:
                load += s
            else:
                n, load = n + 1, s
        return n

    return next(c for c in range(1, sum(sizes) + 1) if need(c) <= shards)


def test_capacity_is_smallest(spark):
    rng = random.Random(4)
    for sizes, shards in (([5], 16), ([3, 1, 4, 1, 5, 9, 2, 6], 3), ([1, 1, 90, 1, 1, 1], 4), ([rng.randrange(1, 50) for _ in range(60)], 7), ([7] * 20, 16)):
        cells = spark.createDataFrame([(i * 3, s) for i, s in enumerate(sizes)], "at int, size long")
        made = minimax_starts(cells, shards).collect()[0]
        assert made.capacity == best(sizes, shards) and len(made.starts) <= shards and made.starts[0] == 0
        cuts = [*made.starts, 10**6]
        loads = [[s for i, s in enumerate(sizes) if a <= i * 3 < b] for a, b in zip(cuts, cuts[1:])]
        assert all(len(x) == 1 or sum(x) <= made.capacity for x in loads) and sum(map(sum, loads)) == sum(sizes)


def test_documents(spark):
    docs, rows = awkward(spark)
    out = shard_by_bytes(docs, slot_rows=3).collect()
    assert len(out) == len(rows)
    of = {}
    for r in out:
        of.setdefault(r.doc_id, r)
    where = {}
    for key, text, *_ in rows:
        raw = (text or "").encode()
        assert (of[key].size, of[key].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert where.setdefault(raw, of[key].shard) == of[key].shard
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_by_bytes(docs.limit(0)).collect() == []


def test_hot_text_does_not_starve_other_shards(spark):
    rows = [(i, "same text of a large group") for i in range(300)] + [(1000 + i, f"text {i}" + "x" * (i % 7)) for i in range(600)]
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").sum("size").collect()
    loads = sorted(r[1] for r in out)
    assert len(loads) == 16 and loads[-1] == 300 * 27 and loads[-2] < 1.1 * sum(loads[:-1]) / 15


def test_one_id_does_not_fill_a_window(spark):
    """Null ids and one id of a third of all rows: the numbering stays gapless and its windows small."""
    rows = [(None, f"t{i % 50}") for i in range(400)] + [(7, f"t{i % 3}") for i in range(400)] + [(100 + i, f"u{i}") for i in range(400)]
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), slot_rows=20).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 1200 and all(sorted(s) == list(range(len(s))) for s in slots.values())
