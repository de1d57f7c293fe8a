"""A third of all rows, or all, on one key: no window, list or cell grows with them."""

import numpy as np
from pyspark.sql import functions as F

from footfall.llm import jaccard, langid, mixing, quotes, simhash
from footfall.llm.common import Scratch


def largest(table, *keys):
    return table.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_mix_of_rows_without_ids(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    docs = docs.unionByName(spark.range(900).select(F.lit(7).cast("long").alias("doc_id"), F.lit("d e").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source")))
    mix = mixing.Mix(share=(1, 2), max_epochs=1)
    made = mixing.mix_sources(docs, mix, prefix_rows=100).cache()
    total = made.agg(F.sum("tokens_taken").alias("t"), F.max("leaf_budget").alias("b"), F.count(F.lit(1)).alias("n")).first()
    assert (total.t, total.n) == (total.b, 100_900) and total.b == (100_000 * 4 + 900 * 3) // 2
    assert made.filter("partial_tokens not in (0, n_tokens)").count() <= 1
    made.unpersist()
    kept = mixing.apply_mix(docs, mix).count()
    assert 0 <= total.b - kept * 4 + 900 < 900 + 5 * 4


def test_null_ids_are_drawn_row_by_row(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("wort"), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    seen = spark.sparkContext.accumulator(0)

    def words(text):
        seen.add(1)
        return text.split()

    before, langid.words_of = langid.words_of, words
    try:
        model = langid.fit_languages(docs, sample=500)
    finally:
        langid.words_of = before
    assert model.languages == ["de"] and (seen.value == 0 or 300 < seen.value < 800)


def test_fingerprints_of_rows_without_ids_link(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, text), (5, "other words stand here and nowhere else at all"), (None, None), (9, "")]
    made = {(r.doc_id, r.component_id) for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert made == {(None, None), (5, 5), (None, 9), (9, 9)}
    # a row without an id between two others joins them
    prints = spark.createDataFrame([(0, 3), (3, None), (15, 8)], "fp long, rep long")
    scratch = Scratch(spark)
    links = simhash.close_links(prints.select("fp", F.col("fp").alias("rep")), scratch, 2, 512)
    assert {x for r in links.collect() for x in r} == {0, 3, 15}


def test_a_passage_in_every_turn_and_many_replies_to_one(spark):
    n = 100_000
    asked = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.lit(5).cast("long").alias("hash"), F.col("id").alias("turn"), F.col("id").alias("key"))
    held = asked.filter("turn % 3 = 0").select("conv_id", "hash", F.col("turn").alias("from_turn"))
    found = quotes.latest_before(asked, held, 1024)
    assert found.filter("coalesce(origin, -1) <> CASE WHEN turn = 0 THEN -1 ELSE (turn - 1) - (turn - 1) % 3 END").count() == 0 and found.count() == n
    made = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(4)).cast("long").alias("conv_id"), F.when(F.col("id") % 5 > 0, F.col("id") + 10).alias("turn"), F.lit("user").alias("role"),
        F.lit("ok").alias("body"), F.lit(1).alias("n_quotes"), F.lit(1).alias("n_linked"), F.lit(3).cast("long").alias("parent_turn"),
    )
    scratch = Scratch(spark)
    placed = quotes.reply_positions(scratch.numbered(made, "nth"), 1024, scratch).cache()
    by = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.countDistinct("position").alias("d")).collect()
    assert all((r.lo, r.hi, r.d) == (0, r.n - 1, r.n) for r in by) and sum(r.n for r in by) == n
    from pyspark.sql.window import Window

    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("position"))
    assert placed.withColumn("before", before).filter("turn < before or (turn is null and before is not null)").count() == 0
    placed.unpersist()


def test_heavy_sets_are_compared_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    base = list(rng.choice(words, 900))
    near = lambda share: " ".join(w if rng.random() > share else "x" + w for w in base)
    texts = [" ".join(base), near(0.01), near(0.015), near(0.2), " ".join(base[:400]), " ".join(base[:390]), " ".join(rng.choice(words, 60)), "a b c d e f", "a b c d e f g h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want = [min(want[a], want[b]) if x in (want[a], want[b]) else x for x in want]
    before = jaccard.LIGHT
    scratch = Scratch(spark)
    prints = scratch.keep(simhash.sketches(docs, "doc_id", "text", 5)).withColumnRenamed("doc_id", "node")
    for light in (before, 64):
        links = jaccard.similar_links(prints, docs.withColumnRenamed("doc_id", "node"), lambda t: simhash.shingle_hashes(t, 5), scratch, 0.8, 512, light)
        label = list(range(len(texts)))
        for _ in texts:
            for r in links.collect():
                low = min(label[r.a], label[r.b])
                label[r.a] = label[r.b] = low
        assert label == want, light
    assert len(set(want)) < len(texts)
