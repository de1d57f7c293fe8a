"""One awkward table for every operator: nulls, empty and long texts, ties, copies, clashing columns."""

import random

WORDS = [f"{a}{b}" for a in ("ba", "ko", "ri", "Su", "mé", "no") for b in ("lan", "ter", "vo", "ß", "dis", "que")]


def texts(seed=1, n=40):
    rng = random.Random(seed)
    prose = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 120))) for _ in range(n)]
    return [None, "", " ", "a", prose[0], prose[0], " ".join(rng.choices(WORDS, k=60000)), "x\n> y\tz\x0b\x00\x1c漢字 😀 ", *prose]


def awkward(spark, extra=()):
    """documents with clashing extra columns, a null id, a repeated row and a hot source."""
    made = [*texts(), *extra]
    rows = [(i, t, [None, "en", "de", "fr"][i % 4], None if i == 3 else "src0" if i % 3 else f"src{i}", i) for i, t in enumerate(made)]
    rows += [(None, "null id", "en", "src1", 0), rows[9]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ", size long, shard int, fp string, window int, at int, starts int, label int, id string, media string, token long, n long, tokens long, docs long"
    width = clash.count(",")
    docs = spark.createDataFrame([(*r, *[None] * width) for r in rows], schema + clash)
    return docs, [(r[0], r[1], r[2], r[3]) for r in rows]
