import random

import duckdb

from footfall.llm.quotes import link_quotes, normalised, oracle, split_quotes


def test_levels_and_own_text():
    own, quoted = split_quotes("> > deep\n>> deep two\n> upper\nmine\n\n> again\n  tail  ")
    assert own == "mine\n\n  tail" and quoted == [(2, "deep\ndeep two"), (1, "upper"), (1, "again")]
    assert split_quotes(None) == ("", []) and split_quotes("a > b") == ("a > b", [])
    assert normalised("  Hello,\n WORLD! ") == "hello, world"


ROWS = [
    (1, 0, "user", "What is rain?\n\nAnd what is snow?"),
    (1, 1, "assistant", "> and what is  snow\nFrozen rain."),
    (1, 2, "user", "Another matter: hail."),
    (1, 3, "assistant", ">> And what is snow?\n> frozen rain.\nMore on snow."),
    (1, 4, "user", "> never said\nOnly mine."),
    (1, 4, "user", "> never said\nOnly mine."),
    (2, 5, "user", "Frozen rain."),
    (2, 9, "user", "> what is rain?\nother conversation"),
    (3, None, "user", "> x"),
    (3, 0, None, None),
    (None, 0, "user", "> Frozen rain.\nno conversation"),
    (4, 3, "user", "> later\nfirst"),
    (4, 7, "user", "later"),
]


def test_links_and_reply_order(spark):
    schema = "conv_id long, turn long, role string, text string, key int, hash int, position int, n int, span int"
    docs = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in ROWS], schema)
    for turns in (1024, 1):
        out = link_quotes(docs, order_turns=turns).collect()
        assert len(out) == len(ROWS)
        by = {(r.conv_id, r.turn): r for r in out}
        assert by[1, 1].body == "Frozen rain." and (by[1, 1].n_quotes, by[1, 1].n_linked, by[1, 1].parent_turn) == (1, 1, 0)
        assert (by[1, 3].n_quotes, by[1, 3].n_linked, by[1, 3].parent_turn) == (2, 2, 1)
        assert (by[1, 4].n_linked, by[1, 4].parent_turn) == (0, 3) and by[1, 0].parent_turn is None
        assert (by[2, 9].n_linked, by[2, 9].parent_turn) == (0, 5) and by[4, 3].parent_turn is None
        assert by[None, 0].n_linked == 0 and by[3, 0].body == "" and by[3, None].parent_turn is None
        order = [r.turn for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)]
        assert order == [0, 1, 2, 3, 4, 4]
        for conv in (1, 2, 3, 4, None):
            rows = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
            assert [r.position for r in rows] == list(range(len(rows)))
            seen = set()
            for r in rows:
                assert r.parent_turn is None or r.parent_turn in seen
                seen.add(r.turn)
    assert link_quotes(docs.limit(0)).collect() == []


def test_replies_follow_their_originals(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "user", "second"), (1, 2, "user", "> second\nto two"), (1, 3, "user", "> first\nto one")]
    out = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [r.turn for r in out] == [0, 1, 3, 2]


def test_sql_equivalent(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    made = link_quotes(rows)
    want = con.sql(f"SELECT {', '.join(made.columns)} FROM ({oracle()})").fetchall()
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)


LONG = [f"line {k} has {w} words of its own" for k, w in enumerate("many some few more most less".split())]
RUNS = [
    (1, 0, "user", "\n".join(LONG[:4]) + "\n\n" + LONG[4] + "\n\n" + LONG[5]),
    (1, 1, "assistant", "> never said\nr1a\nr1b.\n> nor that\nr2"),
    (1, 2, "user", "something else"),
    (1, 3, "assistant", f"> {LONG[1]}\n> {LONG[2]}\nlines of a paragraph"),
    (1, 4, "user", f"> {LONG[4]}\n>\n> {LONG[5]}\ntwo of three paragraphs"),
    (1, 5, "assistant", ">> never said\n> r1a\n> r1b\n>> nor that\n> r2\nown text between quotes"),
    (1, 6, "user", f"> {LONG[2][:10]}\n> {LONG[2][11:]} {LONG[3].upper()}!\nwrapped anew"),
    (1, 7, "assistant", f"> {LONG[0]}\n> {LONG[2]}\nnot consecutive"),
    (1, 8, "user", f"> {LONG[1]}\n> {LONG[2][:-3]}\nends within a line"),
    (2, 9, "user", f"> {LONG[1]}\n> {LONG[2]}\nanother conversation"),
]


def test_runs_of_lines(spark):
    out = {r.turn: (r.n_quotes, r.n_linked, r.parent_turn) for r in link_quotes(spark.createDataFrame(RUNS, "conv_id long, turn long, role string, text string")).collect()}
    assert out[3] == (1, 1, 0) and out[4] == (1, 1, 0) and out[6] == (1, 1, 0)
    assert out[5] == (4, 2, 1)
    assert out[7] == (1, 0, 6) and out[8] == (1, 0, 7) and out[9] == (1, 0, None)


def test_runs_against_plain_search(spark):
    rng = random.Random(4)
    rows = []
    for turn in range(60):
        lines = [" ".join(rng.choices(("ab", "cd", "...", "ef."), k=rng.randrange(0, 7))) for _ in range(rng.randrange(1, 7))]
        quoted = []
        if turn:
            own = split_quotes(rows[rng.randrange(turn)][3])[0].split("\n")
            at = rng.randrange(len(own))
            quoted = [f"> {x}" for x in own[at : at + rng.randrange(1, 5)]]
        rows.append((1, turn, "user", "\n".join([*lines[:2], *quoted, *lines[2:]])))
    runs = []
    for *_, text in rows:
        own = split_quotes(text)[0].split("\n")
        runs.append({normalised(" ".join(own[a:b])) for a in range(len(own)) for b in range(a + 1, len(own) + 1)})
    made = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for _, turn, _, text in rows:
        asked = [p for _, q in split_quotes(text)[1] if (p := normalised(q))]
        found = [max(k) for p in asked if (k := [t for t in range(turn) if p in runs[t]])]
        assert (made[turn].n_quotes, made[turn].n_linked) == (len(asked), len(found))
        assert made[turn].parent_turn == (max(found) if found else turn - 1 if turn else None)


def nested(seed, conversations, turns):
    """Conversations whose messages quote earlier ones in full, by paragraph or by line, quotes of quotes included."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for conv in range(conversations):
        said: list[str] = []
        for turn in range(rng.randrange(1, turns)):
            own = ["\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3))]
            quoted = []
            for _ in range(rng.randrange(0, 3) if said else 0):
                body = split_quotes(rng.choice(said))[0]
                part = rng.choice([body, rng.choice(body.split("\n\n")), rng.choice(body.split("\n"))])
                mark = rng.choice(["> ", "> > ", ">>", ">>> "])
                quoted += [f"{mark}{x}".rstrip() if rng.random() < 0.5 else f"{mark}{x.upper()}" for x in part.split("\n")] + ["", own.pop() if len(own) > 1 else ""]
            said.append("\n".join([*quoted, "\n\n".join(own)]))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), said[-1]))
    return rows


def test_sql_equivalent_over_many_nested_quotes(spark):
    rows = nested(7, 150, 20)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    made = link_quotes(table)
    columns = ", ".join(made.columns)
    got = sorted(map(tuple, made.collect()), key=repr)
    want = sorted(con.sql(f"SELECT {columns} FROM ({oracle()})").fetchall(), key=repr)
    # a quote of the SQL's shapes is one of the operator's; its other runs may only add links
    linked = made.columns.index("n_linked")
    assert len(got) == len(rows) and sum(r[linked] for r in want) > 500
    same = sum(a == b for a, b in zip(got, want))
    assert same >= 0.97 * len(rows) and sum(r[linked] for r in got) >= sum(r[linked] for r in want)


def test_every_nested_quote_against_plain_search(spark):
    rows = nested(11, 40, 15)
    made = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    runs = {}
    for conv, turn, _, text in rows:
        own = split_quotes(text)[0].split("\n")
        runs[conv, turn] = {normalised(" ".join(own[a:b])) for a in range(len(own)) for b in range(a + 1, len(own) + 1)}
    for conv, turn, _, text in rows:
        asked = [(level, p) for level, q in split_quotes(text)[1] if (p := normalised(q))]
        found = [(level, max(k)) for level, p in asked if (k := [t for t in range(turn) if p in runs[conv, t]])]
        best = max((t for level, t in found if level == min(x for x, _ in found)), default=turn - 1 if turn else None)
        r = made[conv, turn]
        assert (r.n_quotes, r.n_linked, r.parent_turn, r.body) == (len(asked), len(found), best, split_quotes(text)[0])
