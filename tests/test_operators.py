"""Operators on literal rows and by invariants, where SQL says nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.tables import table_start
from quillspark.operators import chunking as C
from quillspark.operators import structure as S
from quillspark.operators import corpus, evaluation, judging, markup, models
from quillspark.operators import retrieval as R
from quillspark.sources import sinks
from quillspark.streaming import turns


def markdown(rng: random.Random) -> str:
    parts = ["# Title"]
    for _ in range(rng.randint(1, 8)):
        parts.append("#" * rng.randint(2, 4) + " Part " + str(rng.randint(0, 99)))
        if rng.random() < 0.6:
            parts.append(" ".join(rng.choice(["One", "two.", "three", "four!", "five"]) for _ in range(rng.randint(1, 400))))
        if rng.random() < 0.5:
            parts.append("| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * rng.randint(1, 40)} |" for i in range(rng.randint(1, 60))))
    return "\n\n".join(parts)


def test_structured_chunks_cover_and_fit():
    rng = random.Random(4)
    for _ in range(60):
        text = markdown(rng)
        made = S.Structure(text, S.Rules(500, 60))
        seen = set()
        for c in made.chunks:
            held = made.blocks[c.first : c.last + 1]
            seen.update(range(c.start, c.end))
            assert c.end - c.start + len(c.header) <= 500 + C.MIN_CHARS
            assert c.header in ("", "| a | b |\n|---|---|")
            # Rows stand below their header, which is repeated where a table goes on.
            assert c.header or all(b.kind != "table" or c.start <= b.start for b in held)
        assert all(c.isspace() for i, c in enumerate(text) if i not in seen)
        # A heading ends a chunk only where nothing stands between it and the next section's.
        for x, y in zip(made.chunks, made.chunks[1:], strict=False):
            last, first = made.blocks[x.last], made.blocks[y.first]
            assert last.kind != "heading" or (first.kind == "heading" and first.level <= 2)


def test_fixed_spans_advance():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 400)))
        spans = list(C.fixed_spans(text, 60, 20))
        assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
        assert all(a < c and c <= b for (a, b), (c, _) in zip(spans, spans[1:], strict=False))
    with pytest.raises(ValueError, match="smaller"):
        list(C.fixed_spans("x", 10, 10))


def test_filters(spark):
    df = spark.createDataFrame([("a", 1, True), ("b", 5, False), (None, None, None)], "s string, n int, b boolean")
    both = R.QueryFilter(any_of=(("s", ("a", "b")),)).narrowed(R.QueryFilter(between=(("n", 2, None),)))
    assert [r["s"] for r in df.filter(both.column(df)).collect()] == ["b"]
    for one, other in (
        (R.QueryFilter(equals=(("s", "a"),)), R.QueryFilter(equals=(("s", "b"),))),
        (R.QueryFilter(any_of=(("s", ("a",)),)), R.QueryFilter(any_of=(("s", ("b",)),))),
        (R.QueryFilter(between=(("n", 5, None),)), R.QueryFilter(between=(("n", None, 4),))),
    ):
        with pytest.raises(ValueError, match="contradict"):
            one.narrowed(other)
    with pytest.raises(ValueError, match="unknown"):
        R.QueryFilter(equals=(("zz", 1),)).column(df)
    with pytest.raises(ValueError, match="no integers"):
        R.QueryFilter(between=(("b", 0, 1),)).column(df)


def test_fusion_keeps_first_seen_order(spark):
    rows = [("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 1, 1, "c"), ("q", 1, 2, "b"), ("r", 0, 1, "z")]
    lists = spark.createDataFrame(rows, "query_id string, list int, rank int, id string")
    got = [(r["query_id"], r["id"]) for r in R.fuse(lists, 3).orderBy("query_id", "rank").collect()]
    assert got == [("q", "b"), ("q", "a"), ("q", "c"), ("r", "z")]
    assert R.fuse(lists.limit(0), 3).count() == 0


def test_containment_by_anchor(spark, monkeypatch):
    """The equi-join finds what the broadcast join finds."""
    rng = random.Random(6)
    words = ["aa", "bb", "cc", "dd"]
    bodies = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    quotes = [(i, " ".join(rng.choice(words) for _ in range(n))[rng.randint(0, 1) :]) for i, n in enumerate([1, 2, 4, 5, 5, 5, 6, 6, 7, 7, 8, 9])]
    b, q = spark.createDataFrame(bodies, "d int, body string"), spark.createDataFrame(quotes, "q int, quote string")
    want = sorted((d, i) for d, body in bodies for i, quote in quotes if quote in body)
    assert sorted((r["d"], r["q"]) for r in judging.containment(b, q).collect()) == want
    monkeypatch.setattr(judging, "QUOTES", 5)
    assert sorted((r["d"], r["q"]) for r in judging.containment(b, q).collect()) == want


def test_many_short_quotes(spark, monkeypatch):
    """10,000 quotes of one to four words, in one automaton and in many, against a look at each."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 4))).strip() or "b"
    quotes = [(i, " ".join(word() for _ in range(1 + i % 4))) for i in range(10_000)] + [(-1, ""), (-2, None), (-3, "a")]
    texts = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(60, None), (61, ""), (62, "a")]
    want = sorted((k, i) for k, body in texts for i, quote in quotes if body and quote and quote in body)
    q, b = spark.createDataFrame(quotes, "q long, quote string"), spark.createDataFrame(texts, "d long, body string")
    for most in (65_536, 3000):
        monkeypatch.setattr(judging, "QUOTES", most)
        assert sorted((r["d"], r["q"]) for r in judging.containment(b, q).select("d", "q").collect()) == want
    monkeypatch.setattr(judging, "CHARACTERS", 20_000)
    assert judging.containment(b, q).count() == len(want)
    assert judging.containment(b, q.limit(0)).count() == 0 and judging.containment(b.limit(0), q).count() == 0


def test_guards_raise(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 1.0)], "id int, value double")
    assert evaluation.pair_by_id(a, a, ["id"]).count() == 2
    with pytest.raises(Exception, match="same samples"):
        evaluation.pair_by_id(a, a.limit(1), ["id"]).collect()
    with pytest.raises(Exception, match="repeated id"):
        corpus.upserted(a, a.unionByName(a).withColumn("id", F.lit(7)), "id").collect()


def test_related(spark):
    rows = [(i, i // 2) for i in range(8)] + [(1, 100), (2, 100), (9, 200), (8, 200)] + [(i, 300) for i in range(50, 60)]
    got = dict(map(tuple, corpus.related(spark.createDataFrame(rows, "item int, key int")).collect()))
    assert got == {**{i: 0 for i in (0, 1, 2, 3)}, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, **{i: 50 for i in range(50, 60)}}


def plain_groups(rows):
    """Item -> least item of its group, one link after the other."""
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i, k in rows:
        if k is not None:
            a, b = sorted((top(i), top(first.setdefault(k, i))))
            root[b] = a
    return {i: top(i) for i in root}


def test_related_shapes(spark):
    """Chains, stars, repeated rows, and items without a key, which are groups of their own."""
    rng = random.Random(3)
    ids = rng.sample(range(1000), 60)
    chain = [(ids[j], 2000 + j + s) for j in range(60) for s in (0, 1)]
    star = [(1500, k) for k in range(3000, 3030)] + [(1501 + j, 3000 + j) for j in range(30)]
    loose = [(1000 + rng.randrange(80), 4000 + rng.randrange(90)) for _ in range(70)]
    rows = chain + star + loose + loose[:9] + [(1900, None), (1901, None), (1901, 5000), (1902, 5000)]
    rng.shuffle(rows)
    got = list(map(tuple, corpus.related(spark.createDataFrame(rows, "item int, key int")).collect()))
    assert len(got) == len(dict(got)) and dict(got) == plain_groups(rows)
    assert corpus.related(spark.createDataFrame([], "item int, key int")).collect() == []


def test_related_keeps_rows_once(spark, monkeypatch):
    """Rounds are on keys: the rows and their items aren't kept anew by each."""
    kept = []
    saved = corpus.saved

    def counted(df, name):
        out = saved(df, name)
        kept.append(out.count())
        return out

    monkeypatch.setattr(corpus, "saved", counted)
    rng = random.Random(4)
    rows = [(i, rng.randrange(60)) for i in range(900) for _ in range(3)]
    got = dict(map(tuple, corpus.related(spark.createDataFrame(rows, "item int, key int")).collect()))
    assert got == plain_groups(rows) and sum(kept) < len(rows) + 900


def test_markup():
    text, headings, table = markup.read_page("<html><style>x{}</style><h1>A&nbsp;B</h1><p>one<br>two  three</p><table><tr><th>k</th><th>v|w</th></tr><tr><td>1</td><td></td></tr></table><script>no</script></html>")
    assert text == "A B\none\ntwo three\nk | v|w\n1 |" and headings == [(1, "A B")]
    assert table == ["| k | v\\|w |", "|---|---|", "| 1 |  |"]


def test_markup_tables():
    """Each table has its own rule and bounds; rows of a table go on after one inside a cell."""
    page = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><p>x</p><table><tr><th>c</th></tr><tr><td>3</td></tr></table><table></table>"
    assert markup.read_page(page)[2] == ["| a | b |", "|---|---|", "| 1 | 2 |", "", "| c |", "|---|", "| 3 |"]
    page = "<table><tr><td>o<table><tr><td>i</td><td>j</td></tr></table></td></tr><tr><td>p</td></tr></table><tr><td>q</td></tr>"
    assert markup.read_page(page)[2] == ["| o i \\| j |", "|---|", "| p |", "", "| i | j |", "|---|---|", "", "| q |", "|---|"]


def test_table_start(spark):
    text = "intro\n| a |\n|---|\n\n| 1 |\nend"
    at = {i: spark.range(1).select(table_start(F.lit(text), F.lit(i))).first()[0] for i in (0, 6, 8, 12, 19, 21, 25)}
    assert at == {0: None, 6: None, 8: "mid_row", 12: "later_row", 19: "later_row", 21: "mid_row", 25: None}


def test_calculator():
    assert models.calculate("1" * 600)[1] == "expression too long" and models.calculate("9 ** 99")[1] == "exponent too large"
    assert models.calculate("True + 1")[0] is None and models.calculate("0.1 + 0.2")[0] == "0.3"


def test_embedding_is_unit_and_stable():
    a = models.stub_embed(["x y", "y x", ""])
    assert (a[0] == a[1]).all() and a[2].sum() == 0 and abs((a[0] ** 2).sum() - 1) < 1e-6


def test_stream_in_batches(spark, tmp_path):
    """Many files, one per batch, give what one batch query gives."""
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "in/*.parquet")
    key = lambda df: sorted(map(str, df.select("window_start", "event_type", "n").collect()))
    assert key(turns.run_windowed(spark, path, rows.schema, "6 hours")) == key(turns.windowed(rows, "6 hours"))
    assert turns.run_totals(spark, path, rows.schema).agg(F.sum("turns")).first()[0] == rows.count()


def test_fan_out(spark):
    seen = []

    def broken(batch, number):
        raise RuntimeError("first")

    with pytest.raises(RuntimeError, match="first"):
        sinks.fan_out([broken, lambda b, n: seen.append((n, b.count()))])(spark.range(3), 5)
    assert seen == [(5, 3)]


def test_innermost(spark):
    """Spans of seconds and of years in the same cells, against a look at every pair."""
    import random

    from quillspark.operators import turnlog

    rng = random.Random(9)
    spans = [(i, f"u{i % 3}", s := rng.choice([0.0, 7.5, rng.uniform(-50, 4e7)]), s + rng.choice([0.0, 0.5, 1.0, 3.0, 900.0, 3.2e7, -1.0, rng.uniform(0, 1e6)])) for i in range(300)]
    nodes = [*spans, *[(1000 + i, f"u{i % 4}", s, s) for i, (_, _, s, _) in enumerate(spans[:60])]]
    df = lambda rows, id: spark.createDataFrame(rows, f"{id} long, user string, start double, end double")
    want = {}
    for n, u, s, e in nodes:
        inside = [(b - a, k) for k, v, a, b in spans if v == u and k != n and a <= s and b >= e and b >= a]
        if inside:
            want[n] = min(inside)[1]
    for width in (1.0, 3600.0, 1e9):
        got = turnlog.innermost(df(nodes, "node"), df(spans, "span"), "user", width)
        assert {r["node"]: r["parent"] for r in got.collect()} == want
    # A year among cells of a second: the joins see two rows of it.
    year = df([(1, "u", 0.5, 31_557_600.5)], "span")
    assert turnlog.innermost(df([(2, "u", 5.0, 6.0)], "node"), year, "user", 1.0).count() == 1
