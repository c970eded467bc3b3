import random

import pytest
from pyspark.sql import functions as F

from foliomill.operators import figures, ranking, selection
from foliomill.streaming import incremental


@pytest.mark.parametrize("most", [None, 5])
def test_ranks_of_a_hot_group(spark, most):
    """A group with most of the rows, a null group and small ones: the same places whether a window or ranges find them."""
    rng = random.Random(1)
    rows = [("hot", i) for i in range(300)] + [(None, i) for i in range(20)] + [(f"k{i % 7}", i) for i in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = {(r["k"], r["v"]): r["rank"] for r in ranking.ranked(df, ["k"], [F.col("v").desc()], most=most).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert got == {(k, v): i + 1 for k, vs in groups.items() for i, v in enumerate(sorted(vs, reverse=True))}
    whole = [r["rank"] for r in ranking.ranked(df, [], [F.col("k"), F.col("v")], most=most).collect()]
    assert sorted(whole) == list(range(1, len(rows) + 1))
    assert ranking.ranked(df.limit(0), ["k"], [F.col("v")], most=most).count() == 0


def test_neighbours_and_blocks(spark):
    df = spark.createDataFrame([("a", i) for i in range(25)] + [(None, 1)], "k string, v int")
    rows = ranking.ranked(df, ["k"], [F.col("v")], "place", most=4)
    got = {(r["k"], r["v"]): r["x"] for r in ranking.beside(rows, ["k"], "place", "v", 1, "x").collect()}
    assert got == {**{("a", i): i + 1 for i in range(24)}, ("a", 24): None, (None, 1): None}
    blocks = {(r["k"], r["block"]): r["items"] for r in ranking.in_blocks(df, ["k"], [F.col("v")], F.col("v"), 10, most=4).collect()}
    assert blocks == {("a", 0): list(range(10)), ("a", 1): list(range(10, 20)), ("a", 2): list(range(20, 25)), (None, 0): [1]}


def test_splits_and_caps_of_hot_strata(spark):
    df = spark.createDataFrame([("a", f"d{i}", i) for i in range(120)] + [("b", "x", 3)], "g string, d string, pages int")
    for f, args in ((selection.split_by_fraction, (0.1, "s")), (selection.split_by_counts, (30, 10, "s"))):
        plain, hot = ({tuple(r) for r in f(df, "g", "d", *args, **k).select("g", "d", "split").collect()} for k in ({}, {"most": 10}))
        assert plain == hot and plain
    plain, hot = ({tuple(r) for r in selection.cap_plan(df, "g", "pages", "d", 2, 110, 40, **k).select("d", "action", "reason").collect()} for k in ({}, {"most": 10}))
    assert plain == hot and sum(a == "keep" for _, a, _ in plain) == 41


@pytest.mark.parametrize("room, seen", [(2, 5), (9, 10)])
def test_scan_stops_only_when_all_quotas_are_full(spark, room, seen):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, tag string")
    groups = [("a", F.col("tag") == "a", 3), ("b", F.col("tag") == "b", room)]
    got = selection.until_filled(df, F.col("id") >= 0, "id", groups, ["id"]).collect()
    assert len(got) == seen


def test_absent_rows(spark):
    """As the loop that keeps a row if none of its keys is taken."""
    rng = random.Random(7)
    for n in (5, 40):
        rows = [(i, rng.choice([None, *(f"q{k}" for k in range(n // 2))]), rng.choice([None, *(f"p{k}" for k in range(n // 2))])) for i in range(n)]
        taken, want = {"q:q0"}, []
        for i, a, b in rows:
            keys = {f"q:{a}"} * (a is not None) if False else ({f"q:{a}"} if a else set()) | ({f"p:{b}"} if b else set())
            if not keys & taken:
                taken |= keys
                want.append(i)
        df = spark.createDataFrame(rows, "i int, a string, b string")
        keys = [F.concat(F.lit("q:"), "a"), F.concat(F.lit("p:"), "b")]
        old = spark.createDataFrame([("q0", None)], "a string, b string")
        assert sorted(r["i"] for r in incremental.absent(df, keys, ["i"], old).collect()) == want


def test_appends(spark, tmp_path):
    path = str(tmp_path / "t")
    keys = [F.concat(F.lit("q:"), "a"), F.concat(F.lit("p:"), "b")]
    one = spark.createDataFrame([(1, "x", "u"), (2, "x", "v"), (3, "y", "v")], "i int, a string, b string")
    assert sorted(r["i"] for r in incremental.append_absent(one, path, keys, ["i"]).collect()) == [1, 3]
    two = spark.createDataFrame([(4, "x", "w"), (5, "z", "w")], "i int, a string, b string")
    assert [r["i"] for r in incremental.append_absent(two, path, keys, ["i"]).collect()] == [5]


@pytest.mark.parametrize("text, pages", [('[{"page_idx": 0}, {"page_idx": 4}, {"type": "x"}]', 5), ("[[], [{}], []]", 3), ("[]", None), ("[{}]", None), ("no json", None), (None, None), ('[[{"a": 1}], [{"b": 2}]]', 2)])
def test_page_total(spark, text, pages):
    assert spark.createDataFrame([(text,)], "x string").select(figures.page_total(F.col("x"))).first()[0] == pages


def test_best_files(spark):
    rows = [("a", "a/x.md", 3), ("a", "a/b/y.md", 9), ("a", "a/z.md", 9), ("a", "a/0_content_list.json", 5), ("a", "a/1_content_list_v2.json", 5), ("b", "b/e.md", 0), ("b", "b/k_content_list.json", 2), ("b", "b/content.json", 2)]
    got = {r["folder"]: (r["markdown"], r["content"]) for r in figures.best_files(spark.createDataFrame(rows, "folder string, path string, length long")).collect()}
    assert got == {"a": ("a/b/y.md", "a/1_content_list_v2.json"), "b": (None, "b/k_content_list.json")}


def test_figure_window(spark):
    df = spark.createDataFrame([("p2", ["c"]), ("p1", ["a", "b"]), ("p0", []), ("p3", ["d", "e"])], "paper string, figures array<string>")
    got = [(r["figure"], r["figure_index"]) for r in figures.figure_window(df, [F.col("paper")], "figures", 1, 5, 3, most=2).orderBy("figure_index").collect()]
    assert got == [("b", 1), ("c", 2), ("d", 3)]


@pytest.mark.parametrize("most", [1, 3, 12, 500])
def test_next_fit_of_a_hot_group(spark, most):
    """As the plain fold, for groups that are cut into ranges: sizes of all kinds, equal ones, none, and larger than the limit."""
    rng = random.Random(most)
    rows = [("hot", i, rng.choice([0, 5, 10, 10, 35, 60, 140])) for i in range(700)] + [("even", i, 25) for i in range(200)] + [("a", i, 99) for i in range(3)] + [("z", 0, 1), (None, 1, 1), ("z", 2, None)]
    want = {}
    for g in ("hot", "even", "a", "z"):
        shard = used = n = 0
        for _, i, s in sorted(r for r in rows if r[0] == g and r[2] is not None):
            if n > 0 and (used + s > 100 or n >= most):
                shard, used, n = shard + 1, 0, 0
            used, n = used + s, n + 1
            want[g, i] = shard
    df = spark.createDataFrame(rows, "g string, i int, s long").repartition(4)
    for hot in (None, 50):
        got = {(r["g"], r["i"]): r["shard_no"] for r in selection.next_fit(df, "g", "i", "s", 100, most, hot).collect()}
        assert got == want
