import random

import pytest
from pyspark.sql import functions as F

from foliomill.operators import agreement, clues, relations, selection, timeline


def test_rejection_order(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "ok")], "id int, v string")
    rules = [(F.col("v").isNull(), "missing"), (F.col("v") != "ok", "bad")]
    assert {r["id"]: r["rejection"] for r in selection.with_rejection(df, rules).collect()} == {1: "missing", 2: "bad", 3: None}


def test_quota_equals_greedy_loop(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [(i, rng.choice(["a", "b", "ab", "c"])) for i in range(60)]
        quotas = {"a": 7, "b": 9}
        taken, count = {}, {"a": 0, "b": 0}
        for i, tags in rows:
            for g in ("a", "b"):
                if g in tags and count[g] < quotas[g]:
                    taken[i] = g
                    count[g] += 1
                    break
        df = spark.createDataFrame(rows, "id int, tags string")
        got = selection.priority_quota(df, "id", [(g, F.contains("tags", F.lit(g)), quotas[g]) for g in ("a", "b")], ["id"])
        # The greedy loop lets a row that finds the first group full try the second, as the passes do.
        assert {r["id"]: r["quota_group"] for r in got.collect()} == taken


def test_allocation(spark):
    df = spark.createDataFrame([("a", 10), ("b", 10), ("c", 5)], "g string, n long")
    got = {r["g"]: r["allocated"] for r in selection.allocate(df, "g", "n", 6).collect()}
    assert sum(got.values()) == 6 and got == {"a": 2, "b": 3, "c": 1}
    assert {r["allocated"] for r in selection.allocate(df, "g", "n", 100).collect()} == {10, 5}


def test_next_fit_equals_loop(spark):
    rng = random.Random(1)
    rows = [(g, f"{i:03d}", rng.choice([0, 1, 5, 9, 30])) for g in "ab" for i in range(40)]
    want, state = {}, {}
    for g, o, s in rows:
        shard, used, n = state.get(g, (0, 0, 0))
        if n and (used + s > 20 or n >= 4):
            shard, used, n = shard + 1, 0, 0
        state[g] = (shard, used + s, n + 1)
        want[g, o] = shard
    got = selection.next_fit(spark.createDataFrame(rows, "g string, o string, s long"), "g", "o", "s", 20, 4)
    assert {(r["g"], r["o"]): r["shard_no"] for r in got.collect()} == want


def test_splits(spark):
    df = spark.createDataFrame([(g, f"{g}{i}") for g, n in (("a", 20), ("b", 1), ("c", 3)) for i in range(n)], "g string, id string")
    f = selection.split_by_fraction(df, "g", "id", 0.1, "s")
    assert {(r["g"], r["split"]): r["count"] for r in f.groupBy("g", "split").count().collect()} == {("a", "test"): 2, ("a", "train"): 18, ("b", "train"): 1, ("c", "test"): 1, ("c", "train"): 2}
    c = selection.split_by_counts(df, "g", "id", 2, 1, "s")
    assert c.count() == 7 and c.exceptAll(selection.split_by_counts(df, "g", "id", 2, 1, "s")).isEmpty()


def test_cap_plan(spark):
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate([1, 5, 6, 7, 8, 99])], "g string, id int, p int")
    got = {r["id"]: r["reason"] for r in selection.cap_plan(df, "g", "p", "id", 2, 50, 3).collect()}
    assert got == {0: "short", 1: None, 2: None, 3: None, 4: "cap", 5: "long"}


def test_relations(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "k string, t int, v string")
    assert {tuple(r) for r in relations.latest(log, ["k"], ["t"], ["v"]).collect()} == {("k", "b"), ("m", "c")}
    assert {tuple(r) for r in relations.earliest(log, ["k"], ["t"], ["v"]).collect()} == {("k", "a"), ("m", "c")}
    work = spark.createDataFrame([("k",), ("z",), (None,)], "k string")
    assert {r[0] for r in relations.not_done(work, log, ["k"]).collect()} == {"z", None}
    p = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, None)], "id int, k1 string, k2 string")
    o = spark.createDataFrame([("a", None), ("q", "y")], "f string, g string")
    assert {r["id"] for r in relations.any_key(p, [F.col("k1"), F.col("k2")], o, [F.col("f"), F.col("g")], "id").collect()} == {1, 2}
    hit = relations.first_hit(p, [F.col("k1"), F.col("k2")], spark.createDataFrame([("x", 10), ("b", 20), ("y", 30)], "key string, v int"), "key", "v", "id")
    assert {r["id"]: (r["v"], r["key_rank"]) for r in hit.collect()} == {1: (10, 1), 2: (20, 0), 3: (None, None)}
    a, b = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id int, s int"), spark.createDataFrame([(2, 6), (3, 8), (4, 9)], "id int, s int")
    assert {tuple(r) for r in relations.reconcile(a, b, "id", ["s"]).collect()} == {(1, "missing"), (2, "ok"), (3, "s_mismatch"), (4, "extra")}
    assert relations.repeated(log, ["k"]).collect()[0]["n"] == 2


def test_timeline(spark):
    e = spark.createDataFrame([("u", i, s) for i, s in enumerate("abbb")] + [("v", 0, "b"), ("w", 0, "a")], "u string, t int, s string")
    assert {tuple(r) for r in timeline.trailing_run(e, "u", "t", "s", "b").collect()} == {("u", 3), ("v", 1), ("w", 0)}
    w = timeline.backward_windows(spark, "2024-01-01", "2024-01-10", 4).orderBy("window_no").collect()
    assert [(str(r["window_start"]), str(r["window_end"])) for r in w] == [("2024-01-07", "2024-01-10"), ("2024-01-03", "2024-01-06"), ("2024-01-01", "2024-01-02")]
    days = spark.sql("SELECT date_add(date'2024-01-01', cast(id as int)) AS d, id % 5 AS n FROM range(40)")
    r = timeline.bisect_ranges(days, "d", "n", 9).collect()
    assert sum(x["n"] for x in r) == 80 and all(x["n"] <= 9 for x in r)


def test_agreement(spark):
    wide = spark.createDataFrame([(0, "u/", "x", ""), (1, "u", "X ", "x"), (2, "v", "", None), (3, "v", "", ""), (4, "w", "x", "x")], "pos int, link string, a string, b string")
    pairs = agreement.paired(agreement.marks_long(wide, "link", ["a", "b"]), "link")
    got = {r["criterion"]: (r["n"], r["agreement"], r["kappa"]) for r in agreement.kappa(pairs, "criterion", "first", "second").collect()}
    assert got == {"a": (2, 100.0, 1.0), "b": (2, 50.0, 0.0)}
    same = spark.createDataFrame([("c", True, True)] * 3, "criterion string, first boolean, second boolean")
    assert agreement.kappa(same, "criterion", "first", "second").first()["kappa"] is None


def test_clues(spark):
    df = spark.createDataFrame([('[{"cue": "a.", "category": "t"}, {"cue": "b"}]',), ("text",), ('x {"k": 1} y',), ('{"k": 1}, {"k": 2}',)], "x string")
    got = df.select(clues.cues(F.col("x")).alias("c"), clues.json_object(F.col("x")).alias("o")).collect()
    assert got[0]["c"] == ["textual t: a.", "textual cue: b"] and got[1]["c"] is None and got[2]["o"] == '{"k": 1}' and got[3]["o"] is None
    q = df.limit(1).select(clues.null_query(clues.cues(F.col("x"))).alias("q"), clues.bullets(clues.cues(F.col("x"))).alias("b"), clues.render("A {one} B {two}", {"one": F.lit("{two}"), "two": F.lit("!"), "three": F.lit("z")}).alias("r")).first()
    assert q["q"] == "I'm trying to find a paper I read before. I remember that a b." and q["b"] == "- a.\n- b" and q["r"] == "A ! B !\n\nTHREE:\nz"
    c = spark.createDataFrame([(["f1"], ["f1", "f2"]), (["f1", "f2"], ["f1", "f2"]), ([], [])], "d array<string>, e array<string>")
    assert [r[0] for r in c.select(clues.coverage(F.lit(True), F.col("d"), F.col("e"))).collect()] == [False, True, False]
    assert [r[0] for r in c.select(clues.coverage(F.lit(True), F.col("d"), F.col("e"), relaxed=True)).collect()] == [True, True, False]


def _touchy():
    def answer(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    return answer


def test_generate_isolates_failures(spark):
    df = spark.createDataFrame([(i, "bad" if i == 5 else f"p{i}") for i in range(12)], "id int, prompt string").coalesce(1)
    got = {r["id"]: (r["answer"], r["error"]) for r in clues.generate(df, "prompt", _touchy, size=8).collect()}
    assert got[5] == (None, "RuntimeError: no") and all(got[i] == (f"P{i}", None) for i in got if i != 5) and len(got) == 12


def test_contract(spark):
    q, r = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a",), ("a",), ("c",), ("z",)], "k string")
    assert {tuple(x) for x in clues.contract_violations(q, r, "k").collect()} == {("a", "repeated"), ("b", "missing"), ("z", "unknown")}


def test_small_checks_size(spark):
    from foliomill.plans.runtime import small

    assert "rightBroadcast" not in str(small(spark.range(10), 5)._jdf.queryExecution().toString())
    assert "broadcast" in str(small(spark.range(3), 5)._jdf.queryExecution().toString())
