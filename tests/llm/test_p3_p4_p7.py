import datetime as dt
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foliomill.plans import runtime
from foliomill.llm import p3_overlap, p4_sample, p7_mix

T0 = dt.datetime(2025, 1, 1)
PDF = "document_id string, source string, original_relative_path string, sha256 string, metadata struct<title:string,year:int,license:string,doi:string,abstract:string>, discovered_at timestamp_ntz, entry_id string, split string"
IDX = "entry_id long, split string, entry string, document_id string"


@pytest.mark.parametrize("given", ["ACL/vol 5/Ü a.pdf", "acl\\vol 5\\Ü a.PDF", " ./ACL//vol%205/./Ü a.pdf ", "/ACL/x/../vol 5/Ü a.pdf"])
def test_canonical_path(given):
    assert p3_overlap.canonical_path(given) == "acl/vol 5/ü a.pdf"


def test_path_without_content():
    assert p3_overlap.canonical_path(None) is None and p3_overlap.canonical_path("  ") is None


def test_possible_paths():
    assert p3_overlap.possible_paths("data/Sets/ACL/vol 1/a.pdf") == ["data/sets/acl/vol 1/a.pdf", "sets/acl/vol 1/a.pdf", "acl/vol 1/a.pdf", "vol 1/a.pdf"]
    assert p3_overlap.possible_paths("a.pdf") == ["a.pdf"] and p3_overlap.possible_paths(None) == []


def test_common_share():
    a = "the quick brown fox jumps over the lazy dog today".split()
    assert p3_overlap.common_share(a, a[:8]) == 0.8 and p3_overlap.common_share(a, []) == 0.0 and p3_overlap.common_share(a, a) == 1.0


def text(rng, n=90):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.mark.parametrize("broadcast", [True, False])
def test_overlaps_equal_brute_force(spark, monkeypatch, broadcast):
    """Whether sides are broadcast or shuffled."""
    if not broadcast:
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    rng = random.Random(8)
    docs, entries = [], []
    base = [text(rng) for _ in range(40)]
    near = []
    for b in base[:15]:
        w = b.split()
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
        near.append(" ".join(w).upper().replace(" ", ",  "))
    rows = [(f"d{i}", x) for i, x in enumerate(base + near)] + [("same1", base[0]), ("null1", None), ("null2", None), ("empty", "")]
    for k, (d, x) in enumerate(rows):
        docs.append((d, rng.choice(["ACL", " acl", "Biology "]).strip() if k % 2 else "ACL", f"p/{d}.pdf", None if d.startswith("null") else f"sha{min(k, 50)}", ("t", 2000, None, None, x), T0 + dt.timedelta(hours=k), "9", "q"))
    docs.append(docs[0])
    docs.append((docs[3][0], docs[3][1], docs[3][2], docs[3][3], ("t", 1, None, None, "old text"), T0 - dt.timedelta(days=1), "9", "q"))  # an earlier discovery
    for k, d in enumerate(docs[: len(rows)]):
        entries.append((2 * k, rng.choice(["train", "test"]), f"{d[1]}/{d[2]}", "z"))
        if k % 3 == 0:
            entries.append((2 * k + 1, rng.choice(["train", "test"]), f"./some/{d[1].lower()}//{d[2]}" if k % 2 else f"{d[1].lower()}/./{d[2]}", "z"))
    entries += [(9001, "test", "ACL/gone.pdf", "z"), (9002, "test", None, "z"), (None, "test", "ACL/p/d0.pdf", "z")]
    got = {(r["entry_id_a"], r["entry_id_b"]) for r in p3_overlap.overlaps(spark.createDataFrame(entries, IDX), spark.createDataFrame(docs, PDF)).collect()}
    last = {d[0]: d for d in docs[: len(rows)]}
    by_path = {p3_overlap.canonical_path(f"{d[1]}/{d[2]}"): d[0] for d in last.values()}
    named = [(e, s, next((by_path[p] for p in p3_overlap.possible_paths(x) if p in by_path), None)) for e, s, x, _ in entries if e is not None]
    want = set()
    for e, s, d in named:
        for f, t, g in named:
            if s == "train" and t == "test" and d and g:
                x, y = last[d], last[g]
                words = [p3_overlap.abstract_words(v[4][4] or "") for v in (x, y)]
                if d == g or x[3] and x[3] == y[3] or p3_overlap.common_share(*words) >= 0.8:
                    want.add((min(e, f), max(e, f)))
    assert got == want and want
    none = p3_overlap.overlaps(spark.createDataFrame([], IDX), spark.createDataFrame([], PDF))
    assert none.count() == 0


def test_hot_passages_meet_through_runs(spark, monkeypatch):
    """With every gram taken for widespread, near-copies are still found by runs of selected grams."""
    monkeypatch.setattr(p3_overlap, "HOT", 0)
    rng = random.Random(3)
    x = text(rng, 1500)
    y = x.replace(x.split()[50], "changed", 1)
    docs = [(d, "ACL", f"{d}.pdf", d, ("t", 1, None, None, a), T0, "9", "q") for d, a in (("a", x), ("b", y), ("c", text(rng, 1500)))]
    entries = [(1, "train", "ACL/a.pdf", "z"), (2, "test", "ACL/b.pdf", "z"), (3, "test", "ACL/c.pdf", "z")]
    got = p3_overlap.overlaps(spark.createDataFrame(entries, IDX), spark.createDataFrame(docs, PDF)).collect()
    assert [(r["entry_id_a"], r["entry_id_b"], r["kind"]) for r in got] == [(1, 2, "abstract")]


def test_hot_family_equals_brute_force(spark):
    """A family of 120 variants of one abstract, at about 5 % edits each: nearly all its grams are widespread."""
    rng = random.Random(11)
    base = text(rng, 115).split()
    variants = [" ".join(f"new{rng.randrange(9999)}" if rng.random() < 0.05 else w for w in base) for _ in range(120)]
    docs = [(f"d{i}", "ACL", f"{i}.pdf", f"sha{i}", ("t", 1, None, None, x), T0, "9", "q") for i, x in enumerate(variants + [text(rng, 115) for _ in range(40)])]
    entries = [(i, "test" if i % 3 == 0 else "train", f"ACL/{i}.pdf", "z") for i in range(len(docs))]
    got = {(r["entry_id_a"], r["entry_id_b"]) for r in p3_overlap.overlaps(spark.createDataFrame(entries, IDX), spark.createDataFrame(docs, PDF)).collect()}
    words = [p3_overlap.abstract_words(d[4][4]) for d in docs]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if (i % 3 == 0) != (j % 3 == 0) and p3_overlap.common_share(words[i], words[j]) >= 0.8}
    assert len(want) > 3000 and got == want


@pytest.mark.parametrize("boilerplate", [0, 12])
def test_recall_at_every_length(spark, boilerplate):
    """Abstracts of 10 to 200 words with a tenth to a fifth of the words replaced, some with a passage that all share: of the pairs with a common share
    of 0.8, all of the short ones and 98 % of the others are found."""
    rng = random.Random(5)
    shared = [f"notice{i}" for i in range(boilerplate)]
    docs, want = [], {}
    for n in (10, 15, 20, 25, 30, 40, 45, 60, 80, 100, 101, 130, 200):
        made = 0
        while made < 60:
            x = [f"w{rng.randrange(5000)}" for _ in range(n)]
            edits = rng.choice([0.1, 0.12, 0.16, 0.18])
            y = [f"e{rng.randrange(5000)}" if rng.random() < edits else w for w in x]
            x, y = shared + x, shared + y
            if p3_overlap.common_share(x, y) >= 0.8 and x != y:
                want[len(docs), len(docs) + 1] = n
                docs += [" ".join(x), " ".join(y)]
                made += 1
    rows = [(f"d{i}", "ACL", f"{i}.pdf", f"sha{i}", ("t", 1, None, None, x), T0, "9", "q") for i, x in enumerate(docs)]
    entries = [(i, "test" if i % 2 else "train", f"ACL/{i}.pdf", "z") for i in range(len(docs))]
    got = {(r["entry_id_a"], r["entry_id_b"]) for r in p3_overlap.overlaps(spark.createDataFrame(entries, IDX), spark.createDataFrame(rows, PDF)).collect()}
    lost = Counter(n for pair, n in want.items() if pair not in got)
    assert not [n for n in lost if n + boilerplate <= p3_overlap.SHORT], lost
    assert max(lost.values(), default=0) <= 2 and lost.total() <= 0.02 * len(want), lost


def test_report_counts_classes(spark):
    """As the pairs listed one by one, and a file of which thousands of copies are in either split."""
    rng = random.Random(6)
    texts = [text(rng) for _ in range(12)] + [None]
    docs = [(f"d{i}", f"S{i % 2}", f"{i}.pdf", f"sha{i % 20}", ("t", 1, None, None, texts[i % 13]), T0, "9", "q") for i in range(30)]
    docs[2] = (*docs[2][:4], ("t", 1, None, None, texts[3] + " more words"), *docs[2][5:])
    entries = [(i, rng.choice(["train", "test"]), f"S{i % 30 % 2}/{i % 30}.pdf", "z") for i in range(50)]
    tables = spark.createDataFrame(entries, IDX), spark.createDataFrame(docs, PDF)
    got = {(r["split"], r["source"]): r for r in p3_overlap.report(*tables).collect()}
    pairs = p3_overlap.overlaps(*tables).collect()
    want = {}
    for r in pairs:
        for x in "ab":
            want.setdefault((r[f"split_{x}"], r[f"source_{x}"]), set()).add(r[f"entry_id_{x}"])
    assert {k: r["n_records"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert sum(r["pairs_file"] for r in got.values()) == 2 * sum(r["kind"] == "file" for r in pairs) > 0
    many = spark.createDataFrame([(i, "train" if i % 2 else "test", "S0/0.pdf", "z") for i in range(20_000)], IDX)
    got = p3_overlap.report(many, tables[1]).collect()
    assert {(r["split"], r["n_records"], r["pairs_file"], r["pairs_bytes"]) for r in got} == {("train", 10_000, 10**8, 10**8), ("test", 10_000, 10**8, 10**8)}


@pytest.mark.parametrize("hot", [0, 100, 10**9])
@pytest.mark.parametrize("fill", [0, 140])
def test_widespread_passage_alone_links(spark, monkeypatch, hot, fill):
    """Near-copies whose only common run of words is a passage of one or two selected grams are found whether or not many others have it, and however
    its pairs are joined."""
    monkeypatch.setattr(p3_overlap, "HOT", hot)
    rng = random.Random(12)
    passage = [f"notice{i}" for i in range(10)]
    x = passage + [f"w{rng.randrange(5000)}" for _ in range(90)]
    y = [f"e{i}" if i >= 10 and i % 5 == 0 else w for i, w in enumerate(x)]
    assert p3_overlap.common_share(x, y) == 0.82
    texts = [x, y] + [passage + [f"w{rng.randrange(5000)}" for _ in range(90)] for _ in range(fill)]
    docs = [(f"d{i}", "ACL", f"{i}.pdf", f"sha{i}", ("t", 1, None, None, " ".join(w)), T0, "9", "q") for i, w in enumerate(texts)]
    entries = [(i, "test" if i % 2 else "train", f"ACL/{i}.pdf", "z") for i in range(len(docs))]
    got = p3_overlap.overlaps(spark.createDataFrame(entries, IDX), spark.createDataFrame(docs, PDF)).collect()
    assert [(r["entry_id_a"], r["entry_id_b"], r["kind"]) for r in got] == [(0, 1, "abstract")]


def test_blocks_meet_as_brute_force():
    """Blocks over several batches give the pairs that fit, each gram's and block's by itself."""
    rng = np.random.default_rng(7)
    rows = [(k, k % 2, t, int(h), int(w), *map(int, m)) for k in (3, 4) for t in (0, 1) for h, w, m in zip(rng.choice(40, 30, False), rng.integers(20, 60, 30), rng.integers(-(1 << 63), (1 << 63) - 1, (30, 4)) & rng.integers(0, 1 << 12, (30, 1)))]
    names = ["key", "block", "test", "abstract_hash", "words", "l0", "l1", "l2", "l3"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + 17]]) for k in range(0, len(rows), 17)]
    got = sorted((r["a"], r["b"]) for b in p3_overlap.blocks_met(iter(batches)) for r in b.to_pylist())
    bits = lambda m: sum((x % (1 << 64)).bit_count() for x in m)
    alone = lambda r, s: bits([x & ~y for x, y in zip(r[5:], s[5:])])
    want = []
    for r in rows:
        for s in rows:
            need = p3_overlap.SHARE * max(r[4], s[4]) - 1e-6
            if r[:2] == s[:2] and r[2] < s[2] and r[3] != s[3] and min(r[4], s[4]) >= need and alone(r, s) <= r[4] - need and alone(s, r) <= s[4] - need:
                want.append((r[3], s[3]))
    assert got == sorted(want) and 20 < len(want) < 1500


def test_thinned_owners_still_share():
    """Owners that share three grams share one of those that stay, whatever the counts."""
    rng = random.Random(4)
    for _ in range(300):
        pool = [rng.randrange(20) for _ in range(12)]
        n = {k: rng.choice([0, 5, 5, 900]) for k in range(20)}
        rows = [[rng.choice(pool) for _ in range(rng.randrange(1, 14))] for _ in range(2)]
        owner = np.repeat([0, 1], [len(x) for x in rows])
        keys = np.array(rows[0] + rows[1])
        o, k = p3_overlap.thinned(owner, keys, np.array([n[x] for x in keys.tolist()]), np.array([False, False]))
        assert len(set(zip(o.tolist(), k.tolist()))) == len(k)
        if (Counter(rows[0]) & Counter(rows[1])).total() >= 3:
            assert set(k[o == 0].tolist()) & set(k[o == 1].tolist())


def test_swap_repair():
    C = p4_sample.Cell
    got = p4_sample.swap_repair([C(1, 100, 2, 30.0), C(2, 5, 2, 30.0), C(3, 100, 2, 0.0), C(4, 0, 3, 5.0)], 60)
    assert sum(got.values()) == 60 and got[2] == 5 and got[4] == 0 and got[3] >= 2 and got[1] > got[3]
    exact = p4_sample.swap_repair([C(1, 50, 1, 7.0), C(2, 50, 1, 3.0)], 10, seed=3)
    assert exact == {1: 7, 2: 3}
    assert p4_sample.swap_repair([], 10) == {} and p4_sample.swap_repair([C(1, 0, 2, 1.0)], 5) == {1: 0}


def test_sample(spark):
    docs = [(f"d{i}", s, ("t", y, None, None, None), T0, "7") for i, (s, y) in enumerate([(" ACL", 1999), ("acl", 2003), ("Acl", None), ("ACL", 9999), ("Bio", 1999), (None, 1999), ("Zoo", 2000)] * 20)]
    docs += [("d0", "Bio", ("t", 1999, None, None, None), T0 - dt.timedelta(days=1), "7"), docs[1]]
    df = spark.createDataFrame(docs, "document_id string, source string, metadata struct<title:string,year:int,license:string,doi:string,abstract:string>, discovered_at timestamp_ntz, cell_id string")
    targets = spark.createDataFrame([(1, "ACL", 1995, 2000, 400, 2), (2, "ACL", 2001, 2005, 300, 2), (3, "ACL", None, None, 200, 2), (4, "Bio", None, None, 50, 30), (5, "Bio", 1990, 2000, 50, 1)], "cell_id long, source string, year_from int, year_to int, target_permille int, min_rows int")
    celled = p4_sample.celled(p4_sample.latest(df), targets)
    counts = Counter(r["cell_id"] for r in celled.collect())
    assert counts == {1: 20, 2: 20, 3: 40, 5: 20, None: 40}
    planned = p4_sample.plan(celled, targets)
    p = {r["cell_id"]: r for r in planned.collect()}
    assert p[1]["sample_size"] == 14 and p[4]["available"] == 0 and p[4]["required"] == 30 and sum(r["drawn"] for r in p.values()) == 14
    drawn = Counter(r["cell_id"] for r in p4_sample.draw(celled, planned).collect())
    assert drawn == {k: r["drawn"] for k, r in p.items() if r["drawn"]}
    again = p4_sample.draw(celled, planned)
    assert again.exceptAll(p4_sample.draw(celled, planned)).isEmpty()
    assert p4_sample.plan(p4_sample.celled(p4_sample.latest(df.limit(0)), targets), targets).filter("available < required").count() == 5


def test_temperature():
    S = p7_mix.Source
    s = [S("a", 900, 0.5, 1), S("b", 100, 0.5, 2)]
    assert p7_mix.tempered(s, 0.0) == [0.5, 0.5] and p7_mix.tempered(s, 1.0) == pytest.approx([9 / 11, 2 / 11])
    assert p7_mix.exponent_for(s, 400) == 0.0
    e = p7_mix.exponent_for(s, 900)
    w = p7_mix.tempered(s, e)
    assert 0 < e < 1 and w[1] * 900 == pytest.approx(200, rel=1e-6)
    assert p7_mix.entropy(p7_mix.tempered(s, p7_mix.exponent_for_entropy(s, 0.6))) == pytest.approx(0.6, abs=1e-6)


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, "Big" if i % 3 else "Small", " ".join(["word"] * rng.randrange(5, 30)), "q") for i in range(300)]
    docs += [(1000, "Big", None, "q"), (1001, "Big", "", "q"), (1002, None, "x y", "q"), (1003, "Other", "x y z", "q")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, block string")
    targets = spark.createDataFrame([("Big", 500, 1), ("Small", 500, 3), ("Gone", 200, 4)], "source string, weight_permille int, max_repeats int")
    uses, planned = p7_mix.mix(df, targets)
    rows = uses.collect()
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += r["tokens"]
    assert set(tokens) == {"Big", "Small"} and abs(tokens["Big"] / sum(tokens.values()) - 0.5) < 0.01
    times = Counter((r["source"], r["doc_id"]) for r in rows)
    assert max(v for (s, _), v in times.items() if s == "Big") == 1 and max(times.values()) <= 3
    assert len({(r["doc_id"], r["block"]) for r in rows}) == len(rows)
    assert p7_mix.mix(df.limit(0), targets)[0].count() == 0
    wide = spark.createDataFrame([("Big", 500, 1), ("Small", 500, 9)], "source string, weight_permille int, max_repeats int")
    most = tokens["Big"] + 3 * tokens["Small"]
    t, times = Counter(), Counter()
    for r in p7_mix.mix(df, wide, budget=most)[0].collect():  # beyond the target mix: the weights give way, the limits do not
        t[r["source"]] += r["tokens"]
        times[r["source"], r["doc_id"]] += 1
    assert t["Big"] + t["Small"] > 0.98 * most and t["Small"] > 2 * t["Big"] and max(times.values()) <= 9 and max(v for (x, _), v in times.items() if x == "Big") == 1
    # As large as the sources: the scarce one is used as often as it may be, and the exponent lies between the targets and the sizes.
    scarce = spark.createDataFrame([("Big", 100, 1), ("Small", 900, 2)], "source string, weight_permille int, max_repeats int")
    planned = {r["source"]: r for r in p7_mix.mix(df, scarce, p7_mix.ALL)[1].collect()}
    big, small = planned["Big"], planned["Small"]
    assert small["budget"] == pytest.approx(2 * small["tokens_available"], abs=2) and big["budget"] == pytest.approx(big["tokens_available"] - small["tokens_available"], abs=2) and small["weight"] < 0.9
