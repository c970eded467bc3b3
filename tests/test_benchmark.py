from pyspark.sql import functions as F

from foliomill.plans import benchmark
from foliomill.sources import readers, sinks


def test_grid(spark):
    requests = spark.createDataFrame([("a" * (i % 40 + 1),) for i in range(200)] + [(None,)], "prompt string")
    some = benchmark.representative(requests, "prompt", 8)
    assert 4 <= some.count() <= 8

    def load(setting):
        def make():
            def answer(prompts):
                if setting["tokens"] > 512:
                    raise MemoryError("too large")
                return [p.upper() for p in prompts]

            return answer

        return make

    ticks = iter(range(100))
    runs = benchmark.grid(some, "prompt", load, {"batch": [2, 4], "tokens": [512, 768]}, clock=lambda: float(next(ticks)) ** 2)
    assert len(runs) == 4 and [r["failed"] > 0 for r in runs] == [False, True, False, True]
    assert benchmark.best(runs) == runs[0] and benchmark.best([r for r in runs if r["failed"]]) is None


def test_upload(spark):
    shards = spark.createDataFrame([(i, f"s{i}") for i in range(6)], "place int, path string")

    def load():
        tries = {}

        def send(path):
            tries[path] = tries.get(path, 0) + 1
            if path == "s2" or path == "s4" and tries[path] == 1:
                raise OSError("down")

        return send

    rows = sinks.upload(shards, load, parallel=2, done=shards.filter("place = 0"), retries=1, wait=lambda s: None).collect()
    assert [(r["path"], r["outcome"]) for r in rows] == [("s1", "uploaded"), ("s2", "OSError: down"), ("s3", "uploaded"), ("s4", "uploaded"), ("s5", "uploaded")]


def test_corpora_and_root(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name / "d").mkdir(parents=True)
        (tmp_path / name / "d" / "x.pdf").write_bytes(b"%PDF")
    found = readers.corpora(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "c": str(tmp_path / "none")})
    assert {(r["corpus"], r["relative_path"], r["pdf"]) for r in found.collect()} == {("a", "d/x.pdf", True), ("b", "d/x.pdf", True)}
    (tmp_path / "b" / "p").mkdir()
    (tmp_path / "b" / "p" / "markdown.md").write_text("x")
    assert readers.papers_root(spark, [str(tmp_path / "a"), str(tmp_path / "b")]) == str(tmp_path / "b")
    q = tmp_path / "q" / "m1"
    q.mkdir(parents=True)
    (q / "queries.jsonl").write_text('{"query": "a"}\n{"query": null}\n{"query": " "}\n')
    assert [(r["query"], r["condition"]) for r in readers.by_folder(spark, str(tmp_path / "q" / "*" / "*.jsonl"), "query string", required="query").collect()] == [("a", "m1")]
