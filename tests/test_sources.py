import json

import pytest
from pyspark.sql import functions as F

from foliomill.sources import readers, sinks
from foliomill.streaming import incremental


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "v": "a b"}\n\n[1]\n{"id": 2}\n{broken\n{"id": 2, "v": "z"}\n', encoding="utf-8")
    assert readers.count_lines(spark, str(p)) == 5
    rows = readers.jsonl(spark, str(p), "id int, v string", bad="rows").orderBy("pos").collect()
    assert [(r["id"], r["parse_error"]) for r in rows] == [(1, False), (None, True), (2, False), (None, True), (2, False)]
    good = readers.jsonl(spark, str(p), "id int, v string", bad="skip")
    assert good.count() == 3
    assert {r["id"]: r["v"] for r in readers.last_by_key(good, "id").collect()} == {1: "a b", 2: "z"}
    with pytest.raises(ValueError, match="a.jsonl:3: no object"):
        readers.jsonl(spark, str(p), "id int, v string")
    assert [(r["line_no"], r["problem"]) for r in readers.invalid_lines(spark, str(p)).orderBy("line_no").collect()] == [(3, "no object"), (5, "invalid JSON")]
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "id int", missing_ok=True).count() == 0


def test_split_index(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"train": ["a", "b"], "test": ["c"], "metadata": {}}, indent=1))
    assert {tuple(r) for r in readers.split_index(spark, str(p)).collect()} == {("a", "train", 0), ("b", "train", 1), ("c", "test", 0)}


def test_xml(spark, tmp_path):
    p = tmp_path / "v.xml"
    p.write_text('<collection><volume id="main"><meta><year>2024</year><venue>acl</venue></meta><paper id="0"><title>Front</title></paper><paper id="1"><title>A\n  b</title><author><first>X</first><last>Y</last></author><doi></doi></paper></volume><volume id="other"><paper id="1"><title>n</title></paper></volume></collection>')
    r = readers.volumes(spark, str(p), ["main"]).collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["year"], r[0]["venue"], r[0]["doi"], r[0]["authors"][0]["last"]) == ("A b", 2024, "ACL", None, "Y")
    q = tmp_path / "p.xml"
    q.write_text("<S><PubmedArticle><MedlineCitation><PMID Version='1'>7</PMID><Article><ArticleTitle>T</ArticleTitle><Language>eng</Language><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author><Author><CollectiveName>C</CollectiveName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></S>")
    r = readers.pubmed(spark, str(q)).first()
    assert (r["pmid"], r["year"], r["authors"], r["language"]) == ("7", 1999, ["F L", "C"], "eng")
    s = spark.createDataFrame([("<eSearchResult><Count>2</Count><IdList><Id>5</Id><Id>6</Id></IdList></eSearchResult>", "<L><CommonPrefixes><Prefix>b/</Prefix></CommonPrefixes><CommonPrefixes><Prefix>a/</Prefix></CommonPrefixes><CommonPrefixes><Prefix>b/</Prefix></CommonPrefixes></L>")], "a string, b string")
    r = s.select(readers.search_ids(F.col("a")).alias("s"), readers.version_prefixes(F.col("b")).alias("v")).first()
    assert (r["s"]["count"], r["s"]["ids"], r["v"]) == (2, ["5", "6"], ["a/", "b/"])


def test_csv_and_inventory(spark, tmp_path):
    (tmp_path / "g.csv").write_text("a, 1\nb\nc, 3\n")
    assert readers.samples_csv(spark, str(tmp_path / "g.csv"), "n string, v int").count() == 2
    d = tmp_path / "pdf" / "ACL"
    d.mkdir(parents=True)
    (d / "x.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page /Type/Page")
    (d / "y.pdf").write_bytes(b"no")
    r = {x["relative_path"]: (x["domain"], x["pdf"]) for x in readers.inventory(spark, str(tmp_path / "pdf")).collect()}
    assert r == {"ACL/x.pdf": ("ACL", True), "ACL/y.pdf": ("ACL", False)}
    n = spark.read.format("binaryFile").load(str(d / "x.pdf")).select(readers.page_count(F.col("content"))).first()[0]
    assert n == 2


def test_shards_and_archive(spark, tmp_path):
    files = spark.createDataFrame([("s1.tar", "a", b"1", '{"k": 1}'), ("s1.tar", "b", b"22", None), ("s2.tar", "c", None, "{}")], "shard string, name string, content binary, record string")
    manifest = sinks.write_shards(files, str(tmp_path / "t")).collect()
    assert len(manifest) == 6
    back = {(x["archive"].rsplit("/", 1)[1], x["name"]): x["sha256"] for x in readers.archive(spark, str(tmp_path / "t" / "*.tar")).collect()}
    assert back == {(m["shard"], m["name"]): m["sha256"] for m in manifest}


def test_paper_folders(spark, tmp_path):
    d = tmp_path / "ACL" / "p1"
    (d / "images").mkdir(parents=True)
    (d / "markdown.md").write_text("# T\n\ntext")
    (d / "paper.json").write_text('{"paper_id": "p1"}')
    (d / "images" / "1.png").write_bytes(b"x")
    e = tmp_path / "Bio" / "p2"
    e.mkdir(parents=True)
    (e / "markdown.md").write_text("m")
    r = {x["paper_id"]: (x["domain"], x["record"], x["images"]) for x in readers.paper_folders(spark, str(tmp_path)).collect()}
    assert r == {"p1": ("ACL", '{"paper_id": "p1"}', ["1.png"]), "p2": ("Bio", None, [])}
    w = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"])], "id int, tries array<string>")
    assert {x["id"]: x["path"] for x in readers.first_existing(w, "tries", spark.createDataFrame([("b",)], "path string"), "id").collect()} == {1: "b", 2: None}


def test_content_blocks(spark):
    flat = '[{"type":"image","page_idx":1,"img_path":"a.png","caption":["x","y"]},{"type":"text"}]'
    nested = '[[{"type":"chart","content":{"image_source":{"path":"b.png"}}}],[{"type":"image","img_path":"c.png"}]]'
    r = spark.createDataFrame([(flat,), (nested,)], "c string").select(readers.content_blocks(F.col("c")).alias("b")).collect()
    assert [(x["page_idx"], x["path"]) for x in r[0]["b"]] == [(1, "a.png")] and r[0]["b"][0]["caption"] == "x y"
    assert [(x["page_idx"], x["path"]) for x in r[1]["b"]] == [(0, "b.png"), (1, "c.png")]


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(readers.PagedSource)
    for k in range(3):
        (tmp_path / f"page-{k}.json").write_text(json.dumps({"records": [{"id": f"{k}-{i}"} for i in range(2)]}))
    assert spark.read.format("pages").option("path", str(tmp_path)).load().count() == 6
    s = spark.readStream.format("pages").option("path", str(tmp_path)).load()
    q = s.writeStream.format("memory").queryName("pages_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pages_out").count() == 6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, "y", "b")], "id int, v string, d string")
    sinks.write_jsonl(df, str(tmp_path / "j"), by=["d"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_parquet(df, str(tmp_path / "p"), ["v", "id", "extra"])
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["v", "id", "extra"]
    sinks.write_csv(df, str(tmp_path / "c"), ["id", "v"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "v"]
    assert [sinks.write_once(df, str(tmp_path / "o")) for _ in range(2)] == ["written", "kept"]
    with pytest.raises(ValueError):
        sinks.write_once(df.filter("id = 1"), str(tmp_path / "o"))
    assert sinks.write_once(df.filter("id = 1"), str(tmp_path / "o"), overwrite=True) == "written"
    assert sinks.markdown_table(df.orderBy("id")).split("\n")[2] == "| 1 |  | a |"
    plan = sinks.action_plan(spark.createDataFrame([("a", True), ("b", True), ("c", False)], "k string, at_source boolean"), spark.createDataFrame([("b",)], "k string"), "k")
    assert {r["k"]: r["action"] for r in plan.collect()} == {"a": "planned", "b": "existing", "c": "missing"}


def test_append_new(spark, tmp_path):
    p = str(tmp_path / "log")
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, v string")
    assert incremental.append_new(a, p, ["id"]).count() == 2
    assert incremental.append_new(spark.createDataFrame([(2, "q"), (3, "r")], "id int, v string"), p, ["id"]).count() == 1
    assert spark.read.parquet(p).count() == 3


def test_harvest(spark):
    xml = '<x:arXiv xmlns:x="u" xmlns="v"><id>1</id><created>2001-02-03</created><title>A\n  b</title><categories>eess.SP  physics.optics</categories><authors><author><keyname>L</keyname><forenames>F</forenames><suffix>Jr</suffix></author><author><keyname>M</keyname></author></authors><doi> </doi></x:arXiv>'
    r = spark.createDataFrame([(xml,)], "c string").select(readers.harvest_records(F.col("c")).alias("r")).first()["r"]
    assert (r["id"], r["title"], r["authors"], r["categories"], r["doi"], r["versions"][0]["version"], r["update_date"]) == ("1", "A b", ["F L Jr", "M"], ["eess.SP", "physics.optics"], None, "v1", "2001-02-03")


def test_formats_and_folders(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a.csv").write_text("id,v\n1,x\n")
    assert readers.first_format(spark, str(d)).columns == ["id", "v"]
    (d / "a.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    assert readers.first_format(spark, str(d)).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.first_format(spark, str(tmp_path))
    for c in ("base", "plus"):
        (tmp_path / "q" / c).mkdir(parents=True)
        (tmp_path / "q" / c / "rows.jsonl").write_text('{"id": 1, "query": "q"}\n{"id": 2}\n')
    rows = readers.by_folder(spark, str(tmp_path / "q" / "*" / "*.jsonl"), "id int, query string").filter("query is not null").collect()
    assert {r["condition"] for r in rows} == {"base", "plus"} and len(rows) == 2


def test_lines_of_a_file_in_pieces(spark, tmp_path):
    p = tmp_path / "big.txt"
    p.write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        got = {r["line_no"]: r["line"] for r in readers.numbered_lines(spark, str(p)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i + 1: f"line {i}" for i in range(5000)}


def test_rows_and_groups(spark, tmp_path):
    path = str(tmp_path / "rows")
    sinks.put_row(spark, path, {"b": 1, "a": "ü"})
    sinks.put_row(spark, path, {"b": 2})
    assert {r[0] for r in spark.read.text(path).collect()} == {'{"a": "ü", "b": 1}', '{"b": 2}'}
    sinks.put_row(spark, path, {"b": 3}, append=False)
    assert [r[0] for r in spark.read.text(path).collect()] == ['{"b": 3}']
    groups = str(tmp_path / "groups")
    df = lambda *rows: spark.createDataFrame(rows, "g string, v int")
    sinks.write_groups(df(("a", 1), ("b", 1)), groups, ["g"], first=True)
    sinks.write_groups(df(("a", 2)), groups, ["g"], first=True)
    sinks.write_groups(df(("a", 3)), groups, ["g"], first=False)
    assert {(r["g"], r["v"]) for r in spark.read.json(groups).collect()} == {("a", 2), ("a", 3), ("b", 1)}


def test_bundle_and_transfer(spark, tmp_path):
    import zipfile

    files = spark.createDataFrame([("b.pdf", b"22"), ("a.pdf", None)], "name string, content binary")
    assert sinks.write_bundle(files, spark.createDataFrame([("q1", "why")], "query_id string, query string"), str(tmp_path / "x" / "b.zip")) == 2
    with zipfile.ZipFile(tmp_path / "x" / "b.zip") as z:
        assert z.namelist() == ["pdfs/a.pdf", "pdfs/b.pdf", "queries.json"] and json.loads(z.read("queries.json")) == [{"query_id": "q1", "query": "why"}]
    (tmp_path / "one").write_text("1")
    plan = spark.createDataFrame([(str(tmp_path / "one"), str(tmp_path / "t" / "one"), "planned"), (str(tmp_path / "none"), str(tmp_path / "t" / "none"), "planned"), ("", "e", "existing")], "source_path string, target_path string, action string")
    assert sorted(r["outcome"] for r in sinks.transfer(plan).collect()) == ["existing", "missing", "written"] and (tmp_path / "t" / "one").read_text() == "1"
    gone = spark.createDataFrame([(str(tmp_path / "one"), "delete"), (str(tmp_path / "two"), "delete"), (str(tmp_path / "t" / "one"), "keep")], "path string, action string")
    assert sorted(r["outcome"] for r in sinks.delete_files(gone).collect()) == ["deleted", "gone", "kept"] and not (tmp_path / "one").exists()


def test_formats_and_ids(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "papers.jsonl").write_text('{"paper_id": "p", "figures": ["f1", "f2"]}\n{"paper_id": "q", "figures": null}\n')
    rows = readers.first_format(spark, str(tmp_path / "a"))
    assert {r["id"]: r["record"]["paper_id"] for r in readers.by_any_id(rows, [F.col("paper_id"), F.col("figures")]).collect()} == {"p": "p", "f1": "p", "f2": "p", "q": "q"}
    (tmp_path / "b" / "ACL" / "p1").mkdir(parents=True)
    (tmp_path / "b" / "ACL" / "p1" / "markdown.md").write_text("# T")
    assert readers.first_format(spark, str(tmp_path / "b")).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.first_format(spark, str(tmp_path / "none"))


def test_harvest(spark):
    def load():
        calls = {}

        def fetch(start, end, token):
            calls[start, token] = calls.get((start, token), 0) + 1
            if start == "2024-01-02":
                raise readers.NotAcceptable
            if start == "2024-01-03" and calls[start, token] == 1:
                raise TimeoutError("slow")
            if start == "2024-01-04":
                raise TimeoutError("down")
            page = int(token or 0)
            return [(f"{start}/{page}/{k}", "{}") for k in range(2)], str(page + 1) if page < 2 else None

        return fetch

    windows = spark.createDataFrame([(i, f"2024-01-0{i}", f"2024-01-0{i}") for i in range(1, 5)], "window_no int, window_start string, window_end string")
    rows = readers.harvest(windows, load, retries=1, wait=lambda s: None).collect()
    assert sum(r["status"] == "record" for r in rows) == 12 and {r["status"] for r in rows} == {"record", "skipped", "failed: TimeoutError: down"}
    assert [r["window_no"] for r in readers.harvest(windows, load, retries=1, limit=5, wait=lambda s: None).collect()] == [1] * 5


def test_settings(tmp_path):
    from foliomill.plans import config

    (tmp_path / "stage").mkdir()
    (tmp_path / "stage" / "x.json").write_text('{"n": 1, "m": 2}')
    (tmp_path / "main.json").write_text('{"defaults": [{"stage": "x"}, "_self_"], "stage": {"n": 5}, "k": 1}')
    assert config.load(tmp_path / "main.json", ["k=7"]) == {"stage": {"n": 5, "m": 2}, "k": 7}
    assert config.selected({"b": True}, ["a", "b", "c"]) == ["b"] and config.selected({}, ["a", "b"]) == ["a", "b"] and config.selected({}, ["a", "b", "c"], generated=True) == ["b", "c"]
    pytest.importorskip("yaml")
    (tmp_path / "y.yaml").write_text("a:\n  b: 1\n")
    assert config.load(tmp_path / "y.yaml") == {"a": {"b": 1}}


def test_bar(spark):
    from foliomill.functions import text

    df = spark.createDataFrame([(0, 10), (1, 1000), (5, 10), (10, 10)], "n int, most int")
    assert [r[0] for r in df.select(text.bar(F.col("n"), F.col("most"), 10)).collect()] == ["", "#", "#####", "##########"]
