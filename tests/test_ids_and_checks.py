import pytest
from pyspark.sql import functions as F

from foliomill.functions import ids
from foliomill.operators import validate
from foliomill.plans import config
from foliomill.sources import lookup


def value(spark, column, row=(None,), schema="x string"):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_ids(spark):
    v = value(spark, ids.last_version(F.col("x")), ([("v1", "a"), ("v2", "b"), ("draft", "c")],), "x array<struct<version:string,created:string>>")
    assert v == "v2"
    assert value(spark, ids.versioned_id(F.lit("2101.1"), F.lit("v2"))) == "2101.1v2" and value(spark, ids.versioned_id(F.lit("2101.1v3"), F.lit("v2"))) == "2101.1v3"
    assert value(spark, ids.pdf_address(F.lit("hep-th/9 1"))) == "https://example.org/pdf/hep-th%2F9%201.pdf"
    assert value(spark, ids.number_part(F.lit(" pmc12 "))) == "12" and value(spark, ids.https_from_s3(F.lit("s3://b/k/x"))) == "https://b.s3.amazonaws.com/k/x"
    assert value(spark, ids.url_parameter(F.lit("https://h/p?md5=ab&x=1"), "md5")) == "ab"
    a = value(spark, ids.anthology_parts(F.lit("2024.acl-long.12")))
    assert (a["year"], a["venue"], a["volume_id"], a["number"]) == (2024, "ACL", "2024.acl-long", 12)
    assert value(spark, ids.anthology_parts(F.lit("other")))["year"] is None
    p = value(spark, ids.volume_parts(F.lit("2024.acl-long-1")))
    assert (p["collection"], p["volume"]) == ("2024.acl-long", "1")
    assert value(spark, ids.figure_id(F.lit("p"), F.lit(3), F.lit("abcdef0123456789"))) == "p.fig.0003.abcdef012345"
    assert value(spark, ids.collision_free(F.lit("p"), F.lit("a/p.pdf"), F.lit(1))) == "p" and len(value(spark, ids.collision_free(F.lit("p"), F.lit("a/p.pdf"), F.lit(2)))) == 14
    assert value(spark, ids.stratum(None, F.lit(" "), F.lit(2020))) == "unknown:2020" and value(spark, ids.stratum(F.lit("s"), F.lit("v"), F.lit(None).cast("int"))) == "s"
    assert value(spark, ids.composite_key(F.lit("a"), F.lit(None).cast("string"), F.lit(3))) == "a::::3"
    assert value(spark, ids.no_nan(F.lit(float("nan")))) is None and value(spark, ids.pixel_budget(F.lit(512))) == 524288
    assert [value(spark, ids.kind(F.lit(k))) for k in ("Figure", " text", "other")] == ["visual", "textual", "other"]


def test_cpu_lines(spark):
    r = value(spark, ids.cpu_lines(F.lit("cpu  1 2 3 4 5 6 7 8\ncpu0 1 2 3 4 5 6 7 8 9\nintr 5\ncpu1 0 0 0 9 0 0 0 0")))
    assert [(x["cpu"], x["user"], x["idle"], x["total"]) for x in r] == [("cpu0", 3, 4, 36), ("cpu1", 0, 9, 9)]


def test_terms_and_types(spark):
    assert value(spark, ids.term_score(F.lit("Cellular genomes"), ["cell", "genome", "x"])) == 2
    t = lambda *x: ids.excluded_type(F.array(*map(F.lit, x)).cast("array<string>"), ["letter"], ["journal article"])
    assert [value(spark, t("Journal Article", "Letter to X")), value(spark, t("Journal Article")), value(spark, t("Review")), value(spark, t())] == [True, False, True, False]


def test_validation(spark):
    df = spark.createDataFrame([(1, "a/b.pdf", "0" * 64, 5.0), (2, "/a", "xyz", -1.0), (3, None, None, None), (4, "a/../b.pdf", "F" * 64, 1.5)], "id int, p string, d string, s double")
    got = validate.violations(df, "id", {"path": validate.unsafe_path(F.col("p"), ".pdf"), "digest": validate.bad_digest(F.col("d")), "size": validate.bad_size(F.col("s"))})
    assert {tuple(r) for r in got.collect()} == {(i, r) for i in (2, 3, 4) for r in ("path", "digest", "size")}
    assert value(spark, validate.all_inside(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) and not value(spark, validate.all_inside(F.array(F.lit("c")), F.array(F.lit("a"))))
    m = {r["g"]: (r["n"], r["met"]) for r in validate.targets_met(spark.createDataFrame([("a",), ("a",)], "g string"), "g", {"a": 2, "b": 1}).collect()}
    assert m == {"a": (2, True), "b": (0, False)}
    with pytest.raises(ValueError):
        validate.check_window(5, 2)


def _service():
    def fetch(keys):
        if "down" in keys:
            raise ConnectionError("no")
        return {k: k.upper() for k in keys if k != "gone"}

    return fetch


def test_lookup(spark):
    df = spark.createDataFrame([("a",), ("gone",), (None,), ("a",)], "k string")
    assert sorted((r["k"] or "", r["value"], r["error"]) for r in lookup.lookup(df, "k", _service).collect()) == [("", None, None), ("a", "A", None), ("a", "A", None), ("gone", None, None)]
    waits = []
    assert lookup.fetch_all(["down"], _service(), 2, 1.0, waits.append) == [(None, "ConnectionError: no")] and waits == [1.0, 2.0]


def test_config(tmp_path):
    p = tmp_path / "s.toml"
    p.write_text('[stage]\nname = "x"\nn = 3\n')
    assert config.load(p, ["stage.n=5", "stage.deep.flag=true", "stage.name=y z"]) == {"stage": {"name": "y z", "n": 5, "deep": {"flag": True}}}
