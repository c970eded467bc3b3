import io
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from foliomill.functions import arrow, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column).first()[0]


@pytest.mark.parametrize("given, wanted", [("  a \t\n b c ", "a b c"), (None, ""), ("", ""), (" x", "x")])
def test_squeeze(spark, given, wanted):
    assert one(spark, text.squeeze("x"), x=given) == wanted


@pytest.mark.parametrize("given, wanted", [("A b/c:d.pdf", "A_b_c_d.pdf"), ("..", "unknown"), ("Übersicht é.pdf", "Übersicht_é.pdf"), (None, "unknown")])
def test_safe_name(spark, given, wanted):
    assert one(spark, text.safe_name("x"), x=given) == wanted


def test_slug_and_key(spark):
    assert one(spark, text.slug("x"), x=" Hello, Wörld! 2 ") == "hello-w-rld-2"
    assert len(one(spark, text.slug("x"), x="a" * 200)) == 80
    a = one(spark, text.document_key(F.col("x"), F.col("y"), F.col("z")), x="ACL", y="10.1/x", z="a.pdf")
    b = one(spark, text.document_key(F.col("x"), F.col("y"), F.col("z")), x="ACL", y="10.1/x", z="b.pdf")
    assert a.startswith("acl-10-1-x-") and a != b


@pytest.mark.parametrize("given, wanted", [("CC_BY-SA", "cc by sa"), ("  ", None), ("unspecified", None), (None, None), ("CC0", "cc0")])
def test_license_label(spark, given, wanted):
    assert one(spark, text.license_label("x"), x=given) == wanted


@pytest.mark.parametrize("given, wanted", [("cc by sa", "cc by-sa"), ("cc by", "cc by"), ("cc by nc", "cc by-nc"), ("cc0 1.0", "cc0"), ("mit", "other"), (None, None)])
def test_license_family(spark, given, wanted):
    assert one(spark, text.license_family(F.col("x")), x=given) == wanted


@pytest.mark.parametrize("given, wanted", [("HTTP://CreativeCommons.org:80/licenses/by/4.0/?x=1#y", "CC BY 4.0"), ("https://creativecommons.org/publicdomain/zero/1.0/", "CC0 1.0"), ("CC BY 4.0", None), (None, None)])
def test_license_url(spark, given, wanted):
    assert one(spark, text.license_from_url("x"), x=given) == wanted


@pytest.mark.parametrize("given, wanted", [("12019", 2019), ("x 1890 2015-03", 2015), ("none", None), (None, None)])
def test_first_year(spark, given, wanted):
    assert one(spark, text.first_year("x"), x=given) == wanted


def test_sets(spark):
    j = text.jaccard(text.word_set("x"), text.word_set("y"))
    assert one(spark, j, x="a b c", y="b c d") == 0.5
    assert one(spark, j, x=None, y="") == 1.0
    assert one(spark, j, x="a", y=None) == 0.0


@pytest.mark.parametrize("given, wanted", [("TRUE ", True), ("y", True), ("0", False), (None, False), ("2", False)])
def test_flag(spark, given, wanted):
    assert one(spark, text.flag("x"), x=given) is wanted


def test_markdown(spark):
    md = "# Title\n\n## Abstract\n\nSome text.\n\n## Next\n![a](p/1.png) <img src='q.png'>\n| a |\n|---|\n"
    assert one(spark, text.heading_count("x"), x=md) == 3
    assert one(spark, text.table_row_count("x"), x=md) == 2
    assert one(spark, text.image_links("x"), x=md) == ["p/1.png", "q.png"]
    assert one(spark, text.section("x", "Abstract"), x=md) == "Some text."


def test_thinking_and_duration(spark):
    assert one(spark, text.without_thinking("x"), x="<think>a\nb</think> c") == "c"
    assert one(spark, text.without_thinking("x"), x="z<|channel|>final<|message|>d") == "d"
    assert [one(spark, text.duration(F.col("x").cast("int")), x=v) for v in ("7", "185", "3720")] == ["7s", "3m05s", "1h02m"]


def test_plain_text_and_similarity():
    assert arrow.plain_text("<b>Caf&eacute;</b> \\alpha $x_1$ [see](http://u) Straße") == "café x 1 see strasse"
    assert arrow.similarity("", None) == 1.0 and arrow.similarity("a", "") == 0.0 and arrow.similarity("a b", "A  B") == 1.0


@pytest.mark.parametrize(
    "given, kind, wanted",
    [
        ('[{"cue": "a", "category": "t"}, {"cue": "b"}]', "textual", ["textual t: a", "textual cue: b"]),
        ('```json\n[{"cue": "a", "category": "t"}, {"cue": "b c', "textual", ["textual t: a", "textual cue: b c"]),
        ('{"layout": "grid", "figure_type": ["bar", "line"]}', "visual", ["figure_type: bar", "figure_type: line", "layout: grid"]),
        ('{"distinctive_visual_cues": "d", "note": "n", "visual_elements": "v", "colors_and_styles": "c", "relationships": "r", "layout": "l"}', "visual", ["layout: l", "visual_elements: v", "colors_and_styles: c", "relationships: r", "distinctive_visual_cues: d", "note: n"]),
        ('{"a": "x"} {"b": "y"}', "visual", ["a: x", "b: y"]),
        ("only words", "visual", ["only words"]),
        ("", "visual", []),
        (None, "textual", []),
        ('{"a": {"b": ["x", {"c": "y"}]}, "n": 3', "visual", ["a: x", "a: y", "n: 3"]),
    ],
)
def test_components(given, kind, wanted):
    assert arrow.components(given, kind) == wanted


def test_components_never_fail():
    full = '[{"cue": "a \\"q\\" b", "category": "t"}, {"cue": "c", "n": [1, {"x": null}]}]'
    for k in range(len(full) + 1):
        assert isinstance(arrow.components(full[:k], "textual"), list)


def test_image_size():
    assert arrow.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 20)) == (30, 20)
    assert arrow.image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert arrow.image_size(b"x") is None and arrow.image_size(None) is None


def test_archives():
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as tar:
        for name, data in (("a.pdf", b"1"), ("../b.pdf", b"2"), ("a.pdf", b"3")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    assert [(m["name"], m["problem"]) for m in arrow.archive_members(t.getvalue())] == [("a.pdf", None), ("../b.pdf", "unsafe"), ("a.pdf", "duplicate")]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x/y.md", "hi")
    assert arrow.archive_members(z.getvalue()) == [{"name": "x/y.md", "content": b"hi", "problem": None}]
    assert arrow.archive_members(b"junk")[0]["problem"] == "unreadable" and arrow.archive_members(None) == []
