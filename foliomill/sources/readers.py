"""Readers that keep file and position: JSON lines, JSON, XML, CSV, Parquet, binary files, archives, paper folders, paged sources."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from foliomill.functions.arrow import stream_members
from foliomill.operators import ranking


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of the non-blank lines; only line feeds end lines, and pos rises in file order."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")).filter(F.trim("line") != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of all lines, numbered from 1 in each file.  A file's pieces may be read in any order, so lines are ranked by the place of their
    piece in the file and their place in the piece; a file of any size is spread over tasks."""
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    return ranking.ranked(rows, ["file"], [F.col("piece"), F.col("pos")], "line_no").select("file", "line_no", "line")


def _is_object(line: Column) -> Column:
    """True for a line that is one JSON object."""
    one = F.startswith(F.trim(line), F.lit("{")) & (F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1)
    return F.coalesce(one, F.lit(False))


def invalid_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, problem, line) of the lines that are no JSON (invalid) or no object."""
    rows = numbered_lines(spark, path).filter((F.trim("line") != "") & ~_is_object(F.col("line")))
    problem = F.when(F.try_parse_json("line").isNull(), "invalid JSON").otherwise("no object")
    return rows.select("file", "line_no", problem.alias("problem"), "line")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, bad: str = "fail", missing_ok: bool = False) -> DataFrame:
    """JSON objects, one a line.  ``bad`` lines (no JSON, or no object) fail the read at once, with file and line number, are skipped, or stay as rows with
    ``parse_error`` true."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), T.StructField("pos", T.LongType()), *wanted.fields]))
    rows = lines(spark, path).withColumn("ok", _is_object(F.col("line")))
    if bad == "fail" and not rows.filter("not ok").isEmpty():
        first = invalid_lines(spark, path).orderBy("file", "line_no").first()
        raise ValueError(f"{first['file']}:{first['line_no']}: {first['problem']}: {first['line'][:80]}")
    parsed = rows.withColumn("r", F.when(F.col("ok"), F.from_json("line", wanted)))
    if bad == "rows":
        return parsed.select("file", "pos", (~F.col("ok")).alias("parse_error"), "r.*")
    return parsed.filter("ok").select("file", "pos", "r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def count_lines(spark: SparkSession, path: str) -> int:
    return lines(spark, path).count()


def last_by_key(rows: DataFrame, key: str) -> DataFrame:
    """Each key's last row of a log, by position."""
    others = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct("file", "pos")).alias("r")).select(key, "r.*")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def split_index(spark: SparkSession, path: str) -> DataFrame:
    """(entry, split, pos) of a split document; an entry repeated within its split stays and can be counted."""
    d = json_document(spark, path, "train array<string>, test array<string>")
    both = [d.select(F.lit(s).alias("split"), F.posexplode(s).alias("pos", "entry")) for s in ("train", "test")]
    return both[0].unionByName(both[1]).select("entry", "split", "pos")


#: Fields of a paper in a collection of volumes.
PAPER = "_id string, title string, author array<struct<first:string,last:string>>, abstract string, doi string, pages string, url string"


def volumes(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """Papers of XML volumes: front matter (id 0) is dropped, a paper without id gets its place, empty fields are null."""
    schema = f"_id string, meta struct<booktitle:string,year:string,month:string,venue:string>, paper array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _fields(PAPER))}>>"
    v = spark.read.format("xml").option("rowTag", "volume").schema(schema).load(path)
    if wanted:
        v = v.filter(F.col("_id").isin(wanted))
    p = v.select(F.col("_id").alias("volume_id"), "meta", F.posexplode("paper").alias("place", "p"))
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit(""))
    number = F.coalesce(F.col("p._id"), (F.col("place") + 1).cast("string"))
    return p.filter(number != "0").select("volume_id", number.alias("number"), clean("p.title").alias("title"), F.col("p.author").alias("authors"), F.expr("try_cast(meta.year as int)").alias("year"), F.upper("meta.venue").alias("venue"), clean("p.abstract").alias("abstract"), clean("p.doi").alias("doi"), clean("p.pages").alias("pages"))


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Articles by pmid: title, journal, the first year found in three places, article types, language, authors (collective names too), subjects."""
    schema = """MedlineCitation struct<PMID:struct<_VALUE:string,_Version:string>,Article:struct<ArticleTitle:string,Language:array<string>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,ArticleDate:array<struct<Year:string>>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,CollectiveName:string>>>,PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string,_UI:string>>>>,MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_UI:string>>>>>"""
    a = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path).select(F.col("MedlineCitation").alias("m"))
    art = "m.Article"
    date = F.col(f"{art}.Journal.JournalIssue.PubDate")
    year = F.coalesce(date["Year"], F.nullif(F.regexp_extract(date["MedlineDate"], "([0-9]{4})", 1), F.lit("")), F.col(f"{art}.ArticleDate")[0]["Year"])
    names = F.transform(F.col(f"{art}.AuthorList.Author"), lambda x: F.coalesce(x["CollectiveName"], F.concat_ws(" ", x["ForeName"], x["LastName"])))
    return a.select(F.col("m.PMID._VALUE").alias("pmid"), F.col(f"{art}.ArticleTitle").alias("title"), names.alias("authors"), F.col(f"{art}.Journal.Title").alias("journal"), year.cast("int").alias("year"), F.col(f"{art}.PublicationTypeList.PublicationType._VALUE").alias("article_types"), F.col(f"{art}.Language")[0].alias("language"), F.transform(F.col("m.MeshHeadingList.MeshHeading"), lambda x: x["DescriptorName"]["_VALUE"]).alias("subjects"))


def search_ids(c: Column) -> Column:
    """Of a search result as XML text: struct of count and ids."""
    return F.struct(F.xpath_int(c, F.lit("/eSearchResult/Count")).alias("count"), F.xpath(c, F.lit("/eSearchResult/IdList/Id/text()")).alias("ids"))


def version_prefixes(c: Column) -> Column:
    """Of an object listing as XML text: its distinct version folders in order."""
    return F.array_sort(F.array_distinct(F.xpath(c, F.lit("//CommonPrefixes/Prefix/text()"))))


def samples_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV samples; rows of the wrong width are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).csv(path)
    return rows.filter(F.hash(*rows.columns) >= -(2**31))  # reads every column, so that no width goes unchecked


def _open(path: str):
    """A file of any file system that the executors see, open for reading."""
    where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where[0].open_input_file(unquote(where[1]) if path.startswith("file:") else where[1])


@F.pandas_udf(T.BinaryType())
def file_head(path: pd.Series) -> pd.Series:
    """The first eight bytes of a file; null for one that cannot be read."""

    def head(x: str) -> bytes | None:
        try:
            with _open(x) as f:
                return f.read(8)
        except OSError:
            return None

    return path.map(head)


def inventory(spark: SparkSession, path: str, pattern: str = "*.pdf", root: str = "") -> DataFrame:
    """(path, relative_path, domain, size_bytes, pdf) of files below a folder: files are listed, and of each only the first bytes are read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    base = F.regexp_replace(F.lit(root or path), "^(file:)?/*", "")
    relative = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z]+:/*", ""), F.concat(F.lit("^"), base, F.lit("/*")), "")
    pdf = F.coalesce(F.substring(file_head("path"), 1, 4) == F.lit(b"%PDF"), F.lit(False))
    return f.select("path", relative.alias("relative_path"), F.split(relative, "/")[0].alias("domain"), F.col("length").alias("size_bytes"), pdf.alias("pdf"))


def page_count(content: Column) -> Column:
    """Pages of a PDF by its page objects."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page(?!s)"))


#: Bytes of members that are held at once.
ARCHIVE_BATCH = 32 << 20


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Members of TAR and ZIP files: archive, name, content, size_bytes, sha256, problem (unsafe, duplicate or unreadable).

    An archive is read as a stream, member by member, so its size does not matter; only a single member has to fit into a row."""
    names = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive_path in pdf["path"]:
                held, size = [], 0
                with _open(archive_path) as f:
                    for m in stream_members(f):
                        held.append((archive_path, m["name"], m["content"], m["problem"]))
                        size += len(m["content"] or b"")
                        if size > ARCHIVE_BATCH:
                            yield pd.DataFrame(held, columns=["archive", "name", "content", "problem"])
                            held, size = [], 0
                yield pd.DataFrame(held, columns=["archive", "name", "content", "problem"])

    m = names.mapInPandas(run, "archive string, name string, content binary, problem string")
    return m.select("archive", "name", "content", F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "problem")


def paper_folders(spark: SparkSession, path: str) -> DataFrame:
    """Papers kept as folders with markdown.md and perhaps paper.json and images: id, domain, markdown, record (or none), image names."""
    def folder(c):
        return F.regexp_replace(F.regexp_replace(c, "/[^/]+$", ""), "^[a-z]+:/*", "/")

    def load(fmt: str, pattern: str):
        return spark.read.format(fmt).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)

    text = load("text", "markdown.md").option("wholetext", True).load(path).select(folder(F.col("_metadata.file_path")).alias("folder"), F.col("value").alias("markdown"))
    record = load("text", "paper.json").option("wholetext", True).load(path).select(folder(F.col("_metadata.file_path")).alias("folder"), F.col("value").alias("record"))
    images = load("binaryFile", "*.{png,jpg,jpeg,gif,webp}").load(path).select(folder(folder(F.col("path"))).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("image")).groupBy("folder").agg(F.array_sort(F.collect_list("image")).alias("images"))
    parts = F.split("folder", "/")
    return text.join(record, "folder", "left").join(images, "folder", "left").select(F.element_at(parts, -1).alias("paper_id"), F.element_at(parts, -2).alias("domain"), "markdown", "record", F.coalesce("images", F.array().cast("array<string>")).alias("images"))


def first_existing(wanted: DataFrame, candidates: str, existing: DataFrame, row_id: str) -> DataFrame:
    """Each row with the first of its candidate paths that exists (null if none)."""
    tries = wanted.select(row_id, F.posexplode(candidates).alias("rank", "path"))
    hit = tries.join(existing.select("path").distinct(), "path", "left_semi").groupBy(row_id).agg(F.min_by("path", "rank").alias("path"))
    return wanted.join(hit, row_id, "left")


def content_blocks(c: Column) -> Column:
    """Image and chart blocks of an extraction, from its flat form (a list of blocks with page_idx) or nested form (a list of pages)."""
    block = "struct<type:string,page_idx:int,img_path:string,caption:array<string>,content:struct<image_source:struct<path:string>>>"
    flat = F.from_json(c, f"array<{block}>")
    nested = F.flatten(F.transform(F.from_json(c, f"array<array<{block}>>"), lambda page, i: F.transform(page, lambda b: b.withField("page_idx", F.coalesce(b["page_idx"], i.cast("int"))))))
    blocks = F.when(F.regexp_like(c, F.lit(r"^\s*\[\s*\[")), nested).otherwise(flat)
    return F.transform(F.filter(blocks, lambda b: b["type"].isin("image", "chart")), lambda b: F.struct(b["page_idx"].alias("page_idx"), F.coalesce(b["img_path"], b["content"]["image_source"]["path"]).alias("path"), F.array_join(b["caption"], " ").alias("caption")))


class _Page(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


def _records(file: str) -> Iterator[tuple]:
    with open(file, encoding="utf-8") as f:
        page = json.load(f)
    for r in page.get("records") or []:
        yield str(r.get("id")), json.dumps(r, ensure_ascii=False, sort_keys=True), os.path.basename(file)


class _PagesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_Page(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _records(partition.file)


class _PagesStream(SimpleDataSourceStreamReader):
    """Offset = number of pages taken: a restart goes on at the page after the last committed one."""

    def __init__(self, folder: str):
        self.folder = folder

    def _files(self) -> list[str]:
        return [os.path.join(self.folder, f) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")]

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        files = self._files()[start["page"] :]
        return iter([r for f in files for r in _records(f)]), {"page": start["page"] + len(files)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for f in self._files()[start["page"] : end["page"]] for r in _records(f)])


class PagedSource(DataSource):
    """A harvest kept as pages with resumption by page, as a batch and a streaming source named ``pages``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "id string, record string, page string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PagesStream(self.options["path"])


#: A harvested record as XML, namespaces stripped.
HARVEST = "id string, created string, updated string, title string, categories string, license string, doi string, abstract string, authors struct<author:array<struct<keyname:string,forenames:string,suffix:string>>>"


def harvest_records(c: Column) -> Column:
    """A harvested record's XML as a struct: squeezed fields, author names as forenames keyname suffix, categories as an array, and a first version from
    the creation date."""
    r = F.from_xml(F.regexp_replace(F.regexp_replace(c, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1"), HARVEST, {"rowTag": "arXiv"})
    clean = lambda x: F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))
    names = F.transform(r["authors"]["author"], lambda a: F.concat_ws(" ", a["forenames"], a["keyname"], a["suffix"]))
    versions = F.when(r["created"].isNotNull(), F.array(F.struct(F.lit("v1").alias("version"), r["created"].alias("created"))))
    return F.struct(*(clean(r[x]).alias(x) for x in ("id", "title", "license", "doi", "abstract")), names.alias("authors"), F.filter(F.split(r["categories"], r"\s+"), lambda x: x != "").alias("categories"), versions.alias("versions"), F.coalesce(r["updated"], r["created"]).alias("update_date"))


def first_format(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset kept as Parquet, JSON lines or CSV, whichever is there first in that order, else as papers.jsonl, else as a folder for each paper."""
    readers = ((spark.read.parquet, "data.parquet"), (spark.read.json, "data.jsonl"), (spark.read.option("header", True).csv, "data.csv"), (spark.read.parquet, "*.parquet"), (spark.read.json, "papers.jsonl"), (spark.read.json, "*.jsonl"), (spark.read.option("header", True).csv, "*.csv"))
    for read, pattern in readers:
        if _exists(spark, f"{folder}/{pattern}"):
            return read(f"{folder}/{pattern}")
    if _exists(spark, f"{folder}/*/markdown.md") or _exists(spark, f"{folder}/*/*/markdown.md"):
        return paper_folders(spark, folder)
    raise FileNotFoundError(folder)


def by_any_id(records: DataFrame, ids: list[Column]) -> DataFrame:
    """(id, record): the record that each of several ids names (a column of ids may be an array); the last record of an id counts, by the record itself
    if its order is not known."""
    lists = [F.array(c.cast("string")) if not isinstance(records.select(c).schema[0].dataType, T.ArrayType) else c.cast("array<string>") for c in ids]
    rows = records.select(F.struct(*records.columns).alias("record"), F.explode(F.array_compact(F.array_distinct(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))))).alias("id"))
    return rows.filter("id <> ''").groupBy("id").agg(F.max("record").alias("record"))


Page = tuple[list[tuple[str, str]], str | None]


def harvest(windows: DataFrame, load: Callable[[], Callable[[str, str, str | None], Page]], retries: int = 3, base: float = 0.5, limit: int | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(window_no, id, record, page, status): the records of date windows (window_no, window_start, window_end as text) of a paged service.

    ``load`` makes a client in each worker; called with a window's dates and a resumption token it returns a page's (id, record) pairs and the next
    token, none after the last page.  A page is tried again with back-off; a window that the service refuses (``NotAcceptable``) or that fails for good
    gives one row that says so and is passed over.  ``limit`` bounds the records taken, the first windows' first."""
    from foliomill.sources.lookup import Permanent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = load()
        for pdf in batches:
            for no, start, end in zip(pdf["window_no"], pdf["window_start"], pdf["window_end"]):
                token, page, more = None, 0, True
                while more:
                    status, rows = "record", []
                    for n in range(retries + 1):
                        try:
                            rows, token = fetch(start, end, token)
                            break
                        except NotAcceptable:
                            status = "skipped"
                            break
                        except Permanent as error:
                            status = f"failed: {error}"
                            break
                        except Exception as error:
                            if n == retries:
                                status = f"failed: {type(error).__name__}: {error}"
                                break
                            wait(min(300.0, base * 2**n))
                    found = [(no, i, r, page, status) for i, r in rows] if status == "record" else [(no, None, None, page, status)]
                    yield pd.DataFrame(found, columns=["window_no", "id", "record", "page", "status"])
                    more, page = status == "record" and token is not None, page + 1

    kinds = dict(windows.dtypes)
    spread = windows.select("window_no", F.col("window_start").cast("string"), F.col("window_end").cast("string")).repartition("window_no")
    rows = spread.mapInPandas(run, f"window_no {kinds['window_no']}, id string, record string, page int, status string")
    if limit is None:
        return rows
    return rows.orderBy("window_no", "page", "id").limit(limit)


class NotAcceptable(Exception):
    """The service refuses a window."""


def by_folder(spark: SparkSession, glob: str, schema: str, depth: int = 2, name: str = "condition", required: str | None = None) -> DataFrame:
    """JSON lines of many folders; the folder ``depth`` above each file names its condition; rows of broken lines, and those without the ``required``
    field, are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob)
    rows = rows.withColumn(name, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -depth))
    return rows.filter(F.trim(required) != "") if required else rows


def corpora(spark: SparkSession, folders: dict[str, str], pattern: str = "*.pdf") -> DataFrame:
    """``inventory`` of several corpora with the name of each; folders that are not there or hold no such file are left out."""
    found = [inventory(spark, path, pattern).withColumn("corpus", F.lit(name)) for name, path in folders.items() if _exists(spark, path)]
    if not found:
        raise FileNotFoundError(", ".join(folders.values()))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def papers_root(spark: SparkSession, roots: list[str], layouts: tuple[str, ...] = ("*/markdown.md", "*/*/markdown.md", "preprocessed/*/markdown.md")) -> str:
    """The first of several roots below which papers lie in one of the layouts."""
    for root in roots:
        if any(_exists(spark, f"{root}/{layout}") for layout in layouts):
            return root
    raise FileNotFoundError(", ".join(roots))
