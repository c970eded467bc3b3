"""Queries that write a table in another format to the shared folder and read it back, so that readers and sinks are checked like any operator."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from foliomill.plans import corpus_queries
from foliomill.plans.runtime import cut, ensure_checkpoint_dir, table
from foliomill.sources import readers, sinks


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


def jsonl_documents(spark, sf):
    """All documents as JSON lines and back, strictly read."""
    path = _folder(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf, "documents", ["doc_id", "source", "lang", "text"]), path)
    rows = readers.jsonl(spark, path, "doc_id bigint, source string, lang string, text string")
    return rows.select("doc_id", "source", "lang", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def log_last_rows(spark, sf):
    """Discoveries as a log of JSON lines in order of time, folders by source; each document's last row of its file counts."""
    path = _folder(spark, "log")
    d = table(spark, sf, "pdf_entries", ["document_id", "source", "size_bytes", "discovered_at"]).withColumn("folder", F.lower(F.trim("source"))).filter("folder is not null")
    log = d.groupBy("folder", "document_id").agg(F.max(F.struct("discovered_at", "size_bytes")).alias("x")).select("document_id", "x.size_bytes", "folder")
    sinks.write_groups(log, path, ["folder"], first=True)
    rows = readers.by_folder(spark, f"{path}/*/*.json", "document_id string, size_bytes bigint")
    return rows.select("document_id", F.regexp_replace("condition", "^folder=", "").alias("folder"), "size_bytes")


def csv_orders(spark, sf):
    """All orders as CSV with a header and back, every field as text."""
    path = _folder(spark, "csv")
    sinks.write_csv(table(spark, sf, "orders"), path, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return readers.first_format(spark, path)


def _in_root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of a file between the tags of its root."""
    yield pd.DataFrame({"value": ["<PubmedArticleSet>"]})
    yield from batches
    yield pd.DataFrame({"value": ["</PubmedArticleSet>"]})


def xml_articles(spark, sf):
    """All papers as XML articles and back."""
    path = _folder(spark, "xml")

    def element(tag, value):
        escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(value.cast("string"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
        return F.coalesce(F.concat(F.lit(f"<{tag}>"), escaped, F.lit(f"</{tag}>")), F.lit(""))

    p = corpus_queries.papers(spark, sf, "title", "year")
    year = F.concat(F.lit("<Journal><Title>J</Title><JournalIssue><PubDate>"), element("Year", F.col("year")), F.lit("</PubDate></JournalIssue></Journal>"))
    article = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), F.concat(F.lit('<PMID Version="1">'), "document_id", F.lit("</PMID>")), F.lit("<Article>"), element("ArticleTitle", F.col("title")), year, F.lit("</Article></MedlineCitation></PubmedArticle>"))
    p.select(article.alias("value")).mapInPandas(_in_root, "value string").write.text(path)
    return readers.pubmed(spark, path).select(F.col("pmid").alias("document_id"), "title", "year")


def tar_members(spark, sf):
    """Abstracts packed into TAR shards by the shard plan, and what the archives hold."""
    path = _folder(spark, "tar")
    plan = corpus_queries.shard_plan(spark, sf).select(F.format_string("%s-%05d.tar", "source", "shard_no").alias("shard"), F.col("document_id").alias("name"))
    texts = corpus_queries.papers(spark, sf, "abstract").select(F.col("document_id").alias("name"), F.encode(F.coalesce("abstract", F.lit("")), "UTF-8").alias("content"), F.lit("{}").alias("record"))
    cut(sinks.write_shards(plan.join(texts, "name"), path))
    m = readers.archive(spark, f"{path}/*.tar")
    return m.groupBy(F.regexp_extract("archive", "[^/]+$", 0).alias("shard")).agg(F.count("*").alias("members"), F.sum("size_bytes").alias("bytes"), F.countDistinct("sha256").alias("distinct_members"))


def invalid_answers(spark, sf):
    """Answers as lines of a log: how many of them are no JSON, and no object."""
    path = _folder(spark, "answers")
    r = table(spark, sf, "generation_results", ["result_id", "text"]).dropDuplicates(["result_id"])
    r.select(F.regexp_replace("text", "[\\n\\r]+", " ").alias("value")).filter(F.trim("value") != "").write.text(path)
    return readers.invalid_lines(spark, path).groupBy("problem").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (jsonl_documents, log_last_rows, csv_orders, xml_articles, tar_members, invalid_answers)}

SQL = {
    "jsonl_documents": "SELECT doc_id, source, lang, md5(text) AS digest, length(text)::BIGINT AS n_chars FROM documents",
    "log_last_rows": "SELECT document_id, lower(trim(source)) AS folder, size_bytes FROM pdf_entries WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(source)), document_id ORDER BY discovered_at DESC NULLS LAST, size_bytes DESC NULLS LAST) = 1",
    "invalid_answers": "WITH d AS (SELECT DISTINCT result_id, text FROM generation_results), r AS (SELECT regexp_replace(text, '[\\n\\r]+', ' ', 'g') AS v FROM d), x AS (SELECT v, starts_with(trim(v), '{') AND json_valid(v) AS ok FROM r WHERE trim(v, ' ') <> '') SELECT CASE WHEN json_valid(v) THEN 'no object' ELSE 'invalid JSON' END AS problem, count(*) AS n FROM x WHERE NOT ok GROUP BY 1",
    "csv_orders": "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_orderpriority FROM orders",
    "xml_articles": f"WITH {corpus_queries.PAPERS} SELECT document_id, title, year FROM papers",
    "tar_members": f"""{corpus_queries.SHARDS}, x AS (SELECT f.source || '-' || lpad(shard_no::VARCHAR, 5, '0') || '.tar' AS shard, coalesce(p.abstract, '') AS a FROM fold f JOIN papers p USING (document_id))
SELECT shard, 2 * count(*) AS members, sum(octet_length(encode(a)) + 2)::BIGINT AS bytes, count(DISTINCT a) + 1 - max((a = '{{}}')::INT) AS distinct_members FROM x GROUP BY 1""",
}
