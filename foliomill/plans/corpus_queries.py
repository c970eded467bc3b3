"""Queries over documents, discovered PDFs and splits: text, quality, filters, quotas, statistics, sampling and packing.

Each entry of QUERIES has the DuckDB statement of the same name in SQL, unless SQL cannot express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import arrow, ids, text
from foliomill.operators import ranking, relations, selection, validate
from foliomill.plans.runtime import at_least, cut, small, table

PDF_COLUMNS = ["document_id", "source", "original_filename", "original_relative_path", "shard", "member_path", "size_bytes", "sha256", "metadata", "discovered_at"]
#: Subject terms of the two broad domains and of the cascade.
MEDICAL_TERMS = ("clinical", "patient", "tumour", "vaccine", "lesion", "diagnosis")
BIOLOGY_TERMS = ("cell", "genome", "protein", "colony", "biofilm", "membrane")


def papers(spark: SparkSession, sf: str, *need: str) -> DataFrame:
    """Each document's last discovery, flat: document_id and the fields named (all, if none is).  Only these and the fields that order the discoveries are
    shuffled, so a query that reads no abstract moves none."""
    rows = table(spark, sf, "pdf_entries", PDF_COLUMNS).withColumn("source", F.trim(F.lower("source")))
    nested = {c: F.col(f"metadata.{c}") for c in ("title", "year", "license", "doi", "abstract")}
    plain = ("source", "original_filename", "original_relative_path", "shard", "size_bytes", "sha256", "discovered_at")
    order = ["discovered_at", "source", "year", "license", "sha256"]
    wanted = need or (*plain, *nested)
    flat = rows.select("document_id", *(nested[c].alias(c) if c in nested else F.col(c) for c in dict.fromkeys((*wanted, *order))))
    return relations.latest(flat, ["document_id"], order, list(wanted))


PAPERS = """papers AS (
  SELECT document_id, trim(lower(source)) AS source, original_filename, original_relative_path, shard, size_bytes, sha256, discovered_at,
         metadata.title AS title, metadata.year AS year, metadata.license AS license, metadata.doi AS doi, metadata.abstract AS abstract
  FROM pdf_entries
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY discovered_at DESC NULLS LAST, trim(lower(source)) DESC NULLS LAST, metadata.year DESC NULLS LAST, metadata.license DESC NULLS LAST, sha256 DESC NULLS LAST) = 1)"""
LABEL = "nullif(nullif(trim(regexp_replace(translate(lower(license), '_-', '  '), ' +', ' ', 'g')), ''), 'unspecified')"
TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"


def latest_papers(spark, sf):
    return papers(spark, sf, "source", "year", "license", "size_bytes").select("document_id", "source", "year", "license", "size_bytes")


def text_normalize(spark, sf):
    d = table(spark, sf, "documents", ["doc_id", "text"])
    ascii_only = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+", " "))
    return d.select("doc_id", F.md5(ascii_only).alias("digest"), F.length(ascii_only).cast("long").alias("n_chars"))


def safe_path_ids(spark, sf):
    return papers(spark, sf, "original_filename", "title").select("document_id", text.safe_name("original_filename").alias("safe_name"), text.slug("title").alias("slug"))


def document_keys(spark, sf):
    p = papers(spark, sf, "source", "doi", "title", "original_relative_path")
    return p.select("document_id", text.document_key(F.col("source"), F.coalesce(text.truthy("doi"), text.truthy("title"), F.col("document_id")), F.col("original_relative_path")).alias("key"))


def license_family_counts(spark, sf):
    label = text.license_label("license")
    return papers(spark, sf, "license").select(label.alias("label"), text.license_family(label).alias("family")).groupBy("family", "label").agg(F.count("*").alias("n"))


REJECTIONS = ["malformed", "outside_years", "missing_license", "disallowed_license", "missing_doi", "missing_abstract"]


def _rejected(spark, sf):
    p = papers(spark, sf, "source", "title", "year", "license", "doi", "abstract", "discovered_at").withColumn("label", text.license_label("license"))
    family = text.license_family(F.col("label"))
    rules = [
        (F.col("title").isNull() | (F.trim("title") == ""), "malformed"),
        (~F.coalesce(F.col("year").between(2005, 2024), F.lit(False)), "outside_years"),
        (F.col("label").isNull(), "missing_license"),
        (~F.coalesce(family.isin("cc by", "cc by-sa", "cc0"), F.lit(False)), "disallowed_license"),
        (text.truthy("doi").isNull(), "missing_doi"),
        (text.truthy("abstract").isNull(), "missing_abstract"),
    ]
    return selection.with_rejection(p, rules)


REJECTED = f"""{PAPERS}, labelled AS (SELECT *, {LABEL} AS label FROM papers), rejected AS (
  SELECT *, CASE WHEN title IS NULL OR trim(title) = '' THEN 'malformed'
    WHEN NOT coalesce(year BETWEEN 2005 AND 2024, false) THEN 'outside_years'
    WHEN label IS NULL THEN 'missing_license'
    WHEN NOT (label LIKE 'cc0%' OR (label LIKE 'cc by%' AND label NOT LIKE 'cc by nc%')) THEN 'disallowed_license'
    WHEN doi IS NULL OR trim(doi) = '' THEN 'missing_doi'
    WHEN abstract IS NULL OR trim(abstract) = '' THEN 'missing_abstract' END AS rejection
  FROM labelled)"""


def candidate_rejections(spark, sf):
    return _rejected(spark, sf).select("document_id", "rejection")


def rejection_funnel(spark, sf):
    return _rejected(spark, sf).groupBy("source", F.coalesce("rejection", F.lit("selected")).alias("outcome")).agg(F.count("*").alias("n"))


#: Quotas by priority: name, title term, rows.
QUOTAS = [("clinical", "clinical", 12), ("neural", "neural", 20), ("any", "", 40)]


def quota_selection(spark, sf):
    ok = _rejected(spark, sf).filter("rejection is null").select("document_id", "title", "discovered_at")
    groups = [(name, F.contains(F.lower("title"), F.lit(term)), n) for name, term, n in QUOTAS]
    return selection.priority_quota(ok, "document_id", groups, ["discovered_at", "document_id"]).select("document_id", "quota_group")


def quota_stop(spark, sf):
    """Reasons counted among the rows that are scanned: those up to the one that fills the last quota, or all if a quota stays unfilled."""
    rows = _rejected(spark, sf).select("document_id", "title", "discovered_at", "rejection")
    groups = [(n, F.contains(F.lower("title"), F.lit(t)), q) for n, t, q in QUOTAS]
    scanned = selection.until_filled(rows, F.col("rejection").isNull(), "document_id", groups, ["discovered_at", "document_id"])
    return scanned.groupBy(F.coalesce("rejection", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


_QUOTA_CTE = REJECTED + """,
ok AS (SELECT document_id, lower(title) AS title, discovered_at FROM rejected WHERE rejection IS NULL),
a AS (SELECT document_id, discovered_at, 'clinical' AS quota_group FROM ok WHERE contains(title, 'clinical') ORDER BY discovered_at, document_id LIMIT 12),
b AS (SELECT document_id, discovered_at, 'neural' AS quota_group FROM ok WHERE contains(title, 'neural') AND document_id NOT IN (SELECT document_id FROM a) ORDER BY discovered_at, document_id LIMIT 20),
c AS (SELECT document_id, discovered_at, 'any' AS quota_group FROM ok WHERE document_id NOT IN (SELECT document_id FROM a UNION ALL SELECT document_id FROM b) ORDER BY discovered_at, document_id LIMIT 40),
picked AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"""


def source_cap(spark, sf):
    ok = _rejected(spark, sf).filter("rejection is null").select("document_id", "source", "discovered_at")
    return selection.top_per_group(ok, ["source"], [F.col("discovered_at"), F.col("document_id")], 25).select("document_id", "source", F.col("rank").cast("long").alias("rank"))


def domain_cascade(spark, sf):
    t = F.lower(F.coalesce("title", F.lit("")))
    rules = [
        (F.col("source") == "acl", "language"),
        (t.contains("neural") & t.contains("sensor"), "signal"),
        (t.contains("clinical") | t.contains("patient"), "clinical"),
        (t.contains("genome") | t.contains("cell"), "cell"),
        (F.col("source").isin("physics", "engineering") & t.contains("magnetic"), "magnetism"),
        (F.col("source") == "physics", "physics"),
        (F.col("source") == "engineering", "engineering"),
        (F.col("source") == "medicine", "medicine"),
        (F.col("source") == "biology", "biology"),
    ]
    return papers(spark, sf, "source", "title").select("document_id", text.first_matching(rules, "unknown").alias("domain"))


def term_score_domain(spark, sf):
    """Distinct terms of each class contained in title and abstract; medicine must lead outright."""
    hay = F.lower(F.concat_ws(" ", "title", "abstract"))
    med, bio = (sum((F.contains(hay, F.lit(t)).cast("int") for t in terms), F.lit(0)) for terms in (MEDICAL_TERMS, BIOLOGY_TERMS))
    p = papers(spark, sf, "title", "abstract").select("document_id", med.alias("medical"), bio.alias("biological"))
    return p.withColumn("domain", F.when((F.col("medical") == 0) & (F.col("biological") == 0), None).when(F.col("medical") > F.col("biological"), "medicine").otherwise("biology"))


def _terms(terms):
    return " + ".join(f"contains(hay, '{t}')::INT" for t in terms)


def page_stats(spark, sf):
    """Exact quantiles, mean, deviation and failures of text length, by source and for all."""
    d = table(spark, sf, "documents", ["source", "n_chars"])
    v = F.col("n_chars").cast("double")
    aggs = [F.count("*").alias("n"), F.count_if(F.col("n_chars").isNull()).alias("failed"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg(v), 2).alias("mean"), F.round(F.stddev_samp(v), 2).alias("deviation")]
    aggs += [F.round(F.percentile(v, F.lit(q)), 2).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]
    return d.groupingSets([[F.col("source")], []], F.col("source")).agg(*aggs).withColumn("source", F.coalesce("source", F.lit("all")))


BINS = (100, 250, 500, 1000, 2000, 4000, 8000)


def page_histogram(spark, sf):
    """Inclusive upper bounds with an overflow bin; empty bins stay."""
    bins = spark.createDataFrame([(i, str(b)) for i, b in enumerate(BINS)] + [(len(BINS), f"{BINS[-1]}+")], "bin_no int, bin string")
    d = table(spark, sf, "documents", ["n_chars"]).filter("n_chars is not null")
    at = F.lit(len(BINS))
    for i, b in reversed(list(enumerate(BINS))):
        at = F.when(F.col("n_chars") <= b, i).otherwise(at)
    counts = d.groupBy(at.cast("int").alias("bin_no")).agg(F.count("*").alias("n"))
    return F.broadcast(bins).join(counts, "bin_no", "left").select("bin_no", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def _pruned(spark, sf):
    d = table(spark, sf, "documents", ["doc_id", "source", "n_chars"]).filter("n_chars is not null and source is not null")
    return selection.cap_plan(d, "source", "n_chars", "doc_id", 120, 6000, 40)


def prune_plan(spark, sf):
    return _pruned(spark, sf).select("doc_id", "source", "action", "reason")


def prune_summary(spark, sf):
    p = _pruned(spark, sf)
    aggs = [F.count("*").alias("before"), F.count_if(F.col("action") == "keep").alias("kept"), *(F.count_if(F.col("reason") == r).alias(r) for r in ("short", "long", "cap"))]
    return p.rollup("source").agg(*aggs).withColumn("source", F.coalesce("source", F.lit("all")))


PRUNED = """marked AS (
  SELECT doc_id, source, n_chars, CASE WHEN n_chars <= 120 THEN 'short' WHEN n_chars >= 6000 THEN 'long' END AS reason FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL),
ranked AS (SELECT *, count_if(reason IS NULL) OVER (PARTITION BY source) - 40 AS over_cap, row_number() OVER (PARTITION BY source, reason IS NULL ORDER BY n_chars DESC, doc_id DESC) AS rn FROM marked),
pruned AS (SELECT doc_id, source, CASE WHEN reason IS NULL AND rn <= over_cap THEN 'cap' ELSE reason END AS reason FROM ranked)"""


def stratified_split(spark, sf):
    return selection.split_by_fraction(papers(spark, sf, "source").select("document_id", "source"), "source", "document_id", 0.1, "s1").select("document_id", "source", "split")


def sample_split(spark, sf):
    return selection.split_by_counts(papers(spark, sf, "source").select("document_id", "source"), "source", "document_id", 40, 10, "s2").select("document_id", "source", "split")


def split_counts(spark, sf):
    rows = selection.split_by_fraction(papers(spark, sf, "source").select("document_id", "source"), "source", "document_id", 0.1, "s1")
    return rows.groupBy("source").pivot("split", ["train", "test"]).count().select("source", F.coalesce("train", F.lit(0)).alias("train"), F.coalesce("test", F.lit(0)).alias("test"))


def hamilton_allocation(spark, sf):
    sizes = table(spark, sf, "documents", ["source"]).filter("source is not null").groupBy("source").agg(F.count("*").alias("size"))
    return selection.allocate(sizes, "source", "size", 333).select("source", "size", "allocated")


SHARD_BYTES, SHARD_FILES = 20_000_000, 12


def shard_plan(spark, sf):
    return selection.next_fit(papers(spark, sf, "source", "size_bytes").select("source", "document_id", "size_bytes"), "source", "document_id", "size_bytes", SHARD_BYTES, SHARD_FILES)


def shard_report(spark, sf):
    return shard_plan(spark, sf).groupBy("source", "shard_no").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.min("document_id").alias("first"))


SHARDS = f"""WITH RECURSIVE {PAPERS},
files AS (SELECT source, document_id, size_bytes, row_number() OVER (PARTITION BY source ORDER BY document_id) AS rn FROM papers WHERE source IS NOT NULL AND size_bytes IS NOT NULL),
fold AS (
  SELECT source, document_id, size_bytes, rn, 0::BIGINT AS shard_no, size_bytes::BIGINT AS used, 1::BIGINT AS n FROM files WHERE rn = 1
  UNION ALL
  SELECT f.source, f.document_id, f.size_bytes, f.rn,
    CASE WHEN o.used + f.size_bytes > {SHARD_BYTES} OR o.n >= {SHARD_FILES} THEN o.shard_no + 1 ELSE o.shard_no END,
    CASE WHEN o.used + f.size_bytes > {SHARD_BYTES} OR o.n >= {SHARD_FILES} THEN f.size_bytes ELSE o.used + f.size_bytes END,
    CASE WHEN o.used + f.size_bytes > {SHARD_BYTES} OR o.n >= {SHARD_FILES} THEN 1 ELSE o.n + 1 END
  FROM fold o JOIN files f ON f.source = o.source AND f.rn = o.rn + 1)"""


def exact_duplicates(spark, sf):
    """Documents with the bytes of an earlier one: the first document_id of equal bytes is canonical."""
    p = papers(spark, sf, "source", "sha256").filter("sha256 is not null").select("sha256", "document_id", "source")
    first = p.groupBy("sha256").agg(F.min_by(F.struct("document_id", "source"), "document_id").alias("c"), F.count("*").alias("n")).filter("n > 1")
    return p.join(first, "sha256").filter("document_id <> c.document_id").select("sha256", F.col("c.document_id").alias("canonical_document_id"), F.col("document_id").alias("duplicate_document_id"), F.col("c.source").alias("canonical_source"), F.col("source").alias("duplicate_source"))


def bytes_by_source(spark, sf):
    return papers(spark, sf, "source", "sha256", "size_bytes").groupBy("source").agg(F.count("*").alias("files"), F.countDistinct("sha256").alias("distinct_files"), F.sum("size_bytes").alias("bytes"))


#: So many abstracts are broadcast, some 50 MB; more are shuffled.
ABSTRACTS = 50_000


def _quality(spark, sf):
    # A scan with fewer pieces than cores is spread before texts are taken apart.
    d = at_least(table(spark, sf, "documents", ["doc_id", "paper_id", "text"]).filter("text is not null"))
    p = papers(spark, sf, "title", "abstract").select(F.col("document_id").alias("paper_id"), "title", "abstract")
    # Only abstracts of papers that have a document meet texts; where they are few, texts are not shuffled.
    named = table(spark, sf, "documents", ["paper_id"]).distinct()
    p = small(cut(p.join(named, "paper_id", "left_semi")), ABSTRACTS)
    x = d.join(p, "paper_id", "left").withColumn("a", text.word_set("text")).withColumn("b", text.word_set("abstract"))
    inter = F.size(F.array_intersect("a", "b")).cast("double")
    return x.select(
        "doc_id", F.col("title").isNotNull().alias("matched"), text.heading_count("text").cast("long").alias("headings"), text.table_row_count("text").cast("long").alias("table_rows"), F.size("a").cast("long").alias("words"),
        F.when(F.size("b") > 0, text.jaccard(F.col("a"), F.col("b"))).alias("jaccard"), F.when(F.size("b") > 0, inter / F.size("b")).alias("recall"), F.when(F.size("a") > 0, inter / F.size("a")).alias("precision"),
    )


def parsed_quality_rows(spark, sf):
    q = _quality(spark, sf)
    return q.select("doc_id", "matched", "headings", "table_rows", "words", *(F.round(c, 6).alias(c) for c in ("jaccard", "recall", "precision")))


def parsed_quality_report(spark, sf):
    q = _quality(spark, sf)
    return q.agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"), F.sum("headings").alias("headings"), F.sum("table_rows").alias("table_rows"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("jaccard", "recall", "precision")), F.round(F.avg(F.when(F.col("jaccard") > 0.1, 1.0).otherwise(0.0)), 6).alias("share_close"))


_QUALITY = f"""{PAPERS}, joined AS (
  SELECT d.doc_id, d.text, p.title, {TOKENS.format('d.text')} AS a, {TOKENS.format('p.abstract')} AS b
  FROM documents d LEFT JOIN papers p ON p.document_id = d.paper_id WHERE d.text IS NOT NULL),
quality AS (
  SELECT doc_id, title IS NOT NULL AS matched, len(regexp_extract_all(text, '(?m)^#{{1,6}} '))::BIGINT AS headings, len(regexp_extract_all(text, '(?m)^\\|'))::BIGINT AS table_rows, len(a)::BIGINT AS words,
    CASE WHEN len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS jaccard,
    CASE WHEN len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(b) END AS recall,
    CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) END AS precision
  FROM joined)"""


def abstract_similarity(spark, sf):
    """Ratcliff-Obershelp similarity of each document's text with its paper's abstract, an empty one where it has none (an Arrow UDF; no SQL form)."""
    d = table(spark, sf, "documents", ["doc_id", "paper_id", "text"])
    p = papers(spark, sf, "abstract").select(F.col("document_id").alias("paper_id"), "abstract")
    return d.join(p, "paper_id", "left").select("doc_id", F.round(arrow.similarity_udf("text", "abstract"), 6).alias("similarity"))


def plain_texts(spark, sf):
    """Documents without tags, entities, TeX and links, casefolded (an Arrow UDF; no SQL form)."""
    return table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.md5(arrow.plain_text_udf("text")).alias("digest"))


def markdown_counts(spark, sf):
    m = F.coalesce("markdown", F.lit(""))
    return table(spark, sf, "text_samples", ["sample_id", "markdown"]).dropDuplicates(["sample_id"]).select("sample_id", text.heading_count(m).cast("long").alias("headings"), text.table_row_count(m).cast("long").alias("table_rows"), F.size(text.image_links(m)).cast("long").alias("images"), F.regexp_count(m, F.lit("\n")).cast("long").alias("breaks"))


def top_words(spark, sf):
    """The hundred most frequent title words; ties alphabetical."""
    words = papers(spark, sf, "title").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z-]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


def split_paths(spark, sf):
    """Violations of the path rules in split entries."""
    e = table(spark, sf, "split_index", ["entry_id", "split", "entry"])
    parts = F.split("entry", "/")
    rules = [(F.contains("entry", F.lit("\\")), "backslash"), (F.startswith("entry", F.lit("/")), "absolute"), (F.exists(parts, lambda p: p.isin("", ".", "..")), "bad_part"), (~F.endswith(F.lower("entry"), F.lit(".pdf")), "no_pdf")]
    return selection.with_rejection(e, rules, "violation").filter("violation is not null").select("entry_id", "split", "violation")


def _entries(spark, sf):
    plain = F.regexp_replace(F.lower(F.trim("entry")), "/(\\./)*/*", "/")
    return table(spark, sf, "split_index", ["entry_id", "split", "entry", "entry_pos"]).withColumn("path", F.regexp_replace(plain, "^\\./", ""))


_ENTRIES = """entries AS (SELECT entry_id, split, entry_pos, regexp_replace(regexp_replace(lower(trim(entry)), '/(\\./)*/*', '/', 'g'), '^\\./', '') AS path FROM split_index)"""


def split_duplicates(spark, sf):
    return relations.repeated(_entries(spark, sf), ["split", "path"])


def split_intersection(spark, sf):
    e = _entries(spark, sf)
    return e.filter("split = 'train'").select("path").intersect(e.filter("split = 'test'").select("path"))


def split_other(spark, sf):
    """Papers in no split."""
    p = papers(spark, sf, "source", "original_relative_path").withColumn("path", F.concat("source", F.lit("/"), F.lower("original_relative_path")))
    return p.join(_entries(spark, sf).select("path").distinct(), "path", "left_anti").select("document_id", "source")


def split_papers(spark, sf):
    """The paper of each split entry, in the place it has in its list; null for one that is missing."""
    p = papers(spark, sf, "source", "original_relative_path").select(F.concat("source", F.lit("/"), F.lower("original_relative_path")).alias("path"), "document_id")
    return _entries(spark, sf).join(p, "path", "left").select("entry_id", "split", "entry_pos", "document_id")


def paper_versions(spark, sf):
    """Row fields read from file names: year folder, number, version, and the last valid version first."""
    p = papers(spark, sf, "original_relative_path", "original_filename").select("document_id", F.regexp_extract("original_relative_path", "^([0-9]{4})/", 1).alias("folder"), F.regexp_extract("original_filename", "([0-9]{8})(?:v([0-9]+))?[.]", 2).alias("version"), F.regexp_extract("original_filename", "([0-9]{8})", 1).alias("number"))
    return p.select("document_id", F.expr("try_cast(nullif(folder, '') as int)").alias("folder_year"), F.expr("try_cast(nullif(version, '') as int)").alias("version"), F.expr("try_cast(nullif(number, '') as int)").alias("number"))


def export_sample(spark, sf):
    """The first 20 papers of each source by digest order, as an export bundle would take them."""
    p = papers(spark, sf, "source", "sha256").select("document_id", "source", "sha256")
    return selection.top_per_group(p, ["source"], [F.col("sha256"), F.col("document_id")], 20).select("document_id", "source", F.col("rank").cast("long").alias("rank"))


def export_queries(spark, sf):
    """The first twenty test entries of each source whose paper has requests, in the order of the list, with the number of these."""
    p = papers(spark, sf, "source", "original_relative_path").select(F.concat("source", F.lit("/"), F.lower("original_relative_path")).alias("path"), "document_id", "source")
    asked = table(spark, sf, "generation_requests", ["metadata"]).groupBy(F.col("metadata.paper_id").alias("document_id")).agg(F.count("*").alias("n_requests"))
    rows = _entries(spark, sf).filter("split = 'test'").join(p, "path").join(asked, "document_id")  # the test list is what is exported
    return selection.top_per_group(rows, ["source"], [F.col("entry_pos"), F.col("entry_id")], 20).select("source", "entry_id", "document_id", "n_requests", F.col("rank").cast("long").alias("rank"))


def walk_order(spark, sf):
    """Files in the order of a walk in which a folder sorts as its name with a slash: the order of whole paths by bytes."""
    p = papers(spark, sf, "source", "original_relative_path").filter("source is not null and original_relative_path is not null")
    p = p.select("document_id", F.concat("source", F.lit("/"), "original_relative_path").alias("path"))
    return ranking.ranked(p, [], [F.col("path"), F.col("document_id")], "place").select("document_id", "place")


def id_repair(spark, sf):
    """Ids made unique: the n-th holder of a file name gets a suffix."""
    p = papers(spark, sf, "source", "original_filename").select("document_id", "source", F.lower(F.regexp_extract("original_filename", "([A-Za-z]+)", 1)).alias("stem"))
    w = Window.partitionBy("source", "stem").orderBy("document_id")
    n, rn = F.count("*").over(Window.partitionBy("source", "stem")), F.row_number().over(w)
    return p.select("document_id", F.concat("stem", F.when(rn > 1, F.concat(F.lit("-"), F.hex(rn.cast("long") - 1))).otherwise(F.lit(""))).alias("unique_id"), n.alias("holders"))


def reconcile_sizes(spark, sf):
    """The papers that requests name, with the source they give, against the papers discovered."""
    asked = table(spark, sf, "generation_requests", ["metadata"]).select(F.col("metadata.paper_id").alias("document_id"), F.lower(F.trim("metadata.source_paper_dataset")).alias("source")).filter("document_id is not null")
    asked = asked.groupBy("document_id").agg(F.min("source").alias("source"))
    return relations.reconcile(asked, papers(spark, sf, "source"), "document_id", ["source"]).groupBy("status").agg(F.count("*").alias("n"))


def package_violations(spark, sf):
    """Rules that discovered files break: path, digest, size, archive member, shard name."""
    p = papers(spark, sf, "original_relative_path", "sha256", "size_bytes", "year").join(table(spark, sf, "pdf_entries", ["document_id", "member_path"]).groupBy("document_id").agg(F.min("member_path").alias("member_path")), "document_id")
    rules = {"path": validate.unsafe_path(F.col("original_relative_path"), ".pdf"), "digest": validate.bad_digest(F.col("sha256")), "size": validate.bad_size(F.col("size_bytes")), "member": F.col("member_path") != F.concat("document_id", F.lit(".pdf")), "year": ~F.coalesce(F.col("year").between(1900, 2100), F.lit(False))}
    return validate.violations(p, "document_id", rules)


def quota_targets(spark, sf):
    """Whether each source's quota of accepted papers is reached."""
    ok = _rejected(spark, sf).filter("rejection is null").select("source")
    return validate.targets_met(ok, "source", {"acl": 20, "biology": 200, "medicine": 120, "law": 1})


def paper_strata(spark, sf):
    """Papers by stratum: source and year, with fallbacks."""
    return papers(spark, sf, "source", "year").groupBy(ids.stratum(None, F.col("source"), F.col("year")).alias("stratum")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    package_violations, quota_targets, paper_strata, latest_papers, text_normalize, safe_path_ids, document_keys, license_family_counts, candidate_rejections, rejection_funnel, quota_selection, quota_stop, source_cap, domain_cascade, term_score_domain, page_stats, page_histogram, prune_plan,
    prune_summary, stratified_split, sample_split, split_counts, hamilton_allocation, shard_plan, shard_report, exact_duplicates, bytes_by_source, parsed_quality_rows, parsed_quality_report, abstract_similarity, plain_texts, markdown_counts, top_words,
    split_paths, split_duplicates, split_intersection, split_other, split_papers, paper_versions, export_sample, export_queries, walk_order, id_repair, reconcile_sizes,
)}

_HASHED = "row_number() OVER (PARTITION BY source ORDER BY md5('{}' || '|' || document_id), document_id)"
_SLUG = "rtrim(substr(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-')"

SQL = {
    "package_violations": f"""WITH {PAPERS}, m AS (SELECT document_id, min(member_path) AS mp FROM pdf_entries GROUP BY 1), v AS (
  SELECT p.document_id, unnest([
    CASE WHEN coalesce(contains(original_relative_path, chr(92)) OR len(list_filter(string_split(original_relative_path, '/'), lambda x: x IN ('', '.', '..'))) > 0, true) OR NOT ends_with(lower(original_relative_path), '.pdf') THEN 'path' END,
    CASE WHEN NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{{64}}'), false) THEN 'digest' END, CASE WHEN coalesce(size_bytes < 0, true) THEN 'size' END,
    CASE WHEN coalesce(mp <> p.document_id || '.pdf', true) THEN 'member' END, CASE WHEN NOT coalesce(year BETWEEN 1900 AND 2100, false) THEN 'year' END]) AS rule
  FROM papers p JOIN m ON m.document_id = p.document_id) SELECT * FROM v WHERE rule IS NOT NULL""",
    "quota_targets": f"WITH {REJECTED}, t(source, target) AS (VALUES ('acl', 20), ('biology', 200), ('medicine', 120), ('law', 1)), c AS (SELECT source, count(*) AS n FROM rejected WHERE rejection IS NULL GROUP BY 1) SELECT t.source, coalesce(n, 0) AS n, target, coalesce(n, 0) >= target AS met FROM t LEFT JOIN c ON c.source = t.source",
    "paper_strata": f"WITH {PAPERS} SELECT coalesce(nullif(trim(source), ''), 'unknown') || ':' || coalesce(year::VARCHAR, 'unknown') AS stratum, count(*) AS n FROM papers GROUP BY 1",
    "latest_papers": f"WITH {PAPERS} SELECT document_id, source, year, license, size_bytes FROM papers",
    "text_normalize": "WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM documents) SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n_chars FROM d",
    "safe_path_ids": f"WITH {PAPERS} SELECT document_id, coalesce(nullif(regexp_replace(regexp_replace(original_filename, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown') AS safe_name, {_SLUG.format('title')} AS slug FROM papers",
    "document_keys": f"WITH {PAPERS} SELECT document_id, concat_ws('-', {_SLUG.format('source')}, {_SLUG.format('''coalesce(CASE WHEN trim(doi) <> '' THEN doi END, CASE WHEN trim(title) <> '' THEN title END, document_id)''')}, substr(sha1(source || chr(0) || original_relative_path), 1, 12)) AS key FROM papers",
    "license_family_counts": f"WITH {PAPERS}, l AS (SELECT {LABEL} AS label FROM papers) SELECT CASE WHEN label IS NULL THEN NULL WHEN label LIKE 'cc0%' THEN 'cc0' WHEN label LIKE 'cc by nc%' THEN 'cc by-nc' WHEN label LIKE 'cc by sa%' THEN 'cc by-sa' WHEN label LIKE 'cc by%' THEN 'cc by' ELSE 'other' END AS family, label, count(*) AS n FROM l GROUP BY ALL",
    "candidate_rejections": f"WITH {REJECTED} SELECT document_id, rejection FROM rejected",
    "rejection_funnel": f"WITH {REJECTED} SELECT source, coalesce(rejection, 'selected') AS outcome, count(*) AS n FROM rejected GROUP BY ALL",
    "quota_selection": f"WITH {_QUOTA_CTE} SELECT document_id, quota_group FROM picked",
    "quota_stop": f"""WITH {_QUOTA_CTE},
filled AS (SELECT (SELECT count(*) FROM a) >= 12 AND (SELECT count(*) FROM b) >= 20 AND (SELECT count(*) FROM c) >= 40 AS yes),
s AS (SELECT discovered_at, document_id FROM picked ORDER BY discovered_at DESC, document_id DESC LIMIT 1)
SELECT coalesce(rejection, 'accepted') AS outcome, count(*) AS n FROM rejected r
WHERE NOT (SELECT yes FROM filled) OR (r.discovered_at, r.document_id) <= (SELECT (discovered_at, document_id) FROM s) GROUP BY ALL""",
    "source_cap": f"WITH {REJECTED} SELECT document_id, source, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY discovered_at, document_id) AS rn FROM rejected WHERE rejection IS NULL) WHERE rn <= 25",
    "domain_cascade": f"""WITH {PAPERS}, t AS (SELECT document_id, source, lower(coalesce(title, '')) AS t FROM papers)
SELECT document_id, CASE WHEN source = 'acl' THEN 'language' WHEN contains(t, 'neural') AND contains(t, 'sensor') THEN 'signal' WHEN contains(t, 'clinical') OR contains(t, 'patient') THEN 'clinical' WHEN contains(t, 'genome') OR contains(t, 'cell') THEN 'cell'
WHEN source IN ('physics', 'engineering') AND contains(t, 'magnetic') THEN 'magnetism' WHEN source IN ('physics', 'engineering', 'medicine', 'biology') THEN source ELSE 'unknown' END AS domain FROM t""",
    "term_score_domain": f"WITH {PAPERS}, h AS (SELECT document_id, lower(concat_ws(' ', title, abstract)) AS hay FROM papers), s AS (SELECT document_id, {_terms(MEDICAL_TERMS)} AS medical, {_terms(BIOLOGY_TERMS)} AS biological FROM h) SELECT *, CASE WHEN medical = 0 AND biological = 0 THEN NULL WHEN medical > biological THEN 'medicine' ELSE 'biology' END AS domain FROM s",
    "page_stats": "SELECT coalesce(source, 'all') AS source, count(*) AS n, count_if(n_chars IS NULL)::BIGINT AS failed, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 2) AS mean, round(stddev_samp(n_chars), 2) AS deviation, " + ", ".join(f"round(quantile_cont(n_chars::DOUBLE, {q}), 2) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM documents GROUP BY GROUPING SETS ((source), ())",
    "page_histogram": "WITH b(bin_no, bin, lo, hi) AS (VALUES " + ", ".join(f"({i}, '{b}', {BINS[i - 1] if i else -1}, {b})" for i, b in enumerate(BINS)) + f", ({len(BINS)}, '{BINS[-1]}+', {BINS[-1]}, 9000000000)) SELECT bin_no, bin, count(n_chars) AS n FROM b LEFT JOIN documents ON n_chars > lo AND n_chars <= hi GROUP BY ALL",
    "prune_plan": f"WITH {PRUNED} SELECT doc_id, source, CASE WHEN reason IS NULL THEN 'keep' ELSE 'delete' END AS action, reason FROM pruned",
    "prune_summary": f"WITH {PRUNED} SELECT coalesce(source, 'all') AS source, count(*) AS before, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'short') AS short, count(*) FILTER (reason = 'long') AS long, count(*) FILTER (reason = 'cap') AS cap FROM pruned GROUP BY ROLLUP (source)",
    "stratified_split": f"WITH {PAPERS}, r AS (SELECT document_id, source, {_HASHED.format('s1')} AS rn, count(*) OVER (PARTITION BY source) AS n FROM papers) SELECT document_id, source, CASE WHEN rn <= CASE WHEN n <= 1 THEN 0 ELSE least(n - 1, greatest(1, round(n * 0.1))) END THEN 'test' ELSE 'train' END AS split FROM r",
    "sample_split": f"WITH {PAPERS}, r AS (SELECT document_id, source, {_HASHED.format('s2')} AS rn FROM papers) SELECT document_id, source, CASE WHEN rn <= 40 THEN 'train' ELSE 'test' END AS split FROM r WHERE rn <= 50",
    "split_counts": f"WITH {PAPERS}, r AS (SELECT source, count(*) AS n FROM papers GROUP BY source), t AS (SELECT source, n, CASE WHEN n <= 1 THEN 0 ELSE least(n - 1, greatest(1, round(n * 0.1))) END::BIGINT AS test FROM r) SELECT source, n - test AS train, test FROM t",
    "hamilton_allocation": "WITH s AS (SELECT source, count(*) AS size FROM documents WHERE source IS NOT NULL GROUP BY source), e AS (SELECT *, size * least(333, sum(size) OVER ())::DOUBLE / sum(size) OVER () AS exact, least(333, sum(size) OVER ()) AS total FROM s), r AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, source DESC) AS rn, total - sum(floor(exact)) OVER () AS remaining FROM e) SELECT source, size, (floor(exact) + CASE WHEN rn <= remaining THEN 1 ELSE 0 END)::BIGINT AS allocated FROM r",
    "shard_plan": f"{SHARDS} SELECT source, document_id, size_bytes, shard_no FROM fold",
    "shard_report": f"{SHARDS} SELECT source, shard_no, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, min(document_id) AS first FROM fold GROUP BY source, shard_no",
    "exact_duplicates": f"WITH {PAPERS}, c AS (SELECT sha256, document_id, source, first_value(document_id) OVER w AS cd, first_value(source) OVER w AS cs FROM papers WHERE sha256 IS NOT NULL WINDOW w AS (PARTITION BY sha256 ORDER BY document_id)) SELECT sha256, cd AS canonical_document_id, document_id AS duplicate_document_id, cs AS canonical_source, source AS duplicate_source FROM c WHERE document_id <> cd",
    "bytes_by_source": f"WITH {PAPERS} SELECT source, count(*) AS files, count(DISTINCT sha256) AS distinct_files, sum(size_bytes)::BIGINT AS bytes FROM papers GROUP BY source",
    "parsed_quality_rows": f"WITH {_QUALITY} SELECT doc_id, matched, headings, table_rows, words, round(jaccard, 6) AS jaccard, round(recall, 6) AS recall, round(precision, 6) AS precision FROM quality",
    "parsed_quality_report": f"WITH {_QUALITY} SELECT count(*) AS n, count_if(matched)::BIGINT AS matched, sum(headings)::BIGINT AS headings, sum(table_rows)::BIGINT AS table_rows, round(avg(jaccard), 6) AS mean_jaccard, round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, round(avg(CASE WHEN jaccard > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share_close FROM quality",
    "markdown_counts": "WITH m AS (SELECT sample_id, coalesce(any_value(markdown), '') AS m FROM text_samples GROUP BY sample_id) SELECT sample_id, len(regexp_extract_all(m, '(?m)^#{1,6} '))::BIGINT AS headings, len(regexp_extract_all(m, '(?m)^\\|'))::BIGINT AS table_rows, (len(regexp_extract_all(m, '!\\[[^\\]]*\\]\\(([^)\\s]+)')) + len(regexp_extract_all(m, '<img[^>]+src=[\"'']([^\"'']+)')))::BIGINT AS images, len(regexp_extract_all(m, '\\n'))::BIGINT AS breaks FROM m",
    "top_words": f"WITH {PAPERS}, w AS (SELECT unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z-]+')) AS word FROM papers) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 100",
    "split_paths": "WITH v AS (SELECT entry_id, split, CASE WHEN contains(entry, chr(92)) THEN 'backslash' WHEN starts_with(entry, '/') THEN 'absolute' WHEN len(list_filter(string_split(entry, '/'), lambda p: p IN ('', '.', '..'))) > 0 THEN 'bad_part' WHEN NOT ends_with(lower(entry), '.pdf') THEN 'no_pdf' END AS violation FROM split_index) SELECT * FROM v WHERE violation IS NOT NULL",
    "split_duplicates": f"WITH {_ENTRIES} SELECT split, path, count(*) AS n FROM entries GROUP BY split, path HAVING count(*) > 1",
    "split_intersection": f"WITH {_ENTRIES} SELECT path FROM entries WHERE split = 'train' INTERSECT SELECT path FROM entries WHERE split = 'test'",
    "split_other": f"WITH {PAPERS}, {_ENTRIES} SELECT document_id, source FROM papers p WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.path = p.source || '/' || lower(p.original_relative_path))",
    "split_papers": f"WITH {PAPERS}, {_ENTRIES} SELECT e.entry_id, e.split, e.entry_pos, p.document_id FROM entries e LEFT JOIN papers p ON e.path = p.source || '/' || lower(p.original_relative_path)",
    "paper_versions": f"WITH {PAPERS} SELECT document_id, TRY_CAST(nullif(regexp_extract(original_relative_path, '^([0-9]{{4}})/', 1), '') AS INT) AS folder_year, TRY_CAST(nullif(regexp_extract(original_filename, '([0-9]{{8}})(?:v([0-9]+))?[.]', 2), '') AS INT) AS version, TRY_CAST(nullif(regexp_extract(original_filename, '([0-9]{{8}})', 1), '') AS INT) AS number FROM papers",
    "export_sample": f"WITH {PAPERS} SELECT document_id, source, rn AS rank FROM (SELECT document_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256, document_id) AS rn FROM papers) WHERE rn <= 20",
    "id_repair": f"WITH {PAPERS}, s AS (SELECT document_id, source, lower(regexp_extract(original_filename, '([A-Za-z]+)', 1)) AS stem FROM papers), r AS (SELECT *, row_number() OVER (PARTITION BY source, stem ORDER BY document_id) AS rn, count(*) OVER (PARTITION BY source, stem) AS holders FROM s) SELECT document_id, stem || CASE WHEN rn > 1 THEN '-' || upper(to_hex(rn - 1)) ELSE '' END AS unique_id, holders FROM r",
    "export_queries": f"WITH {PAPERS}, {_ENTRIES}, q AS (SELECT metadata.paper_id AS document_id, count(*) AS n_requests FROM generation_requests GROUP BY 1), x AS (SELECT p.source, e.entry_id, p.document_id, q.n_requests, row_number() OVER (PARTITION BY p.source ORDER BY e.entry_pos, e.entry_id) AS rank FROM entries e JOIN papers p ON e.path = p.source || '/' || lower(p.original_relative_path) JOIN q ON q.document_id = p.document_id WHERE e.split = 'test') SELECT * FROM x WHERE rank <= 20",
    "walk_order": f"WITH {PAPERS} SELECT document_id, row_number() OVER (ORDER BY source || '/' || original_relative_path, document_id) AS place FROM papers WHERE source IS NOT NULL AND original_relative_path IS NOT NULL",
    "reconcile_sizes": f"WITH {PAPERS}, q AS (SELECT metadata.paper_id AS document_id, min(lower(trim(metadata.source_paper_dataset))) AS source FROM generation_requests WHERE metadata.paper_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN p.document_id IS NULL THEN 'missing' WHEN q.document_id IS NULL THEN 'extra' WHEN q.source IS DISTINCT FROM p.source THEN 'source_mismatch' ELSE 'ok' END AS status, count(*) AS n FROM q FULL JOIN papers p ON p.document_id = q.document_id GROUP BY ALL",
}
