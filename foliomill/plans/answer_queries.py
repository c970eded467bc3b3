"""Queries over requests, answers, interpretations and event logs: joins, components, audits, telemetry, windows and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.functions import arrow, text
from foliomill.operators import agreement, clues, figures, ranking, relations, selection, timeline
from foliomill.plans.runtime import cut, table
from foliomill.streaming import incremental

RESULT_ROWS = "r AS (SELECT DISTINCT result_id, request_id, paper_id, source, stage, attempt, text, generated_tokens, error, finished_at, ingested_at FROM generation_results)"


def _results(spark, sf, *columns):
    return table(spark, sf, "generation_results", ["result_id", *columns]).dropDuplicates(["result_id"])


def _interpretations(spark, sf, *columns):
    return table(spark, sf, "interpretation_records", ["interpretation_id", *columns]).dropDuplicates(["interpretation_id"])


def latest_result(spark, sf):
    """Each request's last result by attempt and time."""
    r = _results(spark, sf, "request_id", "attempt", "finished_at", "stage").filter("request_id is not null")
    return relations.latest(r, ["request_id"], ["attempt", "finished_at", "result_id"], ["result_id", "attempt", "stage"])


def first_result(spark, sf):
    r = _results(spark, sf, "request_id", "attempt", "finished_at").filter("request_id is not null")
    return relations.earliest(r, ["request_id"], ["attempt", "finished_at", "result_id"], ["result_id"])


def pending_requests(spark, sf):
    """Requests without a result, for resuming."""
    return relations.not_done(table(spark, sf, "generation_requests", ["request_id"]), table(spark, sf, "generation_results", ["request_id"]), ["request_id"])


def pending_interpretations(spark, sf):
    """Textual and visual requests whose paper has no interpretation of that kind, prompt and version."""
    r = table(spark, sf, "generation_requests", ["request_id", "metadata"]).select("request_id", F.col("metadata.paper_id").alias("record_id"), F.col("metadata.stage").alias("kind"), F.col("metadata.prompt_id").alias("prompt_id"), F.coalesce("metadata.prompt_version", F.lit("v0")).alias("prompt_version")).filter("kind in ('textual', 'visual')")
    log = table(spark, sf, "interpretation_records", ["record_id", "kind", "prompt_id", "prompt_version"]).withColumn("prompt_version", F.coalesce("prompt_version", F.lit("v0")))
    return relations.not_done(r, log, ["record_id", "kind", "prompt_id", "prompt_version"]).select("request_id")


def retry_papers(spark, sf):
    """Papers with a failed answer, matched by paper id or by file name."""
    p = table(spark, sf, "pdf_entries", ["document_id", "original_filename"]).groupBy("document_id").agg(F.min("original_filename").alias("original_filename"))
    failed = _results(spark, sf, "paper_id", "error").filter("error is not null")
    tail = F.concat(F.regexp_extract("paper_id", "_(Q[A-Z]+[0-9]+)$", 1), F.lit(".pdf"))
    return relations.any_key(p, [F.col("document_id"), F.col("original_filename")], failed, [F.col("paper_id"), tail], "document_id").select("document_id")


def result_papers(spark, sf):
    """The paper each answer belongs to: its own paper_id if known, else its request's, else none."""
    r = _results(spark, sf, "request_id", "paper_id")
    q = table(spark, sf, "generation_requests", ["request_id", "metadata"]).select("request_id", F.col("metadata.paper_id").alias("asked"))
    p = table(spark, sf, "pdf_entries", ["document_id"]).distinct().select(F.col("document_id").alias("key"), F.col("document_id").alias("paper"))
    return relations.first_hit(r.join(q, "request_id", "left"), [F.col("paper_id"), F.col("asked")], p, "key", "paper", "result_id").select("result_id", "paper")


def answer_contract(spark, sf):
    """Requests with no or several results, and results without a request, by kind."""
    v = clues.contract_violations(table(spark, sf, "generation_requests", ["request_id"]), _results(spark, sf, "request_id").filter("request_id is not null"), "request_id")
    return v.groupBy("problem").agg(F.count("*").alias("n"))


def json_answers(spark, sf):
    """Which answers hold a JSON object, bare or inside other text."""
    r = _results(spark, sf, "text", "stage")
    o = clues.json_object(F.col("text"))
    return r.groupBy("stage").agg(F.count("*").alias("n"), F.count(o).alias("objects"))


def judge_claims(spark, sf):
    """Claims of judge answers, one row each."""
    kind = "struct<claims:array<struct<claim:string,supported:boolean,evidence:string>>,overall_grounded:boolean>"
    r = _results(spark, sf, "text", "stage").filter("stage = 'judge'")
    body = F.when(F.startswith("text", F.lit("{")) & F.try_parse_json("text").isNotNull(), F.from_json("text", kind))
    return r.select("result_id", body["overall_grounded"].alias("grounded"), F.posexplode(body["claims"]).alias("pos", "c")).select("result_id", "pos", "c.claim", "c.supported", "grounded")


def _cues(spark, sf):
    i = _interpretations(spark, sf, "record_id", "kind", "text").filter("kind = 'textual'")
    return i.select("interpretation_id", "record_id", F.posexplode(clues.cues(F.col("text"))).alias("pos", "cue"))


def component_flatten(spark, sf):
    """Cues of clean JSON interpretations in their order."""
    return _cues(spark, sf)


def component_categories(spark, sf):
    c = _cues(spark, sf)
    return c.groupBy(F.regexp_extract("cue", "^textual ([^:]*):", 1).alias("category")).agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("papers"))


def loose_components(spark, sf):
    """Cues of all interpretations, broken JSON included (an Arrow UDF; no SQL form)."""
    i = _interpretations(spark, sf, "kind", "text")
    return i.select("interpretation_id", F.posexplode(arrow.components_udf("text", "kind")).alias("pos", "cue"))


def null_queries(spark, sf):
    """Queries of the null backend from each interpretation's cues."""
    c = _interpretations(spark, sf, "record_id", "kind", "text").filter("kind = 'textual'").withColumn("cues", clues.cues(F.col("text"))).filter(F.size("cues") > 0)
    return c.select("interpretation_id", clues.null_query(F.col("cues")).alias("query"))


def judge_prompts(spark, sf):
    """Prompts for a judge: template, cues as bullets and the first thousand characters of the answer."""
    c = _interpretations(spark, sf, "record_id", "kind", "text").filter("kind = 'textual'").withColumn("cues", clues.cues(F.col("text"))).filter(F.size("cues") > 0)
    prompt = clues.render("Paper {paper}\nCues:\n{selected_cues}", {"paper": F.col("record_id"), "selected_cues": clues.bullets(F.col("cues")), "answer": F.substring("text", 1, 1000)})
    return c.select("interpretation_id", F.md5(prompt).alias("digest"), F.length(prompt).cast("long").alias("n_chars"))


class _Echo:
    """The null backend: deterministic, without a model."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [f"Answer to {len(p)} characters." for p in prompts]


def null_answers(spark, sf):
    """Answers of the null backend to all prompts (a Python batch call; no SQL form)."""
    q = table(spark, sf, "generation_requests", ["request_id", "prompt"]).filter("prompt is not null")
    return clues.generate(q, "prompt", _Echo)


def plain_answers(spark, sf):
    r = _results(spark, sf, "text").filter("text is not null")
    return r.select("result_id", F.md5(text.without_thinking("text")).alias("digest"))


def completion_audit(spark, sf):
    """Each asked paper: complete, or what it lacks first."""
    asked = table(spark, sf, "generation_requests", ["metadata"]).select(F.col("metadata.paper_id").alias("paper_id"), F.col("metadata.stage").alias("stage")).filter("paper_id is not null")
    a = asked.groupBy("paper_id").agg(F.collect_set("stage").alias("stages"))
    i = table(spark, sf, "interpretation_records", ["record_id", "kind"]).groupBy(F.col("record_id").alias("paper_id")).agg(F.bool_or(F.col("kind") == "textual").alias("textual"), F.bool_or(F.col("kind") == "visual").alias("visual"))
    x = a.join(i, "paper_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rules = [(F.array_contains("stages", "textual") & no("textual"), "missing_textual"), (F.array_contains("stages", "visual") & no("visual"), "missing_visual"), (no("textual") & no("visual"), "nothing_asked")]
    return selection.with_rejection(x, rules, "reason").select("paper_id", F.coalesce("reason", F.lit("complete")).alias("reason"))


def audit_reasons(spark, sf):
    """Papers of each reason: their number and the first five."""
    a = completion_audit(spark, sf)
    first = selection.top_per_group(a, ["reason"], [F.col("paper_id")], 5).groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("paper_id")), ",").alias("first_papers"))
    return a.groupBy("reason").agg(F.count("*").alias("n")).join(first, "reason")


def status_counts(spark, sf):
    r = _results(spark, sf, "source", "error", "attempt")
    status = F.concat_ws("_", F.when(F.col("error").isNull(), "ok").otherwise(F.regexp_extract("error", "^([A-Za-z]+)", 1)), F.lower(F.coalesce("source", F.lit("unknown"))))
    return r.groupBy(status.alias("status")).agg(F.count("*").alias("n")).orderBy("status")


def stage_totals(spark, sf):
    """Answers and tokens by stage and source with totals (rollup)."""
    r = _results(spark, sf, "stage", "source", "generated_tokens").withColumn("source", F.coalesce("source", F.lit("unknown")))
    g = r.rollup("stage", "source").agg(F.count("*").alias("n"), F.sum("generated_tokens").alias("tokens"), F.count_if(F.col("generated_tokens").isNull()).alias("unknown_tokens"))
    return g.select(F.coalesce("stage", F.lit("all")).alias("stage"), F.coalesce("source", F.lit("all")).alias("source"), "n", "tokens", "unknown_tokens")


def late_results(spark, sf):
    """Answers ingested over a day after they were finished, by stage, with their mean delay as text."""
    r = _results(spark, sf, "stage", "finished_at", "ingested_at")
    delay = F.unix_seconds(F.col("ingested_at").cast("timestamp")) - F.unix_seconds(F.col("finished_at").cast("timestamp"))
    return r.withColumn("delay", delay).filter("delay > 86400").groupBy("stage").agg(F.count("*").alias("n"), text.duration(F.max("delay")).alias("longest"))


def best_model(spark, sf):
    """The model with most papers interpreted, then fewest rows; ties by name."""
    m = _interpretations(spark, sf, "model", "record_id").groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("papers"))
    return m.agg(F.max_by(F.struct("model", "papers", "n"), F.struct("papers", -F.col("n"), "model")).alias("b")).select("b.model", "b.papers", "b.n")


def kind_agreement(spark, sf):
    """Agreement of two raters on whether an answer is whole: by tokens and by last character, for each stage."""
    r = _results(spark, sf, "stage", "text", "generated_tokens").filter("text is not null")
    a, b = F.col("generated_tokens") < 150, F.rtrim("text").rlike("[.!?\\]}`\"]\\z")
    return agreement.kappa(r.select("stage", a.alias("first"), b.alias("second")), "stage", "first", "second")


def fixed_batches(spark, sf):
    """Requests of each paper in batches of three."""
    q = table(spark, sf, "generation_requests", ["request_id", "metadata"]).select("request_id", F.col("metadata.paper_id").alias("paper_id"))
    return ranking.ranked(q, ["paper_id"], [F.col("request_id")], "place").select("request_id", F.floor((F.col("place") - 1) / 3).alias("batch"))


def _walk(spark, sf):
    return ranking.ranked(_results(spark, sf, "paper_id", "finished_at"), ["paper_id"], [F.col("finished_at"), F.col("result_id")], "place")


def progress(spark, sf):
    """Running count of a paper's answers and its share of them."""
    rows = _walk(spark, sf)
    sizes = _results(spark, sf, "paper_id").groupBy(F.col("paper_id").alias("paper_of")).agg(F.count("*").alias("all"))
    x = rows.join(sizes, F.col("paper_id").eqNullSafe(F.col("paper_of")))
    return x.select("result_id", F.col("place").alias("done"), F.round(100 * F.col("place") / F.col("all"), 1).alias("percent"))


def neighbours(spark, sf):
    """Previous and next answer of the same paper, as a reviewer walks through them."""
    rows = cut(_walk(spark, sf))
    x = ranking.beside(ranking.beside(rows, ["paper_id"], "place", "result_id", -1, "previous"), ["paper_id"], "place", "result_id", 1, "next")
    return x.select("result_id", "previous", "next")


def paper_answers(spark, sf):
    """Each paper's answered requests in order, in lists of a hundred."""
    r = _results(spark, sf, "paper_id", "request_id").filter("paper_id is not null and request_id is not null").select("paper_id", "request_id").distinct()
    x = ranking.in_blocks(r, ["paper_id"], [F.col("request_id")], F.col("request_id"), 100)
    return x.select("paper_id", "block", F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", ",")).alias("digest"))


def submission_order(spark, sf):
    """Each request's last answer, numbered in the order the requests were submitted."""
    q = table(spark, sf, "generation_requests", ["request_id", "submitted_at"])
    last = relations.latest(_results(spark, sf, "request_id", "attempt", "finished_at").filter("request_id is not null"), ["request_id"], ["attempt", "finished_at", "result_id"], ["result_id"])
    return ranking.ranked(q.join(last, "request_id"), [], [F.col("submitted_at"), F.col("request_id")], "place").select("request_id", "result_id", "place")


def _figures(spark, sf):
    """Papers with the images their requests show as figures."""
    q = table(spark, sf, "generation_requests", ["metadata", "images"]).select(F.col("metadata.paper_id").alias("paper_id"), F.explode("images").alias("image")).filter("paper_id is not null").distinct()
    return q.groupBy("paper_id").agg(F.array_sort(F.collect_list("image")).alias("figures"))  # distinct images of one paper


def figure_window(spark, sf):
    """The figures numbered 10 to 59 over all papers."""
    return figures.figure_window(_figures(spark, sf), [F.col("paper_id")], "figures", 10, 60).select("paper_id", F.col("figure").alias("image"), "figure_index")


def first_figures(spark, sf):
    """The first two figures of each paper."""
    return _figures(spark, sf).select("paper_id", F.array_join(figures.first_figures(F.col("figures"), 2), ",").alias("images"))


def selected_components(spark, sf):
    """The components for a query of each mode: textual then visual ones, or visual ones only, by paper."""
    i = _interpretations(spark, sf, "record_id", "kind", "text").filter("record_id is not null and text is not null")
    x = ranking.in_blocks(i.withColumn("digest", F.md5("text")), ["record_id", "kind"], [F.col("digest"), F.col("interpretation_id")], F.col("digest"), 100)
    lists = x.groupBy("record_id", "block").agg(*(F.max(F.when(F.col("kind") == k, F.col("items"))).alias(k) for k in ("textual", "visual")))
    chosen = lambda mode: F.array_join(figures.components_of(F.col("textual"), F.col("visual"), mode), ",")
    return lists.select("record_id", "block", F.md5(chosen("visual-and-text")).alias("both"), F.md5(chosen("visual-only")).alias("visual_only"))


def absent_queries(spark, sf):
    """Interpretations that would be appended as queries: neither their request nor their paper and kind has one yet, earlier ones first."""
    i = _interpretations(spark, sf, "record_id", "kind", "metadata", "created_at").filter("created_at is not null").select("interpretation_id", "record_id", "kind", F.col("metadata.request_id").alias("request_id"), "created_at")
    keys = [F.concat(F.lit("query_id:"), "request_id"), F.concat(F.lit("mode-paper:"), "kind", F.lit(":"), "record_id")]
    return incremental.absent(i, keys, ["created_at", "interpretation_id"]).select("interpretation_id")


def stream_sample_ticks(spark, sf):
    """Samples of every three seconds, streamed."""
    return incremental.sample_ticks(spark, sf)


def index_window(spark, sf):
    """The eleventh to twentieth textual request of each source, numbered in order; blank prompts are dropped after numbering."""
    q = table(spark, sf, "generation_requests", ["request_id", "prompt", "metadata"]).filter("metadata.stage = 'textual'")
    rn = F.row_number().over(Window.partitionBy("metadata.source_paper_dataset").orderBy("request_id")) - 1
    x = q.withColumn("idx", rn).filter("idx between 10 and 19 and prompt is not null")
    return x.select("request_id", F.format_string("textual_q%05d", "idx").alias("query_id"))


def synthetic_queries(spark, sf):
    """For 50 answered papers in digest order: a templated query and the next two papers as negatives."""
    p = table(spark, sf, "interpretation_records", ["record_id"]).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("rank")
    top = p.withColumn("digest", selection.hash_rank("q", F.col("record_id"))).orderBy("digest", "record_id").limit(52).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("digest", "record_id")))
    return top.select("rank", F.col("record_id").alias("relevant"), F.lead("record_id", 1).over(w).alias("negative_1"), F.lead("record_id", 2).over(w).alias("negative_2"), F.concat(F.lit("Which paper is "), "record_id", F.lit("?")).alias("query")).filter("rank <= 50").withColumn("rank", F.col("rank").cast("long"))


def review_filter(spark, sf):
    """Reviewed answers: the last event of each user as the annotation of the answer with that id; filters by state and by a substring."""
    e = table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    last = relations.latest(e, ["user_id"], ["ts", "event_id"], ["event_type", "value"]).withColumnRenamed("user_id", "result_id")
    r = _results(spark, sf, "paper_id", "stage").join(last, "result_id", "left").withColumn("rating", F.coalesce("event_type", F.lit("Unreviewed")))
    return r.filter(F.contains(F.lower(F.concat_ws(" ", "paper_id", "stage")), F.lit("visual")) & F.col("rating").isin("Unreviewed", "click", "view")).select("result_id", "paper_id", "rating")


def changed_annotations(spark, sf):
    """Events whose type differs from the user's event before."""
    e = table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", "event_type", before.alias("before")).filter("not (before <=> event_type)")


def telemetry_delta(spark, sf):
    d = timeline.deltas(table(spark, sf, "events", ["event_id", "ts", "user_id", "value"]), "user_id", "ts", "value")
    return d.select("event_id", F.round("delta", 4).alias("delta"), F.round("seconds", 3).alias("seconds"))


def telemetry_summary(spark, sf):
    return timeline.sample_summary(table(spark, sf, "events", ["event_type", "value"]), ["event_type"], "value")


def telemetry_ticks(spark, sf):
    """Mean value by hour and type, and over all types of the hour."""
    e = table(spark, sf, "events", ["ts", "event_type", "value"]).withColumn("hour", F.date_trunc("hour", "ts"))
    g = e.groupingSets([[F.col("hour"), F.col("event_type")], [F.col("hour")]], F.col("hour"), F.col("event_type")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return g.select("hour", F.coalesce("event_type", F.lit("all")).alias("event_type"), "mean", "n")


def trailing_errors(spark, sf):
    """How many errors in a row each user ends with."""
    r = timeline.trailing_run(table(spark, sf, "events", ["ts", "user_id", "event_type"]), "user_id", "ts", "event_type", "error")
    return r.select("user_id", "run")


def json_props(spark, sf):
    e = table(spark, sf, "events", ["event_id", "props"])
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return e.select("event_id", k.alias("k"), text.flag(k % 2).alias("odd"))


def date_windows(spark, sf):
    return timeline.backward_windows(spark, "2024-01-01", "2024-03-10", 7).select("window_no", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


def date_bisect(spark, sf):
    days = table(spark, sf, "orders", ["o_orderdate"]).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return timeline.bisect_ranges(days, "day", "n", 400).select(F.col("range_start").cast("string").alias("range_start"), F.col("range_end").cast("string").alias("range_end"), "n")


def stream_window_counts(spark, sf):
    """Events by hour and type from a file stream with a watermark; equal to the batch result once the stream has ended."""
    return incremental.window_counts(spark, sf)


def stream_latest_state(spark, sf):
    """Last event of each user from a file stream."""
    return incremental.latest_state(spark, sf)


QUERIES = {f.__name__: f for f in (
    latest_result, first_result, pending_requests, pending_interpretations, retry_papers, result_papers, answer_contract, json_answers, judge_claims, component_flatten, component_categories, loose_components, null_queries, judge_prompts, null_answers,
    plain_answers, completion_audit, audit_reasons, status_counts, stage_totals, late_results, best_model, kind_agreement, fixed_batches, progress, neighbours, index_window, synthetic_queries, review_filter, changed_annotations, telemetry_delta,
    telemetry_summary, telemetry_ticks, trailing_errors, json_props, date_windows, date_bisect, stream_window_counts, stream_latest_state,
    paper_answers, submission_order, figure_window, first_figures, selected_components, absent_queries, stream_sample_ticks,
)}

_BODY = "trim(regexp_replace(text, '^\\s*```[a-z]*\\s*|\\s*```\\s*$', '', 'g'))"
_CUES = f"""i AS (SELECT DISTINCT interpretation_id, record_id, kind, text FROM interpretation_records WHERE kind = 'textual'),
j AS (SELECT interpretation_id, record_id, text, CASE WHEN starts_with({_BODY}, '[') AND json_valid({_BODY}) THEN from_json({_BODY}::JSON, '[{{"cue":"VARCHAR","category":"VARCHAR"}}]') END AS items FROM i),
k AS (SELECT interpretation_id, record_id, text, list_transform(list_filter(items, lambda x: x.cue IS NOT NULL), lambda x: 'textual ' || coalesce(x.category, 'cue') || ': ' || x.cue) AS cues FROM j)"""
_SHOWN = "trim(regexp_replace(trim({}), '^(?:textual\\s+[^:]+|[A-Za-z][A-Za-z0-9_ -]*):\\s*', ''))"
_STATE = "e AS (SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"
_AUDIT = """a AS (SELECT metadata.paper_id AS paper_id, bool_or(metadata.stage = 'textual') AS want_textual, bool_or(metadata.stage = 'visual') AS want_visual FROM generation_requests WHERE metadata.paper_id IS NOT NULL GROUP BY 1),
i AS (SELECT record_id AS paper_id, bool_or(kind = 'textual') AS textual, bool_or(kind = 'visual') AS visual FROM interpretation_records GROUP BY 1),
audit AS (SELECT paper_id, CASE WHEN want_textual AND NOT coalesce(textual, false) THEN 'missing_textual' WHEN want_visual AND NOT coalesce(visual, false) THEN 'missing_visual' WHEN NOT coalesce(textual, false) AND NOT coalesce(visual, false) THEN 'nothing_asked' ELSE 'complete' END AS reason FROM a LEFT JOIN i USING (paper_id))"""
_P = "(SELECT DISTINCT document_id FROM pdf_entries)"

SQL = {
    "latest_result": f"WITH {RESULT_ROWS} SELECT request_id, result_id, attempt, stage FROM r WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC NULLS LAST, finished_at DESC NULLS LAST, result_id DESC) = 1",
    "first_result": f"WITH {RESULT_ROWS} SELECT request_id, result_id FROM r WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY attempt NULLS FIRST, finished_at NULLS FIRST, result_id) = 1",
    "pending_requests": "SELECT request_id FROM generation_requests q WHERE NOT EXISTS (SELECT 1 FROM generation_results r WHERE r.request_id = q.request_id)",
    "pending_interpretations": "SELECT request_id FROM generation_requests q WHERE metadata.stage IN ('textual', 'visual') AND NOT EXISTS (SELECT 1 FROM interpretation_records i WHERE i.record_id = q.metadata.paper_id AND i.kind = q.metadata.stage AND i.prompt_id = q.metadata.prompt_id AND coalesce(i.prompt_version, 'v0') = coalesce(q.metadata.prompt_version, 'v0'))",
    "retry_papers": "WITH p AS (SELECT document_id, min(original_filename) AS f FROM pdf_entries GROUP BY 1), k AS (SELECT paper_id AS key FROM generation_results WHERE error IS NOT NULL UNION SELECT regexp_extract(paper_id, '_(Q[A-Z]+[0-9]+)$', 1) || '.pdf' FROM generation_results WHERE error IS NOT NULL) SELECT document_id FROM p WHERE document_id IN (SELECT key FROM k WHERE key IS NOT NULL) OR f IN (SELECT key FROM k WHERE key IS NOT NULL)",
    "result_papers": f"WITH {RESULT_ROWS} SELECT r.result_id, coalesce(a.document_id, b.document_id) AS paper FROM r LEFT JOIN generation_requests q ON q.request_id = r.request_id LEFT JOIN {_P} a ON a.document_id = r.paper_id LEFT JOIN {_P} b ON b.document_id = q.metadata.paper_id",
    "answer_contract": f"WITH {RESULT_ROWS}, c AS (SELECT request_id, count(*) AS n FROM r WHERE request_id IS NOT NULL GROUP BY 1), x AS (SELECT CASE WHEN q.request_id IS NULL THEN 'unknown' WHEN c.n IS NULL THEN 'missing' WHEN c.n > 1 THEN 'repeated' END AS problem FROM generation_requests q FULL JOIN c ON c.request_id = q.request_id) SELECT problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY 1",
    "json_answers": f"WITH {RESULT_ROWS} SELECT stage, count(*) AS n, count(CASE WHEN starts_with(trim(text), '{{') AND json_valid(text) THEN 1 WHEN json_valid(regexp_extract(text, '(?s)\\{{.*\\}}')) THEN 1 END) AS objects FROM r GROUP BY 1",
    "judge_claims": f"""WITH {RESULT_ROWS}, j AS (SELECT result_id, from_json(text::JSON, '{{"claims":[{{"claim":"VARCHAR","supported":"BOOLEAN","evidence":"VARCHAR"}}],"overall_grounded":"BOOLEAN"}}') AS b FROM r WHERE stage = 'judge' AND CASE WHEN starts_with(text, '{{') THEN json_valid(text) END), x AS (SELECT result_id, b.overall_grounded AS grounded, unnest(b.claims) AS c, generate_subscripts(b.claims, 1)::INT - 1 AS pos FROM j) SELECT result_id, pos, c.claim AS claim, c.supported AS supported, grounded FROM x""",
    "component_flatten": f"WITH {_CUES} SELECT interpretation_id, record_id, generate_subscripts(cues, 1)::INT - 1 AS pos, unnest(cues) AS cue FROM k",
    "component_categories": f"WITH {_CUES}, u AS (SELECT record_id, unnest(cues) AS cue FROM k) SELECT regexp_extract(cue, '^textual ([^:]*):', 1) AS category, count(*) AS n, count(DISTINCT record_id) AS papers FROM u GROUP BY 1",
    "null_queries": f"WITH {_CUES} SELECT interpretation_id, 'I''m trying to find a paper I read before. I remember that ' || array_to_string(list_transform(cues, lambda x: rtrim({_SHOWN.format('x')}, '.')), ' ') || '.' AS query FROM k WHERE len(cues) > 0",
    "judge_prompts": f"WITH {_CUES}, p AS (SELECT interpretation_id, 'Paper ' || record_id || chr(10) || 'Cues:' || chr(10) || array_to_string(list_transform(cues, lambda x: '- ' || {_SHOWN.format('x')}), chr(10)) || chr(10) || chr(10) || 'ANSWER:' || chr(10) || substr(text, 1, 1000) AS p FROM k WHERE len(cues) > 0) SELECT interpretation_id, md5(p) AS digest, length(p)::BIGINT AS n_chars FROM p",
    "plain_answers": f"WITH {RESULT_ROWS} SELECT result_id, md5(trim(list_last(string_split(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '<|channel|>final<|message|>')), ' ')) AS digest FROM r WHERE text IS NOT NULL",
    "completion_audit": f"WITH {_AUDIT} SELECT paper_id, reason FROM audit",
    "audit_reasons": f"WITH {_AUDIT} SELECT reason, count(*) AS n, array_to_string(list_sort(list(paper_id))[1:5], ',') AS first_papers FROM audit GROUP BY 1",
    "status_counts": f"WITH {RESULT_ROWS} SELECT CASE WHEN error IS NULL THEN 'ok' ELSE regexp_extract(error, '^([A-Za-z]+)', 1) END || '_' || lower(coalesce(source, 'unknown')) AS status, count(*) AS n FROM r GROUP BY 1",
    "stage_totals": f"WITH {RESULT_ROWS}, s AS (SELECT stage, coalesce(source, 'unknown') AS source, generated_tokens FROM r) SELECT coalesce(stage, 'all') AS stage, coalesce(source, 'all') AS source, count(*) AS n, sum(generated_tokens)::BIGINT AS tokens, count(*) FILTER (generated_tokens IS NULL) AS unknown_tokens FROM s GROUP BY ROLLUP (stage, source)",
    "late_results": f"WITH {RESULT_ROWS}, d AS (SELECT stage, epoch(date_trunc('second', ingested_at))::BIGINT - epoch(date_trunc('second', finished_at))::BIGINT AS delay FROM r), m AS (SELECT stage, count(*) AS n, max(delay) AS s FROM d WHERE delay > 86400 GROUP BY 1) SELECT stage, n, format('{{:d}}h{{:02d}}m', s // 3600, s % 3600 // 60) AS longest FROM m",
    "best_model": "WITH i AS (SELECT DISTINCT interpretation_id, model, record_id FROM interpretation_records) SELECT model, count(DISTINCT record_id) AS papers, count(*) AS n FROM i GROUP BY 1 ORDER BY 2 DESC, 3, 1 DESC LIMIT 1",
    "kind_agreement": f"WITH {RESULT_ROWS}, x AS (SELECT stage, (generated_tokens < 150)::INT AS a, regexp_matches(rtrim(text, ' '), '[.!?\\]}}`\"]\\z')::INT AS b FROM r WHERE text IS NOT NULL), g AS (SELECT stage, count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS p, avg(b) AS q FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1) SELECT stage, n, round(100 * po, 1) AS agreement, round(100 * p, 1) AS first_share, round(100 * q, 1) AS second_share, CASE WHEN round(p * q + (1 - p) * (1 - q), 12) = 1 THEN NULL ELSE round((po - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))), 3) END AS kappa FROM g",
    "fixed_batches": "SELECT request_id, (row_number() OVER (PARTITION BY metadata.paper_id ORDER BY request_id) - 1) // 3 AS batch FROM generation_requests",
    "progress": f"WITH {RESULT_ROWS} SELECT result_id, count(*) OVER w AS done, round(100 * count(*) OVER w / count(*) OVER (PARTITION BY paper_id), 1) AS percent FROM r WINDOW w AS (PARTITION BY paper_id ORDER BY finished_at NULLS FIRST, result_id ROWS UNBOUNDED PRECEDING)",
    "neighbours": f"WITH {RESULT_ROWS} SELECT result_id, lag(result_id) OVER w AS previous, lead(result_id) OVER w AS next FROM r WINDOW w AS (PARTITION BY paper_id ORDER BY finished_at NULLS FIRST, result_id)",
    "index_window": "WITH x AS (SELECT request_id, prompt, row_number() OVER (PARTITION BY metadata.source_paper_dataset ORDER BY request_id) - 1 AS idx FROM generation_requests WHERE metadata.stage = 'textual') SELECT request_id, format('textual_q{:05d}', idx) AS query_id FROM x WHERE idx BETWEEN 10 AND 19 AND prompt IS NOT NULL",
    "synthetic_queries": "WITH p AS (SELECT DISTINCT record_id FROM interpretation_records), o AS (SELECT record_id, row_number() OVER (ORDER BY md5('q|' || record_id), record_id) AS rank FROM p), l AS (SELECT rank, record_id, lead(record_id, 1) OVER (ORDER BY rank) AS n1, lead(record_id, 2) OVER (ORDER BY rank) AS n2 FROM o WHERE rank <= 52) SELECT rank, record_id AS relevant, n1 AS negative_1, n2 AS negative_2, 'Which paper is ' || record_id || '?' AS query FROM l WHERE rank <= 50",
    "review_filter": f"WITH {RESULT_ROWS}, {_STATE} SELECT r.result_id, r.paper_id, coalesce(e.event_type, 'Unreviewed') AS rating FROM r LEFT JOIN e ON e.user_id = r.result_id WHERE contains(lower(concat_ws(' ', r.paper_id, r.stage)), 'visual') AND coalesce(e.event_type, 'Unreviewed') IN ('Unreviewed', 'click', 'view')",
    "changed_annotations": "SELECT event_id, event_type, before FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type",
    "telemetry_delta": "WITH d AS (SELECT event_id, value - lag(value) OVER w AS delta, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6 AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, round(delta, 4) AS delta, round(seconds, 3) AS seconds FROM d WHERE delta IS NOT NULL",
    "telemetry_summary": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, quantile_cont(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most, round(avg(CASE WHEN value > 80 THEN 100.0 ELSE 0.0 END), 4) AS over_80 FROM events GROUP BY 1",
    "telemetry_ticks": "WITH e AS (SELECT date_trunc('hour', ts) AS hour, event_type, value FROM events) SELECT hour, coalesce(event_type, 'all') AS event_type, round(avg(value), 6) AS mean, count(*) AS n FROM e GROUP BY GROUPING SETS ((hour, event_type), (hour))",
    "trailing_errors": "WITH l AS (SELECT user_id, max(ts) FILTER (event_type IS DISTINCT FROM 'error') AS last FROM events GROUP BY 1) SELECT e.user_id, count(*) FILTER (l.last IS NULL OR e.ts > l.last) AS run FROM events e JOIN l USING (user_id) GROUP BY 1",
    "json_props": "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, coalesce(lower(((props::JSON->>'k')::BIGINT % 2)::VARCHAR) IN ('1', 'true', 'yes', 'y'), false) AS odd FROM events",
    "date_windows": "SELECT i AS window_no, greatest(DATE '2024-01-01', DATE '2024-03-10' - (i * 7 + 6)::INT)::VARCHAR AS window_start, (DATE '2024-03-10' - (i * 7)::INT)::VARCHAR AS window_end FROM range(10) t(i)",
    "date_bisect": """WITH RECURSIVE d AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1),
g AS (SELECT min(d) AS a, max(d) AS b, sum(n)::BIGINT AS n FROM d
  UNION ALL SELECT * FROM (SELECT CASE s WHEN 0 THEN a ELSE a + ((b - a) // 2 + 1)::INT END AS x, CASE s WHEN 0 THEN a + ((b - a) // 2)::INT ELSE b END AS y, (SELECT sum(d.n)::BIGINT FROM d WHERE d.d BETWEEN CASE s WHEN 0 THEN a ELSE a + ((b - a) // 2 + 1)::INT END AND CASE s WHEN 0 THEN a + ((b - a) // 2)::INT ELSE b END) AS m FROM g, (VALUES (0), (1)) v(s) WHERE n > 400 AND a < b))
SELECT a::VARCHAR AS range_start, b::VARCHAR AS range_end, n FROM g WHERE n > 0 AND (n <= 400 OR a = b)""",
    "paper_answers": f"WITH {RESULT_ROWS}, d AS (SELECT DISTINCT paper_id, request_id FROM r WHERE paper_id IS NOT NULL AND request_id IS NOT NULL), o AS (SELECT *, (row_number() OVER (PARTITION BY paper_id ORDER BY request_id) - 1) // 100 AS block FROM d) SELECT paper_id, block, count(*) AS n, md5(string_agg(request_id, ',' ORDER BY request_id)) AS digest FROM o GROUP BY 1, 2",
    "submission_order": f"WITH {RESULT_ROWS}, l AS (SELECT request_id, result_id FROM r WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC NULLS LAST, finished_at DESC NULLS LAST, result_id DESC) = 1) SELECT request_id, result_id, row_number() OVER (ORDER BY submitted_at NULLS FIRST, request_id) AS place FROM generation_requests q JOIN l USING (request_id)",
    "figure_window": "WITH f AS (SELECT DISTINCT metadata.paper_id AS paper_id, unnest(images) AS image FROM generation_requests), o AS (SELECT *, row_number() OVER (ORDER BY paper_id, image) - 1 AS figure_index FROM f WHERE paper_id IS NOT NULL AND image IS NOT NULL) SELECT paper_id, image, figure_index FROM o WHERE figure_index BETWEEN 10 AND 59",
    "first_figures": "WITH f AS (SELECT DISTINCT metadata.paper_id AS paper_id, unnest(images) AS image FROM generation_requests), o AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY image) AS n FROM f WHERE paper_id IS NOT NULL AND image IS NOT NULL) SELECT paper_id, string_agg(image, ',' ORDER BY image) AS images FROM o WHERE n <= 2 GROUP BY 1",
    "selected_components": """WITH i AS (SELECT DISTINCT interpretation_id, record_id, kind, md5(text) AS d FROM interpretation_records WHERE record_id IS NOT NULL AND text IS NOT NULL),
o AS (SELECT *, (row_number() OVER (PARTITION BY record_id, kind ORDER BY d, interpretation_id) - 1) // 100 AS block FROM i)
SELECT record_id, block, md5(concat_ws(',', string_agg(d, ',' ORDER BY d, interpretation_id) FILTER (kind = 'textual'), string_agg(d, ',' ORDER BY d, interpretation_id) FILTER (kind = 'visual'))) AS both,
  md5(coalesce(string_agg(d, ',' ORDER BY d, interpretation_id) FILTER (kind = 'visual'), '')) AS visual_only FROM o GROUP BY 1, 2""",
    "stream_sample_ticks": "SELECT to_timestamp(floor(epoch(ts) / 3) * 3)::TIMESTAMP AS tick, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1",
    "stream_window_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_latest_state": f"WITH {_STATE} SELECT user_id, event_id, event_type FROM e",
}
