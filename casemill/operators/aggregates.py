"""Aggregations of the read models: dashboard, statistics, watch lists, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.plans.registry import query
from casemill.sources.shared import prefix_sums
from casemill.sources.views import AUDIT, CASES, EXTRACTIONS, FLAGS, NOW_MS, STATUSES, audit_log, cases, extractions, flags, table, with_district

DAY = 86_400_000
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"


@query("agg_status_histogram", f"WITH {CASES} SELECT s.status, count(c.case_id) AS n FROM (SELECT unnest({list(STATUSES)}) AS status) s LEFT JOIN cases c ON c.status = s.status AND NOT c.historical GROUP BY s.status")
def agg_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by status; a status without cases counts 0."""
    counts = cases(spark, sf_dir).where("NOT historical").groupBy("status").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(s,) for s in STATUSES], "status string").join(counts, "status", "left").na.fill(0)


@query("agg_status_pivot", f"""WITH {CASES} SELECT batch_id, count(*) FILTER (WHERE status = 'READY') AS ready, count(*) FILTER (WHERE status = 'NEEDS_CITIZEN_CORRECTION') AS correction,
 count(*) FILTER (WHERE status = 'OFFICER_ATTENTION') AS attention, count(*) FILTER (WHERE status = 'APPROVED') AS approved FROM cases GROUP BY batch_id""")
def agg_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cases(spark, sf_dir).groupBy("batch_id").pivot("status", list(STATUSES)).count().na.fill(0)
    return p.toDF("batch_id", "ready", "correction", "attention", "approved")


@query("agg_district_pivot", f"""WITH {CASES} SELECT coalesce(district, 'Not stated') AS district, count(*) AS received, count(*) FILTER (WHERE status = 'READY') AS ready, count(*) FILTER (WHERE status = 'NEEDS_CITIZEN_CORRECTION') AS correction,
 count(*) FILTER (WHERE status = 'OFFICER_ATTENTION') AS attention, count(*) FILTER (WHERE status = 'APPROVED') AS approved FROM cases GROUP BY 1 ORDER BY received DESC, district""")
def agg_district_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The district dashboard."""
    by = with_district(cases(spark, sf_dir), sf_dir).groupBy(F.coalesce("district", F.lit("Not stated")).alias("district"))
    of = {"ready": "READY", "correction": "NEEDS_CITIZEN_CORRECTION", "attention": "OFFICER_ATTENTION", "approved": "APPROVED"}
    return by.agg(F.count("*").alias("received"), *[F.count_if(F.col("status") == s).alias(n) for n, s in of.items()]).orderBy(F.col("received").desc(), "district")


@query("agg_kpis", f"""WITH {CASES} SELECT count(*) AS received, count(*) FILTER (WHERE status <> 'APPROVED') AS pending, count(*) FILTER (WHERE status = 'APPROVED') AS approved, count(sent_ms) AS notices_sent, count(screened_ms) AS screened,
 round(avg(CASE WHEN screened_ms - received_ms >= 0 THEN screened_ms - received_ms END), 3) AS avg_screening_ms, round(avg(screened_ms - received_ms), 3) AS avg_screening_all_ms,
 round(avg(CASE WHEN status <> 'APPROVED' THEN floor(greatest({NOW_MS} - received_ms, 0) / {DAY}.0) END), 1) AS avg_days_pending, round(avg(CASE WHEN first_status IS NOT NULL THEN CAST(first_status = 'READY' AS INT) END), 6) AS first_time_right
 FROM cases WHERE NOT historical""")
def agg_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's figures in one pass; the average screening time with and without negative times."""
    c = cases(spark, sf_dir).where("NOT historical")
    ms, pending = F.col("screened_ms") - F.col("received_ms"), F.col("status") != "APPROVED"
    days = F.floor(F.greatest(F.lit(NOW_MS) - F.col("received_ms"), F.lit(0)) / DAY)
    return c.agg(
        F.count("*").alias("received"), F.count_if(pending).alias("pending"), F.count_if(~pending).alias("approved"), F.count("sent_ms").alias("notices_sent"), F.count("screened_ms").alias("screened"),
        F.round(F.avg(F.when(ms >= 0, ms)), 3).alias("avg_screening_ms"), F.round(F.avg(ms), 3).alias("avg_screening_all_ms"),
        F.round(F.avg(F.when(pending, days)), 1).alias("avg_days_pending"), F.round(F.avg((F.col("first_status") == "READY").cast("int")), 6).alias("first_time_right"),
    )


@query("agg_ratio_null", f"WITH {FLAGS} SELECT code, round(avg(CASE WHEN resolution <> 'OPEN' THEN CAST(resolution = 'OVERRIDDEN' AS INT) END), 6) AS override_rate FROM flags WHERE severity <> 'info' OR resolution = 'OPEN' GROUP BY code")
def agg_ratio_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of decided findings that were overridden; null where none is decided."""
    f = flags(spark, sf_dir).where("severity <> 'info' OR resolution = 'OPEN'")
    return f.groupBy("code").agg(F.round(F.avg(F.when(F.col("resolution") != "OPEN", (F.col("resolution") == "OVERRIDDEN").cast("int"))), 6).alias("override_rate"))


@query("agg_ratio_one", "SELECT quality, coalesce(round(avg(CASE WHEN toxic = 1 THEN CAST(doc_id % 2 = 0 AS INT) END), 6), 1.0) AS accuracy FROM labels GROUP BY quality")
def agg_ratio_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An accuracy that is 1 where nothing was decided."""
    hit = F.when(F.col("toxic") == 1, (F.col("doc_id") % 2 == 0).cast("int"))
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.coalesce(F.round(F.avg(hit), 6), F.lit(1.0)).alias("accuracy"))


@query("agg_grouping_sets", f"WITH {FLAGS} SELECT severity, action, resolution, count(*) AS n, grouping(severity, action, resolution) AS level FROM flags GROUP BY GROUPING SETS ((severity), (action), (resolution))")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groupings of the findings in one pass."""
    f = flags(spark, sf_dir).select("severity", "action", "resolution")
    sets = [[F.col("severity")], [F.col("action")], [F.col("resolution")]]
    return f.groupingSets(sets, "severity", "action", "resolution").agg(F.count("*").alias("n"), F.grouping_id("severity", "action", "resolution").alias("level"))


@query("agg_rollup_total", f"WITH {CASES} SELECT coalesce(district, 'All') AS district, count(*) AS n, sum(priority)::BIGINT AS priority FROM cases WHERE district IS NOT NULL GROUP BY ROLLUP(district)")
def agg_rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_district(cases(spark, sf_dir), sf_dir).where("district IS NOT NULL").rollup("district").agg(F.count("*").alias("n"), F.sum("priority").alias("priority")).withColumn("district", F.coalesce("district", F.lit("All")))


@query("agg_distinct_sorted", f"WITH {CASES} SELECT status, array_to_string(list_sort(list(DISTINCT district)), ',') AS districts FROM cases WHERE district IS NOT NULL GROUP BY status")
def agg_distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_district(cases(spark, sf_dir), sf_dir).where("district IS NOT NULL").groupBy("status").agg(F.array_join(F.array_sort(F.collect_set("district")), ",").alias("districts"))


@query("agg_first_seen", f"WITH {CASES} SELECT district, min(case_id) AS first_case FROM cases WHERE district IS NOT NULL GROUP BY district")
def agg_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_district(cases(spark, sf_dir), sf_dir).where("district IS NOT NULL").groupBy("district").agg(F.min("case_id").alias("first_case"))


@query("agg_bool_and_empty", f"WITH {AUDIT} SELECT case_id, coalesce(bool_and(value < 60) FILTER (WHERE action = 'purchase'), TRUE) AS all_small, coalesce(bool_or(action = 'error'), FALSE) AS any_error FROM audit_log GROUP BY case_id")
def agg_bool_and_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.coalesce(F.every(F.when(F.col("action") == "purchase", F.col("value") < 60)), F.lit(True))
    return audit_log(spark, sf_dir).groupBy("case_id").agg(small.alias("all_small"), F.some(F.col("action") == "error").alias("any_error"))


@query("agg_top_flag", f"WITH {FLAGS} SELECT case_id, code, severity FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {RANK}, seq, part) AS r FROM flags WHERE resolution <> 'OVERRIDDEN') WHERE r = 1")
def agg_top_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest finding in force of each case; ties to the earlier one."""
    key = F.struct(F.expr(RANK).alias("rank"), "seq", "part")
    best = F.min_by(F.struct("code", "severity"), key)
    return flags(spark, sf_dir).where("resolution <> 'OVERRIDDEN'").groupBy("case_id").agg(best.alias("b")).select("case_id", "b.code", "b.severity")


@query("agg_severity_counts", f"WITH {FLAGS} SELECT case_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE resolution = 'OPEN' AND action = 'citizen') AS citizen_open FROM flags WHERE resolution <> 'OVERRIDDEN' GROUP BY case_id")
def agg_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flags(spark, sf_dir).where("resolution <> 'OVERRIDDEN'")
    return f.groupBy("case_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warn", "info")], F.count_if((F.col("resolution") == "OPEN") & (F.col("action") == "citizen")).alias("citizen_open"))


@query("agg_usage_cost", f"""WITH {EXTRACTIONS} SELECT stage, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(avg(latency_ms), 3) AS avg_latency_ms,
 round(sum(input_tokens) * 2.0::DOUBLE / 1000000 + sum(output_tokens) * 10.0::DOUBLE / 1000000, 4) AS usd FROM extractions GROUP BY stage""")
def agg_usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model use and its price: 2 and 10 dollars for a million tokens in and out."""
    usd = F.sum("input_tokens") * 2.0 / 1_000_000 + F.sum("output_tokens") * 10.0 / 1_000_000
    return extractions(spark, sf_dir).groupBy("stage").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"), F.round(usd, 4).alias("usd"))


@query("agg_manifest", f"""WITH {CASES} SELECT 'status' AS dimension, status AS value, count(*) AS n FROM cases GROUP BY status UNION ALL SELECT 'district', coalesce(district, 'Not stated'), count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'batch', batch_id, count(*) FROM cases GROUP BY batch_id""")
def agg_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by several dimensions as one long table, in one pass over the cases."""
    c = with_district(cases(spark, sf_dir), sf_dir)
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("status", F.col("status")), ("district", F.coalesce("district", F.lit("Not stated"))), ("batch", F.col("batch_id")))])
    return c.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


@query("topk_deficiencies", f"WITH {FLAGS}, {CASES} SELECT code, count(*) AS n FROM flags WHERE action = 'citizen' AND resolution <> 'OVERRIDDEN' AND case_id IN (SELECT case_id FROM cases WHERE NOT historical) GROUP BY code ORDER BY n DESC, code LIMIT 8")
def topk_deficiencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = cases(spark, sf_dir).where("NOT historical").select("case_id")
    f = flags(spark, sf_dir).where("action = 'citizen' AND resolution <> 'OVERRIDDEN'").join(live, "case_id", "left_semi")
    return f.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "code").limit(8)


@query("topk_watch_per_category", f"""WITH {CASES}, w AS (SELECT case_id, floor(greatest({NOW_MS} - received_ms, 0) / {DAY}.0)::BIGINT AS days, unnest(list_filter([CASE WHEN birth_year <= 1921 THEN 'aged' END, CASE WHEN case_id % 3 = 0 THEN 'widowed' END, CASE WHEN case_id % 7 = 0 THEN 'displaced' END], lambda x: x IS NOT NULL)) AS category FROM cases WHERE status <> 'APPROVED')
SELECT category, case_id, days, total FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY days DESC, case_id) AS r, count(*) OVER (PARTITION BY category) AS total FROM w) WHERE r <= 5""")
def topk_watch_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest waiting of each category and the category's size; a case can be in several."""
    days = F.floor(F.greatest(F.lit(NOW_MS) - F.col("received_ms"), F.lit(0)) / DAY)
    of = F.array_compact(F.array(F.when(F.col("birth_year") <= 1921, "aged"), F.when(F.col("case_id") % 3 == 0, "widowed"), F.when(F.col("case_id") % 7 == 0, "displaced")))
    w = cases(spark, sf_dir).where("status <> 'APPROVED'").select("case_id", days.alias("days"), F.explode(of).alias("category"))
    top = w.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.col("days").desc(), "case_id"))).where("r <= 5").drop("r")
    return top.join(w.groupBy("category").agg(F.count("*").alias("total")), "category")


def queue(cases_: DataFrame, top: int | None = None) -> DataFrame:
    """place, case_id, priority of the cases that wait for an officer, in order, by a range sort; ``top`` cuts it to the first ones."""
    waiting = cases_.where("status = 'OFFICER_ATTENTION' AND NOT historical").select("case_id", "priority", "received_ms")
    order = [F.col("priority").desc(), F.col("received_ms"), F.col("case_id")]
    if top is not None:
        waiting = waiting.orderBy(*order).limit(top)
    placed = prefix_sums(waiting, [-F.col("priority"), F.col("received_ms"), F.col("case_id")], {"place": F.lit(1)}, "queue")
    return placed.select("place", "case_id", "priority").orderBy("place")


_QUEUE = f"WITH {CASES} SELECT row_number() OVER (ORDER BY priority DESC, received_ms, case_id) AS place, case_id, priority FROM cases WHERE status = 'OFFICER_ATTENTION' AND NOT historical"


@query("sort_queue", _QUEUE)
def sort_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The officers' whole queue with its places; no task takes all rows."""
    return queue(cases(spark, sf_dir))


@query("sort_queue_all", _QUEUE)
def sort_queue_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queue by its earlier name."""
    return queue(cases(spark, sf_dir))


@query("sort_natural", "SELECT n_name, lpad(regexp_extract(n_name, '([0-9]+)', 1), 12, '0') AS sort_key FROM nation ORDER BY sort_key, n_name")
def sort_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order of the numbers in them: 2 before 10."""
    n = table(spark, sf_dir, "nation").select("n_name", F.lpad(F.regexp_extract("n_name", "([0-9]+)", 1), 12, "0").alias("sort_key"))
    return n.orderBy("sort_key", "n_name")


def natural_key(c: Column, digits: int = 20) -> Column:
    """A key of a name that sorts as people do: without regard to case, each run of digits by its number, wherever it stands."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit(r"(\d+)"), F.lit(1))
    padded = F.transform(runs, lambda r: F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), digits, "0"))
    between = F.split(low, r"\d+")
    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("text"), padded.alias("run")), lambda p: F.array(p["text"], F.coalesce(p["run"], F.lit(""))))), "")


def by_name(df: DataFrame, name: str, *then: str) -> DataFrame:
    """df in natural order of a name; names alike but for case by code point, then by other columns."""
    return df.orderBy(natural_key(F.col(name)), name, *then)


_NAMED = "CASE p_partkey % 4 WHEN 0 THEN concat('packet-', CAST(p_partkey % 130 AS STRING)) WHEN 1 THEN concat(upper(p_brand), ' ', p_name) WHEN 2 THEN concat(p_name, CAST(p_size AS STRING), '-', CAST(p_partkey % 11 AS STRING), '.jpg') ELSE concat('0', CAST(p_size AS STRING), p_brand) END"
_RUNS = "list_transform(regexp_extract_all(lower(name), '([0-9]+)'), lambda r: lpad(regexp_replace(r, '^0+([0-9])', '\\1'), 20, '0'))"


@query("sort_natural_names", f"""WITH n AS (SELECT p_partkey, {_NAMED} AS name FROM part), k AS (SELECT *, array_to_string(list_transform(list_zip(regexp_split_to_array(lower(name), '[0-9]+'), {_RUNS}), lambda p: concat(p[1], coalesce(p[2], ''))), '') AS k FROM n)
SELECT p_partkey, name, row_number() OVER (ORDER BY k, name, p_partkey) AS place FROM k""")
def sort_natural_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of packets and files with their places in natural order: packet-2 before packet-10, case aside; by a range sort."""
    n = table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMED).alias("name"))
    return prefix_sums(n, [natural_key(F.col("name")), F.col("name"), F.col("p_partkey")], {"place": F.lit(1)}, "natural").select("p_partkey", "name", "place")


@query("sort_locale", "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY lower(word), word, c_custkey) AS place FROM (SELECT c_custkey, c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS word FROM customer)")
def sort_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in the order of a reader, not of code points: "a" before "B"; words that differ in case alone by code point."""
    segment = F.col("c_mktsegment")
    word = F.when(F.col("c_custkey") % 3 == 0, F.lower(segment)).when(F.col("c_custkey") % 3 == 1, segment).otherwise(F.concat(F.upper(F.substring(segment, 1, 1)), F.lower(F.substring(segment, 2, 1000))))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", word.alias("word"))
    return prefix_sums(rows, [F.lower("word"), F.col("word"), F.col("c_custkey")], {"place": F.lit(1)}, "locale").select("c_custkey", "c_mktsegment", "place")


@query("topk_latest_head", f"WITH {AUDIT} SELECT audit_id, action FROM audit_log ORDER BY audit_id DESC LIMIT 1")
def topk_latest_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_log(spark, sf_dir).select("audit_id", "action").orderBy(F.col("audit_id").desc()).limit(1)


@query("agg_largest_remainder", f"""WITH {CASES}, q AS (SELECT district, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM cases WHERE district IS NOT NULL) AS share FROM cases WHERE district IS NOT NULL GROUP BY district),
r AS (SELECT district, floor(share)::BIGINT AS base, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, district) AS place, 100 - sum(floor(share)::BIGINT) OVER () AS spare FROM q) SELECT district, (base + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def agg_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred places shared out by districts' sizes; leftovers go to the largest remainders."""
    counts = with_district(cases(spark, sf_dir), sf_dir).where("district IS NOT NULL").groupBy("district").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # a row for each district
    share = counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(whole)).withColumn("base", F.floor("share"))
    place = F.row_number().over(Window.orderBy(F.round(F.col("share") - F.col("base"), 9).desc(), "district"))
    r = share.withColumn("place", place).withColumn("spare", 100 - F.sum("base").over(whole))
    return r.select("district", (F.col("base") + (F.col("place") <= F.col("spare")).cast("long")).alias("quota"))


@query("set_union_findings", "SELECT 'documents' AS place, doc_id AS id FROM documents WHERE contains(text, '@') UNION ALL SELECT 'pages', page_id FROM pages WHERE contains(html, '@') UNION ALL SELECT 'conversations', conv_id FROM conversations WHERE contains(text, '@')")
def set_union_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
        part = table(spark, sf_dir, name).where(F.contains(F.col(text), F.lit("@"))).select(F.lit(name).alias("place"), F.col(key).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("set_except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("set_best_value_merge", f"WITH {EXTRACTIONS} SELECT document_id, seq, output_tokens FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY (CASE WHEN status = 'OK' THEN 10 ELSE 0 END + output_tokens % 4) DESC, seq) AS r FROM extractions) WHERE r = 1")
def set_best_value_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several readings of a document the best ranked one; the earlier wins a tie."""
    rank = F.when(F.col("status") == "OK", 10).otherwise(0) + F.col("output_tokens") % 4
    best = F.max_by(F.struct("seq", "output_tokens"), F.struct(rank, -F.col("seq")))
    return extractions(spark, sf_dir).groupBy("document_id").agg(best.alias("b")).select("document_id", "b.seq", "b.output_tokens")


@query("set_dedupe", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def set_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct()
