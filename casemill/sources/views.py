"""Domain views over the star-schema tables: cases, flags, audit log, extractions.

Each view is written once as expressions that Spark and DuckDB both read, so that a query's SQL sees the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: The day on which ages and pending days are counted, and its milliseconds.
TODAY = "2001-09-01"
NOW_MS = 999_302_400_000
STATUSES = ("READY", "NEEDS_CITIZEN_CORRECTION", "OFFICER_ATTENTION", "APPROVED")
# Finding codes in the order of the screening steps.
CODES = (
    "MISSING_DOCUMENT", "OPTIONAL_DOCUMENT_NOT_PROVIDED", "EXTRACTION_FAILED", "MISSING_FIELD", "LOW_CONFIDENCE", "AADHAAR_CHECKSUM_INVALID", "IFSC_INVALID",
    "EPIC_FORMAT_INVALID", "AADHAAR_FORM_CARD_MISMATCH", "MISSING_SIGNATURE", "BANK_DETAILS_MISMATCH", "NAME_VARIANT", "NAME_AMBIGUOUS", "NAME_MISMATCH",
    "BANK_HOLDER_NAME_MISMATCH", "DOB_MISMATCH", "AGE_BELOW_MINIMUM", "DOB_YEAR_ONLY", "INCOME_ABOVE_CEILING", "DUPLICATE_SUSPECTED",
)


def pick(values: tuple[str, ...], at: str, duck: bool) -> str:
    """SQL for the value at a 0-based place."""
    quoted = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{quoted}], CAST({at} AS BIGINT) + 1)" if duck else f"element_at(array({quoted}), CAST({at} AS INT) + 1)"


def day_ms(column: str, duck: bool) -> str:
    """SQL for a day's milliseconds since 1970, whatever the session's time zone."""
    days = f"date_diff('day', DATE '1970-01-01', CAST({column} AS DATE))" if duck else f"datediff(CAST({column} AS DATE), DATE '1970-01-01')"
    return f"CAST({days} AS BIGINT) * {DAY_MS}"


def case_columns(duck: bool) -> dict[str, str]:
    received = day_ms("o_orderdate", duck)
    approved = "o_orderstatus = 'F' AND o_orderkey % 4 < 2"
    return {
        "case_id": "o_orderkey",
        "applicant_id": "o_custkey",
        "reference": "concat('CM-', CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(o_orderkey AS STRING), 7, '0'))",
        "status": f"CASE WHEN {approved} THEN 'APPROVED' WHEN o_orderstatus = 'F' THEN 'READY' WHEN o_orderstatus = 'O' THEN 'NEEDS_CITIZEN_CORRECTION' ELSE 'OFFICER_ATTENTION' END",
        "first_status": "CASE WHEN o_orderkey % 3 = 0 THEN 'READY' WHEN o_orderkey % 3 = 1 THEN 'OFFICER_ATTENTION' END",
        "priority": "(6 - CAST(substr(o_orderpriority, 1, 1) AS INT)) * 20",
        "received_ms": received,
        "screened_ms": f"CASE WHEN o_orderkey % 11 <> 0 THEN {received} + (o_orderkey % 7 - 1) * 61000 END",
        "decided_ms": f"CASE WHEN {approved} THEN {received} + (1 + o_orderkey % 30) * {DAY_MS} END",
        "sent_ms": f"CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN {received} + {2 * DAY_MS} END",
        "historical": "o_orderkey % 10 = 0",
        "last4": "CASE WHEN o_custkey % 13 <> 0 THEN lpad(CAST(o_custkey % 97 AS STRING), 4, '0') END",
        "birth_year": "CAST(1915 + o_custkey % 60 AS INT)",
        "dob": "CASE WHEN o_custkey % 5 = 0 THEN CAST(1915 + o_custkey % 60 AS STRING) ELSE concat(CAST(1915 + o_custkey % 60 AS STRING), '-', lpad(CAST(1 + o_custkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + o_custkey % 28 AS STRING), 2, '0')) END",
        "batch_id": "concat('b', CAST(o_orderkey % 50 AS STRING))",
        "income": "o_totalprice",
        "district": "CASE WHEN o_custkey % 37 <> 0 THEN n_name END",
    }


def flag_columns(duck: bool) -> dict[str, str]:
    return {
        "case_id": "l_orderkey",
        "seq": "l_linenumber",
        "part": "l_partkey",
        "code": pick(CODES, "l_partkey % 20", duck),
        "severity": "CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'N' THEN 'warn' ELSE 'info' END",
        "action": "CASE l_suppkey % 3 WHEN 0 THEN 'citizen' WHEN 1 THEN 'officer' ELSE 'none' END",
        "resolution": "CASE WHEN l_linestatus = 'O' THEN 'OPEN' WHEN l_linenumber % 2 = 0 THEN 'ACCEPTED' ELSE 'OVERRIDDEN' END",
        "resolved_by": "CASE WHEN l_linestatus = 'F' THEN concat('officer:', CAST(l_suppkey % 120 AS STRING)) END",
        "created_ms": day_ms("l_shipdate", duck),
    }


def extraction_columns(duck: bool) -> dict[str, str]:
    return {
        "document_id": "conv_id",
        "seq": "turn",
        "stage": "CASE WHEN role = 'user' THEN 'classify' ELSE 'extract' END",
        "status": "CASE WHEN (conv_id + turn) % 4 = 0 THEN 'ERROR' ELSE 'OK' END",
        "input_tokens": "CAST(length(text) AS BIGINT)",
        "output_tokens": "CAST(length(text) % 100 AS BIGINT)",
        "latency_ms": "CAST(100 + (conv_id * 7 + turn * 13) % 900 AS BIGINT)",
    }


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over as many partitions as there are cores, by a key, if it has fewer: a small file is one task's otherwise, whatever is made of its rows."""
    enough = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= enough else df.repartition(enough, key)


def cases(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """One row an application, from one scan; no district, see with_district().

    ``where`` is a predicate over the source's own columns, which reaches the reader; filters on derived columns don't.
    """
    orders = table(spark, sf_dir, "orders")
    kept = orders.where(where) if where else orders
    return kept.selectExpr(*[f"{v} AS {k}" for k, v in case_columns(False).items() if k != "district"])


def with_district(cases_: DataFrame, sf_dir: str) -> DataFrame:
    """Cases with the district of the applicant, who is one row of customer; null where it isn't stated."""
    spark = cases_.sparkSession
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    of = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select("c_custkey", "n_name")
    joined = cases_.join(of, cases_.applicant_id == of.c_custkey, "left")
    return joined.withColumn("district", F.expr("CASE WHEN applicant_id % 37 <> 0 THEN n_name END")).drop("c_custkey", "n_name")


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a finding of a case."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in flag_columns(False).items()])


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a model call for a document."""
    return table(spark, sf_dir, "conversations").selectExpr(*[f"{v} AS {k}" for k, v in extraction_columns(False).items()])


#: The audit log's columns over the events table.
AUDIT_COLUMNS = ("event_id AS audit_id", "concat('officer:', CAST(user_id AS STRING)) AS actor", "event_type AS action", "value", "props AS after_json", "event_id % 500 AS case_id")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an action, append-only."""
    return table(spark, sf_dir, "events").selectExpr(*AUDIT_COLUMNS)


CASES = f"cases AS (SELECT {_select(case_columns(True))} FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"
FLAGS = f"flags AS (SELECT {_select(flag_columns(True))} FROM lineitem)"
EXTRACTIONS = f"extractions AS (SELECT {_select(extraction_columns(True))} FROM conversations)"
AUDIT = "audit_log AS (SELECT event_id AS audit_id, concat('officer:', CAST(user_id AS VARCHAR)) AS actor, event_type AS action, value, props AS after_json, event_id % 500 AS case_id FROM events)"


def literal(rows: list[tuple], columns: str) -> tuple:
    """Rows given in code, as (spark -> DataFrame, SQL for DuckDB's FROM). columns: 'name type, ...' with Spark's types."""
    names = [c.split()[0] for c in columns.split(",")]
    kinds = [c.split()[1].replace("long", "BIGINT").replace("string", "VARCHAR") for c in columns.split(",")]

    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    select = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds))
    return (lambda spark: spark.createDataFrame(rows, columns)), f"(SELECT {select} FROM (VALUES {body}) AS v({', '.join(names)}))"


def literal_and(rows: list[tuple], columns: str, of: str, **made: str) -> tuple:
    """Rows given in code and rows made of a table's, as ((spark, sf_dir) -> DataFrame, SQL for DuckDB's FROM). made: column to an expression that both read."""
    given, sql = literal(rows, columns)
    kinds = {c.split()[0]: c.split()[1] for c in columns.split(",")}
    duck = {n: k.replace("long", "BIGINT").replace("string", "VARCHAR") for n, k in kinds.items()}
    both = lambda k: {"long": "BIGINT"}.get(k, k)

    def all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return given(spark).unionByName(table(spark, sf_dir, of).selectExpr(*[f"CAST({made[n]} AS {both(k)}) AS {n}" for n, k in kinds.items()]))

    return all_rows, f"(SELECT * FROM {sql} UNION ALL SELECT {', '.join(f'CAST({made[n]} AS {duck[n]})' for n in kinds)} FROM {of})"
