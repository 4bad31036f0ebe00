"""The tamper-evident log: sealing, verification, leak scan, retention."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions.text import contains_id
from casemill.plans.registry import query
from casemill.sources.views import AUDIT, CASES, NOW_MS, audit_log, cases, table

#: A key for demonstrations; production passes its own.
KEY = b"casemill-demo-key"
FIELDS = ("audit_id", "actor", "action", "after_json")


def seal(log: DataFrame, chain: str, key: bytes = KEY, heads: DataFrame | None = None) -> DataFrame:
    """Each chain's rows in order with prev_hash and hash: HMAC-SHA256 over the hash before and the row as a JSON array.

    A chain is inherently sequential; many chains (one a case) are sealed side by side, each streamed in sorted order without being gathered.
    heads has the chain and the hash that its next row follows; a chain without one begins anew.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[object, str] = (None, "genesis")
        for f in frames:
            before, own = [], []
            for head, row in zip(f.pop("__head"), f[[chain, *FIELDS]].itertuples(index=False)):
                prev = last[1] if row[0] == last[0] else head
                body = json.dumps([x.item() if hasattr(x, "item") else x for x in row[1:]], ensure_ascii=False, separators=(",", ":"))
                digest = hmac.new(key, f"{prev}\n{body}".encode(), hashlib.sha256).digest()
                last = (row[0], base64.urlsafe_b64encode(digest).decode().rstrip("="))
                before.append(prev)
                own.append(last[1])
            yield f.assign(prev_hash=before, hash=own)

    rows = log.select(chain, *FIELDS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", prev_hash string, hash string"
    if heads is None:
        rows = rows.withColumn("__head", F.lit("genesis"))
    else:
        rows = rows.join(heads.select(chain, F.col("hash").alias("__head")), chain, "left").na.fill("genesis", ["__head"])
    return rows.repartition(chain).sortWithinPartitions(chain, "audit_id").mapInPandas(run, schema)


def verify(log: DataFrame, sealed: DataFrame, chain: str, key: bytes = KEY) -> DataFrame:
    """Problems by chain and row: a broken link, a deleted, modified or inserted row. Rows after the last sealed one are no problem. Parallel."""
    link = F.lag("hash", 1, "genesis").over(Window.partitionBy(chain).orderBy("audit_id"))
    links = sealed.select(chain, "audit_id", "prev_hash", "hash", (F.col("prev_hash") != link).alias("broken"), *[F.col(c).alias(f"sealed_{c}") for c in FIELDS[1:]])
    last = sealed.groupBy(chain).agg(F.max("audit_id").alias("last"))
    both = log.select(chain, *FIELDS, F.lit(True).alias("here")).join(links.withColumn("there", F.lit(True)), [chain, "audit_id"], "full_outer").join(last, chain, "left")
    changed = F.lit(False)
    for c in FIELDS[1:]:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"sealed_{c}"))
    problem = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull() & (F.col("audit_id") <= F.col("last")), "inserted").when(F.col("there").isNotNull() & changed, "modified").when(F.col("broken"), "broken link")
    return both.select(chain, "audit_id", problem.alias("problem")).where("problem IS NOT NULL")


@query("audit_seal")
def audit_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seal(audit_log(spark, sf_dir), "case_id").select("case_id", "audit_id", "prev_hash", "hash")


@query("audit_verify", f"""WITH {AUDIT} SELECT case_id, audit_id, CASE WHEN audit_id % 401 = 0 THEN 'deleted' ELSE 'modified' END AS problem FROM audit_log WHERE audit_id % 401 = 0 OR audit_id % 307 = 0""")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification says after rows were deleted and edited behind the seal's back."""
    log = audit_log(spark, sf_dir)
    now = log.where("audit_id % 401 <> 0").withColumn("action", F.when(F.col("audit_id") % 307 == 0, "edited").otherwise(F.col("action")))
    return verify(now, seal(log, "case_id"), "case_id")


#: The tables of the domain with their keys and text columns, for the SQL; Spark takes the columns from the schemas.
SCANNED = {
    "documents": ("doc_id", ("text", "lang", "source")), "pages": ("page_id", ("url", "html")), "events": ("event_id", ("event_type", "props")),
    "conversations": ("conv_id", ("role", "text")), "orders": ("o_orderkey", ("o_orderstatus", "o_orderpriority")), "lineitem": ("l_orderkey", ("l_returnflag", "l_linestatus")),
    "customer": ("c_custkey", ("c_name", "c_mktsegment")), "nation": ("n_nationkey", ("n_name",)), "benchmark": ("item_id", ("text",)),
}
_LEAK = "regexp_matches(regexp_replace({}, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|\\b[0-9a-f]{{64}}\\b', ' ', 'g'), '(^|[^0-9])([2-9][0-9]{{3}})[ -]?([0-9]{{4}})[ -]?([0-9]{{4}})($|[^0-9])')"
_PROBE = "SELECT 1 AS id, 'card 2345 6789 0123' AS txt, 'in hash 123e4567-e89b-12d3-a456-426614174000' AS note"


def leaks(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """place, column, id of every value of a text column that holds a full identifier, never the identifier; columns come from the schemas.

    tables: name -> (rows, key). Each table is scanned once.
    """
    out = None
    for name, (df, key) in tables.items():
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        hit = [F.when(contains_id(F.col(c)), F.lit(c)) for c in texts]
        rows = df.select(F.lit(name).alias("place"), F.col(key).cast("long").alias("id"), F.explode(F.array_compact(F.array(*hit))).alias("column"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _scanned(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str]]:
    return {t: (table(spark, sf_dir, t), k) for t, (k, _) in SCANNED.items()} | {"probe": (spark.sql(_PROBE), "id")}


@query("audit_leak_places", " UNION ALL ".join([f"SELECT '{t}' AS place, CAST({k} AS BIGINT) AS id, '{c}' AS \"column\" FROM {t} WHERE {_LEAK.format(c)}" for t, (k, cs) in SCANNED.items() for c in cs] + ["SELECT 'probe', 1, 'txt'"]))
def audit_leak_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where full identifiers stand, in every text column of the domain's tables."""
    return leaks(_scanned(spark, sf_dir)).select("place", "id", "column")


@query("audit_leak_scan", "SELECT place, count(*) AS rows, count(*) FILTER (WHERE leak) AS leaks FROM (" + " UNION ALL ".join([f"SELECT '{t}' AS place, {' OR '.join(f'coalesce({_LEAK.format(c)}, FALSE)' for c in cs)} AS leak FROM {t}" for t, (_, cs) in SCANNED.items()] + ["SELECT 'probe', TRUE"]) + ") GROUP BY place")
def audit_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a full identifier in any text column, table by table, over all tables of the domain; columns come from the schemas."""
    out = None
    for name, (df, _) in _scanned(spark, sf_dir).items():
        leak = reduce(lambda a, b: a | b, [F.coalesce(contains_id(F.col(f.name)), F.lit(False)) for f in df.schema if f.dataType.simpleString() == "string"])
        part = df.agg(F.count("*").alias("rows"), F.count_if(leak).alias("leaks")).select(F.lit(name).alias("place"), "rows", "leaks")
        out = part if out is None else out.unionByName(part)
    return out


@query("audit_retention_due", f"WITH {CASES} SELECT case_id, decided_ms FROM cases WHERE status = 'APPROVED' AND NOT historical AND decided_ms <= {NOW_MS} - CAST(730 AS BIGINT) * 86400000")
def audit_retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed, live cases decided two years ago or before, whose images go."""
    return retention_due(cases(spark, sf_dir), 730).select("case_id", "decided_ms")


def retention_due(df: DataFrame, days: int) -> DataFrame:
    """None are due where retention is off (0 days or fewer)."""
    if days <= 0:
        return df.limit(0)
    return df.where((F.col("status") == "APPROVED") & ~F.col("historical") & (F.col("decided_ms") <= NOW_MS - days * 86_400_000))


@query("audit_summary", f"WITH {AUDIT} SELECT action, CASE action WHEN 'signup' THEN 'Case received' WHEN 'purchase' THEN 'Case approved' WHEN 'error' THEN 'Reading failed' ELSE upper(substr(action, 1, 1)) || substr(action, 2) END AS title, count(*) AS n FROM audit_log GROUP BY 1, 2")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.create_map(*[F.lit(x) for p in (("signup", "Case received"), ("purchase", "Case approved"), ("error", "Reading failed")) for x in p])
    title = F.coalesce(F.try_element_at(titles, F.col("action")), F.concat(F.upper(F.substring("action", 1, 1)), F.substring("action", 2, 100)))
    return audit_log(spark, sf_dir).groupBy("action", title.alias("title")).agg(F.count("*").alias("n"))
