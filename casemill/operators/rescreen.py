"""Screening anew only what has changed: cases by a digest of what was read, findings carried on by what they are about, statuses refreshed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.screen import DOCUMENTS, EVIDENCE, Rules, screen, status
from casemill.sources.buckets import Bucketed
from casemill.sources.shared import materialize, shuffled, temporaries

APPROVED = "APPROVED"
#: A stored finding: what the rules say, its key, and what officers decided.
FINDINGS = f"case_id {{key}}, place int, code string, severity string, action string, reason string, evidence {EVIDENCE}, flag_key string, resolution string, resolved_by string, resolved_at timestamp, resolution_reason string"
STATES = "case_id {key}, digest string, status string, first_status string, processing string, screened_at timestamp, priority int, last4 string, dob string, name string"
DECISION = ("resolution", "resolved_by", "resolved_at", "resolution_reason")


def digest(typed: DataFrame) -> Column:
    """A digest of all that was read of a case."""
    return F.sha2(F.to_json(F.struct("received", *DOCUMENTS)), 256)


def flag_key(code: Column, evidence: Column) -> Column:
    """What a finding is about: its code and the fields of its evidence, in order."""
    fields = F.array_sort(F.transform(evidence, lambda e: F.concat(e["document"], F.lit("."), e["field"])))
    return F.concat(code, F.lit("|"), F.array_join(fields, ","))


def carried(fresh: DataFrame, before: DataFrame) -> DataFrame:
    """New findings (case_id, place, code, severity, action, reason, evidence) with the decisions on the same findings before; others are open.

    The same: equal key in the same case; of several before, the last by place.
    """
    keyed = fresh.withColumn("flag_key", flag_key(F.col("code"), F.col("evidence")))
    last = before.groupBy("case_id", "flag_key").agg(F.max_by(F.struct(*DECISION), "place").alias("was"))
    out = keyed.join(shuffled(last), ["case_id", "flag_key"], "left")
    return out.select(*fresh.columns, "flag_key", F.coalesce("was.resolution", F.lit("OPEN")).alias("resolution"), *[F.col(f"was.{c}").alias(c) for c in DECISION[1:]])


def refreshed(findings: DataFrame) -> DataFrame:
    """case_id and the status that its findings give, those overridden left out."""
    standing = F.when(F.col("resolution") != "OVERRIDDEN", F.struct("code", "severity", "action"))
    return findings.groupBy("case_id").agg(F.collect_list(standing).alias("f")).select("case_id", status(F.col("f")).alias("status"))


def blocking(findings: DataFrame) -> DataFrame:
    """Findings that stand in the way of an approval: critical ones not overridden, warnings nobody has looked at."""
    return findings.where("(severity = 'critical' AND resolution <> 'OVERRIDDEN') OR (severity = 'warn' AND resolution = 'OPEN')")


class Screening:
    """The stored outcome of screening under ``path``: a table of cases' states and one of their findings, both in buckets by case."""

    def __init__(self, spark: SparkSession, path: str, key: str = "string", buckets: int = 64):
        self.spark = spark
        self.states = Bucketed(spark, f"{path}/states", STATES.format(key=key), "case_id", buckets)
        self.findings = Bucketed(spark, f"{path}/findings", FINDINGS.format(key=key), "case_id", buckets)

    def update(self, typed: DataFrame, rules: Rules, at: str, **how: object) -> DataFrame:
        """Screen the typed cases that are new or read otherwise than before; returns case_id, status_before and status of those.

        They are compared for duplicates with one another and with all other stored cases. Decisions on findings that come again stay; an
        approved case keeps its status; the first status and time of a case's screening stay. Only the buckets of changed cases are rewritten,
        so that a run over what is known already reads and writes no findings.
        """
        with temporaries(self.spark, "rescreened"):
            known = self.states.read().select("case_id", F.col("digest").alias("was"))
            now = materialize(typed.withColumn("digest", digest(typed)), "typed-cases")
            changed = materialize(now.join(known, "case_id", "left").where(F.col("was").isNull() | (F.col("was") != F.col("digest"))).drop("was"), "changed-cases")
            keys = changed.select("case_id")
            if changed.isEmpty():
                return materialize(self.spark.createDataFrame([], f"case_id {changed.schema['case_id'].dataType.simpleString()}, status_before string, status string"), "rescreened")
            others = self.states.read().join(keys, "case_id", "left_anti").select("case_id", "last4", "dob", "name")
            fresh = materialize(screen(changed.select("case_id", "received", *DOCUMENTS), rules, existing=others, **how), "fresh-findings")
            rows = fresh.select("case_id", F.posexplode("flags").alias("place", "f")).select("case_id", "place", "f.*")
            kept = materialize(carried(rows, self.findings.join(keys)), "carried")
            before = self.states.join(keys).select("case_id", F.col("status").alias("status_before"), "first_status", "screened_at")
            failed = F.greatest(*[F.coalesce(F.col(d)["status"] == "ok", F.lit(False)) for d in DOCUMENTS])
            facts = fresh.drop("status").join(changed.select("case_id", "digest", failed.alias("read")), "case_id").join(before, "case_id", "left").join(refreshed(kept), "case_id", "left")
            derived = F.coalesce("status", F.lit("READY"))
            settled = facts.select(
                "case_id", "digest", F.when(F.col("status_before") == APPROVED, APPROVED).otherwise(derived).alias("status"), F.coalesce("first_status", F.when(F.coalesce(F.col("status_before") != APPROVED, F.lit(True)), derived)).alias("first_status"),
                F.when(F.col("read"), "SCREENED").otherwise("EXTRACTION_FAILED").alias("processing"), F.coalesce("screened_at", F.lit(at).cast("timestamp")).alias("screened_at"), "priority", "last4", "dob", "name", "status_before",
            )
            settled = materialize(settled, "settled")
            self.findings.rewrite(keys, kept)
            self.states.rewrite(keys, settled.drop("status_before"))
            return materialize(settled.select("case_id", "status_before", "status"), "rescreened")

    def decide(self, decisions: DataFrame) -> DataFrame:
        """Decisions (case_id, flag_key, verdict, officer, at, reason) on findings; returns each with its outcome, and who did what to what.

        verdict is 'ACCEPTED', 'OVERRIDDEN' or 'OPEN' (taken back). Refused: an unknown finding, an approved case, an override without a
        reason. Several on one finding: the latest. Statuses of touched cases follow from what stands.
        """
        with temporaries(self.spark, "decided"):
            last = decisions.groupBy("case_id", "flag_key").agg(F.max_by(F.struct("verdict", "officer", "at", "reason"), "at").alias("d"))
            cases = self.states.read().select("case_id", F.col("status").alias("case_status"))
            here = materialize(self.findings.join(decisions.select("case_id").distinct()), "findings-there")
            there = here.select("case_id", "flag_key", F.col("resolution").alias("was")).distinct()
            blank = F.coalesce(F.trim("d.reason"), F.lit("")) == ""
            outcome = F.when(F.col("was").isNull(), "no such finding").when(F.col("case_status") == APPROVED, "the case is approved").when(~F.coalesce(F.col("d.verdict").isin("ACCEPTED", "OVERRIDDEN", "OPEN"), F.lit(False)), "unknown verdict")
            outcome = outcome.when((F.col("d.verdict") == "OVERRIDDEN") & blank, "an override needs a reason").otherwise("done")
            judged = last.join(there, ["case_id", "flag_key"], "left").join(cases, "case_id", "left")
            judged = materialize(judged.select("case_id", "flag_key", "d.verdict", "d.officer", "d.at", "d.reason", "was", outcome.alias("outcome")), "decided")
            done = judged.where("outcome = 'done'").select("case_id", "flag_key", F.struct("verdict", "officer", "at", "reason").alias("now"))
            touched = materialize(done.select("case_id").distinct(), "touched-cases")
            names = here.columns
            again = here.join(touched, "case_id", "left_semi").join(done, ["case_id", "flag_key"], "left")
            new = {"resolution": "verdict", "resolved_by": "officer", "resolved_at": "at", "resolution_reason": "reason"}
            open_ = F.col("now.verdict") == "OPEN"
            again = again.withColumns({c: F.when(F.col("now").isNull(), F.col(c)).when(open_, F.lit("OPEN") if c == "resolution" else F.lit(None)).otherwise(F.col("now")[f]) for c, f in new.items()}).select(*names)
            again = materialize(again, "decided-findings")
            states = materialize(self.states.join(touched).join(refreshed(again).select("case_id", F.col("status").alias("new_status")), "case_id", "left"), "touched-states")
            self.findings.rewrite(touched, again)
            self.states.rewrite(touched, states.withColumn("status", F.col("new_status")).drop("new_status"))
            return judged

    def audit(self, decided: DataFrame) -> DataFrame:
        """Rows of the audit log for decisions that were done: actor, action, entity_id, before and after as JSON."""
        action = F.when(F.col("verdict") == "ACCEPTED", "FLAG_ACCEPTED").when(F.col("verdict") == "OVERRIDDEN", "FLAG_OVERRIDDEN").otherwise("FLAG_REOPENED")
        return decided.where("outcome = 'done'").select(
            F.concat(F.lit("officer:"), "officer").alias("actor"), action.alias("action"), F.concat_ws("|", F.col("case_id").cast("string"), "flag_key").alias("entity_id"), "at",
            F.to_json(F.struct(F.col("was").alias("resolution"))).alias("before_json"), F.to_json(F.struct(F.col("verdict").alias("resolution"), "reason")).alias("after_json"),
        )
