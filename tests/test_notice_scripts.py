"""A notice is compiled for the scripts that are shown; they read as in the notice of all scripts."""

from pyspark.sql import functions as F

from casemill.operators.notice_text import ITEM, compiled


def test_scripts_not_shown_are_not_compiled(spark):
    items = F.expr("array(named_struct('code', 'MISSING_FIELD', 'document_a', 'form', 'document_b', NULL, 'field', 'name', 'value_a', NULL, 'value_b', NULL, 'reason', ''))").cast(ITEM)
    given = (F.lit("Tomba"), F.lit("CM-1"), F.lit("2001-09-01"), F.lit("district 1"), items)
    row = spark.range(1).select(compiled()(*given).alias("all"), compiled(scripts=("en", "mni_beng"))(*given).alias("two")).first()
    assert set(row["two"].asDict()) == set(row["all"].asDict()) - {"mni_mtei"}
    assert all(row["two"][k] == row["all"][k] for k in row["two"].asDict())
