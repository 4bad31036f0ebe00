"""Notices from templates as data: a set of templates is compiled to one expression over a case's findings, in three scripts.

A set is JSON: settings (days, helpline, office), labels of documents and fields, eight blocks and a template for each code, each in English,
in Bengali script and, where someone wrote it, in Meetei Mayek; what nobody wrote is transliterated. The set in templates.json is a draft to
try the engine with; a service gives its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.text import redact_id
from casemill.operators.casefile import SOURCES
from casemill.operators.notices import transliterate
from casemill.operators.screen_queries import _SQL, PERSON, screened
from casemill.plans.registry import query
from casemill.sources.views import table

# The blocks of a notice in their order, the scripts, and findings that are the citizen's once an officer has accepted them.
BLOCKS = ("title", "greeting", "intro", "bring", "not_rejection", "final_decision", "helpline", "signoff")
SCRIPTS = ("en", "mni_beng", "mni_mtei")
WHEN_ACCEPTED = ("EXTRACTION_FAILED", "AADHAAR_FORM_CARD_MISMATCH")
DIGITS_ONLY = ("last4", "masked")
DASH, OPEN = "—", "\ue001"  # the second stands for a brace within a value while placeholders are filled
ITEM = "array<struct<code:string,document_a:string,document_b:string,field:string,value_a:string,value_b:string,reason:string>>"
DEFAULT = json.loads(Path(__file__).with_name("templates.json").read_text(encoding="utf-8"))


def checked(templates: dict) -> dict:
    """The set, if it is whole: all blocks, a GENERIC template, every entry with its texts and whether it was reviewed."""
    missing = [b for b in BLOCKS if b not in {x["id"] for x in templates["blocks"]}] + ([] if any(t["code"] == "GENERIC" for t in templates["templates"]) else ["GENERIC"])
    if missing:
        raise ValueError(f"templates are missing: {', '.join(missing)}")
    for e in templates["blocks"] + templates["templates"]:
        if not all(isinstance(e.get(s), str) for s in SCRIPTS) or not isinstance(e.get("reviewed"), bool):
            raise ValueError(f"not a template: {e.get('id') or e.get('code')}")
    return templates


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,string>")


def _said(labels: dict, key: Column, script: str) -> Column:
    """A label, else the key itself, else a dash."""
    return F.coalesce(F.try_element_at(_map({k: v[script] for k, v in labels.items()}), key), key, F.lit(DASH))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {placeholders} filled at once: braces within values are not placeholders; one without a value shows a dash."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.replace(F.coalesce(value, F.lit(DASH)), F.lit("{"), F.lit(OPEN)))
    return F.replace(F.regexp_replace(out, r"\{\w+\}", DASH), F.lit(OPEN), F.lit("{"))


def written_field(document: str, field: str) -> str | None:
    """The field of a reply that a typed field was read from; None for what is derived."""
    return SOURCES.get(document, {}).get(field, (None,))[0]


def items(flags: Column, written: Column | None = None) -> Column:
    """What the citizen is asked to mend, from an array of findings (code, reason, evidence), see asked_of_citizen().

    Of evidence the first two count; of dates of birth the first and the next that differs. ``written`` (map of document.field to text) gives
    values as they stand on paper; of an identifier only the last four digits are shown.
    """
    def value(e: Column) -> Column:
        shown = F.when(e["field"].isin(*DIGITS_ONLY), F.right(e["value"], F.lit(4))).otherwise(e["value"])
        if written is None:
            return shown
        return F.when(e["field"].isin(*DIGITS_ONLY), shown).otherwise(F.coalesce(F.nullif(F.try_element_at(written, F.concat(e["document"], F.lit("."), e["field"])), F.lit("")), shown))

    def item(f: Column) -> Column:
        first = F.get(f["evidence"], F.lit(0))
        two = F.when(f["code"] == "DOB_MISMATCH", F.filter(f["evidence"], lambda e, i: (i == 0) | ~e["value"].eqNullSafe(first["value"]))).otherwise(f["evidence"])
        b = F.get(two, F.lit(1))
        field = F.when(first["field"] != "document", first["field"])
        parts = {"code": f["code"], "document_a": first["document"], "document_b": b["document"], "field": field, "value_a": value(first), "value_b": value(b), "reason": f["reason"]}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    return F.transform(flags, item).cast(ITEM)


def asked_of_citizen(flags: Column, resolved: bool = False) -> Column:
    """The findings of an array that a notice speaks of; ``resolved``: they have a resolution."""
    if not resolved:
        return F.filter(flags, lambda f: f["action"] == "citizen")
    accepted = lambda f: (f["resolution"] == "ACCEPTED") & f["code"].isin(*WHEN_ACCEPTED)
    return F.filter(flags, lambda f: (f["resolution"] != "OVERRIDDEN") & ((f["action"] == "citizen") | accepted(f)))


def compiled(templates: dict = DEFAULT, scripts: tuple[str, ...] = SCRIPTS) -> Callable[..., Column]:
    """A function of columns (name, reference, date, district, items) to a notice.

    It has a struct for each of ``scripts`` (a text a block, and items), codes (of the templates used), pending (how many of the blocks and templates
    used nobody has reviewed) and mayek ('auto' if any line of it was transliterated). Every text has its full identifiers masked.
    """
    templates = checked(templates)
    settings, labels = templates["settings"], templates["labels"]
    blocks, by_code = {b["id"]: b for b in templates["blocks"]}, {t["code"]: t for t in templates["templates"]}
    known = F.array(*[F.lit(c) for c in by_code])

    def notice(name: Column, reference: Column, date: Column, district: Column, given: Column, days: Column | None = None, helpline: Column | None = None) -> Column:
        def of_case(script: str) -> dict[str, Column]:
            days_, helpline_ = (F.lit(str(settings["days"])) if days is None else days.cast("string")), (F.lit(settings["helpline"]) if helpline is None else helpline)
            return {"name": name, "ref": reference, "date": date, "district": district, "days": days_, "helpline": helpline_, "office": filled(F.lit(settings["office"][script]), {"district": district})}

        def of_item(i: Column, script: str) -> dict[str, Column]:
            a, b = _said(labels["documents"], i["document_a"], script), _said(labels["documents"], i["document_b"], script)
            return {"document": a, "document_a": a, "document_b": b, "field": _said(labels["fields"], i["field"], script), "value_a": i["value_a"], "value_b": i["value_b"], "reason": F.coalesce(i["reason"], F.lit(""))}

        no_item = {k: F.lit(DASH) for k in ("document", "document_a", "document_b", "field", "value_a", "value_b")} | {"reason": F.lit("")}
        values = {s: of_case(s) for s in ("en", "mni_beng")}

        def text(entry: dict, script: str) -> Column:
            if script != "mni_mtei":
                return redact_id(filled(F.lit(entry[script]), values[script] | no_item))
            if entry[script].strip():
                return redact_id(filled(F.lit(entry[script]), {k: transliterate(v) for k, v in (values["mni_beng"] | no_item).items()}))
            return redact_id(transliterate(filled(F.lit(entry["mni_beng"]), values["mni_beng"] | no_item)))

        def line(i: Column, script: str) -> Column:
            code = F.when(F.array_contains(known, i["code"]), i["code"]).otherwise("GENERIC")
            pattern = lambda s: F.element_at(_map({c: t[s] for c, t in by_code.items()}), code)
            if script != "mni_mtei":
                return redact_id(filled(pattern(script), values[script] | of_item(i, script)))
            own = {c: t[script] for c, t in by_code.items() if t[script].strip()}
            auto = transliterate(filled(pattern("mni_beng"), values["mni_beng"] | of_item(i, "mni_beng")))
            if own:
                written = filled(F.try_element_at(_map(own), code), {k: transliterate(v) for k, v in (values["mni_beng"] | of_item(i, "mni_beng")).items()})
                auto = F.when(code.isin(*own), written).otherwise(auto)
            return redact_id(auto)

        def lines(script: str) -> Column:
            return F.transform(given, lambda i: line(i, script)).alias("items")

        written = [F.struct(*[text(blocks[b], s).alias(b) for b in BLOCKS], lines(s)).alias(s) for s in scripts]
        codes = F.transform(given, lambda i: F.when(F.array_contains(known, i["code"]), i["code"]).otherwise("GENERIC"))
        unread = sum(not b["reviewed"] for b in templates["blocks"] if b["id"] in BLOCKS)
        drafts = [c for c, t in by_code.items() if not t["reviewed"]]
        pending = F.lit(unread) + (F.size(F.array_intersect(codes, F.array(*map(F.lit, drafts)))) if drafts else F.lit(0))
        bare = [c for c, t in by_code.items() if not t["mni_mtei"].strip()]
        auto = F.lit(any(not blocks[b]["mni_mtei"].strip() for b in BLOCKS)) | (F.arrays_overlap(codes, F.array(*map(F.lit, bare))) if bare else F.lit(False))
        return F.struct(*written, codes.alias("codes"), pending.cast("int").alias("pending"), F.when(auto, "auto").otherwise("manual").alias("mayek"))

    return notice


def plain(notice: Column, script: str) -> Column:
    """A notice of one script as text for a message: blocks by line, items numbered."""
    t = notice[script]
    numbered = F.transform(t["items"], lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    lines = F.concat(F.array(t["title"], F.lit(""), t["greeting"], t["intro"]), numbered, F.array(F.lit(""), t["bring"], t["not_rejection"], t["final_decision"], t["helpline"], F.lit(""), t["signoff"]))
    return redact_id(F.array_join(lines, "\n"))


def reviews(templates: DataFrame) -> DataFrame:
    """kind, reviewed, entries and those in Meetei Mayek of a table of template entries (kind, reviewed, mni_mtei)."""
    return templates.groupBy("kind").agg(F.count_if("reviewed").alias("reviewed"), F.count("*").alias("entries"), F.count_if(F.trim("mni_mtei") != "").alias("mayek"))


def entries(spark: SparkSession, templates: dict = DEFAULT) -> DataFrame:
    """Blocks and templates of a set as one table: kind, name and the entry's texts."""
    rows = [("block", b["id"], b["en"], b["mni_beng"], b["mni_mtei"], b["reviewed"]) for b in templates["blocks"]] + [("template", t["code"], t["en"], t["mni_beng"], t["mni_mtei"], t["reviewed"]) for t in templates["templates"]]
    return spark.createDataFrame(rows, "kind string, name string, en string, mni_beng string, mni_mtei string, reviewed boolean")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _label_sql(labels: dict, key: str, script: str) -> str:
    return f"coalesce(CASE {key} {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v[script])}' for k, v in labels.items())} ELSE {key} END, '{DASH}')"


def _text_sql(script: str) -> str:
    """DuckDB SQL: CTE i (an item) to a case's text."""
    s, labels = DEFAULT["settings"], DEFAULT["labels"]
    case = {"name": "name", "ref": "ref", "date": "received", "district": "district", "days": f"'{s['days']}'", "helpline": f"'{s['helpline']}'"}
    office = f"replace({_quoted(s['office'][script])}, '{{district}}', district)"

    def put(text: str, values: dict[str, str]) -> str:
        for k, v in values.items():
            text = f"replace({text}, '{{{k}}}', coalesce({v}, '{DASH}'))"
        return text

    of_item = {"document": _label_sql(labels["documents"], "da", script), "document_a": _label_sql(labels["documents"], "da", script), "document_b": _label_sql(labels["documents"], "db", script), "field": _label_sql(labels["fields"], "field", script), "value_a": "va", "value_b": "vb"}
    pattern = "CASE code " + " ".join(f"WHEN {_quoted(t['code'])} THEN {_quoted(t[script])}" for t in DEFAULT["templates"]) + " END"
    b = {x["id"]: put(_quoted(x[script]), case | {"office": office}) for x in DEFAULT["blocks"]}
    items_ = f"(SELECT string_agg(concat(n, '. ', {put(pattern, of_item)}), chr(10) ORDER BY n) FROM i WHERE i.k = c.k)"
    return f"concat_ws(chr(10), {b['title']}, '', {b['greeting']}, {b['intro']}, {items_}, '', {b['bring']}, {b['not_rejection']}, {b['final_decision']}, {b['helpline']}, '', {b['signoff']})"


_PART = "regexp_extract_all(evidence, '(?:^|;)([a-z]+)\\.([a-z0-9_]+)=([^;]*)', {})"
_DRAFTS = ", ".join(f"'{t['code']}'" for t in DEFAULT["templates"] if not t["reviewed"])
_UNREAD = sum(not b["reviewed"] for b in DEFAULT["blocks"])


@query("notice_text", f"""WITH {_SQL}, e AS (SELECT k, code, row_number() OVER (PARTITION BY k ORDER BY step, a, b) AS n, {_PART.format(1)} AS d, {_PART.format(2)} AS f, {_PART.format(3)} AS v FROM flags WHERE action = 'citizen'),
j AS (SELECT *, CASE WHEN code = 'DOB_MISMATCH' THEN list_position(list_transform(v, lambda x: x <> v[1]), TRUE) ELSE 2 END AS second FROM e),
i AS (SELECT k, code, n, d[1] AS da, d[second] AS db, CASE WHEN f[1] <> 'document' THEN f[1] END AS field, nullif(v[1], '') AS va, nullif(v[second], '') AS vb FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY k ORDER BY n) AS n) FROM j)),
c AS (SELECT a.k, a.anchor AS name, concat('CM-', a.k) AS ref, strftime(b.received, '%Y-%m-%d') AS received, concat('district ', b.p % 16) AS district FROM anchored a JOIN base b ON a.k = b.k WHERE a.k IN (SELECT k FROM i) AND a.anchor IS NOT NULL)
SELECT k AS case_id, {_text_sql('en')} AS english, {_text_sql('mni_beng')} AS bengali, (SELECT array_to_string(list(code ORDER BY n), ',') FROM i WHERE i.k = c.k) AS codes, CAST({_UNREAD} + (SELECT count(DISTINCT code) FROM i WHERE i.k = c.k AND code IN ({_DRAFTS})) AS INT) AS pending FROM c""")
def notice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notice of every case with something to mend, in two scripts, and what of it awaits a review."""
    s = screened(spark, sf_dir).withColumn("asked", asked_of_citizen(F.col("flags"))).where("size(asked) > 0 AND name IS NOT NULL")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("district "), (F.expr(PERSON) % 16).cast("string")).alias("district"))
    rows = s.select("case_id", "name", items(F.col("asked")).alias("items")).join(o, "case_id")
    made = rows.select("case_id", compiled(scripts=("en", "mni_beng"))(F.col("name"), F.concat(F.lit("CM-"), F.col("case_id").cast("string")), F.col("date"), F.col("district"), F.col("items")).alias("n"))
    return made.select("case_id", plain(F.col("n"), "en").alias("english"), plain(F.col("n"), "mni_beng").alias("bengali"), F.array_join("n.codes", ",").alias("codes"), "n.pending")
