"""Queries of the scalar functions, over rows given in code and over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import dates, text
from casemill.plans.registry import query
from casemill.sources.views import CASES, NOW_MS, TODAY, cases, literal, literal_and, table

NAMES, NAMES_SQL = literal([(1, "Ghanapriya"), (2, "Bheemsen"), (3, "Okraam"), (4, "Jogeshwor"), (5, "Phoolo Rai"), (6, "Vaiphei"), (7, "Dhanno"), (8, ""), (9, None), (10, "Wahengbam")], "id long, name string")


def _phonetic_sql(c: str) -> str:
    out = f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"
    for pattern, to in text.RESPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{letter}+', '{letter}', 'g')"
    return out


@query("str_phonetic_key", f"SELECT id, name, {_phonetic_sql('name')} AS phonetic FROM {NAMES_SQL} UNION ALL SELECT p_partkey + 1000, p_name, {_phonetic_sql('p_name')} FROM part")
def str_phonetic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = NAMES(spark).unionByName(table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).alias("id"), F.col("p_name").alias("name")))
    return rows.withColumn("phonetic", text.phonetic_key(F.col("name")))


IDS, IDS_SQL = literal([(1, "id 2345 6789 0123 ok"), (2, "234567890123"), (3, "1234 5678 9012"), (4, "x2345-6789-0124y 998877665544"), (5, "92345678901234"), (6, None), (7, "a 2345 67890125, b"), (8, "123e4567-e89b-12d3-a456-426614174000 only")], "id long, txt string")
_ID = "([2-9][0-9]{3})[ -]?([0-9]{4})[ -]?([0-9]{4})"
_EDGED = f"(^|[^0-9]){_ID}($|[^0-9])"
_REDACT = f"regexp_replace(regexp_replace(txt, '{_EDGED}', '\\1XXXX XXXX \\4\\5', 'g'), '{_EDGED}', '\\1XXXX XXXX \\4\\5', 'g')"
_ALL_TEXTS = f"SELECT id, txt FROM {IDS_SQL} UNION ALL SELECT doc_id + 100, text FROM documents UNION ALL SELECT page_id + 100000000, html FROM pages"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("text").alias("txt"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 100_000_000).alias("id"), F.col("html").alias("txt"))
    return IDS(spark).unionByName(docs).unionByName(pages)


@query("str_redact_id", f"SELECT id, sha256({_REDACT}) AS redacted FROM ({_ALL_TEXTS})")
def str_redact_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.sha2(text.redact_id(F.col("txt")), 256).alias("redacted"))


@query("str_contains_id", f"SELECT id, regexp_matches(regexp_replace(txt, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|\\b[0-9a-f]{{64}}\\b', ' ', 'g'), '(^|[^0-9]){_ID}($|[^0-9])') AS leak FROM ({_ALL_TEXTS})")
def str_contains_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", text.contains_id(F.col("txt")).alias("leak"))


DIGIT_ROWS, DIGITS_SQL = literal_and([(1, "2345 6789 0123"), (2, "12"), (3, None), (4, "no 2345-6789-0123 .")], "id long, txt string", "part", id="p_partkey + 1000", txt="concat(CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' ELSE p_type END, ' ', CAST(p_partkey % 9000 + 1000 AS STRING), '-', CAST(p_partkey * 7 % 9000 + 1000 AS STRING), ' ', CAST(p_partkey * 11 % 9000 + 1000 AS STRING))")


@query("str_mask", f"SELECT id, CASE WHEN regexp_matches(regexp_replace(txt, '[^0-9]', '', 'g'), '^[0-9]{{12}}$') THEN concat('XXXX XXXX ', substr(regexp_replace(txt, '[^0-9]', '', 'g'), 9, 4)) END AS masked FROM (SELECT * FROM {IDS_SQL} UNION ALL SELECT * FROM {DIGITS_SQL})")
def str_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IDS(spark).unionByName(DIGIT_ROWS(spark, sf_dir)).select("id", text.mask_id(F.col("txt")).alias("masked"))


CODES, CODES_SQL = literal_and([(1, "sbin0 001234"), (2, "SBIN1001234"), (3, "hdfc0abc12z"), (4, "abc 1234567"), (5, "ABC123456"), (6, ""), (7, None)], "id long, code string", "part", id="p_partkey + 1000", code="CASE p_partkey % 4 WHEN 0 THEN concat('abcd0 ', lpad(CAST(p_partkey AS STRING), 6, '0')) WHEN 1 THEN concat('ABC ', lpad(CAST(p_partkey AS STRING), 7, '0')) WHEN 2 THEN concat('abc', CAST(p_partkey AS STRING)) ELSE p_brand END")


@query("str_ifsc_epic", f"SELECT id, regexp_matches(upper(regexp_replace(code, '\\s', '', 'g')), '^[A-Z]{{4}}0[A-Z0-9]{{6}}$') AS ifsc, regexp_matches(upper(regexp_replace(code, '\\s', '', 'g')), '^[A-Z]{{3}}[0-9]{{7}}$') AS epic FROM {CODES_SQL}")
def str_ifsc_epic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CODES(spark, sf_dir).select("id", text.is_ifsc(F.col("code")).alias("ifsc"), text.is_epic(F.col("code")).alias("epic"))


@query("str_loose", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(concat(' ', c_name, '. ', c_mktsegment, ',  x')), '[.,:;''\"`]', '', 'g'), '\\s+', ' ', 'g')) AS loose FROM customer")
def str_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.loose(F.concat(F.lit(" "), "c_name", F.lit(". "), "c_mktsegment", F.lit(",  x"))).alias("loose"))


OCR, OCR_SQL = literal_and([(1, "0kram"), (2, "La1remsiami"), (3, "10 Downing"), (4, "R0sh1"), (5, None), (6, "007")], "id long, raw string", "part", id="p_partkey + 1000", raw="replace(replace(concat(p_name, ' ', CAST(p_partkey AS STRING), p_type), 'o', '0'), 'l', '1')")


@query("str_ocr_repair", f"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '([A-Za-z])0', '\\1o', 'g'), '0([A-Za-z])', 'o\\1', 'g'), '([A-Za-z])1', '\\1l', 'g'), '1([A-Za-z])', 'l\\1', 'g') AS repaired FROM {OCR_SQL}""")
def str_ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OCR(spark, sf_dir).select("id", text.repair_ocr(F.col("raw")).alias("repaired"))


RELATIONS, RELATIONS_SQL = literal([(1, "Asha Rai S/o Ram Rai"), (2, "Bina, wife of K. Das"), (3, "Soni Devi"), (4, "Tomba s.o. Chaoba"), (5, "D/O only"), (6, None), (7, "Rai H\\o X"), (8, "Rai wd | 0 X"), (9, "Rai care of"), (10, "Rai son often")], "id long, raw string")


_WITH_RELATIVES = "concat(c_name, CASE c_custkey % 4 WHEN 0 THEN ' S/o ' WHEN 1 THEN ', wife of ' WHEN 2 THEN ' W/0 ' ELSE ' ' END, c_mktsegment)"


@query("str_relation_strip", f"""SELECT id, trim(regexp_replace(regexp_replace(raw, '(?is)(^|[\\s,;:])((wd|[sdwch])\\s*[/|\\\\]\\s*[o0]|[sdwc]\\.[o0]\\.|(son|daughter|wife|widow|husband|care)\\s+of)([^a-z].*)?$', ' '), ' +$', '')) AS stripped FROM (SELECT * FROM {RELATIONS_SQL} UNION ALL SELECT c_custkey + 1000, {_WITH_RELATIVES} FROM customer)""")
def str_relation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without their relatives: the rows above, and every customer's name with a relative's."""
    named = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("id"), F.expr(_WITH_RELATIVES).alias("raw"))
    return RELATIONS(spark).unionByName(named).select("id", text.strip_relation(F.col("raw")).alias("stripped"))


@query("str_humanise_code", "SELECT l_linenumber, upper(substr(c, 1, 1)) || substr(c, 2) AS title, count(*) AS n FROM (SELECT l_linenumber, lower(replace('MISSING_FIELD_' || l_returnflag, '_', ' ')) AS c FROM lineitem) GROUP BY 1, 2")
def str_humanise_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("MISSING_FIELD_"), "l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber", text.humanise(code).alias("title")).agg(F.count("*").alias("n"))


ANSWERS, ANSWERS_SQL = literal(
    [
        (1, "Female", "Rs. 60,000/-", "No", "Unmarried"), (2, "m", "nil", "yes - 40%", "Widow of X"), (3, "Other", "12,345.50 a year", "N/A", "married"), (4, "", "", "", ""), (5, None, None, None, None),
        (6, "Man", "zero", "perhaps", "Divorced"), (7, "T", "0.50", "-", "never"), (8, "x", "007", "- none", "single"), (9, "महिला / Female", "house 12", "40 %", "never married"), (10, "abc / male", "₹ 1,20,000", "Blind", "unmarried widow"),
        (11, "transgender", "INR 5000 yearly", "locomotor", "Spinster"), (12, "trans", "No income", "not known", "separated, once divorced"), (13, "womanly", "none", "Not applicable", "legally separated"), (14, "F.", "rs 9.5 rs", "disabled", "Bachelor"), (15, "fem", "1 2 3", "na", "remarried"),
    ],
    "id long, g string, i string, y string, m string",
)
_ANSWERED = f"""(SELECT * FROM {ANSWERS_SQL} UNION ALL SELECT c_custkey + 1000, CASE c_custkey % 4 WHEN 0 THEN concat('F ', c_name) WHEN 1 THEN concat(c_mktsegment, ' / male') WHEN 2 THEN 'Mahila' ELSE c_name END,
concat(CASE c_custkey % 3 WHEN 0 THEN 'Rs. ' WHEN 1 THEN 'about ' ELSE '' END, CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR), '/-'), CASE c_custkey % 4 WHEN 0 THEN concat(CAST(c_custkey % 100 AS VARCHAR), '%') WHEN 1 THEN concat('no ', c_name) WHEN 2 THEN c_mktsegment ELSE '-' END,
concat(c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN ' widow' WHEN 1 THEN ' Separated' WHEN 2 THEN ' unmarried' WHEN 3 THEN ' married' ELSE '' END) FROM customer)"""


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows above, and answers made of every customer."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return ANSWERS(spark).unionByName(
        c.select(
            (key + 1000).alias("id"),
            F.when(key % 4 == 0, F.concat(F.lit("F "), "c_name")).when(key % 4 == 1, F.concat("c_mktsegment", F.lit(" / male"))).when(key % 4 == 2, "Mahila").otherwise(F.col("c_name")).alias("g"),
            F.concat(F.when(key % 3 == 0, "Rs. ").when(key % 3 == 1, "about ").otherwise(""), F.floor(F.abs("c_acctbal")).cast("string"), F.lit("/-")).alias("i"),
            F.when(key % 4 == 0, F.concat((key % 100).cast("string"), F.lit("%"))).when(key % 4 == 1, F.concat(F.lit("no "), "c_name")).when(key % 4 == 2, F.col("c_mktsegment")).otherwise("-").alias("y"),
            F.concat("c_mktsegment", F.when(key % 5 == 0, " widow").when(key % 5 == 1, " Separated").when(key % 5 == 2, " unmarried").when(key % 5 == 3, " married").otherwise("")).alias("m"),
        )
    )


def parsed_sql(kind: str, c: str) -> str:
    """DuckDB SQL for the parsers of answers, written from their description."""
    low = f"lower(trim({c}))"
    starts = lambda *words: f"regexp_matches({low}, '^({'|'.join(words)})\\b')"
    holds = lambda *words: " OR ".join(f"contains({low}, '{w}')" for w in words)
    if kind == "gender":
        return f"CASE WHEN {starts('f', 'female', 'mahila', 'woman')} OR {holds('/ female')} THEN 'female' WHEN {starts('m', 'male', 'purush', 'man')} OR {holds('/ male')} THEN 'male' WHEN {starts('t', 'transgender', 'other')} THEN 'other' END"
    if kind == "income":
        return f"CASE WHEN {starts('nil', 'none', 'no income', '0+')} THEN 0.0 ELSE TRY_CAST(nullif(regexp_extract(regexp_replace({low}, '(rs\\.?|inr|₹|/-|,|\\s)', '', 'g'), '^[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) END"
    if kind == "yes_no":
        return f"CASE WHEN {starts('no', 'nil', 'none', 'n/a', 'na', 'not applicable', '-')} THEN FALSE WHEN {starts('yes', 'y', 'true')} OR regexp_matches({low}, '[0-9]\\s*%') OR {holds('locomotor', 'blind', 'deaf', 'disab', 'pwd')} THEN TRUE END"
    return f"CASE WHEN {holds('widow')} THEN 'widowed' WHEN {holds('unmarried', 'single', 'spinster', 'bachelor')} THEN 'unmarried' WHEN {holds('divorc')} THEN 'divorced' WHEN {holds('separat')} THEN 'separated' WHEN {holds('married')} THEN 'married' END"


@query("str_parse_answers", f"""SELECT id, {parsed_sql('gender', 'g')} AS gender, {parsed_sql('income', 'i')} AS income, {parsed_sql('yes_no', 'y')} AS yes, {parsed_sql('marital', 'm')} AS marital FROM {_ANSWERED}""")
def str_parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered classifiers of written answers."""
    return _answered(spark, sf_dir).select("id", text.gender(F.col("g")).alias("gender"), text.income(F.col("i")).alias("income"), text.yes_no(F.col("y")).alias("yes"), text.marital(F.col("m")).alias("marital"))


@query("str_displaced", "SELECT page_id, regexp_matches(html, '(?i)relief\\s*camp') AS displaced, regexp_matches(url, '(?i)form|appl') AS formlike FROM pages")
def str_displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.displaced(F.col("html")).alias("displaced"), F.col("url").rlike("(?i)form|appl").alias("formlike"))


@query("str_flag_key", "SELECT l_orderkey AS case_id, array_to_string(list_sort(list(DISTINCT l_returnflag || '.' || CAST(l_linenumber AS VARCHAR))), ',') AS flag_key FROM lineitem GROUP BY l_orderkey")
def str_flag_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat("l_returnflag", F.lit("."), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_join(F.array_sort(F.collect_set(part)), ",").alias("flag_key"))


DATES, DATES_SQL = literal([(1, "1950-02-28"), (2, "31/02/2020"), (3, "5/6/1936"), (4, "1936"), (5, "DOB: 29.02.1948"), (6, "1700"), (7, "x"), (8, None), (9, "2001-09-02"), (10, "1-9-1941"), (11, "2001-13-01")], "id long, raw string")


def date_sql(c: str) -> str:
    """DuckDB SQL for parse_date()."""
    t = f"trim(regexp_replace({c}, '^[^0-9]*', ''))"
    iso = f"strftime(CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_strptime({t}, '%Y-%m-%d') END, '%Y-%m-%d')"
    day_first = f"strftime(CASE WHEN regexp_matches({t}, '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}$') THEN try_strptime(regexp_replace({t}, '[.-]', '/', 'g'), '%d/%m/%Y') END, '%Y-%m-%d')"
    return f"coalesce({iso}, {day_first}, CASE WHEN regexp_matches({t}, '^[0-9]{{4}}$') AND TRY_CAST({t} AS INT) BETWEEN 1880 AND 2100 THEN {t} END)"


_WRITTEN_DATES = "CASE o_orderkey % 4 WHEN 0 THEN concat('DOB ', CAST(1 + o_orderkey % 31 AS STRING), '/', CAST(1 + o_orderkey % 13 AS STRING), '/', CAST(1870 + o_orderkey % 240 AS STRING)) WHEN 1 THEN CAST(1870 + o_orderkey % 240 AS STRING) WHEN 2 THEN concat(CAST(1870 + o_orderkey % 240 AS STRING), '-0', CAST(1 + o_orderkey % 9 AS STRING), '-31') ELSE o_orderpriority END"


@query("date_parse_partial", f"SELECT id, {date_sql('raw')} AS parsed FROM (SELECT * FROM {DATES_SQL} UNION ALL SELECT o_orderkey + 1000, {_WRITTEN_DATES} FROM orders)")
def date_parse_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as people write them: the rows above, and one for every order, many of them impossible."""
    made = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1000).alias("id"), F.expr(_WRITTEN_DATES).alias("raw"))
    return DATES(spark).unionByName(made).select("id", dates.parse_date(F.col("raw")).alias("parsed"))


@query("date_age", f"""WITH {CASES}, d AS (SELECT case_id, CASE WHEN length(dob) = 4 THEN dob || '-12-31' ELSE dob END AS d, length(dob) = 4 AS approximate FROM cases)
SELECT case_id, (2001 - CAST(substr(d, 1, 4) AS INT) - CASE WHEN '{TODAY[5:]}' < substr(d, 6, 5) THEN 1 ELSE 0 END)::INT AS age, approximate FROM d""")
def date_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", dates.age_on(F.col("dob"), F.lit(TODAY)).alias("age"), (F.length("dob") == 4).alias("approximate"))


@query("date_days_pending", f"WITH {CASES} SELECT case_id, floor(greatest({NOW_MS} - received_ms, 0) / 86400000.0)::BIGINT AS days FROM cases WHERE status <> 'APPROVED'")
def date_days_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.floor(F.greatest(F.lit(NOW_MS) - F.col("received_ms"), F.lit(0)) / 86_400_000)
    return cases(spark, sf_dir).where("status <> 'APPROVED'").select("case_id", days.alias("days"))


@query("date_india_day", "SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def date_india_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by calendar day in India."""
    ts = F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 330 MINUTE")
    return table(spark, sf_dir, "events").groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("date_notice", f"WITH {CASES} SELECT case_id, strftime(make_timestamp(received_ms * 1000), '%-d %b %Y') AS day FROM cases WHERE sent_ms IS NOT NULL")
def date_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("received_ms") / 86_400_000).cast("int"))
    return cases(spark, sf_dir).where("sent_ms IS NOT NULL").select("case_id", F.date_format(day, "d MMM yyyy").alias("day"))


_D, _P = f"[{', '.join(map(str, text.DIHEDRAL))}]", f"[{', '.join(map(str, text.PERMUTED))}]"


@query("math_verhoeff", f"""WITH n AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 + 2360000000 AS VARCHAR) AS digits FROM part)
SELECT id, digits, CAST(list_reduce(list_prepend(0, list_transform(range(1, length(digits) + 1), lambda i: list_extract({_P}, ((i - 1) % 8) * 10 + CAST(substr(reverse(digits), i, 1) AS BIGINT) + 1))), lambda a, x: list_extract({_D}, a * 10 + x + 1)) AS INT) AS checksum FROM n""")
def math_verhoeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 + 2360000000).cast("string").alias("digits"))
    return n.withColumn("checksum", text.checksum(F.col("digits")))


@query("math_priority", f"""WITH {CASES} SELECT case_id, CAST(least(100, CASE WHEN 2001 - birth_year >= 80 THEN 30 ELSE 0 END + CASE WHEN case_id % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN case_id % 5 = 0 THEN 20 ELSE 0 END + CASE WHEN case_id % 7 = 0 THEN 25 ELSE 0 END + least(25, floor(greatest({NOW_MS} - received_ms, 0) / 86400000.0))) AS INT) AS score,
array_to_string(list_filter([CASE WHEN 2001 - birth_year >= 80 THEN 'Aged 80 or over' END, CASE WHEN case_id % 3 = 0 THEN 'Widowed' END, CASE WHEN case_id % 5 = 0 THEN 'Disability' END, CASE WHEN case_id % 7 = 0 THEN 'Displaced' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM cases""")
def math_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive priority with its reasons; waiting days count up to 25, the whole up to 100."""
    marks = (("Aged 80 or over", 2001 - F.col("birth_year") >= 80, 30), ("Widowed", F.col("case_id") % 3 == 0, 20), ("Disability", F.col("case_id") % 5 == 0, 20), ("Displaced", F.col("case_id") % 7 == 0, 25))
    days = F.least(F.lit(25), F.floor(F.greatest(F.lit(NOW_MS) - F.col("received_ms"), F.lit(0)) / 86_400_000))
    score = sum((F.when(test, w).otherwise(0) for _, test, w in marks), days)
    reasons = F.array_join(F.array_compact(F.array(*[F.when(test, name) for name, test, _ in marks])), "; ")
    return cases(spark, sf_dir).select("case_id", F.least(F.lit(100), score).cast("int").alias("score"), reasons.alias("reasons"))


BOXES, BOXES_SQL = literal_and([(1, -3.2, 5.0, 60.7, 80.4), (2, 10.0, 10.0, 10.2, 30.0), (3, 90.0, 0.5, 140.0, 99.5), (4, None, 1.0, 2.0, 3.0)], "id long, x1 double, y1 double, x2 double, y2 double", "part", id="p_partkey + 1000", x1="p_size * 2.5 - 10", y1="p_partkey % 97 + 0.5", x2="CASE WHEN p_partkey % 29 <> 0 THEN p_size * 3 - 20.25 END", y2="p_retailprice / 20")


@query("math_clamp_bbox", f"""WITH c AS (SELECT id, floor(greatest(0, least(100, x1)) + 0.5)::INT AS a, floor(greatest(0, least(100, y1)) + 0.5)::INT AS b, floor(greatest(0, least(100, x2)) + 0.5)::INT AS c, floor(greatest(0, least(100, y2)) + 0.5)::INT AS d FROM {BOXES_SQL} WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL)
SELECT b.id, CASE WHEN c.c > c.a AND c.d > c.b THEN concat_ws(',', c.a, c.b, c.c, c.d) END AS box FROM {BOXES_SQL} b LEFT JOIN c ON b.id = c.id""")
def math_clamp_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box rounded half up and clamped to a 100 by 100 image; null without area or with a missing side."""
    sides = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(c))) + 0.5).cast("int") for c in ("x1", "y1", "x2", "y2")]
    whole = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    return BOXES(spark, sf_dir).select("id", F.when(whole & (sides[2] > sides[0]) & (sides[3] > sides[1]), F.concat_ws(",", *[s.cast("string") for s in sides])).alias("box"))


@query("arr_filter_exists", "WITH k AS (SELECT l_orderkey AS case_id, list_sort(list(l_linenumber)) AS xs FROM lineitem GROUP BY l_orderkey) SELECT case_id, len(list_filter(xs, lambda x: x > 3))::INT AS late, len(list_filter(xs, lambda x: x = 1)) > 0 AS has_first, len(list_filter(xs, lambda x: x < 6)) = len(xs) AS all_early FROM k")
def arr_filter_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_list("l_linenumber").alias("xs"))
    return k.select("case_id", F.size(F.filter("xs", lambda x: x > 3)).alias("late"), F.exists("xs", lambda x: x == 1).alias("has_first"), F.forall("xs", lambda x: x < 6).alias("all_early"))


@query("arr_numbered_lines", "SELECT l_orderkey AS case_id, array_to_string(list_transform(list_sort(list(DISTINCT l_returnflag)), lambda x, i: concat(CAST(i AS VARCHAR), '. ', x)), chr(10)) AS lines FROM lineitem GROUP BY l_orderkey")
def arr_numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = F.array_sort(F.collect_set("l_returnflag"))
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(xs.alias("xs"))
    return by.select("case_id", F.array_join(F.transform("xs", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n").alias("lines"))


@query("arr_worst_verdict", "SELECT o_custkey, CASE min(o_orderkey % 4) WHEN 0 THEN 'DIFFERENT' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'LIKELY_SAME' ELSE 'SAME' END AS verdict FROM orders GROUP BY o_custkey")
def arr_worst_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("DIFFERENT", "AMBIGUOUS", "LIKELY_SAME", "SAME")))
    v = F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(v).alias("v")).select("o_custkey", text.worst(F.col("v")).alias("verdict"))


@query("json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("json_update_field", "SELECT event_id, concat('{\"k\":', CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR), ',\"edited\":true}') AS props FROM events")
def json_update_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of a JSON object changed and one added, the rest kept."""
    edited = text.json_with(F.col("props"), k=F.variant_get(F.parse_json("props"), "$.k", "bigint") + 1, edited=F.lit(True))
    return table(spark, sf_dir, "events").select("event_id", edited.alias("props"))


@query("json_row_stringify", "SELECT n_nationkey, concat('{\"n_nationkey\":', CAST(n_nationkey AS VARCHAR), ',\"n_name\":\"', n_name, '\",\"n_regionkey\":', CAST(n_regionkey AS VARCHAR), '}') AS row FROM nation")
def json_row_stringify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("*")).alias("row"))
