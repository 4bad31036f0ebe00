"""Files in and out: packets, labelled pairs, archives, log lines; tables written by upsert."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions.text import redact_id
from casemill.sources.shared import kept, shared_dir

TRUTH = "packet_id string, expected_status string, documents map<string, struct<type: string, fields: map<string, string>>>, name_checks array<struct<a: string, b: string, expected: string>>, expected_flags array<struct<code: string, severity: string, action: string>>"
ANSWERS = {"yes": True, "same": True, "true": True, "no": False, "different": False, "false": False}
IMAGE = r"(?i)\.(jpe?g|png|webp|heic)$"
HIDDEN = r"(^|/)(\.|__MACOSX/)"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share, which cleanup() removes."""
    return kept(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Labelled packets, one truth.json a folder, with the folder's name; a broken file gives nulls."""
    df = spark.read.schema(TRUTH).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{path}/*/truth.json")
    return df.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/truth[.]json$", 1))


def packet_fields(packets_: DataFrame) -> DataFrame:
    """packet_id, file, type, field, value of every labelled field."""
    files = packets_.select("packet_id", F.explode("documents").alias("file", "d"))
    return files.select("packet_id", "file", F.col("d.type").alias("type"), F.explode("d.fields").alias("field", "value"))


def check_pairs(rows: DataFrame) -> DataFrame:
    """Rows of labelled name pairs (row, name_a, name_b, community, expected_same) with same_person (null: ambiguous) and error (null: fine)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    label = F.lower(F.trim("expected_same"))
    known = F.create_map(*[F.lit(x) for kv in ANSWERS.items() for x in kv])
    error = F.when(blank("name_a") | blank("name_b"), "a name is missing").when(~label.isin(*ANSWERS, "ambiguous") | label.isNull(), F.concat(F.lit("unknown label: "), F.coalesce("expected_same", F.lit(""))))
    return rows.withColumn("same_person", F.try_element_at(known, label)).withColumn("error", error)


def pairs_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, errors) of a CSV file; any error leaves no pairs. Quotes, CRLF and a byte-order mark are understood, blank lines skipped."""
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    read = read.toDF(*[c.replace("﻿", "").strip().lower() for c in read.columns])
    for name, default in (("community", "Unknown"), ("expected_same", None), ("name_a", None), ("name_b", None)):
        if name not in read.columns:
            read = read.withColumn(name, F.lit(default).cast("string"))
    # the header is row 1; a file is read whole (multiLine), so that its rows keep their order in one partition, and each file counts its own
    place = Window.partitionBy("file").orderBy("at")
    read = read.withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
    checked = check_pairs(read.withColumn("row", F.row_number().over(place) + 1).drop("at"))
    errors = checked.where("error IS NOT NULL").select("file", "row", "error")
    return checked.where("error IS NULL").join(errors.limit(1).select(F.lit(True).alias("any")), F.lit(True), "left_anti"), errors


def sniff(content: Column) -> Column:
    """The kind of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(F.substring(head, 9, 8) == "66747970", "heic").when(head.startswith("504B0304"), "zip")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, bytes and sha256 of the image files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", sniff(F.col("content")).alias("kind"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where("kind <> 'zip'")


def zipped_images(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """archive, name, content of the images in ZIP files; hidden and system entries are never inflated, nor are those over ``most_bytes``, whose content is null."""
    image, hidden = re.compile(IMAGE), re.compile(HIDDEN)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                with zipfile.ZipFile(io.BytesIO(row.content)) as z:
                    for entry in z.infolist():
                        if image.search(entry.filename) and not hidden.search(entry.filename):
                            content = z.read(entry) if entry.file_size <= most_bytes else None
                            yield pd.DataFrame({"archive": [row.path], "name": [entry.filename], "content": [content]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, name string, content binary")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys new lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Rows of old whose parent has no new rows, and all new ones: a parent's rows are replaced together, however many there are."""
    return new.unionByName(old.join(new.select(parent).distinct(), parent, "left_anti"))


def delete_cascade(children: DataFrame, gone: DataFrame, parent: str) -> DataFrame:
    """children whose parent is not among those gone."""
    return children.join(gone.select(parent), parent, "left_anti")


def sql(spark: SparkSession, text: str, **values: object) -> DataFrame:
    """Parameterised SQL; values fill :name markers and are never pasted into the text."""
    return spark.sql(text, args=values)


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table of a relational database (its driver on the class path), read in ranges of a numeric key side by side."""
    parts = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize="10000", **parts, **options).load()


def write_report(df: DataFrame, path: str) -> None:
    """A report as one JSON file; for aggregates of a few rows. Spark's commit makes the replacement atomic for readers of the folder."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a markdown table, at most so many rows; nulls are blank."""
    rows = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in df.limit(most).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def write_log(df: DataFrame, path: str) -> None:
    """One JSON object a line, full identifiers redacted first."""
    df.select(redact_id(F.to_json(F.struct("*"))).alias("value")).write.text(path)
