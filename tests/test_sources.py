"""Sources and sinks over small files."""

import json
import zipfile

from casemill.sources import storage


def test_packets_and_their_fields(spark, tmp_path):
    for name, status in (("p1", "READY"), ("p2", "OFFICER_ATTENTION")):
        (tmp_path / name).mkdir()
        truth = {"packet_id": name, "expected_status": status, "documents": {"form.jpg": {"type": "form", "fields": {"name": "Asha Rai", "dob": None}}}, "name_checks": [], "expected_flags": [{"code": "X", "severity": "warn", "action": "officer"}]}
        (tmp_path / name / "truth.json").write_text(json.dumps(truth, indent=1))
    (tmp_path / "p3").mkdir()
    (tmp_path / "p3" / "truth.json").write_text("{broken")
    df = storage.packets(spark, str(tmp_path))
    assert sorted((r.folder, r.expected_status) for r in df.collect()) == [("p1", "READY"), ("p2", "OFFICER_ATTENTION"), ("p3", None)]
    fields = storage.packet_fields(df).where("packet_id = 'p1'").collect()
    assert sorted((r.field, r.value) for r in fields) == [("dob", None), ("name", "Asha Rai")]


def test_pairs_csv_is_all_or_nothing(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_bytes('﻿name_a,name_b,community,expected_same,note\r\n"Rai, ""A""",B,Naga,Yes,\r\n\r\nC,D,Meitei,ambiguous,x\r\n'.encode())
    pairs, errors = storage.pairs_csv(spark, str(good))
    assert errors.count() == 0
    assert sorted((r.name_a, r.same_person) for r in pairs.collect()) == [("C", None), ('Rai, "A"', True)]
    bad = tmp_path / "bad.csv"
    bad.write_text("name_a,name_b,expected_same\nA,B,yes\n,B,no\nC,D,perhaps\n")
    pairs, errors = storage.pairs_csv(spark, str(bad))
    assert pairs.count() == 0 and errors.count() == 2


def test_images_archives_and_kinds(spark, tmp_path):
    heads = {"a.jpg": b"\xff\xd8\xff\xe0" + b"x" * 20, "b.png": b"\x89PNG\r\n\x1a\n" + b"x" * 20, "c.webp": b"RIFF1234WEBPxxxx", "d.heic": b"\0\0\0\x18ftypheic", "e.txt": b"hello"}
    for name, body in heads.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in storage.images(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": "jpeg", "b.png": "png", "c.webp": "webp", "d.heic": "heic"}
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "x.zip", "w") as z:
        z.writestr("one.jpg", b"1")
        z.writestr("__MACOSX/one.jpg", b"2")
        z.writestr(".hidden.png", b"3")
        z.writestr("notes.txt", b"4")
    assert [(r.name, bytes(r.content)) for r in storage.zipped_images(spark, str(tmp_path / "zips")).collect()] == [("one.jpg", b"1")]


def test_upsert_log_reports_and_sql(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert sorted(tuple(r) for r in storage.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    storage.write_log(spark.createDataFrame([("info", "id 2345 6789 0123 seen")], "level string, msg string"), str(tmp_path / "log"))
    assert [json.loads(r.value)["msg"] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["id XXXX XXXX 0123 seen"]
    assert storage.replace_children(old, new, "k").count() == 3
    storage.write_report(new, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    assert storage.markdown(new.orderBy("k")) == "| k | v |\n| --- | --- |\n| 2 | B |\n| 3 | C |"
    old.createOrReplaceTempView("olds")
    assert [r.v for r in storage.sql(spark, "SELECT v FROM olds WHERE k = :k", k=2).collect()] == ["b"]
