"""File readers and writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators.ranking import position_block
from riskloom.sources import feeds, files, labelled, sinks


def test_message_table(spark, tmp_path):
    (tmp_path / "m.csv").write_text('message,other\n" first ",1\n,2\n   ,3\n"a, ""quoted"" one",4\nbad,row,with,more\nlast\n', encoding="utf-8")
    rows = files.numbered_messages(files.message_table(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r["row"], r["message"]) for r in rows] == [(2, "first"), (3, 'a, "quoted" one'), (4, "last")]


def test_message_table_over_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text\none\ntwo,surplus\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('\nbody,"who, when",n\nthree,x,1\nfour\nfive,x,1,surplus\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    rows = files.message_table(spark, str(tmp_path)).collect()
    assert sorted(r["message"] for r in rows) == ["four", "one", "three"]


def test_message_table_over_many_splits(spark, tmp_path):
    lines = [f"message {i}" for i in range(3000)]
    (tmp_path / "m.csv").write_text("text\n" + "\n".join(lines), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        table = files.message_table(spark, str(tmp_path))
        assert table.rdd.getNumPartitions() > 5
        rows = files.numbered_messages(table).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["message"] for r in rows] == lines and [r["pos"] for r in rows] == list(range(3000))


def test_csv_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,a,b\n1,x,y\n2,,z\n3,w,\n", encoding="utf-8")
    lines = files.csv_lines(spark, str(tmp_path))
    assert files.joined_lines(lines).first()["text"] == "x y\nz\nw"
    assert files.joined_lines(files.csv_lines(spark, str(tmp_path), limit=2)).first()["text"] == "x y\nz"


def test_json_text(spark):
    deep = "bottom"
    for _ in range(12):
        deep = [deep]
    docs = [json.dumps({"z": "one", "a": ["two", 3, None, {"k": "three"}], "n": True}), json.dumps({"x": deep, "y": "kept"}), "not json", json.dumps("alone")]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [r[0] for r in df.orderBy("i").select(files.json_text(F.col("d"), max_depth=10)).collect()]
    assert got == ["one\ntwo\nthree", "kept", None, "alone"]
    assert df.where("i = 1").select(files.json_text(F.col("d"))).first()[0] == "bottom\nkept"


def test_text_file_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("This is a test document.\nLine two ".encode() + b"\xff end")
    assert files.text_files(spark, str(tmp_path)).first()["text"] == "This is a test document.\nLine two � end"


def test_file_listing(spark, tmp_path):
    for name in ("a.TXT", "b.json", "c.exe", "d.xlsx"):
        (tmp_path / name).write_text("x")
    rows = {r["extension"]: (r["reader"], r["problem"]) for r in files.file_listing(spark, str(tmp_path)).collect()}
    assert rows == {"txt": ("text", None), "json": ("json", None), "exe": (None, "unsupported file type .exe"), "xlsx": ("external", None)}


def test_labelled_schemas(spark, tmp_path):
    old = tmp_path / "legacy.csv"
    old.write_text("text,category\nhello,Extremist\nbye,Other\n ,Extremist\n")
    rows = labelled.read_labelled(spark, str(tmp_path / "absent.csv"), str(old)).collect()
    assert [(r["text"], r["label"]) for r in rows] == [("hello", "EXTREMIST"), ("bye", "NON_EXTREMIST")]
    new = spark.createDataFrame([("m", "EXTREMIST"), (None, "EXTREMIST")], "Original_Message string, Extremism_Label string")
    assert [tuple(r) for r in labelled.normalize_labelled(new).collect()] == [("m", "EXTREMIST")]
    with pytest.raises(FileNotFoundError):
        labelled.read_labelled(spark, str(tmp_path / "absent.csv"))


FEED = """<?xml version="1.0"?><rss><channel><title>Feed</title>
<item><title>One</title><description>Sum &amp; more</description><link>http://h/1</link><pubDate>Mon</pubDate><guid>g1</guid><author>me</author></item>
<item><title>Two</title><link>http://h/2</link><updated>Tue</updated></item>
<item><description>No title</description></item></channel></rss>"""


def test_feed(spark, tmp_path):
    import hashlib

    (tmp_path / "f.xml").write_text(FEED, encoding="utf-8")
    entries = feeds.read_feed(spark, str(tmp_path))
    rows = feeds.feed_items(entries, "rss", F.col("block")).orderBy("entry_no").collect()
    digest = lambda *p: "rss:" + hashlib.sha1("|".join(p).encode()).hexdigest()[:24]
    assert [r["text"] for r in rows] == ["One\n\nSum & more", "Two", "No title"]
    assert rows[0]["external_id"] == digest("g1", "One", "Mon") and rows[0]["author"] == "me"
    assert rows[1]["external_id"] == digest("http://h/2", "Two", "Tue") and rows[1]["published"] == "Tue"
    assert rows[2]["url"] == rows[2]["feed"] and rows[2]["external_id"] == digest(rows[2]["feed"], "", "")
    assert feeds.feed_items(entries, "rss", F.col("block"), limit=2).count() == 2


def test_a_feed_keeps_every_entry(spark):
    entry = F.struct(F.col("id").cast("string").alias("title"), F.lit("body").alias("description"), *[F.lit(None).cast("string").alias(c) for c in
                     ("summary", "link", "pubDate", "updated", "guid", "id", "author")])
    entries = spark.range(20_000).select(F.lit("f").alias("feed"), F.col("id").alias("seq"), entry.alias("entry"))
    for kind in ("rss", "telegram"):
        assert feeds.feed_items(entries, kind, position_block("seq")).count() == 20_000


def test_report_quotes_every_cell(spark, tmp_path):
    row = [(1, "text", "completed", 0.5, "medium", {"m": 0.5}, None, "en", ['say "hi"', "b"], dt.datetime(2024, 1, 2, 3, 4, 5)), (2, "url", "failed", None, None, None, None, None, None, None)]
    schema = "id long, analysis_type string, status string, threat_score double, threat_level string, model_scores map<string,double>, sentiment string, language string, keywords array<string>, created_at timestamp_ntz"
    path = str(tmp_path / "report")
    sinks.write_report(spark.createDataFrame(row, schema).coalesce(1), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines[0] == ",".join(f'"{c}"' for c in sinks.REPORT_COLUMNS)
    assert lines[1] == '"1","text","completed","0.5000","medium","{""m"":0.5}","","en","say ""hi""; b","2024-01-02T03:04:05"'
    assert lines[2] == '"2","url","failed","","","","","","",""'


def test_batches_replace_themselves(spark, tmp_path):
    store = str(tmp_path / "store")
    assert sinks.read_store(spark, store, "a long, batch_id int").count() == 0
    for _ in range(2):
        sinks.write_batch(spark.range(3).toDF("a"), store, 0)
    sinks.write_batch(spark.range(5).toDF("a"), store, 1)
    assert sinks.read_store(spark, store, "a long, batch_id int").count() == 8
    assert sinks.read_store(spark, store, "a long, batch_id int", before=1).count() == 3


def test_training_summary(spark, tmp_path):
    path = str(tmp_path / "summary")
    sinks.write_training_summary(spark, {"best_model": "x", "cv_results": {"x": {"f1": 0.5}}}, path)
    text = spark.read.text(path, wholetext=True).first()["value"]
    assert json.loads(text)["cv_results"]["x"]["f1"] == 0.5
