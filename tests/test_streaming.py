"""Streaming jobs give the batch result, and repeating a delivery or a batch changes nothing."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from riskloom.plans import stream_queries as sq
from riskloom.functions.scores import level_of
from riskloom.operators import metrics
from riskloom.streaming import collector as c
from riskloom.streaming import live
from riskloom.streaming.tiers import TieredStore

NOW = dt.datetime(2024, 3, 10, 12, 0, 0)
ITEM = "source_id string, source_type string, external_id string, title string, text string, threat_score double, collected_at timestamp_ntz"


@pytest.fixture()
def sources(spark):
    rows = [(f"s{i}", f"Source {i}", f"http://s{i}", "rss", i, True, 300) for i in range(3)]
    return spark.createDataFrame(rows, "source_id string, name string, url string, source_type string, owner_id long, is_active boolean, check_interval int")


def items(spark, ids, score=lambda i: (i % 10) / 10):
    return spark.createDataFrame([(f"s{i % 3}", "rss", f"e{i}", f"t{i}", f"text {i}", score(i), NOW - dt.timedelta(hours=i)) for i in ids], ITEM)


def rescored(df):
    return df.withColumn("threat_level", level_of(F.col("threat_score")))


def drain(spark, job, base):
    stream = c.landed(spark, f"{base}/landing", spark.createDataFrame([], ITEM).schema, files_per_batch=1)
    c.run_to_end(job.run(stream, f"{base}/checkpoint"))


def test_restart_and_repeated_delivery(spark, sources, tmp_path):
    base = str(tmp_path)
    first = items(spark, range(20)).coalesce(1)
    first.write.mode("append").parquet(f"{base}/landing")
    job = c.Collector(spark, f"{base}/stores", sources, rescored)
    drain(spark, job, base)
    first.write.mode("append").parquet(f"{base}/landing")
    items(spark, range(15, 25)).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    drain(spark, c.Collector(spark, f"{base}/stores", sources, rescored), base)
    stored = spark.read.parquet(job.store("items"))
    assert sorted(r["external_id"] for r in stored.collect()) == sorted(f"e{i}" for i in range(25))
    alerts = spark.read.parquet(job.store("alerts"))
    assert alerts.count() == sum(1 for i in range(25) if (i % 10) / 10 >= 0.6)
    events = [(r["owner_id"], json.loads(r["event"])["alert"]) for r in alerts.collect()]
    assert all(f"Source {owner}" == alert["details"]["source_name"] for owner, alert in events)
    polls = spark.read.parquet(job.store("polls"))
    totals = metrics.scan_summary(polls).first()
    assert (totals["fetched"], totals["new"], totals["failed"]) == (50, 25, 0)


def test_a_repeated_batch_replaces_its_output(spark, sources, tmp_path):
    job = c.Collector(spark, str(tmp_path / "stores"), sources, rescored)
    job.process(items(spark, range(10)), 0)
    job.process(items(spark, range(5, 12)), 1)
    job.process(items(spark, range(5, 12)), 1)  # as after a failure between the stores and the checkpoint
    stored = spark.read.parquet(job.store("items"))
    assert sorted(r["external_id"] for r in stored.collect()) == sorted(f"e{i}" for i in range(12))


def test_only_active_sources_are_polled(spark, sources, tmp_path):
    some = sources.withColumn("is_active", F.when(F.col("source_id") == "s1", False).when(F.col("source_id") == "s0", True))
    job = c.Collector(spark, str(tmp_path / "stores"), some, rescored)
    assert job.checked_sources().where("last_checked IS NOT NULL").count() == 0
    job.process(items(spark, range(12)), 0)
    assert {r["source_id"] for r in spark.read.parquet(job.store("items")).collect()} == {"s0", "s2"}
    assert {r["owner_id"] for r in spark.read.parquet(job.store("alerts")).collect()} == {0, 2}
    checked = {r["source_id"]: r["last_checked"] is not None for r in job.checked_sources().collect()}
    assert checked == {"s0": True, "s1": False, "s2": True}
    polled = metrics.poll_results(items(spark, range(12)), items(spark, []), some)
    assert metrics.scan_summary(polled).first()["sources_polled"] == 2


def test_unreadable_rows_are_set_aside(spark, sources, tmp_path):
    landing = tmp_path / "landing"
    for name, lines in {"s0": ['{"source_type":"rss","external_id":"a","title":"t","text":"x","threat_score":0.9,"collected_at":"2024-03-10T01:00:00"}', "{broken"],
                        "s1": ['{"source_type":"rss","external_id":"b","title":"t","text":"y","threat_score":0.1,"collected_at":"2024-03-10T01:00:00"}']}.items():
        (landing / f"source_id={name}").mkdir(parents=True)
        (landing / f"source_id={name}" / "part.json").write_text("\n".join(lines))
    schema = spark.createDataFrame([], ITEM + ", _corrupt string").schema
    stream = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(str(landing))
    job = c.Collector(spark, str(tmp_path / "stores"), sources, rescored)
    c.run_to_end(job.run(stream, str(tmp_path / "checkpoint")))
    assert sorted(r["external_id"] for r in spark.read.parquet(job.store("items")).collect()) == ["a", "b"]
    assert [r["_corrupt"] for r in spark.read.parquet(job.store("quarantine")).collect()] == ["{broken"]
    polls = {r["source_id"]: (r["fetched"], r["new"], r["error"]) for r in spark.read.parquet(job.store("polls")).collect()}
    assert polls == {"s0": (2, 1, "1 unreadable rows"), "s1": (1, 1, None)}
    assert metrics.scan_summary(spark.read.parquet(job.store("polls"))).first()["failed"] == 1


@pytest.mark.parametrize("bounded", [False, True])
def test_stateful_dedup(spark, tmp_path, bounded):
    base = str(tmp_path)
    spec = items(spark, list(range(10)) + [1, 2, 3]).withColumn("at", F.col("collected_at").cast("timestamp"))
    spec.union(items(spark, [50]).withColumn("text", F.lit("")).withColumn("at", F.lit(NOW).cast("timestamp"))).write.parquet(f"{base}/landing")
    stream = c.landed(spark, f"{base}/landing", spec.schema)
    out = c.deduplicated_within(stream, "at", "5 days") if bounded else c.deduplicated(stream)
    c.run_to_end(c.to_folder(out, f"{base}/out", f"{base}/checkpoint"))
    assert sorted(r["external_id"] for r in spark.read.parquet(f"{base}/out").collect()) == sorted(f"e{i}" for i in range(10))


def test_alert_routes_by_owner(spark, sources, tmp_path):
    from riskloom.operators.monitor import alert_event, raise_alerts

    base = str(tmp_path)
    rescored(items(spark, range(30))).write.parquet(f"{base}/landing")
    stream = c.landed(spark, f"{base}/landing", rescored(items(spark, [])).schema)
    c.run_to_end(c.to_folder(alert_event(raise_alerts(stream, sources)), f"{base}/out", f"{base}/checkpoint", by=["owner_id"]))
    mine = spark.read.parquet(f"{base}/out/owner_id=1")
    assert mine.count() == sum(1 for i in range(30) if i % 3 == 1 and (i % 10) / 10 >= 0.6)


def test_daily_windows_match_the_batch_trend(spark, sources, tmp_path):
    base = str(tmp_path)
    data = items(spark, range(60)).select("source_id", "source_type", "collected_at", "threat_score")
    data.repartition(3).write.parquet(f"{base}/landing")
    stream = c.landed(spark, f"{base}/landing", data.schema, files_per_batch=1)
    c.run_to_end(c.to_snapshot(live.daily_trend(stream), f"{base}/out", f"{base}/checkpoint"))
    got = {(r["date"], r["source_id"]): (r["item_count"], r["avg_threat_score"]) for r in c.newest_snapshot(spark, f"{base}/out").collect()}
    batch = metrics.daily_trend(data, sources, NOW, days=180)
    assert got == {(r["date"], r["source_id"]): (r["item_count"], r["avg_threat_score"]) for r in batch.collect()}


def test_closed_days_are_emitted_once_in_append_mode(spark, tmp_path):
    base = str(tmp_path)
    data = items(spark, range(72)).select("source_id", "collected_at", "threat_score")
    data.write.parquet(f"{base}/landing")
    stream = c.landed(spark, f"{base}/landing", data.schema)
    c.run_to_end(c.to_folder(live.daily_trend(stream, delay="1 hour"), f"{base}/out", f"{base}/checkpoint"))
    days = spark.read.parquet(f"{base}/out").groupBy("date").agg(F.sum("item_count").alias("n")).collect()
    assert {r["date"]: r["n"] for r in days} == {"2024-03-08": 24, "2024-03-09": 24}  # the last day is still open


def test_rolling_trend_matches_the_batch_rule(spark, tmp_path):
    base = str(tmp_path)
    rows = [(i, i % 4, "text", "failed" if i % 7 == 0 else "completed", (i * 37 % 100) / 100, "low", NOW - dt.timedelta(minutes=31 * i)) for i in range(150)]
    data = spark.createDataFrame(rows, "analysis_id long, user_id long, analysis_type string, status string, threat_score double, threat_level string, created_at timestamp_ntz")
    data.repartition(3).write.parquet(f"{base}/landing")
    stream = c.landed(spark, f"{base}/landing", data.schema, files_per_batch=1)
    c.run_to_end(c.to_snapshot(live.hourly_parts(stream, NOW), f"{base}/out", f"{base}/checkpoint"))
    got = {r["user_id"]: r["threat_trend_24h"] for r in live.rolling_trend(c.newest_snapshot(spark, f"{base}/out"), NOW).collect()}
    assert got == {u: metrics.analysis_metrics(data, u, NOW).first()["threat_trend_24h"] for u in range(4)}


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    from riskloom import session

    class Conf:
        def get(self, *_):
            return None

        def set(self, *_):
            raise AssertionError("must not choose a folder")

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster(), "x")
    monkeypatch.setattr(Context, "master", "local[2]")
    first, second = session.shared_dir(Cluster(), "x"), session.shared_dir(Cluster(), "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_late_days_leave_the_state(spark, tmp_path):
    base = str(tmp_path)

    def land(days):
        rows = [(f"s{i}", NOW + dt.timedelta(days=d), 0.5) for d in days for i in range(4)]
        spark.createDataFrame(rows, "source_id string, collected_at timestamp_ntz, threat_score double").coalesce(1).write.mode("append").parquet(f"{base}/landing")

    for days in [range(10), [10], [30], [2], [31]]:  # day 2 comes back when it is long closed
        land(days)
    schema = spark.createDataFrame([], "source_id string, collected_at timestamp_ntz, threat_score double").schema
    stream = live.daily_trend(c.landed(spark, f"{base}/landing", schema, files_per_batch=1), delay="2 days")
    store = TieredStore(spark, f"{base}/store", ["date", "source_id"], stream.schema, fanout=2)
    query = store.run(stream, f"{base}/checkpoint")
    c.run_to_end(query)
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in states) >= 40 and states[-1]["numRowsTotal"] <= 12
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 4
    rows = store.read().collect()
    assert len(rows) == 13 * 4 and {r["item_count"] for r in rows} == {1}


def test_tiers_merge_and_repeat(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long, extra array<int>").schema
    store = TieredStore(spark, str(tmp_path / "store"), ["k"], schema, fanout=2)
    assert store.read().collect() == [] and store.segments() == []
    expected = {}
    for batch_id in range(7):
        rows = [(k, batch_id, [batch_id]) for k in (None, "always", f"only {batch_id}", f"third {batch_id % 3}")]
        expected |= {k: n for k, n, _ in rows}
        for _ in range(2 if batch_id in (3, 6) else 1):  # as after a failure before the checkpoint
            store.add(spark.createDataFrame(rows, schema), batch_id)
        assert {r["k"]: r["n"] for r in store.read().collect()} == expected
    assert store.segments() == [(2, 0), (1, 4), (0, 6)]
    store.add(spark.createDataFrame([], schema), 7)
    assert store.segments() == [(3, 0)] and {r["k"]: r["n"] for r in store.read().collect()} == expected
    with pytest.raises(ValueError):
        TieredStore(spark, str(tmp_path), ["k"], schema, fanout=1)


def test_landing_files_follow_the_table(spark, tmp_path):
    """Large tables keep their files instead of being dealt to four; small ones are dealt; all rows come as often as asked."""
    wide, small = spark.range(0, 1000, 1, 12), spark.range(0, 10, 1, 1)
    folder, files = sq.land(wide, f"{tmp_path}/wide")
    assert files == 12 and sorted(r["id"] for r in spark.read.parquet(folder).collect()) == list(range(1000))
    for table, rows in ((wide, 1000), (small, 10)):
        folder, files = sq.land(table, f"{tmp_path}/twice-{rows}", twice=True)
        assert files >= 8 or rows == 1000
        assert sorted(r["id"] for r in spark.read.parquet(folder).collect()) == sorted(2 * list(range(rows)))
