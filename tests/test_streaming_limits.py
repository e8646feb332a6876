import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators.history import expire_images, history_page, purge_count
from corpusgauge.operators.limits import Window, sliding_rate_limit
from corpusgauge.streaming.limits import limit_stream
from corpusgauge.streaming.progress import bucket_versions, fold_batch, read_ledger, stream_progress

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def requests(spark, times):
    rows = [(i, k, START + dt.timedelta(seconds=t)) for i, (k, t) in enumerate(times)]
    return spark.createDataFrame(rows, "event_id bigint, key string, ts timestamp")


def by_hand(times, limit, window):
    hits, out = {}, {}
    for i, (k, t) in sorted(enumerate(times), key=lambda e: (e[1][1], e[0])):
        live = [h for h in hits.get(k, []) if t - h < window]
        if len(live) < limit:
            live.append(t)
            out[i] = (True, None)
        else:
            out[i] = (False, max(1, int(window - (t - live[0])) + 1))
        hits[k] = live
    return out


def decided(df):
    return {r["event_id"]: (r["accepted"], r["retry_after"]) for r in df.collect()}


def test_limit_case(spark):
    times = [("a", 0), ("a", 1), ("a", 2), ("a", 10.5), ("b", 2)]
    got = decided(sliding_rate_limit(requests(spark, times), 2, 10))
    assert got == {0: (True, None), 1: (True, None), 2: (False, 9), 3: (True, None), 4: (True, None)}


@pytest.mark.parametrize("limit", [1, 3])
def test_limit_with_a_hot_key(spark, limit):
    rng = np.random.default_rng(limit)
    times = [("hot" if rng.random() < 0.5 else f"k{rng.integers(30)}", float(t)) for t in rng.integers(0, 4000, 1500)]
    got = decided(sliding_rate_limit(requests(spark, times).repartition(7), limit, 20))
    assert got == by_hand(times, limit, 20)


def test_limit_of_a_null_key_and_of_the_edge_of_a_slot(spark):
    """Requests without a key share one; a pause of just a window ends a session, a shorter one across slots doesn't."""
    times = [(None, 0), (None, 5), (None, 9), (None, 19.5), ("a", 9.5), ("a", 10.5), ("a", 19.4), ("a", 19.5), ("a", 400), ("", 1)]
    assert decided(sliding_rate_limit(requests(spark, times), 1, 10)) == by_hand(times, 1, 10)


def test_limit_needs_three_exchanges(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sliding_rate_limit(requests(spark, [("a", 0), ("b", 1)]), 2, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    times = [(f"k{rng.integers(5)}", float(t)) for t in np.sort(rng.integers(0, 600, 300))]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):  # three files, read one per micro-batch in time order
        requests(spark, times).filter(F.col("event_id").between(part * 100, part * 100 + 99)).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    writer = limit_stream(stream, 2, 30, evict=False).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    assert decided(spark.read.parquet(out)) == by_hand(times, 2, 30)


def test_progress_stream_keeps_the_last_record(spark, tmp_path):
    schema = "seq bigint, dataset string, rel_path string, status string"
    src, ledger, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))
    parts = [[(1, "d", "a", "ok"), (2, "d", "b", "ok")], [(4, "d", "a", "no_face")], [(3, "d", "a", "read_error"), (5, "d", "c", "ok")]]

    def run():
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        stream_progress(log, ledger, state).awaitTermination()

    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        if i:
            run()
    got = {r["rel_path"]: (r["seq"], r["status"]) for r in read_ledger(spark, ledger).collect()}
    assert got == {"a": (4, "no_face"), "b": (2, "ok"), "c": (5, "ok")}


def test_progress_rewrites_only_touched_buckets(spark, tmp_path):
    """Files of an untouched bucket stay, replaced versions go, and a batch that runs again changes nothing."""
    schema = "seq bigint, dataset string, rel_path string, status string"
    path, seq = str(tmp_path / "ledger"), iter(range(10_000))
    want = {}

    def batch(names, number):
        rows = [(next(seq), "d", name, f"s{number}") for name in names]
        want.update({r[2]: (r[0], r[3]) for r in rows})
        return spark.createDataFrame(rows, schema)

    def files():
        return {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in (tmp_path / "ledger").rglob("part-*")}

    def got():
        return {r["rel_path"]: (r["seq"], r["status"]) for r in read_ledger(spark, path).collect()}

    first = batch([f"f{i}" for i in range(200)], 0)
    fold_batch(first, 0, path, buckets=16)
    before, versions = files(), bucket_versions(spark, path)
    assert len(versions) == 16 and got() == want
    for n in range(1, 5):
        again = batch(["f7", "f8"], n)
        fold_batch(again, n, path, buckets=16)
        fold_batch(again, n, path, buckets=16)  # as after a failure between writing and committing
        assert got() == want
    versions = bucket_versions(spark, path)
    touched = {b for b, vs in versions.items() if vs[-1] > 0}
    assert 1 <= len(touched) <= 2 and all(len(versions[b]) <= 3 for b in touched)
    left = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert len(left) >= 14 and all(files()[f] == before[f] for f in left)
    assert not any("v=0/bucket=%d/" % b in f for f in files() for b in touched)
    assert read_ledger(spark, path, before=1).count() <= 200
    fold_batch(first.limit(0), 5, path, buckets=16)
    assert got() == want
    with pytest.raises(ValueError, match="buckets"):
        fold_batch(first, 6, path, buckets=8)
    assert read_ledger(spark, str(tmp_path / "nothing")) is None


def test_history(spark):
    rows = [(i, i % 2, START + dt.timedelta(days=i), f"{i}.jpg" if i != 3 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, created_at timestamp, image_path string")
    page = history_page(df, 1, 2, 1).collect()
    assert [(r["id"], r["total"]) for r in page] == [(7, 5), (5, 5)]
    for bad in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            history_page(df, 1, *bad)
    expired = expire_images(df, "2024-01-05")
    assert expired.count() == 10 and purge_count(expired).first()["purged"] == 3
    assert expired.filter("image_path is null").count() == 4


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_jumping_over_rejections_changes_nothing(limit):
    rng = np.random.default_rng(limit)
    times = np.sort(rng.integers(0, 60_000_000, 3000)).astype(np.int64)
    one, many = Window(limit, 1_500_000), Window(limit, 1_500_000)
    got = np.concatenate([many.offer_many(part) for part in np.array_split(times, 7)])
    assert list(got) == [int(one.offer_many(times[i : i + 1])[0]) for i in range(len(times))] and list(one.hits) == list(many.hits)


def test_late_requests_are_decided(spark, tmp_path):
    """Files out of time order, one per micro-batch: one decision for each request."""
    from pyspark.sql import functions as F

    from corpusgauge.streaming.limits import limit_stream

    rows = [(1, "a", 7200), (2, "a", 7201), (3, "a", 60), (4, "b", 0), (5, "a", 7500)]
    for i, (event, key, second) in enumerate(rows):
        one = spark.createDataFrame([(event, key, second)], "event_id long, key string, second long")
        one.select("event_id", "key", F.timestamp_seconds("second").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    schema = "event_id long, key string, ts timestamp"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = limit_stream(stream, 2, 100, evict=False).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
    out.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1] and got[2] and not got[3] and got[4] and got[5]


def test_state_of_quiet_keys_goes(spark, tmp_path):
    """By the clock: states leave after a quiet window, late requests are decided all the same, and a key that comes back starts anew."""
    schema = "event_id long, key string, ts timestamp"

    def send(number, rows):
        table = spark.createDataFrame([(e, k, START + dt.timedelta(seconds=t)) for e, k, t in rows], schema)
        table.coalesce(1).write.parquet(f"{tmp_path}/in/{number}")

    def wait_for(what):
        end = time.time() + 120
        while not what():
            assert query.exception() is None and time.time() < end
            time.sleep(0.3)

    def decided_so_far():
        return {r["event_id"]: r["accepted"] for r in spark.read.schema("event_id bigint, accepted boolean").parquet(f"{tmp_path}/out").collect()}

    def states():
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    send(0, [(1, "a", 0), (2, "a", 1), (3, "b", 2), (4, "a", 2)])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    writer = limit_stream(stream, 2, 3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
    query = writer.trigger(processingTime="200 milliseconds").start(f"{tmp_path}/out")
    try:
        wait_for(lambda: query.lastProgress is not None and len(decided_so_far()) == 4)
        assert decided_so_far() == {1: True, 2: True, 3: True, 4: False}
        wait_for(lambda: states() == 0)
        send(1, [(5, "a", 1), (6, "b", 0), (7, "c", 500), (8, "a", 2), (9, "a", 2)])
        wait_for(lambda: len(decided_so_far()) == 9)
        assert [decided_so_far()[e] for e in (5, 6, 7, 8, 9)] == [True, True, True, True, False]
        wait_for(lambda: states() == 0)
    finally:
        query.stop()


def test_one_key_of_many_requests_leaves_in_parts(spark, tmp_path):
    """More requests of a key in one micro-batch than leave together, in any order."""
    rng = np.random.default_rng(3)
    times = [("k", float(t)) for t in rng.integers(0, 10**7, 45_000)]
    requests(spark, times).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id bigint, key string, ts timestamp").parquet(f"{tmp_path}/in")
    out = limit_stream(stream, 2, 500, evict=False).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
    out.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert decided(spark.read.parquet(f"{tmp_path}/out")) == by_hand(times, 2, 500)


@pytest.mark.parametrize("files", [0, 3])
def test_streamed_table_of_one_file_or_many(spark, tmp_path, files):
    """A table is a file or a folder of files; the stream queries read either whole, and no other table."""
    from pathlib import Path

    from corpusgauge.plans.queries import QUERIES

    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 10) AS html")
    if files:
        pages.repartition(files).write.parquet(f"{tmp_path}/pages.parquet")
    else:
        pages.coalesce(1).write.parquet(f"{tmp_path}/other")
        next(Path(tmp_path, "other").glob("*.parquet")).rename(f"{tmp_path}/pages.parquet")
    pages.write.parquet(f"{tmp_path}/more_pages.parquet")
    got = [r["page_id"] for r in QUERIES["stream_verdicts"](spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(40))
