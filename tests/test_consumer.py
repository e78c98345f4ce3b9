"""The consumer of both topics: every output equals its batch query, versions are whole."""

import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from conftest import SF
from coldwatch.operators.fleet import latest_per_truck, wire_messages
from coldwatch.operators.history import alert_history
from coldwatch.plans import catalog as catalog_module
from coldwatch.plans.catalog import _both_topics, _shown, catalog
from coldwatch.schemas import PRIMARY_ALERT_FIELDS
from coldwatch.sources.wire import alerts_from_wire, decode, decode_errors
from coldwatch.streaming import consumer
from coldwatch.streaming.versions import VersionedTables, newest_by

SCHEMA = "topic string, event_id bigint, value string"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def flat(df):
    return df.withColumn("additional_alerts", F.array_join("additional_alerts", ","))


@pytest.fixture
def files(spark, tmp_path):
    messages = _both_topics(spark, SF).persist()
    for n in range(6):
        part = messages.where(F.pmod(F.xxhash64("topic", "event_id"), F.lit(6)) == n)
        part.coalesce(1).write.parquet(f"{tmp_path}/{'now' if n < 3 else 'later'}/part={n}")
    yield str(tmp_path)
    messages.unpersist()


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("snapshot_every", [2, 100])
def test_all_outputs_equal_batch_after_a_restart(spark, files, snapshot_every):
    folder, rows_read = tempfile.mkdtemp(prefix="coldwatch-test-"), 0
    for which in ("now", "*"):
        # The second run asks for something else; the tables keep what they were begun with.
        query = consumer.start_consumer(
            stream(spark, f"{files}/{which}/part=*"), folder, snapshot_every=snapshot_every
        )
        query.awaitTermination()
        rows_read += sum(p.numInputRows for p in query.recentProgress)
        snapshot_every += 1
    messages = _both_topics(spark, SF)
    assert rows_read == messages.count()  # one scan and one decode for all outputs
    decoded = decode(messages)
    assert same(
        _shown(spark, SF, consumer.read_latest(spark, folder)),
        _shown(spark, SF, latest_per_truck(wire_messages(decoded))),
    )
    assert same(consumer.read_metrics(spark, folder), catalog()["metrics_table"](spark, SF))
    alerts = alerts_from_wire(decoded.where(F.col("topic") == "alerts"))
    newest = alert_history(alerts.select("event_id", *PRIMARY_ALERT_FIELDS))
    assert same(flat(consumer.read_history(spark, folder)), flat(newest))
    letters = decode_errors(decoded).drop("document")
    assert same(consumer.read_dead_letters(spark, folder), letters)
    feed = consumer.read_feed(spark, folder)
    assert feed.count() == messages.count() - letters.count()
    assert same(flat(feed), flat(consumer._feed(decoded)))


def test_files_and_batches_of_the_queries_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(catalog_module, "CONSUMER_FILE", 60, raising=False)
    monkeypatch.setattr(catalog_module, "CONSUMER_BATCH", 400, raising=False)
    folder = catalog_module._consumed(spark, SF)
    messages = spark.read.parquet(f"{folder}/messages")
    sizes = [r["count"] for r in messages.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 60
    feed, letters = consumer.read_feed(spark, folder), consumer.read_dead_letters(spark, folder)
    assert messages.count() == sum(sizes) == feed.count() + letters.count()
    assert same(messages, _both_topics(spark, SF))
    logged = spark.read.parquet(f"{folder}/{consumer.FEED}").groupBy("batch_id").count().collect()
    assert len(logged) == 5 and max(r["count"] for r in logged) <= 400


def test_a_retried_batch_counts_once(spark):
    folder = tempfile.mkdtemp(prefix="coldwatch-test-")
    rows = [
        [("telemetry", 1, '{"truck_id": "T", "speed_kmh": 1}'), ("telemetry", 2, "no json")],
        [("alerts", 1, '{"truck_id": "T", "alert_type": "X", "severity": "LOW"}')],
        [("alerts", 2, '{"truck_id": "U"}'), ("telemetry", 3, None)],
    ]
    decoded = [decode(spark.createDataFrame(r, SCHEMA)) for r in rows]
    for number in (0, 0, 1, 1, 2, 2):
        # A new object each time, as after a failure; two batches to a snapshot.
        consumer.consumer_tables(folder).commit(number, consumer.parts_of(decoded[number]), 2)
    counts = {(r.metric, r.label_value): r.value for r in consumer.read_metrics(spark, folder).collect()}
    assert counts["logistics_messages_total", None] == 3
    assert counts["logistics_errors_total", None] == 2
    assert counts["logistics_alerts_by_type", "X"] == 1
    assert {r.truck_id: r.alerts_seen for r in consumer.read_latest(spark, folder).collect()} == {
        "T": 1, "U": 1,
    }
    assert consumer.read_dead_letters(spark, folder).count() == 2
    assert consumer.read_feed(spark, folder).count() == 3
    assert consumer.read_history(spark, folder).count() == 2


def test_nothing_finished_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no finished batch"):
        consumer.read_metrics(spark, str(tmp_path))


def test_an_unfinished_batch_is_not_seen(spark, tmp_path, monkeypatch):
    tables = consumer.consumer_tables(str(tmp_path))
    one = decode(spark.createDataFrame([("telemetry", 1, '{"truck_id": "T"}')], SCHEMA))
    two = decode(spark.createDataFrame([("telemetry", 2, '{"truck_id": "U"}')], SCHEMA))
    tables.commit(0, consumer.parts_of(one))

    def fail(*_):
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(VersionedTables, "_publish", fail)
    with pytest.raises(RuntimeError):
        tables.commit(1, consumer.parts_of(two))
    folder = str(tmp_path)
    assert [r.truck_id for r in consumer.read_latest(spark, folder).collect()] == ["T"]
    assert consumer.read_feed(spark, folder).count() == 1


def test_readers_race_a_writer_over_200_batches(spark, tmp_path):
    """Whenever a reader looks, it finds a version, and all tables as of the same batch."""
    batches, source, folder = 200, str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(n, f"T{n % 7}", n) for n in range(batches)]
    spark.createDataFrame(rows, "batch int, truck_id string, ts bigint").repartition(
        1, "batch"
    ).write.partitionBy("batch").parquet(source)

    def add(parts):
        return parts.groupBy().agg(F.sum("n").alias("n"), F.max("batch_id").alias("batch_id"))

    def tables():
        return VersionedTables(folder, {"total": add, "fleet": newest_by("truck_id"), "last": None})

    writing, failures, seen, done = tables(), [], set(), threading.Event()

    def write(batch, number):
        batch = batch.coalesce(1)
        total, last = batch.agg(F.count("*").alias("n")), batch.select("ts")
        writing.commit(number, {"total": total, "fleet": batch, "last": last}, 10)

    def read():
        reading = tables()
        while not done.is_set():
            try:
                version = reading.version(spark)
                n = version.number + 1
                assert reading.read(spark, "total", version).first()["n"] == n
                assert reading.read(spark, "last", version).first()["ts"] == version.number
                fleet = reading.read(spark, "fleet", version).agg(F.max("ts"), F.count("*"))
                assert tuple(fleet.first()) == (version.number, min(n, 7))
                seen.add(n)
            except ValueError:  # before the first batch
                continue
            except Exception as failure:  # kept for the test to show
                failures.append(failure)
                return
            done.wait(0.2)

    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    reader = threading.Thread(target=read)
    try:
        arriving = spark.readStream.schema("truck_id string, ts bigint")
        arriving = arriving.option("maxFilesPerTrigger", 1).parquet(f"{source}/batch=*")
        query = arriving.writeStream.foreachBatch(write).trigger(availableNow=True).start()
        reader.start()
        query.awaitTermination()
    finally:
        done.set()
        reader.join()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert not failures, failures[0]
    assert tables().version(spark).number == batches - 1
    assert len(seen) > 10
