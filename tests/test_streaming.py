import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestone.jobs import catalogue
from lodestone.sources import shared
from lodestone.streaming import folder, status

from .conftest import same_rows

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
HOUR = 3_600_000
LOG = "task string, ts timestamp, status string"


@pytest.fixture
def own(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", status.PROVIDER)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def hours(ms):
    return None if ms is None else (ms.replace(tzinfo=timezone.utc) - START) / timedelta(hours=1)


def run(own, tmp_path, batches, timeout=5, late="4 hours"):
    """Closed runs, as (task, opened, started, status, completed, stale) in hours, of log rows (task, hour, status) in batches."""
    source = f"{tmp_path}/log-{random.random()}"
    os.makedirs(source)
    for i, rows in enumerate(batches):
        own.createDataFrame([(t, START + timedelta(hours=h), s) for t, h, s in rows], LOG).coalesce(1).write.mode("append").parquet(source)
        for name in os.listdir(source):
            if name.endswith(".parquet") and not name.startswith("b"):
                os.rename(f"{source}/{name}", f"{source}/b{i}.parquet")
                os.utime(f"{source}/b{i}.parquet", (1000 + i, 1000 + i))
    log = own.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    target, found = shared.place(own, "runs"), []
    closed = status.runs(log, timeout * HOUR, late)
    query = closed.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{target}/batch={n}")).option("checkpointLocation", shared.place(own, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    for r in own.read.schema(closed.schema).parquet(target).collect():
        found.append((r["task"], hours(r["opened_at"]), hours(r["started_at"]), r["status"], hours(r["completed_at"]), r["error"] is not None))
    return sorted(found, key=repr), query


def test_runs_start_once_and_close_once(own, tmp_path):
    rows = [("a", 0, "PENDING"), ("a", 1, "IN_PROGRESS"), ("a", 2, "IN_PROGRESS"), ("a", 3, "SUCCESS"), ("a", 3.5, "FAILED"), ("a", 4, "SUCCESS"), ("b", 1, "SUCCESS"), ("b", 2, "PENDING"), ("b", 3, "FAILED"), ("b", 4, "IN_PROGRESS"), ("b", 6, "SUCCESS"), ("end", 20, "PENDING")]
    found, _ = run(own, tmp_path, [rows])
    assert found == sorted([("a", 0, 1, "SUCCESS", 3, False), ("b", 2, None, "FAILED", 3, False), ("b", 4, 4, "SUCCESS", 6, False)], key=repr)


def test_late_and_repeated_rows_in_any_batches(own, tmp_path):
    rng = random.Random(4)
    rows = [(f"t{rng.randrange(4)}", h / 2, rng.choice(status.ORDER)) for h in range(60) for _ in range(2)]
    whole, _ = run(own, tmp_path, [rows + [("end", 100, "PENDING")]], 3)
    mixed = sorted(rows + rows[::3], key=lambda r: r[1] + rng.uniform(0, 3))  # late, but within the watermark, and repeated
    parts, _ = run(own, tmp_path, [mixed[i : i + 25] for i in range(0, len(mixed), 25)] + [[("end", 100, "PENDING")]], 3)
    assert parts == whole and len({t for t, *_ in whole}) == 4


def test_silence_ends_a_run_and_its_state(own, tmp_path):
    batches = [[("a", 0, "PENDING"), ("a", 1, "IN_PROGRESS")], [("b", 9, "PENDING")], [("c", 11, "PENDING"), ("a", 10.5, "SUCCESS")], [("end", 40, "PENDING")], [("end", 41, "SUCCESS")]]
    found, query = run(own, tmp_path, batches)
    assert ("a", 0, 1, "FAILED", 6, True) in found and ("b", 9, None, "FAILED", 14, True) in found and ("c", 11, None, "FAILED", 16, True) in found
    assert not [x for x in found if x[0] == "a" and x[3] == "SUCCESS"]


def test_rows_too_late_unknown_or_null_change_nothing(own, tmp_path):
    batches = [[("a", 10, "PENDING"), ("x", 30, "PENDING")], [("x", 31, "PENDING")], [("a", 11, "SUCCESS"), (None, 35, "PENDING"), ("u", 29, "UNKNOWN")], [("end", 60, "PENDING")]]
    found, _ = run(own, tmp_path, batches)
    assert ("a", 10, None, "FAILED", 15, True) in found and {t for t, *_ in found} == {"a", "x"}


def write(path, name, text):
    os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write(text)


def outcome(spark, root):
    return {(r["batch"].split("-")[0], r["collection_name"], r["document_name"]): (r["status"], r["error"]) for r in folder.statuses(spark, root).collect()}


def test_a_folder_from_files_to_chunks(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"file://{tmp_path}/out"
    write(source, "one/a.txt", "The first document. It has text.")
    write(source, "one/b.html", "<p>shown</p><script>x()</script>")
    write(source, "one/c.exe", "binary")
    write(source, "two/a.txt", "Same name, other collection.")
    write(source, "two/blank.md", " \n ")
    write(source, "two/deep/two/a.txt", "Same name again, same folder name.")
    ingest = lambda upload: folder.ingest(folder.files(spark, source), root, f"file://{tmp_path}/checkpoint-{upload}", upload).awaitTermination()
    ingest("first")
    found = outcome(spark, root)
    assert found["first", "one", "a.txt"] == ("SUCCESS", None) and found["first", "one", "b.html"] == ("SUCCESS", None)
    assert found["first", "one", "c.exe"][1] == "files of this kind are not taken in: c.exe" and found["first", "two", "blank.md"][1] == "no text in blank.md"
    texts = {(r["collection_name"], r["document_name"]): r["chunk"] for r in folder.chunks(spark, root).collect()}
    assert set(texts) == {("one", "a.txt"), ("one", "b.html"), ("two", "a.txt")} and "x()" not in texts["one", "b.html"]
    assert folder.statuses(spark, root).where("document_name = 'a.txt' and collection_name = 'two'").count() == 2
    write(source, "one/new.txt", "Came later.")
    ingest("first")
    assert outcome(spark, root)["first", "one", "new.txt"] == ("SUCCESS", None)
    ingest("second")
    found = outcome(spark, root)
    assert found["second", "one", "a.txt"] == ("FAILED", "Document a.txt already exists. Use update document API instead.")
    assert folder.chunks(spark, root).count() == 4


def test_a_batch_that_stopped_in_the_middle(spark, tmp_path, monkeypatch):
    source, root = f"{tmp_path}/in", f"file://{tmp_path}/out"
    write(source, "one/a.txt", "The first document.")
    place = f"file://{tmp_path}/checkpoint"
    start = lambda: folder.ingest(folder.files(spark, source), root, place, "u")
    chunk, stopped = folder.chunk, []

    def failing(*args):
        out = chunk(*args)
        if not stopped:
            stopped.append(out.write.mode("overwrite").partitionBy("collection_name").parquet(f"{root}/chunks/batch=u-00000000"))
            raise RuntimeError("stopped")
        return out

    monkeypatch.setattr(folder, "chunk", failing)
    with pytest.raises(Exception, match="stopped"):
        start().awaitTermination()
    assert folder.statuses(spark, root).count() == 0 == folder.chunks(spark, root).count()
    start().awaitTermination()
    assert outcome(spark, root) == {("u", "one", "a.txt"): ("SUCCESS", None)} and folder.chunks(spark, root).count() == 1


def test_judged_rows(spark):
    rows = [("c", "x", "text one"), ("c", "x", "text two"), ("c", "y", None), (None, "z", "t"), ("c", "old", "t"), ("d", "old", "t"), ("c", "twice", "same"), ("c", "twice", "same")]
    stored = spark.createDataFrame([("c", "old")], "collection_name string, document_name string")
    out = folder.judged(spark.createDataFrame(rows, "collection_name string, document_name string, text string"), stored)
    told = sorted((r["collection_name"] or "", r["document_name"], r["error"] is None) for r in out.collect())
    assert told == sorted([("c", "x", True), ("c", "x", False), ("c", "y", False), ("", "z", False), ("c", "old", False), ("d", "old", True), ("c", "twice", True), ("c", "twice", True)])


def test_stream_ingest_counts_every_row_with_a_text(spark, tmp_path):
    """Blank texts, a doc_id twice or null, an empty source and one that is null."""
    import duckdb

    rows = [(1, "a b", "s"), (2, "", "s"), (3, " \n\t", "s"), (4, None, "s"), (5, "c", "s"), (5, "c", "s"), (5, "d", "s"), (6, "x", ""), (7, "y", None), (None, "z", "t"), (None, "z", "t"), (8, "\u00a0", "u")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same_rows(catalogue.QUERIES["stream_ingest"](spark, str(tmp_path)), con, catalogue.ORACLES["stream_ingest"]) == 5
