"""Files: null cells, schemas that grow, absent logs, dataset catalogs, months, and streams against batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alertlake.operators import detectors as D
from alertlake.operators import versions as V
from alertlake.operators.clean import clean
from alertlake.plans.jobs import alert_run, analyze_csv, ingest, process_datasets, refresh, upload_alerts
from alertlake.sources import quarantine as Q
from alertlake.sources import readers as R
from alertlake.sources import sinks
from alertlake.streaming import streams as S
from alertlake.workspace import new_folder, shared_root, store


def put(spark, folder, name, text):
    lines = spark.createDataFrame([(text,)], "value string")
    path = f"{folder}/{name}"
    lines.coalesce(1).write.text(path)
    return path


OLD = "TransactionID,AccountID,CustomerID,TransactionDate,TransactionAmount,TransactionType,MerchantID,BranchID,IsApproved\n" \
      "1,A1,C1,2025-05-01,100.5,Debit,M1,B1,true\n2,A2,C2,2025-05-01,250.0,Credit,null,B2,false"
NEW = "TransactionID,AccountID,CustomerID,TransactionDate,TransactionAmount,TransactionType,MerchantID,BranchID,IsApproved,Location,FraudFlag\n" \
      "2,A2,C2,2025-05-01,250.0,Credit,null,B2,false,Boston,TRUE\n3,A3,C1,2025-05-02 00:02:00,null,Debit,M2,B1,true,Boston,false"


def test_csv_nulls_and_growing_schema(spark):
    folder = new_folder(spark, "test-csv")
    old = R.read_transactions_csv(spark, put(spark, folder, "old", OLD))
    new = R.read_transactions_csv(spark, put(spark, folder, "new", NEW))
    assert old.where("MerchantID is null").count() == 1 and dict(old.dtypes)["TransactionAmount"] == "double"
    both = clean(old.unionByName(new, allowMissingColumns=True))
    assert both.count() == 4 and both.where("Location is null").count() == 2
    rows = {r["type"]: r for r in D.detect_upload(new).collect()}
    assert rows["fraud_flags"]["count"] == 1 and rows["overnight_transactions"]["count"] == 2
    assert "high_login_attempts" not in rows and "velocity_anomaly" not in rows
    done = ingest(old, new, f"{folder}/store", "v2.0.0", "20250501120000")
    assert done.transactions.count() == 4
    kinds = {r["type"]: r["anomaly"]["count"] for r in done.alerts.collect()}
    assert kinds["general_insight"] == 2 and kinds["fraud_flags"] == 1


def test_headers_may_differ(spark):
    folder = new_folder(spark, "test-headers")
    put(spark, folder, "in/a", "TransactionID,CustomerID,TransactionAmount,Location\n1,C1,10.5,Boston")
    put(spark, folder, "in/b", "TransactionID,Location,CustomerID,TransactionAmount,Channel\n2,Dallas,C2,20.5,ATM")
    rows = {r["TransactionID"]: r for r in R.read_transactions_csv(spark, f"{folder}/in").collect()}
    assert (rows["1"]["Location"], rows["1"]["TransactionAmount"], rows["1"]["Channel"]) == ("Boston", 10.5, None)
    assert (rows["2"]["Location"], rows["2"]["CustomerID"], rows["2"]["TransactionAmount"]) == ("Dallas", "C2", 20.5)
    with pytest.raises(Exception):
        R.read_csv(spark, f"{folder}/in/b", "TransactionID string, CustomerID string, TransactionAmount double, Location string, Channel string").collect()


def test_only_a_missing_path_is_empty(spark):
    folder = new_folder(spark, "test-missing")
    put(spark, folder, "bad/history", "no parquet")
    assert V.VersionStore(spark, f"{folder}/none").current() == "v0.0.0"
    with pytest.raises(Exception):
        V.VersionStore(spark, f"{folder}/bad").current()


def test_repeated_runs_replace_their_alerts(spark):
    folder = new_folder(spark, "test-runs")
    rows = spark.createDataFrame([("1", "L", 9)], "TransactionID string, Location string, LoginAttempts int")
    for run in ("20240101000000", "20240102000000", "20240101000000"):
        sinks.save_alerts(upload_alerts(rows, run), f"{folder}/alerts")
    found = spark.read.json(f"{folder}/alerts").groupBy("run_id").count().collect()
    assert len(found) == 2 and len({r["count"] for r in found}) == 1


def test_logs(spark):
    folder = new_folder(spark, "test-logs")
    assert R.read_log(spark, f"{folder}/none", "usage").count() == 0
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5, 6, 7, 123456), "q", "m", 3, 4)],
                                 "timestamp timestamp_ntz, query_id string, model_name string, tokens_prompt bigint, tokens_completion bigint")
    sinks.append_log(sinks.usage_records(rows), f"{folder}/usage", "usage")
    row = R.read_log(spark, f"{folder}/usage", "usage").first()
    assert row["tokens_total"] == 7 and row["timestamp"] == dt.datetime(2024, 1, 1, 5, 6, 7, 123456)


def test_catalog_and_jobs(spark):
    folder = new_folder(spark, "test-catalog")
    put(spark, folder, "processed_cases.csv", "a,b_flag\n1,1\n2,0")
    put(spark, folder, "processed_transactions.csv", OLD)
    put(spark, folder, "other.csv", "x\n1")
    found = R.read_datasets(spark, folder)
    assert sorted(found) == ["cases", "transactions"]
    written = process_datasets(found, f"{folder}/out", scaled=True)
    assert "TransactionAmount_z" in written["transactions"].columns
    alerts = alert_run(spark, f"{folder}/out", f"{folder}/alerts", "20250101000000")
    assert {r["type"] for r in alerts.collect()} >= {"cases_b_flag"}
    direct = {r["type"]: r["query"] for r in analyze_csv(spark, f"{folder}/processed_transactions.csv", "20250101000000").collect()}
    assert direct["overnight_transactions"] == "Generate an alert for 2 transactions occurring during overnight hours (12am-5am)"
    assert sorted(written) == ["branch_summaries", "cases", "transactions"] and written["branch_summaries"].count() == 2


def test_refresh_adds_only_new(spark):
    folder = new_folder(spark, "test-refresh")
    names = ("TransactionID string, TransactionAmount double, TransactionType string, TransactionDate timestamp_ntz, Location string, Channel string, "
             "CustomerAge int, CustomerOccupation string, TransactionDuration int, LoginAttempts int, AccountBalance double")
    rows = spark.createDataFrame([(f"t{i}", 1.5 * i, "Debit", dt.datetime(2024, 1, 1 + i), "L", "ATM", 30, "x", 5, 1, 9.0) for i in range(4)], names)
    days = rows.groupBy("Location", F.to_date("TransactionDate").alias("Date")).agg(F.count("*").alias("TransactionCount"))
    first = refresh(spark, f"{folder}/v", rows.limit(2), days.limit(0), f"{folder}/a", "20240101000000").count()
    again = refresh(spark, f"{folder}/v", rows, days, f"{folder}/a", "20240102000000")
    assert first == 2 and again.count() == 8 and again.select("id").distinct().count() == 8


def test_month_names(spark):
    folder = new_folder(spark, "test-months")
    put(spark, folder, "1-25.csv", "date,alert_count\n2025-01-03,31\n2025-01-04,30")
    put(spark, folder, "12-24.csv", "date,alert_count\n2024-12-01,99")
    rows = R.read_monthly_counts(spark, f"{folder}/*.csv").orderBy("date").collect()
    assert [(r["month"], r["alert_count"]) for r in rows] == [("December 2024", 99), ("January 2025", 31), ("January 2025", 30)]
    counts = S.file_stream(spark, f"{folder}/*.csv", "date date, alert_count bigint")
    S.breach_stream(counts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    assert sorted(r["alert_count"] for r in spark.read.parquet(f"{folder}/out").collect()) == [31, 99]


def test_velocity_across_batches(spark):
    folder = new_folder(spark, "test-velocity")
    base = dt.datetime(2024, 1, 1, 9, 58)
    batches = [[("a", "1", 0), ("b", "2", 1)], [("a", "3", 4.9), ("b", "4", 6.5)], [("a", "5", 9.9), ("a", "6", 10), (None, "7", 10)]]
    for rows in batches:
        spark.createDataFrame([(c, i, base + dt.timedelta(minutes=m)) for c, i, m in rows], "CustomerID string, TransactionID string, TransactionDate timestamp") \
            .coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = S.file_stream(spark, f"{folder}/in", "CustomerID string, TransactionID string, TransactionDate timestamp", "parquet")
    S.velocity_stream(stream, f"{folder}/out", f"{folder}/checkpoint", groups=4).awaitTermination()
    assert sorted(r["TransactionID"] for r in spark.read.parquet(f"{folder}/out").collect()) == ["3", "6"]


def test_late_rows_are_dropped(spark):
    folder = new_folder(spark, "test-late")
    for day, value in ((1, 10.0), (9, 20.0), (9, 40.0), (1, 99.0)):
        spark.createDataFrame([(dt.datetime(2024, 1, day, 12), value)], "timestamp timestamp, x double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = S.file_stream(spark, f"{folder}/in", "timestamp timestamp, x double", "parquet")
    S.daily_average_stream(stream, "x", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = S.latest(spark, f"{folder}/out", ["date"]).orderBy("date").collect()
    assert [(r["date"].day, r["average_x"]) for r in rows] == [(1, 10.0), (9, 30.0)]


def test_each_upload_alone_and_idempotent(spark):
    folder = new_folder(spark, "test-upload")
    for k in range(2):
        spark.createDataFrame([(f"{k}{i}", "L", 10 if i < k + 1 else 1) for i in range(5)], "TransactionID string, Location string, LoginAttempts int") \
            .coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = S.file_stream(spark, f"{folder}/in", "TransactionID string, Location string, LoginAttempts int", "parquet")
    for checkpoint in ("c1", "c2"):  # a second run over the same files replaces the same folders
        S.upload_alert_stream(stream, f"{folder}/out", f"{folder}/{checkpoint}", "20240101000000").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").where("type = 'high_login_attempts'").collect()
    assert sorted(r["anomaly"]["count"] for r in rows) == [1, 2]


def test_shared_folder(spark):
    assert new_folder(spark, "x").startswith(shared_root(spark))
    kept = store(spark.range(3), "numbers")
    assert kept.count() == 3 and "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_a_repeated_log_run_replaces_its_lines(spark):
    folder = new_folder(spark, "test-log-runs")
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "q1", 10, 5), ("2024-01-02 10:00:00", "q2", 1, 2)],
                                 "timestamp string, query_id string, tokens_prompt long, tokens_completion long").withColumn("timestamp", F.to_timestamp("timestamp"))
    for run in ("1", "2", "1"):
        sinks.append_log(sinks.usage_records(rows), f"{folder}/usage", "usage", run)
    found = R.read_log(spark, f"{folder}/usage", "usage")
    assert found.count() == 4 and "run_id" not in found.columns
    assert found.agg(F.sum("tokens_total")).first()[0] == 36


STREAM_ROW = "CustomerID string, TransactionID string, TransactionDate timestamp"


def put_batches(spark, folder, batches):
    base = dt.datetime(2024, 1, 1, 9, 58)
    for rows in batches:
        spark.createDataFrame([(c, i, None if m is None else base + dt.timedelta(minutes=m)) for c, i, m in rows], STREAM_ROW) \
            .coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return S.file_stream(spark, f"{folder}/in", STREAM_ROW, "parquet")


UNORDERED = [[("a", "3", 4.9), ("b", "2", 1), ("a", "6", 30)], [("a", "1", 21), ("b", "4", 22.5), ("a", "7", 24)],
             [("a", "5", 25.9), (None, "8", 60), ("a", "late", 3), ("a", "timeless", None)], [("a", "9", 61), ("a", "10", 62)]]


def test_velocity_of_rows_out_of_order(spark):
    folder = new_folder(spark, "test-unordered")
    stream = put_batches(spark, folder, UNORDERED)
    S.unordered_velocity_stream(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    in_time = spark.read.parquet(f"{folder}/in").where("TransactionID not in ('late', 'timeless')")
    expected = sorted(r["TransactionID"] for r in D.rapid_rows(in_time).collect())
    assert expected == ["10", "5", "6", "7"]
    assert sorted(r["TransactionID"] for r in S.velocity_found(spark, f"{folder}/out").collect()) == expected
    assert sorted(r["TransactionID"] for r in S.velocity_found(spark, f"{folder}/out", held=False).collect()) == ["5", "6", "7"]
    assert sorted(r["TransactionID"] for r in S.late_rows(spark, f"{folder}/out").collect()) == ["late", "timeless"]
    assert S.clock(spark, f"{folder}/out").agg(F.sum("rows")).first()[0] == 12


def test_velocity_goes_on_and_repeats(spark):
    folder = new_folder(spark, "test-unordered-again")
    for batches in (UNORDERED[:2], UNORDERED[2:]):  # two starts with one checkpoint
        stream = put_batches(spark, folder, batches)
        S.unordered_velocity_stream(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    S.unordered_velocity_stream(stream, f"{folder}/out", f"{folder}/other").awaitTermination()  # all batches once more, same folders
    found = S.velocity_found(spark, f"{folder}/out")
    assert sorted(r["TransactionID"] for r in found.collect()) == ["10", "5", "6", "7"]
    assert found.where("TransactionID = '6'").first()["gap_micros"] == 246_000_000


def test_rows_in_are_rows_counted_and_rows_late(spark):
    folder = new_folder(spark, "test-counted")
    stream = put_batches(spark, folder, UNORDERED).withColumn("x", F.col("TransactionID").try_cast("int"))
    S.counted_window_stream(stream, ["x"], f"{folder}/out", f"{folder}/checkpoint", "10 minutes", "5 minutes", "10 minutes", "TransactionDate").awaitTermination()
    rows = {r["window_start"].strftime("%H:%M"): r for r in S.window_totals(spark, f"{folder}/out").collect()}
    assert rows["10:20"]["records"] == 4 and rows["10:20"]["average_x"] == (7 + 5 + 6 + 4) / 4
    assert S.late_rows(spark, f"{folder}/out").count() == 2
    assert sum(r["records"] for r in rows.values()) == 2 * 10  # two windows hold each row


def test_a_stream_of_rows_without_time(spark):
    folder = new_folder(spark, "test-timeless")
    stream = put_batches(spark, folder, [[("a", "1", None)], [("a", "2", None)]])
    S.unordered_velocity_stream(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    assert S.velocity_found(spark, f"{folder}/out").count() == 0 and S.late_rows(spark, f"{folder}/out").count() == 2


LINE = "id string, amount double, day date"


def test_broken_lines_go_to_quarantine(spark):
    folder = new_folder(spark, "test-quarantine")
    schema = spark.createDataFrame([], LINE).schema
    put(spark, folder, "in/a", "id,amount,day\n1,2.5,2024-01-01\n2,x,2024-01-02\n3,4\n4,null,null\n5,y,z\n6,1,2024-01-01,more")
    put(spark, folder, "in/b", "id,amount,day\n7,3,2024-02-30\n8,3,2024-02-29")
    good, broken = Q.sorted_out(spark, f"{folder}/in/*", schema)
    assert dict(good.dtypes) == {"id": "string", "amount": "double", "day": "date"}
    for columns in (["id"], ["id", "day"], ["id", "amount", "day"]):  # whatever is asked for, the same rows are good
        assert sorted(r["id"] for r in good.select(*columns).collect()) == ["1", "4", "8"]
    found = {r["record"].split(",")[0]: r for r in broken.collect()}
    assert {k: r["reason"] for k, r in found.items()} == {"2": "amount", "3": "cells", "5": "amount,day", "6": "cells", "7": "day"}
    assert found["3"]["record"] == "3,4" and found["2"]["record"] == "2,x,2024-01-02" and "/in/b" in found["7"]["file"]
    assert good.count() + broken.count() == 8
    with pytest.raises(ValueError):
        Q.sorted_out(spark, f"{folder}/in", spark.createDataFrame([], "file string").schema)


def test_files_that_break_while_read(spark):
    from pathlib import Path

    folder = new_folder(spark, "test-broken-files")
    rows = spark.range(40_000).withColumn("x", F.xxhash64("id"))
    rows.repartition(4, "id").write.parquet(folder)
    files = sorted(Path(folder).glob("part-*.parquet"))
    lost = spark.read.parquet(str(files[1])).count()
    middle = bytearray(files[1].read_bytes())
    middle[len(middle) // 2] ^= 0xFF  # a single byte of a page; its footer stays
    for file, data in ((files[1], bytes(middle)), (files[2], files[2].read_bytes()[:1000])):
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(data)
    kept = sum(spark.read.parquet(str(files[i])).count() for i in (0, 3))
    good, broken = Q.read_whole_files(spark, folder, rows.schema)
    found = {Path(r["file"]).name: r for r in broken.collect()}
    assert {k: r["reason"] for k, r in found.items()} == {files[1].name: "pages", files[2].name: "footer"}
    assert found[files[1].name]["rows_expected"] == lost and found[files[2].name]["bytes"] == 1000
    assert good.count() == kept and good.where(F.col("x") != F.xxhash64("id")).count() == 0
