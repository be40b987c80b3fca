import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alertlake.operators import versions as V
from alertlake.schema import LINEAGE_SCHEMA
from alertlake.workspace import new_folder


def edges(spark, pairs):
    import datetime as dt

    return spark.createDataFrame([(v, p, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "create_new_version", "", i)
                                  for i, (v, p) in enumerate(pairs)], LINEAGE_SCHEMA)


def walk(pairs, start):
    first = {}
    for v, p in pairs:
        first.setdefault(v, p)
    seen, at = {start}, start
    while first.get(at) and first[at] not in seen:
        at = first[at]
        seen.add(at)
    return seen


def ancestors(spark, pairs, start):
    out = V.ancestry(edges(spark, pairs), spark.createDataFrame([(start,)], "version string"))
    return {r["ancestor"] for r in out.collect()}


@pytest.mark.parametrize("pairs, start", [
    ([("b", "a"), ("c", "b"), ("d", "c")], "d"), ([("b", "a"), ("a", "b")], "a"), ([("b", "a"), ("b", "z")], "b"), ([("x", "y")], "q"),
    ([(f"n{i}", f"n{i - 1}") for i in range(1, 40)], "n39"),
])
def test_ancestry(spark, pairs, start):
    assert ancestors(spark, pairs, start) == walk(pairs, start)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=12), st.integers(0, 9))
def test_any_lineage(spark, numbers, start):
    pairs = [(str(a), str(b)) for a, b in numbers]
    assert ancestors(spark, pairs, str(start)) == walk(pairs, str(start))


def test_store(spark):
    kept = V.VersionStore(spark, new_folder(spark, "test-versions"))
    assert kept.current() == "v0.0.0"
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "TransactionID string, x double")
    more = rows.union(spark.createDataFrame([("c", 3.0), ("c", 4.0)], rows.schema))
    assert kept.create("first", "2024-01-01 00:00:00", rows) == "v1.0.0"
    assert kept.create("second", "2024-01-02 12:00:00", more, True) == "v2.0.0"
    row = kept.compare("v1.0.0", "v2.0.0").first()
    assert (row["transaction_count_difference"], row["new_records_count"], row["time_difference_days"]) == (2, 1, 1.5)
    assert row["lineage_relation"] == "B is direct descendant of A" and row["notes_b"] == "second"
    assert kept.rollback("v9.0.0", "2024-01-03 00:00:00") is False
    assert kept.rollback("v1.0.0", "2024-01-03 00:00:00") is True
    assert kept.current() == "v1.0.0" and kept.as_of().count() == 2 and kept.as_of("v2.0.0").count() == 4
    assert [r["version"] for r in kept.versions().orderBy("version").collect()] == ["v1.0.0", "v2.0.0", "v3.0.0"]
    assert kept.info("v2.0.0").first()["merge_with_existing"] is True
    with pytest.raises(ValueError):
        kept.info("v9.0.0")
    assert kept.create("after", "2024-01-04 00:00:00", rows) == "v4.0.0"  # v2.0.0 exists and is never overwritten
    assert kept.current() == "v4.0.0" and kept.info().first()["parent_version"] == "v1.0.0"


def test_import(spark):
    document = ('{"current_version": "v2.0.0", "versions": {"v1.0.0": {"created_at": "2024-01-01T10:00:00.5", "notes": "n", "parent_version": "v0.0.0", '
                '"processing_info": {}}, "v2.0.0": {"created_at": "2024-01-02T00:00:00", "parent_version": "v1.0.0", "processing_info": '
                '{"merge_with_existing": true, "processed_records": 7, "processed_files": ["a", "b"]}}}, "data_lineage": '
                '[{"version": "v1.0.0", "parent": "v0.0.0", "timestamp": "2024-01-01T10:00:00", "operation": "create_new_version", "notes": ""}]}')
    versions, lineage = V.import_document(spark.createDataFrame([(document,)], "document string"))
    rows = {r["version"]: r for r in versions.collect()}
    assert rows["v2.0.0"]["processed_records"] == 7 and rows["v2.0.0"]["is_current"] and not rows["v1.0.0"]["is_current"]
    assert lineage.first()["parent"] == "v0.0.0"
    summary = {r["version"]: r for r in V.version_summary(versions).collect()}
    assert (summary["v2.0.0"]["files"], summary["v2.0.0"]["merged"], summary["v1.0.0"]["files"], summary["v2.0.0"]["notes"]) == (2, "Yes", 0, "No notes available")
