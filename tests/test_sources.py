import json
import os

import pytest
from pyspark.errors import AnalysisException

from tidepool.operators.validate import validate_sequences
from tidepool.session import scratch_path
from tidepool.sources.files import append, read_reference, read_requests, read_table, scan_csv, write_csv


def test_json_requests_validate(spark):
    path = scratch_path(spark, "requests-json")
    os.makedirs(path)
    good = [[float((7 * step + col) % 11) for col in range(68)] for step in range(20)]
    rows = [
        {"request_id": "a", "ts": "2024-01-01T00:00:00Z", "sequence": good},
        {"request_id": "b", "ts": "2024-01-01T00:00:01Z", "sequence": good[:10]},
        {"request_id": "c", "ts": "2024-01-01T00:00:02Z", "sequence": [["x"] * 68] * 20},   # strings
        {"request_id": "d", "ts": "2024-01-01T00:00:03Z"},                                  # missing field
    ]
    with open(os.path.join(path, "part.json"), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    df = read_requests(spark, path)
    got = {r["request_id"]: r["error_code"] for r in validate_sequences(df, "sequence", 20, 68).collect()}
    assert got == {"a": None, "b": "bad_length", "c": "null_value", "d": "null_value"}


def test_reference_scan_none_on_failure(spark):
    assert read_reference(spark, None) is None
    assert read_reference(spark, "/nonexistent/ref.parquet") is None


def test_csv_scan_round_trip_and_missing_path(spark):
    df = spark.createDataFrame([("S1", 1, 2.5), ("S2", 2, None)], "ticker string, row_id long, x double")
    path = scratch_path(spark, "csv")
    write_csv(df, path)
    back = scan_csv(spark, path, df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(AnalysisException):
        scan_csv(spark, "/nonexistent/panel.csv", df.schema)


def test_append_log(spark):
    path = scratch_path(spark, "log")
    df = spark.createDataFrame([(1, 0.5)], "id long, prediction double")
    append(df, path)
    append(df, path)
    assert read_table(spark, path).count() == 2


def test_materialize_lists_written_tables(spark):
    from tidepool.session import materialize, materialized_paths
    before = len(materialized_paths())
    t = materialize(spark.range(5), "listed")
    assert t.count() == 5
    paths = materialized_paths()
    assert len(paths) == before + 1 and "listed-" in paths[-1]
