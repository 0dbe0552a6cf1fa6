"""Text files: line order over files and splits, minimum partitions."""

import datetime as dt

from flowbook.operators import factors as FX
from flowbook.sources import text


def write(folder, files):
    for name, lines in files.items():
        (folder / name).write_text("".join(f"{x}\n" for x in lines))
    return str(folder)


def test_first_line_by_path_whatever_the_sizes(spark, tmp_path):
    path = write(tmp_path, {"a.csv": ["2015-04-01T00;x"], "b.csv": ["2020-01-01T00;x"] * 300})
    assert text.read_analysis_date(spark, path) == dt.date(2015, 4, 1)


def test_last_line_wins_over_files_and_splits(spark, tmp_path):
    path = write(tmp_path, {"a.csv": ["K;x;ReferenceRate;2015-01-01T00;0.1"] * 200, "b.csv": ["K;x;ReferenceRate;2015-01-01T00;0.9"]})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        lines = text.read_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 5
        assert [r.value[-3:] for r in lines.orderBy("line_no").collect()] == ["0.1"] * 200 + ["0.9"]
        assert FX.dedup(FX.factor_records(lines)).first().vals == ["0.9"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_minimum_partitions(spark, tmp_path):
    path = write(tmp_path, {"a.csv": [f"{i};x" for i in range(1000)]})
    lines = text.read_lines(spark, path, min_partitions=32)
    assert lines.rdd.getNumPartitions() == 32
    assert [r.value for r in lines.orderBy("line_no").collect()] == [f"{i};x" for i in range(1000)]
