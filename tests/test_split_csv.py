"""Multi-line CSV read by many tasks, against Spark's own whole-file reader."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import types as T

from feira.sources.split_csv import read_split_csv

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("odd name", T.StringType())])


def write(path, rows, end="\n", header=None):
    with open(path, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh, quoting=csv.QUOTE_MINIMAL, lineterminator=end)
        w.writerow(header or SCHEMA.fieldNames())
        w.writerows(rows)


def texts(seed: int):
    rng = random.Random(seed)
    parts = ["a", "b,c", '"', '""', "\n", "\n\n", "é", "long " * 30, '"\n"', ",", "id,text,n,odd name", " "]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) or "x", rng.choice([None, i % 7]), rng.choice(["p", "q\nr", 's"t'])) for i in range(150)]


def whole_file(spark, path):
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(SCHEMA).csv(path)


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(names, (str(n), str(n), "1"))]
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("split,end", [(37, "\n"), (101, "\n"), (1000, "\r\n"), (1 << 20, "\n")])
def test_equals_the_whole_file_reader(spark, tmp_path, small_splits, split, end):
    """Split ends inside quotes, at quotes, at line breaks and inside records longer than several splits."""
    rows = texts(split) + [(999, "over many\nsplits " * 40, 1, "z")]
    path = str(tmp_path / "one.csv")
    write(path, rows, end)
    want = sorted(map(tuple, whole_file(spark, path).collect()), key=repr)
    assert len(want) == len(rows)
    small_splits(split)
    got = read_split_csv(spark, path, SCHEMA)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    if split < 1000:
        assert got.rdd.getNumPartitions() > 8  # one file, many tasks


def test_folder_of_files(spark, tmp_path, small_splits):
    folder = tmp_path / "many"
    folder.mkdir()
    rows = texts(5)
    for k in range(3):
        write(folder / f"{k}.csv", rows[k::3])
    write(folder / "header_only.csv", [])
    small_splits(90)
    got = read_split_csv(spark, str(folder), SCHEMA)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole_file(spark, str(folder)).collect()), key=repr)


def test_blank_lines_are_no_records(spark, tmp_path):
    path = tmp_path / "blank.csv"
    path.write_text('id,text,n,odd name\n\n1,a,2,b\n\n\n2,"c\n\nd",3,e\n\n', encoding="utf-8")
    assert sorted(map(tuple, read_split_csv(spark, str(path), SCHEMA).collect())) == [(1, "a", 2, "b"), (2, "c\n\nd", 3, "e")]


def test_another_header_fails(spark, tmp_path):
    folder = tmp_path / "bad"
    folder.mkdir()
    write(folder / "a.csv", [(1, "x", 2, "y")])
    write(folder / "b.csv", [("x", 1, 2, "y")], header=["text", "id", "n", "odd name"])
    with pytest.raises(Exception, match="the header is"):
        read_split_csv(spark, str(folder), SCHEMA).collect()
