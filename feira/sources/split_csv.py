"""CSV files whose quoted fields hold line breaks, read by many tasks.

Spark's ``multiLine`` reader gives a whole file to one task, since the start of a record can't be told from a place in the middle
of a file. It can be told from the number of quotes before it: a line break ends a record exactly if an even
number of quotes stands before it in the file (a doubled quote inside a field adds two). So

1. every split of every file is read as plain lines, and its quotes are counted (one aggregation, one
   small row a split; a running sum over a file's splits tells whether each one begins inside a quoted field);
2. the splits are read again and their lines joined into records where the count is even. The lines before the first record's
   beginning belong to a record that an earlier split began; those pieces, two a split at most, are put together by the
   record's first split;
3. ``from_csv`` parses whole records, with the types and options of the file reader.

The list of splits with their quote parities is sent to the tasks, as Spark's driver holds the list of splits in any scan.
Quotes must stand only around fields and doubled inside them, as CSV writers do. Lines end in ``\\n`` or ``\\r\\n``. Blank
lines are no records. Every file begins with the same header; another one is an error.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): the physical lines with the split that holds their beginning, in file order within a task."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))


def _open_splits(lines: DataFrame) -> list[tuple[str, int]]:
    """The splits that begin inside a quoted field."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "at").agg((F.sum(quotes) % 2).alias("odd"))
    before = F.sum("odd").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    return [(r.file, r.at) for r in splits.withColumn("before", before).where("before % 2 = 1").select("file", "at").collect()]


def _pieces(lines: DataFrame, inside: set[tuple[str, int]], header: list[str]) -> DataFrame:
    """(kind, file, at, text): ``whole`` records, the ``head`` of a split that ends an earlier split's record, the ``tail`` that a later split
    ends, and ``middle`` for a split without any record's beginning or end. Pieces keep their line breaks; headers are checked and left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split: tuple[str, int] | None = None
        held: list[str] = []
        odd = opened = False  # inside a quoted field; the held lines began in an earlier split
        headed = True  # the file's header has been seen
        out: list[tuple[str, str, int, str]] = []

        def close() -> None:
            if held:
                if not headed:
                    raise ValueError(f"{split[0]}: the header is longer than a split")
                out.append(("middle" if opened else "tail", *split, "\n".join(held) + "\n"))
                held.clear()

        for batch in batches:
            for file, at, line in zip(batch["file"], batch["at"], batch["line"]):
                if (file, at) != split:
                    close()
                    split = (file, at)
                    odd = opened = split in inside
                    headed = at > 0
                held.append(line)
                odd ^= line.count('"') % 2 == 1
                if not odd and not headed:
                    found = next(csv.reader(["\n".join(held).removesuffix("\r")]), [])
                    if found != header:
                        raise ValueError(f"{file}: the header is {found}, not {header}")
                    headed = True
                    held.clear()
                elif not odd:
                    out.append(("head" if opened else "whole", file, at, "\n".join(held)))
                    held.clear()
                    opened = False
            yield pd.DataFrame(out, columns=["kind", "file", "at", "text"])
            out.clear()
        close()
        yield pd.DataFrame(out, columns=["kind", "file", "at", "text"])

    return lines.mapInPandas(run, "kind string, file string, at long, text string")


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str] | None = None) -> DataFrame:
    """The records of the CSV file or folder at ``path``, whose header holds the names of ``schema`` in this order."""
    lines = _lines(spark, path)
    inside = set(_open_splits(lines))
    pieces = _pieces(lines, inside, schema.fieldNames())
    records = pieces.where("kind = 'whole'").select("text")
    if inside:
        parts = pieces.where("kind <> 'whole'")
        in_file = W.partitionBy("file").orderBy("at", F.col("kind") == "tail").rowsBetween(W.unboundedPreceding, W.currentRow)
        owned = parts.withColumn("owner", F.max(F.when(F.col("kind") == "tail", F.col("at"))).over(in_file))
        joined = owned.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("kind") == "tail").alias("t"), "text"))).alias("p"))
        records = records.union(joined.select(F.concat_ws("", F.transform("p", lambda x: x["text"])).alias("text")))
    text = F.regexp_replace("text", "\\r$", "")
    parsed = records.select(text.alias("text")).where("text <> ''").select(
        F.from_csv("text", schema.toDDL(), {"quote": '"', "escape": '"', "multiLine": "true"} | (options or {})).alias("r"))
    return parsed.select(*[F.col("r").getField(f.name).alias(f.name) for f in schema])
