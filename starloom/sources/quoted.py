"""CSV files whose quoted fields hold line breaks, read in many tasks a file.

Whether a line starts a record hangs on all quotes before it: a record starts where their
number is even.  One pass counts the quotes of every byte range (a file split), their
running parity per file tells each range whether it starts inside a quoted field, and
a second pass cuts each range into records by itself.  Only what lies over the border
of two ranges, two pieces a range at most, is put together afterwards.

Quotes stand only around fields, or doubled inside quoted ones (RFC 4180).  Line
breaks inside fields are kept as written; blank lines between records are skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): every line with the byte range it starts in, in file order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of every record but each file's first (its header), line breaks included."""
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # one row per byte range (a file split of spark.sql.files.maxPartitionBytes)
    counted = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes")).collect()
    inside, odd, last = {}, 0, None
    for r in sorted(counted, key=lambda r: (r["file"], r["start"])):
        odd = odd if r["file"] == last else 0
        inside[r["file"], r["start"]] = odd
        odd, last = (odd + r["quotes"]) % 2, r["file"]
    shared = spark.sparkContext.broadcast(inside)

    def cut(batches):
        where, open_, first, odd = None, None, True, 0     # range, lines of the record begun, still before its first start, parity

        def batch(rows):
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                                              names=["file", "start", "kind", "record"])

        def closed(done):
            """The record begun, at the end of its range: whole, or a piece."""
            if open_ is None:
                return
            text = "\n".join(open_)
            kind = ("inner" if odd else "tail") if first else ("head" if odd else "whole")
            done.append((*where, kind, text))

        for b in batches:
            done: list[tuple] = []
            files, starts, values = (b.column(i) for i in range(3))
            values = values.to_pylist()
            marks = np.fromiter((v.count('"') for v in values), np.int64, len(values))
            for key, value, n in zip(zip(files.to_pylist(), starts.to_pylist()), values, marks.tolist()):
                if key != where:
                    closed(done)
                    where, open_, odd = key, None, shared.value[key]
                    first = bool(odd)                       # begins inside a record of the range before
                if odd == 0 and open_ is not None:          # a line that starts a record
                    done.append((*where, "tail" if first else "whole", "\n".join(open_)))
                    open_, first = None, False
                open_ = [value] if open_ is None else [*open_, value] if len(open_) < 64 else ["\n".join([*open_, value])]
                odd = (odd + n) % 2
            yield batch(done)
        done = []
        closed(done)
        yield batch(done)

    cut_up = lines.mapInArrow(cut, "file string, start long, kind string, record string")
    # pieces: a record begins with a head, goes on over inner ranges, and ends with a tail
    pieces = cut_up.where("kind <> 'whole'")
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == "head", 1).otherwise(0))
    numbered = pieces.withColumn("number", F.sum(F.when(F.col("kind") == "head", 1).otherwise(0)).over(order))
    joined = (numbered.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", F.when(F.col("kind") == "head", 1).otherwise(0).alias("later"), "record"))).alias("p"))
              .select("file", F.col("p")[0]["start"].alias("start"), F.array_join(F.col("p")["record"], "\n").alias("record")))
    whole = cut_up.where("kind = 'whole'").select("file", "start", "record").unionByName(joined)
    ended = whole.select("file", "start", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
    return ended.select("file", "start", "record")


def read_quoted(spark: SparkSession, path: str, columns: list[str], corrupt: str | None = None) -> DataFrame:
    """String ``columns`` of every record behind the header; with ``corrupt``, a column of
    that name holds records of a wrong number of fields."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, *([corrupt] if corrupt else [])])
    options = {"escape": '"', "mode": "PERMISSIVE", **({"columnNameOfCorruptRecord": corrupt} if corrupt else {})}
    header = ",".join(columns)
    bare = F.regexp_replace(F.col("record"), '["﻿]', "")
    # the header is the first record of a file: it lies in its first range and names the columns
    body = records(spark, path).where(~((F.col("start") == 0) & (bare == header)))
    return body.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
