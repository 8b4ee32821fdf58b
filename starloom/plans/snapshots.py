"""Which folders make up the loaded tables: one small manifest per load.

A load writes new folders only and names them in a manifest, whose appearance
under its number (one rename) is the commit.  Readers follow the manifest with the largest
number, so a load that dies half-way leaves the tables as they were; two loads that
race for one number cannot both commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _children(spark: SparkSession, path: str) -> list[str]:
    files, folder = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def current(spark: SparkSession, path: str) -> dict:
    """The manifest that readers follow; of an empty folder: no tables."""
    names = [n for n in _children(spark, f"{path}/_loads") if n.endswith(".json") and n[:-5].isdigit()]
    if not names:
        return {"number": 0, "tables": {}, "months": {}, "last_order_key": None}
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/_loads/{names[-1]}", wholetext=True).collect()))


def commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Make ``manifest`` the current one; fails where another load came first."""
    number = int(manifest["number"]) + 1
    files, target = _file_system(spark, f"{path}/_loads/{number:08d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_loads/{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({**manifest, "number": number}).encode()))
    out.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise RuntimeError(f"another load of {path} was committed first")


def month_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """``purchase_year=.../purchase_month=...`` folders of a load of the fact."""
    return {f"{y}/{m}": f"{path}/{y}/{m}" for y in _children(spark, path) if y.startswith("purchase_year=")
            for m in _children(spark, f"{path}/{y}") if m.startswith("purchase_month=")}
