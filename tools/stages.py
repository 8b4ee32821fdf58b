"""Summarise a Spark event log (the folder ``bench.py`` reports as
``event_log_dir``): slowest stages with task counts and shuffle bytes.

usage: python tools/stages.py EVENT_LOG_DIR [TOP]
"""

from __future__ import annotations

import glob
import io
import json
import sys


def _lines(f: str):
    if f.endswith((".zstd", ".zst")):
        import zstandard
        with open(f, "rb") as raw:
            text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
            yield from text
    else:
        with open(f, encoding="utf-8") as fh:
            yield from fh


def stages(path: str):
    files = [f for f in glob.glob(f"{path.rstrip('/')}/**/*", recursive=True) if "events" in f.split("/")[-1]
             or f.split("/")[-1].startswith(("app-", "local-"))]
    for f in files:
        for line in _lines(f):
            ev = json.loads(line)
            if ev.get("Event") != "SparkListenerStageCompleted":
                continue
            info = ev["Stage Info"]
            acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
            yield {
                "stage": info["Stage ID"],
                "name": info["Stage Name"].split(" at ")[0],
                "tasks": info["Number of Tasks"],
                "ms": info.get("Completion Time", 0) - info.get("Submission Time", 0),
                "shuffle_read": int(acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or 0)
                + int(acc.get("internal.metrics.shuffle.read.localBytesRead", 0) or 0),
                "shuffle_write": int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0),
            }


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    rows = sorted(stages(path), key=lambda r: -r["ms"])
    total = sum(r["ms"] for r in rows)
    print(f"{len(rows)} stages, {total / 1000:.1f} s of stage time")
    print(f"{'stage':>6} {'ms':>7} {'tasks':>6} {'shuf_rd':>10} {'shuf_wr':>10}  name")
    for r in rows[:top]:
        print(f"{r['stage']:>6} {r['ms']:>7} {r['tasks']:>6} {r['shuffle_read']:>10} {r['shuffle_write']:>10}  {r['name']}")


if __name__ == "__main__":
    main()
