"""Slowest stages of a Spark event log (JSON lines; a file or Spark 4's
rolling log folder, zstd or plain), e.g. from ``BENCH_EVENTLOG=1 python
bench.py``, which prints the log folder on stderr:
    python tools/stage_times.py <event log file or folder> [top_n]
"""

from __future__ import annotations

import io
import json
import os
import sys


def _lines(path: str):
    """Event lines of a log file or of a rolling log folder (``events_*``),
    plain or zstd-compressed."""
    files = ([os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith("events_")]
             if os.path.isdir(path) else [path])
    for name in files:
        if name.endswith(".zstd"):
            import zstandard
            with open(name, "rb") as raw:
                reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw),
                                          encoding="utf-8")
                yield from reader
        else:
            with open(name) as f:
                yield from f


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages = []
    for line in _lines(path):
        ev = json.loads(line)
        if ev.get("Event") != "SparkListenerStageCompleted":
            continue
        info = ev["Stage Info"]
        start, end = info.get("Submission Time"), info.get("Completion Time")
        if start is None or end is None:
            continue
        stages.append((end - start, info["Stage ID"], info["Number of Tasks"],
                       info["Stage Name"][:90]))
    stages.sort(reverse=True)
    total = sum(s[0] for s in stages)
    print(f"{len(stages)} stages, {total / 1000:.1f} s summed stage time")
    for ms, sid, tasks, name in stages[:top]:
        print(f"{ms / 1000:7.2f} s  stage {sid:5d}  {tasks:5d} tasks  {name}")


if __name__ == "__main__":
    main()
