"""Summarise a Spark event log: jobs and stages with wall time, task count and task time.

Usage: python tools/stage_times.py <event-log file or dir> [top_n]
"""

from __future__ import annotations

import json
import os
import sys


def load(path: str) -> list[dict]:
    """Read a plain event log file, a rolling log folder (eventlog_v2_*), or the newest log in a folder."""
    if os.path.isdir(path) and not os.path.basename(path).startswith("eventlog_v2_"):
        entries = [os.path.join(path, f) for f in os.listdir(path)]
        path = max(entries, key=os.path.getmtime)
    files = [path]
    if os.path.isdir(path):
        files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_"))
    events = []
    for f in files:
        with open(f, "rb") as fh:
            if f.endswith(".zstd"):
                import zstandard

                raw = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True).read()
            else:
                raw = fh.read()
        events += [json.loads(line) for line in raw.decode("utf-8").splitlines() if line.strip()]
    return events


def main() -> None:
    events = load(sys.argv[1])
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 25
    stages: dict[int, dict] = {}
    task_time: dict[int, float] = {}
    jobs = []
    for e in events:
        ev = e.get("Event")
        if ev == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            sid = info["Stage ID"]
            stages[sid] = {
                "name": info.get("Stage Name", "")[:70],
                "tasks": info.get("Number of Tasks"),
                "wall": (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000,
            }
        elif ev == "SparkListenerTaskEnd":
            sid = e["Stage ID"]
            m = e.get("Task Metrics") or {}
            task_time[sid] = task_time.get(sid, 0) + m.get("Executor Run Time", 0) / 1000
        elif ev == "SparkListenerJobEnd":
            jobs.append(e)
    total_wall = sum(s["wall"] for s in stages.values())
    print(f"jobs={len(jobs)} stages={len(stages)} sum(stage wall)={total_wall:.2f}s "
          f"sum(task time)={sum(task_time.values()):.2f}s")
    for sid, s in sorted(stages.items(), key=lambda kv: -kv[1]["wall"])[:top]:
        print(f"stage {sid:5d} wall={s['wall']:6.2f}s tasks={s['tasks']:4d} task_time={task_time.get(sid, 0):6.2f}s  {s['name']}")


if __name__ == "__main__":
    main()
