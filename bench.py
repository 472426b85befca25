"""Headline-query timings.

Runs the headline operators on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query is executed completely (``noop`` sink); the time of a query is
the best of ``$BENCH_REPEAT`` runs (default 3) after one warm-up pass on the
smallest scale factor. It also replays the frames through the streaming
flagship (one day per micro-batch) and reports micro-batch durations;
``BENCH_STREAM=0`` skips that part.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sightline.plans import queries as Q  # noqa: E402
from sightline.session import build_session  # noqa: E402

HEADLINE = [
    "latest_per_camera",      # D1
    "sampling_schedule",      # E2
    "asof_prediction",        # F5
    "summary_text",           # G2
    "rolling_features",       # H1
    "carry_forward_text",     # H2
    "box_overlays",           # I1
    "annotated_results",      # I2 (flagship)
    "score_events",           # J3
    "bad_records",            # B6
]


def run(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    Q.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def stream_flagship(spark, sf_dir: str) -> dict:
    """I2 as a stream: the frames replayed with one file per day, one file
    per micro-batch; average and largest micro-batch duration."""
    from pyspark.sql import functions as F

    from sightline.operators import scoring
    from sightline.session import scratch_path
    from sightline.sources import tables as TB
    from sightline.streaming.annotation import run_annotation

    src = scratch_path(spark, "bench-stream-src")
    f = TB.frames(spark, sf_dir).withColumn("_day", F.date_format("ts", "yyyy-MM-dd"))
    TB.messages(f, keep=["_day"]).select("partition", "offset", "value", "_day") \
        .write.partitionBy("_day").json(src)
    scorers = {"object": scoring.StubDetector(TB.DETECTION_LABELS, exclude=(TB.FIREARM_LABEL,)),
               "firearm": scoring.StubDetector(TB.DETECTION_LABELS, only=(TB.FIREARM_LABEL,))}
    t0 = time.perf_counter()
    q = run_annotation(spark, src + "/*", scratch_path(spark, "bench-stream-out"),
                       scratch_path(spark, "bench-stream-ckpt"), scorers, freshness=False,
                       max_files_per_trigger=1)
    q.awaitTermination()
    wall = time.perf_counter() - t0
    ms = [p["durationMs"]["triggerExecution"] for p in q.recentProgress if p["numInputRows"] > 0]
    rows = sum(p["numInputRows"] for p in q.recentProgress)
    return {"stream_batches": len(ms), "stream_batch_ms_avg": round(sum(ms) / max(len(ms), 1), 1),
            "stream_batch_ms_max": max(ms) if ms else 0, "stream_frames_per_sec": round(rows / wall, 1)}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for name in HEADLINE:
            run(spark, name, warm)
    times = {}
    for name in HEADLINE:
        times[name] = round(min(run(spark, name, sf_dir) for _ in range(repeat)), 3)
    frames = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    extra = stream_flagship(spark, sf_dir) if os.environ.get("BENCH_STREAM", "1") == "1" else {}
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else None, "frames": frames,
                      "frames_per_sec_flagship": round(frames / times["annotated_results"], 1), **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
