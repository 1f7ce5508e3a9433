"""Time the headline jobs and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every job is written to the
no-op sink, so all of its rows are produced and none travel to the driver. Before that each table
is copied into one file per core: the given files have a single row group, which one task would read.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

HEADLINE = (
    "top3_schemes", "eligibility_criteria", "eligibility_status", "matched_schemes", "missing_documents", "pairwise_names", "name_consensus", "consistency_score",
    "readiness_score", "application_vs_document", "question_slots", "matched_questions", "texts_matched_to_items", "classified_texts", "labelled_fields",
    "field_metrics", "error_rates", "quality_score", "otsu_threshold", "rate_limited_events", "session_verdicts",
)


def laid_out(spark, base: str, files: int) -> str:
    """The tables of `base` in so many files each."""
    from grantlens.session import TABLES, table

    to = tempfile.mkdtemp(prefix="run-")
    for name in TABLES:
        table(spark, base, name).repartition(files).write.parquet(f"{to}/{name}.parquet")
    return to


def main() -> None:
    from grantlens.plans import all_jobs
    from grantlens.session import build_session

    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    jobs = all_jobs()
    sf, base = os.path.basename(base.rstrip("/")).removeprefix("sf"), laid_out(spark, base, spark.sparkContext.defaultParallelism)
    jobs["schemes_per_state"].run(spark, base).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        jobs[name].run(spark, base).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "layout": "one file per core", "sf": sf}))


if __name__ == "__main__":
    main()
