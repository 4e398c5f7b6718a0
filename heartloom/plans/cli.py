"""Command line: python -m heartloom.plans.cli baseline|formal|formal-folders|statistics|reliability --output PATH ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from heartloom.operators.landmarks import FaceMesh
from heartloom.plans import jobs
from heartloom.schemas import REPLICATES, SEED
from heartloom.sources import tables


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=("baseline", "formal", "formal-folders", "statistics", "reliability"))
    parser.add_argument("--dataset", help="folder of recordings, for the jobs baseline and formal-folders")
    parser.add_argument("--model", help="face model file, for the jobs baseline and formal-folders")
    parser.add_argument("--baseline", help="output of a baseline run, for the job formal-folders")
    parser.add_argument("--subjects", nargs="*", help="names of subjects, for the job baseline; all if left out")
    parser.add_argument("--max-frames", type=int, help="first frames of each recording, for the job baseline")
    parser.add_argument("--candidates")
    parser.add_argument("--references")
    parser.add_argument("--traces", help="long traces of the original recordings, Parquet")
    parser.add_argument("--shifted", help="long traces of the shifted regions, Parquet; formal-folders measures them itself if left out")
    parser.add_argument("--output", required=True)
    parser.add_argument("--replicates", type=int, default=REPLICATES)
    parser.add_argument("--seed", type=int, default=SEED)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"heartloom-{a.job}").getOrCreate()
    if a.job == "baseline":
        out = jobs.baseline_from_folders(spark, a.dataset, FaceMesh(a.model), a.output, a.subjects, a.max_frames)
    elif a.job == "formal":
        out = jobs.formal_run(spark, tables.read_references(spark, a.references), spark.read.parquet(a.traces), spark.read.parquet(a.shifted), a.output)
    elif a.job == "formal-folders":
        out = jobs.formal_run_from_folders(spark, a.dataset, a.model, a.baseline, a.shifted, a.output)
    else:
        job = jobs.statistics if a.job == "statistics" else jobs.reliability_model
        out = job(spark, a.candidates, a.output, a.replicates, a.seed)
    print(json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
