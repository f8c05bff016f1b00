"""The command line, and scripts that submit it. Spark distributes the work of a job; job numbers remain for
jobs that are split over several submissions."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="labelgrid", description="runs one query of the catalogue over a folder of tables and writes its rows")
    p.add_argument("-t", "--task", required=True, help="name of the query")
    p.add_argument("-i", "--input", required=True, help="folder of Parquet tables")
    p.add_argument("-o", "--output", required=True, help="folder for the rows, as Parquet")
    p.add_argument("-ji", "--job-id", type=int, default=0)
    p.add_argument("-jn", "--job-num", type=int, default=1, help="writes only rows of this job's share, by the hash of the row")
    p.add_argument("-p", "--partitions", type=int, default=0, help="number of shuffle partitions")
    return p


def submit_script(command: str, name: str, job_id: int = 0, job_num: int = 1, memory: str = "50GB", cpus: int = 1, time: str = "0-12:00", partition: str = "") -> str:
    """Text of a batch script for one job; ``command`` may hold two %d for the job's number and their count."""
    lines = ["#!/bin/bash", f"#SBATCH --job-name={name}_{job_id}", f"#SBATCH --mem={memory}", f"#SBATCH --cpus-per-task={cpus}", f"#SBATCH --time={time}"]
    lines += [f"#SBATCH --partition={partition}"] if partition else []
    return "\n".join([*lines, command % (job_id, job_num) if "%d" in command else command]) + "\n"


def submit_scripts(command: str, name: str, job_num: int, **options) -> list[str]:
    return [submit_script(command, name, i, job_num, **options) for i in range(job_num)]


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.catalogue import queries

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"labelgrid {a.task}").getOrCreate()
    if a.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", a.partitions)
    rows = queries()[a.task](spark, a.input)
    if a.job_num > 1:
        rows = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(a.job_num)) == a.job_id)
    rows.write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
