"""Command line: inspect-catalog, inspect-metrics, validate-csv, ingest-local, estimate-local.

Exit codes: 0 success, 1 rows with problems or none, 2 a file, schema or job that can't be used.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.identity import record_key
from .functions.parsing import HEADERS, TIME_POLICIES, Parser
from .operators.metrics import metric_table
from .operators.reconcile import validation_report
from .plans import ingest, trajectories
from .sources.catalog import catalog_table
from .sources.rawtext import read_positions


def session() -> SparkSession:
    s = SparkSession.builder.appName("wakeline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def folder(text: str) -> Path | str:
    """A URI as it is, anything else as a local path."""
    return text if "://" in text else Path(text)


def validate_csv(spark: SparkSession, path: str, era: str, policy: str, max_records: int) -> int:
    raw = read_positions(spark, era, [dict(path=path, asset_id=Path(path).name)], max_records=max_records)
    parsed = Parser(era, policy).parse(raw)
    parsed = parsed.withColumn("record_key", record_key(F.col("raw.asset_id"), F.col("raw.row_start")))
    report = validation_report(parsed).first().asDict()
    print(json.dumps(report))
    clean = report["input_rows"] and not report["rejected"] and not report["conflict_groups"]
    return 0 if clean else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wakeline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("inspect-catalog")
    commands.add_parser("inspect-metrics")
    v = commands.add_parser("validate-csv")
    v.add_argument("path")
    v.add_argument("--era", required=True, choices=list(HEADERS))
    v.add_argument("--naive-time-policy", default="reject", choices=TIME_POLICIES)
    v.add_argument("--max-records", type=int, default=1_000_000)
    i = commands.add_parser("ingest-local")
    i.add_argument("job", type=Path)
    i.add_argument("output", type=folder)
    i.add_argument("--carried", type=folder)
    e = commands.add_parser("estimate-local")
    e.add_argument("job", type=Path)
    e.add_argument("output", type=folder)
    a = parser.parse_args(argv)
    spark = session()
    try:
        if a.command in ("inspect-catalog", "inspect-metrics"):
            table = catalog_table(spark) if a.command == "inspect-catalog" else metric_table(spark)
            print(json.dumps([r.asDict() for r in table.collect()], indent=1))
            return 0
        if a.command == "validate-csv":
            return validate_csv(spark, a.path, a.era, a.naive_time_policy, a.max_records)
        if a.command == "ingest-local":
            inputs, config = ingest.load_job(a.job)
            print(ingest.ingest(spark, inputs, config, a.output, a.carried))
            return 0
        print(trajectories.run(spark, root=a.output, **trajectories.load_job(a.job)))
        return 0
    except Exception as error:
        print(f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
