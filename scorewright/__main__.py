"""Command line: `python -m scorewright eval --kind freeform --data questions.jsonl --predictions answers.parquet --out results`."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .operators.status import probe_report
from .plans import tasks
from .plans.config import config_names, redacted, task_catalog
from .session import build_session
from .sources.readers import DatasetConfig, dataset_catalog, load_dataset
from .sources.sinks import write_jsonl

CHECKS = "model string, kind string, name string, status string, tested boolean, ok boolean, repeats boolean"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="scorewright")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("eval", help="score a table of predictions against a data set")
    run.add_argument("--kind", required=True, choices=sorted(tasks.KINDS))
    run.add_argument("--name", default="task")
    run.add_argument("--data", required=True)
    run.add_argument("--predictions", required=True, help="Parquet with id and prediction")
    run.add_argument("--out", required=True)
    run.add_argument("--limit", type=int)
    run.add_argument("--options", type=json.loads, default={}, help="JSON: labels, schema and others of the kind")
    probe = commands.add_parser("probe", help="rate endpoints by their checks")
    probe.add_argument("checks", help="JSONL with model, kind (mode, transport or check), name, status, tested, ok and repeats")
    probe.add_argument("--out", required=True)
    for name, what in (("datasets", "data sets"), ("tasks", "task groups and subtasks"), ("models", "model configurations"), ("providers", "provider configurations")):
        listing = commands.add_parser(name, help=f"list the {what} in a folder")
        listing.add_argument("root")
        listing.add_argument("--json", action="store_true")
    commands.add_parser("kinds", help="list the task types")
    args = parser.parse_args(argv)
    if args.command == "kinds":
        print("\n".join(sorted(tasks.KINDS)))
        return
    if args.command in ("models", "providers"):
        names = config_names(args.root)
        print(json.dumps({args.command: names}) if args.json else "\n".join(names))
        return
    if args.command == "tasks":
        groups = {group: [s.key for s in subtasks] for group, subtasks in task_catalog(args.root).items()}
        print(json.dumps({"tasks": groups}) if args.json else "\n".join(line for g, keys in groups.items() for line in (g, *(f"  {k}" for k in keys))))
        return
    spark = build_session()
    if args.command == "probe":
        checks = spark.read.schema(CHECKS).json(args.checks)
        report = probe_report(checks, ["model"])
        write_jsonl(report, args.out)
        for r in report.groupBy("probe_status").agg(F.count("*").alias("n")).orderBy("probe_status").collect():
            print(r.probe_status, r.n)
        return
    if args.command == "datasets" and args.json:
        print(json.dumps({"datasets": [r.asDict(recursive=True) for r in dataset_catalog(spark, args.root).collect()]}, default=str))
        return
    if args.command == "datasets":
        for r in dataset_catalog(spark, args.root).collect():
            print(r["name"], r.path, *r.labels)
        return
    samples = load_dataset(spark, DatasetConfig(args.data, limit=args.limit))
    done = tasks.evaluate(tasks.ad_hoc(args.kind, args.name, **args.options), samples, tasks.from_table(spark.read.parquet(args.predictions)))
    done.samples.write.mode("overwrite").parquet(f"{args.out}/samples")
    write_jsonl(done.metrics, f"{args.out}/metrics")
    for name, df in done.artifacts.items():
        df.write.mode("overwrite").parquet(f"{args.out}/{name}")
    print(json.dumps({"arguments": redacted(argv or []), "metrics": f"{args.out}/metrics"}))


if __name__ == "__main__":
    main()
