"""Driver-side configuration: merging, validation, catalogs, names and secrets. Nothing here grows with the data."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

try:
    import yaml
except ImportError:  # JSON is read and written without it
    yaml = None

#: Groups in order of their place in reference tables.
GROUP_ORDER = ("latam_pr", "latam_es", "translation", "structured_extraction", "transcription")
#: Task types.
TASK_TYPES = ("classification", "structured", "freeform")
#: Metrics that a summary leaves out, and the objects that it keeps.
SUMMARY_SKIPS = (
    "total_samples", "valid_samples", "error_count", "throughput", "total_duration", "samples_with_type_errors", "numeric_fields_total", "numeric_fields_correct", "imperfect_sample_count",
    "match_distribution_counts", "subtasks",
)
SUMMARY_OBJECTS = ("diagnostic_counts", "diagnostic_rates", "performance_summary")
DEFAULT_FIELDS = {"classification": {"input_field": "text", "output_field": "label"}, "structured": {"input_field": "text", "output_field": "expected"}, "freeform": {"input_field": "text", "output_field": "expected"}}
SECRET_FLAG = re.compile(r"(?i)(api[-_]?key|token|secret|password|authorization)")


def deep_merge(*layers: dict[str, Any] | None) -> dict[str, Any]:
    """Later layers win; objects are merged key by key."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def validate_task(config: dict[str, Any]) -> list[str]:
    """Faults of a task configuration, none if it is sound."""
    faults = []
    kind = config.get("task_type")
    if kind not in TASK_TYPES:
        faults.append(f"task_type must be one of {', '.join(TASK_TYPES)}")
    data = config.get("dataset") or {}
    if not data.get("name"):
        faults.append("dataset.name is missing")
    if data.get("source", "auto") not in ("auto", "local", "jsonl", "parquet", "directory", "huggingface", "hub"):
        faults.append(f"unknown dataset.source {data.get('source')}")
    if kind == "classification" and not (data.get("labels") or data.get("choices_field")):
        faults.append("classification needs labels or choices_field")
    labels = data.get("labels")
    if isinstance(labels, str):
        try:
            labels = json.loads(labels)
        except ValueError:
            faults.append("labels are no JSON")
    if kind == "classification" and labels and not isinstance(labels, dict):
        faults.append("labels must map values to texts")
    if kind == "structured" and not any(k in d for d in (data, config) for k in ("schema", "schema_field", "schema_path", "schema_json")):
        faults.append("structured needs a schema")
    return faults


def with_task_defaults(config: dict[str, Any]) -> dict[str, Any]:
    return deep_merge({"dataset": DEFAULT_FIELDS.get(config.get("task_type", ""), {})}, config)


def expand_groups(tasks: list[str], groups: dict[str, list[str]]) -> list[str]:
    """Groups become their tasks, at any depth; each task once, in order of first mention; a group inside itself is passed over."""
    out: dict[str, None] = {}

    def add(name: str, seen: frozenset[str]) -> None:
        if name in groups and name not in seen:
            for x in groups[name]:
                add(x, seen | {name})
        elif name not in groups:
            out[name] = None

    for t in tasks:
        add(t, frozenset())
    return list(out)


def allowed_tasks(tasks: list[str], allowed: list[str] | None) -> list[str]:
    """Tasks that a provider may run: itself or its group is listed."""
    return tasks if allowed is None else [t for t in tasks if t in allowed or t.split(".")[0] in allowed]


def compatible(needs: dict[str, str], offers: dict[str, bool]) -> tuple[bool, list[str]]:
    """Whether every required capability is offered, and what preferred ones are not. Levels: required, preferred, optional."""
    missing = [c for c, level in needs.items() if level == "required" and not offers.get(c, False)]
    return not missing, missing or [c for c, level in needs.items() if level == "preferred" and not offers.get(c, False)]


def restricted(offers: dict[str, bool], limits: dict[str, bool]) -> dict[str, bool]:
    """Capabilities can be taken away, never added."""
    return {c: v and limits.get(c, True) for c, v in offers.items()}


def run_id(stamp: str, test: bool = False, limited: bool = False) -> str:
    return stamp + "_TEST" * test + "_LIMITED" * limited


def redacted(argv: list[str]) -> list[str]:
    """Values of secret flags are masked, as `--flag value` and `--flag=value`."""
    out, hide = [], False
    for a in argv:
        name, eq, _ = a.partition("=")
        if hide:
            a, hide = "***", False
        elif a.startswith("-") and SECRET_FLAG.search(name):
            a, hide = (f"{name}=***", False) if eq else (a, True)
        out.append(a)
    return out


@dataclass(frozen=True)
class Subtask:
    group: str
    name: str
    primary_metric: str | None = None
    config: dict[str, Any] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return f"{self.group}.{self.name}"


def parsed_document(text: str) -> Any:
    """JSON, or YAML where a YAML parser is installed."""
    try:
        return json.loads(text)
    except ValueError:
        if yaml is None:
            raise
        return yaml.safe_load(text)


def metadata_files(root: str, pattern: str = "*") -> list[Path]:
    """metadata.json or metadata.yaml of the folders below root, in order; private folders and `common` are passed over."""
    found = {p.parent: p for name in ("metadata.yaml", "metadata.json") for p in Path(root).glob(f"{pattern}/{name}")}
    return [found[k] for k in sorted(found) if not k.name.startswith("_") and k.name != "common"]


def task_catalog(root: str) -> dict[str, list[Subtask]]:
    """Groups by folder: its metadata names the group's subtasks and defaults."""
    out = {}
    for path in metadata_files(root):
        meta = parsed_document(path.read_text()) or {}
        names = meta.get("subtasks") or {path.parent.name: {}}
        names = names if isinstance(names, dict) else dict.fromkeys(names, {})
        out[path.parent.name] = [Subtask(path.parent.name, n, (c or {}).get("primary_metric", meta.get("primary_metric")), deep_merge(meta.get("defaults"), c)) for n, c in names.items()]
    return out


def resolve_task(ref: str, catalog: dict[str, list[Subtask]]) -> list[Subtask]:
    """`group` or `group.subtask`; an unknown reference raises."""
    group, _, name = ref.partition(".")
    found = [s for s in catalog.get(group, []) if not name or s.name == name]
    if not found:
        raise KeyError(ref)
    return found


def reference_rows(catalog: dict[str, list[Subtask]]) -> list[tuple[str, str, str | None]]:
    """(group, subtask, primary metric) for reference tables."""
    return [(s.group, s.name, s.primary_metric) for subtasks in catalog.values() for s in subtasks]


def reference_tables(root: str, order: tuple[str, ...] = GROUP_ORDER) -> tuple[dict[str, Any], dict[str, Any]]:
    """Tasks and groups by name, for leaderboards: of metadata that names a group, groups in the given order, then by name."""
    by_group: dict[str, list[tuple[str, dict]]] = {}
    for path in metadata_files(root, "**"):
        try:
            meta = parsed_document(path.read_text())
        except Exception:  # of either parser: a broken file is passed over
            continue
        if isinstance(meta, dict) and meta.get("group"):
            by_group.setdefault(meta["group"], []).append((path.parent.name, meta))
    tasks, groups = {}, {}
    for group in [g for g in order if g in by_group] + sorted(set(by_group) - set(order)):
        for folder, meta in by_group[group]:
            own = meta.get("group_metadata") or {"name": meta.get("display_name", folder), "description": meta.get("description", "")}
            entry = groups.setdefault(group, dict(own) | {"subtasks": []})
            subtasks = meta.get("subtasks") or {}
            about = meta.get("task_metadata") or (subtasks if isinstance(subtasks, dict) else {})
            for name in subtasks if isinstance(subtasks, (dict, list)) else []:
                if not (isinstance(name, str) and about.get(name)):
                    continue
                row = {"name": name, "group": group} | about[name]
                url = None if "URL" in row else row.pop("url", None) or row.pop("Url", None)
                tasks[name] = row | ({"URL": url} if url else {})
                if name not in entry["subtasks"]:
                    entry["subtasks"].append(name)
    return {"tasks": tasks}, {"task_groups": groups}


def emitted_config(model: str, provider: str, tasks: list[str], options: dict[str, Any] | None = None, form: str = "json") -> str:
    """A run configuration, empty sections left out, as JSON (which YAML readers take too) or, where a YAML library is installed, as YAML."""

    def full(node: Any) -> Any:
        if not isinstance(node, dict):
            return node
        return {k: v for k, v in ((k, full(v)) for k, v in node.items()) if v is not None and v != {}}

    found = full(deep_merge({"model": {"name": model}, "provider_type": provider, "tasks": tasks}, options))
    if form == "yaml" and yaml is not None:
        return yaml.safe_dump(found, sort_keys=False, allow_unicode=True)
    return json.dumps(found, indent=2, ensure_ascii=False) + "\n"


def config_faults(config: dict[str, Any]) -> list[str]:
    """What an emitted configuration lacks to be run."""
    named = (config.get("model") or {}).get("name")
    return [f"{name} is missing" for name, there in (("model.name", named), ("tasks", config.get("tasks"))) if not there]


def summarized(metrics: dict[str, Any], names: list[str] | None = None) -> dict[str, Any]:
    """Numbers of a task's metrics, those in names if there are any, with the objects that summaries keep; subtasks by themselves."""
    inner = metrics.get("subtasks")
    if isinstance(inner, dict):
        return {"subtasks": {k: summarized({n: v for n, v in m.items() if n != "subtasks"}, names) for k, m in inner.items()}}
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    kept = [n for n in names if n in metrics] if names else [n for n in metrics if n not in SUMMARY_SKIPS]
    return {n: float(metrics[n]) for n in kept if number(metrics[n])} | {n: metrics[n] for n in SUMMARY_OBJECTS if isinstance(metrics.get(n), dict)}


def canonical_task(key: str) -> str:
    """Dashes after the first dot are underscores."""
    head, dot, tail = key.partition(".")
    return head + dot + tail.replace("-", "_")


def run_summary(model: str, run: str, stamp: str, *layers: dict[str, dict]) -> dict[str, Any]:
    """Summaries by task, a later layer winning a task and its spelling; diagnostics are summed over tasks, rates to six places."""
    tasks: dict[str, Any] = {}
    for layer in layers:
        for key, metrics in layer.items():
            same = next((k for k in tasks if canonical_task(k) == canonical_task(key)), None)
            tasks.pop(same, None)
            tasks[key] = metrics
    counts: dict[str, int] = {}
    leaves = [m for t in tasks.values() for m in (t["subtasks"].values() if isinstance(t.get("subtasks"), dict) else [t])]
    for m in leaves:
        for k, n in m.get("diagnostic_counts", {}).items():
            counts[k] = counts.get(k, 0) + n
    total = sum(counts.values())
    diagnostics = {"counts": counts, "rates": {k: round(n / total, 6) for k, n in counts.items()}} if total else {}
    return {"model": model, "run_id": run, "timestamp": stamp, "tasks": tasks, "diagnostics": diagnostics}


def run_outcome(model: str, run: str, started: datetime, ended: datetime, records: dict[str, dict[str, Any]], policy: str = "relaxed", summary: dict[str, Any] | None = None) -> dict[str, Any]:
    """What automation reads of a run: statuses and their counts, exit code, times, diagnostics. records: by task, with status, completed and subtasks."""
    statuses = [r.get("status") or "pending" for r in records.values()]
    inner = [s.get("status") or "pending" for r in records.values() for s in (r.get("subtasks") or {}).values() if isinstance(s, dict)]
    bad, poor = {"failed", "error", "pending"}, {"degraded", "skipped", "no_samples"}
    blocks = {"smoke": bad | poor - {"degraded"}, "strict": set(statuses) - {"passed"}}.get(policy.lower(), set())
    counts = {f"{s}_tasks": statuses.count(s) for s in ("passed", "degraded", "skipped", "no_samples", "pending", "error", "failed")}
    counts |= {"requested_tasks": len(records), "completed_tasks": sum(bool(r.get("completed")) for r in records.values()), "non_passing_tasks": sum(s in bad | {"skipped", "no_samples"} for s in statuses)}
    counts |= {"requested_subtasks": len(inner), "passed_subtasks": inner.count("passed")}
    return {
        "schema_version": "1.0", "model": model, "run_id": run, "started_at": started.isoformat(), "ended_at": ended.isoformat(), "duration_s": round(max(0.0, (ended - started).total_seconds()), 6),
        "status": "failed" if bad & set(statuses) else "degraded" if poor & set(statuses) else "passed", "exit_policy": policy, "exit_code": int(bool(blocks & set(statuses))),
        "counts": counts, "tasks": records, "diagnostics": (summary or {}).get("diagnostics", {}),
    }


def config_names(root: str) -> list[str]:
    """Configurations directly in a folder, by name without their suffix."""
    return sorted({p.stem for p in Path(root).glob("*") if p.suffix in (".json", ".yaml", ".yml")})


def model_config(model: str, root: str) -> str | None:
    """The first configuration file below a folder that gives the model's full name as its own; else one that is called so. Files that can't be read are passed over."""
    files = [p for p in sorted(Path(root).rglob("*")) if p.suffix in (".json", ".yaml", ".yml")]
    for path in files:
        try:
            found = parsed_document(path.read_text())
        except Exception:  # of either parser
            continue
        own = found.get("model") if isinstance(found, dict) else None
        if isinstance(own, dict) and own.get("name") == model:
            return str(path)
    called = [p for n in (model.replace("/", "_"), model.rsplit("/", 1)[-1]) for p in files if p.stem == n]
    return str(called[0]) if called else None
