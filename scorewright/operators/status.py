"""Rules that turn metrics into statuses, and outputs into diagnostic classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, text
from .joins import with_skips

#: Statuses that need no further run.
DONE = ("passed", "degraded", "skipped", "no_samples")
_COUNTS = ("total_samples", "valid_samples", "error_count")
_RATES = ("error_rate", "invalid_response_rate", "connectivity_error_rate")


def derived(df: DataFrame) -> DataFrame:
    """Fills the counts and rates that follow from others; columns that are absent are null."""
    have = set(df.columns)
    c = {n: F.col(n).cast("long") if n in have else F.lit(None).cast("long") for n in (*_COUNTS, "run_samples")} | {n: F.col(n).cast("double") if n in have else F.lit(None).cast("double") for n in _RATES}
    total = F.coalesce(c["total_samples"], c["run_samples"])
    good = F.coalesce(c["valid_samples"], F.greatest(F.lit(0), total - c["error_count"]))
    good = F.when(c["valid_samples"].isNull() & (total.isNull() | c["error_count"].isNull()), F.lit(None)).otherwise(good)
    bad = F.when(c["error_count"].isNotNull(), c["error_count"]).when(total.isNotNull() & good.isNotNull(), F.greatest(F.lit(0), total - good))
    return df.withColumns({"total_samples": total, "valid_samples": good, "error_count": bad, "error_rate": F.coalesce(c["error_rate"], F.try_divide(bad.cast("double"), F.when(total != 0, total).cast("double"))), "invalid_response_rate": c["invalid_response_rate"], "connectivity_error_rate": c["connectivity_error_rate"]})


def metric_status() -> tuple[Column, Column]:
    """(status, reason) of the columns that derived() fills."""
    c = F.col
    none_valid = (c("total_samples") > 0) & (c("valid_samples") == 0)
    partial = F.coalesce(c("error_rate") > 0, F.lit(False)) | F.coalesce(c("invalid_response_rate") > 0, F.lit(False)) | F.coalesce(c("connectivity_error_rate") > 0, F.lit(False))
    rules = [
        (c("total_samples") == 0, "no_samples", "no_samples"),
        (none_valid & (c("connectivity_error_rate") == 1.0), "failed", "all_connectivity_errors"),
        (none_valid & (c("invalid_response_rate") == 1.0), "failed", "all_invalid_responses"),
        (none_valid, "failed", "no_valid_samples"),
        (c("error_rate") >= 1.0, "failed", "all_samples_failed"),
        (partial, "degraded", "partial_errors"),
    ]
    status, reason = F.lit("passed"), F.lit(None).cast("string")
    for test, s, r in reversed(rules):
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    return status, reason


def with_status(df: DataFrame) -> DataFrame:
    status, reason = metric_status()
    return derived(df).withColumns({"status": status, "reason": reason})


def subtask_statuses(metrics: DataFrame, skipped: DataFrame, key: str = "subtask") -> DataFrame:
    out = with_status(with_skips(metrics, skipped, key))
    return out.withColumns({"status": F.when(F.col("is_skipped"), "skipped").otherwise(F.col("status")), "reason": F.when(F.col("is_skipped"), F.coalesce("skip_reason", F.lit("incompatible"))).otherwise(F.col("reason"))}).drop("is_skipped", "skip_reason")


_ORDER = ("passed", "degraded", "no_samples", "skipped", "failed")
_REASONS = (None, "subtask_degraded", "subtask_no_samples", "subtask_skipped", "subtask_failure")


def severity(status: Column) -> Column:
    out = F.when(status == "error", len(_ORDER) - 1)
    for i, s in enumerate(_ORDER):
        out = out.when(status == s, i)
    return out.otherwise(0)


def task_status(subtasks: DataFrame, by: list[str]) -> DataFrame:
    """The worst status of the subtasks: failed, skipped, no_samples, degraded, passed."""
    worst = subtasks.groupBy(*by).agg(F.max(severity(F.col("status"))).alias("s"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("s") + 1)
    return worst.select(*by, pick(_ORDER).alias("status"), pick(_REASONS).alias("reason"))


def exit_code(df: DataFrame, policy: str = "relaxed", by: list[str] | None = None) -> DataFrame:
    """0 or 1: relaxed never blocks, smoke blocks on what did not run or failed, strict on all but passed."""
    s = F.coalesce(F.col("status"), F.lit("pending"))
    blocked = {"smoke": s.isin("failed", "error", "pending", "skipped", "no_samples"), "strict": s != "passed"}.get(policy.lower(), F.lit(False))
    return df.groupBy(*(by or [])).agg(F.coalesce(F.bool_or(blocked), F.lit(False)).cast("int").alias("exit_code"))


def run_status(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    s = F.coalesce(F.col("status"), F.lit("pending"))
    failed, worse = F.bool_or(s.isin("failed", "error", "pending")), F.bool_or(s.isin("degraded", "skipped", "no_samples"))
    return df.groupBy(*(by or [])).agg(F.when(failed, "failed").when(worse, "degraded").otherwise("passed").alias("run_status"))


def unfinished(tasks: DataFrame, statuses: DataFrame, key: str = "task") -> DataFrame:
    return tasks.join(statuses.filter(F.col("status").isin(*DONE)).select(key), key, "left_anti")


def generic_class(raw: Column | str) -> Column:
    x = text.col(raw)
    return F.when(x.isNull() | (x == ""), "not_applicable").when(text.looks_like_markup(x), "ocr_text_or_markup").when(text.repetition(x), "degenerate_repetition").otherwise("plain_text")


def choice_class(index: Column | str, choices: Column | str) -> Column:
    i = text.col(index)
    return F.when((i >= 0) & (i < F.size(text.col(choices))), "mc_valid").otherwise("mc_invalid")


def structured_class(raw: Column | str, schema: dict, output: Column | str | None = None) -> Column:
    """Valid against the schema or not; if no JSON: markup, cut off, repeating, or a parse error."""
    x = F.coalesce(text.col(raw), F.lit(""))
    found = jsons.json_candidate(x) if output is None else F.coalesce(text.col(output), jsons.json_candidate(x))
    count = lambda c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))
    cut = (count("{") > count("}")) & text.strip(x).rlike(r"[,{\[]$")
    return (
        F.when(jsons.validate_json(schema, empty_is_valid=False)(found), "valid_json_schema")
        .when(jsons.json_ok(found), "valid_json_non_schema")
        .when(text.looks_like_markup(x), "ocr_text_or_markup")
        .when(cut, "json_truncated")
        .when(text.repetition(x), "degenerate_repetition")
        .otherwise("json_parse_error")
    )


_CODE = r"(?:status code|error code)[:\s]+(\d{3})"
#: Issue, severity, status code, and the parts of a message that tell it; the first that fits stands.
ISSUES = (
    ("invalid_api_key", "failed", 401, ("invalid api key", "unauthorized")),
    ("forbidden", "failed", 403, ("forbidden",)),
    ("model_not_found", "failed", 404, ()),
    ("insufficient_credits", "failed", 429, ("insufficient_quota", "insufficient quota", "credits", "billing")),
    ("rate_limited", "degraded", 429, ("rate limit",)),
)
#: Parts of a message that call for the longer back-off.
RATE_WORDS = ("rate_limit", "rate limit", "429")


def status_code(message: Column | str) -> Column:
    """The three digits after "status code" or "error code", else null."""
    x = F.lower(F.coalesce(text.col(message), F.lit("")))
    return F.when(x.rlike(_CODE), F.regexp_extract(x, _CODE, 1).cast("int"))


def issue(message: Column | str, error_type: Column | str | None = None) -> Column:
    """(issue_code, severity, status_code as text) of an endpoint's error; all null where there is none."""
    said, code = F.coalesce(text.col(message), F.lit("")), status_code(message)
    x, kind = F.lower(said), F.coalesce(text.col(error_type), F.lit("")) if error_type is not None else F.lit("")
    has = lambda *parts: F.coalesce(*(F.when(F.contains(x, F.lit(p)), True) for p in parts), F.lit(False))
    fits = {name: F.coalesce(code == number, F.lit(False)) | (has(*parts) if parts else F.lit(False)) for name, _, number, parts in ISSUES}
    fits["model_not_found"] |= has("model") & has("not found")
    fits["insufficient_credits"] = has(*ISSUES[3][3])  # by its words alone: its status code is that of a rate limit
    fits["rate_limited"] |= kind == "rate_limit"
    struct = lambda name, severity, number: F.struct(name.alias("issue_code"), severity.alias("severity"), number.cast("string").alias("status_code"))
    null = F.lit(None).cast("string")
    out = F.when(said != "", struct(F.lit("access_error"), F.lit("failed"), code)).otherwise(struct(null, null, null))
    for name, severity, number, _ in reversed(ISSUES):
        out = F.when(fits[name], struct(F.lit(name), F.lit(severity), F.coalesce(code, F.lit(number)))).otherwise(out)
    return out


def retry(message: Column | str, code: Column | str, attempt: Column | str, on_4xx: bool = False) -> Column:
    """(retry, delay, error_type) after the attempt, from 1: 5, 15, 45 ... up to 120 s after a rate limit, none after other 4xx codes, else 1, 2, 4 ... up to 16 s."""
    n, c, x = text.col(attempt).cast("double"), text.col(code), F.lower(F.coalesce(text.col(message), F.lit("")))
    limited = F.coalesce(c == 429, F.lit(False)) | x.rlike("|".join(RATE_WORDS))
    struct = lambda again, delay, kind: F.struct(F.lit(again).alias("retry"), delay.alias("delay"), F.lit(kind).alias("error_type"))
    return (
        F.when(limited, struct(True, F.least(F.lit(120.0), 5 * F.pow(F.lit(3.0), n - 1)), "rate_limit"))
        .when((c >= 400) & (c < 500), struct(on_4xx, F.lit(0.0), "invalid_response"))
        .otherwise(struct(True, F.least(F.lit(16.0), F.pow(F.lit(2.0), n - 1)), "connectivity_error"))
    )


def endpoint(requested: Column | str, first: Column | str, second: Column | str, names: tuple[str, str] = ("chat", "completions")) -> Column:
    """The endpoint to use: the one asked for if it works, else the other if that does, else the one asked for; `auto` takes the first that works, or null."""
    ask, a, b = F.coalesce(text.col(requested), F.lit("auto")), F.coalesce(text.col(first), F.lit(False)), F.coalesce(text.col(second), F.lit(False))
    named = F.when(ask == names[0], F.when(a | ~b, names[0]).otherwise(names[1])).when(ask == names[1], F.when(b | ~a, names[1]).otherwise(names[0]))
    return F.when(ask.isin(*names), named).otherwise(F.when(a, names[0]).when(b, names[1]))


def probe_report(checks: DataFrame, by: list[str]) -> DataFrame:
    """Checks (kind: mode, transport or check; name, status, tested, ok, repeats) of an endpoint to probe_status and the four risk flags.

    Failed if access failed or no tested mode works; degraded if no tested transport works or any check is degraded or failed.
    """
    kind, name, s = F.col("kind"), F.col("name"), F.col("status")
    tested = lambda k: F.coalesce(F.bool_or((kind == k) & F.col("tested")), F.lit(False))
    works = lambda k, t=True: F.coalesce(F.bool_or((kind == k) & F.col("ok") & (F.col("tested") if t else F.lit(True))), F.lit(False))
    any_of = lambda test: F.coalesce(F.bool_or((kind == "check") & test), F.lit(False))
    failed = any_of((name == "access_readiness") & (s == "failed")) | (tested("mode") & ~works("mode"))
    degraded = (tested("transport") & ~works("transport")) | any_of(s.isin("degraded", "failed"))
    loops = any_of((name == "truncation") & (s == "degraded") & F.col("repeats"))
    return checks.groupBy(*by).agg(
        F.when(failed, "failed").when(degraded, "degraded").otherwise("passed").alias("probe_status"), loops.alias("truncation_risk"), (~works("transport", False)).alias("schema_unreliable"),
        loops.alias("repetition_risk"), any_of((name == "multimodal") & (s == "failed")).alias("multimodal_unreliable"),
    )


def probe_status(checks: DataFrame, by: list[str]) -> DataFrame:
    """Checks (name, ok, required, repeats) of an endpoint: failed if a required one failed, degraded if any did, with risk flags."""
    bad = ~F.coalesce(F.col("ok"), F.lit(False))
    flags = F.array_sort(F.collect_set(F.when(bad, F.concat(F.lit("check_failed:"), F.col("name"))).when(F.coalesce(F.col("repeats"), F.lit(False)), F.concat(F.lit("repetition:"), F.col("name")))))
    return checks.groupBy(*by).agg(F.when(F.bool_or(bad & F.col("required")), "failed").when(F.bool_or(bad), "degraded").otherwise("passed").alias("probe_status"), flags.alias("risk_flags"))
