"""Attempts of a model call inside a task. Spark repeats lost tasks; this repeats calls that an endpoint refused."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from ..operators.status import RATE_WORDS

#: (exception, attempt from 1) -> whether to try again, after how many seconds, and the kind of the error.
Decision = Callable[[Exception, int], tuple[bool, float, str]]


def status_of(error: Exception) -> int | None:
    """The status code that the error, or the response it carries, names."""
    codes = (getattr(holder, "status_code", None) for holder in (getattr(error, "response", None), error))
    return next((c for c in codes if isinstance(c, int)), None)


def decide(error: Exception, attempt: int, on_4xx: bool = False) -> tuple[bool, float, str]:
    """As operators.status.retry has it for tables of errors."""
    code, said = status_of(error), str(error).lower()
    if code == 429 or any(w in said for w in RATE_WORDS):
        return True, min(120.0, 5.0 * 3.0 ** (attempt - 1)), "rate_limit"
    if code is not None and 400 <= code < 500:
        return on_4xx, 0.0, "invalid_response"
    return True, min(16.0, 2.0 ** (attempt - 1)), "connectivity_error"


def attempted(call: Callable[[], Any], attempts: int = 3, decision: Decision = decide, wait: Callable[[float], None] = time.sleep) -> tuple[Any, str | None, str | None]:
    """(result, None, None) of the first attempt that succeeds, else (None, the last error, its kind)."""
    said, kind = "no attempt", None
    for attempt in range(1, attempts + 1):
        try:
            return call(), None, None
        except Exception as e:
            again, delay, kind = decision(e, attempt)
            said = f"{type(e).__name__}: {e}"
            if not again or attempt == attempts:
                break
            wait(delay)
    return None, said, kind
