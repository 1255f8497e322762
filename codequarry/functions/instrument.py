"""Capturing calls: a wrapper that records arguments and results as short texts."""

from __future__ import annotations

import datetime
import decimal
import functools
import inspect
import json
import sys
from collections.abc import Callable

#: Characters of head and tail that stay of a long text; elements up to which arrays are written out.
HALF, ELEMENTS = 90, 25


def elided(text: str) -> str:
    return text if len(text) <= 2 * HALF else f"{text[:HALF]}  ......  {text[-HALF:]}"


def _table(value) -> str | None:
    if type(value).__module__.startswith("pandas"):
        return f"{type(value).__name__} shape={value.shape}"
    if hasattr(value, "shape") and hasattr(value, "dtype"):
        size = 1
        for n in value.shape:
            size *= int(n)
        if size > ELEMENTS:
            return f"shape={tuple(value.shape)} dtype={value.dtype}"
        listed = value.tolist() if hasattr(value, "tolist") else value
        return json.dumps(_rounded(listed))
    if hasattr(value, "nodes") and hasattr(value, "edges"):
        return f"graph nodes={len(value.nodes)} edges={len(value.edges)}"
    return None


def _rounded(x):
    if isinstance(x, list):
        return [_rounded(y) for y in x]
    return round(x, 2) if isinstance(x, float) else x


def serialized(value) -> str:
    """A short text of any value: ISO times, numbers of decimals, source of functions, shapes of
    arrays beyond 25 elements, JSON where it can be, else repr; never fails."""
    try:
        if isinstance(value, (datetime.datetime, datetime.date, datetime.time)):
            return value.isoformat()
        if isinstance(value, decimal.Decimal):
            return str(float(value))
        if inspect.isroutine(value):
            return f"<function {getattr(value, '__qualname__', value)}>"
        table = _table(value)
        if table is not None:
            return elided(table)
        try:
            return elided(json.dumps(value))
        except (TypeError, ValueError):
            return elided(repr(value))
    except Exception:
        return f"<unserializable: {type(value).__name__}>"


class CallRecorder:
    """Records every call of the functions it wraps; before and after are hooks for subclasses."""

    def __init__(self):
        self.logs: list[dict] = []

    def before(self, func: Callable, args: tuple, kwargs: dict) -> dict:
        bound = inspect.signature(func).bind(*args, **kwargs)
        bound.apply_defaults()
        frame = sys._getframe(2)
        return {
            "func_name": func.__name__, "inputs": {k: serialized(v) for k, v in bound.arguments.items()}, "input_types": {k: type(v).__name__ for k, v in bound.arguments.items()},
            "caller_info": {"func_name": frame.f_code.co_name, "lineno": frame.f_lineno},
        }

    def after(self, record: dict, result) -> None:
        self.logs.append(record | {"output": serialized(result), "output_type": type(result).__name__})

    def wrap(self, func: Callable) -> Callable:
        @functools.wraps(func)
        def inner(*args, **kwargs):
            record = self.before(func, args, kwargs)
            result = func(*args, **kwargs)
            self.after(record, result)
            return result

        return inner

    def dump(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.logs, f)
