"""Named operators with checked parameters, and chains of them (UDF-01, UDF-02, UDF-04)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Operator:
    """UDF-01: a function of a DataFrame and parameters. `parameters`: name to type; those in `required` must be given."""

    name: str
    run: Callable[..., DataFrame]
    parameters: dict[str, type | tuple[type, ...]] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def problems(self, given: dict[str, Any]) -> list[str]:
        out = [f"{k} is missing" for k in self.required if k not in given]
        out += [f"{k} is unknown" for k in given if k not in self.parameters]
        return out + [f"{k} has the wrong type" for k, v in given.items() if k in self.parameters and not isinstance(v, self.parameters[k])]

    def call(self, df: DataFrame, **given: Any) -> dict[str, Any]:
        """An envelope: success, data (a DataFrame that has not run yet) or error, and seconds for planning it."""
        start, bad = time.perf_counter(), self.problems(given)
        data, error = None, "; ".join(bad) or None
        if not bad:
            try:
                data = self.run(df, **given)
            except Exception as e:  # what is wrong goes into the envelope
                error = f"{type(e).__name__}: {e}"
        return {"success": error is None, "data": data, "error": error, "seconds": time.perf_counter() - start}


class Registry:
    """UDF-02."""

    def __init__(self) -> None:
        self._known: dict[str, Operator] = {}

    def register(self, operator: Operator) -> Operator:
        self._known[operator.name] = operator
        return operator

    def unregister(self, name: str) -> bool:
        return self._known.pop(name, None) is not None

    def get(self, name: str) -> Operator | None:
        return self._known.get(name)

    def names(self) -> list[str]:
        return sorted(self._known)

    def call(self, name: str, df: DataFrame, **given: Any) -> dict[str, Any]:
        if name not in self._known:
            return {"success": False, "data": None, "error": f"no operator {name}", "seconds": 0.0}
        return self._known[name].call(df, **given)

    def chain(self, df: DataFrame, steps: list[tuple[str, dict[str, Any]]]) -> dict[str, Any]:
        """UDF-04: operators one after another, as one plan; it stops at the first that fails."""
        status: list[dict[str, Any]] = []
        for name, given in steps:
            got = self.call(name, df, **given)
            status.append({"step": name, "success": got["success"], "error": got["error"]})
            if not got["success"]:
                return {"success": False, "data": None, "steps": status}
            df = got["data"]
        return {"success": True, "data": df, "steps": status}


#: The library's own.
REGISTRY = Registry()
