"""Checks that users bring: Python functions over the hits of a row, and columns that may fail, each without ending the job."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

#: Arguments of a check: the value, the whole text, the country of the rule and its parameters.
MOST_ARGUMENTS = 4
_PLAIN, _PANDAS, _ARROW = "plain", "pandas", "arrow"
_KINDS = {
    PythonEvalType.SQL_BATCHED_UDF: (_PLAIN, False),
    PythonEvalType.SQL_ARROW_BATCHED_UDF: (_PLAIN, False),
    PythonEvalType.SQL_SCALAR_PANDAS_UDF: (_PANDAS, False),
    PythonEvalType.SQL_SCALAR_PANDAS_ITER_UDF: (_PANDAS, True),
    PythonEvalType.SQL_SCALAR_ARROW_UDF: (_ARROW, False),
    PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF: (_ARROW, True),
}


@dataclass(frozen=True)
class PythonCheck:
    """A Python function of a value and, if it takes them, text, country and parameters; by value or by batch."""

    function: Callable[..., Any]
    kind: str = _PLAIN
    stream: bool = False

    def arguments(self) -> int:
        """How many arguments the function takes, four at most; as many, if that cannot be told."""
        try:
            given = inspect.signature(self.function).parameters.values()
        except (TypeError, ValueError):
            return 1  # a built-in
        if any(p.kind is p.VAR_POSITIONAL for p in given):
            return MOST_ARGUMENTS
        n = sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in given)
        if not 1 <= n:
            raise ValueError("a check takes the value at least")
        return min(n, MOST_ARGUMENTS)


def python_check(function: Callable[..., Any]) -> PythonCheck:
    """Marks a plain Python function as a check of (value), (value, text), (value, text, country) or (value, text, country, parameters)."""
    return PythonCheck(function)


def as_python(check: Any) -> PythonCheck | None:
    """The Python check that a validator is, be it marked or a user-defined function of Spark; None for a function of columns."""
    if isinstance(check, PythonCheck):
        return check
    kind = _KINDS.get(getattr(check, "evalType", None))
    return None if kind is None else PythonCheck(check.func, *kind)


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Columns that are put into a DataFrame inside give null where a cast or an operation fails, whatever the session says."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _by_value(check: PythonCheck, values: list, texts: list, places: list, rest: tuple) -> list[bool]:
    """One value after the other, each answer used again for equal arguments; an error is a no."""
    n, known = check.arguments(), {}
    out = []
    for value, text, place in zip(values, texts, places, strict=True):
        key = value if n == 1 else (value, place)
        if key not in known:
            try:
                known[key] = bool(check.function(*(value, text, *rest)[:n]))
            except Exception:  # whatever a user's check raises, it fails the value and not the job
                known[key] = False
        out.append(known[key])
    return out


def _batch(check: PythonCheck, values: pa.Array, texts: pa.Array, rest: tuple) -> np.ndarray:
    """All values at once; raises what the check raises, and if it gives another number of answers."""
    n = check.arguments()
    columns = (values, texts) if check.kind == _ARROW else (values.to_pandas(), texts.to_pandas())
    given = (*columns, *rest)[:n]
    if check.stream:
        answers = list(check.function(iter([given[0] if n == 1 else given])))
        answer = answers[0] if len(answers) == 1 else None
    else:
        answer = check.function(*given)
    out = pd.Series(answer.to_pandas() if hasattr(answer, "to_pandas") else answer)
    if len(out) != len(values):
        raise ValueError("a check gave another number of answers than there are values")
    return out.map(lambda x: x is not None and x == x and bool(x)).to_numpy(dtype=bool)


def judged(check: PythonCheck, values: pa.Array, texts: pa.Array, places: np.ndarray, rest: tuple) -> np.ndarray:
    """What a check says of each value; where it fails for a batch, value by value."""
    if not len(values):
        return np.zeros(0, dtype=bool)
    if check.kind == _PLAIN:
        return np.array(_by_value(check, values.to_pylist(), texts.to_pylist(), places.tolist(), rest), dtype=bool)
    try:
        return _batch(check, values, texts, rest)
    except Exception:
        if len(values) == 1:
            return np.zeros(1, dtype=bool)
        half = len(values) // 2  # halves, so that one bad value costs a few calls and not as many as there are values
        parts = [(0, half), (half, len(values) - half)]
        return np.concatenate([judged(check, values.slice(a, n), texts.slice(a, n), places[a : a + n], rest) for a, n in parts])


def python_verdicts(values: Column, which: Column, text: Column, checks: Sequence[tuple[PythonCheck, str, Mapping[str, Any]]]) -> Column:
    """array<boolean>: for each of an array of values what its check says, by the number of the check (-1: none, and so true).

    A batch of rows goes to Python once, for all checks; ``checks`` are (check, country, parameters).
    """

    @F.arrow_udf("array<boolean>")
    def verdicts(values: pa.Array, which: pa.Array, texts: pa.Array) -> pa.Array:
        flat, chosen = values.flatten(), which.flatten().to_numpy(zero_copy_only=False)
        rows = pc.list_parent_indices(values).to_numpy()
        out = np.ones(len(flat), dtype=bool)
        for k, (check, country, parameters) in enumerate(checks):
            at = np.flatnonzero(chosen == k)
            out[at] = judged(check, flat.take(pa.array(at)), texts.take(pa.array(rows[at])), rows[at], (country, dict(parameters)))
        sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out))

    return verdicts(values, which, text)
