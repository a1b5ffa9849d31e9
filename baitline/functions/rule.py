"""Rules as SQL text.

A rule is written once, as a function from SQL operands to a SQL expression. It is used

- in a plan, on column names: ``redact_pii("raw_text")`` is ``F.expr`` of its text, one call
  however long the rule is, and code-generated like any expression;
- on ``Column`` operands: ``redact_pii(F.lit("..."))``, bound once each as lambda variables;
- inside another rule, by ``redact_pii.sql("x.text")``;
- as the body of a SQL function (``functions.tools``).
"""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(array() AS array<string>)"


def lit(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(items) -> str:
    """A SQL array of strings."""
    return f"array({', '.join(map(lit, items))})" if items else EMPTY


def case(pairs, default: str) -> str:
    """First value whose condition holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def present(pairs, empty: str = EMPTY) -> str:
    """The array of the values whose condition holds, in order: a concatenation of one-element and
    empty arrays, which stays code-generated (a filter over an array is interpreted)."""
    return "concat(" + ", ".join(f"CASE WHEN {c} THEN array({v}) ELSE {empty} END" for c, v in pairs) + ")"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def rule(build: Callable[..., str]) -> Callable[..., Column]:
    """A rule that takes column names or ``Column`` operands; ``.sql`` is its text."""
    @wraps(build)
    def made(*operands: str | Column) -> Column:
        if all(isinstance(o, str) for o in operands):
            return F.expr(build(*operands))
        columns = [F.expr(o) if isinstance(o, str) else o for o in operands]
        bound = F.array(F.struct(*[c.alias(f"a{i}") for i, c in enumerate(columns)]))
        text = build(*[f"bound.a{i}" for i in range(len(columns))])
        return F.get(F.call_function("transform", bound, F.expr(f"bound -> {text}")), F.lit(0))

    made.sql = build
    return made


class Stages:
    """Rules that build on each other, level by level: ``{name: text}`` with ``{name}`` for the
    inputs and for the names of earlier levels."""

    def __init__(self, *levels: dict[str, str]) -> None:
        self.levels = levels

    def add(self, df, names: dict[str, str]):
        """The levels as columns of ``df``, one projection each, so that each value is computed once.
        ``names``: the column of each input, and of each name that is not its own column."""
        for level in self.levels:
            names = {n: n for n in level} | names
            df = df.withColumns({names[n]: F.expr(text.format(**names)) for n, text in level.items()})
        return df

    def nested(self, inputs: dict[str, str], outputs: list[str]) -> str:
        """The same as one expression: a struct of ``outputs``; each level is bound once."""
        held = list(inputs)
        fields = ", ".join(f"{lit(n)}, {v}" for n, v in inputs.items())
        text = f"named_struct({fields})"
        for i, level in enumerate(self.levels):
            var = f"level{i}"
            names = {n: f"{var}.{n}" for n in held}
            passed = ", ".join(f"{lit(n)}, {names[n]}" for n in held)
            new = ", ".join(f"{lit(n)}, {t.format(**names)}" for n, t in level.items())
            text = let(var, text, f"named_struct({passed}, {new})")
            held += list(level)
        return let("done", text, "named_struct(" + ", ".join(f"{lit(n)}, done.{n}" for n in outputs) + ")")
