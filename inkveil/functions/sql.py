"""Expressions built as SQL text.

The span expressions have thousands of nodes. Built through ``pyspark.sql.functions`` each
node costs several round trips to the JVM, seconds in all; as SQL text the whole expression
is sent and parsed once. The names follow ``pyspark.sql.functions``; plain strings and
numbers are literals, and ``col`` names a column or lambda variable.
"""

from __future__ import annotations

import functools
import inspect
import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as _functions

_fresh = itertools.count()


def literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value) if value >= 0 else f"({value})"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{escaped}'"


def text_of(value) -> str:
    return value.sql if isinstance(value, Expr) else literal(value)


class Expr:
    """A SQL expression, optionally with a field name."""

    def __init__(self, sql: str, name: str | None = None):
        self.sql = sql
        self.name = name

    @property
    def column(self) -> Column:
        return _functions.expr(self.sql)

    def alias(self, name: str) -> Expr:
        return Expr(self.sql, name)

    def _infix(self, op: str, other) -> Expr:
        return Expr(f"({self.sql} {op} {text_of(other)})")

    def _reverse(self, op: str, other) -> Expr:
        return Expr(f"({text_of(other)} {op} {self.sql})")

    def __eq__(self, other):  # type: ignore[override]
        return self._infix("=", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._infix("<>", other)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, other):
        return self._infix("<", other)

    def __le__(self, other):
        return self._infix("<=", other)

    def __gt__(self, other):
        return self._infix(">", other)

    def __ge__(self, other):
        return self._infix(">=", other)

    def __add__(self, other):
        return self._infix("+", other)

    def __sub__(self, other):
        return self._infix("-", other)

    def __rsub__(self, other):
        return self._reverse("-", other)

    def __mul__(self, other):
        return self._infix("*", other)

    def __mod__(self, other):
        return self._infix("%", other)

    def __floordiv__(self, other):
        """Integer division; the positions it is used on fit an int."""
        return Expr(f"cast({self.sql} div {text_of(other)} as int)")

    def __neg__(self):
        return Expr(f"(- {self.sql})")

    def __and__(self, other):
        return self._infix("and", other)

    def __or__(self, other):
        return self._infix("or", other)

    def __invert__(self):
        return Expr(f"(not {self.sql})")

    def __getitem__(self, field: str):
        return Expr(f"{self.sql}.`{field}`")

    def cast(self, type_: str) -> Expr:
        return Expr(f"cast({self.sql} as {type_})")

    def isNull(self):  # noqa: N802
        return Expr(f"({self.sql} is null)")

    def isNotNull(self):  # noqa: N802
        return Expr(f"({self.sql} is not null)")

    def isin(self, values: list):
        return Expr(f"({self.sql} in ({', '.join(map(literal, values))}))") if values else Expr("false")

    def rlike(self, regex: str):
        return call("rlike", self, regex)

    def contains(self, part):
        return call("contains", self, part)

    def startswith(self, part):
        return call("startswith", self, part)

    def endswith(self, part):
        return call("endswith", self, part)


class Case(Expr):
    """An open CASE, as ``when`` gives it."""

    def __init__(self, arms: str):
        super().__init__(f"(case {arms} end)")
        self.arms = arms

    def when(self, condition: Expr, value) -> Case:
        return Case(f"{self.arms} when {condition.sql} then {text_of(value)}")

    def otherwise(self, value) -> Expr:
        return Expr(f"(case {self.arms} else {text_of(value)} end)")


def when(condition: Expr, value) -> Case:
    return Case(f"when {condition.sql} then {text_of(value)}")


def call(name: str, *args) -> Expr:
    return Expr(f"{name}({', '.join(map(text_of, args))})")


def __getattr__(name: str):
    """Any other name is the SQL function of that name."""
    if name.startswith("_"):
        raise AttributeError(name)
    return functools.partial(call, name)


def lit(value) -> Expr:
    return Expr(literal(value))


def col(name: str) -> Expr:
    return Expr(name)


def struct(*fields: Expr) -> Expr:
    return Expr(f"named_struct({', '.join(f'{literal(f.name)}, {f.sql}' for f in fields)})")


def _lambda(fn: Callable[..., Expr]) -> Expr:
    """A SQL lambda; variables get names of their own, so bodies can be nested freely."""
    names = [f"v{next(_fresh)}" for _ in inspect.signature(fn).parameters]
    body = text_of(fn(*map(Expr, names)))
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return Expr(f"{head} -> {body}")


def transform(xs: Expr, fn) -> Expr:
    return call("transform", xs, _lambda(fn))


def transform_values(xs: Expr, fn) -> Expr:
    return call("transform_values", xs, _lambda(fn))


def filter(xs: Expr, fn) -> Expr:  # noqa: A001
    return call("filter", xs, _lambda(fn))


def exists(xs: Expr, fn) -> Expr:
    return call("exists", xs, _lambda(fn))


def forall(xs: Expr, fn) -> Expr:
    return call("forall", xs, _lambda(fn))


def zip_with(a: Expr, b: Expr, fn) -> Expr:
    return call("zip_with", a, b, _lambda(fn))


def aggregate(xs: Expr, init, step, finish=None) -> Expr:
    args = [xs, init, _lambda(step)]
    return call("aggregate", *args, *([_lambda(finish)] if finish else []))


def expression(fn):
    """Let a function of expressions be called with column names (or SQL text) too.

    Called with an ``Expr`` it returns an ``Expr``, for use inside other expressions; called
    with strings only it returns a ``Column``. Parameters marked ``str`` are plain values.
    """
    signature = inspect.signature(fn)
    columns = [n for n, p in signature.parameters.items() if str(p.annotation).startswith("Expr")]

    @functools.wraps(fn)
    def wrapped(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        given = {n: bound.arguments[n] for n in columns if bound.arguments.get(n) is not None}
        if any(isinstance(v, Column) for v in given.values()):
            raise TypeError(f"{fn.__name__} takes column names or SQL text, not Column objects")
        inner = any(isinstance(v, Expr) for v in given.values())
        bound.arguments.update({n: Expr(v) if isinstance(v, str) else v for n, v in given.items()})
        result = fn(*bound.args, **bound.kwargs)
        return result if inner else result.column

    return wrapped
