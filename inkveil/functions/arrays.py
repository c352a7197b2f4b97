"""Helpers shared by the array expressions."""

from __future__ import annotations

from collections.abc import Callable

from inkveil.functions import sql as F
from inkveil.functions.sql import Expr

def let(value: Expr, body: Callable[[Expr], Expr]) -> Expr:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it.

    A separate ``select`` does not give that guarantee: the optimizer may merge the two
    projections and then evaluate ``value`` once per element inside a lambda.
    """
    return F.get(F.transform(F.array(value), body), 0)


def empty(element: str) -> Expr:
    return F.array().cast(f"array<{element}>")


def null(type_: str) -> Expr:
    return F.lit(None).cast(type_)


#: Arrays up to this length are not worth cutting into blocks.
SHORT = 16


def running(values: Expr, op: Callable[[Expr, Expr], Expr]) -> Expr:
    """For every element, ``op`` folded over the elements before it, starting from 0.

    ``op`` is addition or the maximum. A fold that gathers an array copies the array at every
    step, so it is quadratic in the size of the array; here folds carry one number. They run
    over the block of the element and over the totals of the blocks before it. With blocks
    as long as the cube root of the size, that takes about k ** (4 / 3) steps for k elements.
    """

    def fold(xs: Expr) -> Expr:
        return F.aggregate(xs, 0, op)

    def by_block(xs: Expr) -> Expr:
        length = F.greatest(F.ceil(F.cbrt(F.size(xs))).cast("int"), 1)
        starts = F.sequence(0, F.greatest(F.size(xs) - 1, 0), length)
        totals = F.transform(starts, lambda s: fold(F.slice(xs, s + 1, length)))

        def prefix(env: Expr) -> Expr:
            before, n = env["before"], env["length"]
            return F.transform(
                xs, lambda _, i: op(F.get(before, i // n), fold(F.slice(xs, i - i % n + 1, i % n)))
            )

        def sum_up(sums: Expr) -> Expr:
            before = F.transform(sums, lambda _, j: fold(F.slice(sums, 1, j)))
            return let(F.struct(length.alias("length"), before.alias("before")), prefix)

        short = F.transform(xs, lambda _, i: fold(F.slice(xs, 1, i)))
        return F.when(F.size(xs) <= SHORT, short).otherwise(let(totals, sum_up))

    return let(values, by_block)


def gathered(xs: Expr, state: Expr, step: Callable[[Expr, Expr], Expr], element: str) -> Expr:
    """A fold that gives something for each element: ``struct<state, out>``.

    ``step(state, x)`` is a struct of the new ``state`` and an ``item`` of type ``element``. What is
    gathered goes by blocks as long as the square root of the size, since the array is copied at every step:
    k elements take k ** (3 / 2) copies.
    """

    def by_block(ys: Expr) -> Expr:
        length = F.greatest(F.ceil(F.sqrt(F.size(ys))).cast("int"), 1)
        starts = F.when(F.size(ys) > 0, F.sequence(0, F.greatest(F.size(ys) - 1, 0), length)).otherwise(empty("int"))

        def one(acc: Expr, x: Expr) -> Expr:
            return let(
                step(acc["state"], x),
                lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["item"])).alias("out")),
            )

        def block(acc: Expr, start: Expr) -> Expr:
            init = F.struct(acc["state"].alias("state"), empty(element).alias("out"))
            return let(
                F.aggregate(F.slice(ys, start + 1, length), init, one),
                lambda r: F.struct(r["state"].alias("state"), F.concat(acc["chunks"], F.array(r["out"])).alias("chunks")),
            )

        init = F.struct(state.alias("state"), empty(f"array<{element}>").alias("chunks"))
        return let(
            F.aggregate(starts, init, block),
            lambda r: F.struct(r["state"].alias("state"), F.flatten(r["chunks"]).alias("out")),
        )

    return let(xs, by_block)


def add(a: Expr, b: Expr) -> Expr:
    return a + b


def larger(a: Expr, b: Expr) -> Expr:
    return F.greatest(a, b)
