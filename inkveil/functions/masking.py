"""Rewriting strategies: (value, data type) -> new value."""

from __future__ import annotations

from collections.abc import Callable

from inkveil.constants import ADDRESS_TAIL, CITY_DISTRICT, DEFAULT_PLACEHOLDER, PLACEHOLDERS, PROVINCE_CITY
from inkveil.functions import sql as F
from inkveil.functions.sql import Expr, expression


def _edges(value: Expr, head: int, stars: Expr, tail: int) -> Expr:
    return F.concat(F.left(value, head), stars, F.right(value, tail))


def _stars(n: Expr | int) -> Expr:
    return F.repeat("*", F.lit(n) if isinstance(n, int) else n)


@expression
def mask_name(value: Expr) -> Expr:
    n = F.length(value)
    return F.when(n <= 1, value).otherwise(F.concat(F.left(value, 1), _stars(n - 1)))


@expression
def mask_id_card(value: Expr) -> Expr:
    return F.when(F.length(value) < 18, value).otherwise(_edges(value, 6, _stars(8), 4))


@expression
def mask_phone(value: Expr) -> Expr:
    return F.when(F.length(value) < 11, value).otherwise(_edges(value, 3, _stars(4), 4))


@expression
def mask_bank_card(value: Expr) -> Expr:
    n = F.length(value)
    return F.when(n < 8, value).otherwise(_edges(value, 4, _stars(n - 8), 4))


@expression
def mask_address(value: Expr) -> Expr:
    """Keep the address up to its city or district.

    Only a line feed stops the search, so the class is spelled out: Java's dot also stops
    at other line breaks.
    """
    upto_district = rf"\A[^\n]*?[{PROVINCE_CITY}][^\n]*?[{CITY_DISTRICT}]"
    upto_city = rf"\A[^\n]*?[{CITY_DISTRICT}]"
    kept = F.coalesce(
        F.nullif(F.regexp_extract(value, upto_district, 0), ""),
        F.nullif(F.regexp_extract(value, upto_city, 0), ""),
        F.when(F.length(value) > 6, F.left(value, 6)).otherwise(""),
    )
    return F.when(value.isNotNull(), F.concat(kept, ADDRESS_TAIL))


@expression
def mask_email(value: Expr) -> Expr:
    at = F.instr(value, "@")
    user = F.when(at <= 2, "*").otherwise(F.concat(F.left(value, 1), "***"))
    return F.when(at == 0, value).otherwise(F.concat(user, F.substr(value, at, F.length(value))))


@expression
def mask_default(value: Expr) -> Expr:
    n = F.length(value)
    return F.when(n <= 2, _stars(n)).otherwise(_edges(value, 1, _stars(n - 2), 1))


#: Masks by data type; other types get ``mask_default``.
MASKS: dict[str, Callable[[Expr], Expr]] = {
    "name": mask_name,
    "id_card": mask_id_card,
    "phone": mask_phone,
    "address": mask_address,
    "bank_card": mask_bank_card,
    "email": mask_email,
}


@expression
def mask_value(value: Expr, type_: Expr) -> Expr:
    masked = F.when(value == "", value)
    for name, mask in MASKS.items():
        masked = masked.when(type_ == name, mask(value))
    return masked.otherwise(mask_default(value))


@expression
def replace_value(value: Expr, type_: Expr) -> Expr:
    placeholder = None
    for name, text in PLACEHOLDERS.items():
        placeholder = F.when(type_ == name, text) if placeholder is None else placeholder.when(type_ == name, text)
    return placeholder.otherwise(DEFAULT_PLACEHOLDER)


@expression
def delete_value(value: Expr, type_: Expr) -> Expr:
    return F.lit("")


Strategy = Callable[[Expr, Expr], Expr]

#: Strategies by name.
STRATEGIES: dict[str, Strategy] = {"mask": mask_value, "replace": replace_value, "delete": delete_value}


def register_strategy(name: str, strategy: Strategy) -> None:
    """Add or override a strategy by name."""
    STRATEGIES[name] = strategy


def register_functions(spark, prefix: str = "inkveil_") -> list[str]:
    """Make every strategy a SQL function of the session, ``<prefix><name>(value, type)``.

    ``<prefix>rewrite(value, type, strategy)`` takes the strategy by its name and is null for unknown ones.
    The functions are SQL expressions, which Spark puts into the plan; strategies registered later need a new call.
    """
    value, type_ = Expr("value"), Expr("type")
    bodies = {name: apply(value, type_) for name, apply in STRATEGIES.items()}
    bodies["rewrite"] = rewrite_value(value, type_, Expr("strategy"))
    made = []
    for name, body in bodies.items():
        if not name.isidentifier():
            raise ValueError(f"{name!r} cannot be part of a function's name")
        more = ", strategy string" if name == "rewrite" else ""
        spark.sql(f"create or replace temporary function {prefix}{name}(value string, type string{more}) returns string return {body.sql}")
        made.append(prefix + name)
    return made


@expression
def rewrite_value(value: Expr, type_: Expr, strategy: Expr) -> Expr:
    """New value under the named strategy; null when no strategy has that name."""
    new = None
    for name, apply in STRATEGIES.items():
        new = F.when(strategy == name, apply(value, type_)) if new is None else new.when(strategy == name, apply(value, type_))
    return new
