"""Parameterised search (F5-F8): one optional attribute out of a whitelist.

A spec maps each searchable attribute to a function ``value -> Column | None`` (None: no
condition). The three filter layers of the reference are kept apart:

* ``base``: always applied (employees and orders are always active-only);
* ``default``: applied only when no search is given (suppliers and products show active rows);
* the attribute predicate: applied when both the attribute and the value are non-empty. An
  unknown attribute adds no condition and does not bring the default back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.expr import contains_ci, parse_flag, parse_tristate, text_equals

Predicate = Callable[[str], "Column | None"]


def by_id(c: str) -> Predicate:
    return lambda v: F.col(c) == F.lit(int(v))


def by_text(c: str) -> Predicate:
    return lambda v: contains_ci(c, v)


def by_text_equal(c: str) -> Predicate:
    """``col = lower(v)`` under a case-insensitive collation."""
    return lambda v: text_equals(c, v)


def by_flag(c: str = "is_valid") -> Predicate:
    return lambda v: F.col(c) == F.lit(parse_flag(v))


def by_tristate(c: str = "is_valid") -> Predicate:
    def pred(v):
        flag = parse_tristate(v)
        return None if flag is None else F.col(c) == F.lit(flag)
    return pred


def by_money(c: str) -> Predicate:
    """Exact decimal equality (the reference binds a float; a decimal literal avoids binary
    rounding on the comparison)."""
    return lambda v: F.col(c) == F.lit(Decimal(str(v).strip()))


def by_int(c: str) -> Predicate:
    return lambda v: F.col(c) == F.lit(int(v))


@dataclass
class SearchSpec:
    attributes: dict[str, Predicate]
    base: Callable[[], Column] | None = None
    default: Callable[[], Column] | None = None
    # predicates that must run after aggregation (HAVING) are listed here by attribute name
    after_aggregate: set[str] = field(default_factory=set)


def condition(spec: SearchSpec, search_by: str | None, value: str | None) -> Column | None:
    """The attribute predicate for a request, or None."""
    if search_by and value:
        make = spec.attributes.get(search_by)
        return make(value) if make is not None else None
    return None


def apply_search(df: DataFrame, spec: SearchSpec, search_by: str | None = None, value: str | None = None,
                 stage: str = "where") -> DataFrame:
    """Apply base, default and attribute conditions for one stage ('where' before aggregation,
    'having' after it)."""
    conds: list[Column] = []
    searching = bool(search_by and value)
    if stage == "where":
        if spec.base is not None:
            conds.append(spec.base())
        if not searching and spec.default is not None:
            conds.append(spec.default())
    attr_stage = "having" if search_by in spec.after_aggregate else "where"
    if searching and attr_stage == stage:
        c = condition(spec, search_by, value)
        if c is not None:
            conds.append(c)
    for c in conds:
        df = df.where(c)
    return df
