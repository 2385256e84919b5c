"""Aggregates as monoids: a partial state for any stretch of rows, and a way to join those of two neighbours.

A pane over the last rows of a key is the end of one block of rows and the start of the next. With a state that
grows row by row inside a block, and a join of two states, every pane costs the same however long it is. `of`
tells which aggregates have such a state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession, functions as F

#: A state is a struct of aggregates, of which none depends on the order of rows.
Parts = dict[str, Column]


@dataclass(frozen=True)
class Monoid:
    """`parts` are the aggregates a state is made of, `join` puts the parts of two states together and `finish`
    gives the result. A state without rows is a null struct, so each of its parts is null."""

    parts: Parts
    join: Callable[[Column, Column], Parts]
    finish: Callable[[Column], Column]


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _counts(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _single(part: Column, join: Callable[[Column, Column], Column]) -> Monoid:
    return Monoid({"v": part}, lambda a, b: {"v": join(a["v"], b["v"])}, lambda s: s["v"])


def _count(*values: Column) -> Monoid:
    return _single(F.count(*values), _counts)


def _sum(x: Column) -> Monoid:
    return _single(F.sum(x), _added)


def _avg(x: Column) -> Monoid:
    """Sums of fractions as DOUBLE, as Spark's own average has them; decimals stay decimals."""

    def join(a: Column, b: Column) -> Parts:
        return {"total": _added(a["total"], b["total"]), "n": _counts(a["n"], b["n"])}

    return Monoid({"total": F.sum(x), "n": F.count(x)}, join, lambda s: F.when(s["n"] > 0, s["total"] / s["n"]))


def _moments(x: Column, finish: Callable[[Column, Column], Column]) -> Monoid:
    """Number, mean and variance, joined without a difference of large sums."""
    x = x.cast("double")

    def join(a: Column, b: Column) -> Parts:
        one, two = F.coalesce(a["n"], F.lit(0)), F.coalesce(b["n"], F.lit(0))
        n, gap = one + two, b["mean"] - a["mean"]
        mean = F.coalesce(a["mean"] + gap * two / n, a["mean"], b["mean"])
        both = (a["var"] * one + b["var"] * two + gap * gap * one * two / n) / n
        return {"n": n, "mean": mean, "var": F.coalesce(both, a["var"], b["var"])}

    parts = {"n": F.count(x), "mean": F.avg(x), "var": F.var_pop(x)}
    return Monoid(parts, join, lambda s: finish(s["n"], s["var"]))


def _by_population(n: Column, var: Column) -> Column:
    return var


def _by_sample(n: Column, var: Column) -> Column:
    return F.when(n > 1, var * n / (n - 1))


def _best(pick: Callable[[Column], Column], join: Callable[..., Column], value: Column, by: Column) -> Monoid:
    """The value of the row with the least or largest `by`; a tie goes to the least or largest value."""
    row = F.when(by.isNotNull(), F.struct(by.alias("by"), value.alias("value")))
    return Monoid({"v": pick(row)}, lambda a, b: {"v": join(a["v"], b["v"])}, lambda s: s["v"]["value"])


# By the names Spark calls them. Sums of squares and products follow from these.
_KNOWN: dict[str, Callable[..., Monoid]] = {
    "count": _count,
    "sum": _sum,
    "avg": _avg,
    "mean": _avg,
    "min": lambda x: _single(F.min(x), F.least),
    "max": lambda x: _single(F.max(x), F.greatest),
    "bool_and": lambda x: _single(F.bool_and(x), F.least),
    "every": lambda x: _single(F.bool_and(x), F.least),
    "bool_or": lambda x: _single(F.bool_or(x), F.greatest),
    "some": lambda x: _single(F.bool_or(x), F.greatest),
    "bit_or": lambda x: _single(F.bit_or(x), lambda a, b: F.coalesce(a.bitwiseOR(b), a, b)),
    "bit_and": lambda x: _single(F.bit_and(x), lambda a, b: F.coalesce(a.bitwiseAND(b), a, b)),
    "bit_xor": lambda x: _single(F.bit_xor(x), lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
    "count_if": lambda x: _single(F.count_if(x), _counts),
    "var_pop": lambda x: _moments(x, _by_population),
    "var_samp": lambda x: _moments(x, _by_sample),
    "variance": lambda x: _moments(x, _by_sample),
    "stddev_pop": lambda x: _moments(x, lambda n, var: F.sqrt(var)),
    "stddev_samp": lambda x: _moments(x, lambda n, var: F.sqrt(_by_sample(n, var))),
    "stddev": lambda x: _moments(x, lambda n, var: F.sqrt(_by_sample(n, var))),
    "std": lambda x: _moments(x, lambda n, var: F.sqrt(_by_sample(n, var))),
    "min_by": lambda x, y: _best(F.min, F.least, x, y),
    "max_by": lambda x, y: _best(F.max, F.greatest, x, y),
}


@dataclass(frozen=True)
class Call:
    """What an aggregate is made of: the name and arguments of Spark's aggregate function, or None for anything
    else, as a calculation on aggregates."""

    name: str | None
    arguments: tuple[Column, ...]
    distinct: bool
    bare: Column


def read(aggregate: Column) -> Call:
    """Look at an aggregate, with or without an alias."""
    column = type(aggregate)
    jvm = SparkSession.active()._jvm
    of = lambda node: column(jvm.org.apache.spark.sql.Column(node))
    node = aggregate._jc.node()
    if node.getClass().getSimpleName() == "Alias":
        node = node.child()
    bare = of(node)
    if node.getClass().getSimpleName() != "UnresolvedFunction" or not _aggregates(node.functionName()):
        return Call(None, (), False, bare)
    arguments = node.arguments()
    return Call(
        node.functionName().lower(), tuple(of(arguments.apply(i)) for i in range(arguments.size())), node.isDistinct(), bare
    )


def _aggregates(name: str) -> bool:
    """Whether Spark has an aggregate function of this name."""
    session = SparkSession.active()
    known = session._jsparkSession.sessionState().functionRegistry()
    found = known.lookupFunction(session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return found.isDefined() and found.get().getGroup() == "agg_funcs"


def of(call: Call) -> Monoid | None:
    """The monoid of an aggregate, None if it has no state of fixed size here."""
    make = None if call.name is None or call.distinct else _KNOWN.get(call.name)
    try:
        return None if make is None else make(*call.arguments)
    except TypeError:  # a form with other arguments
        return None
