"""The typed steps of a plan: each takes a frame and named parameters and gives a frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.types import ddl_of
from ..operators.base import col, quoted
from ..operators.semantic import filter as sem_filter
from ..operators.semantic import map as sem_map
from ..functions.names import fresh
from ..operators.asof import asof_join as joined_as_of
from .expressions import TABLE_FUNCTIONS, checked


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    run: Callable
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    semantic: bool = False
    frames: bool = False


STEPS: dict[str, Step] = {}


def _step(*required: str, optional: tuple[str, ...] = (), semantic: bool = False, frames: bool = False):
    def keep(f):
        STEPS[f.__name__.rstrip("_")] = Step(f, required, optional, semantic, frames)
        return f

    return keep


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def _known(df: DataFrame, names) -> list[str]:
    names = _list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise PlanError(f"no such columns: {missing}; there are {df.columns}")
    return names


def _free(df: DataFrame, name: str) -> None:
    clash = [c for c in df.columns if c.lower() == name.lower() and c != name]
    if clash:
        raise PlanError(f"{name!r} differs from {clash[0]!r} by case only")


def _set(df: DataFrame, name: str, value: Column) -> DataFrame:
    _free(df, name)
    return df.withColumn(name, value)


@_step("new_column", "expression")
def add_column(df, new_column, expression):
    return _set(df, new_column, checked(expression))


@_step("new_column", "source_column", "function", optional=("dtype",))
def apply_function(df, new_column, source_column, function, dtype=None):
    """``function``: a SQL expression in which x is the source column, whatever columns the frame has; or the name of a
    registered function, which is applied to it."""
    _known(df, source_column)
    if new_column not in df.columns:
        _free(df, new_column)
    text = f"{function}(x)" if str(function).isidentifier() and str(function).lower() != "x" else function
    value = checked(text)
    kept, made = fresh([*df.columns, "x", new_column], "kept_x", "made")
    own = {c: kept for c in df.columns if c.lower() == "x"}
    work = df.withColumnsRenamed(own).withColumn("x", col(own.get(source_column, source_column)))
    work = work.withColumn(made, value.cast(ddl_of(dtype)) if dtype else value)
    names = [c for c in df.columns if c != new_column] + [new_column] if new_column not in df.columns else df.columns
    return work.select(*[col(made).alias(c) if c == new_column else col(own.get(c, c)).alias(c) for c in names])


@_step("function", "arguments", optional=("outer",))
def table_function(df, function, arguments, outer=False):
    """Rows of ``df`` beside those that a registered table function gives for its arguments, columns of ``df``; with
    ``outer`` rows for which it gives none stay, with nulls."""
    if function not in TABLE_FUNCTIONS:
        raise PlanError(f"no table function {function!r}; known: {sorted(TABLE_FUNCTIONS)}")
    cls, returns = TABLE_FUNCTIONS[function]
    given = F.udtf(cls, returnType=returns)(*[col(c).outer() for c in _known(df, arguments)])
    clash = {c.lower() for c in df.columns} & {c.lower() for c in StructType.fromDDL(returns).names}
    if clash:
        raise PlanError(f"the function's columns {sorted(clash)} are in the frame")
    return df.lateralJoin(given, F.lit(True), "left" if outer else "inner")


def _frame(frames, name: str) -> DataFrame:
    if name not in (frames or {}):
        raise PlanError(f"no frame {name!r}; there are {sorted(frames or {})}")
    return frames[name]


@_step("right", "on", optional=("how", "right_on"), frames=True)
def join(df, frames, right, on, how="inner", right_on=None):
    """``df`` joined with a named frame on columns. The right's keys go; its other columns must not clash."""
    other = _frame(frames, right)
    keys, theirs = _known(df, on), _known(other, right_on or on)
    if len(keys) != len(theirs) or how not in ("inner", "left", "left_semi", "left_anti"):
        raise PlanError("on and right_on name as many columns; how is 'inner', 'left', 'left_semi' or 'left_anti'")
    spare = fresh([*df.columns, *other.columns], *[f"right_{k}" for k in range(len(keys))])
    other = other.withColumnsRenamed(dict(zip(theirs, spare, strict=True)))
    clash = {c.lower() for c in df.columns} & {c.lower() for c in other.columns} - set(spare)
    if clash and how in ("inner", "left"):
        raise PlanError(f"columns of both frames: {sorted(clash)}; rename or drop them")
    condition = None
    for a, b in zip(keys, spare, strict=True):
        one = col(a) == F.col(b)
        condition = one if condition is None else condition & one
    out = df.join(other, condition, how)
    return out.drop(*spare) if how in ("inner", "left") else out


@_step("right", "by", "on", optional=("right_by", "right_on", "columns"), frames=True)
def asof_join(df, frames, right, by, on, right_by=None, right_on=None, columns=None):
    """``df`` with columns of the last row of a named frame that has equal ``by`` and is not later in ``on``."""
    other = _frame(frames, right)
    _known(df, [*_list(by), on])
    _known(other, [*_list(right_by or by), right_on or on, *(columns or [])])
    return joined_as_of(df, other, by=_list(by), on=on, right_by=_list(right_by) if right_by else None, right_on=right_on, columns=columns)


def _ordered(df, partition_by, order_by, ascending=True):
    order = [col(c).asc_nulls_last() if ascending else col(c).desc_nulls_last() for c in _known(df, order_by)]
    return Window.partitionBy(*[col(c) for c in _known(df, partition_by)]).orderBy(*order)


@_step("column", "new_column", "partition_by", "order_by", optional=("periods", "fill"))
def shift(df, column, new_column, partition_by, order_by, periods=1, fill=None):
    """The column's value ``periods`` rows before (after, if negative) within the partition."""
    _known(df, column)
    value = F.lag(col(column), int(periods)) if int(periods) >= 0 else F.lead(col(column), -int(periods))
    value = value.over(_ordered(df, partition_by, order_by))
    return _set(df, new_column, value if fill is None else F.coalesce(value, F.lit(fill).cast(df.schema[column].dataType)))


@_step("column", "new_column", "function", "partition_by", "order_by", optional=("rows", "within"))
def window_agg(df, column, new_column, function, partition_by, order_by, rows=None, within=None):
    """An aggregate over a moving window: ``rows`` is [first, last] by rows from the current one, ``within`` the same by
    the one order column's number; null is no bound. Without either it runs from the beginning to the current row."""
    _known(df, column)
    if function not in _AGGREGATES or function == "nunique":
        raise PlanError(f"no window aggregate {function!r}")
    if rows is not None and within is not None:
        raise PlanError("rows or within, not both")
    w = _ordered(df, partition_by, order_by)
    low, high = (rows if rows is not None else within) or (None, 0)
    low, high = Window.unboundedPreceding if low is None else int(low), Window.unboundedFollowing if high is None else int(high)
    w = w.rangeBetween(low, high) if within is not None else w.rowsBetween(low, high)
    value = F.coalesce(F.sum(col(column)).over(w), F.lit(0)) if function == "sum" else _AGGREGATES[function](col(column)).over(w)
    return _set(df, new_column, value)


@_step("rename_map")
def rename_columns(df, rename_map):
    for new in rename_map.values():
        _free(df.drop(*[quoted(k) for k in rename_map]), new)
    return df.withColumnsRenamed({k: v for k, v in rename_map.items() if k in df.columns})


@_step("column", "dtype")
def astype_column(df, column, dtype):
    _known(df, column)
    return df.withColumn(column, col(column).cast(ddl_of(dtype)))


@_step("column", "value")
def fillna(df, column, value):
    _known(df, column)
    kind = df.schema[column].dataType
    filled = F.coalesce(F.nanvl(col(column), F.lit(None)), F.lit(value).cast(kind)) if kind.typeName() in ("double", "float") else F.coalesce(col(column), F.lit(value).cast(kind))
    return df.withColumn(column, filled)


@_step("column", "to_replace", "value")
def replace_values(df, column, to_replace, value):
    _known(df, column)
    kind = df.schema[column].dataType
    old, new = _list(to_replace), _list(value)
    if len(new) == 1:
        new = new * len(old)
    if len(new) != len(old):
        raise PlanError("value is one value or as many as to_replace")
    out = None
    for a, b in zip(old, new, strict=True):
        hit, put = col(column).eqNullSafe(F.lit(a).cast(kind)), F.lit(b).cast(kind)
        out = F.when(hit, put) if out is None else out.when(hit, put)
    return df if out is None else df.withColumn(column, out.otherwise(col(column)))


@_step("new_column", "conditions", "choices", optional=("default",))
def conditional_column(df, new_column, conditions, choices, default=None):
    if len(conditions) != len(choices) or not conditions:
        raise PlanError("there must be as many choices as conditions, one or more")
    out = None
    for condition, choice in zip(conditions, choices, strict=True):
        out = F.when(checked(condition), F.lit(choice)) if out is None else out.when(checked(condition), F.lit(choice))
    return _set(df, new_column, out.otherwise(F.lit(default)))


@_step("condition")
def select_rows(df, condition):
    return df.where(checked(condition))


@_step(optional=("columns", "order_by"))
def drop_duplicates(df, columns=None, order_by=None):
    """Keeps a row for each key; with ``order_by`` the first in that order, else any."""
    names = _known(df, columns) if columns else df.columns
    if not order_by:
        return df.dropDuplicates(names)
    turn = "__step_turn"
    w = Window.partitionBy(*[col(c) for c in names]).orderBy(*[col(c).asc_nulls_last() for c in _known(df, order_by)])
    return df.withColumn(turn, F.row_number().over(w)).where(F.col(turn) == 1).drop(turn)


@_step(optional=("columns",))
def dropna(df, columns=None):
    return df.na.drop(subset=_known(df, columns) if columns else None)


@_step("columns")
def select_columns(df, columns):
    return df.select(*[col(c) for c in _known(df, columns)])


@_step("columns")
def drop_columns(df, columns):
    gone = set(_known(df, columns))
    return df.select(*[col(c) for c in df.columns if c not in gone])


_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "size": lambda c: F.count(F.lit(1)),
    "nunique": F.countDistinct, "std": F.stddev_samp, "var": F.var_samp, "median": lambda c: F.percentile(c, F.lit(0.5)),
    "first": lambda c: F.first(c, True), "last": lambda c: F.last(c, True),
}


@_step("group_columns", "aggregations")
def group_by_agg(df, group_columns, aggregations):
    """Rows with a null key are left out, and a sum of nulls is 0, as in dataframe libraries."""
    keys = _known(df, group_columns)
    made = []
    for name, functions in aggregations.items():
        _known(df, name)
        many = isinstance(functions, (list, tuple))
        for f in _list(functions):
            if f not in _AGGREGATES:
                raise PlanError(f"unknown aggregate {f!r}; known: {sorted(_AGGREGATES)}")
            value = _AGGREGATES[f](col(name))
            made.append((value.cast("double") if f == "mean" else value).alias(f"{name}_{f}" if many else name))
    if not made:
        raise PlanError("group_by_agg needs aggregations")
    rows = df
    for k in keys:
        rows = rows.where(col(k).isNotNull())
    return rows.groupBy(*[col(k) for k in keys]).agg(*made)


@_step("columns", optional=("ascending",))
def sort_values(df, columns, ascending=True):
    names = _known(df, columns)
    order = _list(ascending) if isinstance(ascending, (list, tuple)) else [ascending] * len(names)
    if len(order) != len(names):
        raise PlanError("ascending is one value or one for each column")
    return df.orderBy(*[col(c).asc_nulls_last() if up else col(c).desc_nulls_last() for c, up in zip(names, order, strict=True)])


@_step("subprompt", optional=("input_fields", "output_fields"), semantic=True)
def map_(df, llm, subprompt, input_fields=None, output_fields=None):
    return sem_map(prompt=subprompt, input_fields=input_fields, output_fields=output_fields)(llm, df)


@_step("subprompt", optional=("input_fields",), semantic=True)
def filter_(df, llm, subprompt, input_fields=None):
    return sem_filter(prompt=subprompt, input_fields=input_fields)(llm, df)


def normalised(plan) -> list[tuple[str, dict]]:
    """(operation, params) of each step. group_by is joined with the aggregation after it."""
    if not isinstance(plan, list):
        raise PlanError("a plan is a list of steps")
    out: list[tuple[str, dict]] = []
    for k, step in enumerate(plan):
        if not isinstance(step, dict):
            raise PlanError(f"step {k} is not a dictionary")
        name = str(step.get("operation", "")).lower()
        params = dict(step.get("params") or {})
        params |= {k: v for k, v in step.items() if k not in ("type", "operation", "params")}
        if name == "group_by":
            follows = plan[k + 1] if k + 1 < len(plan) else {}
            if not isinstance(follows, dict) or str(follows.get("operation", "")).lower() != "group_by_agg":
                raise PlanError(f"step {k}: group_by must be followed by group_by_agg")
            follows.setdefault("params", {}).setdefault("group_columns", params.get("group_columns"))
            continue
        if name not in STEPS:
            raise PlanError(f"step {k}: unknown operation {name!r}; known: {sorted(STEPS)}")
        known = STEPS[name]
        missing = [p for p in known.required if p not in params]
        extra = [p for p in params if p not in known.required + known.optional]
        if missing or extra:
            raise PlanError(f"step {k} ({name}): missing {missing}, unknown {extra}")
        out.append((name, params))
    return out
