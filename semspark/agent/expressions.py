"""Checks that an expression from a plan calls allowed functions only, before it becomes a column."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ALLOWED = frozenset(
    """abs acos add_months approx_count_distinct array array_contains asin atan avg base64 bround cast cbrt ceil ceiling char_length
    coalesce concat concat_ws contains cos count current_date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth
    dayofweek dayofyear endswith exp extract floor format_number format_string from_json from_unixtime get_json_object greatest hour if
    ifnull initcap instr int isnan isnotnull isnull last_day least left length levenshtein like ln locate log log10 log2 lower lpad
    ltrim make_date max md5 min minute mod month months_between nanvl negative not now nullif nvl nvl2 pmod positive pow power quarter
    regexp_count regexp_extract regexp_like regexp_replace replace reverse right rint rlike round rpad rtrim second sha2 sign signum sin
    size split split_part sqrt startswith string struct substr substring substring_index sum tan to_date to_json to_number to_timestamp
    translate trim trunc try_add try_cast try_divide try_multiply try_subtract try_to_date try_to_number try_to_timestamp try_variant_get unix_timestamp upper weekday
    weekofyear when xxhash64 year double bigint float boolean date timestamp decimal""".split()
)


class ExpressionError(ValueError):
    pass


#: Arrow functions and table functions that plans may name, by name, with the types of what they give.
FUNCTIONS: dict[str, tuple[object, str]] = {}
TABLE_FUNCTIONS: dict[str, tuple[type, str]] = {}


def _free_name(name: str) -> str:
    if not name.isidentifier() or name != name.lower():
        raise ValueError("a name of small letters, digits and underscores is needed")
    if name in ALLOWED or name in FUNCTIONS or name in TABLE_FUNCTIONS:
        raise ValueError(f"{name!r} is taken")
    return name


def register_function(name: str, returns: str):
    """``@register_function("word_count", "int")``: plans may call the function in expressions. It takes Arrow arrays, a
    batch of each argument, and gives one of the type named."""

    def keep(f):
        FUNCTIONS[_free_name(name)] = (f, returns)
        return f

    return keep


def register_table_function(name: str, returns: str):
    """``@register_table_function("words_of", "word string, at int")`` on a class whose ``eval`` yields rows: plans may
    call it in the step table_function."""

    def keep(cls):
        TABLE_FUNCTIONS[_free_name(name)] = (cls, returns)
        return cls

    return keep


def _walk(node) -> None:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name = node.nameParts().mkString(".").lower()
        if name in FUNCTIONS:
            SparkSession.active().udf.register(name, F.arrow_udf(*FUNCTIONS[name]))
        elif name not in ALLOWED:
            raise ExpressionError(f"function {name!r} is not allowed")
    if any(word in kind for word in ("Subquery", "Exists", "ListQuery", "Invoke", "ScalaUDF", "PythonUDF")):
        raise ExpressionError(f"{kind} is not allowed in an expression")
    children = node.children()
    for k in range(children.size()):
        _walk(children.apply(k))


def checked(text: str) -> Column:
    """The column of a SQL expression. Raises ExpressionError for functions not on the list and for subqueries."""
    spark = SparkSession.active()
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(str(text))
    except Exception as error:
        raise ExpressionError(f"cannot parse {text!r}: {str(error).splitlines()[0]}") from error
    _walk(tree)
    return F.expr(str(text))
