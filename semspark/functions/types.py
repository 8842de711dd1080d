"""Type names: Spark's own and the usual ones of dataframe libraries."""

from __future__ import annotations

ALIASES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint", "integer": "int",
    "float32": "float", "float64": "double", "float": "double", "number": "double",
    "object": "string", "str": "string", "text": "string", "category": "string", "bool": "boolean",
    "datetime64": "timestamp", "datetime64[ns]": "timestamp", "datetime": "timestamp",
}


def ddl_of(name) -> str:
    """A Spark type name for a type or one of the aliases."""
    if hasattr(name, "simpleString"):
        return name.simpleString()
    return ALIASES.get(str(name).strip().lower(), str(name).strip())
