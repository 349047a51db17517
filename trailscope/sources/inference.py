"""Column types of text tables, inferred from every cell (the rules of pandas ``read_csv``).

Each cell has a kind; the kinds of a column form a lattice (null, integer, float, text, with booleans and integers beyond 64 signed bits
beside them). A column's type is the join of all its cells, found by one aggregate over the whole table, all columns at once: a bit mask per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailscope.functions.params import sql_str

NULL, INTEGER, NEGATIVE, UNSIGNED, FLOAT, BOOLEAN, TEXT = (1 << k for k in range(7))

# The cells that read as a number or a truth value.
INTEGER_CELL = "^ *[+-]?[0-9]+ *$"
FLOAT_CELL = "^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)? *$"
INFINITE_CELL = "^ *[+-]?inf(inity)? *$"
BOOLEAN_CELL = "^(true|false)$"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kind_sql(cell: str) -> str:
    """The kind of a text cell, as a bit mask."""
    whole = f"try_cast({cell} AS DECIMAL(38,0))"
    return (
        f"CASE WHEN {cell} IS NULL THEN {NULL} "
        f"WHEN {cell} RLIKE {sql_str(INTEGER_CELL)} THEN CASE WHEN try_cast({cell} AS BIGINT) IS NOT NULL THEN "
        f"IF({whole} < 0, {INTEGER | NEGATIVE}, {INTEGER}) WHEN {whole} BETWEEN 0 AND 18446744073709551615BD THEN {UNSIGNED} ELSE {TEXT} END "
        f"WHEN {cell} RLIKE {sql_str(FLOAT_CELL)} THEN IF(abs(CAST({cell} AS DOUBLE)) < CAST('inf' AS DOUBLE), {FLOAT}, {TEXT}) "
        f"WHEN lower({cell}) RLIKE {sql_str(INFINITE_CELL)} THEN {FLOAT} "
        f"WHEN lower({cell}) RLIKE {sql_str(BOOLEAN_CELL)} THEN {BOOLEAN} ELSE {TEXT} END"
    )


def type_of(kinds: int | None) -> T.DataType:
    """The column type for the joined kinds of its cells (None: no rows).

    As in pandas, integers with nulls become floats, as do columns of nulls only; booleans with anything else, and unsigned integers
    with nulls or negative numbers, stay text. Unsigned 64-bit integers become ``DECIMAL(20,0)``.
    """
    if kinds is None or kinds & TEXT:
        return T.StringType()
    if kinds & BOOLEAN:
        return T.BooleanType() if kinds == BOOLEAN else T.StringType()
    if kinds & FLOAT:
        return T.DoubleType()
    if kinds & UNSIGNED:
        return T.DecimalType(20, 0) if not kinds & (NULL | NEGATIVE) else T.StringType()
    return T.DoubleType() if kinds & NULL else T.LongType()


def column_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, T.DataType]:
    """The inferred type of each text column (all of them by default). One pass over the data."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = [c for c in texts if columns is None or c in columns]
    if not names:
        return {}
    kinds = df.agg(*[F.expr(f"bit_or({kind_sql(_q(c))}) AS c{i}") for i, c in enumerate(names)]).first()
    return {c: type_of(kinds[i]) for i, c in enumerate(names)}


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with its text columns (or those of ``columns``) cast to their inferred types; the others stay."""
    types = column_types(df, columns)
    cast = {c: t.simpleString() for c, t in types.items() if not isinstance(t, T.StringType)}
    return df.select(*[F.expr(f"CAST(trim({_q(c)}) AS {cast[c]}) AS {_q(c)}") if c in cast else F.col(_q(c)) for c in df.columns])
