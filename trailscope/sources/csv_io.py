"""CSV scan and sink with the null conventions of pandas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailscope.functions.params import sql_str
from trailscope.sources.inference import infer_types
from trailscope.sources.schemas import cast_by_name

# The text cells pandas ``read_csv`` reads as missing by default.
PANDAS_NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def normalize_na(df: DataFrame, tokens: list[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """Turn NA tokens in string columns into NULL (Spark keeps ``NA`` as text)."""
    listed = ", ".join(sql_str(t) for t in tokens)
    cols = []
    for f in df.schema.fields:
        q = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, T.StringType) and tokens:
            cols.append(F.expr(f"CASE WHEN {q} IN ({listed}) THEN CAST(NULL AS STRING) ELSE {q} END AS {q}"))
        else:
            cols.append(q)
    return df.select(*cols)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    na_tokens: list[str] = PANDAS_NA_TOKENS,
    multi_line: bool = False,
    infer: bool = False,
) -> DataFrame:
    """Read a headered CSV file or directory as text, null the NA tokens, cast by name.

    The columns of ``schema`` get its types; with ``infer``, the other columns get the types
    that all their cells allow (:mod:`trailscope.sources.inference`, one pass over the file), else they stay text.

    ``multi_line`` accepts line feeds inside quoted cells, which :func:`write_csv` can
    write; such files are not split, so each is read by one task.

    Quotes are doubled inside quoted cells, as pandas writes them.
    """
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    df = normalize_na(raw, na_tokens)
    if infer:
        known = schema.fieldNames() if schema is not None else []
        df = infer_types(df, [c for c in df.columns if c not in known])
    return cast_by_name(df, schema) if schema is not None else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a headered CSV directory; NULL as an empty cell, no index column.

    Zone-free timestamps are written as the input has them, ``2012-03-19 08:04:16``, with a fraction (of six digits, as pandas writes it) only where there is one.
    """

    def time_text(name: str):
        text = "CAST(`" + name.replace("`", "``") + "` AS STRING)"
        return F.expr(f"IF({text} LIKE '%.%', concat(substring_index({text}, '.', 1), '.', rpad(substring_index({text}, '.', -1), 6, '0')), {text})")

    times = {f.name: time_text(f.name) for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    (
        df.withColumns(times)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
