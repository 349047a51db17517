"""Fixed schemas of the three input tables and by-name casting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSIONS = T.StructType(
    [
        T.StructField("website_session_id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("is_repeat_session", T.IntegerType()),
        T.StructField("utm_source", T.StringType()),
        T.StructField("utm_campaign", T.StringType()),
        T.StructField("utm_content", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("http_referer", T.StringType()),
    ]
)

PAGEVIEWS = T.StructType(
    [
        T.StructField("website_pageview_id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("website_session_id", T.LongType()),
        T.StructField("pageview_url", T.StringType()),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("website_session_id", T.LongType()),
        T.StructField("items_purchased", T.IntegerType()),
        T.StructField("price_usd", T.DecimalType(10, 2)),
        T.StructField("cogs_usd", T.DecimalType(12, 4)),
    ]
)

SCHEMAS = {"website_sessions": SESSIONS, "website_pageviews": PAGEVIEWS, "orders": ORDERS}


def cast_by_name(df: DataFrame, schema: T.StructType, keep_extra: bool = True) -> DataFrame:
    """Cast the schema's columns by header name; other columns are kept as read.

    ``read.csv(schema=...)`` binds by position, which breaks as soon as a file
    has its columns in another order, so casting is done by name instead.
    """
    wanted = {f.name: f.dataType for f in schema.fields}
    missing = [name for name in wanted if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def q(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def cast(f: T.StructField) -> str:
        name, target = q(f.name), f.dataType.simpleString()
        if isinstance(f.dataType, T.IntegralType) and isinstance(df.schema[f.name].dataType, T.StringType):
            # pandas writes an integer column with missing values as 1.0; a true fraction still fails.
            whole = f"regexp_replace({name}, '[.]0*[ ]*$', '')"
            return f"CAST({whole} AS {target}) AS {name}"
        return f"CAST({name} AS {target}) AS {name}"

    cols = [F.expr(cast(f)) for f in schema.fields]
    if keep_extra:
        cols += [F.expr(q(c)) for c in df.columns if c not in wanted]
    return df.select(*cols)
