"""Inferred CSV types against pandas on columns of mixed cells."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import os

import pandas as pd
import pytest

from trailscope.sources.csv_io import read_csv, write_csv
from trailscope.sources.inference import column_types, infer_types
from trailscope.sources.schemas import ORDERS

CELLS = [
    "1", "-7", "+5", "007", " 2", "3 ", "2.", ".5", "1e5", "1E+5", "-0.25", "inf", "-Infinity", "1_0", "0x10", "9223372036854775807",
    "9223372036854775808", "-9223372036854775809", "18446744073709551616", "True", "false", "TrUe", "yes", "1e400", "1 2", "1e", "--1",
    "", "NA", "nan", "x", "$1",
]
KINDS = {"int64": "bigint", "uint64": "decimal(20,0)", "float64": "double", "bool": "boolean", "object": "string", "str": "string"}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """One column per cell and per pair of cells, three rows each."""
    columns = {f"c{i}": [a, a, a] for i, a in enumerate(CELLS)}
    columns |= {f"p{i}": [a, b, a] for i, (a, b) in enumerate(itertools.combinations(CELLS, 2))}
    path = f"{tmp_path_factory.mktemp('csv')}/mixed.csv"
    rows = [",".join(columns), *[",".join(c[k] for c in columns.values()) for k in range(3)]]
    with open(path, "w") as f:
        f.write("\n".join(rows) + "\n")
    return path, columns


def test_types_and_values_match_pandas(spark, table):
    path, columns = table
    names = list(columns)
    frame = pd.read_csv(path)
    text = read_csv(spark, path)
    types = {}
    for at in range(0, len(names), 90):  # a few hundred expressions at a time
        types |= column_types(text.select(names[at : at + 90]))
    # Integers beyond 64 bits beside floats are read as floats by pandas, depending on where they stand; here they are text.
    odd = {"18446744073709551616", "-9223372036854775809"}
    wrong = {(tuple(columns[c]), str(frame[c].dtype), t.simpleString()) for c, t in types.items() if KINDS[str(frame[c].dtype)] != t.simpleString() and not odd & set(columns[c])}
    assert not wrong
    some = [c for c in names if not odd & set(columns[c])][::9]
    got = infer_types(text.select(some)).toPandas()
    for c in some:
        for a, b in zip(got[c], frame[c]):
            missing = b is None or (isinstance(b, float) and math.isnan(b))
            assert (a is None or a != a) if missing else _same(a, b, str(frame[c].dtype)), (columns[c], a, b)


def _same(a, b, kind: str) -> bool:
    if kind == "float64":  # the default float parser of pandas is off by some units in the last place
        return math.isclose(a, b, rel_tol=1e-14)
    return int(a) == int(b) if kind in ("int64", "uint64") else str(a).lower() == str(b).lower()  # mixed truth values stay text here


def test_only_columns_outside_the_schema_are_inferred(spark, tmp_path):
    path = f"{tmp_path}/orders.csv"
    with open(path, "w") as f:
        f.write("order_id,cogs_usd,website_session_id,price_usd,items_purchased,gift\n7,1.00,1,2.50,1,True\n8,,2,3.50,2,False\n")
    df = read_csv(spark, path, ORDERS, infer=True)
    assert {f.name: f.dataType.simpleString() for f in df.schema.fields} == {
        "website_session_id": "bigint", "items_purchased": "int", "price_usd": "decimal(10,2)", "cogs_usd": "decimal(12,4)", "order_id": "bigint", "gift": "boolean",
    }
    assert read_csv(spark, path, ORDERS).schema["order_id"].dataType.simpleString() == "string"


def test_no_rows_is_text(spark, tmp_path):
    path = f"{tmp_path}/none.csv"
    with open(path, "w") as f:
        f.write("a,b\n")
    assert [f.dataType.simpleString() for f in read_csv(spark, path, infer=True).schema.fields] == ["string", "string"]


def test_timestamps_are_written_as_read(spark, tmp_path):
    times = [dt.datetime(2012, 3, 19, 8, 4, 16), dt.datetime(2012, 3, 19, 0, 0), dt.datetime(2012, 3, 19, 8, 4, 16, 500000), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, created_at timestamp_ntz").coalesce(1)
    write_csv(df, f"{tmp_path}/out")
    part = next(p for p in sorted(os.listdir(f"{tmp_path}/out")) if p.endswith(".csv"))
    with open(f"{tmp_path}/out/{part}") as f:
        assert f.read().split("\n") == ["id,created_at", "0,2012-03-19 08:04:16", "1,2012-03-19 00:00:00", "2,2012-03-19 08:04:16.500000", "3,", ""]
