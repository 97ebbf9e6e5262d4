"""Queries beside their SQL, as rows whose order does not count."""

import math
import os
from numbers import Integral

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def _plain(v):
    """A long column with nulls is one of floats on one side and of nullable integers on the other."""
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if math.isfinite(v) and v == int(v) else round(v, 9)
    return int(v) if isinstance(v, Integral) and not isinstance(v, bool) else v


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(repr(_plain(None if v is pd.NA or v != v else v)) for v in row) for row in frame[columns].itertuples(index=False))


def views(sf=SF):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con
