"""Order-insensitive comparison of a Spark and a DuckDB result."""

import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(v)
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


def assert_same(spark_df, sql: str, duck) -> None:
    got, want = spark_df.toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
