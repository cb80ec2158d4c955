"""Comparison of Spark rows with SQL rows."""

SF = "/root/testdata/sf0.001"


def same(spark_rows, sql_rows) -> None:
    a, b = spark_rows.toPandas(), sql_rows.df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert len(a) == len(b)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), (c, a[a[c] != b[c]].head(), b[a[c] != b[c]].head())
