"""Rows of Spark and DuckDB as comparable lists."""


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(None if r[i] is None else (r[i] if isinstance(r[i], float) else str(r[i])) for i in order) for r in records]
    return sorted(out, key=repr)


def same(df, con, sql):
    got = rows([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(res.fetchall(), columns)
