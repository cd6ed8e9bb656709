"""Rows of two engines, order and the last digits of doubles left aside."""


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return repr([plain(v) for v in value])
    return repr(value)


def same(df, con, sql):
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    return len(rows)
