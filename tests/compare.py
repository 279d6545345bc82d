"""Rows of a DataFrame and of SQL, made comparable."""

import datetime
import decimal


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def sql_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    order = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=lambda r: [(x is None, str(x)) for x in r])
