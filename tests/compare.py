"""Rows of both engines, columns by name, doubles to six places, in any order."""


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    return value


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> list[tuple]:
    found = con.sql(sql)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
