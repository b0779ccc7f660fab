"""Comparison of frames with SQL."""


def rounded(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(rounded, v))
    return v


def same_rows(df, con, sql):
    """The rows of a frame and of a SQL text agree, whatever their order."""
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    want = sorted((tuple(rounded(dict(zip(names, row, strict=True))[c]) for c in sorted(names)) for row in relation.fetchall()), key=str)
    assert columns == sorted(names)
    assert len(got) == len(want)
    assert got == want
    return got
