"""Comparison of a query's rows with those of its SQL, whatever their order."""


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None or v != v:
            return "none"
        if hasattr(v, "quantize"):
            v = float(v)
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(one(row[i]) for i in order) for row in rows)


def agrees(spark, duck, query, sql, sf_dir):
    df = query(spark, sf_dir)
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    a, b = canonical(df.collect(), df.columns), canonical(found.fetchall(), names)
    assert a == b
