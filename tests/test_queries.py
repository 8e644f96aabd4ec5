"""Every registered query of the engine against its SQL at the smallest size."""

from __future__ import annotations

import math
import os

import pytest

from quernstone.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict") or isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
        res = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in res.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=repr)
