"""Every registered query against its SQL, or that it runs."""

import os
import random

import duckdb
import pytest

import backscope.plans.registry as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, duck, name):
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.SQL:
        assert rows
        return
    found = duck.execute(registry.SQL[name])
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    assert [found.description[i][0] for i in order] == columns
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


@pytest.mark.parametrize("timed", [1.0, 0.9, 0.0])
def test_host_limits_where_attempts_are_dense(spark, tmp_path, timed):
    """The supplied small tables hardly have attempts that come while another waits; here many do, and some have no time."""
    r, at, rows = random.Random(8), 0, []
    for i in range(600):
        at += r.choice((0, 1, 400_000, 1_700_000, 5_000_000, 4_000_000_000))
        ts = f"make_timestamp({1704067200000000 + at})" if r.random() < timed else "null::TIMESTAMP"
        rows.append(f"({i}, {ts}, {r.randrange(5)}, '{r.choice(('error', 'view'))}', 1.0)")
    c, file = duckdb.connect(), f"{tmp_path}/events.parquet"
    c.execute(f"copy (select * from (values {', '.join(rows)}) t(event_id, ts, user_id, event_type, value)) to '{file}' (format parquet)")
    c.execute(f"create view events as select * from '{file}'")
    found = c.execute(registry.SQL["m8_host_limits"])
    columns = [d[0] for d in found.description]
    got = registry.QUERIES["m8_host_limits"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
