"""Every registered query of the library itself against its SQL twin, row by row."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from countloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(plain(r[k]) for k in order) for r in data]
    return [columns[k] for k in order], sorted(out, key=lambda r: [(x is None, str(round(x, 4)) if isinstance(x, float) else str(x)) for x in r])


def test_every_query_has_a_twin_or_a_reason():
    assert set(QUERIES) - set(ORACLE_SQL) <= {"tie_atomic_blocks", "fingerprint_manifest", "hypergeometric_mix", "periodicity_blocks", "joint_periodicity"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLE_SQL[name])
    theirs, want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == theirs
    assert len(got) == len(want)
    assert len(got) > 0 or name in {"valleys", "matched_windows", "matched_windows_stopped"}
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if isinstance(x, float) or isinstance(y, float):
                assert (x is None) == (y is None) and (x is None or math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-6)), (a, b)
            else:
                assert x == y, (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
