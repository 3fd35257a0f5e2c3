"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from turnweave.plans import catalogue


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    ours = sorted(tuple(repr(plain(r[c])) for c in cols) for r in df.collect())
    theirs = sorted(tuple(repr(plain(r[names.index(c)])) for c in cols) for r in got.fetchall())
    assert ours == theirs
    assert ours or name == "frm_peaks"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "turnweave.llm" not in f.read_text(), f


@pytest.mark.parametrize("name", ["seg_label_intersection", "seg_overlap_join"])
def test_events_before_the_epoch(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2023-12-31 23:58:00.000700' + to_microseconds(i * 1234567) AS ts, i % 3 AS user_id,
      ['click', 'view'][i % 2 + 1] AS event_type, CAST(i % 5 AS DOUBLE) / 4 AS value FROM range(200) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    theirs = con.execute(catalogue.SQL[name])
    rows = df.select(*[c[0] for c in theirs.description]).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(theirs.fetchall())
