"""Registered queries whose functions Python workers import by the name of their module, against their SQL."""

import os
import subprocess
import sys
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Keys of one byte and of several, of each remainder by 3 and 4.
KEYS = [*range(1, 13), 127, 128, 255, 256, 1000, 65537, 1 << 24]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    pq.write_table(pa.table({"s_suppkey": pa.array(KEYS, pa.int64())}), d / "supplier.parquet")
    pq.write_table(pa.table({"n_nationkey": pa.array([0, *KEYS], pa.int32())}), d / "nation.parquet")
    return str(d)


def agrees(spark, tables, name) -> int:
    """Names, types and rows of a query are those of its SQL; returns the number of rows."""
    import __spark_entry__ as e

    con = pytest.importorskip("duckdb").connect()
    for t in ("supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    want, got = con.execute(e.oracle_sql()[name]), e.queries()[name](spark, tables)
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert [(c, types.get(t, t.upper())) for c, t in got.dtypes] == [(d[0], str(d[1])) for d in want.description]
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(want.fetchall())
    return len(rows)


def test_any_module_may_be_imported_first():
    """What a Python worker does, in one process that forgets the package between two modules."""
    code = """
import importlib, pkgutil, sys, vexel
for name in [m.name for m in pkgutil.walk_packages(vexel.__path__, "vexel.")]:
    for m in [m for m in sys.modules if m.partition(".")[0] == "vexel"]:
        del sys.modules[m]
    importlib.import_module(name)
    print(name)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert {"vexel.plans.queries", "vexel.plans.source_queries", "vexel.plans.frame_queries"} <= set(done.stdout.split())


def test_mvt_values(spark, tables):
    assert agrees(spark, tables, "mvt_values") == sum(k % 4 > 0 or k % 3 == 0 for k in KEYS)


def test_mvt_broken(spark, tables):
    """A row a tile, whether it breaks the format or not."""
    assert agrees(spark, tables, "mvt_broken") == len(KEYS)


def test_png_pixels(spark, tables):
    assert agrees(spark, tables, "png_pixels") == 12 * len(KEYS)


def test_png_premultiplied(spark, tables):
    assert agrees(spark, tables, "png_premultiplied") == 12 * len(KEYS)


def test_dem_scan(spark, tables):
    """A decimal in SQL is one here; the heights are exact tenths before that."""
    import __spark_entry__ as e
    from pyspark.sql import functions as F

    from vexel.sources import dem

    assert agrees(spark, tables, "dem_scan") == 12 * len(KEYS)
    pixels = e.queries()["png_pixels"](spark, tables)
    for r in pixels.select("r", "g", "b", F.round(dem.elevation(F.col("r"), F.col("g"), F.col("b")), 4).alias("h")).collect():
        assert r.h == (r.r * 65536 + r.g * 256 + r.b - 100000) / 10


def test_glyph_scan(spark, tables):
    """Glyphs with and without a bitmap, of each stack but that of key 0."""
    assert agrees(spark, tables, "glyph_scan") == 6 * len(KEYS)
