import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.functions import expressions as X
from keyfold.plans import catalog
from keyfold.schema import commands

SF = "/root/testdata/sf0.001"


def test_command_table():
    table = commands()
    assert len(table) == 39 and len({v for v, *_ in table}) == 39


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def rows(table, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toArrow()
    if name not in catalog.oracle_sql():
        assert got.num_rows
        return
    expected = duck.sql(catalog.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(expected.column_names)
    assert rows(got, columns) == rows(expected, columns)
    assert [str(got.schema.field(c).type) for c in columns] == [str(expected.schema.field(c).type) for c in columns]


def test_vector_text_is_that_of_printf(spark, tmp_path):
    """Halves of a millionth, large, tiny and odd numbers: all digits are those of the exact binary value."""
    rng = random.Random(6)
    values = [k / 128 for k in (1, 3, 5, -7, 9, 127, 2**23 - 1)] + [0.0, -0.0, -1e-9, 0.9999999, 16777215.0, 1e20, -3.4028234e38, 1e38, 2.0**53, 2.0**64, 1e-45]
    values += [np.float32(rng.uniform(-1, 1) * 10.0 ** rng.randrange(-8, 38)).item() for _ in range(400)]
    rows = [values, [float("nan"), 1.0], [float("inf"), float("-inf"), 0.0078125], [None, 0.0234375, None], [], None, [None]]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").write.parquet(path)
    got = catalog.queries()["vector_text_roundtrip"](spark, str(tmp_path)).orderBy("vec_id").collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
        expected = con.sql(catalog.oracle_sql()["vector_text_roundtrip"] + " ORDER BY vec_id").fetchall()
    assert list(map(tuple, got)) == expected
    doubles = values + [2.5e-6, 1.5e-6, 5e-7, 123456789012.0078125, 1.7976931348623157e308, -1e23, 9007199254740993.0, 0.9999995, 0.99999949999999999]
    doubles += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-9, 300) for _ in range(400)] + [(2 * rng.randrange(10**7) + 1) / 2e6 for _ in range(400)]
    table = spark.createDataFrame([(doubles,)], "v array<double>")
    for n in (6, 2):
        assert table.select(X.fixed(F.col("v"), n)).first()[0] == [f"%.{n}f" % x for x in doubles]
