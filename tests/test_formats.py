import os

import numpy as np
import pytest
from fixtures import TOY
from pyspark.sql import functions as F

from axisloom.operators import cells_of, coo_to_rows, coo_to_sparse, nonzero_cells
from axisloom.sinks import write_matrix, write_projected
from axisloom.sources import convert_matrix, read_coo, read_dense, read_trials, read_vector_text, scan_rows

TRIPLES = [(i, j, TOY[i, j]) for i in range(7) for j in range(5) if TOY[i, j]]


def put(folder, name, lines, end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + end)
    return str(folder)


def values(df):
    return np.array([r.y for r in df.orderBy("row_id").collect()])


def test_dense_and_both_coordinate_files_give_the_same_matrix(spark, tmp_path):
    dense = put(tmp_path / "d", "m.txt", [" ".join(f"{v:g}" for v in row) for row in TOY])
    zero = put(tmp_path / "z", "m.txt", [f"{i},{j},{v}" for i, j, v in TRIPLES])
    one = put(tmp_path / "o", "m.txt", [f"{i + 1},{j + 1},{v}" for i, j, v in TRIPLES], end="")
    for got in (
        read_dense(spark, dense),
        coo_to_rows(read_coo(spark, zero, 0), 5),
        coo_to_rows(read_coo(spark, one, 1), 5),
    ):
        assert np.array_equal(values(got), TOY)


def test_lines_are_numbered_across_files_and_splits(spark, tmp_path):
    folder = tmp_path / "many"
    rows = [[i, i * i] for i in range(500)]
    put(folder, "b.txt", [f"  {a}\t{b} " for a, b in rows[200:]])
    put(folder, "a.txt", ["", *[f"{a} {b}" for a, b in rows[:200]], " "])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_dense(spark, str(folder))
            assert [r.row_id for r in df.orderBy("row_id").collect()] == list(range(500))
            assert np.array_equal(values(df), np.array(rows, float))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ragged_or_bad_lines_raise(spark, tmp_path):
    ragged = put(tmp_path / "r", "m.txt", ["1 2 3", "1 2"])
    with pytest.raises(Exception, match="ragged"):
        read_dense(spark, ragged).collect()
    bad = put(tmp_path / "b", "m.txt", ["1 2", "1 x"])
    with pytest.raises(Exception):
        read_dense(spark, bad).collect()


def test_coordinate_rows_repeat_drop_and_sparse_form(spark):
    cells = spark.createDataFrame(
        [(0, 1, 2.0), (0, 1, 3.0), (0, 9, 1.0), (5, 0, 0.0), (5, 3, -1.0)], "row_id BIGINT, col_id INT, value DOUBLE"
    )
    assert np.array_equal(values(coo_to_rows(cells, 4)), [[0, 5, 0, 0], [0, 0, 0, -1]])
    sparse = {r.row_id: (r.idx, r.val) for r in coo_to_sparse(cells, 4).collect()}
    assert sparse == {0: ([1], [5.0]), 5: ([3], [-1.0])}
    assert nonzero_cells(cells, 4).count() == 3


@pytest.mark.parametrize("fmt", ["DENSE", "LIL", "COO"])
def test_written_text(spark, as_rows, tmp_path, fmt):
    m = np.array([[0, 1.5, 0], [0, 0, 0], [-2, 0, 1e-9]])
    out = str(tmp_path / fmt)
    write_matrix(as_rows(m), out, fmt)
    files = sorted(f for f in os.listdir(out) if f.startswith("part"))
    lines = [line for f in files for line in open(os.path.join(out, f)).read().splitlines()]
    assert lines == {
        "DENSE": ["0.0 1.5 0.0", "0.0 0.0 0.0", "-2.0 0.0 1.0E-9"],
        "LIL": ["{1:1.5}", "{}", "{0:-2.0,2:1.0E-9}"],
        "COO": ["0,1,1.5", "2,0,-2.0", "2,2,1.0E-9"],
    }[fmt]


def test_write_then_read(spark, as_rows, tmp_path):
    m = np.random.default_rng(0).standard_normal((40, 6)) * 10.0 ** np.arange(-9, 9, 3)
    dense, coo, vec = (str(tmp_path / n) for n in "dcv")
    write_matrix(as_rows(m), dense, "DENSE")
    write_matrix(as_rows(m), coo, "COO")
    assert np.array_equal(values(read_dense(spark, dense)), m)
    assert np.array_equal(values(coo_to_rows(read_coo(spark, coo), 6)), m)
    path = write_projected(as_rows(m).withColumnRenamed("y", "x"), vec, "VECTOR")
    back = read_vector_text(spark, path)
    assert np.array_equal([r["values"] for r in back.orderBy("row_id").collect()], m)
    assert {(r["size"], tuple(r["indices"])) for r in back.collect()} == {(6, (0, 1, 2, 3, 4, 5))}


def test_unknown_formats_are_refused(spark, as_rows, tmp_path):
    with pytest.raises(ValueError):
        write_matrix(as_rows(TOY), str(tmp_path / "x"), "CSV")
    with pytest.raises(ValueError):
        convert_matrix(spark, "x", "XML", "y")
    with pytest.raises(ValueError):
        convert_matrix(spark, "x", "COO", "y")


def test_conversion_counts_columns(spark, tmp_path):
    one = put(tmp_path / "o", "m.txt", [f"{i + 1},{j + 1},{v}" for i, j, v in TRIPLES])
    out = str(tmp_path / "rows")
    convert_matrix(spark, one, "COO", out, base=1, d=5)
    assert np.array_equal(values(scan_rows(spark, out)), TOY)
    assert np.array_equal(values(scan_rows(spark, out, 3)), TOY[:, :3])


def test_trial_file(spark, tmp_path):
    folder = tmp_path / "t"
    put(folder, "sweeps.csv", ["Unnamed: 0,0,1,dx", '0,[1. 2.5],"[ 3e0', '  4.]",7', "1,[5 6],[7 8],9", "2,[0 0],[0 0],9"])
    got = sorted(tuple(r) for r in read_trials(spark, str(folder), first_n=2).collect())
    assert got == [
        (0, 0, 0, 1.0), (0, 0, 1, 2.5), (0, 1, 0, 3.0), (0, 1, 1, 4.0),
        (1, 0, 0, 5.0), (1, 0, 1, 6.0), (1, 1, 0, 7.0), (1, 1, 1, 8.0),
    ]


def test_cells_keep_or_drop_null(as_rows):
    df = as_rows(np.array([[1, np.nan], [0, 2]]))
    assert cells_of(df).count() == 3
    assert cells_of(df, keep_null=True).filter(F.col("value").isNull()).count() == 1


def test_lines_are_numbered_by_part_number(spark, tmp_path):
    from axisloom.sources import read_dense

    folder = tmp_path / "m"
    folder.mkdir()
    for name, value in (("part-99999", 1), ("part-100000", 2), ("part-100001-x.txt", 3), ("part-00002", 0)):
        (folder / name).write_text(f"{value}\n")
    rows = read_dense(spark, str(folder), 1).orderBy("row_id").collect()
    assert [(r.row_id, r.y) for r in rows] == [(i, [float(i)]) for i in range(4)]
