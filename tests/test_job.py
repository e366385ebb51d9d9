import os

import numpy as np
import pytest
from fixtures import TOY

from axisloom.job import parser, run
from axisloom.operators import FactorModel
from axisloom.sources import read_dense, read_vector_text


def test_convert_then_fit_then_project(spark, tmp_path):
    text = tmp_path / "mat.txt"
    text.write_text("\n".join(" ".join(f"{v:g}" for v in row) for row in TOY))
    rows, out = str(tmp_path / "rows"), str(tmp_path / "out")
    run(spark, ["convert", "-DInput=" + str(text), "-DInputFmt=DENSE", "-DOutput=" + rows, "-DCardinality=5"])
    model = run(
        spark,
        ["ppca", "-i", rows, "--o", out, "-Drows=7", "-cols", "5", "-pcs", "3", "-computeProjectedMatrix", "1",
         "-projectedFmt", "VECTOR"],
    )
    assert len(model.history) == 3
    pcs = np.array([r.y for r in read_dense(spark, os.path.join(out, "PCs.txt")).orderBy("row_id").collect()])
    assert np.array_equal(pcs, model.loadings)
    projected = read_vector_text(spark, os.path.join(out, "ProjectedMatrix")).orderBy("row_id").collect()
    assert np.allclose([r["values"] for r in projected], TOY @ model.loadings)
    assert np.array_equal(FactorModel.load(spark, os.path.join(out, "model")).loadings, model.loadings)


def test_sparse_job(spark, tmp_path):
    text = tmp_path / "coo.txt"
    text.write_text("\n".join(f"{i},{j},{TOY[i, j]}" for i in range(7) for j in range(5) if TOY[i, j]))
    rows, out = str(tmp_path / "rows"), str(tmp_path / "out")
    run(spark, ["convert", "-Input", str(text), "-InputFmt", "COO", "-Base", "0", "-Output", rows, "-Sparse"])
    model = run(spark, ["ppca", "-i", rows, "-o", out, "-cols", "5", "-pcs", "2", "-computeProjectedMatrix", "1"])
    projected = spark.read.parquet(os.path.join(out, "ProjectedMatrix")).orderBy("row_id").collect()
    assert np.allclose([r.x for r in projected], TOY @ model.loadings)
    with pytest.raises(SystemExit):
        run(spark, ["ppca", "-i", rows, "-o", out, "-pcs", "2"])


def test_fa_job(spark, tmp_path):
    rng = np.random.default_rng(0)
    text = tmp_path / "m.txt"
    np.savetxt(text, rng.standard_normal((50, 4)))
    rows = str(tmp_path / "rows")
    run(spark, ["convert", "-Input", str(text), "-InputFmt", "dense", "-Output", rows])
    model = run(spark, ["fa", "-i", rows, "-o", str(tmp_path / "o"), "-pcs", "1", "-maxIter", "5", "-outFmt", "coo"])
    assert model.kind == "fa" and model.noise.shape == (4,)


@pytest.mark.parametrize(
    "args",
    [
        ["ppca", "-o", "x", "-pcs", "3"],
        ["ppca", "-i", "x", "-o", "x", "-pcs", "3", "-outFmt", "CSV"],
        ["convert", "-Input", "x", "-InputFmt", "XML", "-Output", "y"],
        ["other"],
    ],
)
def test_wrong_arguments_are_refused(args):
    with pytest.raises(SystemExit):
        parser().parse_args(args)


@pytest.mark.parametrize("job", ["ppca", "fa"])
def test_the_model_as_a_table_writes_the_same_files(spark, tmp_path, job):
    from axisloom.operators import CellModel

    text, start = tmp_path / "coo.txt", tmp_path / "start.txt"
    cells = [(i, j, TOY[i, j] * (1 + 0.3 * i + 0.1 * j)) for i in range(7) for j in range(4) if TOY[i, j]]
    text.write_text("\n".join(f"{i},{j},{v}" for i, j, v in cells))
    start.write_text("\n".join(" ".join(f"{(3 * i + 2 * j) % 7 / 7}" for j in range(2)) for i in range(4)))
    rows = str(tmp_path / "rows")
    run(spark, ["convert", "-Input", str(text), "-InputFmt", "COO", "-Base", "0", "-Output", rows, "-Sparse"])
    more = ["-cols", "4", "-pcs", "2", "-start", str(start), "-noise", "0.5", "-errSampleRate", "0", "-maxIter", "2", "-computeProjectedMatrix", "1"]
    found = {}
    for kind in ("array", "table"):
        out = str(tmp_path / kind)
        model = run(spark, [job, "-i", rows, "-o", out, "-model", kind, *more])
        pcs = np.array([r.y for r in read_dense(spark, os.path.join(out, "PCs.txt")).orderBy("row_id").collect()])
        projected = {r.row_id: r.x for r in spark.read.parquet(os.path.join(out, "ProjectedMatrix")).collect()}
        found[kind] = pcs, projected, model
    assert isinstance(found["table"][2], CellModel)
    assert np.allclose(found["array"][0], found["table"][0])
    assert all(np.allclose(x, found["array"][1][i]) for i, x in found["table"][1].items())
    assert CellModel.load(spark, str(tmp_path / "table" / "model")).components().count() == 4
