"""Command line for ``spark-submit``: convert a matrix, fit a model, write the results.

    spark-submit -m axisloom.job convert -Input mat.txt -InputFmt DENSE -Output rows
    spark-submit -m axisloom.job ppca -i rows -o out -pcs 3

Options may be written ``-i``, ``--i`` or ``-Di=...``.  Rows and columns are
counted when not given.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import fa_fit, fit_cells, ppca_fit
from .operators.model import Start
from .plans.budget import MAX_CLOSURE_BYTES
from .sinks import write_matrix, write_projected
from .sinks.text import FORMATS as OUTPUT_FORMATS
from .sources import convert_matrix, read_dense, scan_rows
from .sources.text import FORMATS as INPUT_FORMATS


def _options(args: list[str]) -> list[str]:
    """``-Dname=value`` -> ``-name=value``; other arguments stay."""
    return [re.sub(r"^-D(?=[A-Za-z]+=)", "-", a) for a in args]


def _rate(text: str) -> float | str:
    return text if text == "by_rows" else float(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="axisloom.job", description=__doc__.splitlines()[0], allow_abbrev=False)
    jobs = top.add_subparsers(dest="job", required=True)

    def option(p, name, *more, **kw):
        p.add_argument(f"-{name}", f"--{name}", *more, dest=name, **kw)

    convert = jobs.add_parser("convert", help="text matrix to stored rows", allow_abbrev=False)
    option(convert, "Input", required=True)
    option(convert, "InputFmt", required=True, type=str.upper, choices=INPUT_FORMATS)
    option(convert, "Output", required=True)
    option(convert, "Base", type=int, choices=(0, 1), help="index base of COO input")
    option(convert, "Cardinality", type=int, help="number of columns")
    option(convert, "Sparse", action="store_true", help="store sparse rows (COO input)")
    for name, text in (("ppca", "isotropic noise"), ("fa", "noise per column")):
        fit = jobs.add_parser(name, help=text, allow_abbrev=False)
        option(fit, "i", required=True, help="stored rows (see convert)")
        option(fit, "o", required=True, help="output folder")
        option(fit, "pcs", required=True, type=int, help="number of components")
        option(fit, "rows", type=int)
        option(fit, "cols", type=int)
        option(fit, "errSampleRate", type=_rate, default="by_rows", help="share of rows the error looks at; falls with N unless given")
        option(fit, "maxIter", type=int, default=3)
        option(fit, "outFmt", type=str.upper, choices=OUTPUT_FORMATS, default="DENSE")
        option(fit, "computeProjectedMatrix", "-ComputeProjectedMatrix", type=int, choices=(0, 1), default=0)
        option(fit, "projectedFmt", type=str.upper, choices=("PARQUET", "VECTOR"), default="PARQUET")
        option(fit, "seed", type=int, default=0, help="of the drawn start values")
        option(fit, "start", help="dense text of start loadings, a line per column, in place of drawn ones")
        option(fit, "noise", type=float, help="start noise variance, with -start")
        option(fit, "canonical", action="store_true", help="rotate and order the components")
        option(fit, "model", choices=("auto", "array", "table"), default="auto", help="where the model is held; auto: a table when sparse rows have more columns x components than a task can take")
    return top


def run(spark: SparkSession, args: list[str]):
    """Runs one job; returns the fitted model (None for a conversion)."""
    a = parser().parse_args(_options(args))
    if a.job == "convert":
        if a.InputFmt == "COO" and a.Base is None:
            parser().error("COO input needs -Base")
        convert_matrix(spark, a.Input, a.InputFmt, a.Output, a.Base, a.Cardinality, a.Sparse)
        return None
    rows = scan_rows(spark, a.i, a.cols)
    fit = ppca_fit if a.job == "ppca" else fa_fit
    if "idx" in rows.columns and a.cols is None:
        parser().error("sparse rows need -cols")
    too_large = a.cols is not None and 8 * a.cols * a.pcs > MAX_CLOSURE_BYTES
    if "idx" in rows.columns and a.model != "array" and (a.model == "table" or too_large):
        return _table_fit(spark, rows, a)
    init = a.seed
    if a.start is not None:
        lines = read_dense(spark, a.start, a.pcs).orderBy("row_id").collect()
        init = Start(np.array([r.y for r in lines]), a.noise if a.job == "ppca" or a.noise is None else np.full(len(lines), a.noise))
    model = fit(
        rows, a.pcs, d=a.cols, max_iter=a.maxIter, error_rate=a.errSampleRate, n_rows=a.rows, init=init,
        canonical=a.canonical,
    )
    model.save(spark, os.path.join(a.o, "model"))
    write_matrix(model.loading_rows(spark), os.path.join(a.o, "PCs.txt"), a.outFmt)
    if a.computeProjectedMatrix:
        write_projected(model.transform(rows), a.o, a.projectedFmt)
    return model


def _table_fit(spark: SparkSession, rows: DataFrame, a: argparse.Namespace):
    """The fit with the model as a table: same files, no reconstruction error per round."""
    cells = rows.select("row_id", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    cells = cells.select("row_id", F.col("e.idx").cast("int").alias("col_id"), F.col("e.val").alias("value"))
    start = None
    if a.start is not None:
        noise = F.lit(0.5 if a.noise is None else a.noise)
        start = read_dense(spark, a.start, a.pcs).select(F.col("row_id").cast("int").alias("col_id"), F.col("y").alias("c"), noise.alias("noise"))
    n = a.rows if a.rows is not None else rows.count()
    model = fit_cells(
        cells, a.pcs, n, a.cols, kind=a.job, max_iter=a.maxIter, start=start, seed=a.seed, canonical=a.canonical
    )
    model.save(os.path.join(a.o, "model"))
    # columns without cells have no loadings; they are zero in the text
    width = a.pcs if model.eigenvalues is None else len(model.eigenvalues)
    zeros = F.array_repeat(F.lit(0.0), width)
    every = spark.range(a.cols).withColumnRenamed("id", "row_id").join(model.loading_rows(), "row_id", "left")
    write_matrix(every.select("row_id", F.coalesce("y", zeros).alias("y")), os.path.join(a.o, "PCs.txt"), a.outFmt)
    if a.computeProjectedMatrix:
        write_projected(model.transform(cells), a.o, a.projectedFmt)
    return model


def main() -> None:
    spark = SparkSession.builder.appName("axisloom").getOrCreate()
    try:
        run(spark, sys.argv[1:])
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
