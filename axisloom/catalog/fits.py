"""Model fits.  With one component the EM rounds can be written out in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import operators as op
from ..operators.model import Start
from ..operators.pca import shares_frame
from ..plans.moments import column_stats
from ..session import scratch_path, stored
from . import register as r
from .register import query


def add(n: int, term: str, sep: str = " + ") -> str:
    return sep.join(f"({term.format(j=j)})" for j in range(n))


def each(n: int, term: str) -> str:
    return ", ".join(term.format(j=j) for j in range(n))


def loading_rows(n: int, source: str, extra: str) -> str:
    return "\n UNION ALL ".join(
        f"SELECT {j} AS col_id, round(c{j}, 6) + 0.0 AS loading, {extra.format(j=j)} FROM {source}" for j in range(n)
    )


def zscored(base: str, source: str, n: int) -> str:
    stats = each(n, "avg(y{j}) AS m{j}, stddev_pop(y{j}) AS s{j}")
    return f"""{base}, st AS (SELECT {stats} FROM {source}),
z AS (SELECT {each(n, "(y{j} - m{j}) / s{j} AS z{j}")} FROM {source}, st)"""


START = (0.7, 0.5, 0.3)
START_NOISE = 0.9


def ppca_k1_sql(rounds: int) -> str:
    ctes = ppca_k1_rounds(zscored(r.CORRELATED, "correlated", 3), START, rounds)
    return ctes + "\n" + loading_rows(3, f"p{rounds}", "round(ss, 6) AS noise")


def ppca_k1_rounds(base: str, first_loadings: tuple, rounds: int) -> str:
    """Rounds of the one-component fit on the centered columns of CTE ``z``: p0, p1, ..."""
    n = len(first_loadings)
    first = ", ".join(f"{c}::DOUBLE AS c{j}" for j, c in enumerate(first_loadings))
    ctes = [
        base,
        f"total AS (SELECT count(*) AS n, sum({add(n, 'z{j} * z{j}')}) AS norm2 FROM z)",
        f"p0 AS (SELECT {first}, {START_NOISE}::DOUBLE AS ss)",
    ]
    for i in range(rounds):
        ctes += [
            f"q{i} AS (SELECT *, {add(n, 'c{j} * c{j}')} + ss AS m FROM p{i})",
            f"x{i} AS (SELECT z.*, m, ss, ({add(n, 'z{j} * c{j}')}) / m AS x FROM z, q{i})",
            f"s{i} AS (SELECT sum(x * x) + count(*) * max(ss) / max(m) AS xtx, {each(n, 'sum(z{j} * x) AS t{j}')} FROM x{i})",
            f"c{i} AS (SELECT xtx, {each(n, 't{j}, t{j} / xtx AS c{j}')} FROM s{i})",
            f"p{i + 1} AS (SELECT {each(n, 'c{j}')}, (norm2 + xtx * ({add(n, 'c{j} * c{j}')}) - 2 * ({add(n, 'c{j} * t{j}')})) / (n * {n}) AS ss FROM c{i}, total)",
        ]
    return "WITH " + ",\n".join(ctes)


def fitted_rows(spark, model, **extra):
    rows = model.components(spark).select(
        "col_id", r.rounded(F.col("loadings")[0]).alias("loading"), r.rounded(F.col("noise")).alias("noise")
    )
    for name, value in extra.items():
        rows = rows.withColumn(name, r.rounded(F.lit(float(value)), 3))
    return rows


def start(n: int, noise) -> Start:
    return Start(np.array((START + (0.2,))[:n])[:, None], noise)


def history_sql(rounds: int, n: int = 3) -> str:
    """Noise variance, its change and the L1 error after every round."""
    body = ppca_k1_rounds(zscored(r.CORRELATED, "correlated", n), START, rounds)
    errors = [
        f"""e{i} AS (SELECT greatest({each(n, f'sum(abs(x * p.c{{j}} - z{{j}}))')})
  / greatest({each(n, 'sum(abs(z{j}))')}) AS error FROM x{i}, p{i + 1} p)"""
        for i in range(rounds)
    ]
    lines = [
        f"SELECT {i + 1} AS round, round(p{i + 1}.ss, 6) AS objective, "
        + (f"round(abs(1 - p{i + 1}.ss / p{i}.ss), 6) + 0.0" if i else "NULL::DOUBLE")
        + f" AS rel_change, round(error, 6) AS error FROM p{i + 1}, e{i}"
        + (f", p{i}" if i else "")
        for i in range(rounds)
    ]
    return body + ",\n" + ",\n".join(errors) + "\n" + "\n UNION ALL ".join(lines)


@query("ppca_fit_k1", ppca_k1_sql(2))
def ppca_k1(spark, sf):
    z = op.zscore_rows(r.correlated(spark, sf))
    return fitted_rows(spark, op.ppca_fit(z, 1, max_iter=2, tol=0, error_rate=0, init=start(3, START_NOISE)))


@query("ppca_fit_k1_rows", ppca_k1_sql(3))
def ppca_k1_rows(spark, sf):
    """The same fit with a pass per round, without the scatter matrix."""
    z = op.zscore_rows(r.correlated(spark, sf))
    model = op.ppca_fit(z, 1, max_iter=3, tol=0, error_rate=0, init=start(3, START_NOISE), plan="rows")
    return fitted_rows(spark, model)


COUNTS_WIDE = f"""{r.EVENT_COUNTS}, {r.dense_sql('counts')}, wide AS (
  SELECT row_id, {each(5, "sum(value) FILTER (WHERE col_id = {j}) AS y{j}")} FROM dense GROUP BY row_id)"""
START5 = START + (0.2, 0.4)


def cells_k1_sql(rounds: int, n: int = 5) -> str:
    means, centered = each(n, "avg(y{j}) AS m{j}"), each(n, "y{j} - m{j} AS z{j}")
    base = f"{COUNTS_WIDE}, st AS (SELECT {means} FROM wide), z AS (SELECT {centered} FROM wide, st)"
    ctes = ppca_k1_rounds(base, START5, rounds)
    return ctes + "\n" + loading_rows(n, f"p{rounds}", "round(ss, 6) AS noise")


@query("ppca_fit_cells_k1", cells_k1_sql(2))
def ppca_cells_k1(spark, sf):
    """Sparse cells joined with the model as a table."""
    cells = r.event_counts(spark, sf)
    n = cells.select("row_id").distinct().count()
    begin = spark.createDataFrame(
        [(j, [c], START_NOISE) for j, c in enumerate(START5)], "col_id INT, c ARRAY<DOUBLE>, noise DOUBLE"
    )
    model = op.fit_cells(cells, 1, n, len(r.TYPES), max_iter=2, tol=0, start=begin)
    return model.components().select(
        "col_id", r.rounded(F.col("loadings")[0]).alias("loading"), r.rounded(F.col("noise")).alias("noise")
    )


START_PSI = (0.9, 0.8, 0.7)


def fa_k1_sql(rounds: int, n: int = 3) -> str:
    first = ", ".join(f"{c}::DOUBLE AS c{j}, {p}::DOUBLE AS p{j}" for j, (c, p) in enumerate(zip(START, START_PSI)))
    ctes = [
        zscored(r.CORRELATED, "correlated", n),
        f"total AS (SELECT count(*) AS n, {each(n, 'avg(z{j} * z{j}) AS v{j}')} FROM z)",
        f"p0 AS (SELECT {first}, 0::DOUBLE AS ll)",
    ]
    for i in range(rounds):
        ll = (
            f"-0.5 * n * ({n} * ln(2 * pi()) - (ln(v) - ({add(n, 'ln(p{j})')}))"
            f" + ({add(n, 'v{j} / p{j}')}) - xtx / v)"
        )
        ctes += [
            f"v{i} AS (SELECT *, 1 / (1 + {add(n, 'c{j} * c{j} / p{j}')}) AS v FROM p{i})",
            f"w{i} AS (SELECT *, {each(n, 'c{j} / p{j} * v AS w{j}')} FROM v{i})",
            f"x{i} AS (SELECT z.*, {add(n, 'z{j} * w{j}')} AS x FROM z, w{i})",
            f"s{i} AS (SELECT avg(x * x) AS xtx, {each(n, 'avg(z{j} * x) AS t{j}')} FROM x{i})",
            f"m{i} AS (SELECT *, 1 + xtx - ({add(n, 'w{j} * c{j}')}) AS sigma, {ll} AS ll_now FROM s{i}, w{i}, total)",
            f"p{i + 1} AS (SELECT {each(n, 't{j} / sigma AS c{j}, v{j} - t{j} * t{j} / sigma AS p{j}')}, ll_now AS ll FROM m{i})",
        ]
    return (
        "WITH " + ",\n".join(ctes) + "\n"
        + loading_rows(n, f"p{rounds}", "round(p{j}, 6) + 0.0 AS noise, round(ll, 3) + 0.0 AS log_likelihood")
    )


@query("fa_fit_k1", fa_k1_sql(2))
def fa_k1(spark, sf):
    z = op.zscore_rows(r.correlated(spark, sf))
    model = op.fa_fit(z, 1, max_iter=2, tol=-np.inf, error_rate=0, init=start(3, np.array(START_PSI)))
    return fitted_rows(spark, model, log_likelihood=model.history[-1][1])


def missing_k1_sql(rounds: int, n: int = 4) -> str:
    return missing_k1_rounds(rounds, n) + "\n" + loading_rows(n, f"p{rounds}", "round(ss, 6) AS noise")


def missing_k1_rounds(rounds: int, n: int = 4) -> str:
    first = ", ".join(f"{c}::DOUBLE AS c{j}" for j, c in enumerate(START + (0.2,)))
    residual = add(n, "coalesce(pow(x * c{j} - z{j}, 2), 0)")
    ctes = [
        zscored(r.LINEITEM_GAPS, "lineitem4", n),
        f"total AS (SELECT count(*) AS n, sum({add(n, '(z{j} IS NULL)::INT')}) AS missing FROM z)",
        f"i0 AS (SELECT {first})",
        f"x0 AS (SELECT z.*, i0.*, ({add(n, 'coalesce(z{j}, 0) * c{j}')}) / ({add(n, 'c{j} * c{j}')}) AS x FROM z, i0)",
        f"p0 AS (SELECT {each(n, 'max(c{j}) AS c{j}')}, sum({residual}) / (max(n) * {n} - max(missing)) AS ss FROM x0, total)",
    ]
    for i in range(rounds):
        nxt = i + 1
        ctes += [
            f"q{i} AS (SELECT *, 1 / (1 + ({add(n, 'c{j} * c{j}')}) / ss) AS sx FROM p{i})",
            f"d{i} AS (SELECT {each(n, 'e.z{j}')}, {each(n, 'coalesce(e.z{j}, e.x * q.c{j}) AS f{j}')}, {each(n, 'q.c{j} AS c{j}')}, q.sx, q.ss FROM x{i} e, q{i} q)",
            f"y{nxt} AS (SELECT *, ({add(n, 'f{j} * c{j}')}) * sx / ss AS x FROM d{i})",
            f"s{i} AS (SELECT sum(x * x) + count(*) * max(sx) AS xx, {each(n, 'sum(f{j} * x) AS t{j}')}, max(sx) AS sx, max(ss) AS ss FROM y{nxt})",
            f"n{i} AS (SELECT {each(n, 't{j} / xx AS c{j}')}, sx, ss FROM s{i})",
            f"x{nxt} AS (SELECT {each(n, 'y.z{j}')}, y.x, {each(n, 'k.c{j}')}, k.sx, k.ss FROM y{nxt} y, n{i} k)",
            f"p{nxt} AS (SELECT {each(n, 'max(c{j}) AS c{j}')}, (sum({residual}) + max(n) * ({add(n, 'max(c{j}) * max(c{j})')}) * max(sx) + max(missing) * max(ss)) / (max(n) * {n}) AS ss FROM x{nxt}, total)",
        ]
    return "WITH " + ",\n".join(ctes)


@query("ppca_missing_fit_k1", missing_k1_sql(3))
def missing_k1(spark, sf):
    fit = op.ppca_missing_fit(
        r.lineitem_gaps(spark, sf), 1, max_iter=3, tol=0, init=start(4, None), checkpoint_every=2
    )
    return fitted_rows(spark, fit.model)


# --- eigenvalues of a 3 x 3 correlation matrix, in closed form --------------

EIGEN = f"""{r.CORRELATED},
co AS (SELECT count(*)::DOUBLE AS n, corr(y0, y1) AS a, corr(y0, y2) AS b, corr(y1, y2) AS c FROM correlated),
p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM co),
phi AS (SELECT *, acos(least(1, greatest(-1, a * b * c / (p * p * p)))) / 3 AS phi FROM p),
e AS (SELECT n, 1 + 2 * p * cos(phi) AS e0, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS e2 FROM phi),
eig AS (SELECT n, e0, 3 - e0 - e2 AS e1, e2 FROM e)"""


@query("explained_variance", f"""
WITH {EIGEN}
SELECT 0 AS comp, round(e0 * n / (n - 1) / 3, 6) AS share, round(e0 * n / (n - 1) / 3, 6) AS cumulative FROM eig
UNION ALL SELECT 1, round(e1 * n / (n - 1) / 3, 6), round((e0 + e1) * n / (n - 1) / 3, 6) FROM eig""")
def explained(spark, sf):
    z = op.zscore_rows(r.correlated(spark, sf))
    model = op.ppca_fit(z, 2, max_iter=2000, tol=1e-15, error_rate=0, canonical=True)
    return rounded_shares(op.explained_variance(model, spark))


def rounded_shares(df):
    return df.select("comp", r.rounded(F.col("share")).alias("share"), r.rounded(F.col("cumulative")).alias("cumulative"))


@query("pca_shares", f"""
WITH {EIGEN}
SELECT 0 AS comp, round(e0 / 3, 6) AS share, round(e0 / 3, 6) AS cumulative FROM eig
UNION ALL SELECT 1, round(e1 / 3, 6), round((e0 + e1) / 3, 6) FROM eig
UNION ALL SELECT 2, round(e2 / 3, 6), round((e0 + e1 + e2) / 3, 6) FROM eig""")
def pca_shares(spark, sf):
    model = op.pca_fit(op.zscore_rows(r.correlated(spark, sf)), 3)
    return rounded_shares(shares_frame(model, spark))


@query("pca_randomized_shares", f"""
WITH {EIGEN}
SELECT 0 AS comp, round(e0 / 3, 6) AS share, round(e0 / 3, 6) AS cumulative FROM eig
UNION ALL SELECT 1, round(e1 / 3, 6), round((e0 + e1) / 3, 6) FROM eig""")
def pca_randomized_shares(spark, sf):
    """The form for wide matrices: passes over the rows, no scatter matrix."""
    model = op.pca_randomized(op.zscore_rows(r.correlated(spark, sf)), 2, oversample=0, plan="rows", passes=200, tol=1e-12)
    return rounded_shares(shares_frame(model, spark))


FOURIER = 24


def fourier_sql() -> str:
    """Directions and phases from digests, cosines written out."""
    u = lambda text: f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496"
    return f"""
WITH {r.EMBEDDINGS}, f AS (SELECT CAST(i AS INTEGER) AS f FROM range({FOURIER}) a(i)),
w AS (
  SELECT CAST(i AS INTEGER) AS col_id, f, sqrt(2 * 0.5) * sqrt(-2 * ln({u("'0:' || i || ':' || f || ':r'")})) * cos(2 * pi() * {u("'0:' || i || ':' || f || ':a'")}) AS w
  FROM range({r.WIDTH}) b(i), f),
p AS (SELECT f, 2 * pi() * {u("'0:phase:' || f")} AS p FROM f),
s AS (SELECT row_id, f, sum(v * w) AS s FROM cell JOIN w USING (col_id) GROUP BY row_id, f)
SELECT row_id, f AS feature, round(sqrt(2.0 / {FOURIER}) * cos(s + p), 6) + 0.0 AS value FROM s JOIN p USING (f)"""


@query("group_covariances", f"""
WITH {r.EMBEDDINGS}, named AS (SELECT row_id, col_id, v, CAST(label AS INTEGER) AS grp FROM cell JOIN embeddings ON vec_id = row_id)
SELECT a.grp, a.col_id AS i, b.col_id AS j, round(covar_pop(a.v, b.v), 6) + 0.0 AS cov
FROM named a JOIN named b ON b.row_id = a.row_id AND b.col_id >= a.col_id GROUP BY 1, 2, 3""")
def covariances_by_label(spark, sf):
    """Array sums per group: all 64 columns by label."""
    table = r.table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("grp"), F.col("embedding").cast("array<double>").alias("y"))
    flat = op.group_covariances(table, r.WIDTH).select("grp", F.posexplode("cov").alias("at", "cov"))
    # the place in the upper triangle, row by row
    row = F.floor((2 * r.WIDTH + 1 - F.sqrt(F.lit((2 * r.WIDTH + 1) ** 2) - 8 * F.col("at"))) / 2).cast("int")
    flat = flat.withColumn("i", row)
    first = (F.col("i") * r.WIDTH - F.floor(F.col("i") * (F.col("i") - 1) / 2)).cast("int")
    return flat.select("grp", "i", (F.col("i") + F.col("at") - first).cast("int").alias("j"), r.rounded(F.col("cov")).alias("cov"))


@query("fourier_features", fourier_sql())
def fourier(spark, sf):
    """The explicit map of the radial kernel."""
    made = op.fourier_features(r.embeddings(spark, sf), FOURIER, gamma=0.5, d=r.WIDTH)
    return made.select("row_id", F.posexplode("y").alias("feature", "value")).withColumn("value", r.rounded(F.col("value")))


@query("sv_share", f"""
WITH {EIGEN}
SELECT round((sqrt(e0) + sqrt(e1)) / (sqrt(e0) + sqrt(e1) + sqrt(e2)), 6) AS share FROM eig""")
def sv_share(spark, sf):
    z = op.zscore_rows(r.correlated(spark, sf))
    return r.one_row(spark, share=op.singular_value_share(z, 2))


# --- two components: rounds over long tables, 2 x 2 inverses written out -----


def inverse2(source: str, name: str, a: str, b: str, d: str, more: str = "") -> str:
    """CTE with the inverse i00, i01, i11 of [[a, b], [b, d]]."""
    det = f"(({a}) * ({d}) - ({b}) * ({b}))"
    return f"{name} AS (SELECT *, ({d}) / {det} AS i00, -({b}) / {det} AS i01, ({a}) / {det} AS i11{more} FROM {source})"


def em_k2_sql(cells: str, d: int, kind: str, rounds: int) -> str:
    """Rounds for both noise models from CTE ``cell`` (row_id, col_id, v).

    With per-column noise ``p`` the map is W = (C / p) (I + C' (C / p))^-1; for a
    common noise this is C (C'C + p I)^-1, and the M-step matrix is X'X / n + V.
    """
    isotropic = kind == "ppca"
    ctes = [
        cells,
        "means AS (SELECT col_id, avg(v) AS m, var_pop(v) AS var FROM cell GROUP BY col_id)",
        "z AS (SELECT row_id, col_id, v - m AS z FROM cell JOIN means USING (col_id))",
        "n AS (SELECT count(DISTINCT row_id)::DOUBLE AS n FROM cell)",
        r.FIXED,
        "p0 AS (SELECT a.col_id, a.c AS c0, b.c AS c1, 0.5::DOUBLE AS p, var FROM fixed a "
        "JOIN fixed b USING (col_id) JOIN means USING (col_id) WHERE a.comp = 0 AND b.comp = 1)",
    ]
    for i in range(rounds):
        ctes += [
            f"g{i} AS (SELECT 1 + sum(c0 * c0 / p) AS a, sum(c0 * c1 / p) AS b, 1 + sum(c1 * c1 / p) AS d FROM p{i})",
            inverse2(f"g{i}", f"v{i}", "a", "b", "d"),
            f"w{i} AS (SELECT col_id, (c0 * i00 + c1 * i01) / p AS w0, (c0 * i01 + c1 * i11) / p AS w1 FROM p{i}, v{i})",
            f"x{i} AS (SELECT row_id, sum(z * w0) AS x0, sum(z * w1) AS x1 FROM z JOIN w{i} USING (col_id) GROUP BY row_id)",
            f"q{i} AS (SELECT avg(x0 * x0) + max(i00) AS q00, avg(x0 * x1) + max(i01) AS q01, "
            f"avg(x1 * x1) + max(i11) AS q11 FROM x{i}, v{i})",
            inverse2(f"q{i}", f"j{i}", "q00", "q01", "q11"),
            f"t{i} AS (SELECT col_id, sum(z * x0) / max(n) AS t0, sum(z * x1) / max(n) AS t1 "
            f"FROM z JOIN x{i} USING (row_id), n GROUP BY col_id)",
            f"c{i} AS (SELECT col_id, var, t0, t1, t0 * i00 + t1 * i01 AS c0, t0 * i01 + t1 * i11 AS c1 "
            f"FROM t{i} JOIN p{i} USING (col_id), j{i})",
        ]
        if isotropic:
            noise = (
                "(sum(var) + max(q00) * sum(c0 * c0) + 2 * max(q01) * sum(c0 * c1) + max(q11) * sum(c1 * c1)"
                f" - 2 * sum(c0 * t0 + c1 * t1)) / {d}"
            )
            ctes.append(f"s{i} AS (SELECT {noise} AS p FROM c{i}, q{i})")
            ctes.append(f"p{i + 1} AS (SELECT col_id, c0, c1, p, var FROM c{i}, s{i})")
        else:
            ctes.append(f"p{i + 1} AS (SELECT col_id, c0, c1, var - c0 * t0 - c1 * t1 AS p, var FROM c{i})")
    last = f"p{rounds}"
    return "WITH " + ",\n".join(ctes) + "\n" + "\n UNION ALL ".join(
        f"SELECT col_id, {j} AS comp, round(c{j}, 6) + 0.0 AS loading, round(p, 6) + 0.0 AS noise FROM {last}"
        for j in (0, 1)
    )


def factor_rows(spark, model):
    return model.components(spark).select(
        "col_id",
        F.posexplode(F.coalesce("axes", "loadings")).alias("comp", "loading"),
        r.rounded(F.col("noise")).alias("noise"),
    ).withColumn("loading", r.rounded(F.col("loading")))


def start2(d: int, noise) -> Start:
    return Start(r.fixed_loadings(d, 2), noise)


@query("ppca_fit", em_k2_sql(r.EMBEDDINGS, r.WIDTH, "ppca", 3))
def ppca(spark, sf):
    df = r.embeddings(spark, sf)
    model = op.ppca_fit(df, 2, max_iter=3, tol=0, error_tol=-1, init=start2(r.WIDTH, 0.5), d=r.WIDTH)
    return factor_rows(spark, model)


COUNT_CELLS = f"{r.EVENT_COUNTS}, {r.dense_sql('counts')}, cell AS (SELECT row_id, col_id, value AS v FROM dense)"


@query("ppca_fit_sparse", em_k2_sql(COUNT_CELLS, len(r.TYPES), "ppca", 3))
def ppca_sparse(spark, sf):
    d = len(r.TYPES)
    rows = op.coo_to_sparse(r.event_counts(spark, sf), d, unique=True)
    model = op.ppca_fit(rows, 2, max_iter=3, tol=0, error_tol=-1, init=start2(d, 0.5), d=d, persist=True)
    return factor_rows(spark, model)


@query("fa_fit", em_k2_sql(r.EMBEDDINGS, r.WIDTH, "fa", 3))
def fa(spark, sf):
    df, psi = r.embeddings(spark, sf), np.full(r.WIDTH, 0.5)
    model = op.fa_fit(df, 2, max_iter=3, tol=-np.inf, init=start2(r.WIDTH, psi), d=r.WIDTH)
    return factor_rows(spark, model)


@query("covariance_cells", f"""
WITH {r.EVENT_COUNTS}, {r.dense_sql('counts')}
SELECT a.col_id AS i, b.col_id AS j, round(covar_pop(a.value, b.value), 6) + 0.0 AS cov
FROM dense a JOIN dense b ON b.row_id = a.row_id AND b.col_id >= a.col_id GROUP BY 1, 2""")
def sparse_covariance(spark, sf):
    """Covariances from the stored cells only."""
    cells = r.event_counts(spark, sf)
    n = cells.select("row_id").distinct().count()
    return op.covariance_cells(cells, n, len(r.TYPES)).withColumn("cov", r.rounded(F.col("cov")))


@query("fa_fit_cells", em_k2_sql(COUNT_CELLS, len(r.TYPES), "fa", 2))
def fa_cells(spark, sf):
    """Per-column noise with the model as a table."""
    d = len(r.TYPES)
    cells = r.event_counts(spark, sf)
    n = cells.select("row_id").distinct().count()
    begin = spark.createDataFrame(
        [(j, c.tolist(), 0.5) for j, c in enumerate(r.fixed_loadings(d, 2))],
        "col_id INT, c ARRAY<DOUBLE>, noise DOUBLE",
    )
    model = op.fit_cells(cells, 2, n, d, kind="fa", max_iter=2, tol=-np.inf, start=begin)
    return (
        model.components()
        .select("col_id", F.posexplode("loadings").alias("comp", "loading"), r.rounded(F.col("noise")).alias("noise"))
        .withColumn("loading", r.rounded(F.col("loading")))
    )


@query("ppca_missing_fit")
def missing(spark, sf):
    """Two components, until the objective settles."""
    return factor_rows(spark, op.ppca_missing_fit(r.lineitem_gaps(spark, sf), 2).model)


def missing_scores_sql(rounds: int, n: int = 4) -> str:
    """Filled rows of the last round on the unit loading vector."""
    body = missing_k1_rounds(rounds, n)
    top = f"greatest({each(n, 'abs(c{j})')})"
    sign = " ".join(f"WHEN abs(c{j}) = top THEN sign(c{j})" for j in range(n))
    return f"""{body},
t AS (SELECT {each(n, 'c{j}')}, {top} AS top, sqrt({add(n, 'c{j} * c{j}')}) AS norm FROM n{rounds - 1}),
a AS (SELECT {each(n, 'c{j} / norm AS a{j}')}, CASE {sign} END AS sgn FROM t)
SELECT round(sgn * ({add(n, 'f{j} * a{j}')}), 4) + 0.0 AS value FROM y{rounds}, a"""


@query("ppca_missing_scores", missing_scores_sql(3))
def missing_scores(spark, sf):
    fit = op.ppca_missing_fit(
        r.lineitem_gaps(spark, sf), 1, max_iter=3, tol=0, init=start(4, None), checkpoint_every=2
    )
    return fit.scores().select(r.rounded(F.col("x")[0], 4).alias("value"))


def eigenvector_sql(value: str, comp: int) -> str:
    """Unit eigenvector of the correlation matrix: cross product of two rows of A - value I."""
    return f"""
SELECT {comp} AS comp, a * c - b * (1 - {value}) AS v0, a * b - (1 - {value}) * c AS v1,
       (1 - {value}) * (1 - {value}) - a * a AS v2 FROM co, eig"""


def axes_sql() -> str:
    sign = " ".join(f"WHEN abs(v{j}) = top THEN sign(v{j})" for j in range(3))
    lines = "\n UNION ALL ".join(
        f"SELECT comp, {j} AS col_id, round(v{j} / norm * CASE {sign} END, 6) + 0.0 AS loading FROM s" for j in range(3)
    )
    return f"""
WITH {EIGEN}, v AS ({eigenvector_sql('e0', 0)} UNION ALL {eigenvector_sql('e1', 1)}),
s AS (SELECT *, greatest(abs(v0), abs(v1), abs(v2)) AS top, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS norm FROM v)
{lines}"""


@query("canonical_rotation", axes_sql())
def rotation(spark, sf):
    z = op.zscore_rows(r.correlated(spark, sf))
    model = op.canonical_rotation(z, op.ppca_fit(z, 2, max_iter=2000, tol=1e-15, error_rate=0))
    return factor_rows(spark, model).select("comp", "col_id", "loading")


@query("canonical_rotation_cells", axes_sql())
def rotation_cells(spark, sf):
    """The axes of a model that is a table, saved and loaded: as many components as columns span everything."""
    z = op.zscore_rows(r.correlated(spark, sf)).select("y").withColumn("row_id", F.monotonically_increasing_id())
    rows, _ = stored(z, "numbered-rows")  # order keys repeat; the numbers are fixed once written
    path = scratch_path(spark, "model")
    op.fit_cells(op.cells_of(rows), 3, rows.count(), 3, max_iter=1, canonical=True).save(path)
    model = op.CellModel.load(spark, path)
    axes = model.components().select(F.posexplode("axis").alias("comp", "v"), "col_id").filter("comp < 2")
    return axes.select("comp", "col_id", r.rounded(F.col("v")).alias("loading"))


@query("model_round_trip", ppca_k1_sql(2))
def round_trip(spark, sf):
    path = scratch_path(spark, "model")
    z = op.zscore_rows(r.correlated(spark, sf))
    op.ppca_fit(z, 1, max_iter=2, tol=0, error_rate=0, init=start(3, START_NOISE)).save(spark, path)
    return fitted_rows(spark, op.FactorModel.load(spark, path))


@query("posterior_scores", f"""
WITH {r.EMBEDDINGS}, {r.FIXED}, one AS (SELECT col_id, c FROM fixed WHERE comp = 0),
means AS (SELECT col_id, avg(v) AS m FROM cell GROUP BY col_id), size AS (SELECT sum(c * c) + 0.5 AS m2 FROM one)
SELECT row_id, round(sum((v - m) * c) / max(m2), 6) + 0.0 AS value
FROM cell JOIN one USING (col_id) JOIN means USING (col_id), size GROUP BY row_id""")
def posterior(spark, sf):
    df = r.embeddings(spark, sf)
    mean = column_stats(df, r.WIDTH).mean
    model = op.FactorModel("ppca", r.fixed_loadings()[:, :1], mean, np.full(r.WIDTH, 0.5), 0)
    return model.transform(df, "posterior").select("row_id", r.rounded(F.col("x")[0]).alias("value"))


@query("classifier_accuracy")
def accuracy(spark, sf):
    """Accuracy on rows reduced by each method."""
    table = r.table(spark, sf, "embeddings").withColumn("y", F.col("embedding").cast("array<double>"))
    df = table.select(F.col("vec_id").alias("row_id"), "y", "label")
    k = 10
    plain = df.select("row_id", "y")
    models = {
        "pca": op.pca_fit(plain, k),
        "ppca": op.ppca_fit(plain, k, max_iter=20, error_rate=0, canonical=True, d=r.WIDTH),
        "fa": op.fa_fit(plain, k, max_iter=20, error_rate=0, d=r.WIDTH),
    }
    rows = []
    for name, model in models.items():
        mode = "posterior" if name == "fa" else "centered"
        for kernel in ("linear", "rbf"):
            rows.append((name, kernel, op.accuracy_of(model.transform(df, mode), "label", max_iter=10, kernel=kernel)))
    return spark.createDataFrame(rows, "method STRING, kernel STRING, accuracy DOUBLE")


def comparison_sql() -> str:
    """Both shares from the eigenvalues of 3 x 3 matrices per group.

    PCA: matrix cov_ij / (n var_i var_j) of the variance-normalised columns, square
    roots of its eigenvalues.  PPCA with all components: the correlation matrix.
    """
    names = [(i, j) for i in range(3) for j in range(i, 3)]
    pca = ", ".join(f"covar_pop(y{i}, y{j}) / var_pop(y{i}) / var_pop(y{j}) / count(*) AS a{i}{j}" for i, j in names)
    ppca = ", ".join(f"corr(y{i}, y{j}) AS a{i}{j}" if i != j else f"1.0::DOUBLE AS a{i}{j}" for i, j in names)
    return f"""
WITH g AS (SELECT l_returnflag AS grp, l_quantity AS y0, l_quantity * (1 - l_discount) AS y1,
                  l_extendedprice / 1000 AS y2 FROM lineitem),
m AS (SELECT 'pca' AS method, grp, {pca} FROM g GROUP BY grp UNION ALL SELECT 'ppca', grp, {ppca} FROM g GROUP BY grp),
q AS (SELECT *, (a00 + a11 + a22) / 3 AS q FROM m),
p AS (SELECT *, sqrt(((a00 - q) ** 2 + (a11 - q) ** 2 + (a22 - q) ** 2 + 2 * (a01 ** 2 + a02 ** 2 + a12 ** 2)) / 6) AS p FROM q),
d AS (SELECT *, ((a00 - q) * ((a11 - q) * (a22 - q) - a12 * a12) - a01 * (a01 * (a22 - q) - a12 * a02)
              + a02 * (a01 * a12 - (a11 - q) * a02)) / (2 * p ** 3) AS d FROM p),
f AS (SELECT *, acos(least(1, greatest(-1, d))) / 3 AS phi FROM d),
e AS (SELECT method, grp, q + 2 * p * cos(phi) AS e0, q + 2 * p * cos(phi + 2 * pi() / 3) AS e2, 3 * q AS total FROM f),
v AS (SELECT method, grp, e0, total - e0 - e2 AS e1, e2, total FROM e)
SELECT method, grp, round(CASE WHEN method = 'ppca' THEN (e0 + e1) / total
  ELSE (sqrt(e0) + sqrt(e1)) / (sqrt(e0) + sqrt(e1) + sqrt(e2)) END, 6) AS share FROM v"""


@query("model_comparison", comparison_sql())
def comparison(spark, sf):
    """Groups by return flag: one grouped pass, the fits of all groups side by side."""
    columns = ["l_quantity", F.col("l_quantity") * (1 - F.col("l_discount")), F.col("l_extendedprice") / 1000]
    items = r.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.array(*[F.col(c) if isinstance(c, str) else c for c in columns]).alias("y")
    )
    out = op.model_comparison(items, 2, 3, max_iter=7)
    return out.withColumn("share", r.rounded(F.col("share")))


@query("fit_history", history_sql(3))
def fit_history(spark, sf):
    """Objective, its change and the error over all rows, round by round."""
    z = op.zscore_rows(r.correlated(spark, sf))
    model = op.ppca_fit(z, 1, max_iter=3, tol=0, error_tol=-1, init=start(3, START_NOISE))
    return model.history_frame(spark).select(
        "round", *[r.rounded(F.col(c)).alias(c) for c in ("objective", "rel_change", "error")]
    )


def fa_history_sql(rounds: int) -> str:
    body = fa_k1_sql(rounds)
    body = body[: body.rindex("SELECT 0 AS col_id")] if "SELECT 0 AS col_id" in body else body
    lines = "\n UNION ALL ".join(f"SELECT {i} AS round, round(ll, 3) + 0.0 AS log_likelihood FROM p{i}" for i in range(1, rounds + 1))
    return body + lines


@query("fa_history", fa_history_sql(3))
def fa_history(spark, sf):
    """Log-likelihood of the parameters that each round starts with."""
    z = op.zscore_rows(r.correlated(spark, sf))
    model = op.fa_fit(z, 1, max_iter=3, tol=-np.inf, error_rate=0, init=start(3, np.array(START_PSI)))
    return model.history_frame(spark).select("round", r.rounded(F.col("objective"), 3).alias("log_likelihood"))


def job_sql() -> str:
    body = cells_k1_sql(2)
    body = body[: body.rindex("SELECT 0 AS col_id")] if body.count("SELECT 0 AS col_id") == 1 else body
    pcs = "\n UNION ALL ".join(f"SELECT 'loading' AS what, {j} AS item, round(c{j}, 6) + 0.0 AS value FROM p2" for j in range(5))
    x = add(5, "y{j} * p2.c{j}")
    return f"""{body}{pcs}
 UNION ALL SELECT 'score', row_number() OVER (ORDER BY row_id) - 1, round({x}, 4) + 0.0 FROM wide, p2"""


@query("job_run", job_sql())
def job_run(spark, sf):
    """The jobs from files to files: convert, fit from a given start, project; results read back."""
    from ..job import run
    from ..sources import read_dense, read_vector_text

    top = scratch_path(spark, "job")
    r.event_counts(spark, sf).write.csv(f"{top}/coo")
    spark.createDataFrame([(str(c),) for c in START5], "value STRING").coalesce(1).write.text(f"{top}/start")
    run(spark, ["convert", "-Input", f"{top}/coo", "-InputFmt", "COO", "-Base", "0", "-Output", f"{top}/rows", "-Cardinality", "5"])
    run(spark, [
        "ppca", "-i", f"{top}/rows", "-o", f"{top}/out", "-cols", "5", "-pcs", "1", "-maxIter", "2", "-start", f"{top}/start",
        "-noise", str(START_NOISE), "-errSampleRate", "0", "-computeProjectedMatrix", "1", "-projectedFmt", "VECTOR",
    ])
    pcs = read_dense(spark, f"{top}/out/PCs.txt", 1).select(
        F.lit("loading").alias("what"), F.col("row_id").alias("item"), r.rounded(F.col("y")[0]).alias("value")
    )
    scores = read_vector_text(spark, f"{top}/out/ProjectedMatrix").select(
        F.lit("score").alias("what"), F.col("row_id").alias("item"), r.rounded(F.col("values")[0], 4).alias("value")
    )
    return pcs.unionAll(scores)


@query("projected_parquet", f"""
WITH {r.EMBEDDINGS}, {r.FIXED}
SELECT row_id, comp AS col_id, round(sum(v * c), 6) + 0.0 AS value
FROM cell JOIN fixed USING (col_id) GROUP BY row_id, comp""")
def projected_parquet(spark, sf):
    """Projected rows stored below a job's output folder and read back."""
    from ..sinks import write_projected

    out = scratch_path(spark, "projected")
    model = op.FactorModel("ppca", r.fixed_loadings(), np.zeros(r.WIDTH), np.full(r.WIDTH, 0.5), 0)
    path = write_projected(model.transform(r.embeddings(spark, sf)), out)
    return r.cells(spark.read.parquet(path), "x")


@query("start_values", f"""
WITH {r.EVENT_COUNTS}, cols AS (SELECT DISTINCT col_id FROM counts)
SELECT col_id, CAST(j AS INTEGER) AS comp,
       round(CAST('0x' || substr(md5(col_id || ':7:' || j), 1, 7) AS BIGINT) / 268435456.0, 9) AS value
FROM cols, range(3) k(j)""")
def drawn_start(spark, sf):
    """Start loadings drawn from the columns' numbers: the same on every cluster."""
    from ..operators.cells_fit import uniform_start

    columns = r.event_counts(spark, sf).select("col_id").distinct()
    drawn = columns.select("col_id", F.posexplode(uniform_start(3, 7)).alias("comp", "value"))
    return drawn.withColumn("value", F.round("value", 9))


@query("sample_default_rate", """
WITH n AS (SELECT count(*) AS n FROM orders), rate AS (SELECT n, pow(10, least(0, 4 - length(CAST(n AS VARCHAR)))) AS rate FROM n)
SELECT n, rate, CAST(count(o_orderkey) AS BIGINT) AS sampled, round(coalesce(sum(o_totalprice), 0), 2) + 0.0 AS total
FROM rate LEFT JOIN orders ON rate = 1 OR CAST('0x' || substr(md5(o_orderkey || ':3'), 1, 8) AS BIGINT) < floor(rate * 4294967296)
GROUP BY n, rate""")
def sample_default_rate(spark, sf):
    """The share of rows that the error looks at by default in a job, and the sample it gives."""
    orders = r.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    n = orders.count()
    rate = op.default_sample_rate(n)
    sample = op.sample_rows(orders, rate, seed=3, key="o_orderkey")
    return sample.agg(F.count("*").alias("sampled"), r.rounded(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total")).select(
        F.lit(n).cast("bigint").alias("n"), F.lit(rate).alias("rate"), "sampled", "total"
    )


def missing_k2_sql(rounds: int, n: int = 4) -> str:
    """The refilling fit with two components from a fixed start, on wide rows."""
    begin = ", ".join(
        f"{a}::DOUBLE AS a{j}, {b}::DOUBLE AS b{j}" for j, (a, b) in enumerate(r.fixed_loadings(n, 2).tolist())
    )
    products = [add(n, t) for t in ("a{j} * a{j}", "a{j} * b{j}", "b{j} * b{j}")]
    residual = add(n, "coalesce(pow(u * a{j} + v * b{j} - z{j}, 2), 0)")
    keep = each(n, "z{j}")
    ctes = [
        zscored(r.LINEITEM_GAPS, "lineitem4", n),
        f"total AS (SELECT count(*) AS n, sum({add(n, '(z{j} IS NULL)::INT')}) AS missing FROM z)",
        f"i0 AS (SELECT {begin})",
        inverse2("i0", "c0", *products),
        f"f0 AS (SELECT {keep}, {each(n, 'a{j}, b{j}')}, i00, i01, i11, {add(n, 'coalesce(z{j}, 0) * a{j}')} AS s, "
        f"{add(n, 'coalesce(z{j}, 0) * b{j}')} AS t FROM z, c0)",
        f"x0 AS (SELECT {keep}, {each(n, 'a{j}, b{j}')}, s * i00 + t * i01 AS u, s * i01 + t * i11 AS v FROM f0)",
        f"p0 AS (SELECT {each(n, 'max(a{j}) AS a{j}, max(b{j}) AS b{j}')}, sum({residual}) / (max(n) * {n} - max(missing)) AS ss FROM x0, total)",
    ]
    for i in range(rounds):
        k = i + 1
        ctes += [
            inverse2(f"p{i}", f"q{i}", f"1 + ({products[0]}) / ss", f"({products[1]}) / ss", f"1 + ({products[2]}) / ss"),
            f"d{i} AS (SELECT {each(n, 'e.z{j}')}, {each(n, 'coalesce(e.z{j}, e.u * q.a{j} + e.v * q.b{j}) AS f{j}')}, "
            f"{each(n, 'q.a{j}, q.b{j}')}, q.i00, q.i01, q.i11, q.ss FROM x{i} e, q{i} q)",
            f"h{i} AS (SELECT *, ({add(n, 'f{j} * a{j}')}) / ss AS s, ({add(n, 'f{j} * b{j}')}) / ss AS t FROM d{i})",
            f"y{i} AS (SELECT *, s * i00 + t * i01 AS u, s * i01 + t * i11 AS v FROM h{i})",
            f"s{i} AS (SELECT {each(n, 'sum(f{j} * u) AS ta{j}, sum(f{j} * v) AS tb{j}')}, sum(u * u) + count(*) * max(i00) AS m00, "
            f"sum(u * v) + count(*) * max(i01) AS m01, sum(v * v) + count(*) * max(i11) AS m11, "
            f"max(i00) AS x00, max(i01) AS x01, max(i11) AS x11, max(ss) AS ss FROM y{i})",
            inverse2(f"s{i}", f"m{i}", "m00", "m01", "m11"),
            f"n{i} AS (SELECT {each(n, 'ta{j} * i00 + tb{j} * i01 AS a{j}, ta{j} * i01 + tb{j} * i11 AS b{j}')}, x00, x01, x11, ss FROM m{i})",
            f"x{k} AS (SELECT {each(n, 'y.z{j}')}, y.u, y.v, {each(n, 'k.a{j}, k.b{j}')}, x00, x01, x11, k.ss FROM y{i} y, n{i} k)",
            f"r{i} AS (SELECT {each(n, 'max(a{j}) AS a{j}, max(b{j}) AS b{j}')}, sum({residual}) AS res, max(x00) AS x00, max(x01) AS x01, "
            f"max(x11) AS x11, max(ss) AS ss FROM x{k})",
            f"p{k} AS (SELECT {each(n, 'a{j}, b{j}')}, (res + n * (({products[0]}) * x00 + 2 * ({products[1]}) * x01 + ({products[2]}) * x11)"
            f" + missing * ss) / (n * {n}) AS ss FROM r{i}, total)",
        ]
    last = "\n UNION ALL ".join(
        f"SELECT {j} AS col_id, {c} AS comp, round({x}{j}, 6) + 0.0 AS loading, round(ss, 6) + 0.0 AS noise FROM p{rounds}"
        for j in range(n) for c, x in enumerate("ab")
    )
    return "WITH " + ",\n".join(ctes) + "\n" + last


@query("ppca_missing_fit_k2", missing_k2_sql(3))
def missing_k2(spark, sf):
    """Two components from a fixed start, three rounds."""
    begin = Start(r.fixed_loadings(4, 2), None)
    model = op.ppca_missing_fit(r.lineitem_gaps(spark, sf), 2, max_iter=3, tol=0, init=begin).model
    return model.components(spark).select(
        "col_id", F.posexplode("loadings").alias("comp", "loading"), r.rounded(F.col("noise")).alias("noise")
    ).withColumn("loading", r.rounded(F.col("loading")))


CLASSES = 10


@query("classifier_confusion", f"""
WITH {r.EMBEDDINGS}, w AS (
  SELECT CAST(i AS INTEGER) AS col_id, CAST(c AS INTEGER) AS cls, ((i * 7 + c * 13) % 11 - 5) / 10.0::DOUBLE AS w
  FROM range({r.WIDTH}) a(i), range({CLASSES}) b(c)),
s AS (SELECT row_id, cls, sum(v * w) AS s FROM cell JOIN w USING (col_id) GROUP BY row_id, cls),
best AS (SELECT row_id, cls, row_number() OVER (PARTITION BY row_id ORDER BY round(s, 9) DESC, cls) AS place FROM s),
p AS (SELECT CAST(label AS INTEGER) AS label, cls AS predicted FROM best JOIN embeddings ON vec_id = row_id WHERE place = 1)
SELECT label, predicted, count(*) AS n, (SELECT round(avg((label = predicted)::INT), 6) FROM p) AS accuracy FROM p GROUP BY label, predicted""")
def classifier_confusion(spark, sf):
    """A linear scorer with given weights: how labels and predictions meet."""
    table = r.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("y"), F.col("label").cast("int").alias("label")
    )
    scored = op.linear_classes(table, r.fixed_loadings(r.WIDTH, CLASSES))
    return op.confusion(scored, "label").withColumn("accuracy", F.round("accuracy", 6))
