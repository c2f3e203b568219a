"""Registered queries: least squares, mixed models, contrasts and predictions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.models.absorbed import fit_absorbed
from panelweave.models.cells import collect_cells
from panelweave.models.contrasts import average_comparisons, mean_predictions
from panelweave.models.design import Design, Factor, Numeric, coded, crossed, main
from panelweave.models.mixed import fit_mixed, likelihood_ratio_table
from panelweave.models.ols import coefficient_table, fit_nested, fit_ols, measure_table
from panelweave.operators import describe
from panelweave.plans import hypotheses, study
from panelweave.plans.bind import table
from panelweave.plans.entries_linkage import LATEST_SQL, STUDY
from panelweave.plans.registry import query, r6, rounded
from panelweave.session import written

FLAG = Factor("l_returnflag", ("A", "N", "R"))
STATUS = Factor("l_linestatus", ("F", "O"))
QTY = Numeric("l_quantity")
_Y = "l_extendedprice / 10000 + (l_suppkey % 7) * CAST(0.8 AS DOUBLE)"


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", f"{_Y} AS y")


_L = f"WITH li AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_quantity AS z, {_Y} AS y FROM lineitem)"


@query("mdl_design", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(1 AS DOUBLE) AS intercept, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END AS flag_n,
    CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS flag_r, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS flag_n_qty FROM lineitem""")
def _(spark, d):
    design = Design.of(crossed(FLAG, QTY))
    rows = coded(table(spark, d, "lineitem"), design)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("(Intercept)").alias("intercept"), F.col("l_returnflagN").alias("flag_n"),
                       F.col("l_returnflagR").alias("flag_r"), F.col("`l_returnflagN:l_quantity`").alias("flag_n_qty"))


_ANCOVA = _L + """, g AS (SELECT l_returnflag AS f, count(*) AS n, avg(z) AS mz, avg(y) AS my, var_pop(z) AS vz, covar_pop(z, y) AS czy, var_pop(y) AS vy FROM li GROUP BY 1),
    s AS (SELECT sum(n) AS n, sum(n * vz) AS szz, sum(n * czy) AS szy, sum(n * vy) AS syy FROM g),
    e AS (SELECT *, szy / szz AS b, syy - szy * szy / szz AS rss, (syy - szy * szy / szz) / (n - 4) AS s2 FROM s),
    a AS (SELECT * FROM g WHERE f = 'A')"""


@query("mdl_ols", _ANCOVA + """ SELECT '(Intercept)' AS term, round(a.my - b * a.mz, 6) AS estimate, round(sqrt(s2 * (1.0 / a.n + a.mz * a.mz / szz)), 6) AS std_error FROM a, e
    UNION ALL SELECT 'l_returnflag' || g.f, round((g.my - b * g.mz) - (a.my - b * a.mz), 6), round(sqrt(s2 * (1.0 / g.n + 1.0 / a.n + pow(g.mz - a.mz, 2) / szz)), 6) FROM g, a, e WHERE g.f <> 'A'
    UNION ALL SELECT 'l_quantity', round(b, 6), round(sqrt(s2 / szz), 6) FROM e""")
def _(spark, d):
    cells = collect_cells(_lines(spark, d), "y", [FLAG], ["l_quantity"])
    fits = {"m": fit_ols(cells, Design.of(main(FLAG, QTY)))}
    return rounded(coefficient_table(spark, fits).select("term", "estimate", "std_error"), "estimate", "std_error")


@query("mdl_ols_fit", _ANCOVA + """, t AS (SELECT var_pop(y) * count(*) AS tss FROM li), m AS (SELECT CAST(e.n AS DOUBLE) AS n, rss, s2, tss, -0.5 * e.n * (ln(2 * pi()) + ln(rss / e.n) + 1) AS ll FROM e, t)
    SELECT measure, round(value, 4) AS value FROM (SELECT unnest(['nobs', 'r2', 'r2_adjusted', 'loglik', 'aic', 'bic', 'f', 'rmse', 'sigma']) AS measure,
    unnest([n, 1 - rss / tss, 1 - (rss / (n - 4)) / (tss / (n - 1)), ll, -2 * ll + 10, -2 * ll + 5 * ln(n), ((tss - rss) / 3) / s2, sqrt(rss / n), sqrt(s2)]) AS value FROM m)""")
def _(spark, d):
    cells = collect_cells(_lines(spark, d), "y", [FLAG], ["l_quantity"])
    out = measure_table(spark, {"m": fit_ols(cells, Design.of(main(FLAG, QTY)))}).where("measure <> 'f_p_value'")
    return rounded(out.select("measure", "value"), "value", digits=4)


_ABSORBED = f"""WITH li AS (SELECT l_partkey, l_quantity AS q, l_discount AS d, {_Y} AS y FROM lineitem),
    g AS (SELECT l_partkey, CAST(count(*) AS DOUBLE) AS n, avg(y) AS my, avg(q) AS mq, avg(d) AS md, covar_pop(q, q) AS qq, covar_pop(q, d) AS qd, covar_pop(d, d) AS dd,
        covar_pop(q, y) AS qy, covar_pop(d, y) AS dy, covar_pop(y, y) AS yy FROM li GROUP BY 1),
    s AS (SELECT sum(n) AS n, count(*) AS levels, sum(n * qq) AS qq, sum(n * qd) AS qd, sum(n * dd) AS dd, sum(n * qy) AS qy, sum(n * dy) AS dy, sum(n * yy) AS yy FROM g),
    b AS (SELECT *, qq * dd - qd * qd AS det, (dd * qy - qd * dy) / (qq * dd - qd * qd) AS bq, (qq * dy - qd * qy) / (qq * dd - qd * qd) AS bd FROM s),
    e AS (SELECT *, yy - bq * qy - bd * dy AS rss, (yy - bq * qy - bd * dy) / (n - levels - 2) AS s2 FROM b)"""


@query("mdl_absorbed", _ABSORBED + """ SELECT 'l_quantity' AS term, round(bq, 6) AS estimate, round(sqrt(s2 * dd / det), 6) AS std_error FROM e
    UNION ALL SELECT 'l_discount', round(bd, 6), round(sqrt(s2 * qq / det), 6) FROM e
    UNION ALL SELECT unnest(['nobs', 'levels', 'df_residual', 'r2_within', 'sigma']), round(unnest([n, CAST(levels AS DOUBLE), n - levels - 2, 1 - rss / yy, sqrt(s2)]), 6), NULL FROM e""")
def _(spark, d):
    fit = _absorbed_fit(spark, d)
    terms = coefficient_table(spark, {"m": fit}).select("term", "estimate", "std_error")
    fitted = measure_table(spark, {"m": fit}).select(F.col("measure").alias("term"), F.col("value").alias("estimate"), F.lit(None).cast("double").alias("std_error"))
    return rounded(terms.unionByName(fitted), "estimate", "std_error")


@query("mdl_absorbed_effects", _ABSORBED + " SELECT l_partkey, CAST(g.n AS BIGINT) AS n, round(my - bq * mq - bd * md, 6) AS effect FROM g, e")
def _(spark, d):
    return rounded(_absorbed_fit(spark, d).effects(), "effect")


def _absorbed_fit(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_partkey", "l_quantity", "l_discount", f"{_Y} AS y")
    return fit_absorbed(rows, "y", Design.of(main(QTY, Numeric("l_discount"))), "l_partkey")


@query("mdl_nested", _L + """, g AS (SELECT l_returnflag AS f, regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM li GROUP BY 1), a AS (SELECT * FROM g WHERE f = 'A')
    SELECT 'qty' AS model, '(Intercept)' AS term, round(regr_intercept(y, z), 6) AS estimate FROM li UNION ALL SELECT 'qty', 'l_quantity', round(regr_slope(y, z), 6) FROM li
    UNION ALL SELECT 'flag * qty', '(Intercept)', round(a, 6) FROM a UNION ALL SELECT 'flag * qty', 'l_quantity', round(b, 6) FROM a
    UNION ALL SELECT 'flag * qty', 'l_returnflag' || g.f, round(g.a - a.a, 6) FROM g, a WHERE g.f <> 'A'
    UNION ALL SELECT 'flag * qty', 'l_returnflag' || g.f || ':l_quantity', round(g.b - a.b, 6) FROM g, a WHERE g.f <> 'A'""")
def _(spark, d):
    cells = collect_cells(_lines(spark, d), "y", [FLAG], ["l_quantity"])
    fits = fit_nested(cells, {"qty": Design.of(main(QTY)), "flag * qty": Design.of(crossed(FLAG, QTY))})
    return rounded(coefficient_table(spark, fits).select("model", "term", "estimate"), "estimate")


@query("mdl_contrasts", _L + """, c AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM li GROUP BY 1, 2),
    e AS (SELECT sum(n * v) / (sum(n) - count(*)) AS s2 FROM c)
    SELECT c.f || ' - A' AS contrast, c.s AS l_linestatus, round(c.m - a.m, 6) AS estimate, round(sqrt(s2 * (1.0 / c.n + 1.0 / a.n)), 6) AS std_error,
    round((c.m - a.m) / sqrt(s2 * (1.0 / c.n + 1.0 / a.n)), 5) AS statistic, round(c.m - a.m - 1.959963984540054 * sqrt(s2 * (1.0 / c.n + 1.0 / a.n)), 6) AS conf_low,
    round(c.m - a.m + 1.959963984540054 * sqrt(s2 * (1.0 / c.n + 1.0 / a.n)), 6) AS conf_high FROM c JOIN c a ON a.f = 'A' AND a.s = c.s, e WHERE c.f <> 'A'""")
def _(spark, d):
    cells = collect_cells(_lines(spark, d), "y", [FLAG, STATUS])
    fit = fit_ols(cells, Design.of(crossed(FLAG, STATUS)))
    out = average_comparisons(spark, fit, cells, FLAG, ["l_linestatus"])
    out = rounded(out.select("contrast", "l_linestatus", "estimate", "std_error", "statistic", "conf_low", "conf_high"),
                  "estimate", "std_error", "conf_low", "conf_high")
    return rounded(out, "statistic", digits=5)


def _profile_sql(reml: bool, slope: bool, tag: str, levels: int = 6, width: int = 200) -> str:
    """Random-intercept fit in SQL: the profiled criterion on a grid of theta, refined level by level."""
    free = f"(t.n - {2 if slope else 1})" if reml else "t.n"
    parts = [
        f"grp{tag} AS (SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS n, sum(z - c.mz) AS sz, sum(y - c.my) AS sy FROM li, (SELECT avg(z) AS mz, avg(y) AS my FROM li) c GROUP BY 1)",
        f"t{tag} AS (SELECT CAST(count(*) AS DOUBLE) AS n, var_pop(z) * count(*) AS zz, covar_pop(z, y) * count(*) AS zy, var_pop(y) * count(*) AS yy, avg(z) AS mz, avg(y) AS my FROM li)",
    ]
    sums = ("sum(ln(1 + h * h * n)) AS ld, sum(h * h / (1 + h * h * n) * n * n) AS w11, sum(h * h / (1 + h * h * n) * n * sz) AS w1z, sum(h * h / (1 + h * h * n) * sz * sz) AS wzz, "
            "sum(h * h / (1 + h * h * n) * n * sy) AS w1y, sum(h * h / (1 + h * h * n) * sz * sy) AS wzy, sum(h * h / (1 + h * h * n) * sy * sy) AS wyy")
    if slope:
        solve = ("(b1 * a22 - b2 * a12) / det AS beta0, (b2 * a11 - b1 * a12) / det AS beta1, byy - (b1 * (b1 * a22 - b2 * a12) + b2 * (b2 * a11 - b1 * a12)) / det AS r2, ln(det) AS lda")
    else:
        solve = "b1 / a11 AS beta0, CAST(0 AS DOUBLE) AS beta1, byy - b1 * b1 / a11 AS r2, ln(a11) AS lda"
    previous = None
    for k in range(levels):
        grid = (f"SELECT CAST(i AS DOUBLE) * 4 / {width} AS h FROM generate_series(0, {width}) r(i)" if previous is None else
                f"SELECT greatest(h + (CAST(i AS DOUBLE) / {width} - 0.5) * {4 * 4 ** 1 / width} * pow({4.0 / width}, {k - 1}), 0) AS h FROM {previous}, generate_series(0, {width}) r(i)")
        parts.append(f"e{tag}{k} AS (SELECT h, {sums} FROM ({grid}) x CROSS JOIN grp{tag} GROUP BY h)")
        parts.append(f"f{tag}{k} AS (SELECT *, (a11 * a22 - a12 * a12) AS det FROM (SELECT e.*, t.n - w11 AS a11, -w1z AS a12, t.zz - wzz AS a22, -w1y AS b1, t.zy - wzy AS b2, t.yy - wyy AS byy, t.n AS n, t.mz AS mz, t.my AS my FROM e{tag}{k} e, t{tag} t))")
        parts.append(f"d{tag}{k} AS (SELECT *, ld + {'lda + ' if reml else ''}free * (1 + ln(2 * pi() * r2 / free)) AS dev, r2 / free AS s2 FROM (SELECT f.*, {solve}, {free.replace('t.n', 'f.n')} AS free FROM f{tag}{k} f))")
        parts.append(f"best{tag}{k} AS (SELECT * FROM d{tag}{k} ORDER BY dev, h LIMIT 1)")
        previous = f"best{tag}{k}"
    parts.append(f"fit{tag} AS (SELECT *, beta0 + my - beta1 * mz AS intercept FROM {previous})")
    return ", ".join(parts)


def _ri_terms(tag: str) -> str:
    return f"""SELECT '(Intercept)' AS term, round(intercept, 3) AS estimate FROM fit{tag} UNION ALL SELECT 'l_quantity', round(beta1, 5) FROM fit{tag}
    UNION ALL SELECT 'sd__(Intercept)', round(h * sqrt(s2), 3) FROM fit{tag} UNION ALL SELECT 'sd__Observation', round(sqrt(s2), 4) FROM fit{tag}"""


def _ri_query(spark, d, reml: bool) -> DataFrame:
    cells = collect_cells(_lines(spark, d), "y", [], ["l_quantity"], group="l_suppkey")
    fit = fit_mixed(cells, Design.of(main(QTY)), reml=reml)
    rows = coefficient_table(spark, {"m": fit}).select("term", "estimate")
    value = F.when(F.col("term") == "l_quantity", r6("estimate", 5)).when(F.col("term") == "sd__Observation", r6("estimate", 4))
    return rows.withColumn("estimate", value.otherwise(r6("estimate", 3)))


@query("mdl_lmm_ri", f"{_L}, {_profile_sql(False, True, 'a')} {_ri_terms('a')}")
def _(spark, d):
    return _ri_query(spark, d, reml=False)


@query("mdl_lmm_reml", f"{_L}, {_profile_sql(True, True, 'a')} {_ri_terms('a')}")
def _(spark, d):
    return _ri_query(spark, d, reml=True)


@query("mdl_lrt", f"""{_L}, {_profile_sql(False, False, 'a')}, {_profile_sql(False, True, 'b')}
    SELECT 'null' AS model, CAST(3 AS INTEGER) AS npar, round(dev + 6, 3) AS aic, round(dev + 3 * ln(n), 3) AS bic, round(dev, 3) AS deviance, CAST(NULL AS DOUBLE) AS chisq, CAST(NULL AS INTEGER) AS df FROM fita
    UNION ALL SELECT '+ quantity', 4, round(b.dev + 8, 3), round(b.dev + 4 * ln(b.n), 3), round(b.dev, 3), round(a.dev - b.dev, 3), 1 FROM fita a, fitb b""")
def _(spark, d):
    cells = collect_cells(_lines(spark, d), "y", [], ["l_quantity"], group="l_suppkey")
    fits = {"null": fit_mixed(cells, Design.of([])), "+ quantity": fit_mixed(cells, Design.of(main(QTY)))}
    out = likelihood_ratio_table(spark, fits).select("model", "npar", "aic", "bic", "deviance", "chisq", "df")
    return rounded(out, "aic", "bic", "deviance", "chisq", digits=3)


_BLUP = "h * h / (1 + h * h * g.n) * (g.sy - g.n * beta0 - g.sz * beta1)"


@query("mdl_blup", f"""{_L}, {_profile_sql(True, True, 'a')} SELECT l_suppkey, '(Intercept)' AS term, round(intercept + {_BLUP}, 3) AS value FROM grpa g, fita
    UNION ALL SELECT l_suppkey, 'l_quantity', round(beta1, 3) FROM grpa g, fita""")
def _(spark, d):
    cells = collect_cells(_lines(spark, d), "y", [], ["l_quantity"], group="l_suppkey")
    fit = fit_mixed(cells, Design.of(main(QTY)), reml=True)
    return rounded(fit.group_coefficients(), "value", digits=3)


@query("mdl_r2_icc", f"""{_L}, {_profile_sql(True, True, 'a')}, v AS (SELECT var_samp(l.z) * any_value(beta1) * any_value(beta1) AS vf, any_value(h * h * s2) AS vr, any_value(s2) AS s2 FROM li l, fita),
    b AS (SELECT l_suppkey, {_BLUP} AS b FROM grpa g, fita)
    SELECT 'r2_marginal' AS measure, round(vf / (vf + vr + s2), 4) AS value FROM v UNION ALL SELECT 'r2_conditional', round((vf + vr) / (vf + vr + s2), 4) FROM v
    UNION ALL SELECT 'icc', round(vr / (vr + s2), 4) FROM v UNION ALL SELECT 'sigma', round(sqrt(s2), 4) FROM v
    UNION ALL SELECT 'rmse', round(sqrt(avg(pow(y - intercept - beta1 * z - b, 2))), 4) FROM li JOIN b USING (l_suppkey), fita""")
def _(spark, d):
    cells = collect_cells(_lines(spark, d), "y", [], ["l_quantity"], group="l_suppkey")
    fit = fit_mixed(cells, Design.of(main(QTY)), reml=True)
    out = measure_table(spark, {"m": fit}).where(F.col("measure").isin("r2_marginal", "r2_conditional", "icc", "sigma", "rmse"))
    return rounded(out.select("measure", "value"), "value", digits=4)


@query("mdl_predictions", f"""{_L}, {_profile_sql(True, True, 'a')}, b AS (SELECT l_suppkey, {_BLUP} AS b FROM grpa g, fita)
    SELECT l_suppkey, count(*) AS n, round(avg(intercept + beta1 * z + b), 3) AS mean_prediction FROM li JOIN b USING (l_suppkey), fita GROUP BY l_suppkey""")
def _(spark, d):
    cells = collect_cells(_lines(spark, d), "y", [], ["l_quantity"], group="l_suppkey")
    fit = fit_mixed(cells, Design.of(main(QTY)), reml=True)
    return rounded(mean_predictions(fit, ["l_suppkey"]), "mean_prediction", digits=3)


# --- two kinds of rows: intercepts and slopes by supplier ---------------------------------------------

_OPEN = Factor("l_linestatus", ("F", "O"))
_SLOPED = "l_extendedprice / 10000 + (l_suppkey % 7) * CAST(0.8 AS DOUBLE) + CASE WHEN l_linestatus = 'O' THEN (l_suppkey % 5) * CAST(0.5 AS DOUBLE) ELSE 0 END"


def _slope_sql(tag: str, slopes: bool, levels: int = 11) -> str:
    """Profile likelihood of intercepts (and slopes) for a two-level factor, by a grid refined around its best point.

    With Z = X = (1, s) and the factor [[a, 0], [b, c]], a group's matrix is 2 x 2: its determinant and inverse
    are written out. Without slopes b = c = 0.
    """
    width = 8 if slopes else 32
    q = "((m22 * {0} * {2} - m12 * ({0} * {3} + {1} * {2}) + m11 * {1} * {3}) / det)"
    t = {"x": ("(a * n + b * k)", "(c * k)"), "s": ("(a * k + b * k)", "(c * k)"), "y": ("(a * sy + b * ky)", "(c * ky)")}
    sums = ", ".join(f"sum({q.format(*t[u], *t[v])}) AS w{u}{v}" for u, v in ("xx", "xs", "ss", "xy", "sy", "yy"))
    parts = [f"""grp{tag} AS (SELECT l_suppkey, count(*)::DOUBLE AS n, sum(s) AS k, sum(v) AS sy, sum(s * v) AS ky FROM (
        SELECT l_suppkey, CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END AS s, {_SLOPED} - (SELECT avg({_SLOPED}) FROM lineitem) AS v FROM lineitem) GROUP BY 1)""",
        f"all{tag} AS (SELECT sum(n) AS n, sum(k) AS k, sum(sy) AS sy, sum(ky) AS ky, (SELECT var_pop({_SLOPED}) * count(*) FROM lineitem) AS yy FROM grp{tag})"]
    previous = None
    for level in range(levels):
        at = lambda i: f"(CAST({i} AS DOUBLE) / {width} - 0.5)"
        size = 4.0 * (0.5 ** level if slopes else 0.125 ** level)
        if previous is None:
            axes = {"a": f"2 + {size} * {at('i')}", "b": f"{size} * {at('j')}" if slopes else "0.0", "c": f"2 + {size} * {at('h')}" if slopes else "0.0"}
            source = f"generate_series(0, {width}) r(i)" + (f", generate_series(0, {width}) u(j), generate_series(0, {width}) v(h)" if slopes else "")
        else:
            axes = {"a": f"greatest(a + {size} * {at('i')}, 0)", "b": f"b + {size} * {at('j')}" if slopes else "0.0", "c": f"greatest(c + {size} * {at('h')}, 0)" if slopes else "0.0"}
            source = f"{previous}, generate_series(0, {width}) r(i)" + (f", generate_series(0, {width}) u(j), generate_series(0, {width}) v(h)" if slopes else "")
        grid = "SELECT DISTINCT " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in axes.items()) + f" FROM {source}"
        inner = "SELECT *, m11 * m22 - m12 * m12 AS det FROM (SELECT *, 1 + a * a * n + 2 * a * b * k + b * b * k AS m11, k * c * (a + b) AS m12, 1 + k * c * c AS m22 FROM grp" + tag + f" CROSS JOIN ({grid}))"
        parts.append(f"e{tag}{level} AS (SELECT a, b, c, sum(ln(det)) AS ld, {sums} FROM ({inner}) GROUP BY a, b, c)")
        parts.append(f"""f{tag}{level} AS (SELECT e.*, t.n AS n_rows, t.n - wxx AS g11, t.k - wxs AS g12, t.k - wss AS g22, t.sy - wxy AS h1, t.ky - wsy AS h2, t.yy - wyy AS hyy
            FROM e{tag}{level} e, all{tag} t)""")
        parts.append(f"""d{tag}{level} AS (SELECT *, ld + n_rows * (1 + ln(2 * pi() * (hyy - (g22 * h1 * h1 - 2 * g12 * h1 * h2 + g11 * h2 * h2) / (g11 * g22 - g12 * g12)) / n_rows)) AS dev
            FROM f{tag}{level})""")
        parts.append(f"best{tag}{level} AS (SELECT a, b, c, dev, n_rows FROM d{tag}{level} ORDER BY dev, a, b, c LIMIT 1)")
        previous = f"best{tag}{level}"
    return ", ".join(parts) + f", fit{tag} AS (SELECT * FROM {previous})"


@query("mdl_lmm_rs", f"""WITH {_slope_sql('p', False, 7)}, {_slope_sql('r', True, 22)}
    SELECT 'fixed slope' AS model, 4 AS npar, round(dev + 8, 2) AS aic, round(dev, 2) AS deviance, CAST(NULL AS DOUBLE) AS chisq, CAST(NULL AS INTEGER) AS df FROM fitp
    UNION ALL SELECT 'random slope', 6, round(r.dev + 12, 2), round(r.dev, 2), round(p.dev - r.dev, 2), 2 FROM fitp p, fitr r""")
def _(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey", "l_linestatus", f"{_SLOPED} AS y")
    cells, design = collect_cells(rows, "y", [_OPEN], group="l_suppkey"), Design.of(main(_OPEN))
    fits = {"fixed slope": fit_mixed(cells, design), "random slope": fit_mixed(cells, design, ("(Intercept)", "l_linestatusO"))}
    out = likelihood_ratio_table(spark, fits).select("model", "npar", "aic", "deviance", "chisq", "df")
    return rounded(out, "aic", "deviance", "chisq", digits=2)


# --- a balanced table: one row per supplier and cell ---------------------------------------------------

LINE, PARITY = Factor("line", ("1", "2", "3")), Factor("parity", ("even", "odd"))
_CELLS = """SELECT l_suppkey, CASE WHEN l_linenumber <= 2 THEN '1' WHEN l_linenumber <= 4 THEN '2' ELSE '3' END AS line, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
    avg(l_extendedprice / 10000) + (l_suppkey % 7) * CAST(0.8 AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2, 3, l_suppkey % 7"""
_BALANCED = f"""WITH bal AS ({_CELLS}),
    mean AS (SELECT line, parity, count(*) AS n, avg(y) AS m FROM bal GROUP BY 1, 2),
    rest AS (SELECT y - avg(y) OVER (PARTITION BY l_suppkey) - avg(y) OVER (PARTITION BY line, parity) + avg(y) OVER () AS e FROM bal),
    s2 AS (SELECT sum(e * e) / (((SELECT count(DISTINCT l_suppkey) FROM bal) - 1) * 5) AS v FROM rest)"""


def _balanced_fit(spark, d):
    """REML fit of a saturated model over the cell means of all lines, a row per supplier and cell.

    Every supplier has lines in every cell, so the fit is balanced: cell means, and errors within suppliers.
    """
    line = F.when(F.col("l_linenumber") <= 2, "1").when(F.col("l_linenumber") <= 4, "2").otherwise("3")
    cell = table(spark, d, "lineitem").groupBy(
        "l_suppkey", line.alias("line"), F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd").alias("parity")
    ).agg((F.avg(F.col("l_extendedprice") / 10000)).alias("m"))
    cell = written(cell.withColumn("y", F.col("m") + (F.col("l_suppkey") % 7) * F.lit(0.8)), "balanced")
    cells = collect_cells(cell, "y", [LINE, PARITY], group="l_suppkey")
    return cells, fit_mixed(cells, Design.of(crossed(LINE, PARITY)), reml=True)


@query("mdl_contrasts_mixed", f"""{_BALANCED} SELECT 'line' AS term, a.line || ' - 1' AS contrast, a.parity, round(a.m - b.m, 5) AS estimate, round(sqrt(2 * v / a.n), 5) AS std_error,
    round((a.m - b.m) / sqrt(2 * v / a.n), 3) AS statistic FROM mean a JOIN mean b ON a.parity = b.parity AND b.line = '1', s2 WHERE a.line <> '1'""")
def _(spark, d):
    cells, fit = _balanced_fit(spark, d)
    out = average_comparisons(spark, fit, cells, LINE, ["parity"]).select("term", "contrast", "parity", "estimate", "std_error", "statistic")
    return rounded(rounded(out, "estimate", "std_error", digits=5), "statistic", digits=3)


@query("mdl_predictions_factors", f"{_BALANCED} SELECT line, parity, n, round(m, 6) AS mean_prediction FROM mean")
def _(spark, d):
    _, fit = _balanced_fit(spark, d)
    return rounded(mean_predictions(fit, ["line", "parity"]), "mean_prediction")


# --- all lines: unbalanced cells and a covariate, without SQL (REML has no closed form there) -----------


def _whole_fit(spark, d):
    cells = collect_cells(_lines(spark, d), "y", [FLAG, STATUS], ["l_quantity"], group="l_suppkey")
    return cells, fit_mixed(cells, Design.of([*crossed(FLAG, STATUS), *main(QTY)]), reml=True)


@query("mdl_contrasts_mixed_whole")
def _(spark, d):
    cells, fit = _whole_fit(spark, d)
    return average_comparisons(spark, fit, cells, FLAG, ["l_linestatus"])


@query("mdl_predictions_factors_whole")
def _(spark, d):
    _, fit = _whole_fit(spark, d)
    return mean_predictions(fit, ["l_returnflag", "l_linestatus"])


# --- the catalogue over the enriched panel -------------------------------------------------------------


def _study(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = written(study.enriched_panel(**study.inputs_from_tables(spark, d)), "study")
    return written(study.latest_people(rows), "study-people"), rows


def _files(spark, d) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of the files of the tables."""
    root = spark._jvm.org.apache.hadoop.fs.Path(d)
    found, out = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


@lru_cache(maxsize=2)
def _fitted(spark, d, files) -> hypotheses.Catalogue:
    return hypotheses.all_models(*_study(spark, d))


def _catalogue(spark, d) -> hypotheses.Catalogue:
    """All models over these tables as they are now; the queries below show different tables of one catalogue."""
    return _fitted(spark, d, _files(spark, d))


_SAMPLE = STUDY + f""", latest AS (SELECT cid, {LATEST_SQL} FROM study GROUP BY cid),
    sample AS (SELECT contributor_score AS y, ff49_abbr IN ('Softw', 'Hardw', 'Chips') AS tech, ff49_abbr AS industry, occupation_std, is_sec_insider, gender FROM latest
      WHERE contributor_score IS NOT NULL AND occupation_std IS NOT NULL AND mean_score_zipcode_wo_i IS NOT NULL AND ff49_abbr IS NOT NULL AND gender IS NOT NULL AND is_sec_insider IS NOT NULL),
    part AS (SELECT 'h1' AS h, * FROM sample UNION ALL SELECT 'h3 managers', * FROM sample WHERE occupation_std = 'manager' UNION ALL SELECT 'h3 insiders', * FROM sample WHERE is_sec_insider),
    long AS (SELECT h || ' tech: baseline' AS model, 'ff49_is_techTRUE' AS term, tech AS hit, y FROM part)"""


@query("study_baselines", f"""{_SAMPLE}, g AS (SELECT model, term, hit, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM long GROUP BY 1, 2, 3),
    s AS (SELECT model, sum(ss) / (sum(n) - 2) AS s2 FROM g GROUP BY 1 HAVING count(*) = 2 AND sum(n) > 2)
    SELECT g.model, g.term, round(g.m - r.m, 6) AS estimate, round(sqrt(s2 * (1.0 / g.n + 1.0 / r.n)), 6) AS std_error
    FROM g JOIN g r ON g.model = r.model AND NOT r.hit JOIN s ON s.model = g.model WHERE g.hit""")
def _(spark, d):
    people, rows = _study(spark, d)
    whole, _ = hypotheses.estimation_samples(people, rows)
    fits = {k: f for k, f in (hypotheses.h1(whole) | hypotheses.h3(whole)).fits.items() if k.endswith("tech: baseline")}
    out = coefficient_table(spark, fits).where("term = 'ff49_is_techTRUE' AND NOT isnan(estimate) AND NOT isnan(std_error)")
    return rounded(out.select("model", "term", "estimate", "std_error"), "estimate", "std_error")


@query("study_mean_ci", f"""{_SAMPLE} SELECT industry AS ff49_abbr, tech AS ff49_is_tech, count(*) AS n, round(avg(y), 9) AS mean, round(stddev_samp(y), 9) AS sd, round(stddev_samp(y) / sqrt(count(*)), 9) AS se,
    round(avg(y) - 2 * stddev_samp(y) / sqrt(count(*)), 9) AS lo, round(avg(y) + 2 * stddev_samp(y) / sqrt(count(*)), 9) AS hi FROM sample GROUP BY 1, 2""")
def _(spark, d):
    whole, _ = hypotheses.estimation_samples(*_study(spark, d))
    return rounded(describe.mean_ci(whole, [hypotheses.INDUSTRY, hypotheses.TECH.name], hypotheses.STATIC), "mean", "sd", "se", "lo", "hi", digits=9)


@query("study_box", f"""{_SAMPLE}, q AS (SELECT occupation_std, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.75) AS q3 FROM sample GROUP BY 1)
    SELECT occupation_std, count(*) AS n, any_value(q1) AS q1, any_value(m) AS median, any_value(q3) AS q3, min(y) FILTER (WHERE y >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
    max(y) FILTER (WHERE y <= q3 + 1.5 * (q3 - q1)) AS whisker_hi, count(*) FILTER (WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM sample JOIN q USING (occupation_std) GROUP BY occupation_std""")
def _(spark, d):
    whole, _ = hypotheses.estimation_samples(*_study(spark, d))
    return describe.box_stats(whole, ["occupation_std"], hypotheses.STATIC)


@query("study_composition", f"""{_SAMPLE} SELECT occupation_std, gender, n, round(n / sum(n) OVER (PARTITION BY occupation_std), 9) AS share FROM (
    SELECT occupation_std, gender, count(*) AS n FROM sample GROUP BY 1, 2)""")
def _(spark, d):
    whole, _ = hypotheses.estimation_samples(*_study(spark, d))
    return rounded(describe.composition(whole, "occupation_std", "gender"), "share", digits=9)


@query("study_models")
def _(spark, d):
    return coefficient_table(spark, _catalogue(spark, d).fits)


@query("study_skipped")
def _(spark, d):
    found = _catalogue(spark, d)
    return hypotheses.skipped_models(spark, found).unionByName(
        spark.createDataFrame([(name, "fitted") for name in found.fits], "model string, reason string")
    )


@query("study_likelihood_ratios")
def _(spark, d):
    return hypotheses.likelihood_ratio_tables(spark, _catalogue(spark, d))


@query("study_group_coefficients")
def _(spark, d):
    return hypotheses.group_coefficient_tables(spark, _catalogue(spark, d))


@query("study_contrasts")
def _(spark, d):
    return hypotheses.contrast_tables(spark, _catalogue(spark, d))


@query("study_predictions")
def _(spark, d):
    return hypotheses.prediction_tables(spark, _catalogue(spark, d))
