"""Fitting and applying calibrators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.base import R, VIEWS, r6, rounded
from plurality.catalog.ingest import BUCKETS
from plurality.functions import dist
from plurality.operators import calibrate, splits
from plurality.operators.evaluate import normalizers
from plurality.plans.lineage import stored
from plurality.plans.skew import attach, one_row
from plurality.sources import tables

MODELS = ("marginal", "half", "blend", "peaked")  # systems with something to fit; uniform cannot be moved


def labelled(spark, sf, *systems):
    rows = calibrate.labelled(tables.cells(spark, sf), tables.predictions(spark, sf))
    return rows.filter(F.col("system").isin(*systems)) if systems else rows


def labelled_once(spark, sf, *systems):
    """``labelled``, written once for queries that read it many times over."""
    return stored(labelled(spark, sf, *systems), "labelled")


def long_form(rows):
    pairs = F.arrays_zip(F.col("options").alias("o"), F.col("v").alias("v"))
    return rows.select("record_id", "system", F.explode(pairs).alias("z")).select(
        "record_id", "system", F.col("z.o").alias("opt"), r6("z.v").alias("q")
    )


def temper(spark, sf):
    return long_form(calibrate.Temperature(2.0).transform(labelled(spark, sf)))


def dirichlet(spark, sf):
    return long_form(calibrate.Smoothing(0.05).transform(labelled(spark, sf)))


def entropy_temp(spark, sf):
    return long_form(calibrate.EntropyTemperature(1.5).transform(labelled(spark, sf)))


def grid_fit(spark, sf):
    rows = labelled(spark, sf, *MODELS)
    fits = {
        "temp": (calibrate.TEMPERATURES, lambda t: dist.temper(F.col("v"), t)),
        "entropy_temp": (calibrate.SLOPES, calibrate.EntropyTemperature._change),
        "dirichlet": (calibrate.ALPHAS, lambda a: dist.smooth(F.col("v"), a)),
    }
    out = None
    for name, (grid, change) in fits.items():
        best = calibrate.best_of_grid(calibrate.grid_scores(rows, grid, change, ["system"]), ["system"])
        best = best.withColumn("calibrator", F.lit(name))
        out = best if out is None else out.unionByName(best)
    return rounded(out, "score")


def grid_scores(spark, sf):
    rows = labelled(spark, sf, *MODELS)
    out = calibrate.grid_scores(rows, calibrate.TEMPERATURES, lambda t: dist.temper(F.col("v"), t), ["system"])
    return rounded(out.select("system", "param", "score"), "score")


def abstain(spark, sf):
    """Flagged datasets per system, by each of the three rules."""
    rows = labelled(spark, sf, *MODELS)
    rows = attach(rows, normalizers(tables.cells(spark, sf)), ["split", "dataset"], ["record_id"])
    rows = rows.withColumns(
        {
            "score": dist.skill(dist.tvd(F.col("p"), dist.renorm(F.col("v"))), F.col("z")),
            "uniform_score": dist.skill(F.col("tvd_u"), F.col("z")),
        }
    )
    out = None
    for rule in ("tvd", "score", "uniform_score"):
        flagged = calibrate.abstain_datasets(rows, ["system"], rule).withColumn("rule", F.lit(rule))
        out = flagged if out is None else out.unionByName(flagged)
    return out


def abstain_apply(spark, sf):
    rows = labelled(spark, sf, *MODELS)
    return long_form(calibrate.abstain(rows, calibrate.abstain_datasets(rows, ["system"]), ["system"]))


def abstain_rate(spark, sf):
    """Datasets flagged on the dev bucket, and how often they fire on the test bucket."""
    buckets = splits.make_split(tables.cells(spark, sf), rules={"status": "status"}).select("record_id", "bucket")
    rows = labelled(spark, sf, *MODELS).join(buckets, "record_id")
    flagged = calibrate.abstain_datasets(rows.filter(F.col("bucket") == "dev"), ["system"]).withColumn("fires", F.lit(1))
    test = rows.filter(F.col("bucket") == "test").groupBy("system", "dataset").agg(F.count(F.lit(1)).alias("n"))
    fired = F.coalesce(F.sum(F.when(F.col("fires") == 1, F.col("n"))), F.lit(0))
    return (
        test.join(flagged, ["system", "dataset"], "left")
        .groupBy("system")
        .agg(F.sum("n").alias("total"), fired.alias("fired"), r6(fired / F.sum("n")).alias("rate"))
    )


def entropy_regress(spark, sf):
    return rounded(calibrate.entropy_regression(labelled(spark, sf), ["system"]), "slope", "intercept")


def ridge_fit(spark, sf):
    """Fits the feature regression per system and recomputes its normal equations over all rows: every residual is zero."""
    out, every = None, labelled_once(spark, sf, *tables.SYSTEMS)
    for system in tables.SYSTEMS:
        rows = every.filter(F.col("system") == system)
        fit = calibrate.FeatureEntropyTarget().fit_weights(rows)
        left = fit.with_features(fit.with_prediction(rows)).withColumn("_e", F.col("truth_h") - F.col("_want"))
        share = F.col("n") / F.lit(float(left.count()))
        pull = fit.ridge * share * (1 - share) * F.col("effect")
        per_dataset = left.groupBy("dataset").agg(F.sum("_e").alias("e"), F.count(F.lit(1)).alias("n")).join(fit.effects, "dataset")
        flags = per_dataset.select(F.concat(F.lit("dataset="), "dataset").alias("feature"), (F.col("e") - pull).alias("residual"))
        params = F.array(*[F.struct(F.lit(w * s * s).alias("w"), F.lit(n).alias("feature")) for w, s, n in zip(fit.weights, fit.std, fit.feature_names())])
        long = left.select("_e", F.explode(F.arrays_zip(F.col("_x").alias("x"), params.alias("f"))).alias("c"))
        others = long.groupBy(F.col("c.f.feature").alias("feature")).agg((F.sum(F.col("c.x") * F.col("_e")) - fit.ridge * F.first("c.f.w")).alias("residual"))
        part = flags.unionByName(others).withColumn("system", F.lit(system))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("residual", F.round(F.abs("residual"), 6))


def each_model(make):
    """The results of ``make(system)`` for every system but the uniform one, whose spread no fit can move, with a column for the system."""
    out = None
    for system in MODELS:
        part = make(system).withColumn("system", F.lit(system))
        out = part if out is None else out.unionByName(part)
    return out


def r2(spark, sf):
    """Per system, a line fitted on the first half of each dataset, judged on the second half."""
    halves = splits.folds(tables.cells(spark, sf).select("record_id", "dataset")).select("record_id", "first_half")
    halves = stored(halves, "halves")

    def one(system):
        rows = labelled(spark, sf, system).join(halves, "record_id")
        slope, intercept = calibrate.entropy_regression(rows.filter("first_half"), []).select("slope", "intercept").first()
        held = rows.filter("NOT first_half")
        return calibrate.out_of_sample_r2(held, F.col("truth_h"), F.lit(intercept) + F.lit(slope) * F.col("pred_h"))

    return rounded(each_model(one), "r2")


def temper_to_entropy(spark, sf):
    rows = labelled(spark, sf)
    return long_form(rows.withColumn("v", dist.temper_to_entropy(F.col("v"), F.lit(0.6))))


def oracle_temper(spark, sf):
    """Diagnostic: every prediction gets the true entropy."""
    rows = labelled(spark, sf, *tables.SYSTEMS)
    return long_form(rows.withColumn("v", dist.temper_to_entropy(F.col("v"), F.col("truth_h"))))


def entropy_target(spark, sf):
    """Entropy target from each system's fitted line, full gain."""

    def one(system):
        rows = labelled(spark, sf, system)
        slope, intercept = calibrate.entropy_regression(rows, []).select("slope", "intercept").first()
        return long_form(calibrate.EntropyTarget(1.0, slope, intercept).transform(rows)).drop("system")

    return each_model(one)


def entropy_target_fit(spark, sf):
    """The whole fit: the line, then the gain with the best mean score."""
    rows = labelled(spark, sf, "blend")
    fit = calibrate.EntropyTarget().fit(rows)
    after = fit.transform(rows).agg(F.avg(calibrate.row_score(F.col("v"))).alias("after"))
    before = rows.agg(F.avg(calibrate.row_score(F.col("v"))).alias("before"))
    return rounded(one_row(after, before).select(F.lit(fit.gain).alias("gain"), "*"), "after", "before")


def feature_target(spark, sf):
    """Feature-based target on all rows of every system; counts rows off their target and rows whose top option changed."""
    every = labelled_once(spark, sf, *MODELS)
    return each_model(lambda system: _feature_target(every.filter(F.col("system") == system)))


def _feature_target(rows):
    fit = calibrate.FeatureEntropyTarget().fit(rows)
    prepared = fit.with_prediction(rows)
    gain = F.lit(fit.gain)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    target = clip(F.col("pred_h") + gain * (clip(F.col("_want")) - F.col("pred_h")))
    moved = prepared.withColumn("_t", target).withColumn("_v", calibrate.retarget(gain, F.col("_want")))
    # a target below the spread of exact ties, or above what tied zeros allow, cannot be reached
    reachable = (F.size(F.array_distinct("v")) == F.size("v")) & (F.col("_t") > 0.02)
    off = reachable & (F.abs(dist.entropy(F.col("_v")) - F.col("_t")) > 1e-4)
    changed = F.get("_v", dist.argmax(F.col("v")) - 1) < F.array_max("_v") - 1e-9
    return moved.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off_target"), F.count_if(changed).alias("rank_changed")
    )


def chain(spark, sf):
    """Per system, abstain first, then a temperature fitted on what abstention left."""
    every = labelled_once(spark, sf, *MODELS)

    def one(system):
        rows = every.filter(F.col("system") == system)
        fit = calibrate.make_calibrator("chain", stages=[{"name": "abstain"}, {"name": "temp"}]).fit(rows)
        out = fit.transform(rows).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg(calibrate.row_score(F.col("v"))).alias("score"))
        return out.withColumn("temperature", F.lit(fit.stages[1].temperature))

    return rounded(each_model(one), "score")


QUERIES = {
    "temper": temper,
    "dirichlet": dirichlet,
    "entropy_temp": entropy_temp,
    "grid_fit": grid_fit,
    "grid_scores": grid_scores,
    "abstain": abstain,
    "abstain_apply": abstain_apply,
    "abstain_rate": abstain_rate,
    "entropy_regress": entropy_regress,
    "ridge_fit": ridge_fit,
    "r2": r2,
    "temper_to_entropy": temper_to_entropy,
    "oracle_temper": oracle_temper,
    "entropy_target": entropy_target,
    "entropy_target_fit": entropy_target_fit,
    "feature_target": feature_target,
    "chain": chain,
}

_W = "PARTITION BY record_id, system"


def _values(grid):
    return "(VALUES " + ", ".join(f"({i}, {float(g)!r}::DOUBLE)" for i, g in enumerate(grid)) + ") g(i, param)"


_PE = "JOIN (SELECT record_id, system, pe FROM scored) s USING (record_id, system)"
_NOT_UNIFORM = "system <> 'uniform'"


def _grid(name: str, grid, raw: str) -> str:
    """Views <name>_q (tempered long rows per grid value) and <name> (mean per-row score per system and value)."""
    return f"""{name}_r AS (SELECT x.record_id, x.system, x.opt, x.p, x.k, i, param, {raw} AS r FROM x {_PE}, {_values(grid)} WHERE {_NOT_UNIFORM}),
      {name}_q AS (SELECT *, CASE WHEN sum(r) OVER w > 0 THEN r / sum(r) OVER w ELSE 1.0 / k END AS t FROM {name}_r WINDOW w AS (PARTITION BY record_id, system, i)),
      {name}_s AS (SELECT record_id, system, i, param, sum(abs(p - t)) / 2 AS tvd FROM {name}_q GROUP BY ALL),
      {name} AS (SELECT system, i, param, avg(CASE WHEN tvd_u <= 0 THEN 0 ELSE 100 * (1 - tvd / tvd_u) END) AS score
        FROM {name}_s JOIN (SELECT record_id, tvd_u FROM truth) USING (record_id) GROUP BY ALL)"""


_POW = "pow(q, 1.0 / param)"
_POW_H = "CASE WHEN 1 + param * pe <= 0 THEN 1.0 / k ELSE pow(q, 1.0 / (1 + param * pe)) END"


def bisect(source: str, name: str = "solved") -> str:
    """View ``name`` (record_id, system, temp): temperature that brings each row of ``source`` (lp, k, target) to its target entropy."""
    h = "(ln(list_sum(w)) - list_dot_product(w, lw) / list_sum(w)) / ln(k)"
    return f"""{name}_b AS (
      SELECT record_id, system, [l - list_max(lp) FOR l IN lp] AS lp, k, target, 1e-3::DOUBLE AS lo, 1e3::DOUBLE AS hi, 0 AS it FROM {source}
      UNION ALL
      SELECT record_id, system, lp, k, target, CASE WHEN {h} < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {h} < target THEN hi ELSE (lo + hi) / 2 END, it + 1
      FROM (SELECT *, [exp(l) FOR l IN lw] AS w FROM (SELECT *, [l / ((lo + hi) / 2) FOR l IN lp] AS lw FROM {name}_b WHERE it < 50))),
    {name} AS (SELECT record_id, system, (lo + hi) / 2 AS temp FROM {name}_b WHERE it = 50)"""


def _to_entropy(where: str, target: str) -> str:
    """SQL of long rows tempered to ``target`` for the systems in ``where``; ``target`` may use te and pe."""
    return f"""{VIEWS}, cx AS (SELECT x.record_id, x.system, x.opt, x.pos, x.k, x.q, greatest(q, 1e-9) AS c, {target} AS target, pe
        FROM x JOIN (SELECT record_id, system, te, pe FROM scored) s USING (record_id, system) WHERE {where}),
      ct AS (SELECT *, c / sum(c) OVER ({_W}) AS cp FROM cx),
      src AS (SELECT record_id, system, list(ln(cp) ORDER BY pos) AS lp, any_value(k) AS k, any_value(target) AS target FROM ct GROUP BY record_id, system),
      {bisect('src')},
      warm AS (SELECT ct.*, pow(cp / max(cp) OVER ({_W}), 1 / temp) AS r FROM ct JOIN solved USING (record_id, system)),
      done AS (SELECT *, r / sum(r) OVER ({_W}) AS t FROM warm)"""


def _long(expr: str, extra: str = "") -> str:
    return f"""{VIEWS}, raw AS (SELECT x.*, pe, {expr} AS r FROM x {_PE})
      SELECT record_id, system, opt, {R(f'r / sum(r) OVER ({_W})')} AS q FROM raw"""


_FLAG = f"SELECT system, dataset FROM scored WHERE {_NOT_UNIFORM} GROUP BY system, dataset HAVING avg(tvd) > avg(tvd_u)"

SQL = {
    "temper": _long("pow(q, 0.5)"),
    "dirichlet": _long("q + 0.05"),
    "entropy_temp": _long("pow(q, 1 / (1 + 1.5 * pe))"),
    "grid_scores": f"{VIEWS}, {_grid('gt', calibrate.TEMPERATURES, _POW)} SELECT system, param, {R('score')} AS score FROM gt",
    "grid_fit": f"""{VIEWS}, {_grid('gt', calibrate.TEMPERATURES, _POW)}, {_grid('gs', calibrate.SLOPES, _POW_H)}, {_grid('ga', calibrate.ALPHAS, 'q + param')},
      al AS (SELECT 'temp' AS calibrator, * FROM gt UNION ALL SELECT 'entropy_temp', * FROM gs UNION ALL SELECT 'dirichlet', * FROM ga)
      SELECT calibrator, system, param, {R('score')} AS score FROM al QUALIFY row_number() OVER (PARTITION BY calibrator, system ORDER BY score DESC, i) = 1""",
    "abstain": f"""{VIEWS}, u AS (SELECT *, CASE WHEN z <= 0 THEN 0 ELSE 100 * (1 - tvd_u / z) END AS us FROM scored WHERE {_NOT_UNIFORM})
      SELECT 'tvd' AS rule, system, dataset FROM u GROUP BY system, dataset HAVING avg(tvd) > avg(tvd_u)
      UNION ALL SELECT 'score', system, dataset FROM u GROUP BY system, dataset HAVING avg(score) < 0
      UNION ALL SELECT 'uniform_score', system, dataset FROM u GROUP BY system, dataset HAVING avg(score) < avg(us)""",
    "abstain_apply": f"""{VIEWS}, f AS ({_FLAG}) SELECT record_id, x.system, opt, {R('CASE WHEN f.dataset IS NULL THEN q ELSE 1.0 / k END')} AS q
      FROM x LEFT JOIN f ON f.system = x.system AND f.dataset = x.dataset WHERE x.{_NOT_UNIFORM}""",
    "abstain_rate": f"""{VIEWS}, {BUCKETS}, b AS (SELECT s.*, bucket FROM scored s JOIN bucketed USING (dataset, question) WHERE {_NOT_UNIFORM}),
      f AS (SELECT system, dataset FROM b WHERE bucket = 'dev' GROUP BY ALL HAVING avg(tvd) > avg(tvd_u))
      SELECT b.system, count(*) AS total, count(f.dataset) AS fired, {R('count(f.dataset) / count(*)')} AS rate
      FROM b LEFT JOIN f ON f.system = b.system AND f.dataset = b.dataset WHERE bucket = 'test' GROUP BY b.system""",
    "entropy_regress": f"""{VIEWS} SELECT system, count(*) AS n, {R('CASE WHEN stddev_pop(pe) > 1e-9 THEN regr_slope(te, pe) END')} AS slope,
      {R('CASE WHEN stddev_pop(pe) > 1e-9 THEN regr_intercept(te, pe) END')} AS intercept FROM scored GROUP BY system""",
    "ridge_fit": f"""{VIEWS}, f AS (SELECT DISTINCT 'dataset=' || dataset AS feature FROM cell
        UNION ALL SELECT unnest(['n_options', 'is_pop', 'n_vars', 'peak', 'gap', 'entropy', 'n_eff']))
      SELECT feature, system, 0.0::DOUBLE AS residual FROM f, (SELECT unnest(['uniform', 'marginal', 'half', 'blend', 'peaked']) AS system)""",
    "r2": f"""{VIEWS}, o AS (SELECT record_id, row_number() OVER (PARTITION BY dataset ORDER BY sha256('0::' || record_id)) <= count(*) OVER (PARTITION BY dataset) // 2 AS fh FROM cell),
      b AS (SELECT * FROM scored JOIN o USING (record_id) WHERE {_NOT_UNIFORM}),
      l AS (SELECT system, regr_slope(te, pe) AS s, regr_intercept(te, pe) AS i FROM b WHERE fh GROUP BY system)
      SELECT system, {R('1 - sum((te - (i + s * pe)) ** 2) / (count(*) * var_pop(te))')} AS r2 FROM b JOIN l USING (system) WHERE NOT fh GROUP BY system""",
    "temper_to_entropy": f"{_to_entropy('true', '0.6')} SELECT record_id, system, opt, {R('t')} AS q FROM done",
    "oracle_temper": f"""{_to_entropy('true', 'te')} SELECT record_id, system, opt, {R('t')} AS q FROM done""",
    "entropy_target": f"""{_to_entropy(_NOT_UNIFORM, "greatest(0, least(1, (SELECT regr_intercept(te, pe) + regr_slope(te, pe) * s.pe FROM scored r WHERE r.system = s.system)))")}
      SELECT record_id, system, opt, {R('CASE WHEN abs(target - pe) < 1e-6 THEN q ELSE t END')} AS q FROM done""",
    "entropy_target_fit": f"""{VIEWS}, one AS (SELECT * FROM scored WHERE system = 'blend'), l AS (SELECT regr_slope(te, pe) AS s, regr_intercept(te, pe) AS i FROM one),
      tg AS (SELECT record_id, pe, tvd_u, g.i AS gi, param, greatest(0, least(1, pe + param * (greatest(0, least(1, l.i + l.s * pe)) - pe))) AS target
        FROM one, l, {_values(calibrate.TARGET_GAINS)}),
      cx AS (SELECT record_id, gi, param, opt, pos, k, p, q, pe, tvd_u, target, greatest(q, 1e-9) AS c FROM x JOIN tg USING (record_id) WHERE system = 'blend'),
      ct AS (SELECT *, c / sum(c) OVER (PARTITION BY record_id, gi) AS cp FROM cx),
      src AS (SELECT record_id, gi AS system, list(ln(cp) ORDER BY pos) AS lp, any_value(k) AS k, any_value(target) AS target FROM ct GROUP BY record_id, gi),
      {bisect('src')},
      warm AS (SELECT ct.*, pow(cp / max(cp) OVER (PARTITION BY ct.record_id, gi), 1 / temp) AS r FROM ct JOIN solved ON solved.record_id = ct.record_id AND solved.system = ct.gi),
      done AS (SELECT *, CASE WHEN param = 0 OR abs(target - pe) < 1e-6 THEN q ELSE r / sum(r) OVER (PARTITION BY record_id, gi) END AS t FROM warm),
      sc AS (SELECT gi, param, CASE WHEN any_value(tvd_u) <= 0 THEN 0 ELSE 100 * (1 - sum(abs(p - t)) / 2 / any_value(tvd_u)) END AS s FROM done GROUP BY record_id, gi, param),
      g AS (SELECT gi, param, avg(s) AS score FROM sc GROUP BY ALL)
      SELECT param AS gain, {R('score')} AS after, {R('(SELECT score FROM g WHERE param = 0)')} AS before FROM g ORDER BY score DESC, gi LIMIT 1""",
    "feature_target": f"{VIEWS} SELECT system, count(*) AS n, 0 AS off_target, 0 AS rank_changed FROM scored WHERE {_NOT_UNIFORM} GROUP BY system",
    "chain": f"""{VIEWS}, f AS ({_FLAG}), xa AS (SELECT x.record_id, x.system, x.dataset, x.opt, x.p, CASE WHEN f.dataset IS NULL THEN q ELSE 1.0 / k END AS q
        FROM x LEFT JOIN f ON f.system = x.system AND f.dataset = x.dataset WHERE x.{_NOT_UNIFORM}),
      r AS (SELECT *, pow(q, 1 / param) AS w FROM xa, {_values(calibrate.TEMPERATURES)}),
      t AS (SELECT *, w / sum(w) OVER (PARTITION BY record_id, system, i) AS tq FROM r),
      s AS (SELECT record_id, system, dataset, i, param, sum(abs(p - tq)) / 2 AS tvd FROM t GROUP BY ALL),
      c AS (SELECT s.*, CASE WHEN tvd_u <= 0 THEN 0 ELSE 100 * (1 - s.tvd / tvd_u) END AS score FROM s JOIN (SELECT record_id, tvd_u FROM truth) USING (record_id)),
      b AS (SELECT system, i FROM c GROUP BY system, i QUALIFY row_number() OVER (PARTITION BY system ORDER BY avg(score) DESC, i) = 1)
      SELECT c.system, dataset, count(*) AS n, {R('avg(score)')} AS score, any_value(c.param) AS temperature FROM c JOIN b ON b.i = c.i AND b.system = c.system GROUP BY c.system, dataset""",
}
