"""Learned models, attributions and recursive forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformal, explain, sequences, splits
from ..operators import metrics as M
from ..operators.joins import null_safe_join
from ..operators.sun import campus_coordinates
from ..operators.time_features import add_lags
from ..plans import build, evaluate, forecast, learn, windows
from ..session import cut_lineage
from ..sources import driver_tables as D
from .columns import SUN_SQL, TRAIN_CHANNELS, channel_rows, site_text
from .registry import CTES, query
from .scans import SCENARIOS


def features(spark, folder):
    return splits.chronological_split(build.build_features(D.panel(spark, folder)))


ZONE = "Etc/GMT-10"
KEYS = ["site_id", "timestamp"]


def fitted_trees(spark, folder):
    """Features written once, and the trees fitted on them with the library's settings, which are the source's."""
    df = cut_lineage(features(spark, folder))
    return df, learn.train_gbt(df)


@query("train_gbt", "timed", """
    SELECT split, count(power) AS n_eval, (SELECT count(power) FROM timed WHERE split = 'train') AS n_train_rows, true AS below_persistence
    FROM timed WHERE split <> 'train' GROUP BY 1""")
def train_gbt(spark, folder):
    """Rows fitted and scored, and whether the trees' mean absolute error is below that of the value 24 h before."""
    df, model = fitted_trees(spark, folder)
    scored = model.predict(df.where(F.col("split") != "train"))
    mae, before = (F.avg(F.abs(F.col("power") - F.col(c))) for c in ("prediction", "power_lag_96"))
    return scored.groupBy("split").agg(F.count("power").alias("n_eval"), F.lit(model.info["n_train_rows"]).alias("n_train_rows"), (mae < before).alias("below_persistence"))


@query("gbt_leaderboard")
def gbt_leaderboard(spark, folder):
    df, model = fitted_trees(spark, folder)
    return site_text(evaluate.model_leaderboard(model.predict(df).withColumn("model", F.lit("gbt")), df))


@query("feature_importance")
def feature_importance(spark, folder):
    return learn.feature_importance(fitted_trees(spark, folder)[1], spark)


@query("tree_importance")
def tree_importance(spark, folder):
    """Inputs ranked by the attributions of all test rows to the fitted trees."""
    df, model = fitted_trees(spark, folder)
    return explain.global_importance(model.contributions(df.where(F.col("split") == "test"), KEYS))


@query("tree_explanations")
def tree_explanations(spark, folder):
    """One representative row per scenario, its strongest inputs and the rest."""
    df, model = fitted_trees(spark, folder)
    chosen = explain.pick_representatives(df).select("scenario", *KEYS)
    parts = model.contributions(null_safe_join(df, F.broadcast(chosen), KEYS), ["scenario", *KEYS])  # at most one row per scenario
    return explain.contribution_table(parts, ["scenario", *KEYS])


LINEAR_INPUTS = ["power_lag_1", "power_lag_96", "power_rolling_mean_86400s", "temperature", "humidity", "sin_hour", "cos_hour"]


CTES["two"] = ("panel timed p24", """
    SELECT p.site_id, p.timestamp, t.split, p.power, p.temperature AS x1, q.p24 AS x2
    FROM panel p JOIN timed t USING (site_id, timestamp) JOIN p24 q USING (site_id, timestamp)""")
CTES["twomean"] = ("two", "SELECT avg(x1) AS m1, avg(x2) AS m2 FROM two WHERE split = 'train' AND power IS NOT NULL")
CTES["twofit"] = ("two twomean", """
    SELECT m1, m2, (covar_pop(f1, power) * var_pop(f2) - covar_pop(f2, power) * covar_pop(f1, f2)) / (var_pop(f1) * var_pop(f2) - covar_pop(f1, f2) ** 2) AS b1,
           (covar_pop(f2, power) * var_pop(f1) - covar_pop(f1, power) * covar_pop(f1, f2)) / (var_pop(f1) * var_pop(f2) - covar_pop(f1, f2) ** 2) AS b2
    FROM (SELECT power, coalesce(x1, m1) AS f1, coalesce(x2, m2) AS f2, m1, m2 FROM two, twomean WHERE split = 'train' AND power IS NOT NULL) GROUP BY m1, m2""")


@query("contributions", "two twofit", """
    SELECT *, row_number() OVER (ORDER BY mean_abs DESC) AS rank, mean_abs / sum(mean_abs) OVER () AS share_of_total FROM (
        SELECT feature, avg(abs(c)) AS mean_abs, avg(c) AS mean, max(abs(c)) AS max_abs FROM (
            SELECT 'temperature' AS feature, coalesce((x1 - m1) * b1, 0) AS c FROM two, twofit WHERE split = 'test'
            UNION ALL SELECT 'power_lag_96', coalesce((x2 - m2) * b2, 0) FROM two, twofit WHERE split = 'test') GROUP BY 1)""", "mean_abs mean max_abs share_of_total")
def contributions(spark, folder):
    """Least squares on two inputs, solved in closed form on the SQL side: importance of their attributions."""
    df = cut_lineage(splits.chronological_split(add_lags(D.panel(spark, folder), (96,))))
    model = learn.train_linear(df, ["temperature", "power_lag_96"], ridge=0.0)
    return explain.global_importance(model.contributions(df.where(F.col("split") == "test"), KEYS))


@query("linear_contributions")
def linear_contributions(spark, folder):
    df = cut_lineage(features(spark, folder))
    model = learn.train_linear(df, LINEAR_INPUTS)
    return explain.global_importance(model.contributions(df.where(F.col("split") == "test"), KEYS))


@query("linear_regression", "panel timed", """
    SELECT 'temperature' AS feature, regr_slope(p.power, coalesce(p.temperature, m.t)) AS coefficient,
           regr_intercept(p.power, coalesce(p.temperature, m.t)) AS intercept
    FROM panel p JOIN timed t USING (site_id, timestamp),
         (SELECT avg(p.temperature) AS t FROM panel p JOIN timed t USING (site_id, timestamp) WHERE t.split = 'train' AND p.power IS NOT NULL) m
    WHERE t.split = 'train' AND p.power IS NOT NULL GROUP BY 1""", "coefficient intercept")
def linear_regression(spark, folder):
    model = learn.train_linear(splits.chronological_split(D.panel(spark, folder)), ["temperature"], ridge=0.0)
    names = list(zip(model.names, model.coefficients))
    return spark.createDataFrame([(n, c, model.intercept) for n, c in names], "feature string, coefficient double, intercept double")


WINDOW_CHANNELS = sequences.CHANNELS
WINDOW_COLUMNS = [f"ch_{c}" for c in WINDOW_CHANNELS]


def window_rows(spark, folder):
    """Channels in training units with split and target, and the target's own mean and deviation on training rows."""
    df = cut_lineage(splits.chronological_split(channel_rows(spark, folder)))  # for the scaler, the fit and the scores
    train = evaluate.train_rows(df)
    ready = sequences.standardized(df, sequences.channel_scaler(train, WINDOW_CHANNELS), WINDOW_CHANNELS,
                                   keep=("site_id", "split", "timestamp", "power", "is_daylight"))
    return ready, sequences.target_stats(train).first()


_WINDOW_ROWS = f"""
    SELECT split, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY site_id, split ORDER BY timestamp) AS pos FROM timed)
    WHERE pos > {sequences.LOOKBACK} AND power IS NOT NULL GROUP BY 1"""


@query("window_regression", "timed", f"SELECT split, n, CASE split WHEN 'train' THEN 'fitted' ELSE 'scored' END AS part FROM ({_WINDOW_ROWS})")
def window_regression(spark, folder):
    """How many windows the model was fitted on and how many it scored; :func:`window_metrics` has its errors."""
    model, scored, _ = windows_scored(spark, folder)
    tested = scored.where(F.col("prediction").isNotNull()).groupBy("split").agg(F.count("*").alias("n"), F.lit("scored").alias("part"))
    return spark.createDataFrame([("train", model.n, "fitted")], tested.schema).unionByName(tested)


def windows_scored(spark, folder):
    """A fit of the target in training units, with predictions of the other splits in the target's own."""
    ready, stats = window_rows(spark, folder)
    scaled = ready.withColumn("power", (F.col("power") - F.lit(stats["y_mean"])) / F.lit(stats["y_std"]))
    model = windows.fit_windows(evaluate.train_rows(scaled), WINDOW_COLUMNS, by=("split",))
    scored = model.predict(scaled.where(F.col("split") != "train"), by=("split",))
    back = [sequences.unstandardized(F.col(c), F.lit(stats["y_mean"]), F.lit(stats["y_std"])) for c in ("target", "prediction")]
    return model, scored.select("site_id", "split", "timestamp", back[0].alias("power"), back[1].alias("prediction")), stats


@query("window_metrics")
def window_metrics(spark, folder):
    return M.regression_metrics(windows_scored(spark, folder)[1], ["split"], daylight=None)


MOMENT_LAGS = (0, 1, 2, 4, 24, 96)


CTES["w"] = ("panel timed", f"SELECT *, row_number() OVER (PARTITION BY site_id, split ORDER BY timestamp) AS pos FROM {TRAIN_CHANNELS}")


@query("lagged_moments", "w", " UNION ALL ".join(f"""
    SELECT lag::BIGINT AS lag, '{a}' AS channel, '{b}' AS earlier, sum(now.ch_{a} * before.ch_{b}) AS moment FROM w now JOIN (VALUES {", ".join(f"({i})" for i in MOMENT_LAGS)}) l(lag) ON true
    JOIN w before ON before.site_id = now.site_id AND before.split = now.split AND before.pos = now.pos - lag GROUP BY 1"""
    for a in ("power", "power_observed", "temperature", "sin_hour") for b in ("power", "humidity", "sin_hour")), "moment")
def lagged_moments(spark, folder):
    """Sums that a window model is solved from, of some channels and lags."""
    rows = sequences.channel_matrix(splits.chronological_split(channel_rows(spark, folder)), WINDOW_CHANNELS, keep=("site_id", "split", "timestamp", "power"))
    out = windows.lagged_moments(rows, WINDOW_COLUMNS, by=("split",)).withColumns({c: F.regexp_replace(c, "^ch_", "") for c in ("channel", "earlier")})
    wanted = F.col("channel").isin("power", "power_observed", "temperature", "sin_hour") & F.col("earlier").isin("power", "humidity", "sin_hour")
    return out.where(wanted & F.col("lag").isin(*MOMENT_LAGS))


# ---------------------------------------------------------------- attributions with known coefficients

KNOWN = {"temperature": 0.31, "humidity": -0.17, "wind_speed": 0.53, "solar_elevation_deg": 0.071, "wind_direction": -0.013}


def known_model(df):
    """Given coefficients around the means of all rows, so the SQL twin can state the same attributions."""
    row = df.agg(*[F.avg(c).alias(c) for c in KNOWN]).first()
    return learn.LinearForecaster(list(KNOWN), list(KNOWN.values()), [float(row[c]) for c in KNOWN], 1.0)


CTES["contrib"] = ("panel", " UNION ALL ".join(
    f"SELECT site_id, timestamp, '{c}' AS feature, {c} AS value, CASE WHEN {c} IS NULL THEN 0 ELSE ({c} - (SELECT avg({c}) FROM panel)) * {w}::DOUBLE END AS contribution FROM panel"
    for c, w in KNOWN.items()))
CTES["importance"] = ("contrib", """
    SELECT *, row_number() OVER (ORDER BY mean_abs DESC) AS rank, mean_abs / sum(mean_abs) OVER () AS share_of_total FROM (
        SELECT feature, avg(abs(contribution)) AS mean_abs, avg(contribution) AS mean, max(abs(contribution)) AS max_abs FROM contrib GROUP BY 1)""")
CTES["contribtable"] = ("contrib", """
    WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, timestamp ORDER BY round(abs(contribution), 9) DESC, feature) AS rank FROM contrib)
    SELECT site_id, timestamp, rank, feature, value, contribution, CASE WHEN contribution > 0 THEN '+' ELSE '-' END AS direction FROM ranked WHERE rank <= 3
    UNION ALL SELECT site_id, timestamp, 4, '<remaining ' || count(*) || ' features>', NULL, sum(contribution), CASE WHEN sum(contribution) > 0 THEN '+' ELSE '-' END
    FROM ranked WHERE rank > 3 GROUP BY 1, 2""")
def known_contributions(spark, folder):
    df = D.panel(spark, folder)
    return known_model(df).contributions(df, KEYS)


@query("global_importance", "importance", "SELECT * FROM importance", "mean_abs mean max_abs share_of_total")
def global_importance(spark, folder):
    return explain.global_importance(known_contributions(spark, folder))


@query("share_and_rank", "", """
    SELECT event_type, total, row_number() OVER (ORDER BY total DESC) AS rank, total / sum(total) OVER () AS share_of_total
    FROM (SELECT event_type, sum(value) AS total FROM events GROUP BY 1)""", "total share_of_total")
def share_and_rank(spark, folder):
    totals = D.table(spark, folder, "events").groupBy("event_type").agg(F.sum("value").alias("total"))
    return explain.share_and_rank(totals, "total", "event_type")


@query("importance_topn", "importance", "SELECT rank, feature, mean_abs FROM importance WHERE rank <= 3", "mean_abs")
def importance_topn(spark, folder):
    return explain.top_importance(explain.global_importance(known_contributions(spark, folder)), 3).select("rank", "feature", "mean_abs")


@query("top2_share", "importance", "SELECT sum(share_of_total) AS top2_share FROM importance WHERE rank <= 2", "top2_share")
def top2_share(spark, folder):
    return explain.top2_share(explain.global_importance(known_contributions(spark, folder)))


@query("topk_with_remainder", "contribtable", "SELECT * FROM contribtable", "value contribution")
def topk_with_remainder(spark, folder):
    return explain.contribution_table(known_contributions(spark, folder), KEYS, 3)


@query("top_pos_neg", "contribtable", """
    SELECT site_id, timestamp, direction, place, feature, contribution FROM (
        SELECT *, row_number() OVER (PARTITION BY site_id, timestamp, direction ORDER BY round(abs(contribution), 9) DESC, feature) AS place
        FROM contribtable WHERE feature NOT LIKE '<remaining%' AND contribution <> 0) WHERE place <= 3""", "contribution")
def top_pos_neg(spark, folder):
    return explain.strongest(explain.contribution_table(known_contributions(spark, folder), KEYS, 3), KEYS)


CTES["picks"] = ("panel", f"""
    SELECT scenario, site_id, timestamp, power FROM (
        SELECT s.*, row_number() OVER (PARTITION BY s.scenario ORDER BY round(abs(s.power - g.goal), 9), s.timestamp, s.site_id) AS rn FROM ({SCENARIOS}) s
        JOIN (SELECT scenario, CASE WHEN scenario = 'clear_noon_peak' THEN max(power) ELSE median(power) END AS goal FROM ({SCENARIOS}) GROUP BY 1) g USING (scenario))
    WHERE rn = 1""")


@query("pick_representative", "picks", "SELECT * FROM picks", "power")
def pick_representative(spark, folder):
    return explain.pick_representatives(D.panel(spark, folder))


@query("explain_scenarios", "picks contrib", """
    SELECT p.scenario, c.site_id, c.timestamp, c.feature, c.value, c.contribution FROM picks p JOIN contrib c USING (site_id, timestamp)""", "value contribution")
def explain_scenarios(spark, folder):
    df = D.panel(spark, folder)
    chosen = explain.pick_representatives(df).select("scenario", *KEYS)
    # at most one row per scenario is explained
    return known_model(df).contributions(df.join(chosen, KEYS), ["scenario", *KEYS]).drop("base_value")


# ---------------------------------------------------------------- forecasts

@query("forecast_recursive", "gen", """
    SELECT site_id, step, last_ts + to_minutes(step * 15) AS timestamp, pow(0.5::DOUBLE, step) * (c0 + sum(pow(2.0::DOUBLE, step - 1) * h) OVER (PARTITION BY site_id ORDER BY step)) AS prediction
    FROM (SELECT l.site_id, s.step, l.t AS last_ts, coalesce(last.power, 0) AS c0, coalesce(h.power, 0) AS h
          FROM (SELECT site_id, max(timestamp) AS t FROM gen GROUP BY 1) l CROSS JOIN (SELECT unnest(generate_series(1, 96)) AS step) s
          LEFT JOIN gen last ON last.site_id = l.site_id AND last.timestamp = l.t
          LEFT JOIN gen h ON h.site_id = l.site_id AND h.timestamp = l.t + to_minutes(s.step * 15) - INTERVAL 24 HOUR)""", "prediction")
def forecast_recursive(spark, folder):
    """A predictor with a closed form shows that predictions are fed back exactly."""
    def predict(get):
        zero = F.lit(0.0)
        return F.coalesce(get("power_lag_1"), zero) * 0.5 + F.coalesce(get("power_lag_96"), zero) * 0.5

    return forecast.forecast_recursive(D.panel(spark, folder), predict, forecast.MAX_HORIZON).select("site_id", "step", "timestamp", "prediction")


def batch(spark, folder):
    """Boosted trees, all sites at once, with real sun positions and bounds calibrated on the trees' own val residuals."""
    coords = cut_lineage(campus_coordinates(D.site_details(spark, folder)))
    panel = cut_lineage(D.panel(spark, folder).drop("solar_elevation_deg", "is_daylight"))
    df = cut_lineage(splits.chronological_split(build.build_features(panel, coords, ZONE)))
    model = learn.train_gbt(df)
    scored = model.predict(df.where(F.col("split") == "val")).withColumn("regime", conformal.regime())
    radii = cut_lineage(conformal.fit(scored, []))
    return forecast.forecast_recursive(panel, model.prediction, forecast.MAX_HORIZON, coords=coords, zone=ZONE, radii=radii, per_site=model.sites.table)


CTES["slots"] = ("gen", """
    SELECT g.site_id, g.campus_id, s.step::BIGINT AS step, g.timestamp + to_minutes(s.step * 15) AS timestamp, g.power AS last_power
    FROM gen g JOIN (SELECT site_id, max(timestamp) AS t FROM gen GROUP BY 1) l ON l.site_id = g.site_id AND l.t = g.timestamp
    CROSS JOIN (SELECT unnest(generate_series(1, 96)) AS step) s""")


@query("forecast_batch", "slots sites", f"""
    SELECT site_id, step, timestamp, CASE WHEN solar_elevation_deg > 0 THEN 'day' ELSE 'night' END
           || CASE WHEN step = 1 AND last_power IS NULL THEN '_nolag' ELSE '_lag' END AS regime, 0.9::DOUBLE AS confidence_level, true AS symmetric
    FROM ({SUN_SQL.replace("FROM gen g", "FROM slots g")}) JOIN slots USING (site_id, timestamp)""", "confidence_level")
def forecast_batch(spark, folder):
    """Slots, regimes and form of the bounds; :func:`forecast_values` has the numbers."""
    above, below = F.col("upper_bound") - F.col("prediction"), F.col("prediction") - F.col("lower_bound")
    return batch(spark, folder).select("site_id", "step", "timestamp", "regime", "confidence_level", ((F.abs(above - below) < 1e-9) & (above >= 0)).alias("symmetric"))


@query("forecast_values")
def forecast_values(spark, folder):
    return batch(spark, folder)
