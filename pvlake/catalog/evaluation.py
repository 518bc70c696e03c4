"""Baselines, metrics, leaderboards, cross-site evaluation and conformal intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines, conformal, history, splits
from ..operators import metrics as M
from ..plans import evaluate
from ..sources import driver_tables as D
from .columns import REGIME_SQL, ROLE_SQL, site_text
from .registry import CTES, METRIC_DOUBLES, POOLED_RANGE, metric_sql, query


def timed_rows(spark, folder):
    return splits.chronological_split(D.generation_daylit(spark, folder))


def leaderboard(spark, folder):
    return evaluate.baseline_leaderboard(D.generation_daylit(spark, folder))


@query("mean_global", "allmean", "SELECT m AS mean_power FROM allmean", "mean_power")
def mean_global(spark, folder):
    return evaluate.train_rows(timed_rows(spark, folder)).agg(F.avg("power").alias("mean_power"))


@query("mean_site", "sitemean", "SELECT site_id, m AS site_mean FROM sitemean", "site_mean")
def mean_site(spark, folder):
    return baselines.site_means(evaluate.train_rows(timed_rows(spark, folder)))


@query("range_denominator", "ranges", """
    SELECT scope, coalesce(site_id::VARCHAR, '') AS site_id, denominator FROM ranges""", "denominator")
def range_denominator(spark, folder):
    return site_text(M.train_range(evaluate.train_rows(timed_rows(spark, folder))))


def _baseline(name):
    def run(spark, folder):
        return evaluate.baseline_predictions(D.generation_daylit(spark, folder)).where(F.col("model") == name).select(
            "site_id", "timestamp", "split", "prediction")
    return run


for _key, _name in (("baseline_zero", "zero"), ("baseline_mean_global", "mean_global"), ("baseline_mean_site", "mean_site"),
                    ("baseline_persistence", "persistence_24h")):
    query(_key, "scored", f"SELECT site_id, timestamp, split, prediction FROM scored WHERE model = '{_name}'", "prediction")(_baseline(_name))


@query("baseline_leaderboard", "board", "SELECT * REPLACE (coalesce(site_id::VARCHAR, '') AS site_id) FROM board", METRIC_DOUBLES)
def baseline_leaderboard(spark, folder):
    return site_text(leaderboard(spark, folder))


@query("metrics_all_and_site", "scored ranges", "SELECT * REPLACE (coalesce(site_id::VARCHAR, '') AS site_id) FROM (" + metric_sql(
    "(SELECT * FROM scored WHERE model = 'persistence_24h')", "split",
    "(SELECT r.denominator FROM ranges r WHERE r.scope = g.scope AND (g.scope = 'ALL' OR r.site_id = g.site_id))") + ")", METRIC_DOUBLES)
def metrics_all_and_site(spark, folder):
    timed = timed_rows(spark, folder)
    scored = baselines.predict_persistence(timed)
    return site_text(M.metrics_all_and_site(scored, ["split"], M.train_range(evaluate.train_rows(timed))))


@query("regression_metrics", "scored", "SELECT * EXCLUDE (scope, site_id) FROM (" + metric_sql(
    "(SELECT * FROM scored WHERE split = 'test')", "model", "10.0") + ") WHERE scope = 'ALL'", METRIC_DOUBLES)
def regression_metrics(spark, folder):
    scored = evaluate.baseline_predictions(D.generation_daylit(spark, folder)).where(F.col("split") == "test")
    return M.regression_metrics(scored, ["model"], 10.0)


@query("per_site_spread", "board", """
    SELECT model, split, count(*) AS n_sites, min(mae) AS min_mae, max(mae) AS max_mae, min(r2) AS min_r2, max(r2) AS max_r2,
           count(*) FILTER (WHERE r2 < 0) AS n_negative_r2 FROM board WHERE scope = 'SITE' GROUP BY 1, 2""", "min_mae max_mae min_r2 max_r2")
def per_site_spread(spark, folder):
    return M.per_site_spread(leaderboard(spark, folder), ["model", "split"])


@query("rank_models", "board", """
    SELECT split, model, mae, row_number() OVER (PARTITION BY split ORDER BY mae NULLS LAST, model) AS rank FROM board WHERE scope = 'ALL'""", "mae")
def rank_models(spark, folder):
    return M.rank_models(leaderboard(spark, folder)).select("split", "model", "mae", "rank")


@query("model_comparison", "board", """
    SELECT b.model, b.mae, b.rmse, b.r2, b.nrmse, row_number() OVER (ORDER BY b.r2 DESC NULLS LAST, b.model) AS rank, s.min_mae, s.max_mae
    FROM board b JOIN (SELECT model, min(mae) AS min_mae, max(mae) AS max_mae FROM board WHERE scope = 'SITE' AND split = 'test' GROUP BY 1) s USING (model)
    WHERE b.scope = 'ALL' AND b.split = 'test'""", "mae rmse r2 nrmse min_mae max_mae")
def model_comparison(spark, folder):
    board = leaderboard(spark, folder).where(F.col("split") == "test")
    spread = M.per_site_spread(board, ["model"]).select("model", "min_mae", "max_mae")
    return M.rank_models(board, "r2").select("model", "mae", "rmse", "r2", "nrmse", "rank").join(spread, "model")


@query("worst_sites_test", "board", """
    SELECT site_id, model, mae FROM board WHERE scope = 'SITE' AND split = 'test' AND model = 'persistence_24h'
    ORDER BY coalesce(mae, -1) DESC, site_id LIMIT 14""", "mae")
def worst_sites_test(spark, folder):
    board = leaderboard(spark, folder).where(F.col("model") == "persistence_24h")
    return M.worst_sites(board).select("site_id", "model", "mae")


@query("mae_delta", "board", """
    SELECT model, mae, mae - (SELECT mae FROM board WHERE model = 'persistence_24h' AND split = 'test' AND scope = 'ALL') AS mae_delta
    FROM board WHERE split = 'test' AND scope = 'ALL'""", "mae mae_delta")
def mae_delta(spark, folder):
    return M.mae_delta(leaderboard(spark, folder), "persistence_24h")


@query("model_metrics_lookup", "board", """
    SELECT model, n_eval, mae, rmse FROM board WHERE model = 'mean_site' AND split = 'test' AND scope = 'ALL'""", "mae rmse")
def model_metrics_lookup(spark, folder):
    return M.model_metrics(leaderboard(spark, folder), "mean_site").select("model", "n_eval", "mae", "rmse")


@query("argmax_argmin", "board", """
    SELECT split, min_by(model, mae) AS best_model, max_by(model, mae) AS worst_model FROM board
    WHERE scope = 'ALL' AND model <> 'persistence_24h' GROUP BY 1""")
def argmax_argmin(spark, folder):
    board = leaderboard(spark, folder).where((F.col("scope") == "ALL") & (F.col("model") != "persistence_24h"))
    return board.groupBy("split").agg(F.min_by("model", "mae").alias("best_model"), F.max_by("model", "mae").alias("worst_model"))


@query("test_window", "timed", "SELECT min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM timed WHERE split = 'test'")
def test_window(spark, folder):
    return timed_rows(spark, folder).where(F.col("split") == "test").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))


# ---------------------------------------------------------------- cross-site protocol

CTES["crossed"] = ("day", f"""
    SELECT d.* EXCLUDE (pos, n), CASE WHEN role = 'train' THEN 'seen' ELSE 'unseen' END AS protocol,
           CASE WHEN role <> 'train' THEN role WHEN pos <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
                WHEN pos <= round_even(n * (0.7::DOUBLE + (1 - 0.7::DOUBLE) / 2), 0) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS pos, count(*) OVER (PARTITION BY site_id) AS n FROM day) d
    JOIN ({ROLE_SQL}) USING (site_id)""")
CTES["crossranges"] = ("crossed", """
    SELECT 'ALL' AS scope, nullif(max(power) - min(power), 0) AS denominator FROM crossed WHERE split = 'train'""")
CTES["crossscored"] = ("crossed", """
    SELECT c.*, k.model, CASE k.model WHEN 'zero' THEN 0.0 WHEN 'mean_global' THEN (SELECT avg(power) FROM crossed WHERE split = 'train')
           WHEN 'mean_site' THEN coalesce(s.m, (SELECT avg(power) FROM crossed WHERE split = 'train')) ELSE h.power END AS prediction
    FROM crossed c LEFT JOIN (SELECT site_id, avg(power) AS m FROM crossed WHERE split = 'train' GROUP BY 1) s USING (site_id)
    LEFT JOIN gen h ON h.site_id = c.site_id AND h.timestamp = c.timestamp - INTERVAL 24 HOUR
    CROSS JOIN (VALUES ('zero'), ('mean_global'), ('mean_site'), ('persistence_24h')) k(model)""")
CTES["crossboard"] = ("crossscored crossranges gen", metric_sql(
    "(SELECT * FROM crossscored WHERE split IN ('val', 'test'))", "model, protocol, split", POOLED_RANGE.format(ranges="crossranges")))


def cross_board(spark, folder):
    return evaluate.cross_site_leaderboard(D.generation_daylit(spark, folder))


@query("cross_site_eval", "crossboard", "SELECT * REPLACE (coalesce(site_id::VARCHAR, '') AS site_id) FROM crossboard", METRIC_DOUBLES)
def cross_site_eval(spark, folder):
    return site_text(cross_board(spark, folder))


@query("gap_pct", "crossboard", """
    SELECT model, seen, unseen, 100.0 * (unseen - seen) / nullif(seen, 0) AS gap_pct FROM (
        SELECT model, max(mae) FILTER (WHERE protocol = 'seen') AS seen, max(mae) FILTER (WHERE protocol = 'unseen') AS unseen
        FROM crossboard WHERE scope = 'ALL' AND split = 'test' GROUP BY 1)""", "seen unseen gap_pct")
def gap_pct(spark, folder):
    return M.generalisation_gap(cross_board(spark, folder), ["model"])


@query("cross_site_rollup", "crossboard", """
    SELECT model, max(mae) FILTER (WHERE protocol = 'seen' AND split = 'val' AND scope = 'ALL') AS seen_val_mae,
           max(r2) FILTER (WHERE protocol = 'unseen' AND split = 'test' AND scope = 'ALL') AS unseen_test_r2,
           count(*) FILTER (WHERE protocol = 'unseen' AND split = 'test' AND scope = 'SITE') AS n_unseen_sites,
           sum(r2) FILTER (WHERE protocol = 'unseen' AND split = 'test' AND scope = 'SITE') AS sum_unseen_r2 FROM crossboard GROUP BY 1""",
       "seen_val_mae unseen_test_r2 sum_unseen_r2")
def cross_site_rollup(spark, folder):
    rolled = M.cross_site_rollup(cross_board(spark, folder))
    return rolled.select("model", "seen_val_mae", "unseen_test_r2", "n_unseen_sites", "sum_unseen_r2")


@query("unseen_sites", "crossboard", """
    SELECT model, site_id, mae, r2 FROM crossboard WHERE protocol = 'unseen' AND split = 'test' AND scope = 'SITE'""", "mae r2")
def unseen_sites(spark, folder):
    return M.unseen_sites(cross_board(spark, folder))


# ---------------------------------------------------------------- conformal intervals

CTES["regimes"] = ("day timed", f"""
    SELECT s.*, r.regime FROM timed s JOIN ({REGIME_SQL}) r USING (site_id, timestamp)""")
CTES["pred"] = ("regimes sitemean allmean p24", """
    SELECT r.*, 'persistence_24h' AS model, p.p24 AS prediction FROM regimes r JOIN p24 p USING (site_id, timestamp)
    UNION ALL SELECT r.*, 'mean_site', coalesce(s.m, (SELECT m FROM allmean)) FROM regimes r LEFT JOIN sitemean s USING (site_id)""")
CTES["scores"] = ("pred", """
    SELECT model, regime, abs(power - prediction) AS score FROM pred WHERE split = 'val' AND power IS NOT NULL AND prediction IS NOT NULL
    UNION ALL SELECT model, 'global', abs(power - prediction) FROM pred WHERE split = 'val' AND power IS NOT NULL AND prediction IS NOT NULL""")
CTES["radii"] = ("scores", """
    SELECT model, level, regime, radius, n FROM (
        SELECT model, regime, l.level, score AS radius, count(*) OVER (PARTITION BY model, regime, l.level) AS n,
               row_number() OVER (PARTITION BY model, regime, l.level ORDER BY score) AS rn, l.alpha
        FROM scores CROSS JOIN (VALUES ('0.9', 0.1::DOUBLE), ('0.8', 0.2::DOUBLE)) l(level, alpha))
    WHERE rn = least(n, ceil((n + 1) * (1 - alpha)))""")
CTES["intervals"] = ("pred radii", """
    SELECT p.*, m.method, l.level::DOUBLE AS confidence_level, l.level, p.prediction - coalesce(r.radius, g.radius) AS lower_bound,
           p.prediction + coalesce(r.radius, g.radius) AS upper_bound, coalesce(r.radius, g.radius) AS radius
    FROM pred p CROSS JOIN (VALUES ('global'), ('mondrian')) m(method) CROSS JOIN (VALUES ('0.9'), ('0.8')) l(level)
    LEFT JOIN radii g ON g.model = p.model AND g.level = l.level AND g.regime = 'global'
    LEFT JOIN radii r ON r.model = p.model AND r.level = l.level AND r.regime = p.regime AND m.method = 'mondrian' WHERE p.split = 'test'""")
CTES["tagged"] = ("intervals", """
    SELECT *, 'ALL' AS scope, '' AS label FROM intervals
    UNION ALL SELECT *, 'REGIME', regime FROM intervals WHERE method = 'mondrian' AND level = '0.9'
    UNION ALL SELECT *, 'SITE', 'site_' || site_id FROM intervals WHERE method = 'mondrian' AND level = '0.9'""")
CTES["coverage"] = ("tagged", """
    SELECT model, method, confidence_level, scope, label, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE NOT ok) AS n_missing,
           avg((power >= lower_bound AND power <= upper_bound)::INT) FILTER (WHERE ok) AS coverage, avg(abs(power - prediction)) FILTER (WHERE ok) AS mae,
           avg(upper_bound - lower_bound) FILTER (WHERE ok) AS mean_width, median(upper_bound - lower_bound) FILTER (WHERE ok) AS median_width,
           quantile_cont(upper_bound - lower_bound, 0.9) FILTER (WHERE ok) AS p90_width
    FROM (SELECT *, power IS NOT NULL AND prediction IS NOT NULL AND lower_bound IS NOT NULL AS ok FROM tagged) GROUP BY 1, 2, 3, 4, 5""")


def conformal_scored(spark, folder):
    scored = evaluate.regime_predictions(timed_rows(spark, folder))
    return scored.where(F.col("model").isin("persistence_24h", "mean_site"))


@query("conformal_quantile", "scores", """
    SELECT score AS radius, n FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n
        FROM scores WHERE model = 'persistence_24h' AND regime = 'global') WHERE rn = least(n, ceil((n + 1) * (1 - 0.1::DOUBLE)))""", "radius")
def conformal_quantile(spark, folder):
    from ..operators.quantiles import order_statistics

    scored = conformal.valid_pairs(conformal_scored(spark, folder).where((F.col("split") == "val") & (F.col("model") == "persistence_24h")))
    return order_statistics(scored.withColumn("s", F.abs(F.col("power") - F.col("prediction"))), [], "s", {"radius": conformal.conformal_rank(0.1)})


@query("conformal_fit", "radii", "SELECT * FROM radii", "radius")
def conformal_fit(spark, folder):
    return conformal.fit(conformal_scored(spark, folder).where(F.col("split") == "val"), ["model"])


def intervals(spark, folder):
    return evaluate.conformal_intervals(conformal_scored(spark, folder))


@query("interval_bounds", "intervals", """
    SELECT site_id, timestamp, model, method, confidence_level, regime, prediction, lower_bound, upper_bound FROM intervals""",
       "confidence_level prediction lower_bound upper_bound")
def interval_bounds(spark, folder):
    return intervals(spark, folder).select(
        "site_id", "timestamp", "model", "method", "confidence_level", "regime", "prediction", "lower_bound", "upper_bound")


@query("radius_lookup", "intervals", """
    SELECT site_id, timestamp, model, regime, radius FROM intervals WHERE method = 'mondrian' AND level = '0.8'""", "radius")
def radius_lookup(spark, folder):
    rows = intervals(spark, folder).where((F.col("method") == "mondrian") & (F.col("confidence_level") == 0.8))
    return rows.select("site_id", "timestamp", "model", "regime", "radius")


COVERAGE_DOUBLES = "coverage mae mean_width median_width p90_width"


@query("coverage_metrics", "coverage", "SELECT * FROM coverage", f"confidence_level {COVERAGE_DOUBLES}")
def coverage_metrics(spark, folder):
    return conformal.coverage_report(intervals(spark, folder))


@query("conformal_site_spread", "coverage", """
    SELECT model, count(*) AS n_sites, min(coverage) AS min_coverage, max(coverage) AS max_coverage, min(mean_width) AS min_width,
           max(mean_width) AS max_width, count(*) FILTER (WHERE coverage < confidence_level) AS n_below_nominal
    FROM coverage WHERE scope = 'SITE' GROUP BY 1""", "min_coverage max_coverage min_width max_width")
def conformal_site_spread(spark, folder):
    return conformal.site_spread(conformal.coverage_report(intervals(spark, folder)))


@query("head_per_group", "intervals", """
    SELECT regime, site_id, timestamp, prediction FROM (
        SELECT *, row_number() OVER (PARTITION BY regime ORDER BY timestamp, site_id) AS rn FROM intervals
        WHERE model = 'persistence_24h' AND method = 'mondrian' AND level = '0.9' AND prediction IS NOT NULL) WHERE rn <= 2""", "prediction")
def head_per_group(spark, folder):
    rows = intervals(spark, folder).where(
        (F.col("model") == "persistence_24h") & (F.col("method") == "mondrian") & (F.col("confidence_level") == 0.9)
        & F.col("prediction").isNotNull())
    return history.head_per_group(rows, ["regime"], ["timestamp", "site_id"]).select("regime", "site_id", "timestamp", "prediction")
