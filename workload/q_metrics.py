"""Segmentation metric and training-log queries."""

from pyspark.sql import functions as F

from cobblestone.operators import curvature, evaluation, training_log
from cobblestone.session import scratch_path
from cobblestone.sources import training_log as log_source
from workload.fixtures import table, view
from workload.registry import query

DICE = "((2 * sum({y} * {p}) + 1e-6) / (sum({y}) + sum({p}) + 1e-6))"
SAFE = "least(greatest({p}, 1e-7), 1 - 1e-7)"
FOCAL = f"avg(pow(1 - ({{y}} * {{p}} + (1 - {{y}}) * (1 - {{p}})), 2) * -({{y}} * ln({SAFE}) + (1 - {{y}}) * ln(1 - {SAFE})))"
HUBER = "avg(CASE WHEN abs({y} - {p}) <= 1 THEN ({y} - {p}) * ({y} - {p}) / 2 ELSE abs({y} - {p}) - 0.5e0 END)"
YP = {"y": "y_true", "p": "y_pred"}


@query("A18_A19_A20_binary_report", uses=("fx_pred",), sql=f"""
SELECT run, round({DICE.format(**YP)}, 6) AS dice, round(1 - {DICE.format(**YP)}, 6) AS dice_loss, round({FOCAL.format(**YP)} + 0.5e0 * (1 - {DICE.format(**YP)}), 6) AS focal_dice_loss,
  round(coalesce(count(*) FILTER (y_pred > 0.5 AND y_true > 0) / CAST(nullif(count(*) FILTER (y_pred > 0.5), 0) AS DOUBLE), 0), 6) AS "precision",
  round(coalesce(count(*) FILTER (y_pred > 0.5 AND y_true > 0) / CAST(nullif(count(*) FILTER (y_true > 0), 0) AS DOUBLE), 0), 6) AS recall FROM fx_pred GROUP BY run""")
def binary_report(spark, sf):
    out = evaluation.binary_report(view(spark, sf, "fx_pred"), "y_true", "y_pred", "run")
    return out.select("run", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("A21_pr_auc", uses=("fx_pred",), sql="""
WITH b AS (SELECT run, greatest(CAST(ceil(y_pred * 199) AS BIGINT) - 1, 0) AS bucket, count(*) FILTER (y_true > 0) AS dtp, count(*) AS dp FROM fx_pred GROUP BY 1, 2),
c AS (SELECT *, sum(dtp) OVER w - dtp AS tp, sum(dp) OVER w - dp AS called, sum(dtp) OVER (PARTITION BY run) AS pos FROM b WINDOW w AS (PARTITION BY run ORDER BY bucket DESC))
SELECT run, round(sum(dtp / CAST(dp AS DOUBLE) * (dtp + (tp - dtp / CAST(dp AS DOUBLE) * called) * CASE WHEN called > 0 THEN ln((called + dp) / CAST(called AS DOUBLE)) ELSE 0 END)) / max(pos), 6) AS pr_auc FROM c GROUP BY run""")
def pr_auc(spark, sf):
    return evaluation.pr_auc(view(spark, sf, "fx_pred"), "y_true", "y_pred", "run").withColumn("pr_auc", F.round("pr_auc", 6))


REG = "(SELECT l_returnflag AS run, l_quantity / 10 AS y, l_extendedprice / 10000 AS p, l_tax * 10 AS q, abs(l_discount) * 10 AS s, CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END AS t FROM lineitem) z"


@query("A22_regression_report", sql=f"""
SELECT run, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round({HUBER.format(y='y', p='p')}, 6) AS huber FROM {REG} GROUP BY run""")
def regression_report(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run"), (F.col("l_quantity") / 10).alias("y"), (F.col("l_extendedprice") / 10000).alias("p"))
    out = evaluation.regression_report(df, "y", "p", "run")
    return out.select("run", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _fd(y, p):
    return f"({FOCAL.format(y=y, p=p)} + 0.5e0 * (1 - {DICE.format(y=y, p=p)}))"


@query("A22_total_loss", sql=f"SELECT run, round(10 * {_fd('t', 's')} + {HUBER.format(y='y', p='p')} + 10 * {_fd('t', 'q')}, 5) AS loss FROM {REG} GROUP BY run")
def total_loss(spark, sf):
    l = table(spark, sf, "lineitem")
    t = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)
    df = l.select(F.col("l_returnflag").alias("run"), t.alias("y_is_street"), (F.abs("l_discount") * 10).alias("p_is_street"), (F.col("l_quantity") / 10).alias("y_altitude"),
                  (F.col("l_extendedprice") / 10000).alias("p_altitude"), t.alias("y_is_residential"), (F.col("l_tax") * 10).alias("p_is_residential"))
    return evaluation.total_loss(df, "run").withColumn("loss", F.round("loss", 5))


@query("A15_score_histogram", uses=("fx_pred",), sql="""
WITH b AS (SELECT CAST(least(9, floor(y_pred / 0.1e0)) AS INT) AS bin, count(*) AS n FROM fx_pred GROUP BY 1)
SELECT round(bin * 0.1e0, 6) AS interval_start, round((bin + 1) * 0.1e0, 6) AS interval_end, round(n / sum(n) OVER (), 9) AS share FROM b""")
def score_histogram(spark, sf):
    h = curvature.normalised_histogram(view(spark, sf, "fx_pred"), "y_pred", 0.0, 1.0, 10)
    return h.select(F.round("interval_start", 6).alias("interval_start"), F.round("interval_end", 6).alias("interval_end"), F.round("share", 9).alias("share"))


# --- logs ----------------------------------------------------------------------------------------

EPOCHS = """marked AS (SELECT line_no, value, last_value(CASE WHEN regexp_matches(value, 'performing ([0-9]+)-th epoch') THEN CAST(regexp_extract(value, 'performing ([0-9]+)-th epoch', 1) AS INT) END IGNORE NULLS) OVER (ORDER BY line_no) AS epoch FROM fx_log)"""
METRICS = EPOCHS + """,
hits AS (SELECT line_no, epoch, unnest(regexp_extract_all(value, '(val_)?is_street[_\\w]*:\\s*([0-9.eE+-]+)', 0)) AS m FROM marked WHERE epoch IS NOT NULL AND contains(value, 'is_street')),
metrics AS (SELECT line_no, epoch, trim(split_part(m, ':', 1)) AS metric, CAST(trim(split_part(m, ':', 2)) AS DOUBLE) AS value FROM hits)"""


@query("W8_epoch_carry", uses=("fx_log",), sql=f"WITH {EPOCHS} SELECT line_no, epoch FROM marked")
def epoch_carry(spark, sf):
    return training_log.with_epoch(view(spark, sf, "fx_log"), block=1000).select("line_no", "epoch")


@query("L1_metric_extraction", uses=("fx_log",), sql=f"WITH {METRICS} SELECT line_no, epoch, metric, value FROM metrics")
def metric_extraction(spark, sf):
    return training_log.extract_metrics(view(spark, sf, "fx_log"), block=1000)


NAMES = ("val_is_street__dice_coef", "is_street_loss")


@query("L1_wide_metrics", uses=("fx_log",), sql=f"""WITH {METRICS} SELECT line_no, epoch, max(value) FILTER (metric = '{NAMES[0]}') AS {NAMES[0]}, max(value) FILTER (metric = '{NAMES[1]}') AS {NAMES[1]} FROM metrics GROUP BY 1, 2""")
def wide(spark, sf):
    return training_log.wide_metrics(training_log.extract_metrics(view(spark, sf, "fx_log")), NAMES)


@query("S13_log_text_source", uses=("fx_log",), sql=f"WITH {METRICS} SELECT epoch, metric, value FROM metrics")
def log_text_source(spark, sf):
    path = scratch_path(spark, "log")
    # the log as a folder of consecutive files; an epoch may start in one file and go on in the next
    view(spark, sf, "fx_log").repartitionByRange(8, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    lines = log_source.read_log(spark, path)
    return training_log.extract_metrics(lines, block=F.struct("file", "block")).select("epoch", "metric", "value")


@query("S14_metric_csv", uses=("fx_log",), sql=f"""WITH {METRICS} SELECT epoch, max(value) FILTER (metric = '{NAMES[0]}') AS {NAMES[0]}, max(value) FILTER (metric = '{NAMES[1]}') AS {NAMES[1]} FROM metrics GROUP BY line_no, epoch""")
def metric_csv(spark, sf):
    path = scratch_path(spark, "metrics-csv")
    table_wide = training_log.wide_metrics(training_log.extract_metrics(view(spark, sf, "fx_log")), NAMES).drop("line_no")
    log_source.write_metrics(table_wide, path)
    return log_source.read_metrics(spark, path, NAMES)


@query("L2_learning_curve", uses=("fx_fold",), sql="""
WITH c AS (SELECT epoch, max(value) FILTER (metric = 'm0') AS train, max(value) FILTER (metric = 'm1') AS validation FROM fx_fold WHERE metric IN ('m0', 'm1') GROUP BY epoch)
SELECT *, epoch = (SELECT epoch FROM c ORDER BY validation DESC, epoch LIMIT 1) AS is_best FROM c""")
def learning_curve(spark, sf):
    return training_log.learning_curve(view(spark, sf, "fx_fold"), "m0", "m1")


@query("W4_best_epoch", uses=("fx_fold",), sql="""
SELECT metric, epoch AS best_epoch, value AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, epoch) AS rn FROM fx_fold) q WHERE rn = 1""")
def best_epoch(spark, sf):
    return training_log.best_epoch(view(spark, sf, "fx_fold"))


SINCE = """r AS (SELECT *, max(value) OVER (PARTITION BY metric ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fx_fold),
b AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN epoch END) OVER (PARTITION BY metric ORDER BY epoch) AS best_epoch, max(value) OVER (PARTITION BY metric ORDER BY epoch) AS best_value FROM r)"""


@query("W5_epochs_since_best", uses=("fx_fold",), sql=f"WITH {SINCE} SELECT metric, epoch, best_epoch, best_value, CAST(epoch - best_epoch AS BIGINT) AS since_best FROM b")
def since_best(spark, sf):
    return training_log.since_best(view(spark, sf, "fx_fold")).select("metric", "epoch", "best_epoch", "best_value", "since_best")


@query("W5_early_stop", uses=("fx_fold",), sql=f"""WITH {SINCE} SELECT metric, min(epoch) FILTER (epoch - best_epoch >= 20) AS stop_epoch, arg_min(best_epoch, epoch) FILTER (epoch - best_epoch >= 20) AS best_epoch,
  arg_min(best_value, epoch) FILTER (epoch - best_epoch >= 20) AS best_value FROM b GROUP BY metric""")
def early_stop(spark, sf):
    return training_log.early_stop(view(spark, sf, "fx_fold"))


@query("W6_plateau_rates", uses=("fx_fold",), sql=f"""WITH {SINCE}, k AS (SELECT *, sum(CASE WHEN epoch > best_epoch AND (epoch - best_epoch) % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY metric ORDER BY epoch) AS cuts FROM b)
SELECT metric, epoch, CAST(cuts AS BIGINT) AS cuts, greatest(1e-3 * pow(0.5e0, cuts), 1e-6) AS rate FROM k""")
def plateau_rates(spark, sf):
    # values have two decimals, so beating the best by more than 1e-4 means beating it
    return training_log.plateau_rates(view(spark, sf, "fx_fold")).select("metric", "epoch", "cuts", "rate")


@query("W7_latest_checkpoint", sql="""
WITH f AS (SELECT event_type AS folder, concat(CAST(1700000000 + event_id * 7919 % 1000003 AS VARCHAR), '_epoch', CAST(event_id % 100 AS VARCHAR), '_model.keras') AS file FROM events)
SELECT folder, file FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY split_part(file, '_', 1) DESC, file DESC) AS rn FROM f) q WHERE rn = 1""")
def latest_checkpoint(spark, sf):
    e = table(spark, sf, "events")
    listing = e.select(F.col("event_type").alias("folder"), F.concat((1700000000 + F.col("event_id") * 7919 % 1000003).cast("string"), F.lit("_epoch"), (F.col("event_id") % 100).cast("string"), F.lit("_model.keras")).alias("file"))
    return training_log.latest_file(listing, "folder")
