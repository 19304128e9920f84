"""Model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import calendars, model, signals
from tidemark.plans.registry import registry
from tidemark.plans.signals import FEATURES, RET
from tidemark.sources import bindings as b
from tidemark.sources.folders import written

QUERIES, SQL, query = registry()

USED = ["return_5", "return_20", "volatility_20", "ma_ratio_20"]
WEIGHTS = [0.8, -0.4, 1.5, 2.5]


def _r(df, *columns, digits=6):
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def _bars(spark, sf):
    """Monthly bars, written: a row an entity and month. Else every use of them reads and sorts all lines again."""
    return written(b.bars(spark, sf), "bars")


def _samples(spark, sf):
    """Features with a fold by year parity and a three-month label."""
    bars = _bars(spark, sf)
    rows = signals.features(bars).join(signals.forward_label(bars, 3), ["entity", "session"])
    return rows.withColumn("fold", F.year("session") % 2)


SAMPLES = "samples AS (SELECT f.*, year(session) % 2 AS fold, y FROM features f JOIN (SELECT entity, session, (lead(close, 3) OVER (PARTITION BY entity ORDER BY session) / close - 1 > 0)::INT AS y FROM bars) l USING (entity, session) WHERE n = 61 AND y IS NOT NULL)"
SCALE = "scale AS (SELECT fold, " + ", ".join(f"avg({c}) AS {c}_mean, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS {c}_std" for c in USED) + " FROM samples GROUP BY fold)"


@query("m01_train_scaler", b.BARS, RET, FEATURES, SAMPLES, SCALE, sql_text="SELECT fold, " + ", ".join(f"round({c}_mean, 6) AS {c}_mean, round({c}_std, 6) AS {c}_std" for c in USED) + " FROM scale")
def m01(spark, sf):
    return _r(model.scaler(_samples(spark, sf), USED), *[f"{c}_{x}" for c in USED for x in ("mean", "std")])


#: The optimum by descent at full length: scaled features keep the curvature between PENALTY and 1.1, so each of these
#: steps of length 1 takes a tenth off the distance at least.
PENALTY, UNTIL = 0.1, 300
W = [f"w{i + 1}" for i in range(len(USED))]
GIVEN = "1 / (1 + exp(-(f.w0 + " + " + ".join(f"f.{w} * z.{c}" for w, c in zip(W, USED)) + ")))"
OPTIMUM = f"""scaled AS MATERIALIZED (
  SELECT fold, y, {', '.join(f"({c} - {c}_mean) / {c}_std AS {c}" for c in USED)} FROM samples JOIN scale USING (fold)),
optimum(fold, step, w0, {', '.join(W)}) AS (
  SELECT DISTINCT fold, 0, 0::DOUBLE, {', '.join('0::DOUBLE' for _ in USED)} FROM scaled
  UNION ALL
  SELECT f.fold, f.step + 1, any_value(f.w0) - avg({GIVEN} - z.y),
    {', '.join(f"any_value(f.{w}) - avg(({GIVEN} - z.y) * z.{c}) - {PENALTY} * any_value(f.{w})" for w, c in zip(W, USED))}
  FROM optimum f JOIN scaled z ON z.fold = f.fold WHERE f.step < {UNTIL} GROUP BY f.fold, f.step)"""
FITTED = ", ".join(f"round({w}, 3) AS {w}" for w in W)


@query(
    "m02_logistic_fit", b.BARS, RET, FEATURES, SAMPLES, SCALE, OPTIMUM,
    sql_text=f"SELECT fold, round(w0, 3) AS intercept, {FITTED} FROM optimum WHERE step = {UNTIL}",
)
def m02(spark, sf):
    """The optimum that ``m02_descent`` goes towards, fold by fold, each by a distributed solver."""
    rows = _samples(spark, sf)
    z = written(model.scaled(rows, model.scaler(rows, USED), USED).select("fold", "y", *USED), "scaled")
    folds = [r["fold"] for r in z.select("fold").distinct().orderBy("fold").collect()]  # a row a fold
    fits = [model.fit_logistic(z.where(F.col("fold") == fold), USED, PENALTY) for fold in folds]
    fits = [(fold, intercept, *weights) for fold, (intercept, weights) in zip(folds, fits)]
    out = spark.createDataFrame(fits, f"fold int, intercept double, {', '.join(f'{w} double' for w in W)}")
    return _r(out, "intercept", *W, digits=3)


SCORE = " + ".join(f"{w} * (({c} - {c}_mean) / {c}_std)" for c, w in zip(USED, WEIGHTS))


@query("m03_predict", b.BARS, RET, FEATURES, SAMPLES, SCALE, sql_text=f"SELECT entity, session, round(1 / (1 + exp(-greatest(-35, least(35, 0.1 + {SCORE})))), 6) AS p FROM samples JOIN scale USING (fold)")
def m03(spark, sf):
    rows = _samples(spark, sf)
    z = model.scaled(rows, model.scaler(rows, USED), USED)
    return _r(model.predict(z, USED, F.lit(0.1), F.array(*[F.lit(w) for w in WEIGHTS])).select("entity", "session", "p"), "p")


PENALTIES = "pen AS (SELECT session % 4 AS fold, penalty, least(greatest(p * (1 - penalty) + 0.5 * penalty, 0.01), 0.99) AS p, y FROM pred, (SELECT unnest([0.0, 0.1, 0.9]) AS penalty))"


@query("m04_penalty_selection", b.PRED, PENALTIES, sql_text="SELECT fold, arg_min(penalty, {'l': round(loss, 9), 'p': penalty})::DOUBLE AS penalty, round(min(loss), 6) AS log_loss FROM (SELECT fold, penalty, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS loss FROM pen GROUP BY fold, penalty) GROUP BY fold")
def m04(spark, sf):
    penalties = F.explode(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.9)))
    rows = b.predictions(spark, sf).select((F.col("session") % 4).alias("fold"), penalties.alias("penalty"), "p", "y")
    mixed = F.col("p") * (1 - F.col("penalty")) + 0.5 * F.col("penalty")
    return _r(model.best_penalty(rows.withColumn("p", F.least(F.greatest(mixed, F.lit(0.01)), F.lit(0.99)))), "log_loss")


@query("m05_out_of_sample", b.PRED, sql_text="SELECT doc_id % 20 % 4 AS fold, count(*) AS predictions, count(y) AS scored, count(*) - count(y) AS unscored, round(avg(y::DOUBLE), 6) AS reference_accuracy, round(avg(CASE WHEN y IS NOT NULL THEN 0.25 END), 6) AS reference_brier, round(avg(CASE WHEN y IS NOT NULL THEN ln(2) END), 6) AS reference_log_loss FROM documents LEFT JOIN (SELECT symbol, y FROM pred) ON symbol = doc_id GROUP BY 1")
def m05(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("symbol"), (F.col("doc_id") % 20).alias("session"))
    labels = b.predictions(spark, sf).select("symbol", "session", "y")
    return _r(model.out_of_sample(docs.withColumn("fold", F.col("session") % 4), labels), "reference_accuracy", "reference_brier", "reference_log_loss")


@query("v01_model_weights", b.PRED, sql_text="SELECT session, symbol AS entity, round(1.0::DOUBLE / count(*) OVER (PARTITION BY session), 8) AS weight FROM pred WHERE p >= 0.5")
def v01_model(spark, sf):
    return _r(model.signal_weights(b.predictions(spark, sf).withColumnRenamed("symbol", "entity")), "weight", digits=8)


#: The chain: folds over the sessions that have features, train-only scaling, descent for each penalty, choice by
#: validation loss, predictions of the chosen model, scores where the label is known.
PENALTIES_TRIED = [0.0, 0.1, 1.0]
STEPS = model.EPOCHS
LINEAR = " + ".join(f"f.w{i + 1} * z.{c}" for i, c in enumerate(USED))
CHAINED = f"""fo AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ord FROM (SELECT DISTINCT session FROM features WHERE n = 61)),
num AS (SELECT count(*) AS n FROM fo),
folds AS (SELECT (p - 17) // 3 AS fold, p, least(p + 2, n - 1) AS p_to FROM (SELECT n, unnest(generate_series(17, n - 1, 3)) AS p FROM num)),
labelled AS (SELECT f.entity, f.session, fo.ord, {', '.join('f.' + c for c in USED)}, y FROM features f JOIN fo USING (session) LEFT JOIN (SELECT entity, session, (lead(close, 3) OVER (PARTITION BY entity ORDER BY session) / close - 1 > 0)::INT AS y FROM bars) l USING (entity, session) WHERE f.n = 61),
roles AS (SELECT l.*, fold, CASE WHEN ord BETWEEN p - 17 AND p - 10 AND ord + 3 < p - 6 THEN 'train' WHEN ord BETWEEN p - 6 AND p - 4 AND ord + 3 < p THEN 'validate' WHEN ord BETWEEN p AND p_to THEN 'predict' END AS role FROM labelled l JOIN folds ON ord BETWEEN p - 17 AND p_to),
sc AS (SELECT fold, {', '.join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS {c}_s" for c in USED)} FROM roles WHERE role = 'train' AND y IS NOT NULL GROUP BY fold),
z AS (SELECT r.fold, r.role, r.entity, r.session, r.y, {', '.join(f"(r.{c} - {c}_m) / {c}_s AS {c}" for c in USED)} FROM roles r JOIN sc USING (fold) WHERE role IS NOT NULL),
zt AS (SELECT * FROM z WHERE role = 'train' AND y IS NOT NULL),
fit(fold, penalty, step, w0, {', '.join(f'w{i + 1}' for i in range(len(USED)))}) AS (
  SELECT DISTINCT fold, penalty, 0, 0::DOUBLE, {', '.join('0::DOUBLE' for _ in USED)} FROM zt, (SELECT unnest({PENALTIES_TRIED})::DOUBLE AS penalty)
  UNION ALL SELECT f.fold, f.penalty, f.step + 1, any_value(f.w0) - {model.RATE} * avg(1 / (1 + exp(-(f.w0 + {LINEAR}))) - z.y), {', '.join(f"any_value(f.w{i + 1}) - {model.RATE} * (avg((1 / (1 + exp(-(f.w0 + {LINEAR}))) - z.y) * z.{c}) + f.penalty * any_value(f.w{i + 1}))" for i, c in enumerate(USED))}
  FROM fit f JOIN zt z ON z.fold = f.fold WHERE f.step < {STEPS} GROUP BY f.fold, f.penalty, f.step),
done AS (SELECT * FROM fit WHERE step = {STEPS}),
val AS (SELECT f.fold, f.penalty, -avg(z.y * ln(p) + (1 - z.y) * ln(1 - p)) AS loss FROM (SELECT z.*, f.penalty AS pen, 1 / (1 + exp(-(f.w0 + {LINEAR}))) AS p FROM z JOIN done f ON f.fold = z.fold WHERE z.role = 'validate' AND z.y IS NOT NULL) z JOIN done f ON f.fold = z.fold AND f.penalty = z.pen GROUP BY f.fold, f.penalty),
chosen AS (SELECT fold, arg_min(penalty, {{'l': loss, 'p': penalty}}) AS penalty, min(loss) AS loss FROM val GROUP BY fold),
oos AS (SELECT z.fold, z.entity, z.session, z.y, 1 / (1 + exp(-(f.w0 + {LINEAR}))) AS p FROM z JOIN chosen c ON c.fold = z.fold JOIN done f ON f.fold = z.fold AND f.penalty = c.penalty WHERE z.role = 'predict')"""


def _roles(spark, sf):
    """Scaled samples of every fold with their role, and labels where they are known."""
    bars = _bars(spark, sf)
    rows = signals.features(bars).select("entity", "session", *USED).join(signals.forward_label(bars, 3).select("entity", "session", "y"), ["entity", "session"], "left")
    calendar = calendars.ordinals(rows).withColumn("ord", F.col("ord") - 1)
    samples = rows.join(calendar, "session").withColumn("label_ord", F.col("ord") + 3)
    samples = samples.crossJoin(F.broadcast(calendar.agg(F.count(F.lit(1)).alias("sessions"))))  # one row
    roles = signals.fold_samples(samples, F.col("sessions"), 8, 3, 3, 3, warmup=0)
    roles = roles.select("fold", "role", "entity", "session", "y", *USED)
    return model.scaled(roles, model.scaler(roles.where("role = 'train' AND y IS NOT NULL"), USED), USED)


def _fitted(z):
    return model.fit_descent(z.where("role = 'train' AND y IS NOT NULL"), USED, PENALTIES_TRIED, epochs=STEPS)


@query("m02_descent", b.BARS, RET, FEATURES, CHAINED, sql_text=f"SELECT fold, penalty, round(w0, 6) AS intercept, {', '.join(f'round(w{i + 1}, 6) AS w{i + 1}' for i in range(len(USED)))} FROM done")
def m02_descent(spark, sf):
    fits = _fitted(_roles(spark, sf))
    return _r(fits.select("fold", "penalty", "intercept", *[F.col("weights")[i].alias(f"w{i + 1}") for i in range(len(USED))]), "intercept", *[f"w{i + 1}" for i in range(len(USED))])


@query("m05_walk_forward", b.BARS, RET, FEATURES, CHAINED, sql_text="SELECT fold, penalty, round(loss, 6) AS log_loss, count(*) AS predictions, count(y) AS scored, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN y IS NOT NULL THEN pow(p - y, 2) END), 6) AS brier_score FROM oos JOIN chosen USING (fold) GROUP BY fold, penalty, loss")
def m05_chain(spark, sf):
    """Fit, choice and out-of-sample predictions of every fold, each from the step before."""
    z = written(_roles(spark, sf), "roles")  # else it is made for the fit, the choice and the predictions
    fits = _fitted(z)
    judged = model.predict(z.where("role = 'validate' AND y IS NOT NULL").join(fits, "fold"), USED, F.col("intercept"), F.col("weights"))
    chosen = model.best_penalty(judged.select("fold", "penalty", "p", "y"))
    best = fits.join(chosen, ["fold", "penalty"])
    p = model.predict(z.where("role = 'predict'").join(best, "fold"), USED, F.col("intercept"), F.col("weights"))
    out = p.groupBy("fold", "penalty", "log_loss").agg(F.count(F.lit(1)).alias("predictions"), F.count("y").alias("scored"), F.avg("p").alias("mean_p"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier_score"))
    return _r(out, "log_loss", "mean_p", "brier_score")
