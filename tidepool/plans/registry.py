"""Registered queries: one per operator, each over the whole driver tables.

Each entry takes (spark, sf_dir) and returns a DataFrame whose column names
match the oracle SQL in ``tidepool.plans.oracle``. Doubles are rounded to 6
decimals on both sides so that summation order cannot change the hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.columns import feature_columns
from tidepool.operators.clean import drop_columns, extreme_rows, inf_to_null, parse_dates
from tidepool.operators.evaluate import (align_predictions, attach_actuals, eval_metrics, model_comparison,
                                         residual_stats, wide_ensemble)
from tidepool.operators.profile import (column_info, count_distinct, describe, distinct_values, head, histogram, null_map,
                                        overview, top_k, value_counts)
from tidepool.operators.quantile import exact_quantiles
from tidepool.operators import learn
from tidepool.operators.scale import scaler_inverse, scaler_inverse_as, scaler_long
from tidepool.operators.score import PandasScorer, batch_score, linear_predict, linear_scores_wide
from tidepool.operators.split import split_report
from tidepool.operators.windows import window_feature
from tidepool.functions.position import add_position_encoding
from tidepool.operators.drift import check_drift, drift_columns, drift_prediction, drift_report, drift_status
from tidepool.operators.profile import seeded_sample
from tidepool.operators.runs import best_runs, run_records
from tidepool.operators.validate import flatten_named, last_step, split_valid, validate_sequences
from tidepool.operators.windows import last_n
from tidepool.plans import dataset as ds
from tidepool.plans import monitor as mon
from tidepool.plans import streams
from tidepool.plans import ensemble as ens
from tidepool.plans import fixtures as fx
from tidepool.session import materialize, scratch_path
from tidepool.sources.files import append, read_reference, read_requests, read_table, scan_csv, write_csv, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    """Register a query. The operators treat the driver's zone-less
    timestamps as UTC wall-clock time, so the query pins the session zone."""
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE / FLOAT column (top level) to ``digits``."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


# ---------------------------------------------------------------- ensemble (plan D)

@register("eval_metrics")
def q_eval_metrics(spark, sf):
    return rounded(eval_metrics(ens.scored(spark, sf)))


@register("model_comparison")
def q_model_comparison(spark, sf):
    m = eval_metrics(ens.scored(spark, sf).filter(F.col("split") == "test"), ["model"])
    return rounded(model_comparison(m, "mae"))


def row_model_expr(scorer, suffix: str):
    """A row model applied to plain columns ``<feature><suffix>``."""
    total = F.lit(float(scorer.bias))
    for feat, w in scorer.weights.items():
        total = total + F.lit(float(w)) * F.col(feat + suffix)
    return total


@register("temporal_split")
def q_temporal_split(spark, sf):
    return ens.split_panel(spark, sf).select("split", "ticker", "row_id", "date")


@register("split_report")
def q_split_report(spark, sf):
    return split_report(ens.split_panel(spark, sf), "date")


@register("lookback_windows")
def q_lookback_windows(spark, sf):
    w, _ = ens.panel_windows(spark, sf)
    i_px, i_qty = fx.PANEL_FEATURES.index("px"), fx.PANEL_FEATURES.index("qty")
    return rounded(w.select("split", "ticker", "row_id",
                            F.size("seq").alias("n_steps"),
                            window_feature("seq", i_px, "first", ens.LOOK_BACK).alias("px_first"),
                            window_feature("seq", i_px, "last", ens.LOOK_BACK).alias("px_last"),
                            window_feature("seq", i_qty, "sum", ens.LOOK_BACK).alias("qty_sum")))


@register("batch_score")
def q_batch_score(spark, sf):
    w, _ = ens.panel_windows(spark, sf)
    return rounded(batch_score(w, ens.MODELS, fx.PANEL_FEATURES, ens.LOOK_BACK, ["split", "row_id"]))


def python_scorer(m):
    """A stand-in model as a Python function of arrays, the way a user's own model comes."""
    weights = np.array([m.weights.get(c, 0.0) for c in fx.PANEL_FEATURES])
    return PandasScorer(m.name, lambda: linear_predict(weights, m.bias, m.source), "row" if m.source == "row" else "window")


@register("batch_score_python")
def q_batch_score_python(spark, sf):
    """The same models through Arrow batches, all of them in one pass."""
    w, _ = ens.panel_windows(spark, sf)
    return rounded(batch_score(w, [python_scorer(m) for m in ens.MODELS], fx.PANEL_FEATURES, ens.LOOK_BACK,
                               ["split", "row_id"]))


@register("ensemble_mean")
def q_ensemble_mean(spark, sf):
    """All scores of a window lie on one row, so the mean needs no shuffle."""
    w, _ = ens.panel_windows(spark, sf)
    wide = linear_scores_wide(w, ens.MODELS, fx.PANEL_FEATURES, ens.LOOK_BACK)
    names = [f"yhat__{m}" for m in ens.MODEL_NAMES]
    wide = wide_ensemble(wide, names, "yhat")
    n = sum((F.col(c).isNotNull().cast("long") for c in names), F.lit(0).cast("long"))
    return rounded(wide.select("split", "row_id", "yhat", n.alias("n_models")))


@register("align_predictions")
def q_align_predictions(spark, sf):
    labeled = fx.labeled_panel(spark, sf)
    z, stats = ens.scaled_panel(spark, sf, labeled)
    ann = ens.MODELS[0]
    row_preds = z.select("split", "row_id",
                         row_model_expr(ann, "__z").alias("yhat"))
    w, _ = ens.panel_windows(spark, sf, labeled, stats)
    return rounded(align_predictions(w.select("split", "row_id"), row_preds, ["split", "row_id"]))


@register("attach_actuals")
def q_attach_actuals(spark, sf):
    labeled = fx.labeled_panel(spark, sf)
    w, _ = ens.panel_windows(spark, sf, labeled)
    preds = batch_score(w, [ens.MODELS[1]], fx.PANEL_FEATURES, ens.LOOK_BACK, ["split", "row_id"])
    return rounded(attach_actuals(preds, labeled, "row_id", fx.TARGET))


@register("eval_metrics_scaled")
def q_eval_metrics_scaled(spark, sf):
    return rounded(eval_metrics(ens.scored(spark, sf), y="actual_z", yhat="yhat_z"))


@register("residual_stats")
def q_residual_stats(spark, sf):
    return rounded(residual_stats(ens.scored(spark, sf)))


@register("scaler_fit")
def q_scaler_fit(spark, sf):
    s = ens.split_panel(spark, sf)
    return rounded(scaler_long(ens.fitted_scaler(s), fx.PANEL_FEATURES + [fx.TARGET]))


@register("scaler_transform")
def q_scaler_transform(spark, sf):
    z, _ = ens.scaled_panel(spark, sf)
    return rounded(z.select("split", "row_id", *ens.SCALED))


@register("scaler_inverse")
def q_scaler_inverse(spark, sf):
    z, stats = ens.scaled_panel(spark, sf)
    back = scaler_inverse(z.select("split", "row_id", *[F.col(f"{c}__z").alias(c) for c in fx.PANEL_FEATURES]),
                          stats, fx.PANEL_FEATURES)
    return rounded(back)


@register("feature_columns")
def q_feature_columns(spark, sf):
    """Features by exclusion, each with the number of values that the panel has for it."""
    panel = fx.add_label(fx.daily_panel(spark, sf, with_label=False))
    feats = feature_columns(panel.columns, targets=[fx.TARGET], exclude=("row_id",))
    n = panel.agg(*[F.count(c).alias(c) for c in feats])
    return (n.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in feats]))
                     .alias("position", "x"))
             .select(F.col("position").cast("int").alias("position"), "x.column", F.col("x.n").alias("n_values")))


# ---------------------------------------------------------------- dataset build (plan A)

@register("left_join_macro")
def q_left_join_macro(spark, sf):
    return rounded(ds.joined(spark, sf).select("ticker", "date", "row_id", "macro_px", "macro_n"))


@register("drop_columns")
def q_drop_columns(spark, sf):
    return rounded(drop_columns(ds.joined(spark, sf), ds.DROP))


@register("inf_to_null")
def q_inf_to_null(spark, sf):
    return rounded(inf_to_null(ds.raw(spark, sf)).select("row_id", "px", "qty"))


@register("parse_dates")
def q_parse_dates(spark, sf):
    p = fx.daily_panel(spark, sf, with_label=False)
    iso = p.select("row_id", F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z")).alias("date_text"))
    out = parse_dates(iso, "date_text", strict=True, out="ts")
    return out.select("row_id", F.unix_seconds("ts").alias("epoch_s"))


@register("ffill_dropna")
def q_ffill_dropna(spark, sf):
    return rounded(ds.filled(spark, sf))


@register("extreme_rows")
def q_extreme_rows(spark, sf):
    return rounded(extreme_rows(ds.filled_table(spark, sf), fx.TARGET).select("ticker", "date", "row_id", fx.TARGET, "extreme"))


@register("quantiles")
def q_quantiles(spark, sf):
    return rounded(exact_quantiles(ds.filled_table(spark, sf), fx.TARGET, [0.01, 0.99]))


@register("quantile_trim")
def q_quantile_trim(spark, sf):
    return rounded(ds.final(spark, sf))


@register("overview")
def q_overview(spark, sf):
    return overview(ds.joined(spark, sf), "date")


@register("column_info")
def q_column_info(spark, sf):
    return column_info(ds.cleaned(spark, sf))


@register("null_map")
def q_null_map(spark, sf):
    return null_map(ds.cleaned(spark, sf), "date")


@register("distinct_entities")
def q_distinct_entities(spark, sf):
    return distinct_values(ds.final(spark, sf), "ticker")


@register("count_distinct")
def q_count_distinct(spark, sf):
    return count_distinct(ds.final(spark, sf), "ticker")


@register("residual_histogram")
def q_residual_histogram(spark, sf):
    """50 equal-width bins of the ensemble's residuals on the test split."""
    s = ens.scored(spark, sf).filter("split = 'test' and model = 'ensemble'")
    return rounded(histogram(s.select((F.col("actual") - F.col("yhat")).alias("residual")), "residual", 50))


@register("drop_columns_strict")
def q_drop_columns_strict(spark, sf):
    """Names that must exist (a missing one raises)."""
    return rounded(drop_columns(ds.joined(spark, sf), ["tax", "macro_n"], strict=True))


@register("describe_target")
def q_describe_target(spark, sf):
    return rounded(describe(ds.final(spark, sf), fx.TARGET))


@register("value_counts")
def q_value_counts(spark, sf):
    return value_counts(ds.final(spark, sf), "ticker", 10)


@register("histogram")
def q_histogram(spark, sf):
    return rounded(histogram(ds.final(spark, sf), fx.TARGET, 50))


@register("top_k")
def q_top_k(spark, sf):
    f = ds.filled_table(spark, sf)
    cols = ["ticker", "date", "row_id", fx.TARGET]
    lo = top_k(f, fx.TARGET, 3, largest=False).select(F.lit("smallest").alias("kind"), *cols)
    hi = top_k(f, fx.TARGET, 3, largest=True).select(F.lit("largest").alias("kind"), *cols)
    hd = head(f, 3).select(F.lit("head").alias("kind"), *cols)
    return rounded(lo.unionByName(hi).unionByName(hd))


@register("write_read_back")
def q_write_read_back(spark, sf):
    path = scratch_path(spark, "final")
    write_table(ds.final(spark, sf), path)
    return rounded(read_table(spark, path))


@register("scan_panel")
def q_scan_panel(spark, sf):
    path = scratch_path(spark, "panel-csv")
    p = fx.daily_panel(spark, sf, with_label=False)
    write_csv(p, path)
    return rounded(scan_csv(spark, path, p.schema))


# ---------------------------------------------------------------- serving and monitoring (plan C)

DRIFT_NUMERIC = ["value", "k", "user_id", "hour"]
DRIFT_CATEGORICAL = ["event_type"]
# fixed values: test per numeric column in the registered drift queries
DRIFT_METHOD = {"value": "ks", "k": "wasserstein", "user_id": "ks", "hour": "wasserstein"}


def drift_frame(df: DataFrame) -> DataFrame:
    return df.select("event_id", "ts", "value", "k", F.col("user_id").cast("double").alias("user_id"),
                     F.hour("ts").cast("double").alias("hour"), "event_type")


@register("validate_sequences")
def q_validate_sequences(spark, sf):
    return mon.validated(spark, sf).select("event_id", "error_code")


@register("last_step")
def q_last_step(spark, sf):
    good, _ = split_valid(mon.validated(spark, sf))
    ls = last_step(F.col("sequence"))
    return rounded(good.select("event_id", ls[0].alias("step_value"), ls[1].alias("step_k")))


@register("flatten_named")
def q_flatten_named(spark, sf):
    good, _ = split_valid(mon.validated(spark, sf))
    return rounded(flatten_named(good, "sequence", mon.EV_FEATURES, keep=["event_id"]))


@register("position_encoding")
def q_position_encoding(spark, sf):
    good, _ = split_valid(mon.validated(spark, sf))
    enc = add_position_encoding(F.col("sequence"), len(mon.EV_FEATURES))
    return rounded(good.select("event_id", enc.alias("enc"))
                       .select("event_id",
                               F.aggregate("enc", F.lit(0.0), lambda a, r: a + r[0]).alias("value_pe_sum"),
                               F.aggregate("enc", F.lit(0.0), lambda a, r: a + r[1]).alias("k_pe_sum")))


@register("score_requests")
def q_score_requests(spark, sf):
    return rounded(mon.score_requests(spark, sf).drop("seq_z", "user_id", "ts"))


@register("request_metrics")
def q_request_metrics(spark, sf):
    batch = mon.validated_table(spark, sf)
    _, bad = split_valid(batch)
    return rounded(mon.request_metrics(mon.prediction_log(spark, sf, batch), bad))


@register("prediction_log")
def q_prediction_log(spark, sf):
    path = scratch_path(spark, "prediction-log")
    append(mon.request_log(spark, sf), path)
    return read_table(spark, path).select("id", F.round("prediction", 6).alias("prediction"),
                                          F.size("features").alias("n_features"))


@register("last_n")
def q_last_n(spark, sf):
    return rounded(last_n(mon.events(spark, sf), mon.WINDOW_SIZE, ["ts", "event_id"])
                   .select("event_id", "user_id", "value"))


@register("seeded_sample")
def q_seeded_sample(spark, sf):
    return seeded_sample(mon.reference_period(spark, sf), mon.WINDOW_SIZE, 42, "event_id").select("event_id")


@register("drift_columns")
def q_drift_columns(spark, sf):
    ref = drift_frame(mon.reference_period(spark, sf))
    cur = drift_frame(mon.current_period(spark, sf))
    return rounded(drift_columns(ref, cur, DRIFT_NUMERIC, DRIFT_CATEGORICAL, DRIFT_METHOD))


def _shifted(cur: DataFrame) -> DataFrame:
    return cur.withColumn("value", F.col("value") * 1.5).filter(F.col("event_type") != "view")


@register("drift_dataset")
def q_drift_dataset(spark, sf):
    ref = drift_frame(mon.reference_period(spark, sf))
    cur = drift_frame(mon.current_period(spark, sf))
    preds = mon.prediction_log(spark, sf).filter(F.col("model") == "ensemble")
    base = check_drift(ref, cur, DRIFT_NUMERIC, DRIFT_CATEGORICAL, DRIFT_METHOD, preds=preds)
    shifted = check_drift(ref, _shifted(cur), DRIFT_NUMERIC, DRIFT_CATEGORICAL, DRIFT_METHOD, preds=preds)
    return rounded(base.withColumn("scenario", F.lit("baseline"))
                   .unionByName(shifted.withColumn("scenario", F.lit("shifted"))))


@register("drift_schema_guard")
def q_drift_schema_guard(spark, sf):
    """The guard over the columns that both sides have: three tested columns
    among five common ones pass it, four common ones do not, nor do nine rows."""
    ref = drift_frame(mon.reference_period(spark, sf))
    cur = drift_frame(mon.current_period(spark, sf))
    tested = ["event_id", "ts", "value", "k", "event_type"]
    few = last_n(cur, 9, ["ts", "event_id"])
    out = None
    for scenario, frame in (("five common", cur.select(*tested)), ("four common", cur.select(*tested[1:])), ("nine rows", few)):
        got = check_drift(ref, frame, DRIFT_NUMERIC, DRIFT_CATEGORICAL, DRIFT_METHOD).withColumn("scenario", F.lit(scenario))
        out = got if out is None else out.unionByName(got)
    return rounded(out)


@register("drift_reference_file")
def q_drift_reference_file(spark, sf):
    """The reference from a CSV file, and the verdict when the file is missing."""
    path = scratch_path(spark, "reference-csv")
    ref = drift_frame(mon.reference_period(spark, sf))
    write_csv(ref, path)
    cur = drift_frame(mon.current_period(spark, sf))
    cols = ["status", "n_columns", "n_drifted", "drift_share", "dataset_drift", "severity"]
    out = None
    for scenario, p in (("file", path), ("missing", path + "-missing")):
        got = check_drift(read_reference(spark, p, "csv", ref.schema), cur, DRIFT_NUMERIC, DRIFT_CATEGORICAL, DRIFT_METHOD)
        got = got.select(F.lit(scenario).alias("scenario"), *cols)
        out = got if out is None else out.unionByName(got)
    return rounded(out)


@register("requests_json")
def q_requests_json(spark, sf):
    """Requests read from JSON lines, then validated."""
    path = scratch_path(spark, "requests-json")
    r = mon.requests(spark, sf)
    r.select(F.col("event_id").cast("string").alias("request_id"), "ts", "sequence").write.json(path)
    got = validate_sequences(read_requests(spark, path), "sequence", mon.LOOK_BACK, len(mon.EV_FEATURES))
    return got.select("request_id", "error_code")


@register("drift_prediction")
def q_drift_prediction(spark, sf):
    log = mon.prediction_log(spark, sf).filter(F.col("model") == "ensemble")
    return rounded(drift_prediction(log, "prediction", ["ts", "id"]))


def _monitor_inputs(spark, sf):
    ref = drift_frame(mon.reference_period(spark, sf))
    cur = drift_frame(last_n(mon.current_period(spark, sf), mon.WINDOW_SIZE, ["ts", "event_id"]))
    preds = last_n(mon.prediction_log(spark, sf).filter(F.col("model") == "ensemble"), mon.WINDOW_SIZE,
                   ["ts", "id"])
    return ref, cur, preds


@register("drift_status")
def q_drift_status(spark, sf):
    """Status after one check, whose record goes to the check log first."""
    ref, cur, preds = _monitor_inputs(spark, sf)
    path = scratch_path(spark, "check-log")
    verdict = check_drift(ref, cur, DRIFT_NUMERIC, DRIFT_CATEGORICAL, DRIFT_METHOD, preds=preds)
    append(verdict.crossJoin(cur.agg(F.max("ts").alias("check_ts"))), path)
    st = drift_status(ref, cur, preds, mon.WINDOW_SIZE, checks=read_table(spark, path))
    return st.withColumn("last_drift_check", F.unix_seconds("last_drift_check"))


@register("drift_report")
def q_drift_report(spark, sf):
    ref, cur, preds = _monitor_inputs(spark, sf)
    st = drift_status(ref, cur, preds, mon.WINDOW_SIZE).drop("last_drift_check")
    verdict = check_drift(ref, cur, DRIFT_NUMERIC, DRIFT_CATEGORICAL, DRIFT_METHOD, preds=preds)
    return rounded(drift_report(st, verdict))


@register("run_log")
def q_run_log(spark, sf):
    m = eval_metrics(ens.scored(spark, sf))
    runs = run_records(m, params={"look_back": str(ens.LOOK_BACK), "target": fx.TARGET,
                                  "split_train": fx.SPLIT_TRAIN, "split_val": fx.SPLIT_VAL})
    path = scratch_path(spark, "run-log")
    append(runs, path)
    return rounded(best_runs(read_table(spark, path), "test_mae").withColumn("rank", F.col("rank").cast("int")))


# ---------------------------------------------------------------- streaming (T1-T5)

@register("stream_ingest")
def q_stream_ingest(spark, sf):
    return streams.stream_ingest(spark, sf)


@register("stream_last_n")
def q_stream_last_n(spark, sf):
    return rounded(streams.stream_last_n(spark, sf).select("event_id", F.col("user_id").cast("long"), "value"))


@register("stream_last_n_by_model")
def q_stream_last_n_by_model(spark, sf):
    return rounded(streams.stream_last_n_by_model(spark, sf).select("model", "rank", "id", "prediction"))


@register("stream_drift_check")
def q_stream_drift_check(spark, sf):
    return rounded(streams.stream_drift_check(spark, sf).select(
        F.unix_seconds("check_ts").alias("check_ts"), "window_size", "n_columns", "n_drifted", "drift_share", "dataset_drift",
        "severity"))


@register("stream_metrics")
def q_stream_metrics(spark, sf):
    m = streams.stream_metrics(spark, sf)
    return rounded(m.select(F.unix_seconds("window_start").alias("window_start"), "model", "n_predictions",
                            "latency_sum", "prediction_sum"))


@register("stream_prediction_log")
def q_stream_prediction_log(spark, sf):
    return streams.stream_prediction_log(spark, sf).select("id", F.round("prediction", 6).alias("prediction"),
                                                           F.size("features").alias("n_features"))


@register("stream_request_metrics")
def q_stream_request_metrics(spark, sf):
    return rounded(streams.stream_request_metrics(spark, sf))


# ---------------------------------------------------------------- model fit (M2)

@register("fit_predict")
def q_fit_predict(spark, sf):
    """GBT with absolute loss on the scaled row features; metrics per split
    in original units (rows-only check: a different learner than the reference)."""
    z, stats = ens.scaled_panel(spark, sf)
    before_test = F.col("date") < F.lit(fx.SPLIT_VAL).cast("date")         # reaches the scan
    tv = z.filter(before_test & F.col("split").isin("train", "val")).withColumn("is_val", F.col("split") == "val")
    model = learn.fit(tv, ens.SCALED, f"{fx.TARGET}__z")
    pred = learn.predict(model, z.filter(F.col(f"{fx.TARGET}__z").isNotNull()))
    pred = scaler_inverse_as(pred, stats, fx.TARGET, {"yhat": "yhat_orig"})
    scored = pred.select("split", F.lit("gbt").alias("model"), F.col(fx.TARGET).alias("actual"),
                         F.col("yhat_orig").alias("yhat"))
    return rounded(eval_metrics(scored))


@register("fit_absolute")
def q_fit_absolute(spark, sf):
    """Line of least absolute error of the scaled label on the scaled price:
    every iteration with its errors, and which one is kept."""
    z, _ = ens.scaled_panel(spark, sf)
    rows = z.filter(F.col("split").isin("train", "val")).select(
        F.col("px__z").alias("x"), F.col(f"{fx.TARGET}__z").alias("y"), (F.col("split") == "val").alias("is_val"))
    model = learn.fit_absolute(materialize(rows, "fit-rows"), ["x"], "y", max_iter=12, patience=12, delta=0.01)
    out = [(t, *b, train, val, t == model.best) for t, b, train, val in model.history]
    return rounded(spark.createDataFrame(out, "iteration int, intercept double, slope double, train_mae double, val_mae double, kept boolean"))
