import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators.evaluate import (align_predictions, attach_actuals, check_actuals, ensemble_mean,
                                         eval_metrics, model_comparison, residual_stats)
from tidepool.operators.score import LinearScorer, PandasScorer, batch_score, linear_predict
from tidepool.operators.validate import flatten_named, last_step, validate_sequences

SEQ = "sequence array<array<double>>"


def seq(n=20, w=68):
    return [[float((3 * step * step + 5 * col) % 17) for col in range(w)] for step in range(n)]


def test_validation_codes(spark):
    nan_seq = seq(); nan_seq[10][5] = float("nan")
    inf_seq = seq(); inf_seq[15][10] = float("inf")
    ragged = seq(); ragged[3] = ragged[3][:10]
    nul = seq(); nul[2][2] = None
    cases = [("ok", seq()), ("short", seq(10)), ("width", seq(20, 10)), ("nan", nan_seq), ("inf", inf_seq),
             ("ragged", ragged), ("null", nul), ("empty", []), ("big", [[1e10] * 68] * 20)]
    df = spark.createDataFrame(cases, f"name string, {SEQ}")
    got = {r["name"]: r["error_code"] for r in validate_sequences(df, "sequence", 20, 68).collect()}
    assert got == {"ok": None, "short": "bad_length", "width": "bad_width", "nan": "non_finite",
                   "inf": "non_finite", "ragged": "ragged", "null": "null_value", "empty": "bad_length",
                   "big": None}


def test_flatten_names_and_last_step(spark):
    df = spark.createDataFrame([(1, seq())], f"id long, {SEQ}")
    names = [f"f{j}" for j in range(68)]
    flat = flatten_named(df, "sequence", names, keep=["id"]).orderBy("position").collect()
    assert len(flat) == 1360
    assert flat[0]["name"] == "f0" and flat[67]["name"] == "f67" and flat[68]["name"] == "feature_68"
    assert flat[68]["value"] == seq()[1][0]               # row-major: step 1, feature 0
    assert df.select(last_step(F.col("sequence")).alias("l")).first()["l"] == seq()[-1]


def test_batch_score_linear_and_pandas(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(30, 20, 3))
    df = spark.createDataFrame([(i, X[i].tolist(), X[i, -1].tolist()) for i in range(30)],
                               "row_id long, seq array<array<double>>, x_row array<double>")
    w = np.array([0.5, -1.0, 2.0])
    lin = LinearScorer("lin", {"a": 0.5, "b": -1.0, "c": 2.0}, "last")
    py = PandasScorer("py", lambda: linear_predict(w, 0.0, "last"))
    mean = LinearScorer("mean_a", {"a": 1.0}, "mean")
    out = batch_score(df, [lin, py, mean], ["a", "b", "c"], 20).collect()
    got = {(r["row_id"], r["model"]): r["yhat"] for r in out}
    for i in range(30):
        assert got[(i, "lin")] == pytest.approx(X[i, -1] @ w)
        assert got[(i, "py")] == pytest.approx(X[i, -1] @ w)
        assert got[(i, "mean_a")] == pytest.approx(X[i, :, 0].mean())


def test_ensemble_align_and_metrics(spark):
    preds = spark.createDataFrame([(1, "m1", 1.0), (1, "m2", 3.0), (2, "m1", 5.0)], "row_id long, model string, yhat double")
    ens = {r["row_id"]: (r["yhat"], r["n_models"]) for r in ensemble_mean(preds).collect()}
    assert ens == {1: (2.0, 2), 2: (5.0, 1)}
    row_preds = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0)], "row_id long, yhat double")
    assert sorted(r["row_id"] for r in align_predictions(preds, row_preds).collect()) == [1, 2]
    truth = spark.createDataFrame([(1, 2.0), (2, 2.0)], "row_id long, y double")
    assert check_actuals(preds, truth).first()["missing_ids"] == 0
    scored = attach_actuals(preds, truth).withColumn("split", F.lit("test"))
    m = {r["model"]: (r["n"], r["mae"], r["mse"]) for r in eval_metrics(scored).collect()}
    assert m["m1"] == (2, 2.0, 5.0) and m["m2"] == (1, 1.0, 1.0)
    rs = {r["model"]: r for r in residual_stats(scored).collect()}
    assert rs["m1"]["resid_mean"] == -1.0 and rs["m1"]["resid_std"] == 2.0     # population std of (1, -3)
    cmp = {r["model"]: r["mae_rank"] for r in model_comparison(eval_metrics(scored, ["model"])).collect()}
    assert cmp == {"m2": 1, "m1": 2}


def test_missing_actual_is_an_error(spark):
    preds = spark.createDataFrame([(1, 0.5), (2, 0.7)], "row_id long, yhat double")
    truth = spark.createDataFrame([(1, None)], "row_id long, y double")
    with pytest.raises(Exception, match="no actual for id 2"):
        attach_actuals(preds, truth).collect()
    known = attach_actuals(preds.filter("row_id = 1"), truth).first()
    assert known["actual"] is None and known["yhat"] == 0.5


def test_python_models_share_one_pass(spark):
    rows = [(i, [[float(i + s), 1.0] for s in range(3)], [float(i), 2.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, seq array<array<double>>, x_row array<double>")
    w = np.array([1.0, 0.5])
    models = [PandasScorer("a", lambda: linear_predict(w, 0.0, "last")), PandasScorer("b", lambda: linear_predict(w, 1.0), "row")]
    out = batch_score(df, models, ["p", "q"], 3)
    got = {(r["row_id"], r["model"]): r["yhat"] for r in out.collect()}
    assert got == {**{(i, "a"): i + 2.5 for i in range(5)}, **{(i, "b"): i + 2.0 for i in range(5)}}
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_scaled_steps_are_written_out_and_odd_widths_kept(spark):
    from tidepool.operators.windows import scale_sequences
    seqs = [[[1.0, 2.0], [3.0, None]], [[4.0]], [[], None], None, [[float("nan"), 1.0]]]
    df = spark.createDataFrame([(i, q, 1.0, 2.0) for i, q in enumerate(seqs)], "i int, q array<array<double>>, m double, s double")
    z = df.select("i", scale_sequences(F.col("q"), [F.col("m"), F.lit(0.0)], [F.col("s"), F.lit(4.0)]).alias("z"))
    got = [r.z for r in z.orderBy("i").collect()]
    assert got[:4] == [[[0.0, 0.5], [1.0, None]], [[1.5]], [[], None], None] and got[4][0][1] == 0.25
    assert "array(" in z._jdf.queryExecution().optimizedPlan().toString().split("CASE")[1].split("ELSE")[0]


def test_valid_sequences_are_asked_first(spark):
    ok = [[1.0, 2.0]] * 2
    cases = {None: ok, "null_value": [[1.0, None], [1.0, 2.0]], "ragged": [[1.0, 2.0, 3.0], [4.0]], "bad_length": ok[:1],
             "non_finite": [[1.0, 2.0], [float("-inf"), 0.0]], "bad_width": [[1.0], [2.0]]}
    rows = [(c, q) for c, q in cases.items()] + [("non_finite", [[float("nan"), 1.0], [1.0, 1.0]]), ("null_value", [[float("nan"), None], [1.0, 1.0]]),
                                                ("null_value", None), ("null_value", [None, [1.0, 2.0]]), ("bad_length", [])]
    df = spark.createDataFrame(rows, "want string, q array<array<double>>")
    got = validate_sequences(df, "q", 2, 2)
    assert all(r.want == r.error_code for r in got.collect())
    assert "flatten" in got._jdf.queryExecution().optimizedPlan().toString()
