"""Independent DuckDB SQL for every SQL-expressible registered query.

Written from the operator semantics, not from the Spark code: plain window
functions (``lead``, frames of 20 preceding rows) where the Spark side uses
the skew-safe block layout, UNION ALL where it uses generators.
"""

from __future__ import annotations

from tidepool.plans import fixtures as fx

F5 = fx.TARGET
FEATS = fx.PANEL_FEATURES


def _std1(expr: str) -> str:
    return f"CASE WHEN stddev_pop({expr}) IS NULL OR stddev_pop({expr}) = 0 THEN 1.0 ELSE stddev_pop({expr}) END"


PANEL = fx.PANEL_LABEL_SQL

SPLIT = f"""
  SELECT *, 'train' AS split FROM ({PANEL}) WHERE date < DATE '{fx.SPLIT_TRAIN}'
  UNION ALL
  SELECT *, 'val' AS split FROM ({PANEL}) WHERE date >= DATE '{fx.SPLIT_TRAIN}' AND date < DATE '{fx.SPLIT_VAL}'
  UNION ALL
  SELECT *, 'test' AS split FROM ({PANEL}) WHERE date >= DATE '{fx.SPLIT_TEST}'"""

STATS = "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, {_std1(c)} AS s_{c}" for c in FEATS + [F5]) + f" FROM ({SPLIT}) WHERE split = 'train'"

SCALED = "SELECT sp.*, " + ", ".join(
    f"(sp.{c} - st.m_{c}) / st.s_{c} AS z_{c}" for c in FEATS + [F5]) + f" FROM ({SPLIT}) sp CROSS JOIN ({STATS}) st"

WIN = "(PARTITION BY ticker, split ORDER BY date, row_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"

WINDOWS = f"""
  SELECT split, ticker, date, row_id, {F5} AS actual, z_{F5} AS actual_z, z_px, z_disc,
         count(*) OVER {WIN} AS steps,
         avg(z_px) OVER {WIN} AS px_mean,
         last_value(z_px) OVER {WIN} AS px_last,
         first_value(z_px) OVER {WIN} AS px_first,
         first_value(z_qty) OVER {WIN} AS qty_first,
         sum(z_qty) OVER {WIN} AS zqty_sum,
         first_value(px) OVER {WIN} AS raw_px_first,
         last_value(px) OVER {WIN} AS raw_px_last
  FROM ({SCALED})"""

PREDS_WIDE = f"""
  SELECT split, ticker, row_id, actual, actual_z,
         0.5 * z_px + (-0.2) * z_disc AS ann,
         px_mean AS gru,
         px_last AS lstm,
         0.5 * px_first + 0.1 * qty_first AS transformer
  FROM ({WINDOWS}) WHERE steps = 20"""

PREDS_LONG = f"""
  SELECT split, ticker, row_id, actual, actual_z, model, yhat_z
  FROM (SELECT *, (ann + gru + lstm + transformer) / 4.0 AS ensemble FROM ({PREDS_WIDE}))
  UNPIVOT (yhat_z FOR model IN (ann, gru, lstm, transformer, ensemble))"""

SCORED = f"""
  SELECT p.*, p.yhat_z * st.s_{F5} + st.m_{F5} AS yhat
  FROM ({PREDS_LONG}) p CROSS JOIN ({STATS}) st"""


def r(x: str, d: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {d})"


Q: dict[str, str] = {}

Q["eval_metrics"] = f"""
  SELECT split, model, count(*) AS n, {r('avg(abs(actual - yhat))')} AS mae,
         {r('avg((actual - yhat) * (actual - yhat))')} AS mse
  FROM ({SCORED}) WHERE actual IS NOT NULL GROUP BY split, model"""

Q["model_comparison"] = f"""
  SELECT model, n, mae, mse, CAST(row_number() OVER (ORDER BY mae_raw, model) AS INTEGER) AS mae_rank
  FROM (SELECT model, count(*) AS n, avg(abs(actual - yhat)) AS mae_raw,
               {r('avg(abs(actual - yhat))')} AS mae,
               {r('avg((actual - yhat) * (actual - yhat))')} AS mse
        FROM ({SCORED}) WHERE actual IS NOT NULL AND split = 'test' GROUP BY model)"""


def rr(cols: list[str], src: str, d: int = 6, keep: list[str] = ()) -> str:
    """SELECT keep..., round(col) AS col ... FROM (src)"""
    sel = list(keep) + [f"{r(c, d)} AS {c}" for c in cols]
    return f"SELECT {', '.join(sel)} FROM ({src})"


Q["temporal_split"] = f"SELECT split, ticker, row_id, date FROM ({SPLIT})"

Q["split_report"] = f"""
  SELECT split, count(*) AS n_rows, min(date) AS min_time, max(date) AS max_time FROM ({SPLIT}) GROUP BY split"""

Q["lookback_windows"] = f"""
  SELECT split, ticker, row_id, CAST(steps AS INTEGER) AS n_steps, {r('px_first')} AS px_first,
         {r('px_last')} AS px_last, {r('zqty_sum')} AS qty_sum
  FROM ({WINDOWS}) WHERE steps = 20"""

Q["batch_score"] = f"""
  SELECT split, row_id, model, {r('yhat')} AS yhat
  FROM (SELECT split, row_id, ann, gru, lstm, transformer FROM ({PREDS_WIDE}))
  UNPIVOT (yhat FOR model IN (ann, gru, lstm, transformer))"""

Q["batch_score_python"] = Q["batch_score"]

Q["ensemble_mean"] = f"""
  SELECT split, row_id, {r('(ann + gru + lstm + transformer) / 4.0')} AS yhat, CAST(4 AS BIGINT) AS n_models
  FROM ({PREDS_WIDE})"""

Q["align_predictions"] = f"""
  SELECT s.split, s.row_id, {r('0.5 * s.z_px + (-0.2) * s.z_disc')} AS yhat
  FROM ({SCALED}) s JOIN (SELECT split, row_id FROM ({WINDOWS}) WHERE steps = 20) w
    ON s.split = w.split AND s.row_id = w.row_id"""

Q["attach_actuals"] = f"""
  SELECT w.split, w.row_id, 'gru' AS model, {r('w.px_mean')} AS yhat, {r('p.' + F5)} AS actual
  FROM ({WINDOWS}) w JOIN ({PANEL}) p ON w.row_id = p.row_id WHERE w.steps = 20"""

Q["eval_metrics_scaled"] = f"""
  SELECT split, model, count(*) AS n, {r('avg(abs(actual_z - yhat_z))')} AS mae,
         {r('avg((actual_z - yhat_z) * (actual_z - yhat_z))')} AS mse
  FROM ({SCORED}) WHERE actual_z IS NOT NULL GROUP BY split, model"""

Q["residual_stats"] = f"""
  SELECT split, model, count(*) AS n, {r('avg(actual - yhat)')} AS resid_mean,
         {r('stddev_pop(actual - yhat)')} AS resid_std, {r('min(actual - yhat)')} AS resid_min,
         {r('max(actual - yhat)')} AS resid_max
  FROM ({SCORED}) WHERE actual IS NOT NULL GROUP BY split, model"""

Q["scaler_fit"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column, {r('m_' + c)} AS mean, {r('s_' + c)} AS std FROM ({STATS})" for c in FEATS + [F5])

Q["scaler_transform"] = "SELECT split, row_id, " + ", ".join(
    f"{r('z_' + c)} AS {c}__z" for c in FEATS) + f" FROM ({SCALED})"

Q["scaler_inverse"] = rr(FEATS, SPLIT, keep=["split", "row_id"])

Q["feature_columns"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", count({c}) AS n_values FROM ({fx.PANEL_SQL})"
    for i, c in enumerate(fx.PANEL_FEATURES))

# ------------------------------------------------------------------ dataset build

RAW = f"""
  SELECT ticker, date, row_id, qty, {fx.SPECIALS_SQL_PX} AS px, disc, tax, n, {F5} FROM ({PANEL})"""

JOINED = f"""
  SELECT r.*, m.macro_px, m.macro_n FROM ({RAW}) r LEFT JOIN ({fx.MACRO_SQL}) m ON r.date = m.date"""

DS_COLS = ["qty", "px", "disc", "n", F5, "macro_px", "macro_n"]


def fin(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


CLEANED = "SELECT ticker, date, row_id, " + ", ".join(f"{fin(c)} AS {c}" for c in DS_COLS) + f" FROM ({JOINED})"

FW = "(PARTITION BY ticker ORDER BY date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FILLED = ("SELECT * FROM (SELECT ticker, date, row_id, "
          + ", ".join(f"last_value({c} IGNORE NULLS) OVER {FW} AS {c}" for c in DS_COLS)
          + f" FROM ({CLEANED}) WHERE ticker IS NOT NULL) WHERE "
          + " AND ".join(f"{c} IS NOT NULL" for c in ["ticker", "date", "row_id"] + DS_COLS))

FINAL = f"""
  SELECT * FROM ({FILLED}) WHERE {F5} > (SELECT quantile_cont({F5}, 0.01) FROM ({FILLED}))
                             AND {F5} < (SELECT quantile_cont({F5}, 0.99) FROM ({FILLED}))"""

Q["left_join_macro"] = rr(["macro_px", "macro_n"], JOINED, keep=["ticker", "date", "row_id"])
Q["drop_columns"] = rr(DS_COLS, JOINED, keep=["ticker", "date", "row_id"])
Q["drop_columns_strict"] = rr([c for c in ["qty", "px", "disc", "n", F5, "macro_px"]], JOINED, keep=["ticker", "date", "row_id"])
Q["inf_to_null"] = f"SELECT row_id, {r(fin('px'))} AS px, {r('qty')} AS qty FROM ({RAW})"
Q["parse_dates"] = f"""
  SELECT row_id, CAST(epoch(CAST(CAST(date AS VARCHAR) || 'T00:00:00Z' AS TIMESTAMPTZ)) AS BIGINT) AS epoch_s
  FROM ({fx.PANEL_SQL})"""
Q["ffill_dropna"] = rr(DS_COLS, FILLED, keep=["ticker", "date", "row_id"])
Q["extreme_rows"] = f"""
  SELECT ticker, date, row_id, {r(F5)} AS {F5}, CASE WHEN {F5} = mn THEN 'min' ELSE 'max' END AS extreme
  FROM ({FILLED}) f CROSS JOIN (SELECT min({F5}) AS mn, max({F5}) AS mx FROM ({FILLED})) m
  WHERE {F5} = mn OR {F5} = mx"""
Q["quantiles"] = f"""
  SELECT {r(f'quantile_cont({F5}, 0.01)')} AS q01, {r(f'quantile_cont({F5}, 0.99)')} AS q99 FROM ({FILLED})"""
Q["quantile_trim"] = rr(DS_COLS, FINAL, keep=["ticker", "date", "row_id"])
Q["write_read_back"] = Q["quantile_trim"]
Q["scan_panel"] = rr(["qty", "px", "disc", "tax", "n"], fx.PANEL_SQL, keep=["ticker", "date", "row_id"])

JOINED_DBL = ["qty", "px", "disc", "tax", "n", F5, "macro_px", "macro_n"]


def miss(c: str, dbl: bool) -> str:
    return f"({c} IS NULL OR isnan({c}))" if dbl else f"({c} IS NULL)"


Q["overview"] = (f"SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_cols, min(date) AS min_time, "
                 f"max(date) AS max_time, CAST("
                 + " + ".join(f"sum(CASE WHEN {miss(c, c in JOINED_DBL)} THEN 1 ELSE 0 END)"
                              for c in ["ticker", "date", "row_id"] + JOINED_DBL)
                 + f" AS BIGINT) AS n_missing FROM ({JOINED})")

CLEAN_TYPES = [("ticker", "string"), ("date", "date"), ("row_id", "bigint")] + [(c, "double") for c in DS_COLS]
Q["column_info"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS dtype, CAST(sum(CASE WHEN NOT {miss(c, t == 'double')} THEN 1 ELSE 0 END) "
    f"AS BIGINT) AS non_null FROM ({CLEANED})" for c, t in CLEAN_TYPES)
Q["null_map"] = " UNION ALL ".join(
    f"SELECT CAST(date_trunc('month', date) AS DATE) AS bucket, '{c}' AS column, "
    f"CAST(sum(CASE WHEN {miss(c, t == 'double')} THEN 1 ELSE 0 END) AS BIGINT) AS n_missing "
    f"FROM ({CLEANED}) GROUP BY 1" for c, t in CLEAN_TYPES if c != "date")
Q["distinct_entities"] = f"SELECT DISTINCT ticker FROM ({FINAL})"
Q["describe_target"] = f"""
  SELECT count(*) AS count, {r(f'avg({F5})')} AS mean, {r(f'stddev_samp({F5})')} AS std, {r(f'min({F5})')} AS min,
         {r(f'quantile_cont({F5}, 0.25)')} AS q25, {r(f'quantile_cont({F5}, 0.5)')} AS q50,
         {r(f'quantile_cont({F5}, 0.75)')} AS q75, {r(f'max({F5})')} AS max,
         {r(f'quantile_cont({F5}, 0.5)')} AS median
  FROM ({FINAL}) WHERE {F5} IS NOT NULL AND NOT isnan({F5})"""
Q["value_counts"] = f"SELECT ticker, count(*) AS n FROM ({FINAL}) GROUP BY ticker ORDER BY n DESC, ticker LIMIT 10"


def histogram_sql(x: str, src: str, bins: int) -> str:
    return f"""
  WITH b AS (SELECT {x} AS x FROM ({src}) WHERE {x} IS NOT NULL AND NOT isnan({x})),
       rg AS (SELECT min(x) AS lo, max(x) AS hi FROM b),
       c AS (SELECT CASE WHEN hi - lo = 0 THEN 1
                         ELSE least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS INTEGER) + 1, {bins}) END AS bin,
                    count(*) AS n FROM b CROSS JOIN rg GROUP BY 1)
  SELECT CAST(g.bin AS INTEGER) AS bin, {r(f'lo + (hi - lo) * (g.bin - 1) / {bins}')} AS lo_edge,
         {r(f'lo + (hi - lo) * g.bin / {bins}')} AS hi_edge, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM range(1, {bins + 1}) g(bin) CROSS JOIN rg LEFT JOIN c ON c.bin = g.bin"""


Q["histogram"] = histogram_sql(F5, FINAL, 50)
Q["residual_histogram"] = histogram_sql(
    "resid", f"SELECT actual - yhat AS resid FROM ({SCORED}) WHERE split = 'test' AND model = 'ensemble'", 50)
Q["count_distinct"] = f"SELECT count(DISTINCT ticker) AS n_unique FROM ({FINAL})"
Q["top_k"] = f"""
  (SELECT 'smallest' AS kind, ticker, date, row_id, {r(F5)} AS {F5} FROM ({FILLED})
     WHERE {F5} IS NOT NULL ORDER BY {F5}, row_id LIMIT 3)
  UNION ALL
  (SELECT 'largest' AS kind, ticker, date, row_id, {r(F5)} AS {F5} FROM ({FILLED})
     WHERE {F5} IS NOT NULL ORDER BY {F5} DESC, row_id LIMIT 3)
  UNION ALL
  (SELECT 'head' AS kind, ticker, date, row_id, {r(F5)} AS {F5} FROM ({FILLED}) ORDER BY row_id LIMIT 3)"""

# ------------------------------------------------------------------ serving and monitoring

EV = fx.EVENTS_SQL
CUT = f"TIMESTAMP '{fx.DRIFT_CUT}'"
EWIN = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"

REQ = f"""
  SELECT event_id, user_id, ts,
         CASE event_id % 50
           WHEN 1 THEN seq[1:10]
           WHEN 2 THEN list_concat(seq[1:19], [['NaN'::DOUBLE, 'NaN'::DOUBLE]])
           WHEN 3 THEN list_concat(seq[1:19], [['Infinity'::DOUBLE, 1.0::DOUBLE]])
           WHEN 4 THEN list_transform(seq, lambda r: r[1:1])
           WHEN 5 THEN list_concat(seq[1:19], [[1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE]])
           WHEN 6 THEN list_concat(seq[1:19], [[NULL::DOUBLE, 1.0::DOUBLE]])
           ELSE seq END AS sequence
  FROM (SELECT event_id, user_id, ts, array_agg([value, k] ORDER BY ts, event_id) OVER {EWIN} AS seq,
               count(*) OVER {EWIN} AS steps FROM ({EV}))
  WHERE steps = 20"""

VALIDATED = f"""
  SELECT *, CASE
    WHEN sequence IS NULL OR len(list_filter(sequence, lambda r: r IS NULL
         OR len(list_filter(r, lambda x: x IS NULL)) > 0)) > 0 THEN 'null_value'
    WHEN len(sequence) = 0 THEN 'bad_length'
    WHEN len(list_filter(sequence, lambda r: len(r) <> len(sequence[1]))) > 0 THEN 'ragged'
    WHEN len(sequence) <> 20 THEN 'bad_length'
    WHEN len(list_filter(sequence, lambda r: len(list_filter(r, lambda x: isnan(x) OR isinf(x))) > 0)) > 0
         THEN 'non_finite'
    WHEN len(sequence[1]) <> 2 THEN 'bad_width'
  END AS error_code
  FROM ({REQ})"""

VALID = f"SELECT * FROM ({VALIDATED}) WHERE error_code IS NULL"
INVALID = f"SELECT * FROM ({VALIDATED}) WHERE error_code IS NOT NULL"

EVSTATS = (f"SELECT avg(value) AS m_v, {_std1('value')} AS s_v, avg(k) AS m_k, {_std1('k')} AS s_k "
           f"FROM ({EV}) WHERE ts < {CUT}")

SREQ_Z = f"""
  SELECT v.event_id, v.ts,
         (v.sequence[-1][1] - m_v) / s_v AS zl_v,
         list_avg(list_transform(v.sequence, lambda r: (r[1] - m_v) / s_v)) AS zm_v,
         (v.sequence[1][1] - m_v) / s_v AS zf_v,
         (v.sequence[1][2] - m_k) / s_k AS zf_k, m_v, s_v
  FROM ({VALID}) v CROSS JOIN ({EVSTATS})"""

SREQ_WIDE = f"""
  SELECT event_id, ts, m_v, s_v, 0.5 * zl_v AS ann, zm_v AS gru, zl_v AS lstm, 0.5 * zf_v + 0.1 * zf_k AS transformer
  FROM ({SREQ_Z})"""

SREQ = f"""
  SELECT event_id, ts, ann * s_v + m_v AS ann, gru * s_v + m_v AS gru, lstm * s_v + m_v AS lstm,
         transformer * s_v + m_v AS transformer, ((ann + gru + lstm + transformer) / 4.0) * s_v + m_v AS ensemble
  FROM ({SREQ_WIDE})"""

PLOG = f"""
  SELECT event_id AS id, ts, model, prediction, CASE WHEN model <> 'ensemble' THEN (event_id % 5000) / 1000.0::DOUBLE END AS latency_s
  FROM ({SREQ}) UNPIVOT (prediction FOR model IN (ann, gru, lstm, transformer, ensemble))"""

Q["validate_sequences"] = f"SELECT event_id, error_code FROM ({VALIDATED})"
Q["last_step"] = f"""
  SELECT event_id, {r('sequence[-1][1]')} AS step_value, {r('sequence[-1][2]')} AS step_k FROM ({VALID})"""
Q["flatten_named"] = f"""
  SELECT event_id, CAST(pos AS INTEGER) AS position,
         CASE WHEN pos < 2 THEN ['value', 'k'][pos + 1] ELSE 'feature_' || CAST(pos AS VARCHAR) END AS name,
         {r('value')} AS value
  FROM (SELECT event_id, unnest(flat) AS value, generate_subscripts(flat, 1) - 1 AS pos
        FROM (SELECT event_id, flatten(sequence) AS flat FROM ({VALID})))"""
Q["position_encoding"] = f"""
  SELECT event_id, {r('sum(step[1] + sin(t - 1))')} AS value_pe_sum, {r('sum(step[2] + cos(t - 1))')} AS k_pe_sum
  FROM (SELECT event_id, unnest(sequence) AS step, generate_subscripts(sequence, 1) AS t FROM ({VALID}))
  GROUP BY event_id"""
Q["score_requests"] = rr(["ann", "gru", "lstm", "transformer", "ensemble"], SREQ, keep=["event_id"])

_le = ", ".join(
    f"CAST(sum(CASE WHEN latency_s IS NULL THEN NULL WHEN latency_s <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS le_{str(b).replace('.', '_')}"
    # fixed values: latency histogram upper bounds in seconds
    for b in [0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0])
Q["request_metrics"] = f"""
  SELECT model, count(*) AS n_predictions, {r('sum(latency_s)')} AS latency_sum, {_le}, nullif(count(latency_s), 0) AS le_inf,
         {r("arg_max(prediction, {'ts': ts, 'id': id})")} AS last_value,
         (SELECT count(*) FROM ({INVALID})) AS validation_errors
  FROM ({PLOG}) GROUP BY model"""
Q["prediction_log"] = f"""
  SELECT id, {r('prediction')} AS prediction, CAST(40 AS INTEGER) AS n_features FROM ({PLOG}) WHERE model = 'ensemble'"""
Q["last_n"] = f"""
  SELECT event_id, user_id, {r('value')} AS value FROM ({EV}) ORDER BY ts DESC, event_id DESC LIMIT 1000"""
SAMPLE_ORDER = "((event_id % 1073741824) * 2654435761 + 42) % 4294967296, event_id"
Q["seeded_sample"] = f"SELECT event_id FROM ({EV}) WHERE ts < {CUT} ORDER BY {SAMPLE_ORDER} LIMIT 1000"

# drift ----------------------------------------------------------------

DNUM = {"value": "ks", "k": "wasserstein", "user_id": "ks", "hour": "wasserstein"}
DFRAME = (f"SELECT event_id, ts, value, k, CAST(user_id AS DOUBLE) AS user_id, CAST(hour(ts) AS DOUBLE) AS hour, "
          f"event_type FROM ({EV})")


def ks_p(d: str, n: str, m: str) -> str:
    ne = f"sqrt(({n}) * ({m}) / (({n}) + ({m})))"
    lam = f"(({ne} + 0.12 + 0.11 / {ne}) * ({d}))"
    series = f"list_sum(list_transform(range(1, 101), lambda kk: pow(-1, kk - 1) * exp(-2 * kk * kk * {lam} * {lam})))"
    return f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * {series})) END"


def drift_columns_sql(ref: str, cur: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS col, '{side}' AS side, CAST({c} AS DOUBLE) AS x FROM ({src})"
        for c in DNUM for side, src in (("ref", ref), ("cur", cur)))
    cat = " UNION ALL ".join(f"SELECT 'event_type' AS col, '{side}' AS side, event_type AS v FROM ({src})"
                             for side, src in (("ref", ref), ("cur", cur)))
    meth = "CASE tot.col " + " ".join(f"WHEN '{c}' THEN '{m}'" for c, m in DNUM.items()) + " END"
    return f"""
  WITH lg AS (SELECT * FROM ({long}) WHERE x IS NOT NULL AND NOT isnan(x)),
  cnt AS (SELECT col, x, sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS c_ref,
                 sum(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS c_cur FROM lg GROUP BY col, x),
  tot AS (SELECT col, CAST(sum(c_ref) AS BIGINT) AS n_ref, CAST(sum(c_cur) AS BIGINT) AS n_cur FROM cnt GROUP BY col),
  cum AS (SELECT col, x, sum(c_ref) OVER (PARTITION BY col ORDER BY x) AS cr,
                 sum(c_cur) OVER (PARTITION BY col ORDER BY x) AS cc,
                 lead(x) OVER (PARTITION BY col ORDER BY x) AS nx FROM cnt),
  g AS (SELECT cum.col, abs(cr / n_ref - cc / n_cur) AS gap, nx - x AS dx FROM cum JOIN tot ON cum.col = tot.col
        WHERE n_ref > 0 AND n_cur > 0),
  st AS (SELECT col, max(gap) AS d, sum(coalesce(gap * dx, 0.0)) AS w FROM g GROUP BY col),
  sd AS (SELECT col, stddev_pop(x) AS sd FROM lg WHERE side = 'ref' GROUP BY col),
  num AS (SELECT tot.col, {meth} AS method, n_ref, n_cur,
                 CASE WHEN {meth} = 'ks' THEN d ELSE w / (CASE WHEN sd IS NULL OR sd = 0 THEN 1.0 ELSE sd END) END AS stat,
                 CASE WHEN {meth} = 'ks' THEN {ks_p('d', 'n_ref', 'n_cur')} END AS p_value,
                 CASE WHEN {meth} = 'ks' THEN 0.05 ELSE 0.1 END AS threshold
          FROM tot LEFT JOIN st ON tot.col = st.col LEFT JOIN sd ON tot.col = sd.col),
  cc AS (SELECT col, v, sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS c_ref,
                sum(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS c_cur
         FROM ({cat}) WHERE v IS NOT NULL GROUP BY col, v),
  ct AS (SELECT col, CAST(sum(c_ref) AS BIGINT) AS n_ref, CAST(sum(c_cur) AS BIGINT) AS n_cur FROM cc GROUP BY col),
  sh AS (SELECT cc.col, c_ref / n_ref AS p, c_cur / n_cur AS q FROM cc JOIN ct ON cc.col = ct.col
         WHERE n_ref > 0 AND n_cur > 0),
  js AS (SELECT col, sqrt(greatest(sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0.0 END
                                     + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0.0 END), 0.0)) AS js
         FROM sh GROUP BY col),
  catr AS (SELECT ct.col, 'js' AS method, n_ref, n_cur, js AS stat, CAST(NULL AS DOUBLE) AS p_value, 0.1 AS threshold
           FROM ct LEFT JOIN js ON ct.col = js.col),
  allc AS (SELECT * FROM num UNION ALL SELECT * FROM catr)
  SELECT col AS "column", method, n_ref, n_cur, stat, p_value, threshold,
         CASE WHEN n_ref = 0 OR n_cur = 0 OR stat IS NULL THEN 'no_data' ELSE 'ok' END AS status,
         CASE WHEN n_ref = 0 OR n_cur = 0 OR stat IS NULL THEN false
              WHEN method = 'ks' THEN p_value < threshold ELSE stat >= threshold END AS drifted
  FROM allc"""


def drift_dataset_sql(ref: str, cur: str) -> str:
    return f"""
  SELECT count(*) AS n_columns, CAST(sum(CAST(drifted AS INTEGER)) AS BIGINT) AS n_drifted,
         avg(CAST(drifted AS DOUBLE)) AS drift_share, 'success' AS status,
         avg(CAST(drifted AS DOUBLE)) > 0.3 AS dataset_drift,
         CASE WHEN NOT (avg(CAST(drifted AS DOUBLE)) > 0.3) THEN 'none'
              WHEN avg(CAST(drifted AS DOUBLE)) > 0.5 THEN 'critical' ELSE 'warning' END AS severity
  FROM ({drift_columns_sql(ref, cur)})"""


DREF = f"SELECT * FROM ({DFRAME}) WHERE ts < {CUT}"
DCUR = f"SELECT * FROM ({DFRAME}) WHERE ts >= {CUT}"
DCUR_SHIFT = f"SELECT * REPLACE (value * 1.5 AS value) FROM ({DCUR}) WHERE event_type <> 'view'"

_dc = drift_columns_sql(DREF, DCUR)
Q["drift_columns"] = f"""
  SELECT "column", method, n_ref, n_cur, {r('stat')} AS stat, {r('p_value')} AS p_value,
         {r('threshold')} AS threshold, status, drifted FROM ({_dc})"""


ENS_LOG = f"SELECT * FROM ({PLOG}) WHERE model = 'ensemble'"
Q["drift_prediction"] = f"""
  SELECT n_window, {r('mean')} AS mean, {r('std')} AS std, {r('mn')} AS min, {r('mx')} AS max,
         {r('''CASE WHEN n_window < 50 THEN 0.0 WHEN std IS NULL OR std = 0 THEN 0.0
              ELSE least(1.0, std / greatest(abs(mean), 0.01)) END''')} AS drift_score
  FROM (SELECT count(prediction) AS n_window, avg(prediction) AS mean, stddev_pop(prediction) AS std,
               min(prediction) AS mn, max(prediction) AS mx
        FROM (SELECT * FROM ({ENS_LOG}) ORDER BY ts DESC, id DESC LIMIT 100))"""

PRED_SCORE = f"(SELECT drift_score FROM ({Q['drift_prediction']}))"


def _dd(ref: str, cur: str, scenario: str) -> str:
    return (f"SELECT n_columns, n_drifted, {r('drift_share')} AS drift_share, status, dataset_drift, severity, "
            f"(SELECT count(*) FROM ({cur})) AS samples_analyzed, {PRED_SCORE} AS prediction_drift_score, "
            f"'{scenario}' AS scenario FROM ({drift_dataset_sql(ref, cur)})")


Q["drift_dataset"] = _dd(DREF, DCUR, "baseline") + " UNION ALL " + _dd(DREF, DCUR_SHIFT, "shifted")

_null = "CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)"
_why = "CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)"
_share = "avg(CAST(drifted AS DOUBLE))"
Q["drift_schema_guard"] = f"""
  SELECT 'five common' AS scenario, count(*) AS n_columns, CAST(sum(CAST(drifted AS INTEGER)) AS BIGINT) AS n_drifted, {r(_share)} AS drift_share,
         'success' AS status, {_share} > 0.3 AS dataset_drift,
         CASE WHEN NOT ({_share} > 0.3) THEN 'none' WHEN {_share} > 0.5 THEN 'critical' ELSE 'warning' END AS severity,
         (SELECT count(*) FROM ({DCUR})) AS samples_analyzed, CAST(0 AS DOUBLE) AS prediction_drift_score
  FROM ({_dc}) WHERE "column" IN ('value', 'k', 'event_type')
  UNION ALL SELECT 'four common', {_null}, 'schema_mismatch', {_why}
  UNION ALL SELECT 'nine rows', {_null}, 'insufficient_data', {_why}"""

Q["drift_reference_file"] = (
    f"SELECT 'file' AS scenario, status, n_columns, n_drifted, drift_share, dataset_drift, severity "
    f"FROM ({_dd(DREF, DCUR, 'file')}) UNION ALL "
    "SELECT 'missing', 'insufficient_data', NULL, NULL, NULL, NULL, NULL")
Q["requests_json"] = f"SELECT CAST(event_id AS VARCHAR) AS request_id, error_code FROM ({VALIDATED})"

CUR_WIN = f"SELECT * FROM ({DCUR}) ORDER BY ts DESC, event_id DESC LIMIT 1000"
STATUS = f"""
  SELECT (SELECT count(*) FROM ({DREF})) AS reference_samples,
         (SELECT CAST(least(count(*), 1000) AS BIGINT) FROM ({CUR_WIN})) AS current_window_size,
         (SELECT CAST(least(count(*), 1000) AS BIGINT) FROM ({ENS_LOG})) AS prediction_window_size,
         (SELECT CAST(epoch(max(ts)) AS BIGINT) FROM ({CUR_WIN})) AS last_drift_check,
         CAST(0.3 AS DOUBLE) AS drift_threshold, CAST(1000 AS INTEGER) AS window_size"""
Q["drift_status"] = STATUS

Q["drift_report"] = f"""
  SELECT CASE WHEN s.current_window_size < 10 THEN 'insufficient_data' ELSE 'success' END AS status,
         s.reference_samples, s.current_window_size, s.prediction_window_size, {r('s.drift_threshold')} AS drift_threshold,
         s.window_size, v.status AS check_status, v.dataset_drift, {r('v.drift_share')} AS drift_share, v.severity,
         (SELECT count(*) FROM ({CUR_WIN})) AS samples_analyzed, {PRED_SCORE} AS prediction_drift_score,
         CASE WHEN v.dataset_drift THEN 'Consider retraining the model' ELSE 'No action required' END AS recommendation
  FROM ({STATUS}) s CROSS JOIN ({drift_dataset_sql(DREF, CUR_WIN)}) v"""

Q["run_log"] = f"""
  SELECT model || '_run' AS run_name, model, {r('test_mae')} AS test_mae,
         CAST(row_number() OVER (ORDER BY test_mae, model || '_run') AS INTEGER) AS rank
  FROM (SELECT model, avg(abs(actual - yhat)) AS test_mae FROM ({SCORED})
        WHERE actual IS NOT NULL AND split = 'test' GROUP BY model)"""

# ------------------------------------------------------------------ streaming twins
Q["stream_ingest"] = Q["validate_sequences"]
Q["stream_last_n"] = Q["last_n"]
Q["stream_metrics"] = f"""
  SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, model, count(*) AS n_predictions,
         {r('sum(latency_s)')} AS latency_sum, {r('sum(prediction)')} AS prediction_sum
  FROM ({PLOG}) GROUP BY 1, 2"""

Q["stream_prediction_log"] = Q["prediction_log"]
Q["stream_request_metrics"] = Q["request_metrics"]
Q["stream_last_n_by_model"] = f"""
  SELECT model, CAST(rank AS INTEGER) AS rank, id, {r('prediction')} AS prediction
  FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, id DESC) AS rank FROM ({PLOG})) WHERE rank <= 100"""

# hourly cuts: the newest 1000 events before each, against the reference period.
# KS is read off at the values of a window (ASOF join for the reference), the
# other distances on the union of the values of both sides.
_num = " UNION ALL ".join(f"SELECT {{0}} '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM {{1}}" for c in DNUM)
_ks = ", ".join(f"'{c}'" for c, m in DNUM.items() if m == "ks")
Q["stream_drift_check"] = f"""
  WITH ev AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos, date_trunc('hour', ts) AS hr FROM ({DFRAME}) WHERE ts IS NOT NULL),
  cuts AS (SELECT hr + INTERVAL 1 HOUR AS cut, max(pos) AS last FROM ev WHERE hr < (SELECT max(hr) FROM ev) GROUP BY hr),
  due AS (SELECT *, least(last, 1000) AS n FROM cuts WHERE least(last, 1000) >= 100),
  win AS (SELECT cut, ev.* FROM due JOIN ev ON pos <= last AND pos > last - n),
  ref AS ({DREF}),
  wl AS (SELECT * FROM ({_num.format('cut,', 'win')}) WHERE x IS NOT NULL AND NOT isnan(x)),
  rl AS (SELECT * FROM ({_num.format('', 'ref')}) WHERE x IS NOT NULL AND NOT isnan(x)),
  rc AS (SELECT col, x, c, sum(c) OVER (PARTITION BY col ORDER BY x) AS le FROM (SELECT col, x, count(*) AS c FROM rl GROUP BY col, x)),
  rt AS (SELECT col, count(*) AS n_ref, stddev_pop(x) AS sd FROM rl GROUP BY col),
  wc AS (SELECT *, sum(c) OVER (PARTITION BY cut, col ORDER BY x) AS le, sum(c) OVER (PARTITION BY cut, col) AS m
         FROM (SELECT cut, col, x, count(*) AS c FROM wl GROUP BY cut, col, x)),
  pt AS (SELECT wc.*, coalesce(rc.le, 0) AS rle, coalesce(CASE WHEN rc.x = wc.x THEN rc.le - rc.c ELSE rc.le END, 0) AS rlt, n_ref
         FROM wc ASOF LEFT JOIN rc ON wc.col = rc.col AND wc.x >= rc.x JOIN rt ON rt.col = wc.col WHERE wc.col IN ({_ks})),
  ks AS (SELECT cut, col, max(greatest(abs(rle / n_ref - le / m), abs(rlt / n_ref - (le - c) / m))) AS d, any_value(n_ref) AS n, any_value(m) AS m
         FROM pt GROUP BY cut, col),
  grid AS (SELECT cut, col, x, sum(cr) AS cr, sum(cc) AS cc FROM (
             SELECT cut, col, x, 0 AS cr, c AS cc FROM wc WHERE col NOT IN ({_ks})
             UNION ALL SELECT k.cut, rc.col, rc.x, rc.c, 0 FROM (SELECT DISTINCT cut, col FROM wc) k JOIN rc ON rc.col = k.col
             WHERE rc.col NOT IN ({_ks})) GROUP BY cut, col, x),
  gap AS (SELECT cut, col, abs(sum(cr) OVER p / sum(cr) OVER q - sum(cc) OVER p / sum(cc) OVER q) * (lead(x) OVER p - x) AS g
          FROM grid WINDOW p AS (PARTITION BY cut, col ORDER BY x), q AS (PARTITION BY cut, col)),
  ws AS (SELECT cut, gap.col, sum(coalesce(g, 0)) / any_value(CASE WHEN sd IS NULL OR sd = 0 THEN 1.0 ELSE sd END) AS w
         FROM gap JOIN rt ON rt.col = gap.col GROUP BY cut, gap.col),
  cat AS (SELECT cut, v, sum(cr) AS cr, sum(cc) AS cc FROM (
            SELECT cut, event_type AS v, 0 AS cr, count(*) AS cc FROM win WHERE event_type IS NOT NULL GROUP BY cut, event_type
            UNION ALL SELECT cut, v, c, 0 FROM due, (SELECT event_type AS v, count(*) AS c FROM ref WHERE event_type IS NOT NULL GROUP BY 1))
          GROUP BY cut, v),
  sh AS (SELECT cut, cr / sum(cr) OVER (PARTITION BY cut) AS p, cc / sum(cc) OVER (PARTITION BY cut) AS q FROM cat),
  js AS (SELECT cut, sqrt(greatest(sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0.0 END
                                     + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0.0 END), 0.0)) AS js FROM sh GROUP BY cut),
  tests AS (SELECT cut, {ks_p('d', 'n', 'm')} < 0.05 AS drifted FROM ks
            UNION ALL SELECT cut, w >= 0.1 FROM ws UNION ALL SELECT cut, js >= 0.1 FROM js),
  per AS (SELECT cut, count(*) AS n_columns, CAST(sum(CAST(drifted AS INTEGER)) AS BIGINT) AS n_drifted, avg(CAST(drifted AS DOUBLE)) AS share
          FROM tests GROUP BY cut)
  SELECT CAST(epoch(cut) AS BIGINT) AS check_ts, n AS window_size, n_columns, n_drifted, {r('share')} AS drift_share,
         share > 0.3 AS dataset_drift, CASE WHEN NOT (share > 0.3) THEN 'none' WHEN share > 0.5 THEN 'critical' ELSE 'warning' END AS severity
  FROM per JOIN due USING (cut)"""

# least absolute error by reweighted least squares, one feature in closed form
Q["fit_absolute"] = f"""
  WITH RECURSIVE d AS (SELECT z_px AS x, z_{F5} AS y, split = 'val' AS is_val FROM ({SCALED})
                       WHERE split IN ('train', 'val') AND z_px IS NOT NULL AND z_{F5} IS NOT NULL),
  it AS (SELECT 0 AS t, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM d WHERE NOT is_val
         UNION ALL
         SELECT t + 1, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, (sw * sxy - sx * sy) / (sw * sxx - sx * sx)
         FROM (SELECT t, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
               FROM (SELECT t, x, y, 1 / greatest(abs(y - a - b * x), 0.01) AS w FROM it, d WHERE NOT is_val AND t < 12) GROUP BY t)),
  err AS (SELECT t, any_value(a) AS a, any_value(b) AS b, avg(abs(y - a - b * x)) FILTER (NOT is_val) AS tr,
                 avg(abs(y - a - b * x)) FILTER (is_val) AS va FROM it, d GROUP BY t)
  SELECT t AS iteration, {r('a')} AS intercept, {r('b')} AS slope, {r('tr')} AS train_mae, {r('va')} AS val_mae,
         t = (SELECT arg_min(t, va) FROM err) AS kept FROM err"""
