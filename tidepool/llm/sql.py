"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"
ALNUM = r"coalesce(regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM.format(LOWER.format('text'))} AS w FROM documents),
b0 AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM.format(LOWER.format('text'))} AS w FROM benchmark),
b AS (SELECT *, least(13, len(w)) AS k FROM b0 WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, w[i:i + k - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM b),
dw AS (SELECT rid, k, i, w[i:i + k - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hit AS (SELECT rid, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, k, i FROM hit))
        GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN items USING (rid) LEFT JOIN pos USING (rid)
"""

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, {WORDS.format('text')} AS w
           FROM documents),
win AS (SELECT rid, o, i, w[i:i + 12] AS win FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p
         FROM (SELECT *, min(o) OVER (PARTITION BY win) AS first FROM win) WHERE first < o),
lost AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid),
kept AS (SELECT doc_id, w, coalesce(ps, []) AS ps,
                [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(coalesce(ps, []), i)] AS k
         FROM d LEFT JOIN lost USING (rid))
SELECT doc_id, len(w) AS n_words, len(ps) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


def _op1() -> str:
    metrics = {"word_length": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words",
               "capitals": "n_upper"}
    gamma = "(1.01::DOUBLE / 0.99::DOUBLE)"
    buckets = " UNION ALL ".join(
        f"SELECT rid, lang, source, '{m}' AS metric, {num} / n_words AS x FROM c WHERE n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words"
        for m, num in metrics.items())
    value = lambda b: f"CASE WHEN {b} = -100000 THEN 0 ELSE 2.0::DOUBLE * pow({gamma}, {b}) / ({gamma} + 1) END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, {WORDS.format('text')} AS w,
           [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
win AS (SELECT rid, i, w[i:i + 7] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS k FROM win) WHERE k > 1) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, CAST(list_sum([length(x) FOR x IN w]) AS BIGINT) AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper FROM d LEFT JOIN rep USING (rid)),
v AS ({buckets}),
b AS (SELECT *, CASE WHEN x <= 0 THEN -100000 ELSE CAST(ceil(ln(x) / ln({gamma})) AS INT) END AS bucket FROM v),
g AS (SELECT lang, source, metric, bucket, count(*) AS gn FROM b GROUP BY ALL),
gt AS (SELECT lang, source, metric, sum(gn) AS gt FROM g GROUP BY ALL),
l AS (SELECT lang, metric, bucket, sum(gn) AS ln_ FROM g GROUP BY ALL),
lt AS (SELECT lang, metric, sum(ln_) AS lt FROM l GROUP BY ALL),
grid AS (SELECT gt.lang, gt.source, gt.metric, l.bucket, CAST(gt AS HUGEINT) AS gt, CAST(lt AS HUGEINT) AS lt,
         CAST(coalesce(gn, 0) AS HUGEINT) * lt + CAST(ln_ AS HUGEINT) * 10 AS wt
         FROM gt JOIN l ON gt.lang IS NOT DISTINCT FROM l.lang AND gt.metric = l.metric
         JOIN lt ON gt.lang IS NOT DISTINCT FROM lt.lang AND gt.metric = lt.metric
         LEFT JOIN g ON g.lang IS NOT DISTINCT FROM gt.lang AND g.source IS NOT DISTINCT FROM gt.source AND g.metric = gt.metric
                        AND g.bucket = l.bucket),
cum AS (SELECT *, sum(wt) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS cw, lt * (gt + 10) AS whole FROM grid),
q AS (SELECT lang, source, metric, min(bucket) FILTER (cw * 4 >= whole) AS b1, min(bucket) FILTER (cw * 4 >= whole * 3) AS b3,
             min(bucket) FILTER (cw * 20 >= whole) AS b0, min(bucket) FILTER (cw * 20 >= whole * 19) AS b4 FROM cum GROUP BY ALL),
e AS (SELECT lang, source, metric, {value('b0')} AS low, {value('b1')} AS q1, {value('b3')} AS q3, {value('b4')} AS high FROM q),
ok AS (SELECT rid, bool_and(x <= greatest(q3 + (q3 - q1) * 3, high) + 0.01
                            AND (metric <> 'word_length' OR x >= least(q1 - (q3 - q1) * 3, low) - 0.01)) AS ok
       FROM v JOIN e USING (metric) WHERE v.lang IS NOT DISTINCT FROM e.lang AND v.source IS NOT DISTINCT FROM e.source GROUP BY rid)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(ok, false) AS kept
FROM c LEFT JOIN ok USING (rid)
"""


# CRC-32 of the decimal digits of a number, bit by bit
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""

# Runs by doubling: windows of 2^k words are named by pairs of names. Inside a
# run of period q, windows of q to 2q - 1 words recur after exactly q words, so
# a stretch of places whose next equal window lies q further on is a run.
LEVELS = 20     # periods up to 2^20 words


def _op12() -> str:
    names = ["n0 AS (SELECT rid, i, hash(word) AS v FROM t)"]
    for k in range(LEVELS):
        names.append(f"m{k} AS (SELECT rid, i, v, lead(v, {1 << k}) OVER (PARTITION BY rid ORDER BY i) AS u FROM n{k})")
        names.append(f"n{k + 1} AS (SELECT rid, i, hash(v, u) AS v FROM m{k} WHERE u IS NOT NULL)")
    steps = " UNION ALL ".join(
        f"SELECT rid, {1 << k} AS l, i, lead(i) OVER (PARTITION BY rid, v ORDER BY i) - i AS q FROM n{k}" for k in range(LEVELS + 1))
    return f"""
WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format('text')} AS w,
                   coalesce({CRC32.format('doc_id')}, 0) AS h FROM documents),
d AS (SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS periodic, h // 10 AS g FROM d0),
e AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (SELECT rid, i, w[CASE WHEN periodic AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word
      FROM (SELECT *, unnest(range(n)) AS i FROM f)),
{', '.join(names)},
steps AS (SELECT * FROM ({steps}) WHERE q <= l AND 2 * q > l),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM steps),
runs AS (SELECT * FROM (SELECT rid, q, min(i) AS s, max(i) - min(i) + q + min(l) AS n FROM islands GROUP BY rid, q, island)
         WHERE n >= greatest(6, 4 * q)),
best AS (SELECT rid, count(*) AS n_runs, first(s ORDER BY n / q DESC, s, q) AS s, first(n ORDER BY n / q DESC, s, q) AS n,
                first(q ORDER BY n / q DESC, s, q) AS q, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS all_runs
         FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS txt FROM t ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, best.n AS length, q AS period, 1000 * best.n // q AS exponent_milli,
       sha256(coalesce(all_runs, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""


OP12 = _op12()

OP11 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (SELECT c.conv_id, 0 AS own, i, role, txt FROM c JOIN t ON t.conv_id = c.base AND i < h
            UNION ALL SELECT c.conv_id, 1, i, role, txt FROM c JOIN t ON t.conv_id = c.conv_id AND i >= h),
paths AS (SELECT c.conv_id, coalesce(list({{'role': role, 'txt': txt}} ORDER BY own, i) FILTER (i IS NOT NULL), []) AS path
          FROM c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
rows_ AS (SELECT *, path[1:depth] AS prefix FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM paths)),
nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(path) = depth) AS ends FROM rows_ GROUP BY prefix, depth),
kids AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(n.prefix[n.depth].txt) ELSE 0 END AS own
          FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.prefix = n.prefix),
totals AS (SELECT prefix[1:above] AS prefix, above AS depth, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved_tokens
           FROM (SELECT *, unnest(range(depth + 1)) AS above FROM full_) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_ n JOIN totals t ON t.depth = n.depth AND t.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""

ORACLE = {"op1_quality": _op1(), "op3_decontaminate": OP3, "op6_substring": OP6, "op11_trie": OP11, "op12_runs": OP12}
