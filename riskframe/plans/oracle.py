"""Independent DuckDB SQL for each registered query (same column names).

Doubles are rounded to 6 places, as on the Spark side.
"""

from __future__ import annotations

T1 = """t1 AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_linenumber <= 4 THEN NULL ELSE l_tax END AS l_tax,
         CAST(l_returnflag = 'R' AND l_linestatus = 'O' AS INTEGER) AS label,
         l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS ship_year
  FROM lineitem)"""

T1_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
T1_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

T2 = """t2 AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_acctbal, n.n_regionkey, o.o_orderpriority,
         CAST(CASE WHEN o.o_orderstatus <> 'P' THEN 1.0 ELSE 2.0 END AS DOUBLE) AS ELIGSTAT,
         CAST(CASE WHEN o.o_orderstatus <> 'P' THEN CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END END
              AS DOUBLE) AS MORTSTAT,
         CASE WHEN o.o_orderstatus = 'F' AND o.o_custkey % 12 <> 0 THEN CAST(o.o_custkey % 12 AS DOUBLE) END
              AS UCOD_LEADING,
         CASE WHEN o.o_custkey % 3 <> 0 THEN CAST(o.o_orderkey % 2 AS DOUBLE) END AS HYPERTEN,
         CAST(year(o.o_orderdate) - 1992 AS INTEGER) AS SDDSRVYR,
         CAST(o.o_orderpriority = '1-URGENT' AS INTEGER) AS label
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

T3 = r"""t3 AS (
  SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(length(d.text) AS DOUBLE) AS text_len,
         CAST(len(regexp_split_to_array(trim(d.text), '\s+')) AS DOUBLE) AS n_words,
         CAST(len(string_split(d.text, chr(10))) AS DOUBLE) AS n_lines,
         CAST(l.toxic AS DOUBLE) AS toxic, CAST(l.quality = 0 AS INTEGER) AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

T4 = """t4 AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label = 0 AS INTEGER) AS label, label AS class
  FROM embeddings)"""


def md5_order(seed, tag, key):
    return f"md5(concat_ws(':', '{seed}', '{tag}', {key})), {key}"


def long_union(src: str, feats, key: str = "", value=lambda f: f) -> str:
    k = f"{key}, " if key else ""
    return "\n  UNION ALL ".join(
        f"SELECT {k}'{f}' AS feature, CAST({value(f)} AS DOUBLE) AS value FROM {src}" for f in feats)


def r(x: str) -> str:
    return f"round({x}, 6)"


def guarded_corr(x="value", y="y"):
    xm = f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    ym = f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"covar_samp({xm}, {ym}) / nullif(stddev_samp({xm}) * stddev_samp({ym}), 0)"


def corr_table(src: str, feats, label="label", key="") -> str:
    """(feature, value) = |corr|, unrounded."""
    lu = "\n  UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, CAST({label} AS DOUBLE) AS y FROM {src}"
        for f in feats)
    return f"SELECT feature, abs({guarded_corr()}) AS value FROM ({lu}) GROUP BY feature"


def split_cte(name, src, key, label, frac, seed=42, tag="split", flag="is_test"):
    part = f"PARTITION BY {label} " if label else ""
    return f"""{name} AS (
  SELECT *, CAST(rk <= floor(n * CAST({frac} AS DOUBLE) + 0.5) AS INTEGER) AS {flag} FROM (
    SELECT *, row_number() OVER ({part}ORDER BY {md5_order(seed, tag, key)}) AS rk,
           count(*) OVER ({part.strip()}) AS n FROM {src}))"""


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- sources
SQL["load_cycles"] = """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal,
       c_mktsegment AS mktsegment, 1 AS cycle FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 2 FROM supplier"""

SQL["link_mortality"] = """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_nationkey, c.c_acctbal
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""

SQL["numeric_only"] = f"""WITH {T1}
SELECT {T1_KEY}, l_quantity, l_extendedprice, l_discount, l_tax, label, ship_year FROM t1"""

SQL["schema_table"] = """
SELECT column_name,
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT' THEN 'float'
            ELSE lower(column_type) END AS data_type,
       CAST(row_number() OVER () AS INTEGER) AS ordinal
FROM (DESCRIBE lineitem)"""

SQL["sink_roundtrip"] = f"WITH {T1} SELECT label, count(*) AS count FROM t1 GROUP BY label"

SQL["read_fixed_width"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"

# ---------------------------------------------------------------- filters
SQL["cohort_linked"] = f"""WITH {T2}
SELECT o_orderkey, o_totalprice, c_acctbal FROM t2 WHERE ELIGSTAT = 1 AND MORTSTAT = 1"""

SQL["cohort_null_safe"] = f"""WITH {T1}
SELECT {T1_KEY} FROM t1 WHERE l_quantity >= 20 AND l_tax IS DISTINCT FROM CAST(0.02 AS DOUBLE)"""

SQL["cycle_in"] = f"WITH {T2} SELECT o_orderkey, SDDSRVYR FROM t2 WHERE SDDSRVYR IN (4, 6)"

SQL["dropna_subset"] = f"""WITH {T1}
SELECT {T1_KEY}, l_discount, l_tax FROM t1 WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL"""

SQL["drop_leakage"] = f"""WITH {T1}
SELECT {T1_KEY}, l_quantity, l_extendedprice, l_discount, l_tax, label FROM t1"""

SQL["select_features"] = f"WITH {T2} SELECT o_orderkey, o_totalprice, c_acctbal, n_regionkey, label FROM t2"

SQL["select_available"] = f"WITH {T1} SELECT l_orderkey, l_quantity, l_tax, label FROM t1"

SQL["align_columns"] = f"""WITH {T2}, {split_cte('h', 't2', 'o_orderkey', None, 0.1, tag='holdout', flag='is_holdout')}
SELECT o_orderkey, c_acctbal, o_totalprice FROM h WHERE is_holdout = 1"""


def _sparse(th):
    parts = "\n  UNION ALL ".join(
        f"SELECT '{f}' AS feature, count({f}) AS non_null, count(*) AS rows FROM t1" for f in T1_FEATS)
    return f"""WITH {T1}
SELECT feature, non_null, rows, CAST(non_null >= rows * CAST({th} AS DOUBLE) AS INTEGER) AS keep FROM (
  {parts})"""


SQL["drop_sparse"] = _sparse(0.5)
SQL["drop_any_null"] = _sparse(1.0)

SQL["impute_mean"] = f"""WITH {T1}, {split_cte('s', 't1', T1_KEY, 'label', 0.2)},
m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS c, avg(l_tax) AS d
      FROM s WHERE is_test = 0)
SELECT {T1_KEY}, {r('coalesce(l_quantity, a)')} AS l_quantity, {r('coalesce(l_extendedprice, b)')} AS l_extendedprice,
       {r('coalesce(l_discount, c)')} AS l_discount, {r('coalesce(l_tax, d)')} AS l_tax
FROM s, m WHERE is_test = 1"""

SQL["impute_keep_empty"] = f"""WITH {T1},
m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS c, avg(l_tax) AS d FROM t1)
SELECT {T1_KEY}, {r('coalesce(l_quantity, a)')} AS l_quantity, {r('coalesce(l_extendedprice, b)')} AS l_extendedprice,
       {r('coalesce(l_discount, c)')} AS l_discount, {r('coalesce(l_tax, d)')} AS l_tax, CAST(0.0 AS DOUBLE) AS l_empty
FROM t1, m"""

SQL["fill_zero"] = f"""WITH {T1}
SELECT {T1_KEY}, coalesce(l_discount, 0.0) AS l_discount, coalesce(l_tax, 0.0) AS l_tax FROM t1"""

SQL["quality_report"] = f"""WITH {T1}
""" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) AS rows, count(*) - count({f}) AS nulls FROM t1" for f in T1_FEATS)

SQL["harmonize_variables"] = f"""WITH {T2}
SELECT o_orderkey, SDDSRVYR,
       CASE WHEN SDDSRVYR IN (3, 4, 5) THEN o_totalprice WHEN SDDSRVYR IN (6, 7, 8, 9) THEN c_acctbal END AS balance
FROM t2"""

ROW_MEAN_DT = ("(coalesce(l_discount, 0.0) + coalesce(l_tax, 0.0)) / "
               "nullif(CAST(l_discount IS NOT NULL AS INTEGER) + CAST(l_tax IS NOT NULL AS INTEGER), 0)")

SQL["combine_measures"] = f"""WITH {T1}, x AS (SELECT *, {ROW_MEAN_DT} AS rate FROM t1)
SELECT {T1_KEY}, l_quantity AS qty, {r('coalesce(rate, avg(rate) OVER ())')} AS rate FROM x"""

SQL["yes_no_recode"] = f"""WITH {T2}
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 1 THEN 1 WHEN o_custkey % 3 = 2 THEN 0 END AS code FROM t2"""

# ---------------------------------------------------------------- row functions
T1_FLAGS_SQL = ("CAST(coalesce(l_quantity > 25, false) AS INTEGER) + "
                "CAST(coalesce(l_extendedprice > 40000.0, false) AS INTEGER) + "
                "CAST(coalesce(l_discount < CAST(0.03 AS DOUBLE), false) AS INTEGER) + "
                "CAST(coalesce(l_tax > CAST(0.05 AS DOUBLE), false) AS INTEGER)")

SQL["flag_count"] = f"WITH {T1} SELECT {T1_KEY}, {T1_FLAGS_SQL} AS flags FROM t1"

SQL["row_mean"] = f"WITH {T1} SELECT {T1_KEY}, {r(ROW_MEAN_DT)} AS mean_rate FROM t1"

CAUSES = [(1, "HEART_DISEASE"), (2, "MALIGNANT_NEOPLASMS"), (3, "CHRONIC_LOWER_RESPIRATORY_DISEASE"),
          (4, "ACCIDENTS"), (5, "CEREBROVASCULAR_DISEASE"), (6, "ALZHEIMERS_DISEASE"),
          (7, "DIABETES_MELLITUS"), (8, "INFLUENZA_PNEUMONIA"), (9, "NEPHRITIS_NEPHROTICSYNDROME_NEPHROSIS"),
          (10, "ALL_OTHER_CAUSES"), (11, "NOT_DEAD")]
CODE_SQL = "coalesce(CAST(trunc(UCOD_LEADING) AS INTEGER), 11)"

SQL["decode_codes"] = f"""WITH {T2}
SELECT o_orderkey, {CODE_SQL} AS code,
       CASE {CODE_SQL} {' '.join(f"WHEN {k} THEN '{v}'" for k, v in CAUSES)} END AS cause FROM t2"""

# ---------------------------------------------------------------- labels
SQL["label_any_condition"] = f"""WITH {T1}
SELECT {T1_KEY}, l_quantity, l_extendedprice,
       CAST(coalesce(l_linenumber = 1, false) OR coalesce(l_quantity = 50, false)
            OR coalesce(l_discount = 0.0, false) OR coalesce(l_tax = CAST(0.08 AS DOUBLE), false) AS INTEGER) AS label
FROM t1"""

SQL["label_any_code"] = f"""WITH {T1}
SELECT {T1_KEY}, l_quantity, l_extendedprice, l_discount, l_tax,
       CAST(coalesce(l_returnflag = 'A', false) OR coalesce(l_linestatus = 'O', false)
            OR coalesce(l_tax = CAST(0.01 AS DOUBLE), false) OR coalesce(l_discount = CAST(0.1 AS DOUBLE), false)
            AS INTEGER) AS label
FROM t1"""

SQL["label_flag_threshold"] = f"""WITH {T1}
SELECT {T1_KEY}, l_quantity, l_extendedprice, CAST({T1_FLAGS_SQL} > 2 AS INTEGER) AS label FROM t1"""

SQL["label_cause_of_death"] = f"""WITH {T2}
SELECT o_orderkey, o_totalprice, c_acctbal, n_regionkey, CAST({CODE_SQL} IN (1, 5) AS INTEGER) AS label
FROM t2 WHERE ELIGSTAT = 1 AND MORTSTAT = 1"""

SQL["label_mean_threshold"] = f"""WITH {T1},
c AS (SELECT {T1_KEY}, l_quantity, l_extendedprice,
             CAST((l_quantity + l_discount * 100 + l_tax * 100) / 3 >= 12.0 AS INTEGER) AS label
      FROM t1 WHERE ship_year IN (1995, 1996) AND l_quantity IS NOT NULL AND l_discount IS NOT NULL
            AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL),
f AS (SELECT label, quantile_cont(l_quantity, 0.25) AS a1, quantile_cont(l_quantity, 0.75) AS a3,
             quantile_cont(l_extendedprice, 0.25) AS b1, quantile_cont(l_extendedprice, 0.75) AS b3
      FROM c GROUP BY label)
SELECT c.* FROM c JOIN f USING (label)
WHERE NOT (coalesce(l_quantity > a3 + 1.5 * (a3 - a1) OR l_quantity < a1 - 1.5 * (a3 - a1), false)
        OR coalesce(l_extendedprice > b3 + 1.5 * (b3 - b1) OR l_extendedprice < b1 - 1.5 * (b3 - b1), false))"""

SQL["label_contributing"] = f"""WITH {T2}
SELECT o_orderkey, o_totalprice, c_acctbal, n_regionkey, CAST(coalesce(HYPERTEN, 0.0) AS INTEGER) AS label
FROM t2 WHERE ELIGSTAT = 1 AND MORTSTAT = 1"""

SQL["risk_condition"] = f"""WITH {T2}
SELECT o_orderkey, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS risk FROM t2"""

SQL["risk_cause"] = f"WITH {T2} SELECT o_orderkey, CAST({CODE_SQL} IN (1, 5) AS INTEGER) AS risk FROM t2"

SQL["risk_contributing"] = f"""WITH {T2}
SELECT o_orderkey, CAST(coalesce(HYPERTEN, 0) = 1 AS INTEGER) AS risk FROM t2"""

# ---------------------------------------------------------------- profiling
SQL["describe"] = f"""WITH {T1}, lng AS ({long_union('t1', T1_FEATS)})
SELECT feature, count(value) AS count, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std,
       {r('min(value)')} AS min, {r('quantile_cont(value, 0.25)')} AS p25, {r('quantile_cont(value, 0.5)')} AS p50,
       {r('quantile_cont(value, 0.75)')} AS p75, {r('max(value)')} AS max
FROM lng GROUP BY feature"""

SQL["value_counts"] = f"WITH {T1} SELECT label, count(*) AS count FROM t1 GROUP BY label"

SQL["correlation"] = f"""WITH {T1}, c AS ({corr_table('t1', T1_FEATS)})
SELECT feature, {r('value')} AS value FROM c"""

SQL["correlation_sorted"] = SQL["correlation"]

TOP_DECILE_SRC = """t1x AS (SELECT *, l_extendedprice * (1 + coalesce(l_tax, 0.0)) AS gross,
                       l_extendedprice * (1 - coalesce(l_discount, 0.0)) AS net,
                       l_extendedprice / l_quantity AS unit_price, CAST(l_linenumber AS DOUBLE) AS line FROM t1)"""

SQL["correlation_top_decile"] = f"""WITH {T1}, {TOP_DECILE_SRC},
c AS ({corr_table('t1x', T1_FEATS + ['gross', 'net', 'unit_price', 'line'])})
SELECT feature, {r('value')} AS value FROM c
WHERE value >= (SELECT quantile_cont(value, 0.9) FROM c WHERE value IS NOT NULL)"""

SQL["iqr_bounds"] = f"""WITH {T1}, lng AS ({long_union('t1', T1_FEATS)}),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY feature)
SELECT feature, {r('q1')} AS q1, {r('q3')} AS q3, {r('q1 - 1.5 * (q3 - q1)')} AS lower,
       {r('q3 + 1.5 * (q3 - q1)')} AS upper FROM q"""

SQL["cohort_sizes"] = f"""WITH {T2}
SELECT count(*) AS entire, count(*) FILTER (WHERE ELIGSTAT = 1) AS linked,
       count(*) FILTER (WHERE ELIGSTAT = 1 AND MORTSTAT = 1) AS dead,
       count(*) FILTER (WHERE ELIGSTAT = 1 AND MORTSTAT = 0) AS alive,
       count(*) FILTER (WHERE o_totalprice >= 20000.0 AND HYPERTEN IS DISTINCT FROM 1) AS main
FROM t2"""

SQL["non_null_counts"] = f"""WITH {T1}
""" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, count({f}) AS non_null, count(*) AS rows FROM t1" for f in T1_FEATS)

# ---------------------------------------------------------------- outliers
SQL["iqr_removal"] = """WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
                                   FROM events)
SELECT event_id, value FROM events, f
WHERE NOT coalesce(value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1), false)"""

SQL["iqr_removal_by_class"] = f"""WITH {T3},
f AS (SELECT label, quantile_cont(n_chars, 0.25) AS a1, quantile_cont(n_chars, 0.75) AS a3,
             quantile_cont(n_words, 0.25) AS b1, quantile_cont(n_words, 0.75) AS b3 FROM t3 GROUP BY label)
SELECT doc_id, n_chars, n_words, label FROM t3 JOIN f USING (label)
WHERE NOT (coalesce(n_chars > a3 + 1.5 * (a3 - a1) OR n_chars < a1 - 1.5 * (a3 - a1), false)
        OR coalesce(n_words > b3 + 1.5 * (b3 - b1) OR n_words < b1 - 1.5 * (b3 - b1), false))"""

# ---------------------------------------------------------------- splits
SQL["split_stratified"] = f"""WITH {T1}, {split_cte('s', 't1', T1_KEY, 'label', 0.2)}
SELECT {T1_KEY}, label, is_test FROM s"""

SQL["split_holdout"] = f"""WITH {T2}, {split_cte('h', 't2', 'o_orderkey', None, 0.1, tag='holdout', flag='is_holdout')}
SELECT o_orderkey, is_holdout FROM h"""

SQL["folds_stratified"] = f"""WITH {T1}
SELECT {T1_KEY}, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY {md5_order(42, 'fold', T1_KEY)}) - 1) % 10 AS INTEGER)
       AS fold FROM t1"""

SQL["split_by_class"] = f"""WITH {T3}
SELECT doc_id, CASE WHEN label = 1 THEN 'pos' ELSE 'rest' END AS part FROM t3"""

SQL["split_majority"] = f"""WITH {T3},
cnt AS (SELECT label, count(*) AS c FROM t3 GROUP BY label),
maj AS (SELECT label FROM cnt ORDER BY c DESC, label ASC LIMIT 1)
SELECT doc_id, label, CAST(label = (SELECT label FROM maj) AS INTEGER) AS is_majority FROM t3"""

# ---------------------------------------------------------------- joins / unions
SQL["align_by_key"] = """SELECT doc_id, n_chars FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""

SQL["union_all_parts"] = f"WITH {T3} SELECT doc_id, label FROM t3"

SQL["union_tagged"] = f"""WITH {T1}
SELECT label, count(*) AS count, 'returned_open' AS pipeline FROM t1 GROUP BY label
UNION ALL
SELECT CAST({T1_FLAGS_SQL} > 1 AS INTEGER) AS label, count(*) AS count, 'flags_gt1' AS pipeline
FROM t1 GROUP BY 1"""

# ---------------------------------------------------------------- evaluation
S_SCORED = f"""{T1},
s AS (SELECT {T1_KEY}, label, l_extendedprice, least(l_quantity / 50, CAST(1.0 AS DOUBLE)) AS s_qty,
             coalesce(l_discount, 0.0) * 10 AS s_disc, coalesce(l_tax, 0.0) * CAST(12.5 AS DOUBLE) AS s_tax FROM t1)"""

_THS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_CFG = ", ".join(f"('{n}', {m * 100 + i}, CAST({th} AS DOUBLE))"
                 for m, n in enumerate(["qty", "disc", "tax"]) for i, th in enumerate(_THS))

GRID = f"""{S_SCORED},
cfg(model, ordinal, threshold) AS (VALUES {_CFG}),
p AS (SELECT s.*, cfg.model, cfg.ordinal, cfg.threshold,
             CAST(CASE cfg.model WHEN 'qty' THEN s_qty WHEN 'disc' THEN s_disc ELSE s_tax END > cfg.threshold
                  AS INTEGER) AS pred
      FROM s CROSS JOIN cfg)"""


def cm_sql(src, group, y="label", p="pred"):
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return (f"SELECT {g}count(*) FILTER (WHERE {y} = 0 AND {p} = 0) AS tn, "
            f"count(*) FILTER (WHERE {y} = 0 AND {p} = 1) AS fp, "
            f"count(*) FILTER (WHERE {y} = 1 AND {p} = 0) AS fn, "
            f"count(*) FILTER (WHERE {y} = 1 AND {p} = 1) AS tp FROM {src}{gb}")


PREC = "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0)"
REC = "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0)"
F1 = "coalesce(2 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0)"
ACC = "coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0.0)"
TNR = "coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0)"
METRICS_SQL = (f"{r(PREC)} AS precision, {r(REC)} AS recall, {r(F1)} AS f1, {r(ACC)} AS accuracy, "
               f"{r(f'({REC} + {TNR}) / 2')} AS auc_roc")
SCORES = f"""{GRID},
cm AS ({cm_sql('p', 'model, ordinal, threshold')}),
sc AS (SELECT model, ordinal, threshold, {PREC} AS precision, {REC} AS recall, {F1} AS f1, {ACC} AS accuracy,
              ({REC} + {TNR}) / 2 AS auc_roc, tn, fp, fn, tp FROM cm)"""

SQL["confusion_matrix"] = f"""WITH {S_SCORED}, p AS (SELECT label, CAST(s_qty > 0.5 AS INTEGER) AS pred FROM s)
{cm_sql('p', '')}"""

SQL["classification_metrics"] = f"""WITH {S_SCORED}, p AS (SELECT label, CAST(s_qty > 0.5 AS INTEGER) AS pred FROM s),
cm AS ({cm_sql('p', '')})
SELECT {METRICS_SQL}, tn, fp, fn, tp FROM cm"""


def cum_sql(score):
    return f"""c AS (SELECT {score} AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
                     count(*) FILTER (WHERE label = 0) AS neg FROM s WHERE {score} IS NOT NULL GROUP BY 1),
cum AS (SELECT threshold, pos, neg, CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp,
               CAST(sum(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp,
               CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N FROM c)"""


SQL["pr_curve"] = f"""WITH {S_SCORED}, {cum_sql('s_qty')}
SELECT {r('threshold')} AS threshold, tp, fp, {r('coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0)')} AS precision,
       {r('coalesce(CAST(tp AS DOUBLE) / nullif(P, 0), 0.0)')} AS recall FROM cum"""

_TPR = "coalesce(CAST(tp AS DOUBLE) / nullif(P, 0), 0.0)"
_FPR = "coalesce(CAST(fp AS DOUBLE) / nullif(N, 0), 0.0)"
_PTPR = "coalesce(CAST(tp - pos AS DOUBLE) / nullif(P, 0), 0.0)"
_PFPR = "coalesce(CAST(fp - neg AS DOUBLE) / nullif(N, 0), 0.0)"
SQL["roc_curve"] = f"""WITH {S_SCORED}, {cum_sql('l_extendedprice')},
pts AS (SELECT threshold, {_TPR} AS tpr, {_FPR} AS fpr, ({_FPR} - {_PFPR}) * ({_TPR} + {_PTPR}) / 2 AS area FROM cum)
SELECT {r('threshold')} AS threshold, {r('tpr')} AS tpr, {r('fpr')} AS fpr, CAST(NULL AS DOUBLE) AS auc FROM pts
UNION ALL
SELECT NULL, NULL, NULL, {r('sum(area)')} FROM pts"""

SQL["evaluate_models"] = f"""WITH {SCORES}
SELECT model, ordinal, {r('threshold')} AS threshold, {r('precision')} AS precision, {r('recall')} AS recall,
       {r('f1')} AS f1, {r('accuracy')} AS accuracy, {r('auc_roc')} AS auc_roc, tn, fp, fn, tp FROM sc"""

SQL["best_per_group"] = f"""WITH {SCORES}
SELECT model, ordinal, {r('threshold')} AS threshold, {r('f1')} AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, ordinal) AS rn FROM sc) WHERE rn = 1"""

SQL["argmax_first"] = f"""WITH {SCORES}
SELECT model, ordinal, {r('f1')} AS f1 FROM sc ORDER BY f1 DESC, ordinal LIMIT 1"""

SQL["closest_to_center"] = f"""WITH {SCORES}
(SELECT ordinal, {r('f1')} AS f1, 'median' AS center FROM sc
 ORDER BY abs(f1 - (SELECT quantile_cont(f1, 0.5) FROM sc)), ordinal LIMIT 1)
UNION ALL
(SELECT ordinal, {r('f1')} AS f1, 'mean' AS center FROM sc
 ORDER BY abs(f1 - (SELECT avg(f1) FROM sc)), ordinal LIMIT 1)"""

SQL["top_k_per_group"] = f"""WITH {SCORES}
SELECT model, ordinal, {r('f1')} AS f1, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC NULLS LAST, ordinal) AS rn FROM sc) WHERE rn <= 3"""

SQL["cv_summary"] = f"""WITH {S_SCORED},
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {md5_order(42, 'fold', T1_KEY)}) - 1) % 10
                     AS INTEGER) AS fold FROM s),
cfg(model, ordinal, threshold) AS (VALUES {_CFG}),
p AS (SELECT f.*, cfg.model, cfg.ordinal,
             CAST(CASE cfg.model WHEN 'qty' THEN s_qty WHEN 'disc' THEN s_disc ELSE s_tax END > cfg.threshold
                  AS INTEGER) AS pred FROM f CROSS JOIN cfg),
cm AS ({cm_sql('p', 'model, ordinal, fold')}),
pf AS (SELECT model, ordinal, fold, {F1} AS f1, {PREC} AS precision FROM cm),
g AS (SELECT model, ordinal, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1, avg(precision) AS mean_precision,
             stddev_pop(precision) AS std_precision FROM pf GROUP BY model, ordinal)
SELECT model, ordinal, {r('mean_f1')} AS mean_f1, {r('std_f1')} AS std_f1, {r('mean_precision')} AS mean_precision,
       {r('std_precision')} AS std_precision, CAST(rank() OVER (ORDER BY round(mean_f1, 10) DESC) AS INTEGER) AS rank_f1 FROM g"""

T2_VOTES_SQL = ("CAST(coalesce(o_totalprice > 150000.0, false) AS INTEGER) + "
                "CAST(coalesce(c_acctbal > 5000.0, false) AS INTEGER) + CAST(coalesce(n_regionkey >= 2, false) AS INTEGER)")

SQL["risk_score"] = f"WITH {T2} SELECT o_orderkey, {T2_VOTES_SQL} AS score FROM t2"

SQL["risk_table"] = f"""WITH {T2}
SELECT {T2_VOTES_SQL} AS score, CAST(sum(CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER)) AS BIGINT) AS risk,
       count(*) AS total FROM t2 GROUP BY 1"""


def best_threshold(name, src, cands):
    vals = ", ".join(f"({i}, CAST({t} AS DOUBLE))" for i, t in enumerate(cands))
    return f"""{name}c(ordinal, threshold) AS (VALUES {vals}),
{name} AS (SELECT threshold FROM (
  SELECT c.ordinal, c.threshold,
         count(*) FILTER (WHERE y = 1 AND coalesce(s > c.threshold, false)) AS tp,
         count(*) FILTER (WHERE y = 0 AND coalesce(s > c.threshold, false)) AS fp,
         count(*) FILTER (WHERE y = 1 AND NOT coalesce(s > c.threshold, false)) AS fn
  FROM {src} CROSS JOIN {name}c c GROUP BY c.ordinal, c.threshold)
  ORDER BY {F1} DESC, ordinal LIMIT 1)"""


SQL["risk_ensemble"] = f"""WITH {T2}, {split_cte('h', 't2', 'o_orderkey', None, 0.1, tag='holdout', flag='is_holdout')},
core AS (SELECT * FROM h WHERE is_holdout = 0),
hold AS (SELECT * FROM h WHERE is_holdout = 1),
l1 AS (SELECT o_totalprice AS s, label AS y FROM core),
l2 AS (SELECT c_acctbal AS s, CAST({CODE_SQL} IN (1, 5) AS INTEGER) AS y FROM core WHERE ELIGSTAT = 1 AND MORTSTAT = 1),
l3 AS (SELECT CAST(n_regionkey AS DOUBLE) AS s, CAST(coalesce(HYPERTEN, 0.0) AS INTEGER) AS y
       FROM core WHERE ELIGSTAT = 1 AND MORTSTAT = 1),
{best_threshold('b1', 'l1', [100000.0, 150000.0, 200000.0, 250000.0, 300000.0])},
{best_threshold('b2', 'l2', [0.0, 2500.0, 5000.0, 7500.0])},
{best_threshold('b3', 'l3', [0.5, 1.5, 2.5, 3.5])},
v AS (SELECT CAST(coalesce(o_totalprice > (SELECT threshold FROM b1), false) AS INTEGER)
             + CAST(coalesce(c_acctbal > (SELECT threshold FROM b2), false) AS INTEGER)
             + CAST(coalesce(CAST(n_regionkey AS DOUBLE) > (SELECT threshold FROM b3), false) AS INTEGER) AS score,
             CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS r1,
             CAST({CODE_SQL} IN (1, 5) AS INTEGER) AS r2 FROM hold)
SELECT 'condition' AS risk_name, score, CAST(sum(r1) AS BIGINT) AS risk, count(*) AS total FROM v GROUP BY score
UNION ALL
SELECT 'cvr_death' AS risk_name, score, CAST(sum(r2) AS BIGINT) AS risk, count(*) AS total FROM v GROUP BY score"""

_STUDY_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "ship_year"]


def _study_part(name, y):
    return f"""SELECT '{name}' AS labeller, feature, {r('value')} AS value,
       coalesce(CAST(value >= (SELECT quantile_cont(value, 0.9) FROM c_{y} WHERE value IS NOT NULL) AS INTEGER), 0)
       AS top FROM c_{y}"""


SQL["study_correlation"] = f"""WITH {T1},
m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS c, avg(l_tax) AS d,
             avg(ship_year) AS e FROM t1),
x AS (SELECT coalesce(l_quantity, a) AS l_quantity, coalesce(l_extendedprice, b) AS l_extendedprice,
             coalesce(l_discount, c) AS l_discount, coalesce(l_tax, d) AS l_tax,
             coalesce(CAST(ship_year AS DOUBLE), e) AS ship_year,
             CAST(coalesce(l_returnflag = 'R', false) AND coalesce(l_linestatus = 'O', false) AS INTEGER) AS y1,
             CAST({T1_FLAGS_SQL} > 1 AS INTEGER) AS y2 FROM t1, m),
c_y1 AS ({corr_table('x', _STUDY_FEATS, 'y1')}),
c_y2 AS ({corr_table('x', _STUDY_FEATS, 'y2')})
{_study_part('returned_open', 'y1')}
UNION ALL
{_study_part('flags_gt1', 'y2')}"""

# ---------------------------------------------------------------- scaling / selection
_SUMSQ = " + ".join(f"coalesce(CAST({f} AS DOUBLE), 0.0) * coalesce(CAST({f} AS DOUBLE), 0.0)" for f in T1_FEATS)

SQL["scale_minmax"] = f"""WITH {T1},
m AS (SELECT {', '.join(f'min({f}) AS lo_{f}, max({f}) AS hi_{f}' for f in T1_FEATS)} FROM t1)
SELECT {T1_KEY}, {', '.join(
    r(f"({f} - lo_{f}) / CASE WHEN hi_{f} - lo_{f} = 0 THEN 1.0 ELSE hi_{f} - lo_{f} END") + f' AS {f}'
    for f in T1_FEATS)} FROM t1, m"""

SQL["scale_standard"] = f"""WITH {T1},
m AS (SELECT {', '.join(f'avg({f}) AS mu_{f}, stddev_pop({f}) AS sd_{f}' for f in T1_FEATS)} FROM t1)
SELECT {T1_KEY}, {', '.join(
    r(f"({f} - mu_{f}) / CASE WHEN sd_{f} = 0 OR sd_{f} IS NULL THEN 1.0 ELSE sd_{f} END") + f' AS {f}'
    for f in T1_FEATS)} FROM t1, m"""

SQL["scale_robust"] = f"""WITH {T1},
m AS (SELECT {', '.join(f'quantile_cont({f}, 0.25) AS a_{f}, quantile_cont({f}, 0.5) AS b_{f}, quantile_cont({f}, 0.75) AS c_{f}' for f in T1_FEATS)} FROM t1)
SELECT {T1_KEY}, {', '.join(
    r(f"({f} - b_{f}) / CASE WHEN c_{f} - a_{f} = 0 THEN 1.0 ELSE c_{f} - a_{f} END") + f' AS {f}'
    for f in T1_FEATS)} FROM t1, m"""

SQL["scale_normalizer"] = f"""WITH {T1}, n AS (SELECT *, sqrt({_SUMSQ}) AS nrm FROM t1)
SELECT {T1_KEY}, {', '.join(
    r(f"CAST({f} AS DOUBLE) / CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END") + f' AS {f}' for f in T1_FEATS)} FROM n"""

_E = [f"e{i:02d}" for i in range(64)]
T4X = f"t4x AS (SELECT vec_id, label, {', '.join(f'vec[{i + 1}] AS {e}' for i, e in enumerate(_E))} FROM t4)"

SQL["select_percentile"] = f"""WITH {T4}, {T4X}, c AS ({corr_table('t4x', _E)}),
cut AS (SELECT quantile_cont(value, 0.9) AS q FROM c WHERE value IS NOT NULL)
SELECT feature, {r('value')} AS value, CAST(coalesce(value > q, false) AS INTEGER) AS selected FROM c, cut"""

# ---------------------------------------------------------------- neighbours


def _nn(name, a, b, key="vec_id", extra_b=""):
    return f"""{name} AS (
  SELECT x.{key} AS {key}, y.{key} AS nn_{key}, list_distance(x.vec, y.vec) AS dist{extra_b},
         row_number() OVER (PARTITION BY x.{key} ORDER BY list_distance(x.vec, y.vec), y.{key}) AS rk
  FROM {a} x JOIN {b} y ON x.{key} <> y.{key})"""


SQL["knn_join"] = f"""WITH {T4}, {_nn('d', 't4', 't4')}
SELECT vec_id, nn_vec_id, {r('dist')} AS dist, CAST(rk AS INTEGER) AS rank FROM d WHERE rk <= 5"""

SQL["clf_knn"] = f"""WITH {T4}, {split_cte('s', 't4', 'vec_id', 'label', 0.2)},
tr AS (SELECT * FROM s WHERE is_test = 0), te AS (SELECT * FROM s WHERE is_test = 1),
d AS (SELECT te.vec_id, tr.label AS nl,
             row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance(te.vec, tr.vec), tr.vec_id) AS rk
      FROM te CROSS JOIN tr),
v AS (SELECT vec_id, nl, count(*) AS c FROM d WHERE rk <= 5 GROUP BY vec_id, nl),
b AS (SELECT vec_id, nl AS pred FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, nl) AS r FROM v) WHERE r = 1)
SELECT te.vec_id, te.label, b.pred FROM te LEFT JOIN b USING (vec_id)"""


def _roles(src):
    return f"""cnt AS (SELECT label, count(*) AS c FROM {src} GROUP BY label),
roles AS (SELECT (SELECT label FROM cnt ORDER BY c DESC, label LIMIT 1) AS maj,
                 (SELECT max(c) FROM cnt) AS nmaj, (SELECT min(c) FROM cnt) AS nmin)"""


SQL["under_random"] = f"""WITH {T3}, {_roles('t3')},
mj AS (SELECT doc_id, label, row_number() OVER (ORDER BY {md5_order(42, 'under', 'doc_id')}) AS rk
       FROM t3 WHERE label = (SELECT maj FROM roles))
SELECT doc_id, label FROM mj WHERE rk <= (SELECT nmin FROM roles)
UNION ALL SELECT doc_id, label FROM t3 WHERE label <> (SELECT maj FROM roles)"""

SQL["clf_knn_resampled"] = f"""WITH {T4}, {split_cte('s', 't4', 'vec_id', 'label', 0.2)},
tr0 AS (SELECT * FROM s WHERE is_test = 0), te AS (SELECT * FROM s WHERE is_test = 1), {_roles('tr0')},
mn AS (SELECT tr0.*, row_number() OVER (ORDER BY {md5_order(42, 'over', 'vec_id')}) AS place
       FROM tr0 WHERE label <> (SELECT maj FROM roles)),
cp AS (SELECT vec_id, label, vec, CAST(nmaj // nmin + CAST(place <= nmaj % nmin AS INTEGER) AS INTEGER) AS n FROM mn, roles),
tr AS (SELECT vec_id, label, vec, unnest(generate_series(1, n)) AS copy FROM cp WHERE n > 0
       UNION ALL SELECT vec_id, label, vec, 1 AS copy FROM tr0 WHERE label = (SELECT maj FROM roles)),
d AS (SELECT te.vec_id, tr.label AS nl,
             row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance(te.vec, tr.vec), tr.vec_id) AS rk
      FROM te CROSS JOIN tr),
v AS (SELECT vec_id, nl, count(*) AS c FROM d WHERE rk <= 5 GROUP BY vec_id, nl),
b AS (SELECT vec_id, nl AS pred FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, nl) AS r FROM v) WHERE r = 1)
SELECT te.vec_id, te.label, b.pred FROM te LEFT JOIN b USING (vec_id)"""

SQL["over_random"] = f"""WITH {T3}, {_roles('t3')},
mn AS (SELECT doc_id, label, row_number() OVER (ORDER BY {md5_order(42, 'over', 'doc_id')}) AS rk
       FROM t3 WHERE label <> (SELECT maj FROM roles)),
cp AS (SELECT mn.*, CAST(nmaj // nmin + CAST(rk <= nmaj % nmin AS INTEGER) AS INTEGER) AS n FROM mn, roles)
SELECT doc_id, label, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy FROM cp WHERE n > 0
UNION ALL SELECT doc_id, label, 1 AS copy FROM t3 WHERE label = (SELECT maj FROM roles)"""


def hu(tag, key="vec_id", extra="copy"):
    return (f"CAST(('0x' || substr(md5(concat_ws(':', '42', '{tag}', {key}, {extra})), 1, 8)) AS BIGINT)"
            f" / 4294967296.0")


SMOTE = f"""{_roles('t4')},
mino AS (SELECT vec_id, label, vec FROM t4 WHERE label <> (SELECT maj FROM roles)),
{_nn('nn', 'mino', 'mino')},
rk AS (SELECT vec_id, label, vec, row_number() OVER (ORDER BY {md5_order(42, 'smote_rank', 'vec_id')}) AS r FROM mino),
cp AS (SELECT rk.*, (nmaj - nmin) // nmin + CAST(r <= (nmaj - nmin) % nmin AS INTEGER) AS n FROM rk, roles),
rws AS (SELECT vec_id, label, vec, unnest(generate_series(1, n)) AS copy FROM cp WHERE n > 0),
h AS (SELECT *, CAST(floor({hu('smote_nn')} * least(5, (SELECT nmin FROM roles) - 1)) + 1 AS INTEGER) AS pick,
             {hu('smote_gap')} AS gap FROM rws),
syn AS (SELECT h.vec_id, CAST(h.copy AS INTEGER) AS copy, h.label, n.nn_vec_id, h.gap, h.vec AS x, y.vec AS nv
        FROM h JOIN nn n ON n.vec_id = h.vec_id AND n.rk = h.pick JOIN mino y ON y.vec_id = n.nn_vec_id)"""

SQL["over_smote"] = f"""WITH {T4}, {SMOTE}
SELECT vec_id, copy, nn_vec_id, {r('gap')} AS gap, CAST(i AS INTEGER) AS dim,
       {r('x[i + 1] + gap * (nv[i + 1] - x[i + 1])')} AS value
FROM syn, range(0, 64) t(i)"""

SMOTE_UNION = f"""{SMOTE},
u AS (SELECT vec_id, 0 AS copy, label, vec FROM t4
      UNION ALL
      SELECT vec_id, copy, label, list_transform(range(1, 65), lambda i: x[i] + gap * (nv[i] - x[i])) AS vec FROM syn),
uk AS (SELECT *, CAST(vec_id AS VARCHAR) || '/' || CAST(copy AS VARCHAR) AS k FROM u)"""


def _nn_u(name, k):
    return f"""{name} AS (
  SELECT x.vec_id, x.copy, x.label, y.label AS nl,
         row_number() OVER (PARTITION BY x.vec_id, x.copy ORDER BY list_distance(x.vec, y.vec), y.vec_id, y.copy) AS rk
  FROM uk x JOIN uk y ON x.k <> y.k)"""


SQL["clean_enn"] = f"""WITH {T4}, {_roles('t4')},
d AS (SELECT x.vec_id, x.label, y.label AS nl,
             row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.vec, y.vec), y.vec_id) AS rk
      FROM t4 x JOIN t4 y ON x.vec_id <> y.vec_id),
bad AS (SELECT vec_id FROM d WHERE rk <= 3 AND label = (SELECT maj FROM roles)
        GROUP BY vec_id HAVING max(CAST(nl <> label AS INTEGER)) = 1)
SELECT vec_id, label FROM t4 WHERE vec_id NOT IN (SELECT vec_id FROM bad)"""

SQL["smote_enn"] = f"""WITH {T4}, {SMOTE_UNION}, {_nn_u('d', 3)},
bad AS (SELECT vec_id, copy FROM d WHERE rk <= 3 GROUP BY vec_id, copy HAVING max(CAST(nl <> label AS INTEGER)) = 1)
SELECT vec_id, CAST(copy AS INTEGER) AS copy, label FROM uk
WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.vec_id = uk.vec_id AND bad.copy = uk.copy)"""

SQL["clean_tomek"] = f"""WITH {T4}, {_roles('t4')}, {_nn('d', 't4', 't4')},
one AS (SELECT vec_id, nn_vec_id FROM d WHERE rk = 1),
links AS (SELECT a.vec_id FROM one a JOIN one b ON a.nn_vec_id = b.vec_id AND b.nn_vec_id = a.vec_id
          JOIN t4 la ON la.vec_id = a.vec_id JOIN t4 lb ON lb.vec_id = b.vec_id
          WHERE la.label <> lb.label AND la.label = (SELECT maj FROM roles))
SELECT vec_id, label FROM t4 WHERE vec_id NOT IN (SELECT vec_id FROM links)"""

SQL["smote_tomek"] = f"""WITH {T4}, {SMOTE_UNION},
d AS (SELECT x.vec_id, x.copy, x.label, y.vec_id AS nv_id, y.copy AS nv_copy, y.label AS nl,
             row_number() OVER (PARTITION BY x.vec_id, x.copy ORDER BY list_distance(x.vec, y.vec), y.vec_id, y.copy) AS rk
      FROM uk x JOIN uk y ON x.k <> y.k),
one AS (SELECT * FROM d WHERE rk = 1),
links AS (SELECT a.vec_id, a.copy FROM one a JOIN one b
          ON a.nv_id = b.vec_id AND a.nv_copy = b.copy AND b.nv_id = a.vec_id AND b.nv_copy = a.copy
          WHERE a.label <> a.nl)
SELECT vec_id, CAST(copy AS INTEGER) AS copy, label FROM uk
WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.vec_id = uk.vec_id AND links.copy = uk.copy)"""

SQL["silhouette"] = f"""WITH {T4},
sz AS (SELECT class, count(*) AS n FROM t4 GROUP BY class),
pd AS (SELECT a.vec_id, a.class AS lc, b.class AS rc, sum(list_distance(a.vec, b.vec)) AS sd
       FROM t4 a JOIN t4 b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.class, b.class),
j AS (SELECT pd.*, sz.n FROM pd JOIN sz ON pd.rc = sz.class),
per AS (SELECT vec_id, max(CASE WHEN lc = rc THEN n END) AS own_n,
               max(CASE WHEN lc = rc AND n > 1 THEN sd / (n - 1) END) AS a,
               min(CASE WHEN lc <> rc THEN sd / n END) AS b FROM j GROUP BY vec_id)
SELECT {r("avg(CASE WHEN own_n <= 1 OR b IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END)")}
       AS silhouette FROM per"""

# ---------------------------------------------------------------- invariants of fitted models


def checks(pairs):
    return "\nUNION ALL ".join(f"SELECT '{k}' AS check, CAST({v} AS BIGINT) AS value" for k, v in pairs)


SQL["under_centroids"] = f"""WITH {T3}
{checks([('minority_rows', '(SELECT count(*) FROM t3 WHERE label = 1)'),
         ('majority_rows', '(SELECT count(*) FROM t3 WHERE label = 1)'), ('cheaper_than_rows', 1)])}"""



def _u(tag, key):
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '42', '{tag}', {key})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


SQL["cluster_sizes"] = f"""WITH {T4},
g AS (SELECT CASE WHEN {_u('group', 'vec_id')} < 0.5 THEN 0 WHEN {_u('group', 'vec_id')} < 0.8 THEN 1 ELSE 2 END AS g FROM t4),
n AS (SELECT g, count(*) AS size FROM g GROUP BY g)
SELECT CAST(row_number() OVER (ORDER BY size DESC) - 1 AS INTEGER) AS cluster, size FROM n"""

SQL["under_cluster_guided"] = f"""WITH {T3}
SELECT doc_id, label FROM t3 WHERE label = 1 OR {_u('group', 'doc_id')} < 0.6"""

SQL["cluster_medoids"] = f"""WITH {T3},
p AS (SELECT doc_id, {_u('group', 'doc_id')} AS u, {_u('a', 'doc_id')} AS ua, {_u('b', 'doc_id')} AS ub FROM t3),
x AS (SELECT doc_id, CASE WHEN u < 0.4 THEN 0 WHEN u < 0.7 THEN 1 ELSE 2 END AS g,
             CASE WHEN u >= 0.4 AND u < 0.7 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END + ua AS a,
             CASE WHEN u >= 0.7 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END + ub AS b FROM p),
s AS (SELECT m.g, m.doc_id AS medoid, count(*) AS size,
             sum(sqrt((m.a - o.a) * (m.a - o.a) + (m.b - o.b) * (m.b - o.b))) AS cost
      FROM x m JOIN x o ON m.g = o.g GROUP BY m.g, m.doc_id)
SELECT medoid, size, round(cost, 6) AS cost FROM s
QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, medoid) = 1"""

_MODEL_CHECKS = f"""WITH {T3}, {split_cte('s', 't3', 'doc_id', 'label', 0.2)}
{checks([('test_rows', '(SELECT count(*) FROM s WHERE is_test = 1)'),
         ('test_pos', '(SELECT count(*) FROM s WHERE is_test = 1 AND label = 1)'),
         ('beats_majority', 1)])}"""

for _k in ("clf_logistic", "clf_forest", "clf_svc", "clf_mlp"):
    SQL[_k] = _MODEL_CHECKS

SQL["fit_predict_chain"] = f"""WITH {T3}, {split_cte('s', 't3', 'doc_id', 'label', 0.2)}
{checks([('test_rows', '(SELECT count(*) FROM s WHERE is_test = 1)'),
         ('test_pos', '(SELECT count(*) FROM s WHERE is_test = 1 AND label = 1)'), ('beats_majority', 1)])}"""

SQL["grid_search"] = f"""WITH {T3}
{checks([('configs', 8), ('fold_rows', 24), ('separating_fits', 24), ('train_apart', 1),
         ('scored_rows', '(SELECT 8 * count(*) FROM t3)')])}"""

SQL["select_l1"] = f"""WITH {T3}
{checks([('rows_seen', '(SELECT count(*) FROM t3)'), ('optimal', 1), ('keeps_separating', 1)])}"""

SQL["refit_top"] = f"""WITH {T3}, {split_cte('s', 't3', 'doc_id', 'label', 0.2)}
{checks([('refits', 4), ('pipelines', 2), ('sampled', 4), ('separating_fits', 8),
         ('train_rows', '(SELECT 4 * count(*) FROM s WHERE is_test = 0)'),
         ('test_rows', '(SELECT 4 * count(*) FROM s WHERE is_test = 1)')])}"""

SQL["train_best"] = f"""WITH {T3}, {split_cte('s', 't3', 'doc_id', 'label', 0.2)}
{checks([('test_rows', '(SELECT count(*) FROM s WHERE is_test = 1)'), ('best_by_test', 1), ('model_is_the_best', 1),
         ('separates', 1)])}"""

_LABELLER_FEATS = ["n_chars", "text_len", "n_words", "n_lines", "toxic"]
SQL["run_labeller"] = f"""WITH {T3}, {split_cte('s', 't3', 'doc_id', 'label', 0.2)}
SELECT 'label ' || CAST(label AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value FROM t3 GROUP BY label
UNION ALL SELECT 'rows train', CAST(count(*) AS DOUBLE) FROM s WHERE is_test = 0
UNION ALL SELECT 'rows test', CAST(count(*) AS DOUBLE) FROM s WHERE is_test = 1
""" + "\n".join(f"""UNION ALL SELECT '{f} {n}', round(CAST({e} AS DOUBLE), 6) FROM t3""" for f in _LABELLER_FEATS
                for n, e in (("count", f"count({f})"), ("min", f"min({f})"), ("p50", f"quantile_cont({f}, 0.5)"),
                             ("max", f"max({f})")))

SQL["risk_ensemble_fitted"] = f"""WITH {T3},
{split_cte('h', 't3', 'doc_id', None, 0.2, tag='holdout', flag='is_holdout')},
hold AS (SELECT * FROM h WHERE is_holdout = 1)
{checks([('quality_total', '(SELECT count(*) FROM hold)'), ('quality_risk', '(SELECT sum(label) FROM hold)'),
         ('toxic_total', '(SELECT count(*) FROM hold)'),
         ('toxic_risk', '(SELECT count(*) FROM hold WHERE toxic > 0)'), ('votes_tell', 1)])}"""
