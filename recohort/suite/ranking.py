"""Global ranking, order statistics and evaluation metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from recohort.functions.times import within
from recohort.operators import cohort as co, evaluation as ev, quality, ranking as rk
from recohort.suite import tables as t
from recohort.suite.registry import query, rounded

C = t.ORDER_CAMPAIGN


def _scores(spark, d):
    """Toxic labels against text length, a probability-like score with ties."""
    docs = t.table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    labels = t.table(spark, d, "labels").select("doc_id", "toxic")
    score = F.least(F.lit(1.0), F.floor(F.col("n_chars") / 50).cast("double") / F.lit(400.0))
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("account"), F.col("toxic").alias("label"),
                                              score.alias("score"), F.col("lang").alias("subgroup"))


_SCORES_SQL = """scores AS (SELECT l.doc_id AS account, l.toxic AS label,
  least(1.0::DOUBLE, floor(d.n_chars / 50.0::DOUBLE)::DOUBLE / 400.0::DOUBLE) AS score, d.lang AS subgroup
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _order_scores(spark, d):
    """Order status against price, grouped by priority; scores hardly tie."""
    return t.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("account"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") / F.lit(599999.0)).alias("score"), F.col("o_orderpriority").alias("subgroup"))


_ORDER_SCORES_SQL = """scores AS (SELECT o_orderkey AS account, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  o_totalprice / 599999.0::DOUBLE AS score, o_orderpriority AS subgroup FROM orders)"""


def _steps_sql(group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    lead = f"{group}, " if group else ""
    return f"""steps AS (SELECT {lead}score, count(*) AS n, sum(label) AS hits FROM scores GROUP BY {lead}score),
cum AS (SELECT *, sum(n) OVER ({part}ORDER BY score DESC) AS n_upto, sum(hits) OVER ({part}ORDER BY score DESC) AS hits_upto,
        sum(n) OVER ({part[:-1]}) AS total, sum(hits) OVER ({part[:-1]}) AS positives FROM steps)"""


@query("average_precision", f"""WITH {_ORDER_SCORES_SQL}, {_steps_sql('subgroup')}
SELECT subgroup, round(sum(hits::DOUBLE * hits_upto / n_upto) / nullif(max(positives), 0)::DOUBLE, 9) AS average_precision FROM cum GROUP BY 1""")
def _ap(spark, d):
    return rounded(ev.average_precision(_order_scores(spark, d), ("subgroup",)), "average_precision")


_AUC = """round(1 - sum(hits::DOUBLE * ((n_upto - n) - (hits_upto - hits) + (n - hits) / 2.0::DOUBLE))
  / nullif(max(positives)::DOUBLE * (max(total) - max(positives)), 0), 9)"""


@query("roc_auc", f"""WITH {_ORDER_SCORES_SQL}, {_steps_sql('subgroup')}
SELECT subgroup, {_AUC} AS roc_auc FROM cum GROUP BY 1""")
def _auc(spark, d):
    return rounded(ev.roc_auc(_order_scores(spark, d), ("subgroup",)), "roc_auc")


@query("pr_curve_points", f"""WITH {_ORDER_SCORES_SQL}, {_steps_sql()},
points AS (SELECT row_number() OVER (ORDER BY score) - 1 AS point, hits_upto::DOUBLE / n_upto AS precision,
                  hits_upto::DOUBLE / positives AS recall, score AS threshold, count(*) OVER () AS d FROM cum
           UNION ALL SELECT count(*), 1.0, 0.0, NULL, count(*) FROM steps),
picks AS (SELECT DISTINCT CASE WHEN i = k - 1 THEN d ELSE CAST(floor(i * (d::DOUBLE / (k - 1))) AS BIGINT) END AS point
          FROM (SELECT d, least(d + 1, 500) AS k FROM (SELECT count(*) AS d FROM steps)) , range(500) r(i) WHERE i < k)
SELECT CAST(p.point AS BIGINT) AS point, round(precision, 9) AS precision, round(recall, 9) AS recall, threshold,
       d + 1 > 500 AS sampled, CAST(d + 1 AS BIGINT) AS full_point_count FROM points p JOIN picks USING (point)""")
def _curve(spark, d):
    return rounded(ev.pr_curve_points(_order_scores(spark, d)), "precision", "recall")


@query("pr_curve", f"""WITH {_ORDER_SCORES_SQL}, {_steps_sql()},
points AS (SELECT row_number() OVER (ORDER BY score) - 1 AS point, hits_upto::DOUBLE / n_upto AS precision,
                  hits_upto::DOUBLE / positives AS recall, score AS threshold FROM cum
           UNION ALL SELECT count(*), 1.0, 0.0, NULL FROM steps)
SELECT CAST(point AS BIGINT) AS point, round(precision, 9) AS precision, round(recall, 9) AS recall, threshold,
       CAST(count(*) OVER () AS BIGINT) AS full_point_count FROM points""")
def _whole_curve(spark, d):
    return rounded(ev.pr_curve(_order_scores(spark, d)), "precision", "recall")


@query("top_decile_metrics", f"""WITH {_SCORES_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, account) AS pos, count(*) OVER () AS n, sum(label) OVER () AS p FROM scores),
s AS (SELECT CAST(ceil(max(n) * 0.1::DOUBLE) AS BIGINT) AS k, max(n) AS n, max(p) AS p,
             sum(CASE WHEN pos <= ceil(n * 0.1::DOUBLE) THEN label ELSE 0 END) AS h FROM r)
SELECT k AS top10_count, round(h::DOUBLE / k, 9) AS top10_precision, round(h::DOUBLE / nullif(p, 0), 9) AS top10_recall,
       round((h::DOUBLE / k) / (nullif(p, 0)::DOUBLE / n), 9) AS top10_lift FROM s""")
def _decile(spark, d):
    return rounded(ev.top_decile_metrics(_scores(spark, d)), "top10_precision", "top10_recall", "top10_lift")


_LOSS = """avg(-ln(CASE WHEN label = 1 THEN greatest(2.220446049250313e-16::DOUBLE, least(1 - 2.220446049250313e-16::DOUBLE, score))
  ELSE 1 - greatest(2.220446049250313e-16::DOUBLE, least(1 - 2.220446049250313e-16::DOUBLE, score)) END))"""


@query("brier_logloss", f"""WITH {_SCORES_SQL}
SELECT round(avg((score - label) * (score - label)), 9) AS brier, round({_LOSS}, 9) AS log_loss FROM scores""")
def _loss(spark, d):
    return rounded(ev.brier_logloss(_scores(spark, d)), "brier", "log_loss")


@query("reliability_bins", f"""WITH {_ORDER_SCORES_SQL},
e AS (SELECT unnest(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM scores),
b AS (SELECT s.score, s.label, (SELECT count(DISTINCT edge) FROM e WHERE edge <= s.score) AS bin FROM scores s)
SELECT bin, round(avg(score), 9) AS mean_probability, round(avg(label), 9) AS observed_rate, count(*) AS "count" FROM b GROUP BY 1""")
def _bins(spark, d):
    return rounded(ev.reliability_bins(_order_scores(spark, d)), "mean_probability", "observed_rate")


def _metrics_sql(scores: str, group: str = "") -> str:
    lead = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    on = f"USING ({group})" if group else "ON TRUE"
    return f"""WITH {scores}, {_steps_sql(group)},
a AS (SELECT {lead}round(sum(hits::DOUBLE * hits_upto / n_upto) / nullif(max(positives), 0)::DOUBLE, 9) AS average_precision,
      {_AUC} AS roc_auc, CAST(max(total) AS BIGINT) AS n, CAST(max(positives) AS BIGINT) AS positives,
      round(max(positives)::DOUBLE / max(total), 9) AS prevalence FROM cum {('GROUP BY ' + group) if group else ''}),
r AS (SELECT *, row_number() OVER ({part}ORDER BY score DESC, account) AS pos, count(*) OVER ({part}) AS n, sum(label) OVER ({part}) AS p FROM scores),
s AS (SELECT {lead}CAST(ceil(max(n) * 0.1::DOUBLE) AS BIGINT) AS k, max(n) AS n, max(p) AS p,
             sum(CASE WHEN pos <= ceil(n * 0.1::DOUBLE) THEN label ELSE 0 END) AS h FROM r {('GROUP BY ' + group) if group else ''}),
l AS (SELECT {lead}round(avg((score - label) * (score - label)), 9) AS brier, round({_LOSS}, 9) AS log_loss FROM scores {('GROUP BY ' + group) if group else ''})
SELECT {lead}a.n, a.positives, a.prevalence, a.average_precision, a.roc_auc, k AS top10_count,
       round(h::DOUBLE / k, 9) AS top10_precision, round(h::DOUBLE / nullif(p, 0), 9) AS top10_recall,
       round((h::DOUBLE / k) / (nullif(p, 0)::DOUBLE / s.n), 9) AS top10_lift, brier, log_loss
FROM a JOIN s {on} JOIN l {on}"""


_RATIOS = ("prevalence", "average_precision", "roc_auc", "top10_precision", "top10_recall", "top10_lift", "brier", "log_loss")


@query("evaluate_scores", _metrics_sql(_SCORES_SQL))
def _evaluate(spark, d):
    return rounded(ev.evaluate_scores(_scores(spark, d).drop("subgroup")), *_RATIOS)


@query("subgroup_metrics", _metrics_sql(_ORDER_SCORES_SQL, "subgroup"))
def _subgroups(spark, d):
    scores = _order_scores(spark, d).withColumnRenamed("subgroup", "priority")
    return rounded(ev.subgroup_metrics(scores, F.col("priority")), *_RATIOS)


@query("select_model", f"""WITH {_ORDER_SCORES_SQL}, {_steps_sql('subgroup')},
a AS (SELECT subgroup, sum(hits::DOUBLE * hits_upto / n_upto) / nullif(max(positives), 0)::DOUBLE AS ap FROM cum WHERE subgroup <> '5-LOW' GROUP BY 1)
SELECT subgroup AS selected_model, round(ap, 9) AS average_precision FROM a ORDER BY ap DESC LIMIT 1""")
def _select(spark, d):
    scores = _order_scores(spark, d).withColumnRenamed("subgroup", "model")
    learned = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    return rounded(ev.select_model(ev.average_precision(scores, ("model",)), learned), "average_precision")


@query("exclude_top_percent", t.ORDER_CASE_SQL + """,
r AS (SELECT *, row_number() OVER (ORDER BY campaign_volume_usd DESC, account) > ceil(count(*) OVER () * 0.01::DOUBLE) AS kept FROM profile)
SELECT 'all' AS label, count(*) AS size, count(CASE WHEN r30 THEN 1 END) AS r30_n, round(count(CASE WHEN r30 THEN 1 END)::DOUBLE / nullif(count(*), 0), 9) AS r30_rate FROM r
UNION ALL SELECT 'excluding_top', count(*), count(CASE WHEN r30 THEN 1 END), round(count(CASE WHEN r30 THEN 1 END)::DOUBLE / nullif(count(*), 0), 9) FROM r WHERE kept""")
def _exclude(spark, d):
    return rounded(rk.exclude_top_percent(co.retention_profile(t.order_trades(spark, d), C)), "r30_rate")


@query("floor_percentiles", f"""WITH {t.order_trades_sql()},
r AS (SELECT size, row_number() OVER (ORDER BY size) AS pos, count(*) OVER () AS n FROM trades WHERE action = 'increase' AND size > 0)
SELECT q AS quantile, CAST(max(size) AS DOUBLE) AS "value" FROM r, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(q)
WHERE pos = floor((n - 1) * q) + 1 GROUP BY 1""")
def _percentiles(spark, d):
    sizes = t.order_trades(spark, d).filter("action = 'increase' AND size_delta_usd > 0")
    return rk.floor_percentiles(sizes, "size_delta_usd", [0.1, 0.5, 0.9])


@query("top_accounts", """SELECT l_suppkey AS account, count(*) AS events FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _top(spark, d):
    return rk.top_accounts(t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("account")))


@query("top_share", f"""WITH c AS (SELECT o_custkey AS account, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC, account) <= ceil(count(*) OVER () * 0.01::DOUBLE) AS top FROM c)
SELECT count(*) AS accounts, count(CASE WHEN top THEN 1 END) AS top_accounts, CAST(sum(CASE WHEN top THEN n ELSE 0 END) AS BIGINT) AS top_events,
       CAST(sum(n) AS BIGINT) AS events, round(sum(CASE WHEN top THEN n ELSE 0 END)::DOUBLE / sum(n), 9) AS share FROM r""")
def _share(spark, d):
    return rounded(rk.top_share(t.order_trades(spark, d)), "share")


@query("ordered_export", f"""WITH {t.EVENT_TRADES_SQL}, {t.FLAGS_SQL}
SELECT account, CAST(ts AS DATE) AS day, count(CASE WHEN opened THEN 1 END) AS increases FROM flagged GROUP BY 1, 2 ORDER BY 2, 1""")
def _export(spark, d):
    return rk.ordered_export(co.wallet_daily(t.event_trades(spark, d)).select("account", "day", "increases"), "day", "account")


@query("limit_probe", """SELECT event_id, ts, user_id, event_type, value FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' ORDER BY ts, event_id LIMIT 5""")
def _probe(spark, d):
    rows = t.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rk.limit_probe(rows, within(F.col("ts"), datetime(2024, 1, 10), datetime(2024, 1, 11)), ["ts", "event_id"])


_MARCH = (datetime(1997, 3, 3), datetime(1997, 3, 10))


@query("partition_profile", f"""WITH {t.order_trades_sql()},
c AS (SELECT account, count(*) AS n FROM trades WHERE {t.inside_sql('ts', *_MARCH)} GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS unique_accounts, count(CASE WHEN n = 1 THEN 1 END) AS single_event_accounts,
       count(CASE WHEN n = 2 THEN 1 END) AS two_event_accounts FROM c""")
def _profile(spark, d):
    return quality.partition_profile(t.order_trades(spark, d).filter(within(F.col("timestamp"), *_MARCH)))


_KINDS = ["view", "signup", "click", "error", "purchase"]


@query("day_type_matrix", "SELECT CAST(ts AS DATE) AS day, " + ", ".join(
    f"count(CASE WHEN event_type = '{k}' THEN 1 END) AS type_{k}" for k in _KINDS) + " FROM events GROUP BY 1")
def _matrix(spark, d):
    return quality.day_type_matrix(t.table(spark, d, "events").withColumnRenamed("ts", "timestamp"), "event_type", _KINDS)
