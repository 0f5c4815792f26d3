"""Evaluation queries (A8-A11, K7) over a deterministic stand-in prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from polarity.operators.evaluate import (OUTCOME_NAMES, confusion2, metrics2, metrics_long,
                                         outcome_counts, score_moments)
from polarity.plans import testbed as tb
from polarity.queries.registry import register, with_ctes

SCORED = ("scored", f"SELECT d.doc_id, {tb.EMOTION_SQL} AS target, {tb.PREDICTION_SQL} AS pred "
                    f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {tb.EMOTION_SQL} IS NOT NULL")


def _scored(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", "n_chars")
    c = tb.corpus(spark, sf).select("doc_id", F.col("emotion").alias("target"))
    return c.join(d, "doc_id").select("doc_id", "target", tb.predictions(d).alias("pred"))


_OUTCOME_SQL = """CASE WHEN pred = target AND target >= 0 THEN 'exact_pos'
 WHEN pred = target AND target < 0 THEN 'exact_neg'
 WHEN pred < 0 AND target >= 0 THEN 'neg_for_pos'
 WHEN pred >= 0 AND target < 0 THEN 'pos_for_neg'
 WHEN target >= 0 AND abs(pred - target) = 1 THEN 'off1_pos'
 WHEN target < 0 AND abs(pred - target) = 1 THEN 'off1_neg'
 WHEN target >= 0 AND abs(pred - target) = 2 THEN 'off2_pos'
 WHEN target < 0 AND abs(pred - target) = 2 THEN 'off2_neg'
 ELSE 'off_more' END"""

OUTCOME5_SQL = ("SELECT " + ", ".join(f"count_if(o = '{n}') AS {n}" for n in OUTCOME_NAMES)
                + ", count(*) AS total, count_if(ok) AS correct, "
                  "round(CASE WHEN count(*) = 0 THEN NULL ELSE count_if(ok) / count(*) END, 6) AS accuracy "
                  f"FROM (SELECT {_OUTCOME_SQL} AS o, pred = target AS ok FROM scored)")


@register("outcome5", with_ctes(SCORED, select=OUTCOME5_SQL))
def q_outcome5(spark, sf):
    return outcome_counts(_scored(spark, sf))


CONF_SQL = ("SELECT count_if(pred > 0 AND target >= 0) AS tp, count_if(pred <= 0 AND target >= 0) AS fn, "
            "count_if(pred < 0 AND target < 0) AS tn, count_if(pred >= 0 AND target < 0) AS fp FROM scored")


@register("confusion2", with_ctes(SCORED, select=CONF_SQL))
def q_confusion2(spark, sf):
    return confusion2(_scored(spark, sf))


def _metrics_sql(legacy: bool) -> str:
    fn, fp = ("fp", "fn") if legacy else ("fn", "fp")

    def div(a, b):
        return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END)"
    pp, pn = div("tp", f"tp + {fp}"), div("tn", f"tn + {fn}")
    rp, rn = div("tp", f"tp + {fn}"), div("tn", f"tn + {fp}")
    return (f"SELECT round(pp, 6) AS precision_pos, round(pn, 6) AS precision_neg, round((pp + pn) / 2, 6) AS precision_avg, "
            f"round(rp, 6) AS recall_pos, round(rn, 6) AS recall_neg, round((rp + rn) / 2, 6) AS recall_avg, "
            f"round({div('2 * pp * rp', 'pp + rp')}, 6) AS f1_pos, round({div('2 * pn * rn', 'pn + rn')}, 6) AS f1_neg, "
            f"round({div('2 * ((pp + pn) / 2) * ((rp + rn) / 2)', '(pp + pn) / 2 + (rp + rn) / 2')}, 6) AS f1_of_avg, "
            f"round(({div('2 * pp * rp', 'pp + rp')} + {div('2 * pn * rn', 'pn + rn')}) / 2, 6) AS f1_avg, "
            f"round({div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy "
            f"FROM (SELECT *, {pp} AS pp, {pn} AS pn, {rp} AS rp, {rn} AS rn FROM "
            f"(SELECT CAST(tp AS DOUBLE) AS tp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp FROM conf))")


@register("metrics2", with_ctes(SCORED, ("conf", CONF_SQL), select=_metrics_sql(False)))
def q_metrics2(spark, sf):
    return metrics2(confusion2(_scored(spark, sf)))


@register("metrics2_legacy", with_ctes(SCORED, ("conf", CONF_SQL), select=_metrics_sql(True)))
def q_metrics2_legacy(spark, sf):
    return metrics2(confusion2(_scored(spark, sf)), legacy=True)


@register("score_moments", with_ctes(SCORED, select=(
    "SELECT count(*) AS n, round(avg((CAST(pred AS DOUBLE) - target) * (CAST(pred AS DOUBLE) - target)), 6) AS mse, "
    "round(pow(corr(CAST(pred AS DOUBLE), CAST(target AS DOUBLE)), 2), 6) AS r2 FROM scored")))
def q_score_moments(spark, sf):
    return score_moments(_scored(spark, sf))


@register("metrics_long", with_ctes(SCORED, ("m", OUTCOME5_SQL), select=" UNION ALL ".join(
    f"SELECT '{n}' AS name, CAST({n} AS DOUBLE) AS value FROM m"
    for n in OUTCOME_NAMES + ["total", "correct", "accuracy"])))
def q_metrics_long(spark, sf):
    return metrics_long(outcome_counts(_scored(spark, sf)))
