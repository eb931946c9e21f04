"""The same questions in plain SQL, written table by table over the star schema.

The SQL takes the direct route (flat joins, global windows); it shares nothing
with the Spark plans but the definitions.
"""

from __future__ import annotations

from checks.scorecards import CALIBRATED, OPERATIONAL
from tidemark.operators.features import NUMERIC_FEATURES
from tidemark.operators.scorecard import Scorecard

SNAP = "TIMESTAMP '1999-12-31 23:59:59'"
TEND = "TIMESTAMP '2000-06-28 23:59:59'"
STATES = ("NATION_2", "NATION_3", "NATION_7", "NATION_11", "NATION_19")
STATE_LIST = ", ".join(f"'{s}'" for s in STATES)


def r(expr: str, digits: int = 9) -> str:
    scale = f"1e{digits}"
    return f"round_even(({expr}) * {scale}, 0) / {scale}"


# ---- the five input tables -------------------------------------------------

INPUTS = f"""
c_orders AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id,
         CASE o.o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
              WHEN 'P' THEN 'processing' END AS order_status,
         o.o_orderdate AS order_purchase_timestamp,
         d.arrived AS order_delivered_customer_date,
         o.o_orderdate + INTERVAL 90 DAY AS order_estimated_delivery_date
  FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS arrived
                           FROM lineitem GROUP BY l_orderkey) d ON d.l_orderkey = o.o_orderkey),
c_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_unique_id, n_name AS customer_state,
         c_mktsegment AS customer_city
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
c_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         CAST(l_extendedprice AS DECIMAL(28,10)) AS price,
         CAST(l_extendedprice * l_tax AS DECIMAL(28,10)) AS freight_value
  FROM lineitem),
c_payments AS (
  SELECT l_orderkey AS order_id,
         CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'R' THEN 'boleto'
              WHEN 'N' THEN 'voucher' END AS payment_type,
         l_linenumber AS payment_installments,
         CAST(l_extendedprice AS DECIMAL(28,10)) AS payment_value
  FROM lineitem),
c_reviews AS (
  SELECT l_orderkey AS order_id, CAST(floor((l_quantity - 1) / 10) + 1 AS INTEGER) AS review_score,
         l_shipdate AS review_creation_date
  FROM lineitem WHERE l_linenumber = 1)"""

ORDERS = f"""
vo AS (
  SELECT o.*, c.customer_unique_id, c.customer_state, c.customer_city,
         o.order_id IN (SELECT order_id FROM c_items) AS has_items,
         coalesce(o.order_status = 'delivered', false)
           AND o.order_id IN (SELECT order_id FROM c_items) AS is_valid_delivered
  FROM c_orders o LEFT JOIN c_customers c ON c.customer_id = o.customer_id),
hist AS (SELECT * FROM vo WHERE is_valid_delivered AND order_purchase_timestamp <= {SNAP})"""

COHORT = f"""
cohort AS (
  SELECT h.customer_unique_id, CAST(coalesce(t.n, 0) AS BIGINT) AS target_orders_count,
         CAST(coalesce(t.n, 0) = 0 AS INTEGER) AS churn
  FROM (SELECT DISTINCT customer_unique_id FROM hist) h
  LEFT JOIN (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM vo
             WHERE is_valid_delivered AND order_purchase_timestamp > {SNAP}
               AND order_purchase_timestamp <= {TEND}
             GROUP BY customer_unique_id) t USING (customer_unique_id))"""


def age(column: str) -> str:
    return f"date_diff('microsecond', {column}, {SNAP}) / 1000000.0::DOUBLE / 86400.0::DOUBLE"


BLOCKS = f"""
rfm AS (
  SELECT customer_unique_id, min(order_purchase_timestamp) AS first_purchase,
         max(order_purchase_timestamp) AS last_purchase,
         count(DISTINCT order_id) AS frequency_orders,
         arg_min(customer_state, (order_purchase_timestamp, customer_id))
           FILTER (WHERE customer_state IS NOT NULL) AS customer_state,
         arg_min(customer_city, (order_purchase_timestamp, customer_id))
           FILTER (WHERE customer_city IS NOT NULL) AS customer_city
  FROM hist GROUP BY customer_unique_id),
rfm2 AS (
  SELECT *, {age('last_purchase')} AS recency_days, {age('first_purchase')} AS tenure_days,
         CAST(frequency_orders > 1 AS INTEGER) AS is_repeat_buyer_hist FROM rfm),
items_agg AS (
  SELECT h.customer_unique_id, count(i.order_item_id) AS frequency_items,
         CAST(sum(i.price) AS DOUBLE) AS total_spend,
         CAST(sum(i.freight_value) AS DOUBLE) AS total_freight,
         count(DISTINCT i.product_id) AS distinct_categories
  FROM c_items i JOIN hist h USING (order_id) GROUP BY h.customer_unique_id),
reviews_agg AS (
  SELECT h.customer_unique_id,
         CAST(sum(v.review_score) AS DOUBLE) / count(v.review_score) AS avg_review_score,
         max(CAST(coalesce(v.review_score <= 2, false) AS INTEGER)) AS has_low_review,
         count(v.review_score) AS review_count
  FROM c_reviews v JOIN hist h USING (order_id)
  WHERE v.review_creation_date <= {SNAP} GROUP BY h.customer_unique_id),
logistics AS (
  SELECT customer_unique_id,
         sum(date_diff('microsecond', order_estimated_delivery_date,
             order_delivered_customer_date))::DOUBLE
           / count(order_estimated_delivery_date) / 1000000.0::DOUBLE / 86400.0::DOUBLE AS delay,
         sum(CAST(order_delivered_customer_date > order_estimated_delivery_date AS INTEGER))::DOUBLE
           / count(*) AS late_rate,
         count(order_id) AS delivered_count
  FROM hist WHERE order_delivered_customer_date <= {SNAP} GROUP BY customer_unique_id),
logistics2 AS (
  SELECT r.customer_unique_id, coalesce(l.delay, 0.0::DOUBLE) AS avg_delivery_delay_days,
         coalesce(l.late_rate, 0.0::DOUBLE) AS late_delivery_rate,
         coalesce(l.delivered_count, 0) AS delivered_count,
         CAST(r.customer_unique_id IN (SELECT customer_unique_id FROM hist
              WHERE order_delivered_customer_date IS NULL
                 OR order_delivered_customer_date > {SNAP}) AS INTEGER)
           AS pending_delivery_at_snapshot,
         CAST(l.delivered_count IS NOT NULL AS INTEGER) AS has_delivery_history
  FROM rfm r LEFT JOIN logistics l USING (customer_unique_id)),
payments_agg AS (
  SELECT h.customer_unique_id,
         sum(p.payment_installments)::DOUBLE / count(p.payment_installments)
           AS avg_payment_installments,
         CAST(sum(p.payment_value) AS DOUBLE) AS total_payment_val,
         CAST(sum(CASE WHEN p.payment_type = 'credit_card' THEN p.payment_value ELSE 0 END)
           AS DOUBLE) AS cc_payment_val,
         CAST(sum(CASE WHEN p.payment_type = 'boleto' THEN p.payment_value ELSE 0 END)
           AS DOUBLE) AS boleto_payment_val
  FROM c_payments p JOIN hist h USING (order_id) GROUP BY h.customer_unique_id),
payments2 AS (
  SELECT *, cc_payment_val / (total_payment_val + 1e-6) AS credit_card_share,
         boleto_payment_val / (total_payment_val + 1e-6) AS boleto_share FROM payments_agg),
review_ranked AS (
  SELECT avg_review_score, row_number() OVER (ORDER BY avg_review_score) AS rn, count(*) OVER () AS n
  FROM reviews_agg WHERE avg_review_score IS NOT NULL),
review_median AS (
  SELECT coalesce((min(avg_review_score) + max(avg_review_score)) / 2, 4.0::DOUBLE) AS m
  FROM review_ranked WHERE rn IN ((n + 1) // 2, n // 2 + 1)),
features AS (
  SELECT r.customer_unique_id, r.first_purchase, r.last_purchase, r.frequency_orders,
         CASE WHEN r.customer_state IN ({STATE_LIST}) THEN r.customer_state ELSE 'Other' END
           AS customer_state,
         r.customer_city, r.recency_days, r.tenure_days, r.is_repeat_buyer_hist,
         i.frequency_items, i.total_spend, i.total_freight, i.distinct_categories,
         i.total_spend / r.frequency_orders AS avg_order_value,
         i.total_spend / nullif(i.frequency_items, 0) AS avg_item_price,
         i.total_freight / (i.total_spend + i.total_freight + 1e-6) AS freight_ratio,
         coalesce(v.avg_review_score, (SELECT m FROM review_median)) AS avg_review_score,
         coalesce(v.has_low_review, 0) AS has_low_review,
         coalesce(v.review_count, 0) AS review_count,
         CAST(v.review_count IS NOT NULL AS INTEGER) AS has_review_at_snapshot,
         l.avg_delivery_delay_days, l.late_delivery_rate, l.delivered_count,
         l.pending_delivery_at_snapshot, l.has_delivery_history,
         coalesce(p.avg_payment_installments, 1.0::DOUBLE) AS avg_payment_installments,
         coalesce(p.credit_card_share, 0.0::DOUBLE) AS credit_card_share,
         coalesce(p.boleto_share, 0.0::DOUBLE) AS boleto_share
  FROM rfm2 r LEFT JOIN items_agg i USING (customer_unique_id)
  LEFT JOIN reviews_agg v USING (customer_unique_id)
  LEFT JOIN logistics2 l USING (customer_unique_id)
  LEFT JOIN payments2 p USING (customer_unique_id)),
dataset AS (SELECT c.target_orders_count, c.churn, f.*
            FROM cohort c JOIN features f USING (customer_unique_id))"""

SPLIT = """
quota AS (
  SELECT churn, n, total - CAST(ceil(total * 0.20::DOUBLE) AS BIGINT) AS train_total,
         n * (total - CAST(ceil(total * 0.20::DOUBLE) AS BIGINT)) / total AS exact
  FROM (SELECT churn, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total
        FROM cohort GROUP BY churn)),
quota2 AS (
  SELECT churn, n, CAST(floor(exact) AS BIGINT) + CAST(
           row_number() OVER (ORDER BY exact - floor(exact) DESC, churn)
             <= train_total - sum(floor(exact)) OVER () AS BIGINT) AS n_train
  FROM quota),
split AS (
  SELECT k.customer_unique_id, k.churn,
         row_number() OVER (PARTITION BY k.churn
           ORDER BY md5(k.customer_unique_id || '42'), k.customer_unique_id) <= q.n - q.n_train
           AS is_test
  FROM cohort k JOIN quota2 q USING (churn)),
train AS (SELECT d.* FROM dataset d JOIN split s USING (customer_unique_id) WHERE NOT s.is_test)"""


def score_sql(card: Scorecard) -> str:
    total = f"{card.intercept!r}::DOUBLE"
    for t in card.terms:
        x = f"(({t.feature}::DOUBLE - {t.center!r}::DOUBLE) / {t.scale!r}::DOUBLE)"
        total = f"({total} + {x} * {t.coefficient!r}::DOUBLE)"
    cases = " ".join(f"WHEN '{s}' THEN {v!r}::DOUBLE" for s, v in card.state_effects)
    total = f"({total} + CASE customer_state {cases} ELSE 0.0::DOUBLE END)"
    return r(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-{total}))", 6)


SCORED = f"""
scored AS (SELECT *, {score_sql(OPERATIONAL)} AS operational_score,
                  {score_sql(CALIBRATED)} AS calibrated_prob FROM dataset),
test AS (SELECT s.customer_unique_id, s.churn, s.operational_score, s.calibrated_prob
         FROM scored s JOIN split p USING (customer_unique_id) WHERE p.is_test),
tiered AS (
  SELECT *, CASE WHEN operational_risk_score > 0.70::DOUBLE THEN 'High Risk'
                 WHEN operational_risk_score >= 0.30::DOUBLE THEN 'Medium Risk'
                 ELSE 'Low Risk' END AS business_risk_tier
  FROM (SELECT *, {r('operational_score', 4)} AS operational_risk_score,
               {r('calibrated_prob', 4)} AS calibrated_churn_prob FROM scored)),
published AS (
  SELECT *, {r('''(rank() OVER (ORDER BY operational_risk_score)
                  + (count(*) OVER (PARTITION BY operational_risk_score) - 1) / 2.0::DOUBLE)
                  / count(*) OVER () * 100.0::DOUBLE''', 1)} AS risk_percentile,
         churn AS actual_churn
  FROM tiered)"""


def as_of(text: str) -> str:
    """The same definitions over the orders and reviews that the snapshot knows."""
    return text.replace("c_orders", "cut_orders").replace("c_reviews", "cut_reviews")


CUT = f"""
cut_orders AS (
  SELECT * REPLACE (CASE WHEN order_delivered_customer_date <= {SNAP}
                    THEN order_delivered_customer_date END AS order_delivered_customer_date)
  FROM c_orders WHERE order_purchase_timestamp <= {SNAP}),
cut_reviews AS (SELECT * FROM c_reviews WHERE review_creation_date <= {SNAP}),
cut_features AS (WITH {as_of(ORDERS)}, {as_of(COHORT)}, {as_of(BLOCKS)} SELECT * FROM features),
versus AS (
  SELECT f.frequency_orders AS orders, coalesce(c.frequency_orders, 0) AS orders_then,
         f.review_count AS reviews, coalesce(c.review_count, 0) AS reviews_then
  FROM features f LEFT JOIN cut_features c USING (customer_unique_id)),
unlike AS (
  SELECT customer_unique_id FROM (SELECT * FROM features EXCEPT SELECT * FROM cut_features)
  UNION SELECT customer_unique_id FROM (SELECT * FROM cut_features EXCEPT SELECT * FROM features))"""


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",".join((INPUTS, ORDERS, *ctes)) + "\n" + select


def on_features(select: str) -> str:
    return sql(select, COHORT, BLOCKS)


def on_scores(select: str, *more: str) -> str:
    return sql(select, COHORT, BLOCKS, SPLIT, SCORED, *more)


# ---- evaluation ------------------------------------------------------------

MATRIX = """
matrix AS (
  SELECT count(*) FILTER (WHERE churn = 0 AND operational_score < 0.5::DOUBLE) AS tn,
         count(*) FILTER (WHERE churn = 0 AND operational_score >= 0.5::DOUBLE) AS fp,
         count(*) FILTER (WHERE churn = 1 AND operational_score < 0.5::DOUBLE) AS fn,
         count(*) FILTER (WHERE churn = 1 AND operational_score >= 0.5::DOUBLE) AS tp FROM test)"""

REPORT = """
per_class AS (
  SELECT 'Active (0)' AS class, coalesce(tn / nullif(tn + fn, 0), 0.0::DOUBLE) AS precision,
         coalesce(tn / nullif(tn + fp, 0), 0.0::DOUBLE) AS recall, (tn + fp)::DOUBLE AS support
  FROM matrix
  UNION ALL
  SELECT 'Churn (1)', coalesce(tp / nullif(tp + fp, 0), 0.0::DOUBLE),
         coalesce(tp / nullif(tp + fn, 0), 0.0::DOUBLE), (tp + fn)::DOUBLE FROM matrix),
scores_per_class AS (
  SELECT class, precision, recall,
         coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0::DOUBLE) AS f1_score,
         support FROM per_class),
report AS (
  SELECT * FROM scores_per_class
  UNION ALL SELECT 'accuracy', a, a, a, a
            FROM (SELECT (tn + tp) / nullif(tn + fp + fn + tp, 0) AS a FROM matrix)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)
            FROM scores_per_class
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                   sum(recall * support) / sum(support), sum(f1_score * support) / sum(support),
                   sum(support) FROM scores_per_class)"""

AUC = """
auc AS (
  SELECT score_name, (sum(CASE WHEN churn = 1 THEN avg_rank END)
                      - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS roc_auc
  FROM (SELECT score_name, churn,
               rank() OVER (PARTITION BY score_name ORDER BY score)
                 + (count(*) OVER (PARTITION BY score_name, score) - 1) / 2.0::DOUBLE AS avg_rank,
               sum(churn) OVER (PARTITION BY score_name)::DOUBLE AS n1,
               sum(1 - churn) OVER (PARTITION BY score_name)::DOUBLE AS n0
        FROM (SELECT 'operational_score' AS score_name, churn, operational_score AS score FROM test
              UNION ALL SELECT 'calibrated_prob', churn, calibrated_prob FROM test))
  GROUP BY score_name, n1, n0)"""

PR_GROUPS = """
both_views AS (
  SELECT 'churn' AS class, operational_score AS score, churn AS y FROM test
  UNION ALL SELECT 'churn_calibrated', calibrated_prob, churn FROM test
  UNION ALL SELECT 'active', 1.0::DOUBLE - operational_score, 1 - churn FROM test),
pr_groups AS (
  SELECT class, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM both_views GROUP BY class, score),
pr_running AS (
  SELECT class, score, pos, neg, sum(pos) OVER up AS tp, sum(neg) OVER up AS fp,
         sum(pos) OVER (PARTITION BY class) AS p, sum(neg) OVER (PARTITION BY class) AS n,
         row_number() OVER (PARTITION BY class ORDER BY score) - 1 AS asc_no,
         count(*) OVER (PARTITION BY class) AS points
  FROM pr_groups WINDOW up AS (PARTITION BY class ORDER BY score DESC)),
ap AS (
  SELECT class, sum(pos / p * (tp / (tp + fp))) AS average_precision,
         max(p) / (max(p) + max(n)) AS prevalence FROM pr_running GROUP BY class),
pr_points AS (
  SELECT class, asc_no AS point_no, tp / p AS recall, tp / (tp + fp) AS precision FROM pr_running
  UNION ALL SELECT class, max(points), 0.0::DOUBLE, 1.0::DOUBLE FROM pr_running GROUP BY class)"""

ROC = """
roc_steps AS (
  SELECT score, pos, neg, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n,
         row_number() OVER down AS k, lead(pos) OVER down AS next_pos, lead(neg) OVER down AS next_neg
  FROM pr_groups WHERE class = 'churn' WINDOW down AS (ORDER BY score DESC)),
roc_points AS (
  SELECT row_number() OVER (ORDER BY k) AS point_no, fp / n AS fpr, tp / p AS tpr FROM roc_steps
  WHERE k = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
  UNION ALL SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE)"""

CURVES = """
all_points AS (
  SELECT 'roc' AS curve, point_no, fpr AS x, tpr AS y FROM roc_points
  UNION ALL SELECT 'pr_' || class, point_no, recall, precision FROM pr_points
            WHERE class IN ('churn', 'active')),
sized AS (SELECT *, count(*) OVER (PARTITION BY curve) AS len FROM all_points),
kept AS (
  SELECT curve, point_no, x, y FROM sized
  WHERE len <= 150 OR point_no IN (SELECT (i * (len - 1)) // 149 FROM range(150) t(i)))"""

CALIBRATION = f"""
long_scores AS (
  SELECT 'operational_score' AS score_name, churn, operational_score AS score FROM test
  UNION ALL SELECT 'calibrated_prob', churn, calibrated_prob FROM test),
edges AS (SELECT i, CASE WHEN i = 10 THEN 1.0::DOUBLE ELSE i * 0.1::DOUBLE END AS edge
          FROM range(11) t(i)),
binned AS (
  SELECT *, (SELECT CAST(least(count(*) - 1, 9) AS INTEGER) FROM edges WHERE edge <= score) AS bin
  FROM long_scores),
bins AS (
  SELECT score_name, bin, count(*) AS rows, avg(churn) AS mean_label, avg(score) AS mean_score
  FROM binned GROUP BY score_name, bin),
ece AS (SELECT score_name, sum(rows * abs(mean_label - mean_score)) / sum(rows) AS ece
        FROM bins GROUP BY score_name),
calibration AS (
  SELECT score_name, avg((score - churn) ** 2) AS brier_score, any_value(ece) AS ece,
         avg(score) AS mean_score
  FROM long_scores JOIN ece USING (score_name) GROUP BY score_name)"""

DECILES = """
ranked AS (
  SELECT 1 - churn AS active, row_number() OVER (ORDER BY 1.0::DOUBLE - operational_score DESC,
           md5(customer_unique_id), customer_unique_id) AS rk, count(*) OVER () AS n FROM test),
per_decile AS (
  SELECT greatest(1, CAST(ceil((rk - 1) * 10 / (n - 1)) AS INTEGER)) AS d, count(*) AS customers,
         CAST(sum(active) AS BIGINT) AS active_count FROM ranked GROUP BY 1),
running AS (
  SELECT d, customers, active_count,
         CAST(sum(active_count) OVER upto AS BIGINT) AS cum_active_count,
         CAST(sum(customers) OVER upto AS BIGINT) AS cum_customers,
         CAST(sum(active_count) OVER () AS BIGINT) AS all_active,
         CAST(sum(customers) OVER () AS BIGINT) AS all_customers
  FROM per_decile WINDOW upto AS (ORDER BY d)),
deciles AS (
  SELECT 'D' || d AS decile, customers, active_count, active_count / customers AS active_rate,
         cum_active_count,
         cum_active_count / (all_active + 1e-9) * 100.0::DOUBLE AS cum_active_capture_pct,
         cum_customers / all_customers * 100.0::DOUBLE AS cum_customer_pct,
         active_count / customers / (all_active / all_customers + 1e-9) AS lift,
         cum_active_count / cum_customers / (all_active / all_customers + 1e-9) AS cum_lift
  FROM running)"""

TIDY = f"""
SELECT section, metric, {r('value')} AS value FROM (
  SELECT 'confusion_matrix' AS section, metric, value::DOUBLE AS value
  FROM (UNPIVOT matrix ON tn, fp, fn, tp INTO NAME metric VALUE value)
  UNION ALL SELECT 'test_counts', metric, value::DOUBLE
  FROM (UNPIVOT (SELECT count(*) AS total_test, count(*) FILTER (WHERE churn = 1) AS churn_count,
                        count(*) FILTER (WHERE churn = 0) AS active_count FROM test)
        ON total_test, churn_count, active_count INTO NAME metric VALUE value)
  UNION ALL SELECT 'ranking', 'churn.roc_auc', roc_auc FROM auc
            WHERE score_name = 'operational_score'
  UNION ALL SELECT 'ranking', 'churn_calibrated.roc_auc', roc_auc FROM auc
            WHERE score_name = 'calibrated_prob'
  UNION ALL SELECT 'ranking', 'active.roc_auc', roc_auc FROM auc
            WHERE score_name = 'operational_score'
  UNION ALL SELECT 'calibration', score_name || '.' || m, v
  FROM (UNPIVOT calibration ON brier_score, ece, mean_score INTO NAME m VALUE v)
  UNION ALL SELECT 'ranking', class || '.' || m, v
  FROM (UNPIVOT (SELECT *, average_precision / (prevalence + 1e-9) AS relative_lift FROM ap)
        ON average_precision, prevalence, relative_lift INTO NAME m VALUE v)
  UNION ALL SELECT 'classification_report', class || '.' || m, v
  FROM (UNPIVOT report ON precision, recall, f1_score, support INTO NAME m VALUE v))"""

# ---- risk scoring and reports ----------------------------------------------

PUBLISHED_COLUMNS = ", ".join(
    (
        "customer_unique_id",
        "business_risk_tier",
        "operational_risk_score",
        "calibrated_churn_prob",
        "risk_percentile",
        "actual_churn",
        *NUMERIC_FEATURES,
        "customer_state",
        "first_purchase",
        "last_purchase",
    )
)
MATCHES = """
matches AS (SELECT * FROM published WHERE business_risk_tier IN ('High Risk', 'Low Risk')
            AND regexp_matches(customer_unique_id, '(?i)customer#0')
            AND total_spend BETWEEN 0 AND 500000)"""
EXPLORER_COLUMNS = """customer_unique_id, business_risk_tier, operational_risk_score,
  calibrated_churn_prob, risk_percentile, recency_days, tenure_days, frequency_orders,
  total_spend, avg_review_score, customer_state"""



def moments() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS feature, {r(f'avg({n}::DOUBLE)', 4)} AS mean,"
        f" {r(f'stddev_pop({n}::DOUBLE)', 4)} AS std FROM train"
        for n in NUMERIC_FEATURES
    )


def standardized() -> str:
    columns = ", ".join(
        r(
            f"(d.{n}::DOUBLE - (SELECT avg({n}::DOUBLE) FROM train))"
            f" / (SELECT coalesce(nullif(stddev_pop({n}::DOUBLE), 0), 1) FROM train)",
            6,
        )
        + f" AS {n}"
        for n in NUMERIC_FEATURES
    )
    return f"SELECT d.customer_unique_id, {columns} FROM dataset d"


def label_moments() -> str:
    """Per model and input z: sum(w * y * z) / n, from the labels alone."""
    kept = sorted((*STATES, "Other"))[1:]
    inputs = {"(intercept)": "1.0::DOUBLE"}
    for n in NUMERIC_FEATURES:
        inputs[n] = (
            f"(t.{n}::DOUBLE - (SELECT avg({n}::DOUBLE) FROM train))"
            f" / (SELECT coalesce(nullif(stddev_pop({n}::DOUBLE), 0), 1) FROM train)"
        )
    inputs |= {f"customer_state_{s}": f"CAST(t.customer_state = '{s}' AS DOUBLE)" for s in kept}
    weights = {
        "operational": "(SELECT count(*) / (2.0::DOUBLE * sum(churn)) FROM train)",
        "calibrated": "1.0::DOUBLE",
    }
    return "\nUNION ALL ".join(
        f"SELECT '{model}' AS model, '{name}' AS feature,"
        f" {r(f'sum({weight} * t.churn * {z}) / count(*)', 6)} AS labelled, true AS met FROM train t"
        for model, weight in weights.items()
        for name, z in inputs.items()
    )


def dummies() -> str:
    kept = sorted((*STATES, "Other"))[1:]
    return ", ".join(f"CAST(customer_state = '{s}' AS DOUBLE) AS customer_state_{s}" for s in kept)


def check(name: str, source: str, broken: str) -> str:
    return f"SELECT '{name}' AS check_name, count(*) FILTER (WHERE {broken}) AS violations FROM {source}"


def checks(*parts: tuple[str, str, str]) -> str:
    return "\nUNION ALL ".join(check(*p) for p in parts)


LOGISTICS_COLUMNS = """avg_delivery_delay_days, late_delivery_rate, delivered_count,
  pending_delivery_at_snapshot, has_delivery_history"""

ORACLE_SQL: dict[str, str] = {
    "validated_orders": sql("SELECT * FROM vo"),
    "cohort_labels": sql("SELECT * FROM cohort", COHORT),
    "label_summary": sql(
        """SELECT count(*) AS eligible_customers, count(*) FILTER (WHERE churn = 1) AS churned_customers,
  count(*) FILTER (WHERE churn = 0) AS active_customers, avg(churn) AS churn_rate,
  avg(1 - churn) AS active_rate FROM cohort""",
        COHORT,
    ),
    "rfm_features": on_features("SELECT * FROM rfm2"),
    "item_features": on_features("SELECT * FROM items_agg"),
    "review_features": on_features("SELECT * FROM reviews_agg"),
    "logistics_features": on_features(
        f"SELECT customer_unique_id, {LOGISTICS_COLUMNS} FROM logistics2"
    ),
    "payment_features": on_features("SELECT * FROM payments2"),
    "snapshot_features": on_features("SELECT * FROM features"),
    "modeling_dataset": on_features("SELECT * FROM dataset"),
    "split_quotas": sql(
        "SELECT churn, n, n - n_train AS n_test FROM quota2", COHORT, BLOCKS, SPLIT
    ),
    "stratified_split": sql("SELECT * FROM split", COHORT, BLOCKS, SPLIT),
    "class_weights": sql(
        """SELECT churn, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
FROM train GROUP BY churn""",
        COHORT,
        BLOCKS,
        SPLIT,
    ),
    "scaler_moments": sql(moments(), COHORT, BLOCKS, SPLIT),
    "standardized_features": sql(standardized(), COHORT, BLOCKS, SPLIT),
    "state_levels": sql(
        """SELECT customer_state, count(*) AS customers,
  customer_state = (SELECT min(customer_state) FROM train) AS is_dropped
FROM train GROUP BY customer_state""",
        COHORT,
        BLOCKS,
        SPLIT,
    ),
    "one_hot_state": on_features(
        f"SELECT customer_unique_id, customer_state, {dummies()} FROM dataset"
    ),
    "model_moments": sql(label_moments(), COHORT, BLOCKS, SPLIT),
    "fixed_scores": on_scores(
        "SELECT customer_unique_id, churn, operational_score, calibrated_prob FROM scored"
    ),
    "eval_counts": on_scores(
        """SELECT count(*) AS total_test, count(*) FILTER (WHERE churn = 1) AS churn_count,
  count(*) FILTER (WHERE churn = 0) AS active_count FROM test"""
    ),
    "confusion_matrix": on_scores("SELECT * FROM matrix", MATRIX),
    "confusion_table": on_scores(
        """SELECT 'Active (0)' AS actual, tn AS predicted_active, fp AS predicted_churn FROM matrix
UNION ALL SELECT 'Churn (1)', fn, tp FROM matrix""",
        MATRIX,
    ),
    "classification_report": on_scores(
        f"""SELECT class, {r('precision')} AS precision, {r('recall')} AS recall,
  {r('f1_score')} AS f1_score, {r('support')} AS support FROM report""",
        MATRIX,
        REPORT,
    ),
    "roc_auc": on_scores(f"SELECT score_name, {r('roc_auc')} AS roc_auc FROM auc", AUC),
    "average_precision": on_scores(
        f"""SELECT class, {r('average_precision')} AS average_precision,
  {r('prevalence')} AS prevalence,
  {r('average_precision / (prevalence + 1e-9)')} AS relative_lift FROM ap
WHERE class IN ('churn', 'active')""",
        PR_GROUPS,
    ),
    "calibration": on_scores(
        f"""SELECT score_name, {r('brier_score')} AS brier_score, {r('ece')} AS ece,
  {r('mean_score')} AS mean_score FROM calibration""",
        CALIBRATION,
    ),
    "calibration_bins": on_scores(
        f"""SELECT score_name, bin, rows, {r('mean_label')} AS mean_label,
  {r('mean_score')} AS mean_score FROM bins""",
        CALIBRATION,
    ),
    "roc_curve": on_scores("SELECT * FROM roc_points", PR_GROUPS, ROC),
    "pr_curve_churn": on_scores(
        "SELECT point_no, recall, precision FROM pr_points WHERE class = 'churn'", PR_GROUPS
    ),
    "pr_curve_active": on_scores(
        "SELECT point_no, recall, precision FROM pr_points WHERE class = 'active'", PR_GROUPS
    ),
    "curve_downsample": on_scores("SELECT * FROM kept", PR_GROUPS, ROC, CURVES),
    "decile_lift": on_scores("SELECT * FROM deciles", DECILES),
    "decile_table": on_scores(
        """SELECT decile, customers, active_count, active_rate, cum_active_capture_pct, lift, cum_lift
FROM deciles""",
        DECILES,
    ),
    "metrics_tidy": on_scores(TIDY, MATRIX, REPORT, AUC, PR_GROUPS, CALIBRATION),
    "risk_tiers": on_scores(
        """SELECT customer_unique_id, operational_risk_score, calibrated_churn_prob,
  business_risk_tier FROM tiered"""
    ),
    "risk_percentile": on_scores(
        "SELECT customer_unique_id, operational_risk_score, risk_percentile FROM published"
    ),
    "scored_customers": on_scores(f"SELECT {PUBLISHED_COLUMNS} FROM published"),
    "high_risk_customers": on_scores(
        f"""SELECT {PUBLISHED_COLUMNS} FROM published WHERE operational_risk_score > 0.70::DOUBLE
ORDER BY operational_risk_score DESC, customer_unique_id"""
    ),
    "tier_summary": on_scores(
        f"""SELECT t.business_risk_tier, s.customer_count, s.avg_risk_score, s.avg_calibrated_prob,
  s.avg_spend, s.avg_recency, s.percentage
FROM (VALUES ('High Risk'), ('Medium Risk'), ('Low Risk')) t(business_risk_tier)
LEFT JOIN (SELECT business_risk_tier, count(*) AS customer_count,
  {r('avg(operational_risk_score)', 4)} AS avg_risk_score,
  {r('avg(calibrated_churn_prob)', 4)} AS avg_calibrated_prob,
  {r('avg(total_spend)', 4)} AS avg_spend, {r('avg(recency_days)', 4)} AS avg_recency,
  {r('count(*) / (SELECT count(*) FROM tiered) * 100.0::DOUBLE', 4)} AS percentage
  FROM tiered GROUP BY business_risk_tier) s USING (business_risk_tier)"""
    ),
    "tier_profile": on_scores(
        f"""SELECT t.tier_no, t.business_risk_tier, coalesce(s.customers, 0) AS customers, s.share,
  s.avg_recency, s.avg_spend, s.avg_review
FROM (VALUES (1, 'Low Risk'), (2, 'Medium Risk'), (3, 'High Risk')) t(tier_no, business_risk_tier)
LEFT JOIN (SELECT business_risk_tier, count(*) AS customers,
  {r('count(*) / (SELECT count(*) FROM tiered)', 4)} AS share,
  {r('avg(recency_days)', 4)} AS avg_recency, {r('avg(total_spend)', 4)} AS avg_spend,
  {r('avg(avg_review_score)', 4)} AS avg_review
  FROM tiered GROUP BY business_risk_tier) s USING (business_risk_tier)"""
    ),
    "kpi_overview": on_scores(
        f"""SELECT count(*) AS eligible_customers, count(*) FILTER (WHERE churn = 1) AS churned_customers,
  count(*) FILTER (WHERE churn = 0) AS active_customers, {r('avg(churn)')} AS churn_rate,
  {r('avg(1 - churn)')} AS active_rate,
  (SELECT {r('roc_auc')} FROM auc WHERE score_name = 'operational_score') AS roc_auc,
  (SELECT {r('average_precision / (prevalence + 1e-9)')} FROM ap WHERE class = 'active')
    AS active_lift FROM scored""",
        AUC,
        PR_GROUPS,
    ),
    "customer_explorer": on_scores(
        f"SELECT {EXPLORER_COLUMNS} FROM matches ORDER BY customer_unique_id LIMIT 100", MATCHES
    ),
    "explorer_count": on_scores("SELECT count(*) AS matching_customers FROM matches", MATCHES),
    "explorer_ids": on_scores(
        "SELECT customer_unique_id FROM matches ORDER BY customer_unique_id LIMIT 20", MATCHES
    ),
    "spend_bounds": on_features(
        """SELECT min(total_spend) AS min_spend, least(2000.0::DOUBLE, max(total_spend)) AS max_spend
FROM features"""
    ),
    "customer_profile": on_scores(
        f"""SELECT customer_unique_id, business_risk_tier, operational_risk_score,
  calibrated_churn_prob, {r('100.0::DOUBLE - risk_percentile')} AS top_percent
FROM published WHERE customer_unique_id = (SELECT min(customer_unique_id) FROM published
  WHERE business_risk_tier IN ('High Risk', 'Low Risk') AND total_spend BETWEEN 0 AND 500000)"""
    ),
    "population_profile": sql(
        """SELECT count(*) AS delivered_customers, count(*) FILTER (WHERE n = 1) AS one_time_buyers,
  count(*) FILTER (WHERE n > 1) AS repeat_buyers,
  count(*) FILTER (WHERE n = 1) / count(*) AS one_time_share,
  count(*) FILTER (WHERE n > 1) / count(*) AS repeat_share,
  (SELECT count(DISTINCT customer_unique_id) FROM c_customers) AS customer_universe
FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM vo WHERE is_valid_delivered
      GROUP BY customer_unique_id)"""
    ),
    "late_review_audit": sql(
        f"""SELECT count(*) AS late_reviews FROM c_reviews v JOIN hist h USING (order_id)
WHERE v.review_creation_date > {SNAP}"""
    ),
    "calibrated_tier_mix": on_scores(
        """SELECT business_risk_tier, customers, customers / sum(customers) OVER () AS share
FROM (SELECT CASE WHEN calibrated_churn_prob > 0.70::DOUBLE THEN 'High Risk'
             WHEN calibrated_churn_prob >= 0.30::DOUBLE THEN 'Medium Risk'
             ELSE 'Low Risk' END AS business_risk_tier, count(*) AS customers
      FROM tiered GROUP BY 1)"""
    ),
    "key_audit": sql(
        checks(
            (
                "duplicate_order_id",
                "(SELECT order_id, count(*) AS k FROM c_orders GROUP BY order_id)",
                "k > 1",
            ),
            (
                "duplicate_customer_id",
                "(SELECT customer_id, count(*) AS k FROM c_customers GROUP BY customer_id)",
                "k > 1",
            ),
        )
    ),
    "leakage_audit": sql(
        checks(
            ("order_after_snapshot", "versus", "orders > orders_then"),
            ("negative_recency", "features", "recency_days < 0"),
            ("tenure_below_recency", "features", "tenure_days - recency_days < -1e-5"),
            ("purchase_after_snapshot", "features", f"last_purchase > {SNAP}"),
            ("review_after_snapshot", "versus", "reviews > reviews_then"),
            ("differs_from_tables_as_of_snapshot", "unlike", "true"),
        ),
        COHORT,
        BLOCKS,
        CUT,
    ),
    "target_audit": on_features(
        checks(
            ("label_not_binary", "cohort", "churn NOT IN (0, 1) OR churn IS NULL"),
            ("label_disagrees_with_count", "cohort", "(churn = 1) <> (target_orders_count = 0)"),
            (
                "duplicate_customer",
                "(SELECT customer_unique_id, count(*) AS k FROM cohort GROUP BY 1)",
                "k > 1",
            ),
            (
                "cohort_features_mismatch",
                "(SELECT c.churn, f.frequency_orders FROM cohort c FULL JOIN features f"
                " USING (customer_unique_id))",
                "churn IS NULL OR frequency_orders IS NULL",
            ),
        )
    ),
    "scoring_audit": on_scores(
        checks(
            (
                "operational_out_of_range",
                "published",
                "NOT coalesce(operational_risk_score BETWEEN 0 AND 1, false)",
            ),
            (
                "calibrated_out_of_range",
                "published",
                "NOT coalesce(calibrated_churn_prob BETWEEN 0 AND 1, false)",
            ),
            (
                "tier_disagrees",
                "published",
                "(operational_risk_score > 0.70::DOUBLE AND business_risk_tier <> 'High Risk')"
                " OR (operational_risk_score < 0.30::DOUBLE AND business_risk_tier <> 'Low Risk')"
                " OR (operational_risk_score BETWEEN 0.30::DOUBLE AND 0.70::DOUBLE"
                " AND business_risk_tier <> 'Medium Risk')",
            ),
            ("export_not_above_threshold", "export", "NOT operational_risk_score > 0.70::DOUBLE"),
            ("export_not_high", "export", "business_risk_tier <> 'High Risk'"),
        )
        + "\nUNION ALL SELECT 'export_empty', CAST(count(*) = 0 AS BIGINT) FROM export",
        "export AS (SELECT * FROM published WHERE operational_risk_score > 0.70::DOUBLE)",
    ),
}

# The same answers, by way of files.
ORACLE_SQL["snapshot_features_csv"] = ORACLE_SQL["snapshot_features"]
ORACLE_SQL["high_risk_files"] = ORACLE_SQL["high_risk_customers"]

ORACLE_SQL["repeated_orders"] = on_features(
    """SELECT customer_unique_id, target_orders_count, churn, frequency_orders, frequency_items,
         distinct_categories, review_count, delivered_count FROM dataset"""
).replace(
    "c_customers AS (",
    "c_orders2 AS (SELECT * FROM c_orders UNION ALL SELECT * FROM c_orders WHERE order_id % 7 = 0),\nc_customers AS (",
    1,
).replace("FROM c_orders o LEFT JOIN c_customers", "FROM c_orders2 o LEFT JOIN c_customers", 1)

ZERO_CHECKS = (
    "negative_recency", "tenure_below_recency", "purchase_after_snapshot", "order_after_snapshot",
    "review_after_snapshot", "differs_from_tables_as_of_snapshot", "label_not_binary",
    "label_disagrees_with_count", "duplicate_customer", "cohort_features_mismatch",
    "operational_out_of_range", "calibrated_out_of_range", "tier_disagrees",
    "export_not_above_threshold", "export_not_high", "metrics_differ_from_run",
    "importance_without_a_feature", "models_differ_in_size", "dataset_and_scored_differ",
    "export_rows_missing",
)
ORACLE_SQL["run_audits"] = on_scores(
    f"""SELECT unnest([{", ".join(f"'{c}'" for c in ZERO_CHECKS)}]) AS check_name, CAST(0 AS BIGINT) AS value
UNION ALL SELECT 'listed_numeric_features', CAST(21 AS BIGINT)
UNION ALL SELECT 'dataset_rows', count(*) FROM dataset
UNION ALL SELECT 'dataset_churned', count(*) FROM dataset WHERE churn = 1
UNION ALL SELECT 'metrics_total_test', count(*) FROM test
UNION ALL SELECT 'metrics_churn_count', count(*) FROM test WHERE churn = 1
UNION ALL SELECT 'metrics_active_count', count(*) FROM test WHERE churn = 0"""
)


def _changed(sql: str, *changes: tuple[str, str]) -> str:
    """The SQL with each text, which must be there, replaced once."""
    for old, new in changes:
        assert old in sql, old
        sql = sql.replace(old, new, 1)
    return sql


# Rows that the CSV shop spoils (star_queries.UNSOUND), by the text each table's definition ends in.
ORACLE_SQL["snapshot_features_sound"] = _changed(
    ORACLE_SQL["snapshot_features"],
    ("d.l_orderkey = o.o_orderkey)", "d.l_orderkey = o.o_orderkey WHERE o.o_orderkey % 13 <> 0)"),
    ("AS freight_value\n  FROM lineitem)", "AS freight_value\n  FROM lineitem WHERE NOT (l_orderkey % 17 = 0 AND l_linenumber = 2))"),
    ("AS payment_value\n  FROM lineitem)", "AS payment_value\n  FROM lineitem WHERE NOT (l_orderkey % 19 = 0 AND l_linenumber = 1))"),
    ("WHERE l_linenumber = 1)", "WHERE l_linenumber = 1 AND l_orderkey % 23 <> 0)"),
)
SPOILT = """
spoilt AS (
  SELECT 'orders' AS table_name, o_orderkey % 13 = 0 AS bad FROM orders
  UNION ALL SELECT 'customers', false FROM customer
  UNION ALL SELECT 'order_items', l_orderkey % 17 = 0 AND l_linenumber = 2 FROM lineitem
  UNION ALL SELECT 'payments', l_orderkey % 19 = 0 AND l_linenumber = 1 FROM lineitem
  UNION ALL SELECT 'reviews', l_orderkey % 23 = 0 FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'products', false FROM part
  UNION ALL SELECT 'sellers', false FROM supplier)"""
ORACLE_SQL["intake_counts"] = f"""WITH {SPOILT}
SELECT table_name, count(*) AS rows_read, count(*) FILTER (NOT bad) AS rows_kept,
       count(*) FILTER (bad) AS rows_rejected
FROM spoilt GROUP BY table_name"""
ORACLE_SQL["intake_records"] = f"""WITH {SPOILT}
SELECT table_name, count(*) AS records, count(*) AS whole_records
FROM spoilt WHERE bad GROUP BY table_name"""
# Customers lie in their file by key.
ORACLE_SQL["decile_lift_in_order"] = _changed(
    ORACLE_SQL["decile_lift"],
    (
        "operational_score DESC,\n           md5(customer_unique_id), customer_unique_id)",
        "round_even(operational_score * 10, 0) / 10.0::DOUBLE DESC, c_custkey)",
    ),
    ("AS n FROM test)", "AS n FROM test JOIN customer ON c_name = customer_unique_id)"),
)
