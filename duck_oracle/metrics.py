"""Oracle SQL for the headline metrics (M-01..M-07), built on the view SQL."""

from __future__ import annotations

from duck_oracle.sqlfn import DD, RD, R, RP
from duck_oracle.views import PERSON_SCORES, V02, V04, V05, V09, V10

M01 = f"""
WITH v AS ({V04})
SELECT cast(sum(CASE WHEN buyer_type = 'One-Time Buyer' THEN customer_count ELSE 0 END) AS bigint) AS one_time_customers,
       cast(sum(customer_count) AS bigint) AS total_customers,
       {R("sum(CASE WHEN buyer_type = 'One-Time Buyer' THEN customer_count ELSE 0 END) * 100", "sum(customer_count)", 2)}
         AS one_time_pct
FROM v
"""

M02 = f"""
WITH d AS (
  SELECT {DD("o.order_estimated_delivery_date", "o.order_delivered_customer_date")} AS delay_days,
         cast(r.review_score AS bigint) AS s
  FROM fx_orders o JOIN fx_order_reviews r ON o.order_id = r.order_id
  WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL AND r.review_score IS NOT NULL
), a AS (
  SELECT sum(s) FILTER (WHERE delay_days > 0) AS s_late, count(s) FILTER (WHERE delay_days > 0) AS n_late,
         sum(s) FILTER (WHERE delay_days <= 0) AS s_ok, count(s) FILTER (WHERE delay_days <= 0) AS n_ok
  FROM d
)
SELECT n_late AS late_reviews, n_ok AS not_late_reviews,
       {R("s_late", "n_late", 3)} AS avg_score_late,
       {R("s_ok", "n_ok", 3)} AS avg_score_not_late,
       {RD("cast(s_ok AS double) / cast(nullif(n_ok, 0) AS double) - cast(s_late AS double) / cast(nullif(n_late, 0) AS double)", 3)}
         AS score_gap
FROM a
"""

M03 = f"""
WITH v AS ({V02})
SELECT count(*) AS n_categories,
       count(*) FILTER (WHERE pareto_group = 'Top 80%') AS top80_categories,
       {RP("sum(CASE WHEN revenue_rank <= 10 THEN cast(total_revenue AS decimal(38,2)) ELSE 0 END)",
           "sum(cast(total_revenue AS decimal(38,2)))", 2)} AS top10_revenue_share_pct
FROM v
"""

M04 = f"""
WITH v AS ({V09})
SELECT count(*) AS n_sellers,
       count(*) FILTER (WHERE delivery_tier = 'Needs Improvement') AS below_70_sellers,
       {R("count(*) FILTER (WHERE delivery_tier = 'Needs Improvement') * 100", "count(*)", 2)} AS below_70_pct
FROM v
"""

M05 = f"""
WITH v AS ({V10})
SELECT payment_type, total_payment_value,
       {R("cast(total_payment_value AS decimal(38,2)) * 100",
          "sum(cast(total_payment_value AS decimal(38,2))) OVER ()", 2)} AS revenue_share_pct
FROM v
"""

M06 = f"""
WITH {PERSON_SCORES}, s AS (
  SELECT seg AS rfm_segment, count(*) AS customers, sum(spend) AS rev FROM labelled GROUP BY seg
)
SELECT rfm_segment, customers,
       {R("customers * 100", "sum(customers) OVER ()", 2)} AS customer_share_pct,
       cast(round(rev, 2) AS double) AS revenue,
       {R("rev * 100", "sum(rev) OVER ()", 2)} AS revenue_share_pct
FROM s
"""

M07 = f"""
WITH v AS ({V05}), month AS (SELECT unnest(range(0, (SELECT max(month_number) FROM v) + 1)) AS month_number)
SELECT c.cohort_month, c.cohort_customers, m.month_number,
    (SELECT v.retention_rate_pct FROM v WHERE v.cohort_month = c.cohort_month AND v.month_number = m.month_number) AS retention_rate_pct
FROM (SELECT DISTINCT cohort_month, cohort_customers FROM v) c, month m
"""

METRICS = {
    "m01_one_time_buyer_share": M01,
    "m02_late_delivery_score_gap": M02,
    "m03_pareto_summary": M03,
    "m04_sellers_below_on_time_target": M04,
    "m05_payment_revenue_share": M05,
    "m06_segment_share": M06,
    "m07_retention_matrix": M07,
}
