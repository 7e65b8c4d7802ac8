"""The sixteen analytical views (``V-01`` .. ``V-16``) and the headline metrics.

Every view is a function ``Tables -> DataFrame``; views that read other
views take the intermediate frame as an optional argument so callers can
share it.
"""

from __future__ import annotations

from feira.plans.customers import (
    cohort_retention,
    customer_ltv,
    repeat_purchase_rate,
    rfm_segments,
)
from feira.plans.delivery import (
    delay_vs_review,
    delivery_by_state,
    delivery_performance_monthly,
    revenue_by_state,
)
from feira.plans.payments import (
    installments_analysis,
    monthly_revenue_by_payment,
    payment_method_analysis,
)
from feira.plans.revenue import category_performance, price_review_correlation, revenue_trends
from feira.plans.sellers import seller_delivery_vs_reviews, seller_performance

# Published view name -> function, in the reference's order.
VIEWS = {
    "vw_revenue_trends": revenue_trends,
    "vw_category_performance": category_performance,
    "vw_price_review_correlation": price_review_correlation,
    "vw_repeat_purchase_rate": repeat_purchase_rate,
    "vw_cohort_retention": cohort_retention,
    "vw_rfm_segments": rfm_segments,
    "vw_customer_ltv": customer_ltv,
    "vw_seller_performance": seller_performance,
    "vw_seller_delivery_vs_reviews": seller_delivery_vs_reviews,
    "vw_payment_method_analysis": payment_method_analysis,
    "vw_monthly_revenue_by_payment": monthly_revenue_by_payment,
    "vw_revenue_by_state": revenue_by_state,
    "vw_delivery_performance_monthly": delivery_performance_monthly,
    "vw_delivery_by_state": delivery_by_state,
    "vw_delay_vs_review": delay_vs_review,
    "vw_installments_analysis": installments_analysis,
}
