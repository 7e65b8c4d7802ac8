"""Reference-shaped tables as SQL over the driver's parquet views (runs in DuckDB).

Same derivation rules as ``feira.sources.bridge`` (written independently, as SQL).
"""

from __future__ import annotations

import re

FIXTURES: dict[str, str] = {
    "fx_orders": """
select o_orderkey as order_id, -1 - o_orderkey * 2 as customer_id, order_status, purchase as order_purchase_timestamp,
  case when o_orderkey % 97 = 0 then null when o_orderkey % 43 = 0 then purchase - interval 1 hour
       else purchase + (o_orderkey % 24) * interval 1 hour end as order_approved_at,
  case when o_orderkey % 53 = 0 or order_status = 'processing' then null
       when o_orderkey % 41 = 0 then purchase - interval 1 day
       else purchase + (1 + o_orderkey % 4) * interval 1 day end as order_delivered_carrier_date,
  case when o_orderkey % 37 = 0 or order_status <> 'delivered' then null
       when o_orderkey % 59 = 0 then purchase + interval 2 hour
       else purchase + (5 + o_orderkey % 26) * interval 1 day end as order_delivered_customer_date,
  o_orderdate + interval 18 day as order_estimated_delivery_date
from (select o_orderkey, o_orderdate,
        case when o_orderkey % 50 = 0 then 'canceled'
             when o_orderstatus = 'P' and o_orderkey % 2 = 0 then 'shipped'
             when o_orderkey % 29 = 0 then 'processing' else 'delivered' end as order_status,
        o_orderdate + (o_orderkey % 24) * interval 1 hour as purchase
      from orders) x""",
    "fx_order_items": """
select l_orderkey as order_id, l_linenumber as order_item_id, l_partkey as product_id,
  case when l_suppkey % 10 = 0 and l_orderkey % 11 <> 0 then l_suppkey - 1 else l_suppkey end as seller_id,
  cast(cast((l_quantity * 1250 + case when l_orderkey % 3 = 0 then l_partkey % 100 else 0 end) as decimal(12,0))
       * cast(0.01 as decimal(3,2)) as decimal(12,2)) as price,
  cast(cast((500 + l_linenumber * 125 + l_partkey % 50) as decimal(12,0))
       * cast(0.01 as decimal(3,2)) as decimal(12,2)) as freight_value,
  case when l_linenumber = 7 and l_partkey % 5 = 0 then 'not-a-date' else cast(l_shipdate as string) end
    as shipping_limit_date
from lineitem""",
    "fx_order_payments": """
select o_orderkey as order_id,
  case when o_orderkey % 10 < 7 then 'credit_card' when o_orderkey % 10 < 9 then 'boleto' else 'debit_card' end as payment_type,
  cast(case when o_orderkey % 10 < 7 then o_orderkey % 13 else 1 end as int) as payment_installments,
  cast(o_totalprice as decimal(12,2)) as payment_value
from orders
union all
select o_orderkey, 'voucher', 1, cast(10.50 as decimal(12,2)) from orders where o_orderkey % 10 = 3""",
    "fx_order_reviews": """
select o_orderkey as order_id, cast(case when o_orderkey % 101 <> 0 then 1 + (o_orderkey * 3) % 5 end as int) as review_score,
  case when o_orderkey % 2 = 0 then null else o_orderpriority end as review_comment_message,
  o_orderdate as review_creation_date
from orders where o_orderkey % 11 <> 0
union all
select o_orderkey, cast(1 + o_orderkey % 4 as int), null, o_orderdate
from orders where o_orderkey % 13 = 0 and o_orderkey % 11 <> 0""",
    "fx_customers": """
select -1 - o_orderkey * 2 as customer_id,
  case when o_orderkey % 4 <> 0 then 100000000 + o_orderkey
       when o_custkey % 2 = 1 then o_custkey else o_custkey - o_custkey % 6 end as customer_unique_id,
  c_mktsegment as customer_city, n_name as customer_state
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "fx_products_raw": """
select p_partkey as product_id,
  case when p_partkey % 40 = 0 then null else p_brand end as product_category_name,
  case when p_partkey % 17 = 0 then null else length(p_name) end as product_name_lenght,
  case when p_partkey % 17 = 0 then null else length(p_name) * 10 end as product_description_lenght,
  case when p_partkey % 23 = 0 then null else p_size % 7 end as product_photos_qty,
  case when p_partkey % 19 = 0 then null else p_size * 100 end as product_weight_g,
  case when p_partkey % 31 = 0 then null else p_size + 10 end as product_length_cm,
  case when p_partkey % 31 = 0 then null else p_size + 3 end as product_height_cm,
  case when p_partkey % 31 = 0 or p_brand = 'Brand#9' then null else p_size + 5 end as product_width_cm
from part""",
    "fx_categories": """
select distinct p_brand as product_category_name, concat('cat_', lower(p_brand)) as product_category_name_english
from part where p_brand <> 'Brand#7'""",
    "fx_products": """
select p.product_id, coalesce(c.product_category_name_english, 'Unknown') as category_name
from fx_products_raw p left join fx_categories c
  on coalesce(p.product_category_name, 'Uncategorized') = c.product_category_name""",
    "fx_sellers": """
select s_suppkey as seller_id, n_name as seller_city, r_name as seller_state
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "fx_geolocation": """
select cast(c_custkey % 100 as int) as geolocation_zip_code_prefix,
  cast((c_custkey * 37) % 1000 as int) / cast(8 as double) as geolocation_lat,
  cast((c_custkey * 53) % 1000 as int) / cast(8 as double) as geolocation_lng,
  c_mktsegment as geolocation_city
from customer
union all
select cast(c_custkey % 100 as int), cast((c_custkey * 37) % 1000 as int) / cast(8 as double),
  cast((c_custkey * 53) % 1000 as int) / cast(8 as double), c_mktsegment
from customer where c_custkey % 10 = 0""",
}

_DEPENDS = {"fx_products": ["fx_products_raw", "fx_categories"]}


def with_fixtures(body: str) -> str:
    """Prefix ``body`` with the fixture CTEs it references (``body`` may start with its own WITH)."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in _DEPENDS.get(name, []):
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in FIXTURES:
        if re.search(rf"\b{name}\b", body):
            add(name)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]}\n)" for n in needed)
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        return f"WITH {ctes},\n{stripped[4:].lstrip()}"
    return f"WITH {ctes}\n{stripped}"
