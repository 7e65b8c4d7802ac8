"""Customer views: repeat purchase (V-04), cohort retention (V-05), RFM (V-06), lifetime value (V-07).

A person is ``customer_unique_id``; ``customer_id`` is per order.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feira.functions import day_diff, money, ratio_round
from feira.functions.numeric import ColumnOrName
from feira.operators.ranking import RankOut, with_global_ranks
from feira.plans.common import delivered_orders, item_value
from feira.sources.bridge import Tables

PERSON = "customer_unique_id"
WORD = 64  # months in a word of an activity bitset

# Fixed values that must equal the reference's.
BUYER_TYPES = ["One-Time Buyer", "Occasional", "Regular", "Loyal"]  # 1 | 2-3 | 4-6 | more
# RFM segments as (label, condition): the first match wins; score 1 is the best quintile
# (SURVEY D6); 'Cannot Lose Them' is unreachable after 'At Risk' (SURVEY D7).
RFM_SEGMENTS = [
    ("Champions", "r_score >= 4 AND f_score >= 4 AND m_score >= 4"),
    ("Loyal Customers", "r_score >= 3 AND f_score >= 3 AND m_score >= 3"),
    ("Recent Customers", "r_score >= 4 AND f_score <= 2"),
    ("Potential Loyalists", "r_score >= 3 AND f_score <= 2 AND m_score >= 3"),
    ("At Risk", "r_score <= 2 AND f_score >= 3 AND m_score >= 3"),
    ("Cannot Lose Them", "r_score <= 2 AND f_score >= 4 AND m_score >= 4"),
    ("Hibernating", "r_score <= 2 AND f_score <= 2 AND m_score <= 2"),
]
RFM_OTHER = "Needs Attention"


def _delivered_with_person(t: Tables, *cols: str) -> DataFrame:
    customers = t.customers.select("customer_id", PERSON)
    return delivered_orders(t, "customer_id", *cols).join(customers, on="customer_id")


def repeat_purchase_rate(t: Tables) -> DataFrame:
    """V-04 vw_repeat_purchase_rate: persons per number of delivered orders.

    ``orders`` has one row per order and ``customers`` one per customer id, so
    orders are counted, not distinct-counted. Two aggregations (per person, then per order count); the share window
    runs over the per-count table, which has one row per distinct order count.
    """
    per_person = _delivered_with_person(t).groupBy(PERSON).agg(F.count("order_id").alias("n_orders"))
    per_count = per_person.groupBy(F.col("n_orders").alias("order_count_bucket")).agg(
        F.count(PERSON).alias("customer_count")
    )
    n = F.col("order_count_bucket")
    one, occasional, regular, loyal = BUYER_TYPES
    return per_count.select(
        "order_count_bucket",
        "customer_count",
        ratio_round(F.col("customer_count") * 100, F.sum("customer_count").over(W.partitionBy()), 2).alias(
            "pct_of_customers"
        ),
        F.when(n == 1, one).when(n.between(2, 3), occasional).when(n.between(4, 6), regular).otherwise(loyal).alias(
            "buyer_type"
        ),
    )


def month_index(date: ColumnOrName) -> Column:
    """Months since year 0 as BIGINT."""
    return (F.year(date) * 12 + F.month(date) - 1).cast("bigint")


def words_of(months: DataFrame, month: str) -> list[int]:
    """The numbers (month / 64) of the bitset words that hold a month; a century has twenty."""
    found = months.agg(F.collect_set(F.expr(f"`{month}` div {WORD}")).alias("words")).first()
    return sorted(found["words"])


def activity_bitsets(months: DataFrame, key: str, month: str, words: list[int]) -> DataFrame:
    """One row per key: the months in which it has a row, as a bitset of 64-bit words (``months_<word>``; bit i is month 64 * word + i),
    and whether it has a row without a month. ``bit_or`` merges, so a key's rows become one row map-side, however many they are."""
    place, bit = F.expr(f"`{month}` div {WORD}"), F.expr(f"shiftleft(1L, CAST(`{month}` % {WORD} AS INT))")
    sets = [F.coalesce(F.bit_or(F.when(place == w, bit)), F.lit(0).cast("bigint")).alias(f"months_{w}") for w in words]
    return months.groupBy(key).agg(*sets, F.max(F.col(month).isNull()).alias("undated"))


def active_months(words: list[int]) -> Column:
    """The months of a bitset as an array of month numbers, with a NULL at the end if the key has a row without a month."""

    def months_in(word: int) -> Column:
        held = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col(f"months_{word}"), i) == 1)
        return F.transform(held, lambda i: i + F.lit(WORD * word).cast("bigint"))

    none = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    return F.concat(none, *map(months_in, words), F.when(F.col("undated"), F.array(F.lit(None).cast("bigint"))).otherwise(none))


def cohort_retention(t: Tables) -> DataFrame:
    """V-05 vw_cohort_retention: active persons per (first-order month, months since).

    A person's orders become one bitset of active months (``bit_or``, merged
    map-side). Persons of equal bitsets are counted next, so the bits of a
    pattern are read once for all of them; its first bit is the cohort month.
    Active persons per cell are then sums of those counts, and the cohort size
    is the cell with month_number 0. Nothing is shuffled per (person, month),
    and no window runs per person. The words are those that any order's month
    falls into, so one odd date adds one word.
    """
    months = (
        _delivered_with_person(t, "order_purchase_timestamp")
        .filter(F.col(PERSON).isNotNull())
        .select(PERSON, month_index("order_purchase_timestamp").alias("order_month"))
    )
    words = words_of(delivered_orders(t, "order_purchase_timestamp").select(month_index("order_purchase_timestamp").alias("order_month")), "order_month")
    persons = activity_bitsets(months, PERSON, "order_month", words)
    patterns = (
        persons.groupBy(*[c for c in persons.columns if c != PERSON]).agg(F.count(F.lit(1)).alias("persons"))
        .withColumn("active", active_months(words))
    )
    cells = (
        patterns.withColumn("cohort", F.array_min("active"))
        .select("cohort", "persons", F.explode("active").alias("order_month"))
        .groupBy("cohort", (F.col("order_month") - F.col("cohort")).alias("month_number"))
        .agg(F.sum("persons").alias("active_customers"))
    )
    size = F.sum(F.when(F.col("month_number") == 0, F.col("active_customers"))).over(W.partitionBy("cohort"))
    cohort_month = F.make_date(F.floor(F.col("cohort") / 12).cast("int"), (F.col("cohort") % 12 + 1).cast("int"), F.lit(1))
    return cells.withColumn("cohort_customers", size).select(
        cohort_month.alias("cohort_month"),
        "cohort_customers",
        "month_number",
        "active_customers",
        ratio_round(F.col("active_customers") * 100, "cohort_customers", 2).alias("retention_rate_pct"),
    )


def rfm_base(t: Tables) -> DataFrame:
    """Per-person recency / frequency / monetary, the inputs of the RFM scores.

    Items are summed per order first, so the person aggregate reads one row
    per order. The snapshot (latest delivered purchase, items ignored) is a
    one-row aggregate joined as a broadcast scalar.
    """
    per_order = t.order_items.groupBy("order_id").agg(F.sum(item_value()).alias("order_value"))
    snapshot = delivered_orders(t, "order_purchase_timestamp").agg(
        F.max("order_purchase_timestamp").alias("snapshot_date")
    )
    per_person = (
        _delivered_with_person(t, "order_purchase_timestamp")
        .join(per_order, on="order_id")
        .groupBy(PERSON)
        .agg(
            F.max("order_purchase_timestamp").alias("last_purchase"),
            F.count("order_id").alias("frequency"),  # one row per order here
            F.round(F.sum("order_value"), 2).alias("monetary_dec"),
        )
    )
    return per_person.crossJoin(F.broadcast(snapshot)).select(
        PERSON,
        day_diff("last_purchase", "snapshot_date").alias("recency_days"),
        "frequency",
        "monetary_dec",
    )


def rfm_segment() -> F.Column:
    """The segment of the columns r_score, f_score and m_score."""
    arms = " ".join(f"WHEN {cond} THEN '{label}'" for label, cond in RFM_SEGMENTS)
    return F.expr(f"CASE {arms} ELSE '{RFM_OTHER}' END")


def rfm_scores(t: Tables, base: DataFrame | None = None) -> DataFrame:
    """Per-person NTILE(5) scores (r, f, m) over all persons, with the exact spend kept as decimal.

    The three NTILEs are global orders over all persons; they are computed
    with the distributed ranking operator (no single-partition window). Ties
    are broken by md5(person), person (SURVEY D13). Score directions are the
    reference's: 1 = most recent / most frequent / highest spend (D6).
    """
    if base is None:
        return t.shared("rfm_scores", lambda: rfm_scores(t, rfm_base(t)))  # V-06, V-07 and M-06 rank once
    return with_global_ranks(
        base,
        PERSON,
        [
            RankOut("r_score", "recency_days", True, "ntile", 5),
            RankOut("f_score", "frequency", False, "ntile", 5),
            RankOut("m_score", "monetary_dec", False, "ntile", 5),
        ],
    ).withColumn("rfm_segment", rfm_segment())


def rfm_segments(t: Tables, scores: DataFrame | None = None) -> DataFrame:
    """V-06 vw_rfm_segments: recency, frequency, monetary, the three scores and the segment per person."""
    scored = rfm_scores(t) if scores is None else scores
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        PERSON,
        "recency_days",
        "frequency",
        money("monetary_dec").alias("monetary"),
        "r_score",
        "f_score",
        "m_score",
        F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("rfm_score"),
        (r + f + m).alias("rfm_total"),
        "rfm_segment",
    )


def customer_ltv(t: Tables, scores: DataFrame | None = None) -> DataFrame:
    """V-07 vw_customer_ltv: average customer value per RFM segment.

    The reference recomputes each person's rounded spend and joins it to the
    segments on the person; that spend is exactly V-06's ``monetary``, so the
    scored table is aggregated directly (no second three-way join). The
    reference's equi-join drops a NULL person, so it is dropped here too.
    """
    scored = rfm_scores(t) if scores is None else scores
    return (
        scored.filter(F.col(PERSON).isNotNull())
        .groupBy("rfm_segment")
        .agg(ratio_round(F.sum("monetary_dec"), F.count("monetary_dec"), 2).alias("avg_clv"))
    )
