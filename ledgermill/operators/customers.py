"""Customer metrics aggregated from invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import is_filled
from ..schemas import MONEY, MONEY_TOTAL


def late_condition(invoices: DataFrame) -> Column:
    """Late flag of either invoice layout; NULL counts as not late."""
    if "is_late" in invoices.columns:
        return F.coalesce(F.col("is_late"), F.lit(0)) == 1
    return F.col("late_payment_status") == "Late"


def customer_ids(invoices: DataFrame, limit: int | None = None) -> DataFrame:
    ids = invoices.filter(is_filled(F.col("customer_id"))).select("customer_id").distinct()
    ids = ids.orderBy("customer_id")
    return ids if limit is None else ids.limit(int(limit))


def aggregate_customers(invoices: DataFrame, limit: int | None = None) -> DataFrame:
    """One row of metrics per customer id; rows without an id are left out.

    Invoices are first counted per customer, name, currency and business code, which
    collapses a dominant customer on the map side. The small result gives both the totals
    and the most common name (count descending, then name ascending with NULL first).
    """
    known = invoices.filter(is_filled(F.col("customer_id")))
    if limit is not None:
        known = known.join(customer_ids(invoices, limit), "customer_id", "left_semi")

    flag = F.coalesce(F.col("is_open"), F.lit(0))
    amount = F.coalesce(F.col("invoice_amount"), F.lit(0).cast(MONEY))
    label = ["customer_name", "currency", "business_code"]

    by_label = known.groupBy("customer_id", *label).agg(
        F.count("*").alias("rows"),
        F.count_if(flag == 0).alias("closed"),
        F.count_if(flag == 1).alias("open"),
        F.sum(amount).alias("amount"),
        F.sum(F.when(flag == 1, amount)).alias("open_amount"),
        F.sum(F.when(flag == 0, F.col("payment_delay_days"))).alias("delay_sum"),
        F.count(F.when(flag == 0, F.col("payment_delay_days"))).alias("delay_rows"),
        F.count_if((flag == 0) & late_condition(invoices)).alias("late"),
        F.min("posting_date").alias("first_date"),
        F.max("posting_date").alias("last_date"),
    )
    most_common = F.min_by(F.struct(*label), F.struct(-F.col("rows"), *label))
    totals = by_label.groupBy("customer_id").agg(
        most_common.alias("label"),
        F.sum("rows").alias("rows"),
        F.sum("closed").alias("closed"),
        F.sum("open").alias("open"),
        F.sum("amount").alias("amount"),
        F.sum("open_amount").alias("open_amount"),
        F.sum("delay_sum").alias("delay_sum"),
        F.sum("delay_rows").alias("delay_rows"),
        F.sum("late").alias("late"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    return totals.select(
        "customer_id",
        F.col("label.customer_name").alias("customer_name"),
        F.col("label.currency").alias("default_currency"),
        F.col("label.business_code").alias("business_code"),
        F.col("rows").alias("total_invoices"),
        F.col("closed").alias("closed_invoice_count"),
        F.col("open").alias("open_invoice_count"),
        F.col("amount").cast(MONEY_TOTAL).alias("total_invoice_amount"),
        F.coalesce(F.col("open_amount"), F.lit(0)).cast(MONEY_TOTAL).alias("open_amount"),
        share("delay_sum", "delay_rows").alias("average_payment_delay"),
        (share("late", "closed") * 100).alias("late_payment_rate"),
        F.col("first_date").alias("first_invoice_date"),
        F.col("last_date").alias("last_invoice_date"),
    )


def invoice_summary(invoices: DataFrame, touched: DataFrame) -> DataFrame:
    """Invoice count and date range of the customers an import touched."""
    return (
        invoices.join(touched.select("customer_id").distinct(), "customer_id", "left_semi")
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("invoice_count"),
            F.min("posting_date").alias("first_invoice_date"),
            F.max("posting_date").alias("last_invoice_date"),
        )
    )
