"""The shared test tables as observation tables.

``shipments``: supplier = site, ship year = batch, line number = bag (4 stands for an unnamed bag), month = visit;
returned quantity = dead, the rest = alive, price over pi = total mass (an irrational scale keeps quotients
off the rounding ties of the SQL comparison).
``order_curves``: nation = site, order year = campaign, urgent or not = class; the running share of the year's
revenue and order count by month.
``events``: user = unit, day = visit, event type = parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.derive import day_offset
from tidemark.functions.nulls import ratio
from tidemark.operators.seeding import Layout

AT = Layout(carried=("campaign",), alive="alive", dead="dead", total="mass", single="price")
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shipment_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item, keyed like an observation."""
    day = F.col("l_shipdate").cast("date")
    return load(spark, folder, "lineitem").select(
        F.year(day).alias("batch"), F.col("l_suppkey").alias("site"), F.year(day).alias("campaign"),
        F.trunc(day, "month").alias("date"), F.nullif(F.col("l_linenumber"), F.lit(4)).alias("id_ind"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.pi()).alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
    )


def shipment_visits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per bag and month; a count that never occurs is NULL."""
    returned = F.col("flag") == "R"
    return shipment_lines(spark, folder).groupBy("batch", "site", "campaign", "date", "id_ind").agg(
        F.sum(F.when(returned, F.col("quantity"))).alias("dead"),
        F.sum(F.when(~returned, F.col("quantity"))).alias("alive"),
        F.sum("price").alias("mass"))


def shipment_measures(spark: SparkSession, folder: str) -> DataFrame:
    """``shipment_visits`` with what the single masses of a bag and month add up to: all quantities follow from this aggregate.

    ``singles`` and ``n_singles``: sum and number of prices a piece of what was not returned; ``lines``: number of prices.
    """
    returned = F.col("flag") == "R"
    each = F.when(~returned, F.col("price") / F.col("quantity"))
    return shipment_lines(spark, folder).groupBy("batch", "site", "campaign", "date", "id_ind").agg(
        F.sum(F.when(returned, F.col("quantity"))).alias("dead"),
        F.sum(F.when(~returned, F.col("quantity"))).alias("alive"),
        F.sum("price").alias("mass"), F.count("price").alias("lines"),
        F.sum(each).alias("singles"), F.count(each).alias("n_singles"))


def shipment_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``shipment_visits`` with 0 for a missing count."""
    return shipment_visits(spark, folder).fillna(0.0, ["dead", "alive"])


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Long observations: batch, site, campaign, date, id_ind, code_param, value."""
    keys = ["batch", "site", "campaign", "date", "id_ind"]
    return shipment_visits(spark, folder).unpivot(keys, ["dead", "alive", "mass"], "code_param", "value").filter(
        F.col("value").isNotNull())


def events(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select(
        F.col("user_id").alias("unit"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("code_param"),
        "value")


def order_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly running shares per class, nation and year."""
    day = F.col("o_orderdate").cast("date")
    orders = load(spark, folder, "orders").select(
        "o_custkey", F.year(day).alias("campaign"), F.trunc(day, "month").alias("date"), "o_totalprice",
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "N0").otherwise("J1").alias("class_age"))
    customers = load(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("site"))
    keys = ["class_age", "site", "campaign"]
    monthly = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(*keys, "date").agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )
    year = Window.partitionBy(*keys)
    upto = year.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda c: ratio(F.sum(c).over(upto), F.sum(c).over(year))
    return monthly.select(
        *keys, "date", day_offset(F.col("date"), F.col("campaign")).alias("DOY"), share("revenue").alias("share"),
        (F.lit(10.0) + F.lit(50.0) * share("orders")).alias("mass"))


def odd_curves(spark: SparkSession, folder: str) -> DataFrame:
    """``order_curves`` with two kinds of series that fits report: one nation in five never grows, so that a curve meets it
    without any residual; another follows a logistic curve around its own middle day, to which each round comes closer.
    """
    curves = order_curves(spark, folder)
    middle = F.min(F.when(F.col("share") >= 0.5, F.col("DOY"))).over(Window.partitionBy("class_age", "site", "campaign"))
    exact = F.lit(0.9) / (1 + F.exp(F.lit(-0.05) * (F.col("DOY") - middle)))
    kind = F.col("site") % 5
    return curves.withColumn("share", F.when(kind == 1, 0.0).when(kind == 2, exact).otherwise(F.col("share")))


def nations(spark: SparkSession, folder: str) -> DataFrame:
    """Site table: number, name, zone."""
    nation, region = load(spark, folder, "nation"), load(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("site"), F.col("n_name").alias("name"), F.col("r_name").alias("zone"))
