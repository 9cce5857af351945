"""Reading the raw observation feed and deriving its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.derive import century, day_offset, last_match, parse_date, parse_number, span
from tidemark.functions.nulls import composite_key, delete_where
from tidemark.operators.joins import join_keys

# The 34 columns of the raw feed by position; only the 18 named ones are read.
RAW_WIDTH = 34
RAW_POSITIONS = {
    "program": 30, "mnemonic_site": 3, "site": 2, "class_age": 17, "ploidy": 18, "date": 9, "mnemonic_date": 8,
    "param": 23, "code_param": 22, "unit_measure": 28, "fraction": 25, "method": 26, "id_ind": 29, "value": 32,
    "mnemonic_sampling": 19, "long": 12, "lat": 14, "pop_init_batch": 16,
}
# The spelling of ploidy, and below the years and the batch of the followed stock.
PLOIDY = {"diploïdes": "2n", "triploïdes": "3n"}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Scan a headed CSV by position, keep the 18 named columns as text; blanks and ``NA`` are NULL."""
    names = {position: name for name, position in RAW_POSITIONS.items()}
    schema = StructType([StructField(names.get(i, f"unused_{i}"), StringType()) for i in range(1, RAW_WIDTH + 1)])
    raw = spark.read.schema(schema).csv(path, header=True, nullValue="NA", enforceSchema=True)
    return raw.select(*RAW_POSITIONS)


def typed(raw: DataFrame) -> DataFrame:
    """Types, then one copy of every distinct row."""
    numbers = {c: parse_number(F.col(c)) for c in ("value", "long", "lat")}
    return raw.withColumns({"date": parse_date(F.col("date")), **numbers}).dropDuplicates()


def with_keys(observations: DataFrame, site_codes: DataFrame) -> DataFrame:
    """Campaign, origin, birthplace and batch from the code strings, and site and ploidy codes.

    ``site_codes`` maps the full name (``site``) to its code (``site_code``). Rows of other sites go.
    """
    code = F.col("pop_init_batch")
    origin, birthplace = span(code, 9, 10), span(code, 14, 15)
    spat = F.when(origin.isin("ET", "NS"), "HATCH").otherwise("WILD")
    # Birthplace codes; later ones overwrite earlier ones.
    site_spat = last_match(
        F.when(spat == "WILD", "AR"),
        (birthplace == "BO", "BO"), (birthplace == "MO", "MO"), (origin == "NS", "E4"), (birthplace == "GO", "E1"),
        (birthplace == "FT", "E3"), (birthplace == "VN", "E2"), (birthplace == "Me", "ME"),
    )
    ploidy = F.col("ploidy")
    for name, short in PLOIDY.items():
        ploidy = F.when(F.col("ploidy") == name, short).otherwise(ploidy)
    keyed = observations.withColumns({
        "campaign": century(span(code, 3, 4)), "spat": spat, "site_spat": site_spat, "ploidy": ploidy})
    coded = join_keys(keyed, site_codes.select("site", "site_code"), ["site"]).withColumn(
        "site", F.col("site_code")).drop("site_code")
    return coded.withColumn("batch", composite_key("campaign", "class_age", "spat", "ploidy", "site_spat"))


def in_scope(observations: DataFrame) -> DataFrame:
    """Rows of the followed batches within their campaign year."""
    foreign = (
        F.col("campaign").between(2009, 2014) & (F.col("class_age") == "N0")
        & (span(F.col("batch"), 6, 18) != "N0_WILD_2n_AR")
    )
    kept = delete_where(observations, foreign)
    kept = kept.filter(day_offset(F.col("date"), F.col("campaign")) <= 365)
    kept = kept.filter(F.col("class_age").isin("N0", "J1"))
    return delete_where(kept, F.col("mnemonic_sampling").contains("ISO"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    ddl = "num int, site string, name string, zone_fr string, zone_en string, lat double, long double"
    return spark.read.schema(ddl).csv(path, header=True, nullValue="NA")


def in_box(points: DataFrame, x: str, y: str, x_range: tuple[float, float] = (-6.0, 7.5),
           y_range: tuple[float, float] = (42.0, 52.0)) -> DataFrame:
    """Points inside a box, edges included."""
    return points.filter(F.col(x).between(*x_range) & F.col(y).between(*y_range))
