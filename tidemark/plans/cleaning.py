"""Raw feed to the clean indicator table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.derive import span
from tidemark.functions.nulls import delete_where
from tidemark.operators import indicators as ind
from tidemark.operators.reshape import pivot_cells, set_aside
from tidemark.operators.schedule import apply_scheduled
from tidemark.operators.seeding import Layout
from tidemark.operators.selection import gate_days
from tidemark.plans.corrections import SINGLE, count_corrections, empty_visits, mass_corrections, told_by_batch
from tidemark.session import cut_lineage
from tidemark.sources.observations import in_scope, typed, with_keys
from tidemark.sources.sinks import fixed_digits

AT = Layout()
VISIT = ["batch", "site", "date"]
MIN_VISITS, END_MONTH = 4, 10
CLEAN_COLUMNS = ["num", "site", "name", "zone_en", "lat", "long", "campaign", "class_age", "batch", "date", "DOY",
                 "mean_CM", "mean_mass"]
# The weighing method and the fraction of single individuals, and the published columns above.
SIMPLE_WEIGHING, WHOLE = "Pesée simple sans préparation", "Sans objet"


def observations(raw: DataFrame, site_codes: DataFrame) -> DataFrame:
    """Typed, keyed and scoped observations of bags and individuals."""
    return in_scope(with_keys(typed(raw), site_codes))


def bag_observations(scoped: DataFrame) -> DataFrame:
    return scoped.filter(F.col("code_param") != SINGLE).select(*AT.columns)


def corrected_bags(bags: DataFrame, cut: bool = True) -> DataFrame:
    return apply_scheduled(bags, count_corrections() + mass_corrections(), AT, told_by_batch, cut)


def visits(bags: DataFrame) -> DataFrame:
    """One row per bag and day with its counts and mass, the largest value of each, and the cells that held several."""
    return pivot_cells(bags, [*AT.bag_keys, AT.date], AT.param, AT.value, [AT.dead, AT.alive, AT.total])


def quarantine(wide: DataFrame) -> DataFrame:
    """Cells of bag, day and parameter with several values, of which the run takes the largest."""
    return set_aside(wide, [*AT.bag_keys, AT.date])


def mortality(wide: DataFrame, strict: bool = False) -> DataFrame:
    """Mean cumulative mortality per visit, of the groups followed long enough."""
    kept = wide.filter(F.col(AT.dead).isNotNull() & F.col(AT.alive).isNotNull())
    for rule in empty_visits():
        kept = delete_where(kept, rule.matches(AT))
    rates = ind.cumulative_rate(kept, AT.bag_keys, AT.date, AT.dead, AT.alive)
    means = ind.mean_per_visit(rates, VISIT, "mc", "mean_CM", strict)
    return gate_days(means, list(AT.group), MIN_VISITS, END_MONTH)


def mass(wide: DataFrame, scoped: DataFrame, strict: bool = False) -> DataFrame:
    """Mean mass per visit: single individuals first, bags where no individual was weighed."""
    recent = F.substring("batch", 1, 4).try_cast("int") > 2008
    from_bags = ind.mean_bag_mass(wide.filter(recent), VISIT, AT.total, AT.alive, strict=strict)
    singles = ind.individual_mass(
        scoped, VISIT, AT.date, AT.value,
        (F.col("code_param") == SINGLE) & (F.col("fraction") == WHOLE) & (F.col("method") == SIMPLE_WEIGHING), recent)
    joined = ind.splice(singles, from_bags, VISIT, "individual_mass", "bag_mass", "mean_mass")
    return gate_days(joined, list(AT.group), MIN_VISITS, END_MONTH)


def clean_table(raw: DataFrame, site_codes: DataFrame, sites: DataFrame, cut: bool = True, strict: bool = False,
                quarantine_path: str | None = None) -> DataFrame:
    """The published table of both indicators; ``strict`` means as in ``nulls.mean``.

    Crowded cells are written to ``quarantine_path`` as Parquet, from the aggregate the table is made of.
    """
    scoped = observations(raw, site_codes)
    wide = visits(corrected_bags(bag_observations(scoped), cut=cut))
    if cut:
        wide = cut_lineage(wide)  # a few columns per bag and day, read by both indicators and the quarantine
    if quarantine_path:
        quarantine(wide).write.mode("overwrite").parquet(quarantine_path)
    campaign = F.substring("batch", 1, 4).try_cast("int")
    table = ind.assemble(
        mortality(wide, strict), mass(wide, scoped, strict), sites.drop("zone_fr"), VISIT, "site", "date", campaign,
        {"class_age": span(F.col("batch"), 6, 7), "campaign": campaign})
    return fixed_digits(table, {"mean_CM": 3, "mean_mass": 2}).select(*CLEAN_COLUMNS)
