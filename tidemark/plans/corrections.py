"""The corrections of the monitoring table, in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.ledger import (
    IN, NAMED_NOT_IN, NOT_IN_OR_UNNAMED, UNNAMED, Rule, SeedFill, Step, ZeroFill, seed_where,
)

ALIVE, DEAD, TOTAL, SINGLE = "INDVVIVNB", "INDVMORNB", "TOTVIVPOI", "INDVPOID"

_NOT_1 = (NAMED_NOT_IN, ("1",))
_BAG_NULL = (UNNAMED, ())


def _bag(*names: str) -> tuple[str, tuple[str, ...]]:
    return IN, names


def _n0(*years: int) -> tuple[str, ...]:
    return tuple(f"{y}_N0_WILD_2n_AR" for y in years)


def _j1(*years: int) -> tuple[str, ...]:
    return tuple(f"{y}_J1_WILD_2n_AR" for y in years)


def _delete(batch, *site, **conditions) -> Rule:
    return Rule("delete", batch=batch, site=site, **conditions)


def count_corrections() -> list[Step]:
    """Steps on the bag counts, up to the naming of unnamed bags.

    Fixed values: batches, sites, dates, bags and counts of the individual corrections.
    """
    value = F.col("value")
    day = lambda text: F.lit(text).cast("date")
    keys = lambda year, cls=None, **sites: Rule("seed", campaign=year, class_age=cls, **sites)
    return [
        _delete(_n0(1995), "GEFOS"),
        ZeroFill(),
        # more alive than dead counts
        _delete(_j1(2008), "CANCA"),
        _delete(_n0(2008), "AGNAS"),
        _delete(_n0(2008), "LOIXR"),
        _delete(_j1(2009), "MARSE", bag=_BAG_NULL),
        _delete(_n0(2009), "MARSE", bag=_BAG_NULL),
        _delete(_j1(2010), "BLAIN", bag=_BAG_NULL),
        _delete(_j1(2010), "BLAIN", param=DEAD, bag=_NOT_1, after="2010-06-16"),
        _delete(_n0(2010), "AGNAS", bag=_NOT_1),
        _delete(_n0(2010), "LETES", bag=_NOT_1),
        _delete(_n0(2011), "BLAIN", "AGNAS", "GEFOS", "LARMO", "LOIXR", bag=_NOT_1),
        _delete(_j1(2012), "MARSE", param=ALIVE, on=("2012-02-21",)),
        Rule("copy", batch=_j1(2012), site=("MARSE",), param=ALIVE, on=("2012-03-09",),
             sets=({"value": 50.0, "date": "2012-02-21"},)),
        _delete(_j1(2012), "MARSE", param=TOTAL, on=("2012-02-21",)),
        Rule("copy", batch=_j1(2012), site=("MARSE",), param=ALIVE, bag=_bag("6"), on=("2012-11-12",),
             sets=({"value": 0.0, "code_param": DEAD},)),
        _delete(_j1(2013), "GEFOS", bag=_BAG_NULL),
        _delete(_j1(2013), "MORLX", param=DEAD, bag=_NOT_1, after="2013-09-06"),
        _delete(_n0(2013), "GEFOS", bag=_BAG_NULL),
        _delete(_n0(2014), "MORLX", param=ALIVE, bag=_bag("1"), on=("2014-05-26",), values=(282.0,)),
        _delete(_n0(2014), "MORLX", param=TOTAL, on=("2014-05-26",)),
        Rule("copy", batch=_n0(2014), site=("MORLX",), param=ALIVE, on=("2014-03-18",),
             sets=({"id_ind": "2"}, {"id_ind": "3"})),
        # more dead than alive counts, spat
        Rule("replace", batch=_n0(2008), site=("COUPE",), param=ALIVE, bag=_bag("1"),
             sets=({"id_ind": F.lit(None).cast("string")},)),
        _delete(_n0(2008), "COUPE", bag=_bag("1")),
        Rule("delete", batch=_n0(2008), bag=_bag("1"), not_values=(43.0, 2.0)),
        _delete(_n0(2008), "BREST", param=DEAD, bag=_BAG_NULL, on=("2008-08-29", "2008-12-12")),
        Rule("update", batch=_n0(2008), site=("BREST",), bag=_bag("1"), sets=({"id_ind": F.lit(None).cast("string")},)),
        _delete(_n0(2009), "BLAIN", "CANCA", bag=_NOT_1),
        _delete(_n0(2010), "CANCA", "GEFOS", bag=(NOT_IN_OR_UNNAMED, ("1",))),
        _delete(_n0(2011), "PENRF", bag=_NOT_1),
        Rule("replace", batch=_n0(2012), site=("MARSE",), param=ALIVE, on=("2012-02-21",),
             sets=tuple({"id_ind": str(i), "value": F.when(value == 300, F.lit(50.0)).otherwise(value)}
                        for i in range(1, 7))),
        Rule("copy", campaign=2014, class_age="N0", not_site=("MORLX",), param=DEAD, bag=_NOT_1, on=("2014-03-18",),
             sets=({"code_param": ALIVE, "value": 300.0},)),
        # more dead than alive counts, half-grown
        _delete(_j1(2008), "GEFOS", bag=_bag("1")),
        Rule("replace", batch=_j1(2008), site=("BREST",), param=ALIVE, bag=_BAG_NULL, first_day=True,
             sets=({"id_ind": "1"}, {"id_ind": "2"}, {"id_ind": "3"})),
        _delete(_j1(2008), "BREST", param=DEAD, bag=_bag("3"), after="2008-07-22"),
        _delete(_j1(2009), "MARSE", param=ALIVE, on=("2009-03-09",)),
        Rule("copy", batch=_j1(2009), site=("MARSE",), param=ALIVE, on=("2009-03-20",), sets=({"date": "2009-03-09"},)),
        SeedFill((
            seed_where([keys(2011, "J1", site=("PENRF", "BLAIN"))], day("2011-03-17"), later_only=True, with_dead=False),
            seed_where([keys(2012, "J1", not_site=("MARSE",))], day("2012-02-21"), later_only=True, with_dead=False),
        )),
        Rule("delete", batch=_j1(2014), site=("MORLX",), on=("2014-05-26",), below=10.0),
        _delete(_j1(2014), "MORLX", param=TOTAL, on=("2014-05-26",)),
        Rule("copy", campaign=2014, class_age="J1", param=DEAD, bag=_NOT_1, on=("2014-03-18",),
             sets=({"code_param": ALIVE, "value": 300.0},)),
        # bags that come and go
        _delete(_n0(2009), "MORLX", "PENRF", "GEFOS", bag=_bag("2", "3")),
        _delete(_n0(2009), "COUPE", param=DEAD, bag=_NOT_1),
        _delete(_n0(2009), "LOIXR", param=DEAD, bag=_bag("3"), after="2009-06-10"),
        _delete(_n0(2009), "LETES", param=DEAD, bag=_NOT_1, after="2009-06-08"),
        _delete(_n0(2010), "BLAIN", "LOIXR", param=DEAD, bag=_NOT_1),
        _delete(_n0(2010), "BREST", param=DEAD, bag=_NOT_1, after="2010-05-25"),
        _delete(_n0(2011), "BREST", param=DEAD, bag=_NOT_1, after="2011-08-12"),
        _delete(_n0(2011), "CANCA", "COUPE", "LETES", "MORLX", bag=_NOT_1),
        _delete(_j1(2011), "CANCA", param=DEAD, bag=(NAMED_NOT_IN, ("3",)), after="2011-06-02"),
        _delete(_j1(2012), "CANCA", param=DEAD, bag=_NOT_1, after="2012-06-21"),
        _delete(_j1(2013), "LOIXR", param=DEAD, bag=_NOT_1, after="2013-10-09"),
        _delete(("2015_J1_HATCH_2n_E4",), "CANCA", param=DEAD, bag=_NOT_1, after="2015-07-03"),
        # seed days
        Rule("copy", campaign=2005, class_age="J1", site=("LARMO",), param=ALIVE, on=("2005-06-23",),
             sets=({"value": 220.0, "date": "2005-04-01"},)),
        Rule("copy", campaign=2005, class_age="J1", site=("LARMO",), param=DEAD, on=("2005-06-23",),
             sets=({"value": 0.0, "date": "2005-04-01"},)),
        Rule("copy", class_age="N0", site=("COUPE",), not_param=TOTAL, on=("2005-06-24",), sets=({"date": "2005-03-24"},)),
        SeedFill((
            seed_where([keys(2009, "N0", not_site=("QUIBE",))], day("2009-03-09")),
            seed_where([keys(2010)], F.when(F.col("class_age") == "N0", day("2010-03-29")).otherwise(day("2010-03-14"))),
            seed_where([keys(2011, "N0", not_site=("PENRF",)), keys(2011, "J1", not_site=("BLAIN", "PENRF"))], day("2011-03-17")),
        )),
        Rule("update", bag=_BAG_NULL, sets=({"id_ind": "unidentified"},)),
    ]


def told_by_batch(batch: str) -> dict:
    """Campaign and class, which every batch code begins with."""
    return {"campaign": int(batch[:4]), "class_age": batch[5:7]}


def mass_corrections() -> list[Step]:
    """Steps on the bag masses. Fixed values as above."""
    hatched = "{}_{}_HATCH_2n_E4".format
    return [
        Rule("delete", campaign_before=2009, param=TOTAL),
        _delete(_n0(2011), "LOIXR", param=TOTAL, on=("2011-11-23",)),
        _delete(_n0(2011), "MORLX", on=("2011-11-23",)),
        _delete(_n0(2011), "BREST", param=TOTAL, bag=_bag("3"), on=("2011-11-25",)),
        _delete((hatched(2015, "N0"),), "LOIXR", bag=_bag("3"), on=("2015-12-14",)),
        _delete((hatched(2015, "N0"),), "LOIXR", param=TOTAL, bag=_bag("2"), on=("2015-12-14",)),
        _delete((hatched(2017, "N0"), hatched(2018, "N0")), "AGNAS", param=TOTAL, bag=_bag("1"),
                on=("2017-12-04", "2018-12-07")),
        _delete(_n0(2009), "LOIXR", param=TOTAL, on=("2009-08-24",)),
        Rule("delete", class_age="J1", site=("COUPE",), param=TOTAL, on=("2009-08-18", "2009-09-17")),
        Rule("replace", batch=_j1(2010), site=("GEFOS",), param=TOTAL, bag=_bag("2"), on=("2010-07-12",),
             sets=({"value": 10500.0},)),
        _delete(_j1(2012), "MARSE", param=DEAD, bag=_bag("4", "6"), after="2012-05-21"),
        _delete(_j1(2012), "MARSE", param=ALIVE, bag=_bag("4", "6"), on=("2012-06-04",)),
        _delete(_j1(2014), "MORLX", bag=_bag("3"), on=("2014-12-08",)),
        Rule("replace", batch=(hatched(2016, "J1"),), site=("BLAIN",), param=ALIVE, bag=_bag("2"), on=("2016-12-01",),
             sets=({"value": 238.0},)),
    ]


def empty_visits() -> list[Step]:
    """Visits with neither dead nor alive. Fixed values as above."""
    return [
        _delete(_j1(2011), "MARSE", bag=_bag("1"), on=("2011-09-26", "2011-09-13")),
        _delete(_j1(2009), "MARSE", bag=_bag("5"), on=("2009-06-23",)),
    ]
