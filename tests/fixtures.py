"""A small model rich in nulls: boats in a marina, their riggers, the crew, buoys and berth rates."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ravelin.sources.model import EntityModel, EntitySet, Enum, Hierarchy, Loader, Nav, Timeline

BOATS = [
    # Hull, Title, Rig, Length, Sold, HarbourId
    (1, "Heron", "sloop", 9.5, False, 10),
    (2, "heron II", "ketch", 14.25, False, 10),
    (3, "Osprey", None, 9.5, True, 20),
    (4, " Tern ", "sloop", None, None, 20),
    (5, "Gull", None, None, False, None),
    (6, "Skua", "yawl", 22.0, None, 30),
    (7, "Petrel", "cutter sloop", 7.0, True, None),
]
HARBOURS = [(10, "North Quay", "Ostend"), (20, "Mole", None), (30, "Basin", "Brest"), (40, "Empty Dock", "Brest")]
RIGGERS = [(100, "Aldo", "IT"), (200, "Berit", None), (300, "Cleo", "GR")]
RIGGED = [(1, 100), (1, 200), (2, 200), (3, 300), (6, 100), (6, 200), (6, 300)]
CREW = [
    (1, "Vera", "Skipper", 900, None, dt.datetime(2020, 2, 29, 12)),
    (2, "Wim", "Skipper", None, 1, dt.datetime(2021, 12, 31, 23, 45)),
    (3, "Xeno", "Hand", None, 1, dt.datetime(2022, 1, 1)),
    (4, "Yuki", "Hand", None, 2, None),
    (5, "Zora", "Hand", None, 2, dt.datetime(2022, 6, 15, 6, 30)),
]
BUOYS = [(1, 9, ["bell", None], [3, 7, 10]), (2, 2, [], [4]), (3, None, None, None), (4, 11, ["horn", "bell"], [5, None])]
RATES = [
    (1, "east", 40, dt.datetime(2023, 1, 1), dt.datetime(2023, 4, 1)),
    (2, "east", 60, dt.datetime(2023, 4, 1), dt.datetime(2023, 7, 1)),
    (3, "east", 75, dt.datetime(2023, 10, 1), None),
    (4, "west", 20, dt.datetime(2023, 1, 1), None),
]


def loaded(rows: list[tuple], schema: str) -> Loader:
    def load(spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(Decimal(str(x)) if isinstance(x, float) else x for x in r) for r in rows], schema)

    return load


def marina() -> EntityModel:
    model = EntityModel()
    bridge = loaded(RIGGED, "Hull int, RiggerId int")
    at_harbour, rigged_by = Nav("Harbour", "Harbours", (("HarbourId", "HarbourId"),)), Nav("Riggers", "Riggers", (("Hull", "Hull"),), True, bridge, (("RiggerId", "RiggerId"),))
    model.add(EntitySet("Boats", "Boat", ("Hull",), loaded(BOATS, "Hull int, Title string, Rig string, Length decimal(8,2), Sold boolean, HarbourId int"), (at_harbour, rigged_by)))
    model.add(EntitySet("Harbours", "Harbour", ("HarbourId",), loaded(HARBOURS, "HarbourId int, Label string, City string"), (Nav("Boats", "Boats", (("HarbourId", "HarbourId"),), True),)))
    model.add(EntitySet("Riggers", "Rigger", ("RiggerId",), loaded(RIGGERS, "RiggerId int, Name string, Country string"), (Nav("Boats", "Boats", (("RiggerId", "RiggerId"),), True, bridge, (("Hull", "Hull"),)),)))
    crew = EntitySet("Crew", "Hand", ("Id",), loaded(CREW, "Id int, Name string, Kind string, Pay int, BossId int, Joined timestamp_ntz"), (Nav("Boss", "Crew", (("BossId", "Id"),)), Nav("Reports", "Crew", (("Id", "BossId"),), True)))
    crew.type_column, crew.subtypes = "Kind", {"Hand": ("Hand", "Skipper"), "Skipper": ("Skipper",)}
    crew.hierarchies["Watch"] = Hierarchy("Id", "BossId")
    model.add(crew)
    model.enums["Lamps"] = Enum((("Red", 1), ("Green", 2), ("White", 8)), True)
    model.add(EntitySet("Buoys", "Buoy", ("Id",), loaded(BUOYS, "Id int, Lights int, Sounds array<string>, Depths array<int>")))
    model.add(EntitySet("Rates", "Rate", ("Id",), loaded(RATES, "Id int, Berth string, Amount int, Since timestamp_ntz, Until timestamp_ntz"), timeline=Timeline(("Berth",), "Since", "Until")))
    return model
