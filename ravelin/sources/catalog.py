"""The entity model of the TPC-H-like test tables, with wire names for columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.sources.model import EntityModel, EntitySet, Hierarchy, Loader, Nav, Timeline

# table: (set, type, key, column prefix)
TABLES = {
    "region": ("Regions", "Region", ("Regionkey",), "r_"),
    "nation": ("Nations", "Nation", ("Nationkey",), "n_"),
    "customer": ("Customers", "Customer", ("Custkey",), "c_"),
    "supplier": ("Suppliers", "Supplier", ("Suppkey",), "s_"),
    "part": ("Parts", "Part", ("Partkey",), "p_"),
    "orders": ("Orders", "Order", ("Orderkey",), "o_"),
    "lineitem": ("Lineitems", "Lineitem", (), "l_"),
    "events": ("Events", "Event", ("EventId",), ""),
    "documents": ("Documents", "Document", ("DocId",), ""),
    "labels": ("Labels", "Label", ("DocId",), ""),
    "pages": ("Pages", "Page", ("PageId",), ""),
    "benchmark": ("Benchmark", "Item", ("ItemId",), ""),
    "conversations": ("Conversations", "Turn", ("ConvId", "Turn"), ""),
    "embeddings": ("Embeddings", "Vector", ("VecId",), ""),
}
NAVS = {
    "Regions": (Nav("Nations", "Nations", (("Regionkey", "Regionkey"),), True),),
    "Nations": (
        Nav("Region", "Regions", (("Regionkey", "Regionkey"),)),
        Nav("Customers", "Customers", (("Nationkey", "Nationkey"),), True),
        Nav("Suppliers", "Suppliers", (("Nationkey", "Nationkey"),), True),
    ),
    "Customers": (Nav("Nation", "Nations", (("Nationkey", "Nationkey"),)), Nav("Orders", "Orders", (("Custkey", "Custkey"),), True)),
    "Suppliers": (Nav("Nation", "Nations", (("Nationkey", "Nationkey"),)), Nav("Items", "Lineitems", (("Suppkey", "Suppkey"),), True)),
    "Parts": (Nav("Items", "Lineitems", (("Partkey", "Partkey"),), True),),
    "Orders": (Nav("Customer", "Customers", (("Custkey", "Custkey"),)), Nav("Items", "Lineitems", (("Orderkey", "Orderkey"),), True)),
    "Lineitems": (
        Nav("Order", "Orders", (("Orderkey", "Orderkey"),)),
        Nav("Part", "Parts", (("Partkey", "Partkey"),)),
        Nav("Supplier", "Suppliers", (("Suppkey", "Suppkey"),)),
    ),
    "Documents": (Nav("Label", "Labels", (("DocId", "DocId"),)),),
}


def wire_name(column: str, prefix: str = "") -> str:
    bare = column[len(prefix) :] if prefix and column.startswith(prefix) else column
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"_+", bare) if p)


def parquet_loader(sf_dir: str, table: str, prefix: str) -> Loader:
    def load(spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
        return df.select(*[F.col(c).alias(wire_name(c, prefix)) for c in df.columns])

    return load


def table_model(sf_dir: str) -> EntityModel:
    """All sets over the Parquet tables of a folder."""
    model = EntityModel(namespace="Tables")
    for table, (name, kind, key, prefix) in TABLES.items():
        model.add(EntitySet(name, kind, key, parquet_loader(sf_dir, table, prefix), NAVS.get(name, ())))
    lines, parts = model.sets["Lineitems"].load, model.sets["Parts"]
    bridge = lambda spark: lines(spark).select("Partkey", "Suppkey").distinct()
    parts.navs += (Nav("Suppliers", "Suppliers", (("Partkey", "Partkey"),), True, bridge, (("Suppkey", "Suppkey"),)),)
    suppliers = model.sets["Suppliers"]
    suppliers.navs += (Nav("Parts", "Parts", (("Suppkey", "Suppkey"),), True, bridge, (("Partkey", "Partkey"),)),)
    bare = parts.load

    def tree(spark: SparkSession) -> DataFrame:
        df = bare(spark)
        parent = F.when(F.col("Partkey") > 1, F.floor(F.col("Partkey") / 2).cast("long"))
        return df.withColumn("ParentPartkey", parent)

    parts.load = tree
    parts.navs += (Nav("ParentPart", "Parts", (("ParentPartkey", "Partkey"),)), Nav("SubParts", "Parts", (("Partkey", "ParentPartkey"),), True))
    parts.hierarchies["PartTree"] = Hierarchy("Partkey", "ParentPartkey")
    events = model.sets["Events"]
    events.dynamic = "Props"

    def states(spark: SparkSession) -> DataFrame:
        """Slices of each user's state: from an event until that user's next one."""
        df = events.load(spark)
        to = F.lead("Ts").over(Window.partitionBy("UserId").orderBy("Ts", "EventId"))
        return df.select("EventId", "UserId", "EventType", "Value", F.col("Ts").alias("ValidFrom"), to.alias("ValidTo"))

    model.add(EntitySet("UserStates", "UserState", ("EventId",), states, timeline=Timeline(("UserId",), "ValidFrom", "ValidTo")))
    return model
