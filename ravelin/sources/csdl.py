"""Metadata documents: written from an entity model, and read into one (XML and JSON)."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ravelin.errors import bad
from ravelin.sources.model import EntityModel, EntitySet, Enum, Loader, Nav

EDM = "http://docs.oasis-open.org/odata/ns/edm"
EDMX = "http://docs.oasis-open.org/odata/ns/edmx"
# Primitive types on both sides.
TO_EDM = {
    "boolean": "Edm.Boolean", "tinyint": "Edm.SByte", "smallint": "Edm.Int16", "int": "Edm.Int32", "bigint": "Edm.Int64", "float": "Edm.Single", "double": "Edm.Double", "string": "Edm.String",
    "binary": "Edm.Binary", "date": "Edm.Date", "timestamp": "Edm.DateTimeOffset", "timestamp_ntz": "Edm.DateTimeOffset", "variant": "Edm.Untyped",
}
FROM_EDM = {
    "Edm.Boolean": T.BooleanType(), "Edm.Byte": T.ShortType(), "Edm.SByte": T.ByteType(), "Edm.Int16": T.ShortType(), "Edm.Int32": T.IntegerType(), "Edm.Int64": T.LongType(), "Edm.Single": T.FloatType(), "Edm.Double": T.DoubleType(),
    "Edm.String": T.StringType(), "Edm.Guid": T.StringType(), "Edm.TimeOfDay": T.StringType(), "Edm.Duration": T.DoubleType(), "Edm.Binary": T.BinaryType(), "Edm.Stream": T.BinaryType(), "Edm.Date": T.DateType(), "Edm.DateTimeOffset": T.TimestampNTZType(), "Edm.Untyped": T.StringType(),
}


def edm_type(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"Collection({edm_type(kind.elementType)})"
    if isinstance(kind, T.DecimalType):
        return "Edm.Decimal"
    return TO_EDM.get(kind.simpleString(), "Edm.Untyped")


def metadata(spark: SparkSession, model: EntityModel) -> dict:
    """The JSON document; types come from the loaders' schemas."""
    types: dict = {}
    container: dict = {"$Kind": "EntityContainer"}
    for s in model.sets.values():
        entity: dict = {"$Kind": "EntityType", "$Key": list(s.key)}
        for f in s.load(spark).schema.fields:
            if f.name == s.type_column:
                continue
            p: dict = {"$Type": edm_type(f.dataType), "$Nullable": f.name not in s.key}
            if isinstance(f.dataType, T.DecimalType):
                p |= {"$Precision": f.dataType.precision, "$Scale": f.dataType.scale}
            entity[f.name] = p
        for n in s.navs:
            target = f"{model.namespace}.{model.set(n.target).type_name}"
            entity[n.name] = {"$Kind": "NavigationProperty", "$Type": target} | ({"$Collection": True} if n.many else {"$Nullable": True}) | ({} if n.bridge else {"$ReferentialConstraint": {a: b for a, b in n.on}})
        types.setdefault(s.type_name, entity)
        container[s.name] = {"$Collection": True, "$Type": f"{model.namespace}.{s.type_name}", "$NavigationPropertyBinding": {n.name: n.target for n in s.navs}}
    for name, e in model.enums.items():
        types[name] = {"$Kind": "EnumType", "$IsFlags": e.flags} | dict(e.members)
    return {"$Version": "4.01", "$EntityContainer": f"{model.namespace}.Container", model.namespace: types | {"Container": container}}


def to_xml(document: dict) -> str:
    """The XML form of a JSON document."""
    root = ET.Element(f"{{{EDMX}}}Edmx", {"Version": document["$Version"]})
    services = ET.SubElement(root, f"{{{EDMX}}}DataServices")
    for namespace, types in document.items():
        if namespace.startswith("$"):
            continue
        schema = ET.SubElement(services, f"{{{EDM}}}Schema", {"Namespace": namespace})
        for name, t in types.items():
            kind = t["$Kind"]
            node = ET.SubElement(schema, f"{{{EDM}}}{kind}", {"Name": name} | ({"IsFlags": "true"} if t.get("$IsFlags") else {}))
            if t.get("$Key"):
                keys = ET.SubElement(node, f"{{{EDM}}}Key")
                for k in t["$Key"]:
                    ET.SubElement(keys, f"{{{EDM}}}PropertyRef", {"Name": k})
            for m, p in t.items():
                if m.startswith("$"):
                    continue
                if kind == "EnumType":
                    ET.SubElement(node, f"{{{EDM}}}Member", {"Name": m, "Value": str(p)})
                elif kind == "EntityContainer":
                    e = ET.SubElement(node, f"{{{EDM}}}EntitySet", {"Name": m, "EntityType": p["$Type"]})
                    for path, target in p["$NavigationPropertyBinding"].items():
                        ET.SubElement(e, f"{{{EDM}}}NavigationPropertyBinding", {"Path": path, "Target": target})
                elif p.get("$Kind") == "NavigationProperty":
                    e = ET.SubElement(node, f"{{{EDM}}}NavigationProperty", {"Name": m, "Type": f"Collection({p['$Type']})" if p.get("$Collection") else p["$Type"]})
                    for a, b in p.get("$ReferentialConstraint", {}).items():
                        ET.SubElement(e, f"{{{EDM}}}ReferentialConstraint", {"Property": a, "ReferencedProperty": b})
                else:
                    extra = {k[1:]: str(p[k]) for k in ("$Precision", "$Scale") if k in p}
                    ET.SubElement(node, f"{{{EDM}}}Property", {"Name": m, "Type": p["$Type"], "Nullable": str(p["$Nullable"]).lower()} | extra)
    return ET.tostring(root, encoding="unicode")


def from_xml(text: str) -> dict:
    """The JSON form of an XML document."""
    root = ET.fromstring(text)
    out: dict = {"$Version": root.get("Version", "4.0")}
    for schema in root.iter(f"{{{EDM}}}Schema"):
        namespace, types = schema.get("Namespace", ""), {}
        for node in schema:
            kind, name = node.tag.rpartition("}")[2], node.get("Name", "")
            if kind not in ("EntityType", "ComplexType", "EnumType", "EntityContainer"):
                continue
            t: dict = {"$Kind": kind}
            if kind in ("EntityType", "ComplexType"):
                t["$Key"] = [r.get("Name") for r in node.iter(f"{{{EDM}}}PropertyRef")]
                if node.get("BaseType"):
                    t["$BaseType"] = node.get("BaseType")
            if kind == "EnumType":
                t["$IsFlags"] = node.get("IsFlags") == "true"
            for i, m in enumerate(x for x in node if x.get("Name")):
                tag, label = m.tag.rpartition("}")[2], m.get("Name", "")
                if tag == "Member":
                    t[label] = int(m.get("Value", i))
                elif tag == "EntitySet":
                    t[label] = {"$Collection": True, "$Type": m.get("EntityType"), "$NavigationPropertyBinding": {b.get("Path"): b.get("Target") for b in m}}
                elif tag == "NavigationProperty":
                    many = m.get("Type", "").startswith("Collection(")
                    t[label] = {"$Kind": tag, "$Type": m.get("Type", "")[11:-1] if many else m.get("Type")} | ({"$Collection": True} if many else {"$Nullable": True})
                    refs = {r.get("Property"): r.get("ReferencedProperty") for r in m.iter(f"{{{EDM}}}ReferentialConstraint")}
                    if refs:
                        t[label]["$ReferentialConstraint"] = refs
                elif tag == "Property":
                    t[label] = {"$Type": m.get("Type", "Edm.String"), "$Nullable": m.get("Nullable", "true") == "true"} | {f"${k}": int(m.get(k, "0")) for k in ("Precision", "Scale") if (m.get(k) or "").isdigit()}
            if kind == "EntityContainer":
                out["$EntityContainer"] = f"{namespace}.{name}"
            types[name] = t
        out[namespace] = types
    return out


def spark_type(p: dict, document: dict) -> T.DataType:
    name = p["$Type"]
    if name.startswith("Collection("):
        return T.ArrayType(spark_type({"$Type": name[11:-1]}, document))
    if name == "Edm.Decimal":
        return T.DecimalType(p.get("$Precision", 38), p.get("$Scale", 10))
    if name.startswith(("Edm.Geography", "Edm.Geometry")):
        raise bad("geospatial types are not supported")
    if name in FROM_EDM:
        return FROM_EDM[name]
    namespace, _, short = name.rpartition(".")
    t = document.get(namespace, {}).get(short)
    if t is None:
        raise bad(f"unknown type {name}")
    return T.LongType() if t["$Kind"] == "EnumType" else schema_of(t, document)


def schema_of(t: dict, document: dict) -> T.StructType:
    fields = []
    if t.get("$BaseType"):
        namespace, _, short = t["$BaseType"].rpartition(".")
        fields += schema_of(document[namespace][short], document).fields
    fields += [T.StructField(n, spark_type(p, document), p.get("$Nullable", True)) for n, p in t.items() if not n.startswith("$") and p.get("$Kind") != "NavigationProperty"]
    return T.StructType(fields)


def model_of(document: dict | str, loaders: dict[str, Loader]) -> EntityModel:
    """An entity model of a document (dict, JSON or XML), with a loader for each set."""
    if isinstance(document, str):
        document = from_xml(document) if document.lstrip().startswith("<") else json.loads(document)
    namespace, _, container = document["$EntityContainer"].rpartition(".")
    types = document[namespace]
    model = EntityModel(namespace=namespace)
    for name, t in types.items():
        if t["$Kind"] == "EnumType":
            model.enums[name] = Enum(tuple((k, v) for k, v in t.items() if not k.startswith("$")), t.get("$IsFlags", False))
    for name, s in types[container].items():
        if name.startswith("$"):
            continue
        short = s["$Type"].rpartition(".")[2]
        t = types[short]
        navs = []
        for n, p in t.items():
            if n.startswith("$") or p.get("$Kind") != "NavigationProperty" or n not in s["$NavigationPropertyBinding"]:
                continue
            refs = tuple(p.get("$ReferentialConstraint", {}).items())
            if refs:
                navs.append(Nav(n, s["$NavigationPropertyBinding"][n], refs, bool(p.get("$Collection"))))
        if name in loaders:
            model.add(EntitySet(name, short, tuple(t.get("$Key", ())), loaders[name], tuple(navs)))
    return model
