"""Export of a dataset document, its colourings, and checks of documents."""

from __future__ import annotations

from collections import Counter
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators import tree
from strandmill.operators.predicates import is_present
from strandmill.sources.writers import significant_of

#: Older attribute names and what they are now: fixed values.
RENAMED = {"authors": "author", "numdate": "num_date"}
#: Attributes with a place of their own in the document.
RESERVED = ("div", "num_date", "author", "url", "accession", "vaccine", "hidden")
DEFAULT_PANELS = ("tree", "map", "entropy")
LEAST_CONFIDENCE = 0.001


def node_attributes(nodes: DataFrame, metadata: DataFrame, data: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Tree nodes with attributes; node data override metadata, old names are corrected."""
    meta = metadata.select(F.col(id_column).alias("node"), *[F.col(c).alias(f"m_{RENAMED.get(c, c)}") for c in columns if c in metadata.columns and c != id_column])
    own = data.select("node", *[F.col(c).alias(f"d_{RENAMED.get(c, c)}") for c in data.columns if c != "node"])
    joined = nodes.select("node", "parent").join(meta, "node", "left").join(own, "node", "left")
    names = dict.fromkeys([c[2:] for c in (*own.columns[1:], *meta.columns[1:])])

    def value(name: str) -> Column:
        options = [F.col(f"`{p}{name}`").cast("string") for p in ("d_", "m_") if f"{p}{name}" in joined.columns]
        return F.coalesce(*[F.when(is_present(o), o) for o in options]).alias(name)

    return joined.select("node", "parent", *[value(n) for n in names])


def value_types(attributes: DataFrame, names: list[str]) -> dict[str, str]:
    """boolean, continuous or categorical by the values of each attribute: one aggregate."""
    checks = []
    for n in names:
        column = F.col(f"`{n}`")
        checks.append(F.coalesce(F.bool_and(F.lower(column).isin("true", "false", "yes", "no", "0", "1")), F.lit(False)).alias(f"b_{n}"))
        checks.append(F.coalesce(F.bool_and(F.when(column.isNotNull(), column.try_cast("double").isNotNull())), F.lit(False)).alias(f"n_{n}"))
    row = attributes.agg(*checks).first() if checks else None
    return {n: "continuous" if row[f"n_{n}"] and not row[f"b_{n}"] else "boolean" if row[f"b_{n}"] else "categorical" for n in names}


def value_sets(attributes: DataFrame, names: list[str]) -> DataFrame:
    """(attribute, value, n) over all nodes."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])).alias("p")
    return attributes.select(pairs).select("p.*").where("value is not null").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def colorings(attributes: DataFrame, names: list[str], titles: dict[str, str] | None = None, colors: dict[str, dict[str, str]] | None = None) -> list[dict]:
    """Colourings with key, title, type and, where colours are given, a scale."""
    kinds = value_types(attributes, names)
    present = {}
    if colors:
        for r in value_sets(attributes, [n for n in names if n.lower() in colors]).collect():
            present.setdefault(r["attribute"], []).append(r["value"])
    out = []
    for n in names:
        entry = {"key": n, "title": (titles or {}).get(n, n.replace("_", " ").title()), "type": kinds[n]}
        scale = [[v, (colors or {}).get(n.lower(), {})[v.lower()]] for v in sorted(present.get(n, [])) if v.lower() in (colors or {}).get(n.lower(), {})]
        if scale:
            entry["scale"] = scale
        out.append(entry)
    return out


def geo_resolutions(attributes: DataFrame, resolutions: list[str], places: dict[tuple[str, str], tuple[float, float]]) -> tuple[list[dict], list[tuple[str, str]]]:
    """(resolutions with coordinates of the values that occur, values without any)."""
    found: dict[str, dict] = {r: {} for r in resolutions}
    missing = []
    for r in value_sets(attributes, resolutions).orderBy("attribute", "value").collect():
        at = places.get((r["attribute"].lower(), r["value"].lower()))
        if at:
            found[r["attribute"]][r["value"]] = {"latitude": at[0], "longitude": at[1]}
        else:
            missing.append((r["attribute"], r["value"]))
    return [{"key": r, "demes": found[r]} for r in resolutions], missing


def is_url(text: str) -> bool:
    parts = urlparse(text)
    return bool(parts.scheme and parts.netloc)


def confidence_map(values: dict[str, float]) -> dict[str, float]:
    """States by falling probability, without those that hardly occur."""
    return {k: significant_of(v) for k, v in sorted(values.items(), key=lambda kv: -kv[1]) if v > LEAST_CONFIDENCE}


def export_document(nodes: DataFrame, attributes: DataFrame, meta: dict, mutations: dict[str, dict[str, list[str]]] | None = None, labels: dict[str, dict[str, str]] | None = None) -> dict:
    """The nested dataset document {version, meta, tree} of a tree that fits the driver."""
    div = {r["node"]: r["div"] for r in tree.cumulative_divergence(nodes).collect()}
    rows = nodes.select("node", "parent", "pre").join(attributes.drop("parent"), "node", "left").orderBy("pre").collect()
    out = []
    for row in rows:
        r = row.asDict()
        attrs: dict = {"div": significant_of(div[r["node"]], 4)}
        for name, value in r.items():
            if name in ("node", "parent", "pre") or value is None:
                continue
            if name == "num_date":
                attrs["num_date"] = {"value": float(value)}
            elif name == "url":
                if is_url(value):
                    attrs["url"] = value
            elif name in ("accession", "hidden"):
                attrs[name] = value
            else:
                attrs[name] = {"value": value}
        branch: dict = {}
        if mutations and mutations.get(r["node"]):
            branch["mutations"] = mutations[r["node"]]
            amino = [f"{g}: {', '.join(m)}" for g, m in mutations[r["node"]].items() if g != "nuc" and m]
            if amino:
                branch.setdefault("labels", {})["aa"] = "; ".join(amino)
        if labels and labels.get(r["node"]):
            branch.setdefault("labels", {}).update(labels[r["node"]])
        out.append({"node": r["node"], "parent": r["parent"], "node_attrs": attrs, "branch_attrs": branch})
    return {"version": "v2", "meta": {"panels": list(DEFAULT_PANELS)} | meta, "tree": tree.nested(out)}


def attribute_census(document: dict) -> dict[str, dict]:
    """Per attribute: on how many nodes it is and whether on all, with its values."""
    seen: dict[str, dict] = {}
    total = 0
    for item, _ in tree.descend(document["tree"]):
        total += 1
        for name, value in item.get("node_attrs", {}).items():
            entry = seen.setdefault(name, {"count": 0, "values": set()})
            entry["count"] += 1
            entry["values"].add(str(value["value"] if isinstance(value, dict) and "value" in value else value))
    return {name: entry | {"on_all_nodes": entry["count"] == total} for name, entry in seen.items()}


def document_errors(document: dict) -> list[str]:
    """Structure and consistency of a dataset document; empty if all is well."""
    errors = [f"lacks {part!r}" for part in ("version", "meta", "tree") if part not in document]
    if errors:
        return errors
    names = Counter(item.get("name") for item, _ in tree.descend(document["tree"]))
    errors += [f"node name {n!r} occurs {c} times" for n, c in names.items() if c > 1]
    seen = attribute_census(document)
    for coloring in document["meta"].get("colorings", []):
        key = coloring["key"]
        if key not in seen and key not in ("gt", "none"):
            errors.append(f"colouring {key!r} is on no node")
    for name in document["meta"].get("filters", []):
        if name not in seen:
            errors.append(f"filter {name!r} is on no node")
    for resolution in document["meta"].get("geo_resolutions", []):
        if resolution["key"] not in seen:
            errors.append(f"resolution {resolution['key']!r} is on no node")
        elif not resolution.get("demes"):
            errors.append(f"resolution {resolution['key']!r} has no coordinates")
    if "map" in document["meta"].get("panels", []) and not document["meta"].get("geo_resolutions"):
        errors.append("the map panel needs a resolution")
    for item, parent in tree.descend(document["tree"]):
        div, above = item.get("node_attrs", {}).get("div"), (parent or {}).get("node_attrs", {}).get("div")
        if div is not None and above is not None and div < above - 1e-9:
            errors.append(f"divergence falls at {item['name']!r}")
    return errors


def schema_errors(value, schema: dict, path: str = "") -> list[str]:
    """Violations of the common parts of a JSON schema: type, enum, required, properties,
    additionalProperties, items, minItems, pattern, minimum and maximum."""
    import re

    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    out = []
    wanted = schema.get("type")
    allowed = [wanted] if isinstance(wanted, str) else wanted or []
    if allowed and not any(isinstance(value, kinds[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in allowed):
        return [f"{path or '/'} is no {' or '.join(allowed)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path or '/'} is none of {schema['enum']}")
    if isinstance(value, dict):
        out += [f"{path or '/'} lacks {name!r}" for name in schema.get("required", []) if name not in value]
        known = schema.get("properties", {})
        for name, item in value.items():
            if name in known:
                out += schema_errors(item, known[name], f"{path}/{name}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path or '/'} has {name!r}, which is not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += schema_errors(item, schema["additionalProperties"], f"{path}/{name}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{path or '/'} has too few items")
        for i, item in enumerate(value):
            out += schema_errors(item, schema.get("items", {}), f"{path}/{i}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{path or '/'} does not match {schema['pattern']!r}")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{path or '/'} is out of range")
    return out


def measurement_collection(df: DataFrame, key: str, title: str, groupings: list[str], x_axis: str, columns: list[str] | None = None) -> dict:
    """A collection document of measurements with strain and value."""
    missing = [c for c in ("strain", "value", *groupings) if c not in df.columns]
    if missing:
        raise ValueError(f"measurements lack {missing}")
    keep = dict.fromkeys(["strain", "value", *(columns or df.columns)])
    rows = [r.asDict() for r in df.select(*keep).collect()]
    collection = {"key": key, "title": title, "groupings": [{"key": g} for g in groupings], "x_axis_label": x_axis, "measurements": rows}
    errors = collection_errors(collection)
    if errors:
        raise ValueError("; ".join(errors))
    return collection


def collection_errors(collection: dict) -> list[str]:
    """Groupings, filters and display defaults must name fields of the measurements."""
    fields = set().union(*[m.keys() for m in collection["measurements"]]) if collection["measurements"] else set()
    errors = [f"grouping {g['key']!r} is no field" for g in collection.get("groupings", []) if g["key"] not in fields]
    errors += [f"filter {f!r} is no field" for f in collection.get("filters", []) if f not in fields]
    shown = collection.get("display_defaults", {}).get("group_by")
    if shown and shown not in [g["key"] for g in collection.get("groupings", [])]:
        errors.append(f"default grouping {shown!r} is none of the groupings")
    return errors


def concatenated(collections: list[dict], default: str | None = None) -> dict:
    """One document of collections, whose keys must differ."""
    keys = Counter(c["key"] for c in collections)
    repeated = [k for k, n in keys.items() if n > 1]
    if repeated:
        raise ValueError(f"collection keys are repeated: {repeated}")
    if default is not None and default not in keys:
        raise ValueError(f"default collection {default!r} does not exist")
    return ({"default_collection": default} if default else {}) | {"collections": collections}
