"""Tree texts: Newick, Nexus with annotations, and nested documents, as node records."""

from __future__ import annotations

import datetime as dt
import re

_TOKEN = re.compile(r"""\[&?[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]]+""")


def parse_newick(text: str, least_tips: int = 3) -> list[dict]:
    """Records (name, parent, branch_length, comment); unnamed inner nodes get numbers."""
    records: list[dict] = []
    stack: list[dict] = []
    fresh = lambda parent: {"name": None, "parent": parent, "branch_length": 0.0, "comment": "", "inner": False}
    node = fresh(None)
    records.append(node)
    length_next = False
    for token in _TOKEN.findall(text):
        if token == "(":
            node["inner"] = True
            stack.append(node)
            node = fresh(stack[-1])
            records.append(node)
        elif token == ",":
            if not stack:
                raise ValueError("a comma outside of parentheses")
            node = fresh(stack[-1])
            records.append(node)
        elif token == ")":
            if not stack:
                raise ValueError("too many closing parentheses")
            node = stack.pop()
        elif token == ":":
            length_next = True
        elif token == ";":
            break
        elif token[0] == "[":
            node["comment"] += token[1:-1]
        elif length_next:
            node["branch_length"], length_next = float(token), False
        else:
            node["name"] = token[1:-1].replace("''", "'") if token[0] == "'" else token
    if stack:
        raise ValueError("too few closing parentheses")
    if sum(not r["inner"] for r in records) < least_tips:
        raise ValueError(f"a tree needs at least {least_tips} tips")
    taken, number = {r["name"] for r in records}, 0
    for r in records:
        if r["name"] is None:
            while f"NODE_{number:07d}" in taken:
                number += 1
            r["name"] = f"NODE_{number:07d}"
            taken.add(r["name"])
    return [{"name": r["name"], "parent": r["parent"]["name"] if r["parent"] else None, "branch_length": r["branch_length"], "comment": r["comment"]} for r in records]


def parse_nexus(text: str, least_tips: int = 3) -> list[dict]:
    """Records of the first tree of a Nexus text, names translated, with ``traits``."""
    table = {}
    block = re.search(r"(?is)\btranslate\b(.*?);", text)
    if block:
        for entry in block[1].split(","):
            key, _, name = entry.strip().partition(" ")
            table[key] = name.strip().strip("'")
    found = re.search(r"(?is)\btree\b[^=]*=\s*(?:\[&[RU]\]\s*)?(.*?;)\s*$", text, re.MULTILINE)
    if not found:
        raise ValueError("no tree in the Nexus text")
    records = parse_newick(found[1], least_tips)
    for r in records:
        r["traits"] = parse_traits(r.pop("comment"))
        r["name"] = table.get(r["name"], r["name"])
        r["parent"] = table.get(r["parent"], r["parent"])
    return records


def parse_traits(comment: str) -> dict:
    """``&key=value`` pairs; numbers, quoted text, and ``{...}`` lists; a set with its
    probabilities becomes a confidence map, an HPD interval a confidence list."""
    out: dict = {}
    pairs = re.findall(r"""([^=,&]+)=(\{[^}]*\}|"[^"]*"|[^,]*)""", comment.lstrip("&"))
    for key, value in pairs:
        if value[:1] == "{":
            out[key] = [_value(v) for v in value[1:-1].split(",")]
        else:
            out[key] = _value(value)
    for key in [k for k in out if k.endswith(".set") or k.endswith("_range") or k == "range"]:
        if key.endswith(".set") and f"{key}.prob" in out:
            out[key[:-4] + "_confidence"] = dict(zip(out[key], out.pop(f"{key}.prob"), strict=False))
        out.pop(key)
    for key in [k for k in out if k.endswith("_95%_HPD")]:
        out[key[:-8] + "_confidence"] = out.pop(key)
    return out


def _value(text: str) -> float | str:
    text = text.strip().strip('"')
    try:
        return float(text)
    except ValueError:
        return text


def parse_tree(text: str, least_tips: int = 3) -> list[dict]:
    """Newick, or Nexus where the text says so."""
    return parse_nexus(text, least_tips) if text.lstrip()[:6].upper() == "#NEXUS" else parse_newick(text, least_tips)


def records_of_document(document: dict) -> list[dict]:
    """Records of a nested document (a ``tree`` inside, or the root itself); branch
    lengths are steps of the cumulative divergence."""
    root = document.get("tree", document)
    out, stack = [], [(root, None, 0.0)]
    while stack:
        item, parent, above = stack.pop()
        attrs = item.get("node_attrs", item.get("attr", {}))
        div = float(attrs.get("div", above)) if not isinstance(attrs.get("div"), dict) else float(attrs["div"]["value"])
        name = item.get("name", item.get("strain"))
        out.append({"name": name, "parent": parent, "branch_length": div - above if parent is not None else 0.0, "attrs": attrs})
        stack += [(child, name, div) for child in reversed(item.get("children", []))]
    return out


def write_newick(records: list[dict]) -> str:
    """Newick text of node records."""
    children: dict[str | None, list[dict]] = {}
    for r in records:
        children.setdefault(r["parent"], []).append(r)
    done: dict[str, str] = {}
    stack = [(children[None][0], False)]
    while stack:
        r, seen = stack.pop()
        own = children.get(r["name"], [])
        if own and not seen:
            stack.append((r, True))
            stack += [(c, False) for c in own]
            continue
        inner = "(" + ",".join(done.pop(c["name"]) for c in own) + ")" if own else ""
        done[r["name"]] = f"{inner}{r['name']}" + (f":{r['branch_length']:g}" if r["parent"] is not None else "")
    return done[children[None][0]["name"]] + ";"


def date_in_name(name: str, pattern: str = r"\d{4}(?:-\d{2}(?:-\d{2})?)?$") -> str | None:
    """The date that a tip's name ends in."""
    match = re.search(pattern, name)
    return match[0] if match else None


def decimal_date(text: str) -> float:
    """Decimal year by seconds of a date of year, year-month or year-month-day."""
    parts = [int(p) for p in text.split("-")]
    year, month, day = [*parts, *[1, 1][len(parts) - 1 :]][:3]
    start, end = dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    return year + (dt.datetime(year, month, day) - start).total_seconds() / (end - start).total_seconds()


def dated_by_root(records: list[dict], latest: float) -> dict[str, float]:
    """Dates of all nodes from distances to the root, the most recent tip at ``latest``."""
    at: dict[str, float] = {}
    by_name = {r["name"]: r for r in records}
    for r in records:
        line, node = [], r
        while node["name"] not in at and node["parent"] is not None:
            line.append(node)
            node = by_name[node["parent"]]
        base = at.setdefault(node["name"], 0.0)
        for step in reversed(line):
            base += step["branch_length"]
            at[step["name"]] = base
    most = max(at.values())
    return {name: latest - most + value for name, value in at.items()}
