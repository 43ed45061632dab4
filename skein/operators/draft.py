"""Drafting of new entries, checked for duplicates."""

from __future__ import annotations

import json
import uuid as uuids
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIKELIHOODS
from ..functions.folding import STANDARD, fold, tag
from ..plans.graph import Graph
from .fuzzy import fuzzy


@dataclass(frozen=True)
class Draft:
    """A wished entry. used_by is the uuid of an actor; confidence one of LIKELIHOODS, likely if blank."""

    name: str
    galaxy: str
    description: str = ""
    refs: tuple[str, ...] = ()
    date: str = ""
    used_by: str = ""
    confidence: str = ""


def exact_collisions(graph: Graph, names: DataFrame) -> DataFrame:
    """name, uuid, tag, value, galaxy, matched_via: entries in any galaxy that bear one of names (name) already."""
    keyed = names.select("name", fold(F.col("name")).alias("key")).filter("key <> ''")
    hits = graph.index(STANDARD, keyed.select(F.char_length("key").alias("length"))).join(keyed, "key").select("name", "uuid", F.col("matched").alias("matched_via"))
    rows = hits.join(graph.node_columns(), "uuid")
    return rows.select("name", "uuid", tag(graph.config.namespace, F.col("galaxy"), F.col("value")).alias("tag"), "value", "galaxy", "matched_via")


def draft(graph: Graph, wish: Draft) -> dict:
    """name, galaxy, refused, exact, near, entry and note.

    A name that an entry bears, in any galaxy, is refused; names only near
    are reported. Wrong input raises ValueError.
    """
    name, galaxy = wish.name.strip(), wish.galaxy.strip()
    if not name:
        raise ValueError("a name is required")
    if not galaxy:
        raise ValueError("a target galaxy is required")
    held = graph.galaxies.filter("nodes > 0").filter(F.lower("type") == galaxy.lower()).orderBy("type").first()
    if held is None:
        raise ValueError(f"no galaxy {galaxy!r} in this corpus")
    out = {"name": name, "galaxy": held["type"], "refused": False, "exact": [], "near": [], "entry": None}
    out["exact"] = [r.asDict() for r in exact_collisions(graph, graph.spark.createDataFrame([(name,)], "name string")).drop("name").orderBy("uuid").collect()]
    if out["exact"]:
        return out | {"refused": True, "note": "an entry of this name exists; if yours is something else, say so where you propose it"}
    near = fuzzy(graph, name, limit=10).orderBy("rank").collect()
    out["near"] = [{"uuid": r["uuid"], "tag": r["tag"], "value": r["value"], "galaxy": r["galaxy"], "matched_via": r["matched"], "similarity": r["similarity"]} for r in near]
    meta = ({"date": wish.date} if wish.date else {}) | ({"refs": list(wish.refs)} if wish.refs else {})
    entry = {"description": wish.description.strip(), "meta": meta, "uuid": str(uuids.uuid4()), "value": name}
    if used_by := wish.used_by.strip():
        entry["related"] = [_relation(graph, used_by, wish.confidence.strip() or "likely")]
    note = "the name is new, but similar ones exist: be ready to say why this is none of them" if near else "the name is new" + ("" if "related" in entry else "; no relation was declared")
    return out | {"entry": {k: entry[k] for k in sorted(entry)}, "note": note}


def _relation(graph: Graph, used_by: str, confidence: str) -> dict:
    target = graph.plain_nodes.filter(F.col("uuid") == used_by).select("dangling", "is_actor", "galaxy").first()
    if target is None:
        raise ValueError(f"no entry with uuid {used_by} to link to")
    if target["dangling"]:
        raise ValueError(f"{used_by} is named by relations, but not defined")
    if not target["is_actor"]:
        raise ValueError(f"{used_by} is in galaxy {target['galaxy']!r}, which holds no actors")
    if confidence not in LIKELIHOODS:
        raise ValueError(f"unknown confidence {confidence!r}; use one of {', '.join(LIKELIHOODS)}")
    return {"dest-uuid": used_by, "tags": [f'estimative-language:likelihood-probability="{confidence}"'], "type": "used-by"}


def render(entry: dict | None) -> str:
    """An entry as a corpus file shows it inside its values: two more blanks a level, four before each line but the first, and <, > and & escaped."""
    if entry is None:
        return ""
    text = json.dumps(entry, indent=2, ensure_ascii=False).replace("\n", "\n    ")
    for c in ("<", ">", "&", chr(0x2028), chr(0x2029)):
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text
