"""The engine: a graph with defaults, validation and notes, one method a query.

Methods return plain dicts and lists, as a caller shows them; the operators
below give the DataFrames.
"""

from __future__ import annotations

import json
import math
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CO_OCCURRENCE_RATE, MIN_CO_OCCURRENCE_ACTORS, SCOPE_ALL, Config
from .functions.folding import parse_mode
from .functions.similarity import FUZZY_THRESHOLD
from .operators import analytics, draft, fuzzy, paths, refs, resolve, traverse
from .plans.graph import Graph
from .sources import corpus, snapshots


class NotLoaded(RuntimeError):
    """No graph was loaded yet."""


class UnknownNode(ValueError):
    """No node has this uuid."""


def normalise_scope(names: list[str] | None) -> list[str] | None:
    """Galaxies to search, trimmed; None, which means all, for the single name ``all`` and for nothing but blanks."""
    if names and len(names) == 1 and names[0].strip().lower() == SCOPE_ALL:
        return None
    return [n.strip() for n in names or [] if n.strip()] or None


def share(value: float | None, default: float, name: str) -> float:
    """A number from 0 to 1; None means the default."""
    if value is None:
        return default
    if math.isnan(value) or not 0 <= value <= 1:
        raise ValueError(f"{name} must be a number between 0 and 1 (got {value})")
    return value


def _rows(df: DataFrame, order: str | None = None, without: tuple[str, ...] = ()) -> list[dict]:
    return [{k: v for k, v in r.asDict(recursive=True).items() if k not in without} for r in (df.orderBy(order) if order else df).collect()]


class Engine:
    """Queries of one graph at a time. Loading another one leaves the old graph in place if it fails."""

    def __init__(self, spark: SparkSession, config: Config = Config(), graph: Graph | None = None):
        self.spark, self.config, self._graph, self._version = spark, config, graph, None

    # -- graphs

    def load(self, root: str, source_ref: str = "") -> dict:
        """Load a corpus of JSON files; without a source_ref, it is looked up."""
        graph = corpus.load(self.spark, root, self.config, source_ref or corpus.source_ref(self.spark, root)).keep()
        graph.nodes.count()
        self._graph, self._version = graph, None
        return self.status()

    def publish(self, folder: str) -> str:
        """Write the graph as a snapshot and make it the folder's current one."""
        return snapshots.publish(self.graph, folder)

    def open(self, folder: str, version: str | None = None) -> dict:
        """Go on with a published snapshot."""
        graph = snapshots.open_graph(self.spark, folder, self.config, version)
        graph.nodes.limit(1).count()
        self._graph, self._version = graph, version or snapshots.current_version(self.spark, folder)[0]
        return self.status()

    def source_status(self, folder: str) -> dict:
        """expected (the version published last), current (the one that is open), in_sync and ready (whether there is a graph to query)."""
        try:
            expected = snapshots.current_version(self.spark, folder)[0]
        except (FileNotFoundError, AnalysisException):
            expected = ""
        current = self._version or ""
        return {"expected": expected, "current": current, "in_sync": bool(expected) and expected == current, "ready": self._graph is not None}

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            raise NotLoaded("no graph is loaded")
        return self._graph

    def _known(self, uuid: str) -> dict:
        row = self.graph.plain_nodes.filter(F.col("uuid") == uuid).select("uuid", "value", "galaxy").first()
        if row is None:
            raise UnknownNode(f"unknown uuid: {uuid}")
        return row.asDict()

    def _scope(self, galaxies: list[str] | None) -> list[str] | None:
        return normalise_scope(galaxies) if galaxies else (list(self.config.scope) if self.config.scope else None)

    # -- queries

    def status(self) -> dict:
        return {"loaded": self._graph is not None} | ({"stats": _rows(analytics.stats(self.graph))[0]} if self._graph else {})

    def resolve(self, query: str, galaxies: list[str] | None = None, limit: int = 20, group: bool = False, mode: str | None = None) -> dict:
        mode, scope = parse_mode(mode), self._scope(galaxies)
        found = resolve.resolve(self.graph, query, scope, limit, mode)
        rows = _rows(found, "rank", ("rank",))
        out = {"query": query, "normalisation": mode, "scope": scope, "count": len(rows), "ambiguous": len(rows) > 1, "candidates": rows}
        return out | ({"by_galaxy": _rows(resolve.group_by_galaxy(found))} if group else {})

    def fuzzy(self, query: str, galaxies: list[str] | None = None, min_similarity: float | None = None, limit: int = 20) -> dict:
        query = query.strip()
        if not query:
            raise ValueError("a query is required")
        threshold, scope = share(min_similarity, FUZZY_THRESHOLD, "min_similarity"), self._scope(galaxies)
        rows = _rows(fuzzy.fuzzy(self.graph, query, scope, threshold, limit), "rank", ("rank",))
        note = "near in spelling is not the same: see the signals of each match before taking it for the one meant"
        if not rows:
            note = "no near names above the threshold; the entry may not be in this corpus"
        elif any(r["blocked"] for r in rows):
            note = "near in spelling is not the same: entries that are blocked disagree on what sets them apart"
        return {"query": query, "min_similarity": threshold, "scope": scope, "count": len(rows), "matches": rows, "note": note}

    def node(self, uuid: str) -> dict:
        self._known(uuid)
        out = _rows(analytics.node_detail(self.graph, uuid))[0]
        return out | {"meta": json.loads(out["meta"]) if out["meta"] else None, "relations_by_type": out["relations_by_type"] or {}}

    def neighbours(self, uuid: str, how: traverse.Walk = traverse.Walk(), with_paths: bool = False) -> dict:
        self._known(uuid)
        hidden = ("start", "rank", "is_actor") + (() if with_paths else ("path",))
        rows = _rows(traverse.neighbours(self.graph, uuid, how, with_bridges=True), "rank", hidden)
        return {"origin": uuid, "depth": how.depth if how.depth > 0 else 1, "count": len(rows), "neighbours": rows}

    def path(self, source: str, target: str, max_depth: int = 0, edge_types: tuple[str, ...] = ()) -> dict:
        self._known(source)
        self._known(target)
        hops = _rows(paths.shortest_path(self.graph, source, target, max_depth, edge_types, with_bridges=True), "hop", ("hop",))
        out = {"from": source, "to": target, "found": bool(hops), "hops": max(0, len(hops) - 1), "path": hops}
        for last, hop in zip(hops, hops[1:], strict=False):
            if hop["bridge"] and hop["confidence"] <= 1:
                weakest = f"{last['value']} -> {hop['value']} ({hop['via']})"
                return out | {"weakest_link": weakest, "caveat": "the route hangs on a link that was declared once and is the only join of its sides"}
        return out

    def profile(self, uuid: str, depth: int = 1, limit: int = 500) -> dict:
        own = self._known(uuid)
        limit = limit if limit > 0 else 500
        entries = _rows(analytics.profile_entries(self.graph, uuid, depth, limit), "rank", ("start", "path"))
        groups = _rows(analytics.profile(self.graph, uuid, depth, limit))
        for g in groups:
            g["entries"] = [{k: v for k, v in e.items() if k not in ("group", "rank")} for e in entries if e["group"] == g["galaxy"]]
        out = own | {"total": len(entries), "truncated": len(entries) == limit, "groups": groups, "note": ""} | {k: sum(g[k] for g in groups) for k in analytics.KINDS}
        if not entries:
            out["note"] = "nothing is linked to this entry here; another entry for the same thing may have more"
        elif not out["specific"]:
            out["note"] = "nothing here belongs to a single actor, so none of it tells who it was"
        return out

    def compare(self, a: str, b: str, depth: int = 1, include_generic: bool = False, galaxies: list[str] | None = None, limit: int = 100) -> dict:
        a, b = a.strip(), b.strip()
        if not a or not b:
            raise ValueError("comparison needs two uuids")
        if a == b:
            raise ValueError("cannot compare an entry with itself")
        own, other = self._known(a), self._known(b)
        args = (self.graph, a, b, depth, include_generic, galaxies)
        facts = _rows(analytics.compare_summary(*args))[0]
        rows = _rows(analytics.compare(*args, limit=limit), "rank", ("rank",))
        out = {"a": own, "b": other} | facts | {side: [{k: v for k, v in r.items() if k != "side"} for r in rows if r["side"] == side] for side in ("shared", "a_only", "b_only")} | {"note": ""}
        if not facts["shared_count"] + facts["a_only_count"] + facts["b_only_count"]:
            out["note"] = "neither entry has a neighbour to compare"
        elif not facts["shared_count"]:
            out["note"] = "nothing in common but, maybe, generic entries"
        elif facts["all_generic"]:
            out["note"] = "all that is shared is used by many actors, so it says little about these two"
        return out

    def co_occurrence(self, uuid: str = "", galaxy: str = "", min_rate: float | None = None, min_actors: int = 0, limit: int = 20) -> dict:
        uuid, galaxy = uuid.strip(), galaxy.strip()
        if not uuid and not galaxy:
            raise ValueError("co-occurrence needs a uuid or a galaxy")
        of = {"uuid": uuid, "value": self._known(uuid)["value"]} if uuid else {"galaxy": galaxy}
        rate, least = share(min_rate, CO_OCCURRENCE_RATE, "min_rate"), min_actors if min_actors > 0 else MIN_CO_OCCURRENCE_ACTORS
        rows = _rows(analytics.co_occurrence(self.graph, uuid or None, galaxy or None, rate, least, limit))
        note = "nearly the same actors use both of a pair: it is one observation, not two" if rows else f"no such pairs of entries that at least {least} actors are linked to"
        return of | {"min_rate": rate, "min_actors": least, "count": len(rows), "pairs": rows, "note": note}

    def refs(self, uuid: str) -> dict:
        own = self._known(uuid)
        found = refs.references(self.graph, uuid)
        rows = _rows(found, None, ("uuid", "at"))
        return own | {"count": len(rows), "references": rows, "publishers": _rows(refs.by_publisher(found)), "note": "" if rows else "this entry has no references here; another galaxy may document the same thing"}

    def most_generic(self, galaxy: str = "", limit: int = 10) -> dict:
        rows = _rows(analytics.most_generic(self.graph, galaxy, limit))
        return {"galaxy": galaxy, "count": len(rows), "entries": rows, "note": "many actors use these, so their presence points to none of them"}

    def galaxies(self) -> list[dict]:
        return _rows(analytics.galaxies(self.graph))

    def has_galaxy(self, name: str) -> bool:
        return resolve.has_galaxy(self.graph, name)

    def draft(self, wish: draft.Draft) -> dict:
        out = draft.draft(self.graph, replace(wish))
        return out | {"json": draft.render(out["entry"])}
