"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be met with up to k = floor(rate * n) edits. Cut
into k + 1 pieces, at least one piece occurs unchanged in any such
occurrence. An Aho-Corasick automaton finds the pieces; around each find,
Myers' bit-parallel algorithm computes the least edit distance of the item
to any stretch of the text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_rows

RATE = 0.08
_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, with each run of other characters than letters and digits as one blank, trimmed."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


class Item:
    """A normalised benchmark text with its error budget, pieces and match masks."""

    def __init__(self, text: str, rate: float = RATE):
        self.text, self.size, self.budget = text, len(text), int(rate * len(text))
        n = self.budget + 1
        self.cuts = [len(text) * i // n for i in range(n + 1)]
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """Least distance to a stretch of text within lo:hi and the first place where one ends, or None beyond the budget."""
        m, masks, budget = self.size, self.masks.get, self.budget
        full, high = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, end = full, 0, m, budget + 1, -1
        for j in range(lo, hi):
            eq = masks(text[j], 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = ph << 1 & full
            pv = (mh << 1 & full) | ~(xv | ph) & full
            mv = ph & xv
            if score < best:
                best, end = score, j + 1
                if not best:
                    break
            elif score - (hi - 1 - j) >= best:  # a column lowers the score by one at most
                break
        return (best, end) if end >= 0 else None


class Matcher:
    """All items of a block: ids by normalised text."""

    def __init__(self, items: dict[str, list], rate: float = RATE):
        import ahocorasick

        self.items = [(Item(text, rate), ids) for text, ids in items.items() if text]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (item, _) in enumerate(self.items):
            for a, b in zip(item.cuts, item.cuts[1:], strict=False):
                found.setdefault(item.text[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None, first_only: bool = False) -> dict[int, tuple[int, int]]:
        """Least distance, and the end of the first stretch at it, for each item (by place) found in a whole text."""
        found: dict[int, tuple[int, int]] = {}
        if not len(self.automaton):
            return found
        text = normalise(text)
        tried: set[tuple[int, int]] = set()
        for last, (n, places) in self.automaton.iter(text):
            for i, a in places:
                start = last + 1 - n - a
                if (i, start) in tried:
                    continue
                tried.add((i, start))
                item = self.items[i][0]
                k = item.budget
                if start + item.size + k <= 0:
                    continue
                if k:
                    got = item.search(text, max(0, start - k), min(len(text), start + item.size + k))
                else:  # short items have no room for edits and must stand as words of their own
                    stop = start + item.size
                    whole = text.startswith(item.text, start) and (start == 0 or text[start - 1] == " ") and (stop == len(text) or text[stop] == " ")
                    got = (0, stop) if whole else None
                if got and (i not in found or got < found[i]):
                    found[i] = got
                    if first_only:
                        return found
        return found


def item_blocks(benchmark: DataFrame, block_chars: int = 2_000_000) -> list[dict[str, list]]:
    """Items (item_id, text) by normalised text, in blocks of about block_chars characters that each fit a task with ease."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    blocks = []
    for b in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else benchmark
        block: dict[str, list] = {}
        for r in part.select("item_id", "text").toLocalIterator():
            if key := normalise(r["text"]):
                block.setdefault(key, []).append(r["item_id"])
        blocks.append(block)
    return blocks


def find_contamination(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, distance, end for every document and item that occurs in it within the error budget.

    Both texts are normalised first; end is a place in the normalised text.
    Items without letters or digits, and null ones, match nothing; items
    alike are each reported. Items too short for any edit match as whole
    words. Null and empty documents match nothing; rows alike are each
    reported; extra columns are ignored. The documents are read once for
    each block of items.
    """
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((documents, "doc_id"), (benchmark, "item_id"))]
    out = None
    for block in item_blocks(benchmark, block_chars):

        def make(block=block):
            matcher = Matcher(block, rate)

            def fn(rows):
                for r in rows:
                    for i, (distance, end) in matcher.matches(r["text"]).items():
                        for item_id in matcher.items[i][1]:
                            yield r["doc_id"], item_id, distance, end

            return fn

        part = map_rows(documents.select("doc_id", "text"), make, f"doc_id {kinds[0]}, item_id {kinds[1]}, distance long, end long")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = 2_000_000) -> DataFrame:
    """documents without the rows in which an item occurs within the error budget; all columns stay."""
    import pyarrow as pa

    for block in item_blocks(benchmark, block_chars):

        def run(batches, block=block):
            matcher = Matcher(block, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.matches(t.as_py(), first_only=True) for t in b.column("text")], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance and end of every occurrence of a benchmark item in a document."""
    return find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
