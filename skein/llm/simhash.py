"""SimHash near-duplicates, found by Golay-code fuzzy hashing of fingerprint segments.

The 64 bits of a fingerprint are cut into segments of 22, 21 and 21 bits,
read as words of the perfect binary Golay code of length 23, in which every
word is at most 3 bits from a codeword. Two words that differ in one bit
share a codeword: the nearest to one is at most 4 bits from the other. So a
word's keys are the codeword indices within 4 bits (one to six of them).

Fingerprints at most 2 bits apart agree in one segment of three, and the
segment after it (in a circle) can be chosen to differ in at most one bit:
of (2,0,0), (1,1,0), (1,0,0) and their turns each has a 0 followed by a 0
or 1. The join key is thus the exact segment together with a codeword index
of the next: the nearest one on one side, all near ones on the other.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, load, map_rows, small, written
from .components import connected_components

SEGMENTS = (22, 21, 21)
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_SHIFTS = (42, 21, 0)


def fingerprint(text: str | None, width: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    """64-bit SimHash of the word shingles of a whole text (A-Z lower-cased, repeats counted); 0 without words."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").lower().split() if w]  # bytes: ASCII case and blanks only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), block):
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts[at : at + block], stops[at : at + block], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash and fingerprint f (signed longs) of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        return lambda rows: [(r["doc_id"], r["text_hash"], (x := fingerprint(r["text"])) - (x >> 63 << 64)) for r in rows]

    return map_rows(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), make, f"doc_id {kind}, text_hash long, f long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Words of 23 bits modulo the generator: the syndrome, 11 bits."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


class Golay:
    """Decoding of 23-bit words to the indices (top 12 bits) of their nearby codewords."""

    def __init__(self, radius: int = 4):
        bits = 1 << np.arange(23)
        errors = [np.zeros(1, np.int64)]
        for _ in range(radius):  # patterns of one more bit, each once: the new bit is the highest
            last = errors[-1]
            errors.append(np.concatenate([last[last < b] | b for b in bits]))
        near = np.concatenate(errors[:4])
        self.leader = np.zeros(1 << 11, np.int64)
        self.leader[_remainders(near)] = near  # perfect: each syndrome once
        every = np.concatenate(errors)
        by = _remainders(every)
        order = np.argsort(by, kind="stable")
        self.start = np.searchsorted(by[order], np.arange((1 << 11) + 1))
        self.pattern = every[order]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.leader[_remainders(words)]) >> 11

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All codeword indices within the radius: positions in words, and indices."""
        s = _remainders(words)
        n = self.start[s + 1] - self.start[s]
        pos = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[s], n)
        return pos, (words[pos] ^ self.pattern[at]) >> 11


def _keys(code: Golay, f: np.ndarray, all_near: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in f and join keys: turn, exact segment, codeword index of the next segment."""
    u = f.astype(np.uint64)
    segments = [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(_SHIFTS, SEGMENTS, strict=True)]
    pos, keys = [], []
    for turn in range(3):
        exact, fuzzy = segments[turn], segments[(turn + 1) % 3]
        p, index = code.near(fuzzy) if all_near else (np.arange(len(f)), code.nearest(fuzzy))
        pos.append(p)
        keys.append((turn << 34) | (exact[p] << 12) | index)
    return np.concatenate(pos), np.concatenate(keys)


def keyed(classes: DataFrame, all_near: bool) -> DataFrame:
    """key, f: the join keys of distinct fingerprints."""
    import pyarrow as pa

    def run(batches):
        code = Golay()
        for b in batches:
            f = b.column("f").to_numpy()
            pos, keys = _keys(code, f, all_near)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[pos])], names=["key", "f"])

    return classes.select("f").mapInArrow(run, "key long, f long")


def _found_by(turn: int, x) -> F.Column:
    """Whether a difference of fingerprints is one that this turn's key finds for sure."""
    bits = lambda k: F.bit_count(F.shiftrightunsigned(x, _SHIFTS[k % 3]).bitwiseAND(F.lit((1 << SEGMENTS[k % 3]) - 1)))
    return (bits(turn) == 0) & (bits(turn + 1) <= 1)


def linked(classes: DataFrame, radius: int = 2) -> DataFrame:
    """u < v: all pairs of distinct fingerprints f that differ in at most ``radius`` (0 to 2) bits, each once."""
    left = keyed(classes, False).withColumnRenamed("f", "u")
    right = keyed(classes, True).select(F.col("key").alias("key2"), F.col("f").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    turn = F.shiftright("key", 34)
    # A pair that several turns find is given by the first of them.
    once = ((turn == 0) & _found_by(0, x)) | ((turn == 1) & _found_by(1, x) & ~_found_by(0, x)) | ((turn == 2) & _found_by(2, x) & ~_found_by(0, x) & ~_found_by(1, x))
    return left.join(right, (F.col("key") == F.col("key2")) & (F.col("u") < F.col("v")) & (F.bit_count(x) <= radius) & once).select("u", "v")


def near_duplicates(documents: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, text_hash, f, component_id and links of every document.

    Documents whose fingerprints differ in at most radius bits are linked;
    component_id is the least doc_id reachable. links counts the other
    fingerprints that this document's fingerprint is linked to. Null and
    empty texts share the fingerprint zero and are linked like any others.
    Rows alike each get their row; null doc_ids are passed over in minima.
    Extra columns are ignored; no rows give none.
    """
    docs = checkpointed(fingerprints(documents))
    classes = checkpointed(docs.groupBy("f").agg(F.min("doc_id").alias("least")))
    pairs = checkpointed(linked(classes, radius))
    degree = pairs.select(F.explode(F.array("u", "v")).alias("g")).groupBy("g").agg(F.count("*").alias("links"))
    roots = connected_components(pairs)
    tied = classes.join(roots.join(degree, F.col("node") == F.col("g")), F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    tied = checkpointed(tied)
    whole = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = tied.join(whole, "root").select(F.col("f").alias("g"), "root", "component_id", "links")
    return docs.join(ids, F.col("f") == F.col("g")).select("doc_id", "text_hash", "f", "root", "component_id", "links")


def keep_one(documents: DataFrame, radius: int = 2) -> DataFrame:
    """One row of documents, with all its columns, of each group of near duplicates: that with the least doc_id, null first.

    Rows alike in doc_id and text are in one group, and one of them stays.
    """
    return keep_least(documents, near_duplicates(documents, radius))


def keep_least(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row of documents of each root of found (doc_id, text_hash, root): that with the least doc_id, null first, and of these the least text_hash.

    Rows to go are named by doc_id and text_hash, so texts aren't sorted,
    nor shuffled while these names are few. All columns stay, of any name.
    """
    counted = written(found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "found")
    ones = counted.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    is_one = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_hash") == F.col("one.text_hash"))
    marked = written(counted.join(ones, "root").select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text"), "n", is_one.alias("stays")), "marked")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"))
    same = F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__text"))
    kept = rows.join(small(marked.filter("NOT stays"), F.lit(64)), same, "left_anti")
    again = marked.filter("stays AND n > 1")
    if not again.isEmpty():  # rows alike
        one = kept.join(again, same, "left_semi").groupBy("__id", "__hash").agg(F.first("__row").alias("__row"))
        kept = kept.join(again, same, "left_anti").select("__row").unionByName(one.select("__row"))
    return kept.select("__row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id and links of every document."""
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", "links")
