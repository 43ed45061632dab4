"""Token counts by field and section, from one encoding of each whole document.

The fields of a row are joined by line feeds and encoded once. Tokens keep
their byte offsets, which become character spans; sections (the lines of
each field) are spans too, and tile the document: the line feed that ends a
section is part of it. Tokens and sections are joined as intervals, and a
token that crosses a boundary goes where an explicit rule says.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import load, map_rows

#: Split pattern of the 50k byte-level vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: majority: the section with most of the token's characters, the earlier one if equal; first, last: that of its first or last character; shared: every section by its share of the characters.
RULES = ("majority", "first", "last", "shared")


class Encoder:
    """A byte-level BPE whose tokens, put together, are the text's UTF-8 bytes."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(k) for k in ranks]

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def spans(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; tokens within one character all have it."""
        stop = np.cumsum(self.size[ids])
        char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1  # the character of each byte
        return char[stop - self.size[ids]], char[stop - 1] + 1


def attribute(first: np.ndarray, stop: np.ndarray, starts: np.ndarray, rule: str = "majority") -> np.ndarray:
    """Tokens in each section. first, stop: token spans; starts: where sections start, rising from 0, an empty one before the next at the same place."""
    n = len(starts)
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, stop - 1, "right") - 1
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float)
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float)
    out = np.bincount(a[a == b], minlength=n).astype(float)
    crossing = np.flatnonzero(a != b)
    ends = np.append(starts[1:], np.iinfo(np.int64).max)
    if len(crossing):  # one row for each of these tokens and each section that it meets
        m = b[crossing] - a[crossing] + 1
        token = np.repeat(np.arange(len(crossing)), m)
        section = np.arange(len(token)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(a[crossing], m)
        lo, hi = first[crossing][token], stop[crossing][token]
        overlap = np.maximum(0, np.minimum(hi, ends[section]) - np.maximum(lo, starts[section]))
        if rule == "shared":
            np.add.at(out, section, overlap / (hi - lo))
        else:
            order = np.lexsort((section, -overlap, token))
            best = order[np.unique(token[order], return_index=True)[1]]
            np.add.at(out, section[best], 1)
    return out


def count_tokens(rows: DataFrame, fields: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "majority", key: str = "doc_id", lines: bool = True) -> DataFrame:
    """key, field, section, start, n_chars, n_tokens for each section of each field.

    Sections are the lines of a field (or whole fields without ``lines``),
    numbered from 0; start counts characters from the document's start,
    n_chars includes the line feed that ends the section. The counts of a
    row's sections sum up to the tokens of its document. A null field is
    empty: one section, without tokens but that of its line feed. Rows
    alike are counted one by one; extra columns are ignored; no rows give
    none. The vocabulary is read by the driver and sent to the tasks.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    with open(vocabulary, "rb") as f:
        data = f.read()
    kind = rows.schema[key].dataType.simpleString()

    def make():
        encoder = Encoder(data, pattern)

        def fn(batch):
            for r in batch:
                values = [r[f"f{i}"] or "" for i in range(len(fields))]
                parts = [(f, i, x) for f, v in zip(fields, values, strict=True) for i, x in enumerate(v.split("\n") if lines else [v])]
                text = "\n".join(values)
                sizes = np.array([len(x) + 1 for _, _, x in parts])
                sizes[-1] -= 1
                starts = np.cumsum(sizes) - sizes
                ids = encoder.encode(text)
                counts = attribute(*encoder.spans(ids, text.encode("utf-8", "replace")), starts, rule) if len(ids) else np.zeros(len(parts))
                for (field, i, _), start, size, n in zip(parts, starts.tolist(), sizes.tolist(), counts.tolist(), strict=True):
                    yield r["k"], field, i, start, size, n

        return fn

    renamed = rows.select(rows[key].alias("k"), *[rows[f].cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return map_rows(renamed, make, f"`{key}` {kind}, field string, section long, start long, n_chars long, n_tokens double", chunk=64)


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document's source and of each line of its text."""
    return count_tokens(load(spark, sf_dir, "documents"), ["source", "text"])
