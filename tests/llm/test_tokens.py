import os

import numpy as np
import pytest

from skein.llm import token_attribution as ta

needs_vocabulary = pytest.mark.skipif(not os.path.exists(ta.VOCABULARY), reason="no vocabulary file")


def slow(spans, starts, end, rule):
    out = [0.0] * len(starts)
    ends = [*starts[1:], end]
    for a, b in spans:
        share = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
        hit = [i for i, x in enumerate(share) if x]
        if rule == "shared":
            for i in hit:
                out[i] += share[i] / (b - a)
        else:
            out[{"first": hit[0], "last": hit[-1], "majority": max(hit, key=lambda i: (share[i], -i))}[rule]] += 1
    return out


@pytest.mark.parametrize("rule", ta.RULES)
def test_intervals_are_joined_as_by_brute_force(rule):
    rng = np.random.default_rng(6)
    for _ in range(60):
        cuts = np.sort(rng.integers(1, 60, rng.integers(1, 25)))
        stops = np.append(np.unique(cuts), 60)
        starts = np.sort(np.append(0, rng.integers(0, 60, rng.integers(0, 12))))
        first = np.append(0, stops[:-1])
        got = ta.attribute(first, stops, starts, rule)
        assert got.tolist() == pytest.approx(slow(list(zip(first, stops, strict=True)), starts.tolist(), 60, rule))


@needs_vocabulary
def test_spans_cover_the_text():
    with open(ta.VOCABULARY, "rb") as f:
        encoder = ta.Encoder(f.read())
    for text in ("héllo wörld\n\n日本語 🙂 x", "a", "  \n ", "é" * 3000, "<|endoftext|>"):
        ids = encoder.encode(text)
        first, stop = encoder.spans(ids, text.encode())
        assert first[0] == 0 and stop[-1] == len(text) and (first[1:] >= stop[:-1] - 1).all()
        assert encoder.encoding.decode(ids.tolist()) == text


@needs_vocabulary
def test_counts_by_field_and_line(spark):
    rows = [(1, "src", "one line\nsecond, longer line\n\nend", "x"), (1, "src", "one line\nsecond, longer line\n\nend", "x"), (2, None, None, "x"), (3, "s", "", "x"), (None, "s", "é" * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, field string").repartition(2)
    got = ta.count_tokens(df, ["source", "text"]).collect()
    with open(ta.VOCABULARY, "rb") as f:
        encoder = ta.Encoder(f.read())
    for doc, source, text, _ in rows:
        mine = [r for r in got if r["doc_id"] == doc]
        copies = 2 if doc == 1 else 1
        assert len(mine) == copies * (1 + (text or "").count("\n") + 1)
        whole = f"{source or ''}\n{text or ''}"
        assert sum(r["n_tokens"] for r in mine) == copies * len(encoder.encode(whole))
        assert sum(r["n_chars"] for r in mine) == copies * len(whole)
    assert ta.count_tokens(df.limit(0), ["text"]).count() == 0
    assert ta.count_tokens(df, ["text"], lines=False).filter("doc_id = 1").count() == 2
    with pytest.raises(ValueError):
        ta.count_tokens(df, ["text"], rule="none")
