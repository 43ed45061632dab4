"""Quality rules judged by host: rule failures summed up by domain, shrunk with an empirical beta prior, and joined back to documents."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_rows

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Rules whose failures count for a host: name -> SQL condition over the measures.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_dup_lines >= 3 AND 4 * n_dup_lines * 10 > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)",
}
#: What makes a document fail whatever its host.
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(f"[{re.escape(SYMBOLS)}]")


def _repeated(words: list[str], width: int = 5) -> int:
    """Words inside windows of width words that occur at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    first: dict[str, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    base, code, count = len(first), ids, len(first)
    for k in range(1, width):  # code numbers the windows of k + 1 words, exactly: it is dense again before it could overflow
        if count * base >= 1 << 62:
            code, count = (u := np.unique(code, return_inverse=True))[1], len(u[0])
        code, count = code[:-1] * base + ids[k:], count * base
    _, back, times = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[back] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """MEASURES of one whole text; null and empty texts have zeros."""
    text = text or ""
    words = _WORDS.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORDS.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, _repeated(words)


def measured(documents: DataFrame, domain: str = "source") -> DataFrame:
    """doc_id, domain and MEASURES of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        return lambda rows: [(r["doc_id"], r["domain"], *measure(r["text"])) for r in rows]

    return map_rows(documents.select("doc_id", F.col(domain).cast("string").alias("domain"), "text"), make, f"doc_id {kind}, domain string, {MEASURES}")


def host_verdicts(scored: DataFrame, rules: dict[str, str] = RULES, most: float = 0.5, min_strength: float = 2.0) -> DataFrame:
    """domain, n_docs, and for each rule its count of failures, its shrunk rate; host_ok is false if any shrunk rate is above ``most``.

    For each rule the beta prior is fitted to the hosts by moments: its mean
    is the failure rate of all documents, its strength (a + b) follows from
    the document-weighted variance of the hosts' rates beyond what sampling
    alone gives. Where hosts don't differ beyond that, the strength is
    unbounded and every host gets the mean; it is ``min_strength`` at
    least. A null domain is a host like others. No documents, no rows.
    """
    hosts = scored.groupBy("domain").agg(F.count("*").alias("n_docs"), *[F.count(F.when(F.expr(x), 1)).alias(f"{r}_fails") for r, x in rules.items()])
    sums = [F.sum("n_docs").alias("n"), F.count("*").alias("k")]
    for r in rules:
        sums += [F.sum(f"{r}_fails").alias(f"{r}_n"), F.sum(F.col(f"{r}_fails") * F.col(f"{r}_fails") / F.col("n_docs")).alias(f"{r}_sq")]
    prior = hosts.agg(*sums)
    n, k = F.col("n"), F.col("k")
    for r in rules:
        mean = F.col(f"{r}_n") / n
        spread = F.col(f"{r}_sq") / n - mean * mean  # document-weighted variance of rates
        noise = mean * (1 - mean)
        # E[spread] = noise * (k - 1) / n + (1 - (k - 1) / n) * noise / (strength + 1), about
        share = F.when((noise > 0) & (n > k - 1), (spread / noise - (k - 1) / n) / (1 - (k - 1) / n)).otherwise(0.0)
        prior = prior.withColumn(f"{r}_mean", mean).withColumn(f"{r}_strength", F.when(share > 1e-9, F.greatest(F.lit(min_strength), 1 / share - 1)).otherwise(1e12))
    prior = prior.select(*[f"{r}_{x}" for r in rules for x in ("mean", "strength")])
    judged = hosts.join(F.broadcast(prior))  # one row
    ok = F.lit(True)
    for r in rules:
        rate = (F.col(f"{r}_fails") + F.col(f"{r}_mean") * F.col(f"{r}_strength")) / (F.col("n_docs") + F.col(f"{r}_strength"))
        judged = judged.withColumn(f"{r}_rate", rate)
        ok = ok & (F.col(f"{r}_rate") <= most)
    return judged.select("domain", "n_docs", *[f"{r}_{x}" for r in rules for x in ("fails", "rate")], ok.alias("host_ok"))


def judge(documents: DataFrame, domain: str = "source", most: float = 0.5) -> DataFrame:
    """doc_id, MEASURES, base_failed, host_ok and kept of every document.

    A document is kept if it passes the base rules and its host's shrunk
    failure rates are all within ``most``. Null and empty texts have no
    words and fail. Rows alike are judged one by one. Columns other than
    doc_id, text and the domain's are ignored.
    """
    from .common import checkpointed

    scored = checkpointed(measured(documents, domain))
    verdicts = host_verdicts(scored, most=most).select(F.col("domain").alias("host"), "host_ok")
    joined = scored.join(verdicts, F.col("domain").eqNullSafe(F.col("host")))
    failed = F.expr(BASE)
    return joined.select("doc_id", *[c.split()[0] for c in MEASURES.split(", ")], failed.alias("base_failed"), "host_ok", (~failed & F.col("host_ok")).alias("kept"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every document and whether the rules and its host let it stay."""
    return judge(load(spark, sf_dir, "documents"))


def _oracle() -> str:
    fails = ", ".join(f"CAST(count(*) FILTER ({x}) AS DOUBLE) AS {r}_fails" for r, x in RULES.items())
    sums = ", ".join(f"sum({r}_fails) AS {r}_n, sum({r}_fails * {r}_fails / n_docs) AS {r}_sq" for r in RULES)
    means = ", ".join(f"{r}_n / n AS {r}_mean, CASE WHEN {r}_n > 0 AND {r}_n < n AND n > k - 1 THEN (({r}_sq / n - ({r}_n / n) * ({r}_n / n)) / (({r}_n / n) * (1 - {r}_n / n)) - (k - 1) / n) / (1 - (k - 1) / n) ELSE 0 END AS {r}_share" for r in RULES)
    strength = {r: f"(CASE WHEN {r}_share > 1e-9 THEN greatest(2.0, 1 / {r}_share - 1) ELSE 1e12 END)" for r in RULES}
    ok = " AND ".join(f"({r}_fails + {r}_mean * {s}) / (n_docs + {s}) <= 0.5" for r, s in strength.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
i AS (SELECT rid, words, unnest(range(len(words) - 4)) AS i FROM w WHERE len(words) > 5),
g AS (SELECT rid, i, words[i + 1 : i + 5] AS gram FROM i),
x AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS times FROM g),
c AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM x, (SELECT unnest(range(5)) AS o) WHERE times > 1 GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT rid, sum(k - 1) AS n_dup_lines FROM (SELECT rid, line, count(*) AS k FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line) GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (rid) LEFT JOIN u USING (rid)),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n_docs, {fails} FROM m GROUP BY source),
p AS (SELECT sum(n_docs) AS n, CAST(count(*) AS DOUBLE) AS k, {sums} FROM h),
q AS (SELECT {means} FROM p),
v AS (SELECT h.source, {ok} AS host_ok FROM h, q)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE}) AS base_failed, host_ok, NOT ({BASE}) AND host_ok AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""


OP6_SQL = _oracle()
