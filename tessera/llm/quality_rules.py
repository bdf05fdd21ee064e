"""Rule-based quality, with verdicts on whole hosts.

Base rules look at one text. Hosts are then judged by how often their documents fail: counts by host, an empirical beta
prior fitted to the hosts' rates by moments, and each host's rate shrunk towards it. A host whose shrunk rate exceeds
``max_rate`` takes all its documents with it. Hosts without many documents stay near the prior, so a few failures don't
condemn them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import free_name, materialize, quoted, skew_join, text_buffer, with_column

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host goes if more than this share of its documents would fail, after shrinking.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_symbol = np.zeros(256, dtype=bool)
_symbol[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_leading = (np.arange(256) & 0xC0) != 0x80


def _per_text(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])[offsets])


def repeat_words(words: list[bytes], counts: np.ndarray, window: int = 5) -> np.ndarray:
    """Of each text, the words inside windows that occur twice or more in it. ``words`` holds all texts' words in
    turn. Windows are numbered exactly, by doubling: pairs, pairs of pairs, and one more word."""
    out = np.zeros(len(counts), dtype=np.int64)
    if len(words) < window:
        return out
    one, unique = pd.factorize(np.array(words, dtype=object))
    pair, pairs = pd.factorize(one[:-1] * np.int64(len(unique)) + one[1:])
    four, fours = pd.factorize(pair[:-2] * np.int64(len(pairs)) + pair[2:])
    five, fives = pd.factorize(four[:-1] * np.int64(len(unique)) + one[4:])
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(doc[: len(five)] == doc[window - 1 :])
    key, _ = pd.factorize(doc[whole] * np.int64(len(fives)) + five[whole])
    again = whole[np.bincount(key)[key] > 1] if len(whole) else whole
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return np.bincount(doc, weights=np.cumsum(cover)[:-1] > 0, minlength=len(counts)).astype(np.int64)


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The columns ``STATS`` of a string column; null counts as empty."""
    data, offsets = text_buffer(column)
    own, raw = data[: offsets[-1]], data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    split = [t.split() for t in texts]  # bytes split at exactly space and \x09-\x0D
    n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": n,
        "word_chars": _per_text(_leading[own] & ~_space[own], offsets),
        "n_symbols": _per_text(_symbol[own], offsets),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": repeat_words([w for words in split for w in words], n),
    }


def annotate(docs: DataFrame, text: str = "text", name: str = "__rules") -> DataFrame:
    """All columns of ``docs`` and a struct of ``STATS``; the text stays where it is."""
    fields = [x.split()[0] for x in STATS.split(", ")]

    def struct(column: pa.Array) -> pa.Array:
        stats = text_stats(column)
        return pa.StructArray.from_arrays([pa.array(stats[f], pa.int64()) for f in fields], fields)

    return with_column(docs, text, name, T.StructType([T.StructField(f, T.LongType()) for f in fields]), struct)


def failed(name: str = "__rules") -> Column:
    n, again = F.col(f"{name}.n_words"), F.col(f"{name}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)


def host_of(source: Column) -> Column:
    """Lower-case host of a source, which may be an address or a bare name; null if there is none."""
    bare = F.regexp_replace(F.lower(F.trim(source.cast("string"))), r"^[a-z][a-z0-9+.-]*://([^/@]*@)?", "")
    host = F.regexp_extract(bare, r"^([^/?#:]*)", 1)
    return F.when(host != "", host)


def judge_hosts(flags: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, n, n_failed, rate, rejected`` from rows ``host, base_failed``; rows without a host are left out."""
    hosts = flags.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "host-counts")
    share = F.col("n_failed") / F.col("n")
    mean, spread = hosts.agg(F.avg(share), F.var_pop(share)).first()
    weight = PRIOR_WEIGHT[1]
    if spread:
        weight = max(PRIOR_WEIGHT[0], min(PRIOR_WEIGHT[1], mean * (1 - mean) / spread - 1))
    rate = (F.col("n_failed") + (mean or 0.0) * weight) / (F.col("n") + weight)
    return hosts.select("host", "n", "n_failed", rate.alias("rate"), (rate > max_rate).alias("rejected"))


def quality_rules(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``doc_id``, the base columns, ``base_failed``, ``host_rate`` and ``kept``, one row for each row of ``docs``
    (``doc_id, text, source``; other columns are ignored). Null and empty texts have no words and fail. Rows without a
    source have no host, a null ``host_rate``, and are judged by the base rules alone. Repeated rows all count and are
    returned repeatedly, null ids are kept, texts of any length count whole. A rate of exactly ``max_rate`` passes. An empty
    table gives no rows."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host_of(F.col("source")).alias("host"))
    stats = annotate(base).select("doc_id", "host", "__rules.*", failed().alias("base_failed"))
    stats = materialize(stats, "rule-stats")
    hosts = judge_hosts(stats, max_rate).select("host", "n", F.col("rate").alias("host_rate"), "rejected")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("rejected"), F.lit(False))
    told = skew_join(stats, hosts, "host", "n", stats.count(), ["doc_id", "n_words", "word_chars"])
    return told.select("doc_id", *[x.split()[0] for x in STATS.split(", ")], "base_failed", kept.alias("kept"), F.round("host_rate", 6).alias("host_rate"))


def keep_good(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows of ``docs`` that pass, with their columns, whatever other columns are called. Null and empty texts have no
    words and go; rows without a source are judged by the base rules alone; texts of any length count whole; repeated rows
    share a verdict and all count for their host; an empty table gives no rows.

    Texts go through the rules once: rows are written with their host and verdict, those that fail without their text, and
    hosts are counted from that table."""
    rules, host, fails = (free_name(docs, n) for n in ("__rules", "__host", "__failed"))
    marked = annotate(docs, name=rules).withColumns({host: host_of(F.col("source")), fails: failed(rules)})
    own = [F.when(~F.col(fails), c).alias(n) if n.lower() == "text" else c for n, c in zip(docs.columns, quoted(docs.columns), strict=True)]
    marked = materialize(marked.select(*own, host, fails), "rule-verdicts")
    hosts = judge_hosts(marked.select(F.col(host).alias("host"), F.col(fails).alias("base_failed")), max_rate)
    count, bad = free_name(docs, "__n"), free_name(docs, "__rejected")
    hosts = hosts.where("rejected").select(F.col("host").alias(host), F.col("n").alias(count), F.col("rejected").alias(bad))
    told = skew_join(marked.where(~F.col(fails)), hosts, host, count, marked.count(), ["doc_id", "text"])
    return told.where(F.col(bad).isNull()).select(*quoted(docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, lower(trim(source)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM p),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM h WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, count(*) AS times FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
dl AS (SELECT doc_id, sum(times - 1) AS n_dup_lines FROM l GROUP BY doc_id),
s AS (SELECT d.doc_id, d.host, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dl.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN dl USING (doc_id)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s),
hosts AS (SELECT host, count(*) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS BIGINT) AS n_failed FROM f WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT avg(n_failed / n) AS m, var_pop(n_failed / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(2.0::DOUBLE, least(1000.0::DOUBLE, m * (1 - m) / v - 1)) ELSE 1000.0::DOUBLE END AS w FROM m),
j AS (SELECT host, (n_failed + m * w) / (n + w) AS rate FROM hosts, prior)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
  (NOT f.base_failed AND NOT coalesce(j.rate > 0.5, FALSE)) AS kept, round(j.rate, 6) AS host_rate
FROM f LEFT JOIN j USING (host)
"""
