"""Text-quality counts per document, and verdicts on hosts from the rule failures of all their documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import SPACES, checkpoint, text_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: A document fails with fewer words, or with more than this share (in percent) of repeated ones.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Rules, as conditions on the counts under which a document fails; those of BASE drop the document
#: itself, the others only tell about its host: symbols for each word, repeated lines among all.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeats")
#: A host goes when its failure rate for some rule, shrunk towards that of all hosts, is above this:
#: when most of its documents are to be expected to fail.
HOST_LIMIT = 0.5
#: The prior counts as this many documents at most, and as one at least.
MOST_STRENGTH = 1e6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_counts(text: str) -> tuple[int, ...]:
    """The COUNTS of one text; lines are those with a word."""
    data = text.encode()
    words = data.split()
    n = len(words)
    in_words = len(text) - (len(data) - len(data.translate(None, SPACES)))
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else []
    windows = list(zip(*[words[k:] for k in range(WINDOW)], strict=False))
    again = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        covered = np.zeros(n, bool)
        starts = np.flatnonzero([seen[x] > 1 for x in windows])
        for k in range(WINDOW):
            covered[starts + k] = True
        again = int(covered.sum())
    return n, in_words, len(data) - len(data.translate(None, SYMBOLS)), len(lines) or int(n > 0), len(lines) - len(set(lines)), again


def document_counts(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, host, the COUNTS and base_failed.

    Null texts count as empty (all counts 0, so they fail); null hosts and ids stay null; repeated
    rows stay; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [text_counts(x.as_py()) for x in batch.column(2)]
            columns = zip(*counts, strict=True) if counts else [[]] * len(COUNTS)
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in columns]], ["doc_id", "host", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_of(text_col).alias("text"))
    counts = rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{x} long" for x in COUNTS))
    return counts.withColumn("base_failed", F.expr(" OR ".join(f"({RULES[x]})" for x in BASE)))


def host_rates(counts: DataFrame) -> DataFrame:
    """Per host (null is one): n, and for each rule its shrunken failure rate, rate_<rule>.

    The rate is the posterior mean under a beta prior that all hosts' failures give by moments.
    Hosts' rates differ by chance as well, the more the smaller they are, so what binomial noise
    explains is taken off first: with k hosts of n documents (N in all) of which f fail, p = sum f / N
    and S = sum f^2 / n - p^2 N, the share of real spread is
    rho = (S / (p (1 - p)) - (k - 1)) / (N - sum n^2 / N - (k - 1)), and the prior counts as
    1 / rho - 1 documents, kept from 1 to MOST_STRENGTH. Where rho is not above 0 (or there is a
    single host, or all or no documents fail) it is MOST_STRENGTH, and hosts share the mean.
    """
    failed = [F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), *failed)
    n, f = F.col("n"), {name: F.col(f"f_{name}") for name in RULES}
    sums = hosts.agg(
        F.count("*").alias("k"), F.sum("n").cast("double").alias("all"), F.sum((n * n).cast("double")).alias("squares"),
        *[x for name in RULES for x in (F.sum(f[name]).cast("double").alias(f"all_{name}"), F.sum(f[name] * f[name] / n).alias(f"s_{name}"))],
    )
    priors = []
    for name in RULES:
        mean = F.col(f"all_{name}") / F.col("all")
        spread = F.try_divide(F.col(f"s_{name}") - mean * mean * F.col("all"), mean * (1 - mean)) - (F.col("k") - 1)
        rho = F.try_divide(spread, F.col("all") - F.col("squares") / F.col("all") - (F.col("k") - 1))
        strength = F.when(rho > 1 / (1 + MOST_STRENGTH), F.greatest(F.lit(1.0), 1 / rho - 1)).otherwise(F.lit(MOST_STRENGTH))
        priors += [mean.alias(f"mean_{name}"), strength.alias(f"strength_{name}")]
    rates = [((f[name] + F.col(f"mean_{name}") * F.col(f"strength_{name}")) / (n + F.col(f"strength_{name}"))).alias(f"rate_{name}") for name in RULES]
    return hosts.join(F.broadcast(sums.select(*priors))).select("host", "n", *rates)  # the prior is a single row


def quality_verdicts(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, the COUNTS, base_failed, host_rate and kept.

    Words are runs of anything but white space. A document is kept unless it fails by itself or its
    host's highest shrunken failure rate (host_rate) is above HOST_LIMIT. Null texts count as empty
    and fail; null hosts are one host; null and repeated ids keep their rows; an empty table gives
    no rows; other columns are not read.
    """
    counts = checkpoint(document_counts(docs, host_col, id_col, text_col))
    rates = host_rates(counts).select(F.col("host").alias("_host"), F.greatest(*[f"rate_{x}" for x in RULES]).alias("host_rate"))
    found = counts.join(rates, counts.host.eqNullSafe(rates._host), "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= HOST_LIMIT)
    return found.select("doc_id", *COUNTS, "base_failed", F.round("host_rate", 6).alias("host_rate"), kept.alias("kept"))
