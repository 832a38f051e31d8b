"""Host-level quality rules: rule failures by domain, shrunk by an empirical beta prior. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsearch.llm.common import SPACE, documents, let, materialised

#: A host is rejected when its failure rate is so many standard deviations above what the prior makes likely.
SDS = 2.0
#: The prior counts as many rows, at least and at most.
PRIOR_ROWS = (2.0, 1000.0)
SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, the first occurrence included."""

    def body(w: Column) -> Column:
        grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def covered(g: Column) -> Column:
            twice = F.filter(g, lambda x, k: (x["h"] == F.get(g, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(g, k - 1)["h"])))
            at = F.transform(F.filter(F.transform(twice, lambda x: x["i"]), lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2))
            return F.size(F.array_distinct(F.flatten(at)))

        return let(F.sort_array(grams), covered)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, body))


def document_rules(docs: DataFrame, *keep: str) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of the whole text of every row; a null text has none.

    Everything is computed within the row, without a shuffle: equal 3-word windows meet by sorting the row's window hashes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    out = docs.select(
        *keep,
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))).alias("q_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = out.select(*keep, F.col("q_words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("q_words.r").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_rates(rules: DataFrame, host: str = "source", sds: float = SDS) -> DataFrame:
    """(host, n, failed, rate, limit, rejected) for every host: failures of its rows, its failure rate shrunk to the hosts' mean, the verdict.

    The beta prior is fitted to the hosts' raw rates by moments, each host counting once: with mean m, and variance v of the rates less what
    the hosts' sizes alone make of m (1 - m), the prior is worth m (1 - m) / v - 1 rows, held within PRIOR_ROWS (the upper one where hosts
    differ no more than their sizes explain). rate is (failed + m prior) / (n + prior). limit is m and `sds` standard deviations of the
    prior, at most half way from m to 1; a host is rejected if its rate less `sds` standard deviations of its posterior is above that. So
    hosts that are all alike, good or bad, are all kept, and how bad a host must be follows from how hosts differ.
    One row per host enters the moments, which are one partial aggregation.
    """
    hosts = rules.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    raw = F.col("failed") / F.col("n")
    moments = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"), F.avg(1 / F.col("n")).alias("s"))
    spread = F.col("m") * (1 - F.col("m"))
    between = F.col("v") - spread * F.col("s")
    prior = F.when(between > 1e-9, spread / between - 1).otherwise(F.lit(PRIOR_ROWS[1]))
    moments = moments.select("m", F.least(F.greatest(prior, F.lit(PRIOR_ROWS[0])), F.lit(PRIOR_ROWS[1])).alias("prior"))
    moments = moments.withColumn("limit", F.least(F.col("m") + sds * F.sqrt(spread / (F.col("prior") + 1)), (1 + F.col("m")) / 2))
    rate = (F.col("failed") + F.col("m") * F.col("prior")) / (F.col("n") + F.col("prior"))
    # a join with one row: a nested loop over the hosts, not a product of tables
    out = hosts.join(F.broadcast(moments), F.lit(True)).withColumn("rate", rate)
    low = F.col("rate") - sds * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("prior") + 1))
    return out.select("host", "n", "failed", "rate", "limit", (low > F.col("limit")).alias("rejected"))


def apply_rules(docs: DataFrame, host: str = "source", sds: float = SDS) -> DataFrame:
    """doc_id, the rules of document_rules(), host_rate and kept for every row of docs (doc_id, text, the host column, any others).

    kept is false for rows that fail by themselves and for all rows of a host that host_rates() rejects. A null host is a host of its own.
    Repeated rows count, and come out, as often as they stand there. The rules are computed once and checkpointed without the texts; the
    verdicts, one row per host, join back by host (a hot host is split by the engine's skew handling; the join is broadcast only where the
    measured size allows it). An empty table gives no rows.
    """
    rules = materialised(document_rules(docs, "doc_id", host))
    verdicts = host_rates(rules, host, sds).select(F.col("host").alias("q_host"), F.col("rate").alias("host_rate"), "rejected")
    out = rules.join(verdicts, F.col(host).eqNullSafe(F.col("q_host")), "left").drop("q_host", host)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).drop("rejected")


def op8_quality(spark, sf_dir):
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate of all documents."""
    out = apply_rules(documents(spark, sf_dir))
    return out.withColumn("host_rate", F.round("host_rate", 6))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, source, x, regexp_extract_all(x, '[^ 	-
]+') AS w, row_number() OVER () AS k FROM t),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
d AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
r AS (SELECT k, count(DISTINCT i + o) AS r FROM d, (VALUES (0), (1), (2)) AS s(o) GROUP BY k),
l AS (SELECT k, count(*) - count(DISTINCT l) AS dl FROM (SELECT k, unnest(string_split(x, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^ 	-
]') GROUP BY k),
b AS (SELECT w.doc_id, source, len(w.w)::BIGINT AS n_words, len(regexp_replace(x, '[ 	-
]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dl, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (k) LEFT JOIN l USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM f GROUP BY source),
m AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v, avg(1 / n) AS s FROM h),
p AS (SELECT m, least(greatest(CASE WHEN v - m * (1 - m) * s > 1e-9 THEN m * (1 - m) / (v - m * (1 - m) * s) - 1 ELSE 1000.0 END, 2.0), 1000.0) AS prior FROM m),
q AS (SELECT m, prior, least(m + 2.0 * sqrt(m * (1 - m) / (prior + 1)), (1 + m) / 2) AS most FROM p),
v AS (SELECT source, n, (failed + m * prior) / (n + prior) AS rate, prior, most FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
  NOT base_failed AND NOT rate - 2.0 * sqrt(rate * (1 - rate) / (n + prior + 1)) > most AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
