"""Host-level quality rules, with DataFrame functions only.

Documents are measured one by one, rule failures are summed by host, each host's failure rates are shrunk towards all
hosts' by an empirical beta prior, and the hosts' verdicts are joined back to the documents.

Null and empty texts have no words (and so fail the base rule), null hosts are a host of their own, repeated rows count
as separate documents, an empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.text import SPACE, let, words
from brindle.staging import stage

#: Hosts are joined back in so many parts each, as one host can hold much of the table.
HOST_PARTS = 32
#: A host is refused if a rule's shrunk failure rate is above this.
MAX_RATES = {"fail_base": 0.5, "fail_symbols": 0.6, "fail_lines": 0.6, "fail_word_length": 0.6}


def repeat_words(w: Column, width: int = 5) -> Column:
    """The number of words of ``w`` (an array) that lie in ``width``-word windows found twice or more in it.

    Windows are told apart by their 64-bit hashes. The sorted (hash, start) pairs are only made where a hash repeats.
    """
    hashes = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))),
        lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
    )

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(e: Column) -> Column:
            twin = lambda k: F.coalesce(F.get(e, k)["h"], F.lit(None))
            again = F.filter(e, lambda x, k: F.coalesce((x["h"] == twin(k - 1)) | (x["h"] == twin(k + 1)), F.lit(False)))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        # each start adds the words up to the next start, a window's width at most
        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, starts), total)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the measures of each document's whole text."""
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(host).alias("host"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
        words(F.col(text)).alias("w"),
    )
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]"))
    return base.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", rf"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )


def failures(m: DataFrame) -> DataFrame:
    """Add the rules' verdicts on each document: ``base_failed`` and the softer ``fail_*``."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    return (
        m.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("fail_base", F.col("base_failed"))
        .withColumn("fail_symbols", F.col("n_symbols") * 10 > F.col("n_words"))
        .withColumn("fail_lines", F.col("n_dup_lines") * 10 > n)
        .withColumn("fail_word_length", (mean < 2) | (mean > 15))
    )


def host_rates(docs: DataFrame, rules: list[str]) -> DataFrame:
    """Per host: n_docs, and for each rule the failures and the rate shrunk by the rule's beta prior.

    The prior's mean and weight come from the moments of all hosts' rates: with mean m and variance v its weight is
    m (1 - m) / v - 1, held within 1 and a million (a variance of 0 gives the largest).
    """
    hosts = stage(
        docs.groupBy("host").agg(
            F.count("*").alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules]
        ),
        "hosts",
    )
    moments = hosts.agg(
        *[F.avg(F.col(r) / F.col("n_docs")).alias(f"m_{r}") for r in rules],
        *[F.var_pop(F.col(r) / F.col("n_docs")).alias(f"v_{r}") for r in rules],
    )
    joined = hosts.crossJoin(F.broadcast(moments))  # one row
    for r in rules:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / v - 1))).otherwise(F.lit(1e6))
        joined = joined.withColumn(f"rate_{r}", (F.col(r) + m * weight) / (F.col("n_docs") + weight))
    return joined.select("host", "n_docs", *rules, *[f"rate_{r}" for r in rules])


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_rates: dict[str, float] | None = None,
) -> DataFrame:
    """Each document's measures, ``base_failed``, its host's shrunk rates, ``host_refused`` and ``kept``.

    A document is kept if it passes the base rule and its host isn't refused.
    """
    limits = MAX_RATES if max_rates is None else max_rates
    rules = list(limits)
    m = stage(failures(measures(docs, doc_id, text, host)), "measures")
    refused = F.lit(False)
    for r in rules:
        refused = refused | (F.col(f"rate_{r}") > limits[r])
    verdicts = (
        host_rates(m, rules)
        .select(
            F.col("host").alias("h"),
            F.col("n_docs").alias("host_docs"),
            F.col("rate_fail_base").alias("host_rate"),
            refused.alias("host_refused"),
        )
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    )
    part = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(HOST_PARTS)).cast("int")
    salted = m.withColumn("own", part)
    same = salted["host"].eqNullSafe(verdicts["h"]) & (salted["own"] == verdicts["part"])
    return (
        salted.join(verdicts, same, "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused"))
        .drop("h", "part", "own")
    )
