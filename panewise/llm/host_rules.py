"""Quality rules by document, and verdicts by host.

Each text is measured and held against plain rules. Failures of each rule, and of any of them, are added up by
host, here the `source`; a beta prior fitted to the hosts' rates by moments (rates of hosts with more documents
weigh more) draws rates of small hosts to the common one. A host is bad, and so are all its documents, if its
drawn rate of documents that fail any rule stands out from the prior: SPREADS standard deviations above its
mean, and TIMES the mean at least; a rate above MOST_FAILED is always too much. Built-in functions only.

A word is `[^\\x20\\x09-\\x0D]+`. A null text has no words, and so fails. Documents without a host form one
host. Repeated rows are measured and counted each, and tie. Texts of any length are measured whole, each in its
row. An empty table gives no rows. Only the id, text and host
columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panewise.llm.common import ASCII_SPACE, let, numbers, same, written

#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Shares of a text beyond which the method's own rules fail it, in hundredths.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 30
#: The drawn rate of failing documents that is bad for any host, and what stands out from the others' rates.
MOST_FAILED, SPREADS, TIMES = 0.5, 2.0, 2.0
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
RULES = ("short", "repetitive", "symbols", "dup_lines")
#: Documents that fail one rule at least.
ANY = "any_rule"


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{ASCII_SPACE}+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeat_words(all_words: Column) -> Column:
    """How many words lie in a window of three words that is found twice or more in the text.

    Windows are sorted by content within the row, so that equal ones are neighbours: n log n steps and no
    pairs, however often a window repeats.
    """

    def window(at: Column) -> Column:
        return F.xxhash64(F.get(all_words, at), F.get(all_words, at + 1), F.get(all_words, at + 2))

    def positions(windows: Column) -> Column:
        again = F.filter(
            windows,
            lambda w, i: F.coalesce(F.get(windows, i - 1)["h"] == w["h"], F.lit(False))
            | F.coalesce(F.get(windows, i + 1)["h"] == w["h"], F.lit(False)),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda w: numbers(w["at"], w["at"] + 2)))))

    starts = numbers(F.lit(0), F.size(all_words) - 3)
    return let(F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.alias("at")))), positions)


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """`id, host`, the measures of each text and which rules it fails."""
    rows = docs.select(F.col(id).alias("id"), F.col(host).alias("host"), F.coalesce(text, F.lit("")).alias("t"))
    t = F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), repeat_words(w).alias("again"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    rows = rows.select(
        "id",
        "host",
        let(words(t), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(without(t, _SPACES)).alias("chars"),
        (F.length(t) - F.length(without(t, _SYMBOLS))).alias("symbols"),
    )
    long = {"n_words": "w.n", "word_chars": "chars", "n_symbols": "symbols", "n_lines": "l.n", "n_dup_lines": "l.dup", "n_repeat_words": "w.again"}
    rows = rows.select("id", "host", *(F.col(c).cast("bigint").alias(name) for name, c in long.items()))
    return rows.withColumns(
        {
            "short": F.col("n_words") < LEAST_WORDS,
            "repetitive": 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"),
            "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars"),
            "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
        }
    ).withColumn(ANY, F.col("short") | F.col("repetitive") | F.col("symbols") | F.col("dup_lines"))


def by_host(rows: DataFrame) -> DataFrame:
    """`host, n` and how many of its documents fail each rule, and any; combined before the shuffle."""
    return rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(r).cast("bigint")).alias(r) for r in (*RULES, ANY))
    )


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """For each rule, and for any, the mean rate and the strength, in documents, of the beta prior; from moments, one row.

    Equal rates everywhere give the strongest prior.
    """
    sums = [F.sum("n").alias("n")]
    for r in (*RULES, ANY):
        sums += [F.sum(r).alias(f"{r}_f"), F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"{r}_s")]
    total = hosts.agg(*sums).first()
    found = {}
    for r in (*RULES, ANY):
        mean = (total[f"{r}_f"] or 0) / (total["n"] or 1)
        variance = (total[f"{r}_s"] or 0.0) / (total["n"] or 1) - mean * mean
        strength = mean * (1 - mean) / variance - 1 if variance > 1e-9 else STRONGEST
        found[r] = (mean, min(max(strength, WEAKEST), STRONGEST))
    return found


def limit(mean: float, strength: float) -> float:
    """The drawn rate above which a host stands out from a prior."""
    spread = (mean * (1 - mean) / (strength + 1)) ** 0.5
    return min(MOST_FAILED, max(mean + SPREADS * spread, TIMES * mean))


def bad_hosts(hosts: DataFrame) -> DataFrame:
    """`host` and its drawn rates by rule, for hosts whose drawn rate of any is above the limit."""
    known = priors(hosts)
    drawn = {r: (F.col(r) + mean * strength) / (F.col("n") + strength) for r, (mean, strength) in known.items()}
    return hosts.select("host", *(rate.alias(r) for r, rate in drawn.items())).filter(F.col(ANY) > limit(*known[ANY]))


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """`id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept` per row.

    Texts are read once; hosts and verdicts come from the written measures. A hot host's measures are added
    up before the shuffle, and in the last join it is split like any skewed key.
    """
    rows = written(measured(docs, id, text, host), "measures")
    bad = bad_hosts(written(by_host(rows), "hosts")).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    failed = F.col("short") | F.col("repetitive")
    return rows.join(bad, same(F.col("host"), F.col("bad_host")), "left").select(
        F.col("id").alias(id),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("bad").isNull()).alias("kept"),
    )
