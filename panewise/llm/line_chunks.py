"""Removal of chunks of lines that are found again anywhere in the corpus.

Lines are hashed, and a rolling hash over the hashes of two lines in a row (lines that aren't blank) is worked out
at every line. Where it is found nowhere else, a boundary is set between its two lines; what lies between two
boundaries is a chunk. A boundary depends on the two lines beside it alone, so no insertion before or after a
shared passage moves its edges, and a chunk begins and ends where the passage does. A line of more than ALONE
words is looked up for itself too. What has a hash that is there again is then compared by its bytes, and goes
where it isn't the first place of them, by id and then place in the text. Built-in functions only.

A null text stays null; a text that loses nothing stays as it is, byte for byte; one all of whose lines
go becomes empty. Blank lines go with the two lines around them. A shared line of at most ALONE words between
two foreign ones stays.

Ids are whole numbers; rows with the same id, or without one, count as one document (those without come last), so
the same lines at the same place in them stay in each. Texts may be of any length. Other columns are handed
through, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panewise.llm.common import ASCII_SPACE, Scratch, let, numbers, same

#: Words of a line beyond which it is a passage of its own.
ALONE = 50

_FILLED = r"[^\x20\x09-\x0D]"
_PLACE = "decimal(38,0)"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(text: Column) -> Column:
    """Array of (first, n, hash): the windows of the rolling hash, each two filled lines and what is between them,
    and then the long lines."""

    def of(lines: Column) -> Column:
        def found(full: Column) -> Column:
            line_hash = lambda i: F.xxhash64(F.get(lines, F.get(full, i)))

            def rolled(hashes: Column) -> Column:
                def pair(i: Column) -> Column:
                    first, last = F.get(full, i), F.get(full, i + 1)
                    both = F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))
                    return F.struct(first.alias("first"), (last - first + 1).alias("n"), both.alias("hash"))

                return F.transform(numbers(F.lit(0), F.size(full) - 2), pair)

            def is_long(i: Column) -> Column:
                return F.size(F.filter(F.split(F.get(lines, i), f"{ASCII_SPACE}+"), lambda w: w != "")) > ALONE

            def alone(i: Column) -> Column:
                return F.struct(i.alias("first"), F.lit(1).alias("n"), F.xxhash64(F.get(lines, i)).alias("hash"))

            pairs = let(F.transform(numbers(F.lit(0), F.size(full) - 1), line_hash), rolled)
            return F.concat(pairs, F.transform(F.filter(full, is_long), alone))

        return let(F.filter(numbers(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(_FILLED)), found)

    return let(_lines(text), of)


def _contents(text: Column, again: Column) -> Column:
    """Array of (first, n, content) of the windows (first, n) in `again`."""

    def of(lines: Column) -> Column:
        def one(c: Column) -> Column:
            content = F.array_join(F.slice(lines, c["first"] + 1, c["n"]), "\n")
            return F.struct(c["first"].alias("first"), c["n"].alias("n"), content.alias("content"))

        return F.transform(again, one)

    return let(_lines(text), of)


def _without(text: Column, removed: Column) -> Column:
    """(text, n_lines, n_removed) without the lines of the windows (first, n) in `removed`."""

    def of(lines: Column) -> Column:
        gone = F.flatten(F.transform(removed, lambda c: numbers(c["first"], c["first"] + c["n"] - 1)))
        stay = F.array_except(numbers(F.lit(0), F.size(lines) - 1), gone)

        def shown(rest: Column) -> Column:
            return F.struct(
                F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n").alias("text"),
                F.size(lines).alias("n_lines"),
                (F.size(lines) - F.size(rest)).alias("n_removed"),
            )

        return let(stay, shown)

    return let(_lines(text), of)


def _place(id: str, first: str) -> Column:
    """Documents in order, then lines; documents without an id come last."""
    number = F.coalesce(F.col(id).cast(_PLACE), F.lit(str(2**63)).cast(_PLACE))
    return (number * F.lit(1 << 31).cast("decimal(10,0)") + F.col(first)).cast(_PLACE)


def _not_first(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """The rows that share their keys with a row at another place; with `least`, the first of the places.

    Places are combined before the shuffle, so what a third of all texts share is one row from each task.
    """
    firsts = rows.groupBy(*keys).agg(F.min(place).alias("least"), F.max(place).alias("most"))
    firsts = firsts.filter(F.col("least") < F.col("most")).select(*keys, "least")
    return rows.join(firsts.hint("merge"), keys)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", told: str = "line_dedup") -> DataFrame:
    """The documents, all columns, with repeated chunks out of `text`, and a last column `told` of (n_lines,
    n_removed), null for a null text.

    Hashes and places of all windows are shuffled first. Texts go through one join with the windows that are
    there again; from then on only texts with such windows are moved, and the bytes of those windows. Joins are
    by merge at every size, so that work grows as the input does.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    own = docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    found = own.select("id", "h", F.explode(windows(F.col("t"))).alias("c")).select("id", "h", "c.*")
    found = scratch.write(found)
    again = _not_first(found, ["hash"], _place("id", "first"))
    again = again.groupBy("id", "h").agg(F.collect_set(F.struct("first", "n")).alias("again"))
    again = again.select(F.col("id").alias("again_id"), F.col("h").alias("again_h"), "again")

    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of the table meets one of ours
    d = docs.toDF(*names.values()).withColumn("id", F.col(names[id]).cast("bigint")).withColumn("h", F.xxhash64(names[text]))
    met = d.join(again.hint("merge"), same(F.col("id"), F.col("again_id")) & (F.col("h") == F.col("again_h")), "left")
    met = scratch.write(met.drop("again_id", "again_h"))
    scratch.drop(found)

    old = F.col(names[text])
    some = met.filter(F.col("again").isNotNull())
    alike = some.select("id", "h", F.explode(_contents(old, F.col("again"))).alias("c")).select("id", "h", "c.*")
    alike = alike.withColumn("hash", F.xxhash64("content"))
    gone = _not_first(alike, ["hash", "content"], _place("id", "first")).filter(_place("id", "first") > F.col("least"))
    gone = gone.groupBy("id", "h").agg(F.collect_set(F.struct("first", "n")).alias("removed"))
    gone = scratch.write(gone.select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h"), "removed"))

    changed = some.join(gone.hint("merge"), same(F.col("id"), F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left")
    # Kept as one column, so that it is worked out once.
    changed = changed.withColumn("new", F.when(F.col("removed").isNotNull(), _without(old, F.col("removed"))))
    n_lines = F.size(_lines(old)).cast("bigint").alias("n_lines")
    n_removed = F.coalesce(F.col("new.n_removed"), F.lit(0)).cast("bigint").alias("n_removed")
    columns = [(F.coalesce("new.text", old) if c == text else F.col(n)).alias(c) for c, n in names.items()]
    changed = changed.select(*columns, F.struct(n_lines, n_removed).alias(told))
    nothing = F.when(old.isNotNull(), F.struct(n_lines, F.lit(0).cast("bigint").alias("n_removed")))
    left = met.filter(F.col("again").isNull()).select(*[F.col(n).alias(c) for c, n in names.items()], nothing.alias(told))
    return left.union(changed)
