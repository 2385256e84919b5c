"""Word histograms over row-count panes of a whole stream, and their top and bottom words."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from panewise.functions.arith import div
from panewise.functions.checks import positive
from panewise.functions.text import WHITESPACE, WHITESPACE_CHAR, split_words
from panewise.operators.ranges import explode_range
from panewise.operators.running import number_all_rows, running_sum, total_weight


# Lines are long, so fewer of them make a chunk: 2^8 lines, then 2^18 and 2^19 totals.
LINE_BITS = (8, 18, 19)

# With no more panes per row than this, counting in slices first costs more than it saves.
FEW_PANES = 8

# Words of a stretch that meet in one task of `top_words_of_lines`; longer panes than LONGEST don't.
STRETCH, LONGEST = 1 << 17, 1 << 20
# Words of a block that are looked at by name, and places in a stretch's table of marks.
LISTED, MARKS = 32, 4096

# Panes of a stretch in which changes of counts are summed: 2^20.
CHANGE_BITS = 20


def histogram(rows: DataFrame, word: str, into: str = "cnt") -> DataFrame:
    return rows.groupBy(word).agg(F.count(F.lit(1)).alias(into))


def _lines(lines: DataFrame, column: str, order_by: str) -> DataFrame:
    """Lines stay texts until they are where their words are needed: an array of words is several times as large."""
    return lines.select(order_by, F.col(column).alias("__line"), F.size(split_words(column)).alias("__words"))


def number_lines(lines: DataFrame, column: str, order_by: str) -> DataFrame:
    """`__before, __line, __words`: each line with the words of all lines before it and its own number of words."""
    summed = running_sum(_lines(lines, column, order_by), order_by, F.col("__words"), "__upto", bits=LINE_BITS)
    return summed.select((F.col("__upto") - F.col("__words")).alias("__before"), "__line", "__words")


def number_words(lines: DataFrame, column: str, order_by: str) -> DataFrame:
    """`seq, word`: the words of all lines, numbered 1, 2, 3, ... in line order.

    Only lines are ordered, with their word counts as weights; a word's number is its place in its
    line after the words of all lines before.
    """
    placed = number_lines(lines, column, order_by)
    placed = placed.select("__before", F.posexplode(split_words("__line")).alias("__at", "word"))
    return placed.select((F.col("__before") + F.col("__at") + 1).alias("seq"), "word")


def total_words(lines: DataFrame, column: str, order_by: str) -> Column:
    """Number of words of all lines, as a scalar subquery that shares the counts of `number_lines`."""
    return total_weight(_lines(lines, column, order_by), order_by, F.col("__words"), LINE_BITS)


def slice_rows(size: int, slide: int) -> int:
    """The rows of a slice, the longest run of rows that always share their panes; 1 where counting in slices
    first saves nothing."""
    return gcd(size, slide) if size > FEW_PANES * slide else 1


def slices_of(numbered: DataFrame, word: str, run: int, seq: str = "seq") -> DataFrame:
    """`__slice, word, __cnt`: word counts of slices of `run` rows; rows are numbered from 1."""
    if run == 1:
        return numbered.select((F.col(seq) - 1).alias("__slice"), word, F.lit(1).cast("bigint").alias("__cnt"))
    return numbered.groupBy(div(F.col(seq) - 1, run).alias("__slice"), word).agg(F.count(F.lit(1)).alias("__cnt"))


def panes_of_slices(
    slices: DataFrame, word: str, run: int, size: int, slide: int, first: Column, last: Column
) -> DataFrame:
    """`pane, word, cnt`: the panes from `first` to `last`, each slice sent to those that hold it."""
    start = F.col("__slice") * run
    begin = F.greatest(div(start + (run + slide - 1), slide), first.cast("bigint"))
    end = F.least(div(start + size, slide), last.cast("bigint"))
    panes = slices.withColumn("pane", F.explode(F.when(begin <= end, F.sequence(begin, end))))
    return panes.groupBy("pane", word).agg(F.sum("__cnt").alias("cnt"))


def pane_histogram(
    numbered: DataFrame, word: str, size: int, slide: int, total: Column, seq: str = "seq"
) -> DataFrame:
    """`pane, word, cnt`: word counts of the panes of a stream numbered 1..total by `seq`.

    Pane j holds the last `size` rows up to row j * slide. With many panes per row, rows are first counted per
    slice, and slices then sent to their panes; where slices would be single rows, panes follow from what
    enters and leaves them (`changes`).
    """
    positive(size=size, slide=slide)
    run = slice_rows(size, slide)
    if run == 1 and size > FEW_PANES * slide:
        return histogram_by_changes(numbered, word, size, slide, total, seq)
    return panes_of_slices(slices_of(numbered, word, run, seq), word, run, size, slide, F.lit(1), div(total, slide))


def histogram_by_changes(
    numbered: DataFrame, word: str, size: int, slide: int, total: Column, seq: str = "seq", bits: int = CHANGE_BITS
) -> DataFrame:
    """`pane_histogram` from what changes between panes: a row enters one pane and leaves after another one.

    A word's count in a pane is the sum of its changes so far, so a row is two changes however many panes it is
    in, and changes are combined before the shuffle. Panes are cut into stretches of 2^bits; each gets the
    count its word begins it with, so no word is summed in one task, and counts that stay the same are expanded
    to their panes last.
    """
    at = F.col(seq)
    enters, leaves = div(at + (slide - 1), slide), div(at + (size - 1), slide) + 1
    one = lambda pane, by: F.struct(pane.alias("pane"), F.lit(by).cast("bigint").alias("by"))
    changes = numbered.select(F.col(word).alias("__word"), F.explode(F.array(one(enters, 1), one(leaves, -1))).alias("c"))
    # The last row of all ends no pane, so some rows enter and leave between two panes.
    changes = changes.groupBy("__word", F.col("c.pane").alias("pane")).agg(F.sum("c.by").alias("by")).where("by <> 0")
    changes = changes.withColumn("__part", F.shiftright("pane", bits))
    last = div(total, slide)
    sums = changes.groupBy("__word", "__part").agg(F.sum("by").alias("by"))
    by_part = Window.partitionBy("__word").orderBy("__part")
    # A word's count at the end of a stretch is that at the start of the next ones, up to its next change.
    kept = sums.select(
        "__word",
        (F.col("__part") + 1).alias("__from"),
        F.coalesce(F.lead("__part").over(by_part), F.shiftright(last.cast("bigint"), bits)).alias("__to"),
        F.sum("by").over(by_part).alias("by"),
    )
    kept = explode_range(kept.where("by <> 0"), F.col("__from"), F.col("__to"), "__part").drop("__from", "__to")
    begins = kept.withColumn("pane", F.shiftleft("__part", bits))
    rows = changes.unionByName(begins).groupBy("__word", "__part", "pane").agg(F.sum("by").alias("by"))
    within = Window.partitionBy("__word", "__part").orderBy("pane")
    stretches = rows.select(
        "__word", "pane",
        F.sum("by").over(within).alias("cnt"),
        F.coalesce(F.lead("pane").over(within) - 1, F.shiftleft(F.col("__part") + 1, bits) - 1).alias("__until"),
    )
    until = F.least(F.col("__until"), last.cast("bigint"))
    stretches = stretches.where("cnt > 0").withColumnRenamed("pane", "__since").withColumn("__until", until)
    panes = explode_range(stretches, F.col("__since"), F.col("__until"), "pane")
    return panes.select("pane", F.col("__word").alias(word), "cnt")


def stream_histogram(rows: DataFrame, word: str, order_by: str, size: int, slide: int) -> DataFrame:
    """`pane_histogram` of a table read in the order of a unique integer column."""
    needed = rows.select(order_by, word)
    total = total_weight(needed, order_by, F.lit(1))
    numbered = number_all_rows(needed, order_by, "__seq")
    return pane_histogram(numbered, word, size, slide, total, "__seq")


def top_words(panes: DataFrame, word: str, k: int) -> DataFrame:
    """The k most frequent words of every pane with their place `r`; ties go by word."""
    positive(k=k)
    order = Window.partitionBy("pane").orderBy(F.desc("cnt"), word)
    return panes.withColumn("r", F.row_number().over(order).cast("bigint")).where(F.col("r") <= k)


def top_words_of_panes(
    numbered: DataFrame, word: str, size: int, slide: int, total: Column, k: int, seq: str = "seq"
) -> DataFrame:
    """`top_words` of `pane_histogram` for long panes, without counting all words in all panes.

    Panes in a row share most of their rows. For a group of them, a word's count in the rows that all of its panes
    hold is no more than its count in any of them, and its count in the rows that any pane holds is no less. The
    k-th largest of the former is a count that k words reach in every pane, so a word whose latter is below it
    is in no pane's top k, and only the others are sent to the panes of the group. Ties are kept.
    """
    positive(size=size, slide=slide, k=k)
    run = gcd(size, slide)
    slices = numbered.groupBy(div(F.col(seq) - 1, run).alias("__slice"), F.col(word).alias("__word")).agg(
        F.count(F.lit(1)).alias("__cnt")
    )
    asked = candidates_of_groups(slices, run, size, slide, total, k)
    panes = asked.withColumn("pane", F.explode(F.sequence("__first", "__last")))
    counts = panes.groupBy("pane", F.col("__word").alias(word)).agg(F.sum("__cnt").alias("cnt"))
    return top_words(counts, word, k)


def candidates_of_groups(slices: DataFrame, run: int, size: int, slide: int, total: Column, k: int) -> DataFrame:
    """The slices (__slice, __word, __cnt) by `__group` of panes, with the `__first` and `__last` pane there that
    holds them, of words that may be among the k of a pane of the group."""
    panes = max(1, size // (8 * slide))
    start, last_pane = F.col("__slice") * run, div(total, slide)
    first = div(start + (run + slide - 1), slide)
    last = F.least(div(start + size, slide), last_pane.cast("bigint"))
    placed = slices.select("*", first.alias("__from"), last.alias("__to")).where("__from <= __to")
    groups = F.sequence(div(F.col("__from") - 1, panes), div(F.col("__to") - 1, panes))
    placed = placed.withColumn("__group", F.explode(groups))
    opens, closes = F.col("__group") * panes + 1, F.least((F.col("__group") + 1) * panes, last_pane.cast("bigint"))
    placed = placed.withColumn("__first", F.greatest("__from", opens)).withColumn("__last", F.least("__to", closes))
    in_all = (F.col("__first") == opens) & (F.col("__last") == closes)
    counts = placed.groupBy("__group", "__word").agg(
        F.sum("__cnt").alias("__most"), F.sum(F.when(in_all, F.col("__cnt")).otherwise(0)).alias("__least")
    )
    order = Window.partitionBy("__group").orderBy(F.desc("__least"))
    kth = counts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    kth = kth.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"), F.min("__least").alias("__kth"))
    # With fewer words than k all of them stay.
    kth = kth.select("__group", F.when(F.col("__n") == k, F.col("__kth")).otherwise(0).alias("__kth"))
    able = counts.join(kth, "__group").where(F.col("__most") >= F.col("__kth")).select("__group", "__word")
    met = able.select(F.col("__group").alias("__g"), F.col("__word").alias("__w"))
    return placed.join(met, (F.col("__group") == F.col("__g")) & F.col("__word").eqNullSafe(F.col("__w")), "left_semi")


def top_words_of_lines(
    lines: DataFrame, column: str, order_by: str, size: int, slide: int, k: int, word: str = "word",
    stretch: int = STRETCH, listed: int = LISTED,
) -> DataFrame:
    """`top_words` of panes over the words of all lines, in the order of `order_by`.

    Lines are cut into stretches of blocks of words, each with the blocks before it that its panes reach into, and
    shuffled once by their stretch; all counts then stay where they are. A group of panes ends in one block. The
    `listed` largest counts of the blocks that all its panes hold give a count that k words reach in each of them.
    A word among the k reaches that count in the blocks that any pane holds, so in one of them it has its share
    of it. Words without that share in any block of the stretch are never counted in panes. Blocks that may have more
    such words than are listed keep all words of their stretch.
    """
    positive(size=size, slide=slide, k=k)
    total = total_words(lines, column, order_by)
    if max(size, slide) > LONGEST:
        numbered = number_words(lines, column, order_by).withColumnRenamed("word", word)
        return top_words_of_panes(numbered, word, size, slide, total, k)
    panes = max(1, size // (8 * slide))
    block = panes * slide
    reach = max(0, -(-(size - slide) // block))  # a group's panes hold rows of its block and of so many before it
    groups = max(4 * reach, -(-stretch // block))
    held = _by_stretch(number_lines(lines, column, order_by), block, groups, reach)
    marks = _marks(held, size, block, panes, groups, reach, max(listed, k), k)

    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(MARKS)).cast("int")
    each = F.transform(F.split("__line", WHITESPACE_CHAR), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    able = F.filter(each, lambda x: F.col("__open") | F.get("__marks", slot(x["w"])))
    words = held.join(marks.hint("shuffle_hash"), "__stretch").select("__stretch", "__from", F.explode(able).alias("__x"))
    run = gcd(size, slide)
    place = div(F.col("__from") + F.col("__x.i"), run).alias("__slice")
    slices = words.groupBy("__stretch", place, F.col("__x.w").alias(word)).agg(F.count(F.lit(1)).alias("__cnt"))
    start = F.col("__slice") * run
    first = F.greatest(div(start + (run + slide - 1), slide), F.col("__stretch") * (groups * panes) + 1)
    last = F.least(
        div(start + size, slide), (F.col("__stretch") + 1) * (groups * panes), div(total, slide).cast("bigint")
    )
    shown = slices.withColumn("pane", F.explode(F.when(first <= last, F.sequence(first, last))))
    counts = shown.groupBy("__stretch", "pane", word).agg(F.sum("__cnt").alias("cnt"))
    order = Window.partitionBy("__stretch", "pane").orderBy(F.desc("cnt"), word)
    top = counts.withColumn("r", F.row_number().over(order).cast("bigint")).where(F.col("r") <= k)
    return top.drop("__stretch")


def _by_stretch(numbered: DataFrame, block: int, groups: int, reach: int) -> DataFrame:
    """`__stretch, __from, __line`: the parts of lines that a stretch holds, one white space between words, each with
    the number of words before it."""
    long = block * groups
    before, upto = F.col("__before"), F.col("__before") + F.col("__words")
    first, last = div(before, long), div(div(upto - 1, block) + reach, groups)

    def parts(words: Column) -> Column:
        def part(s: Column) -> Column:
            begin = F.greatest(before, (s * groups - reach) * block)
            size = F.least(upto, (s + 1) * long) - begin
            text = F.array_join(F.slice(words, (begin - before + 1).cast("int"), size.cast("int")), " ")
            return F.struct(s.alias("__stretch"), begin.alias("__from"), text.alias("__line"))

        return F.transform(F.sequence(first, last), part)

    # Most lines are in one stretch and stay as they are. In an array of its own, a line's words are split once for all
    # its stretches.
    body = F.rtrim("__line", F.lit(WHITESPACE))
    one = F.array(F.struct(first.alias("__stretch"), before.alias("__from"), body.alias("__line")))
    cut = F.when(first == last, one).otherwise(F.flatten(F.transform(F.array(split_words("__line")), parts)))
    cut = numbered.where(F.col("__words") > 0).select(F.explode(cut).alias("__p")).select("__p.*")
    # A fixed number: what comes of a small partition is many times its size.
    return cut.repartition(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__stretch")


def _marks(
    held: DataFrame, size: int, block: int, panes: int, groups: int, reach: int, listed: int, k: int
) -> DataFrame:
    """`__stretch, __open, __marks`: by a word's hash, whether the stretch counts it; if open, it counts all."""
    words = held.select("__stretch", "__from", F.posexplode(F.split("__line", WHITESPACE_CHAR)).alias("__at", "__word"))
    at = div(F.col("__from") + F.col("__at"), block).alias("__block")
    counts = words.groupBy("__stretch", at, "__word").agg(F.count(F.lit(1)).alias("__cnt"))
    largest = Window.partitionBy("__stretch", "__block").orderBy(F.desc("__cnt"))
    most = counts.withColumn("__r", F.row_number().over(largest)).where(F.col("__r") <= listed)

    # The groups of the stretch whose panes all hold the block: the first of several panes doesn't hold its own.
    opens, closes = F.col("__stretch") * groups, (F.col("__stretch") + 1) * groups - 1
    first = F.greatest(F.col("__block") + (0 if panes == 1 else 1), opens)
    last = F.least(F.col("__block") + (size // block - 1), closes)
    of_groups = most.withColumn("__group", F.explode(F.when(first <= last, F.sequence(first, last))))
    sums = of_groups.groupBy("__stretch", "__group", "__word").agg(F.sum("__cnt").alias("__least"))
    order = Window.partitionBy("__stretch", "__group").orderBy(F.desc("__least"))
    kth = sums.withColumn("__k", F.row_number().over(order)).where(F.col("__k") == k)
    # What each block's words are held against: the least of the groups that hold the block, none if one has none.
    reached = F.sequence(F.col("__group") - reach, F.col("__group"))
    known = kth.select("__stretch", "__least", F.explode(reached).alias("__block"))
    known = known.groupBy("__stretch", "__block").agg(F.min("__least").alias("__least"), F.count(F.lit(1)).alias("__n"))
    asked = F.least(F.col("__block") + reach, closes) - F.greatest(F.col("__block"), opens) + 1
    known = known.where(F.col("__n") == asked).drop("__n")

    able = most.join(known, ["__stretch", "__block"], "left")
    able = able.where(F.col("__cnt") * (reach + 1) >= F.coalesce("__least", F.lit(0)))
    slot = F.pmod(F.xxhash64("__word"), F.lit(MARKS)).cast("int")
    found = able.groupBy("__stretch").agg(
        F.max(F.col("__r") == listed).alias("__open"), F.collect_set(slot).alias("__slots")
    )
    marks = F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), lambda i: F.array_contains("__slots", i))
    return found.select("__stretch", "__open", marks.alias("__marks"))


def bottom_counts(panes: DataFrame, word: str, k: int) -> DataFrame:
    """The k smallest distinct counts of every pane, each with one word (the first by name)."""
    positive(k=k)
    distinct = panes.groupBy("pane", "cnt").agg(F.min(word).alias(word))
    order = Window.partitionBy("pane").orderBy("cnt")
    return distinct.withColumn("r", F.row_number().over(order).cast("bigint")).where(F.col("r") <= k)
