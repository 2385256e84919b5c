"""Benchmark decontamination by a distributed positional inverted index.

`build` reads the texts once and stores a posting (document, term, position) for every word that some test
item has, and one header per document. `phrases` cuts items into windows. `phrase_matches` takes each window's
rarest term, moves its postings back by the term's place in the window, and so has the starts where the window
may be; these are intersected with the postings of the second rarest term, and what is left with the lists of
all terms of the window, within the documents that are left. A match is exact, word by word: terms are told
apart by their texts. `near_matches` finds all distinct terms of a phrase within a number of words, in
any order. Built-in functions only.

Null texts and texts without a word have no words. Rows that repeat an id or a whole document keep a row and
a result each. Items that repeat an id count once; items without an id make words hit, and count among no
items; items without a word are no windows. Texts of any length are indexed whole. Empty tables, of documents
or of items, give no rows and no hits. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window, functions as F

from panewise.llm.common import Scratch, numbers

# Fixed value: words are runs of digits, letters a-z and characters outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rows of a table of terms or documents that is sent to every executor, some 16 bytes each; a larger one is
#: joined by a shuffle.
SENT_ROWS = 1 << 20


def words(text: Column) -> Column:
    """The words of a text, A-Z as a-z; none of a null one."""
    low = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def small(rows: DataFrame, count: int | None = None) -> DataFrame:
    """The rows, marked to be sent to every executor if there are no more than SENT_ROWS."""
    return F.broadcast(rows) if (rows.count() if count is None else count) <= SENT_ROWS else rows


@dataclass(frozen=True)
class Index:
    """`heads` (key, id, n_words), `terms` (word, term, n) with the number of postings, and `postings`
    (key, term, pos), each written to the working folder."""

    heads: DataFrame
    terms: DataFrame
    postings: DataFrame


def build(docs: DataFrame, queries: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, for the words of `queries` (words array<string>).

    No text and no posting is shuffled while the test words are few enough to be sent to all executors. Keys
    are given in the job that writes them, so a task that runs again can't tell a document two keys.
    """
    asked = scratch.write(queries.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()))
    read = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(id).alias("id"), words(F.col(text)).alias("words")
    )
    # The last place of each document is its header: no word, and the number of words before it.
    ended = F.concat("words", F.array(F.lit(None).cast("string")))
    placed = read.select("key", "id", F.posexplode(ended).alias("pos", "word"))
    placed = placed.select("key", F.when(F.col("word").isNull(), F.col("id")).alias("id"), "pos", "word")
    count = asked.count()
    if count > SENT_ROWS:
        placed = scratch.write(placed)
    stored = placed.join(small(asked, count), "word", "left").filter(F.col("word").isNull() | F.col("term").isNotNull())
    stored = scratch.write(stored.select("key", "id", "term", "pos"))
    postings = stored.filter(F.col("term").isNotNull()).select("key", "term", "pos")
    heads = stored.filter(F.col("term").isNull()).select("key", "id", F.col("pos").cast("bigint").alias("n_words"))
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = asked.join(counts, "term", "left").select("word", "term", F.coalesce("n", F.lit(0)).alias("n"))
    return Index(heads, scratch.write(terms), postings)


def phrases(items: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """`phrase, words` of the distinct windows of `size` words, and `phrase, item` for the items with each.

    `items` is (item, words). An item with fewer words is one window.
    """
    starts = numbers(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    some = items.filter(F.size("words") > 0)
    windows = some.select("item", "words", F.explode(starts).alias("at"))
    windows = windows.select("item", F.slice("words", F.col("at") + 1, size).alias("words"))
    distinct = scratch.write(windows.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()))
    of = windows.filter(F.col("item").isNotNull()).join(distinct, "words").select("phrase", "item").distinct()
    return distinct, scratch.write(of)


def _places(asked: DataFrame, index: Index) -> DataFrame:
    """`phrase, off, term, rank, length`: the terms of each phrase, the rarest with rank 1."""
    rows = asked.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("off", "word"))
    rows = rows.join(index.terms, "word")
    order = Window.partitionBy("phrase").orderBy("n", "off")
    return rows.select("phrase", "length", "off", "term", F.row_number().over(order).alias("rank"))


def _held(index: Index, places: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The postings of the terms in `places`; of the documents in `found` only, if given."""
    held = index.postings.join(small(places.select("term").distinct()), "term", "left_semi")
    return held if found is None else held.join(small(found.select("key").distinct()), "key", "left_semi")


def phrase_matches(index: Index, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """`phrase, key, start, length`: every place where the words of a phrase stand in a row.

    `asked` is (phrase, words). A candidate is one row for a phrase and a start, so a common word in a
    phrase costs nothing until rarer ones of it were found at their places.
    """
    places = scratch.write(_places(asked, index))
    rarest = places.filter("rank = 1").select("phrase", "off", "term", "length")
    start = F.col("pos") - F.col("off")
    began = index.postings.join(small(rarest), "term").filter(start >= 0).select("phrase", "key", start.alias("start"), "length")
    # A phrase of one word meets that word again.
    second = places.filter(F.col("rank") == F.least(F.lit(2), "length")).select("phrase", "off", "term")
    wanted = began.join(small(second), "phrase").withColumn("pos", F.col("start") + F.col("off"))
    both = wanted.join(_held(index, second), ["key", "term", "pos"], "left_semi")
    both = scratch.write(both.select("phrase", "key", "start", "length"))
    rest = both.join(small(places.select("phrase", "off", "term")), "phrase").withColumn("pos", F.col("start") + F.col("off"))
    lists = _held(index, places.join(both.select("phrase").distinct(), "phrase", "left_semi"), both)
    there = rest.join(lists, ["key", "term", "pos"]).groupBy("phrase", "key", "start").agg(
        F.count(F.lit(1)).alias("n"), F.first("length").alias("length")
    )
    return scratch.write(there.filter(F.col("n") == F.col("length")).select("phrase", "key", "start", "length"))


def near_matches(index: Index, asked: DataFrame, within: int, scratch: Scratch) -> DataFrame:
    """`phrase, key, start`: the first of each `within` words in a row that hold all distinct words of a
    phrase and begin with one of them.

    Postings of the rarest term are met by those of the other terms in their own stretch of `within` words
    and the two beside it, so a group is never larger than three stretches.
    """
    places = _places(asked.withColumn("words", F.array_distinct("words")), index)
    places = scratch.write(places)
    rarest = places.filter("rank = 1").select("phrase", "term", "length")
    stretch = lambda c: F.floor(c / within)
    anchors = index.postings.join(small(rarest), "term").select("phrase", "key", F.col("pos").alias("at"), "length")
    around = anchors.withColumn("block", F.explode(F.sequence(stretch(F.col("at")) - 1, stretch(F.col("at")) + 1)))
    around = around.join(places.select("phrase", "term"), "phrase")
    held = _held(index, places).withColumn("block", stretch(F.col("pos")))
    met = around.join(held, ["key", "term", "block"]).filter(F.abs(F.col("pos") - F.col("at")) < within)
    group = met.groupBy("phrase", "key", "at", "length").agg(F.collect_set(F.struct("pos", "term")).alias("around"))
    begins = F.filter(
        F.array_distinct(F.transform("around", lambda a: a["pos"])),
        lambda s: (s <= F.col("at"))
        & (F.size(F.array_distinct(F.transform(
            F.filter("around", lambda a: (a["pos"] >= s) & (a["pos"] < s + within)), lambda a: a["term"]
        ))) == F.col("length")),
    )
    return scratch.write(group.select("phrase", "key", F.explode(begins).alias("start")).distinct())


def covered(matches: DataFrame) -> DataFrame:
    """`key, n_hit`: the words of each document that are inside of any match."""
    longest = matches.groupBy("key", "start").agg((F.col("start") + F.max("length")).alias("end"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    new = F.greatest(F.col("end") - fresh, F.lit(0))
    return longest.select("key", new.alias("new")).groupBy("key").agg(F.sum("new").cast("bigint").alias("n_hit"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """A row per document: `id`, n_words, n_hit, n_items, items (their ids as sorted strings), contaminated."""
    scratch = Scratch(docs.sparkSession, "positions")
    asked = scratch.write(items.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("words")))
    index = build(docs, asked, scratch, id, text)
    windows, of = phrases(asked, size, scratch)
    matches = phrase_matches(index, windows, scratch)
    named = matches.select("phrase", "key").distinct().join(of, "phrase").select("key", "item").distinct()
    listed = named.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    hit = scratch.write(covered(matches).join(listed, "key", "left"))
    told = index.heads.join(hit, "key", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return told.select(
        F.col("id").alias(id),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("bigint").alias("n_items"),
        items_of.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )
