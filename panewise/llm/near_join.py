"""Jaccard join of texts by their shingles, through groups of similar texts.

Texts with the same set of shingles are one class. Shingles are put in one order, rare ones first, by a
sketch of how many texts have them; two sets that are similar enough share one of their first few shingles.
Classes that share such a shingle are compared with its most central class, and what links is one family. Where
classes of several families still share one, and sizes and places leave room for a link, the classes of all
shingles with the same central class are a group. In a group the classes first meet as counts of their shingles by ranges of
hashes, which bound the overlap of any two from above and take a small part of the room; classes that no other can
be linked with by that bound go. For those left a group's token union bounds the overlap of a class with all its
members at once, and the group is opened only for classes that qualify, and that are not of its central class's
family. A row goes from a class to each of its groups, never from a class to a class, so no pair is written
down; inside a group, block meets part, and of the links found only those that connect are kept. No link
between families is lost.

The sketch has a fixed size and only decides an order: collisions cost time, never links. Shingles are
64-bit hashes. Texts of any length are cut into shingles whole. A null or empty text has no shingles and is linked with nothing. Repeated rows keep a row
each; rows without an id take part, and count in no smallest id. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panewise.llm.common import Scratch, by_size, dropping_shuffles, in_batches
from panewise.llm.components import components
from panewise.llm.shingles import shingle_sets

#: Counters of the sketch, in blocks; one byte each reaches the executors. It counts the shingles whose hash
#: has no bit of SKIP: counts are less crowded, and the others come after the rare ones of these.
SLOTS, BLOCK, SKIP = 1 << 25, 1 << 14, 1
#: Bits of the filter that texts pass before their shingles are sent anywhere; a power of two.
FILTER_BITS = 1 << 23
#: Shingles of a group's members, and of queries, that meet in one task.
MEMBER_TOKENS, QUERY_TOKENS = 1 << 19, 1 << 20
#: The same where they meet as counts; their least number of ranges, and the shingles of a range at most, on average.
SIFT_TOKENS = 1 << 22
RANGES, PER_RANGE = 64, 8
#: Beyond so many first shingles they are dealt out in rounds, each with its share of the disk.
ROUND_TOKENS, ROUNDS = 1 << 22, 4


@dataclass(frozen=True)
class Threshold:
    """Linked if den * |A and B| >= num * |A or B|."""

    num: int
    den: int

    def overlap(self, n, m):
        """The least overlap of linked sets of these sizes."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """So many first shingles suffice: a linked set shares one of them."""
        return n - -(-self.num * n // self.den) + 1 if n else 0


# How many texts have a shingle, about ----------------------------------------------------------------


def _slots(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(1)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _count(size: int, lanes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(SLOTS, np.uint16)
        for batch in by_size(batches, "text", most=2 << 20):
            for tokens in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), size):
                slots = _slots(tokens[tokens & np.uint64(SKIP) == 0])
                counts[slots] = np.minimum(counts[slots], 65534) + 1
        blocks = counts.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(full.astype(np.int32)),
                pa.array(np.full(len(full), TaskContext.get().partitionId() % lanes, np.int32)),
                pa.array([zlib.compress(blocks[b].tobytes(), 1) for b in full], pa.binary()),
            ],
            names=["block", "lane", "counts"],
        )

    return count


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for counts in table.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(counts), np.uint16)
    packed = zlib.compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), 1)
    return pa.table([table.column("block")[:1], table.column("lane")[:1], pa.array([packed], pa.binary())], names=["block", "lane", "counts"])


def frequency_levels(texts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """For each slot a level that rises with the count of the texts with a shingle there, and the highest
    level of what is rare: counts of about four times the mean.

    Each task counts all its texts; counts are added in two steps of about the square root of the number of
    tasks, block by block. The driver gets one byte for each slot, whatever the size of the table.
    """
    schema = "block int, lane int, counts binary"
    lanes = int(np.ceil(np.sqrt(texts.rdd.getNumPartitions())))
    counted = in_batches(texts.select("text"), _count(size, lanes), schema)
    summed = counted.groupBy("block", "lane").applyInArrow(_add, schema)
    levels, total = np.zeros((SLOTS // BLOCK, BLOCK), np.uint8), 0
    with dropping_shuffles(texts.sparkSession):
        rows = summed.groupBy("block").applyInArrow(_add, schema).collect()
    for row in rows:
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.uint16)
        total += int(counts.sum())
        levels[row["block"]] = _level(counts)
    return levels.ravel(), int(_level(np.array([2 + 4 * total / SLOTS]))[0])


def _level(counts: np.ndarray) -> np.ndarray:
    """Small counts as they are, beyond them eight levels to a doubling."""
    return np.where(counts < 16, counts, 8 * np.log2(np.maximum(counts, 1)) - 16).astype(np.uint8)


# Sets and what they share ----------------------------------------------------------------------------


def _describe(size: int, threshold: Threshold, levels):
    """`id, h, n, class, sig, prefix` of each text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, rare = levels.value
        for batch in by_size(batches, "text", most=2 << 20):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), size)
            prefixes = []
            for s in sets:
                own = level[_slots(s)].astype(np.int64)
                place = np.where(s & np.uint64(SKIP) == 0, own + (own > rare), rare + 1)
                prefixes.append(s[np.lexsort((s, place))[: threshold.prefix(len(s))]].view(np.int64))
            offsets = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("h"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class(s) for s in sets], pa.binary()),
                    pa.array([_ranges(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["id", "h", "n", "class", "sig", "prefix"],
            )

    return describe


def _class(tokens: np.ndarray) -> bytes | None:
    return hashlib.md5(tokens.tobytes()).digest() if len(tokens) else None


def _ranges(tokens: np.ndarray) -> bytes:
    """How many of the shingles are in each of equal ranges of hashes, 255 at most. The number of ranges is a power
    of two that only depends on the size of the set, and never falls as that grows."""
    width = max(RANGES, 1 << max(0, -(-len(tokens) // PER_RANGE) - 1).bit_length())
    found = np.bincount((tokens >> np.uint64(65 - width.bit_length())).astype(np.int64), minlength=width)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def _folded(sig: np.ndarray, width: int) -> np.ndarray:
    """Counts, or rows of them, of wider ranges."""
    if sig.shape[-1] == width:
        return sig
    return sig.reshape(*sig.shape[:-1], width, -1).sum(-1, dtype=np.uint32)


def _marked(keys: DataFrame) -> np.ndarray:
    """Words of a bit set of FILTER_BITS with the bit of every `k`; other keys may share a bit.

    Bits are combined before the shuffle, and the driver gets FILTER_BITS / 64 rows at most.
    """
    bit = F.col("k").bitwiseAND(F.lit(FILTER_BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k").bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return words


def _tokens(size: int, marked):
    """`k, class, n, tokens` of the texts whose key has a bit in the filter."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = marked.value
        for batch in by_size(batches, "text", most=2 << 20):
            k = batch.column("k").to_numpy()
            bit = k & (FILTER_BITS - 1)
            keep = pa.array(((words[bit >> 6] >> (bit & 63)) & 1) == 1)
            batch = batch.filter(keep)
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    pa.array([_class(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["k", "class", "n", "tokens"],
            )

    return tokens


def _fetched(texts: DataFrame, first: DataFrame, wanted: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """`c, n, tokens` of the wanted classes, worked out again from each class's first text.

    A filter of fixed size keeps nearly all other texts where they are; the join after it is exact.
    """
    first = scratch.write(first.join(wanted, "c", "left_semi"))
    marked = texts.sparkSession.sparkContext.broadcast(_marked(first))
    found = in_batches(texts.select("k", "text"), _tokens(size, marked), "k long, class binary, n long, tokens binary")
    # Rows that repeat are dropped where the join has put them, without another shuffle.
    found = found.join(first, ["k", "class"], "left_semi").dropDuplicates(["k", "class"])
    tokens = scratch.write(found.select(F.xxhash64("class").alias("c"), "n", "tokens"))
    scratch.drop(first)
    return tokens


# Bounds by ranges of hashes --------------------------------------------------------------------------


def _bound(sigs: np.ndarray, over: np.ndarray, sig: np.ndarray, more: int) -> np.ndarray:
    """Not less than the overlap of each of the sets with one set. over and more: shingles beyond 255 of a range."""
    return np.minimum(sigs, sig).sum(-1, dtype=np.int64) + np.minimum(over, more)


def _close(threshold: Threshold):
    """The pairs `c, g` whose bound leaves room for a link."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            least, keep = threshold.overlap(n, m), np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("sig").to_pylist(), batch.column("of_g").to_pylist())):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                width = min(len(a), len(b))
                over = n[i] - int(a.sum()), m[i] - int(b.sum())
                keep[i] = _bound(_folded(a, width), over[0], _folded(b, width), over[1]) >= least[i]
            yield batch.filter(pa.array(keep)).select(["c", "g"])

    return close


def _sift(threshold: Threshold):
    """Queries (asks) and members of a group, or of parts of it, whose bound with one of the other side leaves room
    for a link. Ranges four times as wide are tried first."""

    def sift(queries: pa.Table, members: pa.Table) -> pa.Table:
        asks, held = np.zeros(queries.num_rows, bool), np.zeros(members.num_rows, bool)
        members = members.sort_by("n")
        sizes, ids = members.column("n").to_numpy(), members.column("c").to_numpy()
        sigs = [np.frombuffer(s, np.uint8) for s in members.column("sig").to_pylist()]
        over = sizes - np.array([int(s.sum()) for s in sigs], np.int64)
        cuts = np.flatnonzero(np.diff([len(s) for s in sigs], prepend=0, append=0)).tolist()  # where the width changes
        stacks: list[tuple[int, int, dict]] = [(a, b, {}) for a, b in zip(cuts[:-1], cuts[1:])]
        asked = zip(queries.column("c").to_pylist(), queries.column("n").to_pylist(), queries.column("sig").to_pylist())
        for i, (c, n, sig) in enumerate(asked):
            sig = np.frombuffer(sig, np.uint8)
            more = n - int(sig.sum())
            first = int(np.searchsorted(sizes * threshold.den, n * threshold.num, "left"))
            last = int(np.searchsorted(sizes * threshold.num, n * threshold.den, "right"))
            small = np.uint16 if n < 1 << 16 else np.int64  # a sum of minima is n at most
            for start, end, made in stacks:
                a, b = max(start, first), min(end, last)
                if a >= b:
                    continue
                width = min(len(sigs[start]), len(sig))
                if width not in made:
                    fine = _folded(np.stack(sigs[start:end]), width)
                    wide = _folded(fine, width // 4)
                    made[width] = fine, np.ascontiguousarray(wide.T.astype(np.uint16 if wide.max() < 1 << 16 else np.int64))
                fine, wide = made[width]
                own, least = _folded(sig, width), threshold.overlap(n, sizes[a:b])
                of_own = np.minimum(_folded(own, width // 4), np.iinfo(wide.dtype).max).astype(wide.dtype)
                rough = np.minimum(wide[:, a - start : b - start], of_own[:, None]).sum(0, dtype=small)
                at = np.flatnonzero(rough + np.minimum(over[a:b], more) >= least)
                at = at[ids[a + at] != c]
                at = at[_bound(fine[a - start + at], over[a + at], own, more) >= least[at]]
                asks[i] |= len(at) > 0
                held[a + at] = True
        left = [queries.filter(pa.array(asks)).select(["g", "c"]), members.filter(pa.array(held)).select(["g", "c"])]
        sides = [t.append_column("asks", pa.array([k == 0] * t.num_rows, pa.bool_())) for k, t in enumerate(left)]
        return pa.concat_tables([t.cast(pa.schema([("g", pa.int64()), ("c", pa.int64()), ("asks", pa.bool_())])) for t in sides])

    return sift


def _sigs(signs: DataFrame, wanted: DataFrame) -> DataFrame:
    return signs.join(wanted.select("c").distinct(), "c", "left_semi").distinct()


# Opening groups --------------------------------------------------------------------------------------


def _open(threshold: Threshold):
    """Links of queries with the members of a group, or of a part of a large one: enough of them to connect what
    all of them connect."""

    def links(queries: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if queries.num_rows and members.num_rows:
            sets = [np.frombuffer(t, np.uint64) for t in members.column("tokens").to_pylist()]
            sizes, ids = np.array([len(s) for s in sets]), members.column("c").to_numpy()
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            label = np.arange(len(sets))  # members with the same one are connected already
            for c, tokens in zip(queries.column("c").to_pylist(), queries.column("tokens").to_pylist()):
                q = np.frombuffer(tokens, np.uint64)
                left, right = np.searchsorted(flat, q, "left"), np.searchsorted(flat, q, "right")
                # The union's bound: no member has more of the query than all members together.
                least = max(threshold.overlap(len(q), int(sizes.min())), -(-threshold.num * len(q) // threshold.den))
                if (right > left).sum() < least:
                    continue
                n = right - left
                at = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                shared = np.bincount(owner[at], minlength=len(sets))
                good = np.flatnonzero(shared >= threshold.overlap(len(q), sizes))
                reached, first = np.unique(label[good], return_index=True)
                others = [int(ids[good[i]]) for i in first]
                found += [(c, other) for other in others if other != c]
                if len(reached) > 1:
                    label[np.isin(label, reached)] = reached[0]
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links


def _meeting(
    pairs: DataFrame, members: DataFrame, sets: DataFrame, most: tuple[int, int], work, schema: str, scratch: Scratch
) -> DataFrame:
    """What `work` makes of the queries of `pairs` (c, g) and the members (g, c) of the groups, with what `sets` has
    of each c.

    Members of a group are cut into parts, its queries into blocks, by hash and so that each has a bounded
    number of shingles; every block meets every part. A group of any size is so many small tasks.
    """
    size = sets.select("c", "n")
    asked, held = pairs.join(size, "c"), members.join(size, "c")
    cut = lambda most: F.ceil(F.sum("n") / most).cast("int")
    sizes = asked.groupBy("g").agg(cut(most[0]).alias("blocks")).join(
        held.groupBy("g").agg(cut(most[1]).alias("parts")), "g"
    )
    sizes = scratch.write(sizes)
    part = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = pairs.join(sizes, "g").select("g", every("parts").alias("part"), part("blocks").alias("block"), "c")
    right = members.join(sizes, "g").select("g", part("parts").alias("part"), every("blocks").alias("block"), "c")
    key = ["g", "part", "block"]

    def with_sets(side: DataFrame) -> DataFrame:
        # New names for the columns, as both sides may come from the same tables.
        return side.join(sets, "c").select(*[F.col(c).alias(c) for c in (*key, *sets.columns)])

    met = with_sets(left).groupBy(*key).cogroup(with_sets(right).groupBy(*key))
    made = scratch.write(met.applyInArrow(work, schema))
    scratch.drop(sizes)
    return made


def _opened(
    pairs: DataFrame, members: DataFrame, tokens: DataFrame, threshold: Threshold, scratch: Scratch
) -> DataFrame:
    """Links `a, b` between the queries of `pairs` (c, g) and the members (g, c) of the groups."""
    return _meeting(pairs, members, tokens, (QUERY_TOKENS, MEMBER_TOKENS), _open(threshold), "a long, b long", scratch)


def _sifted(
    pairs: DataFrame, members: DataFrame, signs: DataFrame, threshold: Threshold, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """The `pairs` (c, g) and members (g, c) that may be linked with one of the other side by their bounds."""
    sigs = scratch.write(_sigs(signs, members))  # who asks in a group is one of its members
    schema = "g long, c long, asks boolean"
    left = _meeting(pairs, members, sigs, (SIFT_TOKENS, SIFT_TOKENS), _sift(threshold), schema, scratch)
    kept = [scratch.write(left.filter(F.col("asks") == asks).select("c", "g").distinct()) for asks in (True, False)]
    scratch.drop(sigs, left)
    return kept[0], kept[1]


def join(
    docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`id, n_shingles, component_id` per row: the number of distinct shingles, and the smallest id that links
    lead to. Rows without shingles have their own id."""
    found = _joined(docs, words, num, den, id, text)
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def first_of_each(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents, all columns, that have the smallest id of their component.

    Rows without shingles or without an id stay; rows that repeat an id and its text stay or go together.
    """
    found = _joined(docs, words, num, den, id, text)
    gone = found.filter(F.col("id") != F.col("component_id")).select("id", "h").distinct()
    gone = Scratch(docs.sparkSession, "gone").write(gone)
    gone = gone.select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name of the table meets one of ours
    d = docs.toDF(*names)
    of = dict(zip(docs.columns, names))
    own = (F.col(of[id]).cast("bigint") == F.col("gone_id")) & (F.xxhash64(of[text]) == F.col("gone_h"))
    return d.join(gone, own, "left_anti").toDF(*docs.columns)


def _joined(docs: DataFrame, words: int, num: int, den: int, id: str, text: str) -> DataFrame:
    """`id, h, n, component_id` per row, h the hash of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-join")
    threshold = Threshold(num, den)
    texts = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(texts, words))
    texts = texts.withColumn("h", F.xxhash64("text")).withColumn("k", F.xxhash64("id", "h"))
    sets = in_batches(
        texts.drop("k"),
        _describe(words, threshold, levels),
        "id long, h long, n long, class binary, sig binary, prefix array<long>",
    )
    sets = scratch.write(sets.withColumn("c", F.xxhash64("class")))

    # Shingles that two classes have among their first ones.
    postings = scratch.write(*_postings(sets))
    signs = scratch.write(sets.filter(F.col("n") > 0).select("c", "n", "sig"))
    plain = scratch.write(sets.drop("prefix", "sig"))
    scratch.drop(sets)
    sets, classes = plain, plain.filter(F.col("n") > 0)
    first = _first(classes)

    # Each class against the most central class of the shingles it shares: what links there forms groups.
    q = postings.select("token", F.col("c").alias("g"), F.col("n").alias("m"), F.col("pos").alias("at"))
    met = postings.join(_central(postings), "token").join(q, ["token", "g"]).filter(F.col("c") != F.col("g"))
    met = scratch.write(met.filter(_possible(threshold)).select("c", "g").distinct())
    met, far = _closest(met, signs, threshold, scratch), met
    scratch.drop(far)
    pivots = met.select("g", F.col("g").alias("c")).distinct()
    tokens = _fetched(texts, first, met.select("c").union(pivots.select("c")).distinct(), words, scratch)
    star = _opened(met, pivots, tokens, threshold, scratch)
    scratch.drop(met, tokens)
    groups = components(star).select(F.col("node").alias("c"), F.col("label").alias("g"))

    # What may still link families: places of a shingle from which a set of a fitting size has room for the overlap.
    families = groups.select("c", F.col("g").alias("family"))
    grouped = postings.join(families, "c", "left").withColumn("family", F.coalesce("family", "c"))
    grouped = held = scratch.write(grouped.select("token", "c", "n", "pos", "family"))
    scratch.drop(postings)
    # Sets that may be linked have a band of sizes in common, as each is in two of them.
    key = ["token", "band"]
    grouped = grouped.withColumn("band", F.explode(_bands(threshold)))
    room = grouped.groupBy(*key).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest")
    )
    allowed = (F.col("least") * num <= F.col("n") * den) & (F.col("most") * den >= F.col("n") * num)
    needed = F.greatest(F.ceil(F.col("n") * num / den), F.ceil((F.col("n") + F.col("least")) * num / (num + den)))
    roomy = F.least(F.col("n") - F.col("pos"), F.col("rest")) >= needed
    fit = scratch.write(grouped.join(room, key).filter(allowed & roomy).select(*grouped.columns))
    between = fit.groupBy(*key).agg(F.min("family").alias("low"), F.max("family").alias("high"))
    between = between.filter(F.col("low") < F.col("high")).select(*key)
    able = scratch.write(fit.join(between, key, "left_semi"))
    scratch.drop(held, fit)

    # Groups: the classes of all shingles and bands with the same most central class.
    placed = able.join(_central(able, *key), key).select("g", "c", "family").distinct()
    home = able.select(F.col("c").alias("of"), F.col("family").alias("home")).distinct()
    placed = scratch.write(placed.join(home, F.col("g") == F.col("of")).select("g", "c", (F.col("family") == F.col("home")).alias("own")))
    pairs = scratch.write(placed.filter(~F.col("own")).select("c", "g"))
    members = scratch.write(placed.select("g", "c").join(pairs.select("g").distinct(), "g", "left_semi"))
    scratch.drop(able, placed)
    (pairs, members), far = _sifted(pairs, members, signs, threshold, scratch), (pairs, members)
    scratch.drop(signs, *far)
    tokens = _fetched(texts, first, pairs.select("c").union(members.select("c")).distinct(), words, scratch)
    more = _opened(pairs, members, tokens, threshold, scratch)
    scratch.drop(pairs, members, tokens)
    linked = components(star.unionByName(more)).select(F.col("node").alias("c"), "label")

    # Ids of whole components, then back to the rows.
    least = classes.groupBy("class", "c").agg(F.min("id").alias("least")).join(linked, "c", "left")
    least = scratch.write(least.withColumn("label", F.coalesce("label", "c")))
    smallest = least.groupBy("label").agg(F.min("least").alias("component_id"))
    smallest = scratch.write(least.join(smallest, "label").select(F.col("class").alias("of"), "component_id"))
    scratch.drop(least, star, more)
    out = sets.join(smallest, F.col("class") == F.col("of"), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "h", "n", own.alias("component_id"))


def _postings(sets: DataFrame) -> list[DataFrame]:
    """`token, c, n, pos` of the first shingles that two classes have among theirs, a table for each round.

    A round takes the shingles that fall to it by their hash, so that only its share is shuffled at once.
    """
    total = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    rounds = ROUNDS if total > ROUND_TOKENS else 1
    found = []
    for k in range(rounds):
        rows = sets.select("c", "n", F.posexplode("prefix").alias("pos", "token"))
        rows = rows.filter(F.pmod("token", F.lit(rounds)) == k)
        # n and place share a number to save room.
        rows = rows.select("token", "c", (F.col("n") * (1 << 31) + F.col("pos")).alias("at"))
        shared = rows.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"))
        shared = shared.filter(F.col("low") < F.col("high")).select("token")
        size_of, place_of = F.shiftright("at", 31).alias("n"), (F.col("at") % (1 << 31)).alias("pos")
        found.append(rows.join(shared, "token").distinct().select("token", "c", size_of, place_of))
    return found


def _closest(met: DataFrame, signs: DataFrame, threshold: Threshold, scratch: Scratch) -> DataFrame:
    """The pairs `c, g` of `met` that may be linked by their bounds."""
    sigs = scratch.write(_sigs(signs, met.select("c").union(met.select("g"))))
    other = sigs.select(F.col("c").alias("g"), F.col("n").alias("m"), F.col("sig").alias("of_g"))
    close = in_batches(met.join(sigs, "c").join(other, "g"), _close(threshold), "c long, g long")
    close = scratch.write(close.distinct())
    scratch.drop(sigs)
    return close


def _first(classes: DataFrame) -> DataFrame:
    """`class, c, k`: the key of the first text of each class."""
    first = classes.groupBy("class", "c").agg(F.min(F.struct("id", "h")).alias("r"))
    return first.select("class", "c", F.xxhash64("r.id", "r.h").alias("k"))


def _central(postings: DataFrame, *keys: str) -> DataFrame:
    """`token, g`, or keys and g: of the classes with a shingle the one that has the fewest rarer ones, then the least.

    Near copies of one text have few shingles of their own before those they share: the first of them is
    the likeliest to be linked with the others. Place and class share one number, so that they are compared
    before the shuffle.
    """
    wide, low = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")
    place = F.col("pos").cast("decimal(18,0)") * wide + (F.col("c").cast("decimal(20,0)") + low)
    keys = keys or ("token",)
    least = postings.groupBy(*keys).agg(F.min(place.cast("decimal(38,0)")).alias("place"))
    return least.select(*keys, ((F.col("place") % wide) - low).cast("bigint").alias("g"))


def _bands(threshold: Threshold):
    """Two bands of a size n: sizes that may be linked differ by less than the width of a band."""
    wide = math.log(threshold.den / max(threshold.num, 1e-9)) * 1.01 + 1e-6
    band = F.floor(F.log("n") / wide).cast("bigint")
    return F.array(band, band + 1)


def _possible(threshold: Threshold):
    """Whether sizes n, m and places pos, at of a shared shingle leave room for a link. For a linked pair that
    holds at the first shingle they share, where the most is still to come."""
    num, den = threshold.num, threshold.den
    sizes = (F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)
    bound = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    return sizes & (bound * (num + den) >= (F.col("n") + F.col("m")) * num)
