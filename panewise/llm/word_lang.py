"""Languages of words in code-switched text by a linear-chain conditional random field.

A word is a run of letters. Its features are n-grams of its characters with marks at both ends, longer
affixes, the word itself, and the languages whose lexicon lists it; learned transitions weigh a change of
language between neighbours. Forward-backward gives each word's chance of each language; a text's language
is the one with the highest sum of chances, the score its share.

The model is fitted on the driver on a bounded sample: at most `rows` labelled rows of each language, one
stretch of words from a random place of each. Stretches of different languages are joined to sequences
that switch, which is where transitions and borders are learned. Prediction sees the text alone.

A null text, or one without a letter, is `und` with score 0; so is every text if there are no labels. Ties
go to the language first in the alphabet. Repeated rows and rows without an id keep a row each; rows
without an id or a label teach nothing. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from panewise.llm.common import by_size, in_batches

UNKNOWN = "und"
#: Bounds of the training sample: rows of a language, words of a row, languages (those with the most documents).
ROWS, WORDS, LANGUAGES = 400, 60, 256
#: Hashed features; letters beyond the last code are read one by one.
FEATURES, LAST_CODE = 1 << 16, 0x33480

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_OPEN, _CLOSE = 1, 2


# Words ----------------------------------------------------------------------------------------------


def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(LAST_CODE)), bool, LAST_CODE)


@dataclass(frozen=True)
class Words:
    codes: np.ndarray  # of all texts, lower case
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # index of the text of each word

    @classmethod
    def of(cls, texts: list[str], letter: np.ndarray) -> Words:
        lower = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = letter[np.minimum(codes, LAST_CODE - 1)]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in lower])
        return cls(codes, start, end, np.searchsorted(ends, start, side="right"))

    def hashes(self) -> np.ndarray:
        """Equal words have equal hashes: sums of codes times powers, moved to the same power."""
        n = len(self.codes)
        power = np.full(n + 1, _PRIME, np.uint64)
        back = np.full(n + 1, _INVERSE, np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        mixed = (self.codes.astype(np.uint64) + np.uint64(77)) * np.uint64(0xC2B2AE3D27D4EB4F)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * power[:n])])
        return (total[self.end] - total[self.start]) * back[self.start]

    def features(self, pick: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, index of the first feature of each word) of the picked words, whose hashes are given."""
        size = self.end[pick] - self.start[pick] + 2
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)  # in the marked word
        last = np.repeat(size, size) - 1
        at = np.repeat(self.start[pick], size) + place - 1
        c = np.where(place == 0, _OPEN, np.where(place == last, _CLOSE, self.codes[np.clip(at, 0, len(self.codes) - 1)]))
        c = np.concatenate([c, np.zeros(3, np.int64)]).astype(np.uint64)
        n, left = len(place), last - place
        grams = []
        for k, salt in ((2, 11), (3, 23), (4, 37)):
            h = np.full(n, salt, np.uint64)
            for j in range(k):
                h = (h ^ c[j : j + n]) * np.uint64(_PRIME)
                h ^= h >> np.uint64(32)
            # Of the longest grams only the two affixes count.
            good = left >= k - 1 if k < 4 else (left >= 3) & ((place == 0) | (left == 3))
            grams.append((np.where(good, h & np.uint64(FEATURES - 1), FEATURES), good))
        word = (hashes * np.uint64(_PRIME)) >> np.uint64(64 - 16)
        every = np.column_stack([g for g, _ in grams]).astype(np.int64)
        every = np.concatenate([every.ravel(), word.astype(np.int64)])
        owner = np.concatenate([np.repeat(np.arange(len(pick)), size * 3), np.arange(len(pick))])
        keep = every < FEATURES
        every, owner = every[keep], owner[keep]
        order = np.argsort(owner, kind="stable")
        return every[order], np.searchsorted(owner[order], np.arange(len(pick)))


# The chain ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weight: np.ndarray  # features x languages
    lexicon: np.ndarray  # sorted hashes of listed words
    listed: np.ndarray  # for each, whether each language lists it
    listed_weight: np.ndarray  # languages x languages: listed there, said here
    change: np.ndarray  # languages x languages, logarithms
    first: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """A row of scores for each word; each distinct word is scored once."""
        distinct, pick, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        feature, begin = words.features(pick, distinct)
        score = np.add.reduceat(self.weight[feature], begin, axis=0) if len(pick) else np.zeros((0, len(self.languages)))
        return (score + listed_in(distinct, self.lexicon, self.listed) @ self.listed_weight)[which]


def listed_in(hashes: np.ndarray, lexicon: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros((len(hashes), listed.shape[1]))
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return listed[at] * (lexicon[at] == hashes)[:, None]


def marginals(score: np.ndarray, opens: np.ndarray, change: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Chances of each label for each word of many chains in a row; `opens` marks the first word of each.

    Blocks of about sqrt(n) words run side by side: the product of each block's steps carries what comes
    before and after over it, then each block is run on its own. So a text of any length takes about
    sqrt(n) array steps, and the result is that of one pass.
    """
    n, k = score.shape
    if n == 0:
        return np.zeros((0, k))
    length = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // length)
    e = np.ones((blocks * length, k))
    e[:n] = np.exp(score - score.max(1, keepdims=True)) + 1e-30
    new = np.ones(blocks * length, bool)
    new[:n] = opens
    # By place in the block; labels first, so that each step is one product with all blocks.
    e = np.ascontiguousarray(e.reshape(blocks, length, k).transpose(1, 2, 0))
    fresh = [np.flatnonzero(row) for row in new.reshape(blocks, length).T]
    step, begin = np.exp(change), np.exp(first)
    often = 6  # steps between two scalings; numbers stay far inside the range of doubles

    over = np.repeat(np.eye(k)[:, :, None], blocks, axis=2)  # to label, from label, block
    for t in range(length):
        moved = (step.T @ over.reshape(k, k * blocks)).reshape(k, k, blocks)
        at = fresh[t]
        if len(at):
            moved[:, :, at] = begin[:, None, None] * over[:, :, at].sum(0)
        over = moved
        over *= e[t][:, None, :]
        if t % often == 0 or t == length - 1:
            over /= over.max((0, 1))
    left, right = np.ones((k, blocks)), np.ones((k, blocks))
    for b in range(1, blocks):
        x = over[:, :, b - 1] @ left[:, b - 1]
        left[:, b] = x / x.sum()
    for b in range(blocks - 2, -1, -1):
        x = over[:, :, b + 1].T @ right[:, b + 1]
        right[:, b] = x / x.sum()

    ahead = np.empty((length, k, blocks))
    a = left
    for t in range(length):
        a = step.T @ a
        if len(fresh[t]):
            a[:, fresh[t]] = begin[:, None]
        a *= e[t]
        if t % often == 0:
            a /= a.sum(0)
        ahead[t] = a
    b = right
    for t in range(length - 1, -1, -1):
        ahead[t] *= b
        b = step @ (e[t] * b)
        if len(fresh[t]):
            b[:, fresh[t]] = 1.0
        if t % often == 0:
            b /= b.sum(0)
    ahead /= ahead.sum(1, keepdims=True)
    return ahead.transpose(2, 0, 1).reshape(-1, k)[:n]


# Training -------------------------------------------------------------------------------------------


def sequences(stretches: list[tuple[str, str]], size: int = 5, seed: int = 3) -> tuple[list[str], list[list[str]]]:
    """Texts of several short parts from random stretches, and the language of each part."""
    rng = np.random.default_rng(seed)
    words = [(lang, t.split()) for t, lang in stretches]
    texts, langs = [], []
    for _ in range(len(words)):
        parts = []
        for _ in range(size):
            lang, w = words[rng.integers(len(words))]
            n = int(rng.integers(2, 16))
            at = int(rng.integers(max(1, len(w) - n + 1)))
            parts.append((" ".join(w[at : at + n]), lang))
        texts.append([p for p, _ in parts])
        langs.append([g for _, g in parts])
    return texts, langs


def train(stretches: list[tuple[str, str]], rounds: int = 60, rate: float = 0.15, ridge: float = 1e-4) -> Model | None:
    """The field fitted to (text, language) stretches by full-batch Adam; None without any."""
    languages = sorted({lang for _, lang in stretches})
    if not languages:
        return None
    k, number = len(languages), {g: i for i, g in enumerate(languages)}
    texts, langs = sequences(stretches)
    flat = [p for parts in texts for p in parts]
    words = Words.of(flat, letters())
    label = np.array([number[g] for gs in langs for g in gs])[words.text]
    chain = np.repeat(np.arange(len(texts)), [len(p) for p in texts])[words.text]
    opens = np.r_[True, chain[1:] != chain[:-1]] if len(chain) else np.zeros(0, bool)
    distinct, pick, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    if not len(distinct):
        return None
    feature, begin = words.features(pick, distinct)
    owner = np.repeat(np.arange(len(pick)), np.diff(np.r_[begin, len(feature)]))
    counts = np.zeros((len(distinct), k))
    np.add.at(counts, (which, label), 1)
    often = (counts.sum(1) >= 3) & (counts.max(1) >= 0.8 * counts.sum(1))
    listed = (counts[often] == counts[often].max(1, keepdims=True)).astype(float)
    lexicon = distinct[often]
    flags = listed_in(distinct, lexicon, listed)

    used, place = np.unique(feature, return_inverse=True)
    shapes = {"w": (len(used), k), "l": (k, k), "c": (k, k), "f": (k,)}
    p = {n: np.zeros(s) for n, s in shapes.items()}
    m, v = ({n: np.zeros(s) for n, s in shapes.items()} for _ in range(2))
    truth = np.eye(k)[label]
    pairs = np.flatnonzero(~opens)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[pairs - 1], label[pairs]), 1)
    for t in range(1, rounds + 1):
        emit = np.add.reduceat(p["w"][place], begin, axis=0) + flags @ p["l"]
        score = emit[which]
        chance = marginals(score, opens, p["c"], p["f"])
        wrong = truth - chance
        by_word = np.column_stack([np.bincount(which, wrong[:, j], len(distinct)) for j in range(k)])
        g = {
            "w": np.column_stack([np.bincount(place, by_word[owner, j], len(used)) for j in range(k)]),
            "l": flags.T @ by_word,
            "c": seen - expected_changes(score, opens, p["c"], p["f"], chance),
            "f": wrong[opens].sum(0),
        }
        for n in shapes:
            step = g[n] / len(label) - ridge * p[n]
            m[n] = 0.9 * m[n] + 0.1 * step
            v[n] = 0.99 * v[n] + 0.01 * step * step
            p[n] = p[n] + rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.99**t)) + 1e-8)
    weight = np.zeros((FEATURES, k))
    weight[used] = p["w"]
    return Model(languages, weight, lexicon, listed, p["l"], p["c"], p["f"])


def expected_changes(score, opens, change, first, chance) -> np.ndarray:
    """Expected numbers of label pairs, from marginals: the pair's chance is that of the left label times a
    step, each right word seen with all that follows it."""
    e = np.exp(score - score.max(1, keepdims=True)) + 1e-30
    n, k = score.shape
    later = np.ones((n, k))  # what follows each word, by label
    step = np.exp(change)
    ends = np.r_[opens[1:], True]
    # Chains of a training sample are short: run them side by side, by distance from their ends.
    end_of = np.flatnonzero(ends)
    far = end_of[np.searchsorted(end_of, np.arange(n))] - np.arange(n)
    order = np.argsort(far, kind="stable")
    cut = np.searchsorted(far[order], np.arange(1, far.max() + 2))
    for a, b in zip(cut[:-1], cut[1:]):
        i = order[a:b]
        x = (e[i + 1] * later[i + 1]) @ step.T
        later[i] = x / x.sum(1, keepdims=True)
    right = np.flatnonzero(~opens)
    joint = step[None] * (e[right] * later[right])[:, None, :]
    joint /= joint.sum(2, keepdims=True)
    return (joint * chance[right - 1][:, :, None]).sum(0)


# Over tables ----------------------------------------------------------------------------------------


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def stretches(
    docs: DataFrame,
    rows: int = ROWS,
    words: int = WORDS,
    languages: int = LANGUAGES,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> list[tuple[str, str]]:
    """At most `rows` (text, language) of each of the `languages` with the most documents: those with the lowest
    hashes, a stretch of each. A column of labels that is no list of languages can't fill the driver.

    Languages are counted first; the hash then leaves about twice the rows that are wanted, and only their
    stretches meet in the last step, however many rows a language has.
    """
    learn = docs.select(F.col(id).alias("id"), F.col(text).alias("t"), F.col(lang).alias("g"))
    learn = learn.filter(F.col("g").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("t").rlike(r"\p{L}"))
    known = learn.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g").limit(languages)
    counts = {r["g"]: r["n"] for r in known.collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for g, n in sorted(counts.items()) for x in (g, min(1.0, (2 * rows + 100) / n))))
    place = F.xxhash64("id", "t")
    few = learn.filter(F.col("g").isin(list(counts))).withColumn("place", place).filter(F.pmod("place", F.lit(1 << 30)) <= F.get(F.array(share[F.col("g")]), F.lit(0)) * (1 << 30))
    order = Window.partitionBy("g").orderBy("place", "id", "t")
    w = F.split("t", r"\s+")
    from_ = F.pmod("place", F.greatest(F.size(w) - words, F.lit(1))).cast("int") + 1
    few = few.select("g", "place", "id", F.array_join(F.slice(w, from_, F.lit(words)), " ").alias("t"))
    few = few.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= rows)
    return [(r["t"], r["g"]) for r in few.orderBy("g", "no").select("t", "g").collect()]


# Codes that are scored at once; a longer text is cut between words (or in a word longer than that), its
# chain is not.
_AT_ONCE = 1 << 21
# Bytes of the texts that are labelled together; arrays over their codes take some hundred times as much.
_BATCH = 1 << 18


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _AT_ONCE:
        end = at + _AT_ONCE
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + _AT_ONCE
        yield text[at:end]
        at = end
    yield text[at:]


def _label(model: Model, runs: bool):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, languages = letters(), model.languages
        for batch in by_size(batches, "text", most=_BATCH):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if max(map(len, texts)) <= _AT_ONCE:
                words = Words.of(texts, letter)
                score, text = model.emissions(words), words.text
            else:
                parts = [(i, p) for i, t in enumerate(texts) for p in _parts(t)]
                scored = [(i, model.emissions(Words.of([p], letter))) for i, p in parts]
                score = np.concatenate([s for _, s in scored])
                text = np.concatenate([np.full(len(s), i) for i, s in scored])
            chance = marginals(score, np.r_[True, text[1:] != text[:-1]][: len(text)], model.change, model.first)
            n = np.bincount(text, minlength=len(texts))
            total = np.column_stack([np.bincount(text, c, len(texts)) for c in chance.T])
            best = np.round(total, 9).argmax(1)
            share = np.clip(total[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
            said = np.round(chance, 9).argmax(1)
            turn = np.flatnonzero(np.r_[True, (said[1:] != said[:-1]) | (text[1:] != text[:-1])][: len(text)])
            n_runs = np.bincount(text[turn], minlength=len(texts))
            arrays = [
                batch.column("id"),
                pa.array([languages[b] if c else UNKNOWN for b, c in zip(best, n)]),
                pa.array(np.where(n > 0, share, 0.0)),
                pa.array(n.astype(np.int64)),
                pa.array(n_runs.astype(np.int64)),
            ]
            names = ["id", "lang_pred", "score", "n_words", "n_runs"]
            if runs:
                first = np.searchsorted(text, np.arange(len(texts)))
                size = np.diff(np.r_[turn, len(text)])
                each = [(int(turn[i] - first[text[turn[i]]]), int(size[i]), languages[said[turn[i]]]) for i in range(len(turn))]
                at = np.r_[0, np.cumsum(n_runs)]
                arrays.append(pa.array([[dict(zip(("first", "n", "lang"), r)) for r in each[a:b]] for a, b in zip(at[:-1], at[1:])], _RUNS))
                names.append("runs")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return label


_RUN = StructType().add("first", IntegerType()).add("n", IntegerType()).add("lang", StringType())
_FOUND = (
    StructType().add("lang_pred", StringType()).add("score", DoubleType())
    .add("n_words", LongType()).add("n_runs", LongType()).add("runs", ArrayType(_RUN))
)
_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model | None, runs: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, lang_pred, score, n_words, n_runs` per row; with `runs`, also the stretches of words of one language
    as (first word, words, language). Texts are read and answered in place, without a shuffle."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return _identified(rows, model, runs).withColumnRenamed("id", id)


def known(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, all columns, whose language isn't `und`; a null `lang` is filled in with what was found.

    Each column goes to a Python worker once and comes back once."""
    if model is None:
        return docs.filter(F.lit(False))
    label, at = _label(model, False), docs.columns.index(lang)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, text, most=_BATCH):
            own = part.column(text)
            for found in label(iter([pa.RecordBatch.from_arrays([own, own], names=["id", "text"])])):
                said = found.column("lang_pred").cast(part.schema.field(at).type)
                arrays = list(part.columns)
                arrays[at] = pa.compute.coalesce(arrays[at], said)
                whole = pa.RecordBatch.from_arrays(arrays, schema=part.schema)
                yield whole.filter(pa.compute.not_equal(found.column("lang_pred"), UNKNOWN))

    return in_batches(docs, keep, docs.schema)


def _identified(rows: DataFrame, model: Model | None, runs: bool) -> DataFrame:
    out = StructType([rows.schema["id"], *_FOUND.fields[: None if runs else -1]])
    if model is None:
        nothing = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")]
        nothing += [F.lit(0).cast("bigint").alias(c) for c in ("n_words", "n_runs")]
        nothing += [F.array().cast("array<struct<first:int,n:int,lang:string>>").alias("runs")] if runs else []
        return rows.select("id", *nothing)
    return in_batches(rows, _label(model, runs), out)
