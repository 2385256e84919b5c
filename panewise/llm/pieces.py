"""SentencePiece models run by the tokenizers library, held against sentencepiece itself.

The model file is a protobuf message; its pieces, scores and settings are read from the bytes and rebuilt as
a tokenizers pipeline: the normaliser's character map, white space rules and dummy prefix, the marker U+2581
for blanks, a unigram model from the scores or byte-pair merges in the order of the scores, and bytes for
characters that no piece covers.

No piece reaches over a marker from a letter on its left (else texts are encoded whole), so each distinct
stretch of markers and letters is encoded once per task, in batches on several threads. Ids and decoded
texts are those of the tokenizers library in every case. sentencepiece encodes each distinct stretch besides and
normalises each whole text (or encodes it, where stretches can't tell), and the row says whether it gave the same ids.

A null text is an empty one: no ids, decoded as empty. Repeated rows and rows without an id keep a row each.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panewise.llm.common import by_size, in_batches

MARKER = "▁"
#: Kinds of pieces and models in the message.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2

MOST_KEPT = 800_000
RUN = 64  # stretches that are encoded and decoded as one text


# The message ----------------------------------------------------------------------------------------


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: whole numbers, or the bytes of all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class PieceModel:
    content: bytes
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, content: bytes) -> PieceModel:
        pieces, settings = [], {}
        for number, value in fields(content):
            if number == 1:
                own = dict(fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                settings |= {"kind": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0))}
            elif number == 3:
                n = dict(fields(value))
                settings |= {"charsmap": n.get(2, b""), "dummy_prefix": bool(n.get(3, 1)), "squeeze": bool(n.get(4, 1)), "escape": bool(n.get(5, 1))}
        return cls(content, pieces, **settings)

    @classmethod
    def read(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """All ways to put a piece together from two others, pieces with high scores first."""
        normal = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        found = []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in normal and right in normal:
                    found.append((-self.pieces[i][1], i, normal[left], normal[right]))
        return [(self.pieces[a][0], self.pieces[b][0]) for _, _, a, b in sorted(found)]

    def splits_at_markers(self) -> bool:
        """Whether no piece goes on from a letter to a marker, and blanks are all that makes markers."""
        plain = self.escape and not self.charsmap and not any(kind == USER for _, _, kind in self.pieces)
        return plain and not any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, kind in self.pieces if kind != BYTE)

    def normalizer(self):
        from tokenizers import Regex, normalizers as n

        steps = [n.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [n.Strip(), n.Replace(Regex(" {2,}"), " ")]
        steps += [n.Prepend(MARKER)] if self.dummy_prefix else []
        steps += [n.Replace(" ", MARKER)] if self.escape else []
        return n.Sequence(steps)

    def tokenizer(self):
        from tokenizers import AddedToken, Tokenizer, models

        if self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(
                vocabulary, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback
            )
        elif self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            raise ValueError("only unigram and byte-pair models")
        made = Tokenizer(model)
        made.normalizer = self.normalizer()
        made.add_tokens([AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER])
        made.decoder = self.decoder()
        return made

    def decoder(self, first: bool = True):
        """What turns pieces into text; without `first`, that of a stretch inside a text."""
        from tokenizers import decoders

        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix and first else []
        unknown = decoders.Replace(self.pieces[self.unknown][0], " ⁇ ")
        return decoders.Sequence([unknown, decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])


# Encoding and decoding ------------------------------------------------------------------------------

# A stretch without its first marker; every stretch of a text that got a marker before it begins with one.
_STRETCH = re.compile(f"{MARKER}({MARKER}*[^{MARKER}]*)")


def _lists(ids: list[bytes]) -> list[list[int]]:
    return [memoryview(i).cast("I").tolist() for i in ids]


def _cut(ids: list[int], at: int) -> list[bytes]:
    """The ids between those that are `at`."""
    found, packed, start = [], array("I", ids).tobytes(), 0
    for _ in range(ids.count(at)):
        end = ids.index(at, start)
        found.append(packed[4 * start : 4 * end])
        start = end + 1
    return [*found, packed[4 * start :]]


class Codec:
    """Ids of texts and texts of ids by the tokenizers library, held against sentencepiece."""

    def __init__(self, model: PieceModel, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from sentencepiece import SentencePieceProcessor
        from tokenizers import AddedToken, Tokenizer

        self._model = model
        self._whole = model.tokenizer()
        self._bare = Tokenizer(self._whole.model)  # for stretches that are normalised already
        self._bare.decoder = model.decoder(first=False)
        self._judge = SentencePieceProcessor(model_proto=model.content)
        self._split = model.splits_at_markers()
        self._kept: dict[str, bytes] = {}  # ids of stretches
        self._odd: dict[str, tuple[bool | None, str]] = {}  # whether the judge agrees (None: it can't tell), text
        self._unknown_id = model.unknown
        self._control = {i for i, (_, _, kind) in enumerate(model.pieces) if kind == CONTROL}
        self._between = self._piece_between()
        self._runs = Tokenizer(self._whole.model)  # for stretches with that piece between them
        self._runs.decoder = self._bare.decoder
        if self._between:
            self._runs.add_special_tokens([AddedToken(self._between[1], normalized=False, special=True)])

    def _piece_between(self) -> tuple[int, str] | None:
        """A control piece that can't overlap itself, to put between stretches that are encoded as one text."""
        for i in sorted(self._control):
            piece = self._model.pieces[i][0]
            if piece and not any(piece.startswith(piece[-n:]) for n in range(1, len(piece))):
                return i, piece
        return None

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", encoding.ids).tobytes() for encoding in found]

    def _agrees(self, text: str, ids: bytes) -> bool:
        """Whether sentencepiece gives these ids for the whole text."""
        return array("I", self._judge.encode(text)).tobytes() == ids

    def _normal(self, text: str) -> str:
        model = self._model
        if model.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        text = text.replace(" ", MARKER)
        return MARKER + text if model.dummy_prefix and text else text

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        return self.encode_and_decode(texts)[:2]

    def encode_and_decode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool], list[str]]:
        """(little-endian unsigned 32-bit ids, whether both libraries agree, the text they decode to) of each text.

        Where no piece goes on from a letter to a marker, both libraries put nothing together across the start of a
        stretch (markers and what follows them): a merge or a path over that place would need such a piece, and
        byte fallback works letter by letter. So the ids of a text are those of its stretches in a row, and the
        libraries agree on the text if they normalise it alike and agree on each stretch. A stretch is
        judged once, when it is met first; the text as a whole is compared as normalised. Stretches with an
        unknown letter at an edge could be fused across it, so such texts are judged whole. Decoding puts pieces
        side by side, and bytes that make one letter are inside a stretch, so it goes by stretches too; only the
        blank at the start is taken from the whole.

        Stretches go without their first marker. Nearly all decode to themselves, with the judge's consent, so only
        the others keep a verdict and a text, and a text without any of these decodes to what it was normalised to.
        """
        texts = [t or "" for t in texts]
        if not self._split or not self._model.dummy_prefix:
            ids = self._ids(self._whole, texts)
            return ids, list(map(self._agrees, texts, ids)), self.decode_batch(ids)
        normal, cut = [], []
        for text in texts:
            stretches = text.split(" ")
            if "" in stretches or MARKER in text:  # runs of markers, or none at all
                normal.append(self._normal(text))
                cut.append(_STRETCH.findall(normal[-1]))
            else:
                normal.append(MARKER + text.replace(" ", MARKER))
                cut.append(stretches)
        met = set().union(*cut)
        new = list(met - self._kept.keys())
        if len(self._kept) + len(new) > MOST_KEPT:
            self._kept.clear()
            self._odd.clear()
            new = list(met)
        self._learn(new)
        found, agree, back = [], [], []
        for text, whole, stretches in zip(texts, normal, cut):
            ids = b"".join(map(self._kept.__getitem__, stretches))
            odd = [] if self._odd.keys().isdisjoint(stretches) else [self._odd[s] for s in stretches if s in self._odd]
            verdicts = {verdict for verdict, _ in odd}
            found.append(ids)
            if odd:
                whole_back = "".join([self._odd[s][1] if s in self._odd else " " + s.replace(MARKER, " ") for s in stretches])
            else:
                whole_back = whole.replace(MARKER, " ")
            back.append(whole_back.removeprefix(" "))
            if not stretches or None in verdicts:
                agree.append(self._agrees(text, ids))
            else:
                agree.append(False not in verdicts and self._judge.Normalize(text) == whole)
        return found, agree, back

    def _learn(self, new: list[str]) -> None:
        """Encode, judge and decode these stretches: full runs as one text each, all others one by one."""
        if not new:
            return
        judged = self._judge.encode([s.replace(MARKER, " ") for s in new], num_threads=1)
        theirs = [array("I", ids).tobytes() for ids in judged]
        full = len(new) // RUN * RUN if self._between else 0
        left = list(range(full, len(new)))
        if full:
            number, piece = self._between
            runs = [slice(at, at + RUN) for at in range(0, full, RUN)]
            joined = [MARKER + f"{piece}{MARKER}".join(new[run]) for run in runs]
            lists = [encoding.ids for encoding in self._runs.encode_batch_fast(joined, add_special_tokens=False)]
            shown = self._runs.decode_batch(lists, skip_special_tokens=False)
            for run, ids, text in zip(runs, lists, shown):
                some, encoded = new[run], _cut(ids, number)
                # As the piece between is not in the stretches, equal texts are equal stretch by stretch.
                plain = text == " " + f"{piece} ".join(some) and text.count(piece) == RUN - 1
                plain = plain and "" not in some and MARKER not in text and self._unknown_id not in ids
                if plain and encoded == theirs[run]:
                    self._kept.update(zip(some, encoded))
                else:
                    left += range(run.start, run.stop)
        self._learn_singly([new[i] for i in left], [theirs[i] for i in left])

    def _learn_singly(self, new: list[str], judged: list[bytes]) -> None:
        encoded = self._ids(self._bare, [MARKER + s for s in new])
        lists = _lists(encoded)
        decoded = self._bare.decode_batch(lists, skip_special_tokens=False)
        for stretch, own, ids, theirs, back in zip(new, lists, encoded, judged, decoded):
            shown = stretch.replace(MARKER, " ")
            # The judge puts a marker before what it gets and squeezes blanks: only what survives that is comparable.
            # An unknown letter could be fused with one across the stretch's edge.
            if self._unknown_id in own or self._normal(shown) != MARKER + stretch:
                self._odd[stretch] = None, back
            elif ids != theirs or back != " " + shown:
                self._odd[stretch] = ids == theirs, back
        self._kept.update(zip(new, encoded))

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        """Texts of ids by the rebuilt tokenizer's decoder; control pieces stand for nothing."""
        lists = [x if self._control.isdisjoint(x) else [i for i in x if i not in self._control] for x in _lists(ids)]
        return self._whole.decode_batch(lists, skip_special_tokens=False)

    def decode(self, ids: bytes) -> str:
        return self.decode_batch([ids])[0]


def _run(model: PieceModel, threads: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, threads)
        for batch in by_size(batches, "text"):
            texts = batch.column("text").to_pylist()
            found, agree, decoded = codec.encode_and_decode(texts)
            arrays = [
                batch.column("id"),
                pa.array([len(ids) // 4 for ids in found], pa.int64()),
                pa.array([zlib.crc32(ids) for ids in found], pa.int64()),
                pa.array([d == (t or "") for d, t in zip(decoded, texts)], pa.bool_()),
                pa.array(agree, pa.bool_()),
            ]
            names = ["id", "n_tokens", "ids_crc32", "round_trip", "parity"]
            if keep:
                arrays += [pa.array([memoryview(i).cast("I").tolist() for i in found], pa.list_(pa.int32())), pa.array(decoded)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode(
    docs: DataFrame, model: str, threads: int = 2, keep: bool = False, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`id, n_tokens, ids_crc32, round_trip, parity` per row; with `keep`, also the `ids` and the `decoded` text.

    `round_trip`: the ids decode to the text. `parity`: sentencepiece gives the same ids for the whole text. `model` is a path on
    the driver. Rows are read and answered in place, without a shuffle.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"
    out += ", ids array<int>, decoded string" if keep else ""
    return in_batches(rows, _run(PieceModel.read(model), threads, keep), out).withColumnRenamed("id", id)
