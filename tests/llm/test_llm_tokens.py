"""Token counts, packing and SentencePiece against the libraries on whole texts."""

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, decoders

from llm_fixtures import documents, table
from panewise.llm import packing, pieces, token_counts
from panewise.llm.segments import Encoder, Vocabulary

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [r[1] for r in documents()]


def odd_texts(n=600):
    rng = random.Random(2)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "'s", "12", "!", " ", "　", "Σ", "日", "́", "<|endoftext|>", "\r", "\x1d", "ﬁ", "İ", "🙂", "▁", "<s>", "\x00", "..."]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_the_library(path):
    texts = [t for t in TEXTS if t] + odd_texts()
    got = Encoder(Vocabulary.read(path)).ids([t.encode() for t in texts])
    want = [array("I", e.ids).tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert got == want
    counts = Encoder(Vocabulary.read(path)).counts([t.encode() for t in texts] + [None])
    assert counts == [len(w) // 4 for w in want] + [0]


def test_counts_and_cache(spark, tmp_path):
    cache, docs = str(tmp_path / "cache"), table(spark)
    tokenizer = Tokenizer.from_file(WORD)
    want = sorted(
        ((r[0], len((r[1] or "").encode()), n, n > 100) for r in documents() for n in [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)]),
        key=repr,
    )
    for _ in range(2):  # the second time from the cache
        got = token_counts.count_tokens(docs, cache, WORD, limit=100)
        assert sorted(map(tuple, got.collect()), key=repr) == want
        stored = token_counts.stored(spark, cache, Vocabulary.read(WORD))
        distinct = {" ".join((t or "").split()) for t in TEXTS if t is None or t.isascii()}
        assert distinct and stored.count() <= len(set(TEXTS))
    files = {f.inputFiles()[0].rsplit("/", 1)[0] for f in [spark.read.parquet(cache)]}
    assert len(files) == 1
    before = spark.read.parquet(cache).count()
    more = docs.limit(0).unionByName(table(spark, [(500, "quite new", None, None, None), (501, TEXTS[0], None, None, None)]))
    assert token_counts.count_tokens(more, cache, WORD).count() == 2
    assert spark.read.parquet(cache).count() == before + 1
    assert token_counts.count_tokens(docs.limit(0), cache, WORD).count() == 0


def test_cuts():
    assert packing.cuts(5, 5) == [(0, 5)] and packing.cuts(1, 5) == [(0, 1)]
    assert packing.cuts(12, 5) == [(0, 2), (2, 5), (7, 5)]


def test_bins_are_best_fit():
    """Against the list of what is free in the open bins; bins with as much free are alike."""
    rng, bins, free = random.Random(1), packing.Bins(50, 6), []
    for _ in range(3000):
        n = rng.randint(1, 50)
        made = bins.made
        number, offset = bins.place(n)
        fits = [f for f in free if f >= n]
        if fits:
            into = min(fits)
            free.remove(into)
            assert number < made == bins.made
        else:
            if len(free) == 6:
                free.remove(min(free))
            into = 50
            assert number == made and bins.made == made + 1
        assert offset == 50 - into
        if into > n:
            free.append(into - n)


@pytest.mark.parametrize("per_packer", [10, 1000])
def test_packing(spark, per_packer):
    docs = table(spark)
    got = packing.pack(docs, BYTE, most=256, pieces_per_packer=per_packer, open_bins=8).collect()
    tokenizer, want = Tokenizer.from_file(BYTE), []
    for r in documents():
        ids = array("I", [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0])
        for k, (start, n) in enumerate(packing.cuts(len(ids), 256)):
            want.append((r[0], k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    if per_packer == 1000:
        assert len(sequences) <= 1.1 * -(-total // 256) + 1
    assert packing.pack(docs.limit(0), BYTE).count() == 0
    again = packing.pack(docs, BYTE, most=256, pieces_per_packer=per_packer, open_bins=8).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_sentencepiece_parity():
    judge, model = SentencePieceProcessor(model_file=PIECES), pieces.PieceModel.read(PIECES)
    codec, texts = pieces.Codec(model), [*TEXTS, *odd_texts()]
    ids, agree = codec.encode(texts)
    assert all(agree)
    for text, got in zip(texts, ids):
        theirs = judge.encode(text or "")
        assert memoryview(got).cast("I").tolist() == theirs
        assert codec.decode(got) == judge.decode(theirs)
    whole = model.tokenizer()
    assert all(whole.encode(t or "", add_special_tokens=False).ids == judge.encode(t or "") for t in texts[-100:])


def test_ids_and_texts_are_those_of_the_rebuilt_tokenizer():
    judge, codec = SentencePieceProcessor(model_file=PIECES), pieces.Codec(pieces.PieceModel.read(PIECES))
    texts = ["Hello there", "", "ab  cd 日本"]
    want = [judge.encode(t) for t in texts]

    class Other:
        def encode(self, text, **_):
            return [[5] for _ in text] if isinstance(text, list) else [5]

        def piece_to_id(self, piece):
            return judge.piece_to_id(piece)

        def Normalize(self, text):
            return judge.Normalize(text)

    codec._judge = Other()
    ids, agree = codec.encode(texts)
    assert [memoryview(i).cast("I").tolist() for i in ids] == want and agree == [False] * 3
    codec = pieces.Codec(pieces.PieceModel.read(PIECES))  # verdicts are kept
    assert codec.encode(texts) == (ids, [True] * 3) and codec.decode_batch(ids) == texts
    start, unknown = judge.piece_to_id("<s>"), judge.unk_id()
    assert codec.decode(array("I", [start, *want[0], unknown]).tobytes()) == judge.decode([start, *want[0], unknown])
    codec._ids = lambda tokenizer, some: [array("I", [7]).tobytes() if s == "▁Hello" else i for s, i in zip(some, pieces.Codec._ids(tokenizer, some))]
    codec._kept.clear()  # a wrong rebuild shows in the ids and in parity
    ids, agree = codec.encode(texts)
    assert memoryview(ids[0]).cast("I").tolist()[0] == 7 and agree == [False, True, True]
    codec._whole.decoder = decoders.Fuse()
    assert codec.decode(ids[2]).startswith("▁ab")


def test_stretches_judge_and_decode_like_whole_texts():
    """Markers, blanks and control letters in the text, empty texts, and letters the model lacks."""
    model = pieces.PieceModel.read(public_tokenizers.path("piece_bpe_32k.model"))
    codec, judge = pieces.Codec(model, 1), SentencePieceProcessor(model_proto=model.content)
    assert model.splits_at_markers()
    odd = ["", None, " ", "  ", "\u2581", "a\u2581b", "\u2581a \u2581 b", " a  b ", "\n \t", "<s> </s> <unk>", "日本🙂 é\x00", "x" * 700, "<0x41> a"]
    for text in odd + [r[1] for r in documents()]:
        ids, agree, decoded = (x[0] for x in codec.encode_and_decode([text]))
        assert agree == (array("I", judge.encode(text or "")).tobytes() == ids) and decoded == codec.decode(ids)


def test_runs_of_stretches_are_encoded_as_one_text():
    """Only the rest of the last run goes singly, and all stretches of a run that holds something odd."""
    model = pieces.PieceModel.read(PIECES)
    judge, words, singly = SentencePieceProcessor(model_file=PIECES), [f"w{i}é日" for i in range(400)], []
    codec = pieces.Codec(model)
    plain = codec._ids
    codec._ids = lambda tokenizer, some: singly.extend(some) or plain(tokenizer, some)
    odd = ["<s>", "a<s>b", "<s", ">", "\u2581c", "\u2581", "", "<0x41>", "<unk>", "\x00", ""]
    for texts in ([" ".join(words)], [" ".join(words[::-1] + odd), " ".join(odd), " ".join(w + "x" for w in words)]):
        ids, agree, decoded = codec.encode_and_decode(texts)
        for text, got, same, back in zip(texts, ids, agree, decoded):
            theirs = judge.encode(text)
            assert same == (memoryview(got).cast("I").tolist() == theirs) and back == codec.decode(got)
        if len(texts) == 1:
            assert agree == [True] and decoded == texts and len(singly) == 400 % pieces.RUN
    assert set(codec._kept) >= {*words, "<s>", "a<s>b", "\u2581c"} and "" in codec._odd

    class Wrong:
        def encode(self, text, **_):
            return [[5] if t == "w7é日" else judge.encode(t) for t in text] if isinstance(text, list) else judge.encode(text)

        def Normalize(self, text):
            return judge.Normalize(text)

    codec = pieces.Codec(model)
    codec._judge = Wrong()
    texts = [" ".join(words), " ".join(words[8:]), "w7é日"]
    ids, agree, decoded = codec.encode_and_decode(texts)
    assert agree == [False, True, False] and decoded == texts
    assert [memoryview(i).cast("I").tolist() for i in ids] == [judge.encode(t) for t in texts]


def test_a_unigram_model_from_its_message():
    def field(n, kind, data):
        return bytes([n << 3 | kind]) + (bytes([len(data)]) if kind == 2 else b"") + data

    import struct

    def piece(text, score, kind=1):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    message = piece("<unk>", 0, 2) + piece("▁", -2) + piece("a", -3) + piece("b", -3) + piece("▁ab", -1) + piece("ab", -2.5)
    model = pieces.PieceModel.parse(message + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01")))
    assert (model.kind, model.unknown, model.dummy_prefix, model.splits_at_markers()) == (pieces.UNIGRAM, 0, True, True)
    assert model.tokenizer().encode("ab aab").tokens == ["▁ab", "▁", "a", "ab"]


def test_sentencepiece_table(spark):
    judge = SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode(table(spark), PIECES, keep=True).collect()
    want = [(r[0], judge.encode(r[1] or "")) for r in documents()]
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes()) and r.parity
    texts = {r[0]: r[1] for r in documents() if r[0] is not None}
    assert all(r.round_trip == (r.decoded == (texts[r.doc_id] or "")) for r in got if r.doc_id is not None)
    assert pieces.encode(table(spark).limit(0), PIECES).count() == 0
