"""The token ids that the tokenizers library gives, by the cheapest way that gives them.

If a tokenizer drops white space, then no token reaches over it: each distinct word is encoded once per
task. Byte-level vocabularies whose merges rank as their ids do are run by tiktoken on texts of
ASCII and Latin-1 letters. All else is encoded whole by the library. Tests hold all ways against it.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from dataclasses import dataclass

# Words kept in memory per task; the memory starts afresh when it is full.
MOST_KEPT = 800_000

# Bytes of ASCII and of the letters of Latin-1, which every Unicode table classes alike. Other characters
# use lead bytes that are not here.
_PLAIN = bytes([0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3])
# Longer texts are left to the tokenizers library, which bears runs of any length.
_LONGEST = 1 << 20
# Fixed value: the rule of byte-level tokenizers.
_BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Vocabulary:
    """The content of a tokenizer file, read on the driver; workers need not have the file."""

    content: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    @property
    def digest(self) -> str:
        """Changes with anything that could change counts."""
        return hashlib.sha256(self.content.encode()).hexdigest()

    @property
    def rules(self) -> dict:
        return json.loads(self.content)

    def collapses_space(self) -> bool:
        """Whether runs of white space are one blank to it, and blanks at the ends nothing."""
        rules = self.rules
        steps = (rules.get("normalizer") or {}).get("normalizers", [])
        return _drops_space(rules) and any(
            s["type"] == "Replace" and s["pattern"].get("Regex") == r"\s+" and s["content"] == " " for s in steps
        )


def _drops_space(rules: dict) -> bool:
    """A pre-tokenizer that keeps what a pattern matches, and whose pattern never matches white space."""
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]


def _is_byte_level(rules: dict) -> bool:
    step = rules.get("pre_tokenizer") or {}
    return rules.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Strings of special tokens inside a text are read as the library
    does by default. Nothing is added, cut or padded.
    """

    def __init__(self, vocabulary: Vocabulary):
        # Spark gives a task one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        rules = vocabulary.rules
        self._tokenizer = Tokenizer.from_str(vocabulary.content)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._special = [t["content"].encode() for t in rules.get("added_tokens", [])]
        self._drops = _drops_space(rules)
        self._ranks = _by_ranks(rules) if _is_byte_level(rules) else None
        self._ids_of: dict[bytes, bytes] = {}
        self._count_of: dict[bytes, int] = {}

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array("I", encoding.ids).tobytes() for encoding in found]

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        out, words, whole = [b""] * len(texts), {}, []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self._special):
                whole.append(i)
            elif self._drops:
                words[i] = text.split()
            elif self._ranks is not None and len(text) <= _LONGEST and not text.translate(None, _PLAIN):
                out[i] = array("I", self._ranks.encode_ordinary(text.decode())).tobytes()
            else:
                whole.append(i)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        if words:
            encoded = self._known(self._ids_of, words.values(), self._whole)
            for i, of_text in words.items():
                out[i] = b"".join(map(encoded, of_text))
        return out

    def counts(self, texts: list[bytes | None]) -> list[int]:
        """The number of ids of each text; cheaper than the ids where words are counted one by one."""
        if not self._drops or any(s in t for t in texts if t for s in self._special):
            return [len(ids) // 4 for ids in self.ids(texts)]
        words = [t.split() if t else [] for t in texts]
        counted = self._known(self._count_of, words, self._lengths)
        return [sum(map(counted, of_text)) for of_text in words]

    def _lengths(self, texts: list[bytes]) -> list[int]:
        return list(map(len, self._tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)))

    def _known(self, kept: dict, words, encode):
        """Look-up of what `encode` gives for each word, with all of `words` in it."""
        met = set().union(*words)
        new = list(met - kept.keys())
        if len(kept) + len(new) > MOST_KEPT:
            kept.clear()
            new = list(met)
        kept.update(zip(new, encode(new)))
        return kept.__getitem__


def _by_ranks(rules: dict):
    """The same byte-pair encoding by tiktoken, several times as fast, if the file's merges rank as its ids do."""
    model = rules["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    try:
        import tiktoken
    except ImportError:
        return None
    of = {c: b for b, c in enumerate(_byte_letters())}
    special = {t["content"] for t in rules.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = [model["vocab"]["".join(m)] for m in merges] == list(range(256, 256 + len(merges)))
    if not plain or not in_order or len(ranks) != 256 + len(merges):
        return None
    return tiktoken.Encoding("by ranks", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
