"""Personal data by boosted trees over candidates.

Four plain patterns give the base spans, which are always kept. Besides, wide generators propose spans
that may overlap: addresses written around filters, numbers grouped like telephones or cards without the
base form, IPv6 addresses, account and social security numbers. Boosted trees see the format of a candidate
and the words around it; a calibrated chance at or above the threshold of its kind selects it, the more
likely first where candidates overlap. Spans that overlap a base span are not added.

The trees are fitted on candidates of a bounded sample of rows, labelled by checks of form (check digits,
octets), and on made-up candidates in the sample's stead for forms it lacks. Spans are in code points, the
end exclusive. A null or empty text has no spans, a text of any length is read
whole, and an empty table gives no rows. Repeated rows keep a row each; candidates with equal chances go by
their place. Other columns are not read.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panewise.llm import boosting
from panewise.llm.common import by_size
from panewise.llm.secrets import Span, scan_spans

# The base patterns, bounds and order of kinds.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARD_DIGITS, _PHONE_DIGITS = range(13, 20), range(9, 16)

#: The kind of added account and social security numbers.
ID = "id"
_ORDER = {k: i for i, k in enumerate((*KINDS, ID))}

_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterator[Span]:
    """From each @: the longest local part to its left, not before the last match; the domain to its right."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """By kind in the order of KINDS, then by start."""
    spans = list(_emails(text)) if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m[0])]
    spans += [("card", *m.span()) for m in _CARD.finditer(text) if len(d := digits(m[0])) in _CARD_DIGITS and luhn(d)]
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if len(digits(m[0])) in _PHONE_DIGITS]
    return spans


# Candidates ---------------------------------------------------------------------------------------

# Every repeat is bounded or can't be given back, so a pass takes time in proportion to the text.
_GENERATORS = [
    ("email", "around", re.compile(r"(?<![\w.])[\w.%+-]{1,64}+ ?[(\[]at[)\]] ?[\w-]{1,63}+(?: ?(?:[(\[]dot[)\]]|\.) ?[\w-]{1,63}+){1,4}", re.I | re.A)),
    ("ip", "v4", re.compile(r"(?<![\w.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![\w.])", re.A)),
    ("ip", "v6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])", re.A)),
    ("card", "grouped", re.compile(r"(?<!\w)[0-9](?:[ -]?[0-9]){11,18}(?!\w)", re.A)),
    ("phone", "grouped", re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,5}(?![\w-])", re.A)),
    ("phone", "plain", re.compile(r"(?<![\w.+-])0[0-9]{8,11}(?![\w.-])", re.A)),
    (ID, "ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A)),
    (ID, "iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)),
]
# Words that tell what a number beside them is, in the languages of the corpus.
_CONTEXT = {
    "phone": re.compile(r"phone|\btel\b|tél|telefon|teléfono|mobile|móvil|handy|\bcall\b|\bfax\b|rufnummer|appel|llam", re.I),
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|write to|schreib", re.I),
    "ip": re.compile(r"\bip\b|host|server|serveur|servidor|address|adresse|dirección|client", re.I),
    "card": re.compile(r"card|carte|karte|tarjeta|visa|mastercard|amex|payment|cvv|credit", re.I),
    ID: re.compile(r"ssn|social security|iban|account|konto|compte|cuenta|passport|sozialversicherung|sécurité sociale", re.I),
    "other": re.compile(r"version|\bv\.?$|order|invoice|isbn|price|total|date|page|figure|chapter|\bno\.|serial|build|ref|[$€£%]\s*$", re.I),
}
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}")
_REACH = 40


@dataclass(frozen=True)
class Candidate:
    kind: str
    form: int
    start: int
    end: int


def candidates(text: str) -> list[Candidate]:
    return [
        Candidate(kind, form, *m.span())
        for form, (kind, _, pattern) in enumerate(_GENERATORS)
        for m in pattern.finditer(text)
    ]


def _mod97(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def possible(text: str, c: Candidate) -> bool:
    """Whether octets and check digits, where the form has them, are right."""
    found, name = text[c.start : c.end], _GENERATORS[c.form][1]
    if name == "v4":
        return octets(found)
    if c.kind == "card":
        return len(d := digits(found)) in _CARD_DIGITS and luhn(d)
    return name != "iban" or _mod97(found)


def well_formed(text: str, c: Candidate) -> bool:
    """What checks of form and the nearest words say; the weak label of a candidate of the corpus."""
    if not possible(text, c):
        return False
    found, name = text[c.start : c.end], _GENERATORS[c.form][1]
    near = text[max(0, c.start - _REACH) : c.start]
    if name == "ssn":
        return bool(_CONTEXT[ID].search(near)) and found[:3] not in ("000", "666") and found[0] != "9"
    if c.kind == "phone":
        return bool(_CONTEXT["phone"].search(near)) and len(digits(found)) in range(7, 16) and not _DATE.fullmatch(found)
    return True


def features(text: str, c: Candidate) -> list[float]:
    """Form of the candidate, then the characters and words around it."""
    found = text[c.start : c.end]
    number = digits(found)
    groups = [len(g) for g in re.findall(r"[0-9]+", found)]
    before, after = text[max(0, c.start - _REACH) : c.start], text[c.end : c.end + _REACH]
    return [
        *(float(c.form == i) for i in range(len(_GENERATORS))),
        len(found),
        len(number),
        len(groups),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        max(groups, default=0),
        len(set(number)),
        float(number[:1] == "0"),
        float(bool(number) and luhn(number)),
        float("." in found),
        float("-" in found),
        float("(" in found),
        float("/" in found),
        float(c.kind == "ip" and "." in found and octets(found)),
        float(_GENERATORS[c.form][1] == "iban" and _mod97(found)),
        float(bool(_DATE.fullmatch(found))),
        float(before[-1:].isspace() or not before),
        float(before[-1:] in "$€£#"),
        float(before[-2:-1] == ":" or before[-1:] == ":"),
        float(after[:1].isspace() or not after),
        float(after[:1] in "%€$"),
        *(float(bool(p.search(before))) for p in _CONTEXT.values()),
        *(float(bool(p.search(after))) for p in _CONTEXT.values()),
        float(bool(_CONTEXT[c.kind].search(before))),
    ]


# Model --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    trees: boosting.Trees
    thresholds: dict[str, float]

    def select(self, texts: list[str]) -> list[list[Span]]:
        """Of each text's candidates, those its kind's threshold lets through; overlaps go to the likelier."""
        found = [candidates(t) for t in texts]
        rows = [features(t, c) for t, cs in zip(texts, found) for c in cs]
        chance = iter(self.trees.chance(np.array(rows)) if rows else ())
        out = []
        for t, cs in zip(texts, found):
            good = sorted(
                (-p, c.start, c.end, c.kind)
                for c in cs
                if (p := next(chance)) >= self.thresholds[c.kind] and possible(t, c)
            )
            taken = Cover()
            out.append([(kind, start, end) for _, start, end, kind in good if taken.add(start, end)])
        return out


class Cover:
    """Stretches without overlaps, in order."""

    def __init__(self, spans=()):
        self._starts: list[int] = []
        self._ends: list[int] = []
        for start, end in sorted(spans):
            if self._ends and start < self._ends[-1]:
                self._ends[-1] = max(end, self._ends[-1])
            else:
                self._starts.append(start)
                self._ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self._starts, end)
        return i > 0 and self._ends[i - 1] > start

    def add(self, start: int, end: int) -> bool:
        """Take a stretch in, unless it meets one."""
        if self.meets(start, end):
            return False
        i = bisect.bisect_left(self._starts, start)
        self._starts.insert(i, start)
        self._ends.insert(i, end)
        return True


def made_up(n: int, seed: int = 7) -> list[tuple[str, Candidate, bool]]:
    """Texts with one candidate of interest and whether it is personal: rules for each form, in plain prose."""
    rng = random.Random(seed)

    def number(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(rng.choice(("an", "er", "the", "on", "re", "ment", "que", "ión", "heit", "ing")) for _ in range(rng.randint(1, 3)))

    def card() -> str:
        body = rng.choice("3456") + number(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def iban() -> str:
        body = number(18)
        check = 98 - int(body + "131400") % 97  # DE
        return f"DE{check:02d}{body}"

    def grouped(value: str, size: int, by: str) -> str:
        return by.join(value[i : i + size] for i in range(0, len(value), size))

    lead = {
        "phone": ["phone", "tel", "call", "Telefon", "teléfono", "mobile", "fax"],
        ID: ["SSN", "IBAN", "account", "Konto", "social security"],
        "card": ["card", "Visa", "tarjeta", "carte"],
        "email": ["contact", "mail", "write to"],
        "ip": ["host", "IP", "server"],
        "other": ["order", "invoice", "version", "page", "total", "serial", "ref", "ISBN", "build"],
        "": [""],
    }
    good = [
        (lambda: f"{word()} (at) {word()} (dot) com", ["email", ""]),
        (lambda: f"{word()}.{word()}[at]{word()}.example.org", ["email", ""]),
        (lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), ["ip", ""]),
        (lambda: ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)), ["ip", ""]),
        (lambda: grouped(card(), 4, rng.choice(" -")), ["card", ""]),
        (lambda: f"({number(3)}) {number(3)}-{number(4)}", ["phone"]),
        (lambda: f"{number(3)}-{number(3)}-{number(4)}", ["phone"]),
        (lambda: f"0{number(9)}", ["phone"]),
        (lambda: f"{rng.randint(100, 665)}-{number(2)}-{number(4)}", [ID]),
        (lambda: grouped(iban(), 4, rng.choice(("", " "))), [ID, ""]),
    ]
    bad = [
        (lambda: ".".join(str(rng.randint(0, 999)) for _ in range(4)), ["other", ""]),
        (lambda: f"{rng.randint(1900, 2040)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", ["other", ""]),
        (lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2040)}", ["other", ""]),
        (lambda: grouped(number(16), 4, rng.choice(" -")), ["other", ""]),
        (lambda: number(rng.randint(12, 19)), ["other", ""]),
        (lambda: f"{number(3)}-{number(2)}-{number(4)}", ["other"]),
        (lambda: f"{number(3)}-{number(3)}-{number(4)}", ["other", ""]),
        (lambda: f"0{number(9)}", ["other", ""]),
        (lambda: f"{number(2)} {number(3)} {number(3)}", ["other", ""]),
        (lambda: f"AB{number(2)} {number(4)} {number(4)} {number(4)}", ["other", ""]),
    ]
    rows = []
    while len(rows) < n:
        label = rng.random() < 0.5
        value, leads = rng.choice(good if label else bad)
        intro = rng.choice(lead[rng.choice(leads)])
        text = f"{word()} {word()} {intro}{rng.choice((' ', ': '))}{value()} {word()} {word()}"
        rows += [(text, c, label and well_formed(text, c)) for c in candidates(text)]
    return rows


def train(x: np.ndarray, y: np.ndarray, precision: float = 0.95) -> Model:
    """Trees on three quarters of the rows; calibration and thresholds on the rest. `x` may have no rows."""
    extra = made_up(3000)
    x = np.vstack([x.reshape(-1, len(features("", Candidate("ip", 1, 0, 0)))), [features(t, c) for t, c, _ in extra]])
    y = np.concatenate([y, [float(label) for _, _, label in extra]])
    rest = np.arange(len(y)) % 4 == 0
    trees = boosting.calibrated(boosting.fit(x[~rest], y[~rest]), x[rest], y[rest])
    chance, forms = trees.chance(x[rest]), x[rest][:, : len(_GENERATORS)]
    of = {k: [i for i, g in enumerate(_GENERATORS) if g[0] == k] for k in (*KINDS, ID)}
    thresholds = {}
    for kind, columns in of.items():
        own = forms[:, columns].any(1)
        thresholds[kind] = boosting.threshold(chance[own], y[rest][own], precision)
    return Model(trees, thresholds)


def labelled(docs: DataFrame, rows: int, id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and weak labels of at most `rows` candidates of about `rows` documents.

    The documents are those whose hash is lowest, so any row of the table may be among them.
    """
    share = min(1.0, rows / max(1, docs.count()))
    order = F.xxhash64(F.col(id), F.col(text))
    few = docs.select(F.col(text).alias("text"), order.alias("place"))
    few = few.filter(F.col("place") <= min(2**63 - 1, int(-(2**63) + share * 2**64)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            out = []
            for text, place in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist()):
                for k, c in enumerate(candidates(text) if text else ()):
                    out.append((place, k, features(text, c), float(well_formed(text, c))))
            columns = list(zip(*out)) or [(), (), (), ()]
            types = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["place", "k", "x", "y"])

    found = few.mapInArrow(look, "place long, k int, x array<double>, y double")
    taken = found.orderBy("place", "k", "x").limit(rows).collect()
    return np.array([r["x"] for r in taken]), np.array([r["y"] for r in taken])


def find(text: str | None, model: Model | None) -> tuple[list[Span], list[Span]]:
    """Base spans; all spans by kind, then start."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    added = [] if model is None else model.select([text])[0]
    cover = Cover((s, e) for _, s, e in base)
    more = [a for a in added if not cover.meets(a[1], a[2])]
    return base, sorted({*base, *more}, key=lambda s: (_ORDER[s[0]], s[1], s[2]))


def find_personal(docs: DataFrame, sample: int = 4000, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, base, spans` per row. The model is fitted on at most `sample` candidates, then every text is read."""
    model = train(*labelled(docs, sample, id, text))
    return scan_spans(docs, lambda t: find(t, model), id, text)
