"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sliced, table

#: Kinds of spans; the first four are those of the base patterns, and only the CRF finds the others.
KINDS = ("email", "ip", "card", "phone", "secret", "name")
BASE = 4
EMAIL, IP, CARD, PHONE, SECRET, NAME = range(len(KINDS))

# ---- base patterns -------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does: from within a run the same match would fail at the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: from each @ back over the local part, forth over the domain; linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = max(end, start)
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start, then kind; code points."""
    out = [(a, b, EMAIL) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append((m.start(), m.end(), IP))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), CARD))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), PHONE))
    return sorted(out, key=_by_start)


def _by_start(span: tuple[int, int, int]) -> tuple[int, int]:
    return span[0], span[2]


# ---- conditional random field --------------------------------------------------------------------

#: Kinds that the CRF labels: addresses spelt out, phone numbers of other forms, secrets after their cue, names after
#: a title or cue. Labels: outside, then begin and inside of each.
FOUND = (EMAIL, PHONE, SECRET, NAME)
LABELS = ("O", *(f"{side}-{KINDS[k]}" for k in FOUND for side in "BI"))
_BEGIN = {k: 1 + 2 * n for n, k in enumerate(FOUND)}
#: Words on either side that a window holds around a word that may start or end an entity.
REACH = 5
_SLOTS = 1 << 12
#: Slots of their own: the first word of "name at host dot word", the others, words outside; words that no cue of a
#: secret stands up to CUE_WORDS before, and the same for names; words that open a number, with + or, without one before, (.
_FIRST, _NEXT, _NONE, _UNCUED_SECRET, _UNCUED_NAME, _OPENS = range(_SLOTS, _SLOTS + 6)
CUE_WORDS = 3
#: Words, padding included, that a batch of windows holds; a longer run is decoded alone, its features made so many words at a time.
PIECE = 32_000
_WORD = re.compile(r"[^\s]+")
#: Every entity holds, or stands within REACH words of, a word with a digit or one of these; elsewhere nothing is labelled.
_SECRET_CUE = r"token|password|passwd|passphrase|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer"
_NAME_CUE = r"\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|Dear|[Nn]amed?|[Ss]igned)\b"
_TRIGGER = re.compile(rf"[0-9]|\b(?:at|dot|AT|DOT)\b|(?i:{_SECRET_CUE})|{_NAME_CUE}")
_SECRETIVE, _NAMING = re.compile(_SECRET_CUE, re.I), re.compile(_NAME_CUE)
_EDGES = ".,;:!?\"'()[]{}<>#$%&*|"
_CUES = frozenset("call phone tel telephone mobile cell fax dial text ring reach contact hotline mail email e-mail write address send inbox".split())
_SUFFIXES = frozenset("com org net edu gov mil int io info biz dev app ai co me tv de fr es it nl be ch at pl pt se no dk fi ie uk us ca au nz in jp cn br ru za eu".split())


def shape(word: str) -> str:
    """Letters to a or A, digits to 9, runs cut to three; of a word that mixes more than eight runs only which sorts it has."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-ZÀ-Þ]", "A", word)))
    s = re.sub(r"(.)\1{3,}", r"\1\1\1", s)
    return s if len(s) <= 24 else "~" + "".join(sorted(set(s)))[:12]


#: Characters of a word up to which its features are remembered; those of a longer one are made from the whole word each time.
_SHORT = 80


def _own(word: str) -> tuple[str, ...]:
    bare = word.strip(_EDGES)
    low = bare.lower()
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in bare)
    return (
        "s=" + shape(word),
        "b=" + shape(bare),
        f"d={min(digits, 12)}/{len(bare) - digits if len(bare) < 20 else 20}",
        "at" if low in ("at", "dot") else "w=" + low if low in _SUFFIXES else "",
        "cue" if low.rstrip(":") in _CUES else "",
        "secretive" if _SECRETIVE.search(word) else "naming" if _NAMING.search(word) else "",
        "equals" if word in ("=", ":", ":=", "=>", "is") or word[-1] in "=:" else "",
        f"key={min(len(bare) // 8, 5)}" + ("hex" if not bare.strip("0123456789abcdefABCDEF") else "") if len(bare) >= 8 and digits and letters else "",
        "quoted" if word[0] in "\"'`" and len(word) > 2 else "",
        "title" if bare[:1].isupper() and bare[1:].islower() and bare.isalpha() else "",
        "digits" if bare.isdigit() else "letters" if bare.isalpha() else "mixed",
    )


def _slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % _SLOTS


@lru_cache(200_000)
def _short_slots(word: str, offset: int) -> tuple[int, ...]:
    return tuple(_slot(f"{offset}:{f}") for f in _own(word) if f)


def _slots(word: str, offset: int) -> tuple[int, ...]:
    return (_short_slots if len(word) <= _SHORT else _short_slots.__wrapped__)(word, offset)


@lru_cache(200_000)
def _short_marks(word: str) -> int:
    low = word.strip(_EDGES).lower()
    return (low == "at") + 2 * (low == "dot") + 4 * bool(_SECRETIVE.search(word)) + 8 * bool(_NAMING.search(word))


def _marks(word: str) -> int:
    """Bits: at, dot, holds a cue of secrets, of names."""
    return (_short_marks if len(word) <= _SHORT else _short_marks.__wrapped__)(word)


def _forms(words: list[str]) -> list[list[int]]:
    """The slots of their own of each word."""
    n = len(words)
    marks = list(map(_marks, words))
    out = [[_NONE] for _ in words]
    for k in range(1, n - 3):
        if marks[k] & 1 and marks[k + 2] & 2:
            end = k + 3
            while end + 2 < n and marks[end + 1] & 2:
                end += 2
            out[k - 1] = [_FIRST]
            for j in range(k, end + 1):
                out[j] = [_NEXT]
    for slot, cue in ((_UNCUED_SECRET, 4), (_UNCUED_NAME, 8)):
        last = -CUE_WORDS - 1
        for k, mark in enumerate(marks):
            if k - last > CUE_WORDS:
                out[k].append(slot)
            if mark & cue:
                last = k
    for k, word in enumerate(words):
        if word[0] == "+" or word[0] == "(" and not (k and words[k - 1][0] == "+"):
            out[k].append(_OPENS)
    return out


def features(words: list[str], places: range | None = None, forms: list[list[int]] | None = None) -> list[list[int]]:
    """Slots of the words at these places, else of all; forms: _forms(words), where they are known."""
    out, forms = [], _forms(words) if forms is None else forms
    for k in range(len(words)) if places is None else places:
        own = [_slot("bias"), *forms[k]]
        for offset in (-2, -1, 0, 1, 2):
            own += _slots(words[k + offset], offset) if 0 <= k + offset < len(words) else (_slot(f"{offset}:none"),)
        out.append(own)
    return out


class Crf:
    """Weights of word features a label, and of label pairs."""

    def __init__(self) -> None:
        n, b = len(LABELS), _BEGIN[EMAIL]
        self.emit, self.move = np.zeros((_SLOTS + 6, n)), np.zeros((n, n))
        self.emit[_OPENS, _BEGIN[PHONE] + 1] = -1e3  # where numbers stand side by side, each is one
        self.emit[_UNCUED_SECRET, _BEGIN[SECRET]] = self.emit[_UNCUED_NAME, _BEGIN[NAME]] = -1e3
        self.emit[_NONE, b : b + 2] = self.emit[_FIRST, b + 1] = -1e3  # an address has that form, and its name is not inside another
        self.allowed = np.array([[b[0] != "I" or a[1:] == b[1:] for b in LABELS] for a in LABELS])
        self.start = np.array([label[0] != "I" for label in LABELS])

    def scores(self, windows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(windows, most words, labels) emission scores, and the number of words of each."""
        lengths = np.array([len(w) for w in windows])
        flat = [f for w in windows for x in w for f in x]
        counts = np.array([len(x) for w in windows for x in w])
        sums = np.add.reduceat(self.emit[flat], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        out = np.zeros((len(windows), lengths.max(), len(LABELS)))
        out[np.arange(lengths.max())[None, :] < lengths[:, None]] = sums
        return out, lengths

    def decode(self, windows: list[list[list[int]]]) -> list[list[int]]:
        """Viterbi for a batch of windows at once."""
        return self.paths(*self.scores(windows)) if windows else []

    def decode_long(self, words: list[str]) -> list[int]:
        """Viterbi for one run of any length, whose features are made a piece at a time."""
        forms = _forms(words)
        pieces = [self.scores([features(words, range(lo, min(lo + PIECE, len(words))), forms)])[0][0] for lo in range(0, len(words), PIECE)]
        return self.paths(np.concatenate(pieces)[None], np.array([len(words)]))[0]

    def paths(self, score: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """The best labels of each window from its emission scores."""
        move = np.where(self.allowed, self.move, -1e9)
        best = score[:, 0] + np.where(self.start, 0, -1e9)
        back = np.zeros(score.shape, np.int64)
        for t in range(1, score.shape[1]):
            all_ = best[:, :, None] + move[None]
            back[:, t] = all_.argmax(1)
            new = all_.max(1) + score[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        label = best.argmax(1)
        out = [[] for _ in lengths]
        for t in range(score.shape[1] - 1, -1, -1):
            live = t < lengths
            for k in np.flatnonzero(live):
                out[k].append(int(label[k]))
            label = np.where(live, back[np.arange(len(lengths)), t, label], label)
        return [x[::-1] for x in out]

    def train(self, windows: list[list[list[int]]], labels: list[list[int]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Crf:
        """Maximum likelihood with a Gaussian prior: forward and backward sums over the whole table, Adam steps."""
        order = sorted(range(len(windows)), key=lambda k: -len(windows[k]))
        windows, labels = [windows[k] for k in order], [labels[k] for k in order]
        flat = np.array([f for w in windows for x in w for f in x])
        owner = np.repeat(np.arange(sum(map(len, windows))), [len(x) for w in windows for x in w])
        by_slot = np.argsort(flat, kind="stable")
        slots, first = np.unique(flat[by_slot], return_index=True)
        owner = owner[by_slot]
        state = [np.zeros_like(x) for x in (self.emit, self.move) for _ in range(2)]
        for step in range(1, rounds + 1):
            _, grad_words, grad_move = self.gradients(windows, labels)
            grad_emit = np.zeros_like(self.emit)
            grad_emit[slots] = np.add.reduceat(grad_words[owner], first)
            for k, (weight, grad) in enumerate(((self.emit, grad_emit), (self.move, grad_move))):
                grad = grad / len(windows) + decay * weight
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def gradients(self, windows: list[list[list[int]]], labels: list[list[int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """(negative log likelihood of the labels, its slope by each word's label scores, and by the label pairs' weights).

        Windows come longest first. Sums are scaled at each word, so they are products of small matrices;
        at place t only the windows that reach it, a prefix, are touched.
        """
        score, lengths = self.scores(windows)
        live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(lengths[0])]  # windows of more than t words
        top = score.max(2)
        emit, pair = np.exp(score - top[:, :, None]), np.where(self.allowed, np.exp(np.where(self.allowed, self.move, 0)), 0.0)
        forth, back, scale = np.zeros(score.shape), np.ones(score.shape), np.ones(score.shape[:2])
        for t, n in enumerate(live):
            x = emit[:n, t] * (self.start if t == 0 else forth[:n, t - 1] @ pair)
            scale[:n, t] = x.sum(1)
            forth[:n, t] = x / scale[:n, t, None]
        grad_move = np.zeros_like(self.move)
        for t in range(len(live) - 1, 0, -1):
            n = live[t]
            ahead = emit[:n, t] * back[:n, t] / scale[:n, t, None]
            back[:n, t - 1] = ahead @ pair.T
            grad_move += pair * (forth[:n, t - 1].T @ ahead)
        inside = np.arange(lengths[0])[None, :] < lengths[:, None]
        gold = np.zeros(inside.shape, np.int64)
        gold[inside] = np.concatenate(labels)
        both = inside[:, 1:]
        np.subtract.at(grad_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        grad_words = (forth * back)[inside]
        grad_words[np.arange(len(grad_words)), gold[inside]] -= 1
        said = np.take_along_axis(score, gold[:, :, None], 2)[:, :, 0][inside].sum() + self.move[gold[:, :-1][both], gold[:, 1:][both]].sum()
        return float((np.log(scale) + top)[inside].sum() - said), grad_words, grad_move


def labelled_table(rows: int = 720, seed: int = 11) -> list[list[tuple[str, int]]]:
    """The small labelled table: sentences of (word, label) made from a rule with a fixed seed.

    Half begin with an entity: an address spelt out (name at host dot com), a phone number (national forms
    with area code, some with +), a secret after its cue, a person's name after a title or cue. The others
    begin with what looks like one but is not: prices, dates, versions, sizes, plain "at", references,
    check sums and commits, numbers without cue, titles without name, cues in prose. Two in three rows
    hold one or two more of either sort, as runs of near triggers do, some at once behind another.
    """
    rng = random.Random(seed)
    syllables = "an be con dar el fi gor hu il ka lo mer ni os pra qui ro sta ter und ve wi".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes = lambda n: of("0123456789abcdef", n)
    o = lambda text: [(w, 0) for w in text.split()]
    filler = lambda: [(word().capitalize() if rng.random() < 0.2 else word(), 0) for _ in range(rng.randint(1, REACH))]

    def entity(text: str, kind: int) -> list[tuple[str, int]]:
        return [(w, _BEGIN[kind] + (k > 0)) for k, w in enumerate(text.split())]

    def email() -> list[tuple[str, int]]:
        at, dot = rng.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("AT", "DOT")])
        lead = rng.choice(["", "", "email", "write to", "mail me:", "contact", "send to", "reach us at"])
        return o(lead) + entity(f"{word()}{rng.choice(['', '.' + word(), digits(2)])} {at} {word()} {dot} {rng.choice(['', '', f'{word()} {dot} '])}{rng.choice([word(), *sorted(_SUFFIXES)])}", EMAIL)

    def phone() -> list[tuple[str, int]]:
        forms = (f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"0{digits(3)} {digits(7)}")
        forms += (f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"{digits(2)} {digits(3)} {digits(2)} {digits(2)}", f"0{digits(3)} {digits(8)}", f"0{digits(2)}-{digits(7)}")
        if rng.random() < 0.3:  # told by its own form
            return entity(rng.choice((f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}")), PHONE)
        return o(rng.choice(["call", "phone", "Tel:", "mobile", "fax", "dial", "Phone:", "contact"])) + entity(rng.choice(forms), PHONE)

    def secret() -> list[tuple[str, int]]:
        plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        value = rng.choice((lambda: hexes(40), lambda: hexes(rng.choice((32, 64))), lambda: of(plain, rng.randint(16, 44)), lambda: of(plain + "!#%_-", rng.randint(10, 20)), lambda: word() + digits(4)))()
        quote, cue = rng.choice(("", "'", '"', '"')), rng.choice(("token", "api_key", "apikey", "API-KEY", "password", "passwd", "secret", "access_key", "client_secret", "pwd", "auth_token"))
        lead = rng.choice((f"{cue} =", f"{cue}:", f"{cue} :", f"{cue}=", f"{cue} is", "Bearer"))
        tail = rng.choice(("", "", ",", ";", "!!", "***", "."))
        return o(lead) + entity(f"{quote}{value}{quote}{tail}", SECRET)

    def name() -> list[tuple[str, int]]:
        lead = rng.choice(("Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Dr", "Dr.", "Prof.", "Herr", "Frau", "Monsieur", "Dear", "my name is", "is named", "signed", "Name:"))
        return o(lead) + entity(" ".join(word().capitalize() for _ in range(rng.randint(1, 3))), NAME) + [(word(), 0)]

    def other() -> list[tuple[str, int]]:
        forms = (
            f"at {word()}", f"met at {word()} and {word()}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"${digits(3)},{digits(3)}", f"version {digits(1)}.{digits(2)}.{digits(1)}", f"{digits(3)} {word()}",
            f"no. {digits(6)}", f"{digits(2)}:{digits(2)} at {word()}", f"{digits(16)}", f"{digits(11)}", f"dot {word()} dot", f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(3)}",
            f"ISBN {digits(3)}-{digits(1)}-{digits(5)}", f"pages {digits(3)}-{digits(3)}", f"{word()}{digits(2)}@{word()}.com", f"in {digits(4)} {digits(4)} {word()}", f"{digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {word()}",
            f"commit {hexes(40)}", f"sha256 {hexes(64)}", f"md5: {hexes(32)}", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"{word().capitalize()} {word().capitalize()} {digits(4)}", f"the token {word()} of", f"a secret {word()} and {word()}",
            f"password for {word()}", f"tokens = {digits(2)}", f"Dr {word()}", f"Dear {word()}", f"the name {word()} of", f"named {word()} {word()}", f"file{digits(2)}_{word()}.txt", f"{word()}{digits(4)} {word()}",
        )
        return o(rng.choice(forms))

    kinds, out = (email, phone, secret, name), []
    for k in range(rows):
        middles = [kinds[k % 8 // 2]() if k % 2 == 0 else other()]
        for _ in range(k // 8 % 3):
            middles.append(rng.choice((*kinds, other, other, other))())
        out.append(filler() + [x for middle in middles for x in middle + (filler() if rng.random() < 0.7 else [])])
    return out


@lru_cache(1)
def model() -> Crf:
    """Trained in the driver in a few seconds, the same numbers each time; tasks get its 300 kB with their code."""
    table_ = labelled_table()
    return Crf().train([features([w for w, _ in row]) for row in table_], [[y for _, y in row] for row in table_])


def windows_of(text: str) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """(words, their spans) of runs of words within REACH of a trigger; the CRF leaves the rest of the text unlabelled.

    Triggers at most 2 * REACH words apart are in one run, so each has its REACH words on either side there.
    A run has any number of words: it is never cut.
    """
    last = least = 0
    while m := _TRIGGER.search(text, last):
        words, spans, keep, left = [], [], 0, 2 * REACH
        for w in _WORD.finditer(text, _back(text, m.start(), least)):
            words.append(w[0])
            spans.append(w.span())
            if _TRIGGER.search(w[0]):
                keep, left = len(words) + REACH, 2 * REACH
            elif keep:
                left -= 1
            if not left:
                break
        last, least = spans[-1][1], spans[:keep][-1][1]
        yield words[:keep], spans[:keep]


def _back(text: str, at: int, least: int) -> int:
    """Where the word REACH words before the one at this place starts, not before least."""
    seen, k = 0, at
    while k > least:
        if text[k - 1].isspace() and not text[k].isspace():
            seen += 1
            if seen > REACH:
                break
        k -= 1
    return k


def _plausible(kind: int, found: str) -> bool:
    """Whether a labelled span has the form that its kind always has."""
    if kind == PHONE:  # with an area code; E.164 has 15 at most
        return 7 <= sum(c.isdigit() for c in found) <= 15 and "@" not in found
    words = found.split()
    if kind == EMAIL:
        low = [w.strip(_EDGES).lower() for w in words]
        return len(low) >= 5 and low[1] == "at" and low[-2] == "dot" and low[-1] != ""
    return len(words) == 1 and len(found) >= 6 if kind == SECRET else all(w[:1].isupper() for w in words)


class _Taken:
    """Spans by start with the farthest end so far: tells in logarithmic time whether another overlaps one."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts = [a for a, _, _ in spans]
        self.ends = list(accumulate((b for _, b, _ in spans), max))

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def _batches(lengths: list[int]) -> Iterator[list[int]]:
    """Places of windows of like length, PIECE words a batch when padded; a longer window is a batch of its own."""
    batch: list[int] = []
    for k in sorted(range(len(lengths)), key=lengths.__getitem__):
        if batch and (len(batch) + 1) * lengths[k] > PIECE:
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def added_spans(texts: list[tuple[str, list[tuple[int, int, int]]]], crf: Crf) -> list[list[tuple[int, int, int]]]:
    """What the CRF adds to each text's base spans: no overlap with them, and of an entity's form."""
    owners, all_words, all_spans = [], [], []
    base = [_Taken(b) for _, b in texts]
    for k, (text, _) in enumerate(texts):
        for words, spans in windows_of(text):
            owners.append(k)
            all_words.append(words)
            all_spans.append(spans)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for batch in _batches([len(w) for w in all_words]):
        if len(all_words[batch[0]]) > PIECE:
            labels = [crf.decode_long(all_words[batch[0]])]
        else:
            labels = crf.decode([features(all_words[k]) for k in batch])
        for k, row in zip(batch, labels, strict=True):
            text, taken = texts[owners[k]][0], base[owners[k]]
            t = 0
            while t < len(row):
                end = t + 1
                if row[t]:
                    kind = FOUND[(row[t] - 1) // 2]
                    while end < len(row) and row[end] == _BEGIN[kind] + 1:
                        end += 1
                    a, b = all_spans[k][t][0], all_spans[k][end - 1][1]
                    while b > a and text[b - 1] in ".,;:!?\"'`#$%&*|" + "=-" * (kind == NAME):
                        b -= 1
                    while kind in (SECRET, NAME) and a < b and text[a] in "\"'`([{":
                        a += 1
                    if _plausible(kind, text[a:b]) and not taken.overlaps(a, b):
                        out[owners[k]].append((a, b, kind))
                t = end
    return out


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=_by_start))


def personal_data(documents: DataFrame) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_found.

    The counts by kind and base_sha256 are of the base patterns' spans; spans lists these and, among
    them by start and kind, the n_added spans that the CRF finds where no base span is: e-mail addresses
    spelt out, further phone numbers, secrets after their cue, names after a title. n_found: all spans.

    Null text is empty: no spans. Null or repeated doc_id: rows as any other, one a row. Texts and words
    of any length are read whole. Other columns, whatever their names, are ignored. Empty table: no
    rows. Rows stream through; nothing is shuffled.
    """
    crf = model()
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_added", "n_found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(list(zip(texts, base, strict=True)), crf)
            counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in range(BASE)]
            digests = pa.array([hashlib.sha256(written_spans(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([written_spans(b + m) for b, m in zip(base, more, strict=True)], pa.string())
            totals = [pa.array(n, pa.int64()) for n in ([len(m) for m in more], [len(b) + len(m) for b, m in zip(base, more, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans, *totals], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_found long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
