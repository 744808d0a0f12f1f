"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers
by pattern, leftmost and non-overlapping per kind. A semi-Markov CRF then
scores whole candidate spans of up to four words of the text; dynamic
programming over segments of bounded length chooses boundaries and types
together. Its spans are added where no base span stands, trimmed of quotes,
punctuation and ``name=``. The field is trained on generated snippets
(``SNIPPETS`` of them, a fixed seed) by maximum likelihood.

Every word is a candidate. A plain word (letters only, no cue near it) is
never part of an entity under the trained weights: ``trained`` proves that its
label "other" wins between any two neighbours, and raises otherwise. So the
best segmentation of a text is made of those of its runs of other words, and
only these are searched. The search holds the last ``LONGEST`` columns and the
entities found, whatever the length of a run.

Nulls: a null text is empty; a null id is kept. Offsets are code points, ends
exclusive. Repeated rows get the same spans. Empty tables give empty results;
texts of any length are read whole, in time linear in their length. Only
doc_id (a whole number) and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, combinations, groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order; the last one is only found by the field.
KINDS = ["email", "ip", "card", "phone", "secret"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits: it would have started with the run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

SNIPPETS, EPOCHS, RATE = 700, 4, 0.2
LONGEST = 4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            done = found.end()
            yield found.span()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# The field. Labels: 0 is other (one word long), then KINDS.

#: Words that announce a secret or a telephone number, and how well-known kinds of secrets begin.
_CUES = frozenset(["token", "key", "secret", "password", "passwd", "passphrase", "passcode", "pwd", "apikey", "api_key", "access_key", "secret_key", "bearer", "credential", "credentials", "auth"])
_PHONE_CUES = frozenset(["call", "tel", "phone", "telephone", "mobile", "fax", "fon"])
_PREFIX = re.compile(r"(?:sk|pk|rk)[-_][A-Za-z0-9]|gh[pousr]_|xox[abprs]-|AKIA|ASIA|AIza|eyJ|glpat-|npm_|-----BEGIN")
_AT = re.compile(r"[\[(]at[\])]")
_WORD_TESTS = {
    "address": re.compile(r"[\w.%+-]+(?:@|[\[(]at[\])])[\w-]+(?:\.[\w-]+)+").fullmatch,
    "quad": re.compile(r"\d{1,3}(?:\.\d{1,3}){3}").fullmatch,
    "number": re.compile(r"\d+").fullmatch,
    "grouped": re.compile(r"\d[\d-]*\d").fullmatch,
    "dial": re.compile(r"\+?[\d(][\d().-]*\d").fullmatch,
    "date": re.compile(r"\d{1,4}[./:-]\d{1,2}(?:[./:-]\d{1,4})?").fullmatch,
    "link": re.compile(r"(?:https?:|www\.)").match,
    "plus": re.compile(r"\+").match,
    "brackets": re.compile(r"[^(]*\(\d+\)").match,
    "at": _AT.fullmatch,
}
_VALUE_TESTS = {
    "hex": re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}").fullmatch,
    "capitals": re.compile(r"(?=.*\d)[A-Z0-9]{12,}").fullmatch,
    "mixed": re.compile(r"(?=.*\d)(?=.*[A-Za-z])[\w+/=.~!$-]{8,}").fullmatch,
    "both cases": re.compile(r"(?=.*[a-z][A-Z])(?=.*[A-Z])[\w+/=.~!$-]{12,}").fullmatch,
    "prefix": _PREFIX.match,
}
_ASSIGNED = re.compile(r"[\"']?([A-Za-z_][\w.-]{0,40})[\"']?[=:][\"']?(?=[^/\s])")
_PLAIN = re.compile(r"[^\W\d_]{1,15}").fullmatch
_NUMERIC = re.compile(r"[+(]?\d[\d().-]*[,.;]?|\(\d+\)").fullmatch
_TRIM = "\"'`.,;:!?<>[]{}*#$%&|"
FEATURES = ["bias", *(f"words{n}" for n in range(1, LONGEST + 1)), *_WORD_TESTS, *_VALUE_TESTS, "plain", "long", "middle", "assigned", "cue assigned", *(f"digits{n}" for n in range(6)), "checksum", "cue", "sign", "cue and sign", "phone cue", "trimmed", "numbers", "apart address"]
_NUMBER = {f: i for i, f in enumerate(FEATURES)}


class Word(NamedTuple):
    """What the spans that hold a word, or stand after it, need to know of it."""

    features: tuple[int, ...]
    digits: str
    numeric: bool  # may be part of a group of digits
    at: bool
    host: bool  # may end an address
    plus: bool
    brackets: bool
    cue: bool
    phone_cue: bool
    sign: bool


def _numbers(names: Iterable[str]) -> tuple[int, ...]:
    return tuple(_NUMBER[f] for f in names)


def _seen(raw: str) -> Word:
    core = raw.strip(_TRIM)
    names = ["bias", "words1", *(name for name, test in _WORD_TESTS.items() if test(core))]
    given = _ASSIGNED.match(core)
    value = core[given.end() :].strip(_TRIM) if given else core
    names += [name for name, test in _VALUE_TESTS.items() if test(value)]
    if given:
        names += ["assigned", *(["cue assigned"] if given.group(1).lower() in _CUES else [])]
    if _PLAIN(core) or not core:
        names.append("plain")
    elif len(value) >= 20:
        names.append("long")
    elif len(value) >= 8:
        names.append("middle")
    if raw != core:
        names.append("trimmed")
    digits = "".join(c for c in raw if "0" <= c <= "9")
    bucket, checked = _bucket(digits)
    names += [f"digits{bucket}", *(["checksum"] if checked else [])]
    bare = raw.strip(_TRIM + "=").lower()
    return Word(_numbers(names), digits, _NUMERIC(raw) is not None, _AT.fullmatch(raw) is not None, "." in core, _WORD_TESTS["plus"](raw) is not None, _WORD_TESTS["brackets"](raw) is not None, bare in _CUES, bare in _PHONE_CUES, raw[-1:] in ("=", ":"))


_short = lru_cache(maxsize=1 << 16)(_seen)


def seen(raw: str) -> Word:
    return _short(raw) if len(raw) < 64 else _seen(raw)


@lru_cache(maxsize=None)
def _several(n: int, kind: str, plus: bool, brackets: bool, bucket: int, checked: bool) -> tuple[int, ...]:
    return _numbers(["bias", f"words{n}", kind, *(["plus"] if plus else []), *(["brackets"] if brackets else []), f"digits{bucket}", *(["checksum"] if checked else [])])


def _bucket(digits: str) -> tuple[int, bool]:
    """How many digits there are, roughly, and whether they are a card's."""
    return bisect_right([1, 4, 10, 14, 20], len(digits)), 14 <= len(digits) <= 19 and luhn(digits)


def span_features(words: list[Word], a: int, b: int) -> tuple[int, ...] | None:
    """Numbers of the features of the whole span of words a .. b - 1; None: no candidate.

    Spans of several words are groups of digits, or an address around a word "(at)".
    """
    first = words[a]
    if b == a + 1:
        out = first.features
    elif b == a + 3 and words[a + 1].at and words[b - 1].host:
        out = _several(3, "apart address", False, False, 0, False)
    elif all([w.numeric for w in words[a:b]]):
        out = _several(b - a, "numbers", first.plus, first.brackets, *_bucket("".join([w.digits for w in words[a:b]])))
    else:
        return None
    if a:
        before = words[max(a - 2, 0) : a]
        cue, sign, phone = any([w.cue for w in before]), words[a - 1].sign, any([w.phone_cue for w in before])
        if cue or sign or phone:
            out += _numbers(f for f, on in (("cue", cue), ("sign", sign), ("cue and sign", cue and sign), ("phone cue", phone)) if on)
    return out


def segments(words: list[str]) -> dict[tuple[int, int], tuple[int, ...]]:
    """Feature numbers of each candidate segment."""
    known = list(map(seen, words))
    found = {(a, b): span_features(known, a, b) for a in range(len(words)) for b in range(a + 1, min(a + LONGEST, len(words)) + 1)}
    return {at: f for at, f in found.items() if f is not None}


class Field:
    """Weights of span features by label and of label pairs; a text begins and ends beside the label other."""

    def __init__(self):
        self.spans = np.zeros((len(FEATURES), 1 + len(KINDS)))
        self.pairs = np.zeros((1 + len(KINDS), 1 + len(KINDS)))
        self.known: dict[tuple[tuple[int, ...], bool], np.ndarray] = {}

    def score(self, features: tuple[int, ...], one: bool) -> np.ndarray:
        """Scores by label of a segment; only single words may be other."""
        out = self.spans[list(features)].sum(axis=0)
        if not one:
            out[0] = -np.inf
        return out

    def decode(self, words: Iterable[tuple[int, int, str]]) -> Iterator[tuple[int, int, int]]:
        """(start, end, label) of the best segmentation's entities, from (start, end, word) of each word.

        Paths are linked lists of their entities, so what no label's best path
        holds any more is let go.
        """
        near: list[Word] = []  # the last words: a segment and the two before it
        into: list[tuple[int, np.ndarray, list]] = []  # where a segment may begin: place, best scores by label to come, their paths
        best, paths = np.full(len(self.pairs), -np.inf), [None] * len(self.pairs)
        best[0] = 0.0
        for start, end, word in words:
            through = best[:, None] + self.pairs
            last = through.argmax(axis=0)
            into = [*into[1 - LONGEST :], (start, through.max(axis=0), [paths[i] for i in last.tolist()])]
            near = [*near[-LONGEST - 1 :], seen(word)]
            best, paths = np.full(len(self.pairs), -np.inf), [None] * len(self.pairs)
            for n in range(1, len(into) + 1):
                features = span_features(near, len(near) - n, len(near))
                if features is None:
                    continue
                score = self.known.get((features, n == 1))
                if score is None:
                    score = self.score(features, n == 1)
                    if len(self.known) < 100_000:
                        self.known[features, n == 1] = score
                begin, before, held = into[-n]
                total = before + score
                for y in np.flatnonzero(total > best).tolist():
                    best[y] = total[y]
                    paths[y] = (held[y], begin, end, y) if y else held[0]
        path, out = paths[int((best + self.pairs[:, 0]).argmax())], []
        while path:
            path, *entity = path
            out.append(tuple(entity))
        return reversed(out)

    def learn(self, n: int, features: dict[tuple[int, int], tuple[int, ...]], gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the likelihood of ``gold``: observed less expected features, by forward and backward sums."""
        scores, pairs = {(a, b): self.score(f, b == a + 1) for (a, b), f in features.items()}, self.pairs.copy()
        front = np.full((n + 1, len(pairs)), -np.inf)
        rear = np.zeros((n + 1, len(pairs)))
        front[0, 0], rear[n] = 0, pairs[:, 0]
        begins = {b: [a for a in range(max(0, b - LONGEST), b) if (a, b) in scores] for b in range(1, n + 1)}
        ends = {a: [b for b in range(a + 1, min(a + LONGEST, n) + 1) if (a, b) in scores] for a in range(n)}
        for b in range(1, n + 1):
            front[b] = np.logaddexp.reduce(np.concatenate([front[a][:, None] + pairs + scores[a, b] for a in begins[b]]), axis=0)
        for a in range(n - 1, -1, -1):
            rear[a] = np.logaddexp.reduce(np.concatenate([pairs.T + (scores[a, b] + rear[b])[:, None] for b in ends[a]]), axis=0)
        whole = np.logaddexp.reduce(front[n] + rear[n])
        self.pairs[:, 0] -= rate * np.exp(front[n] + rear[n] - whole)
        for (a, b), s in scores.items():
            share = np.exp(front[a][:, None] + pairs + (s + rear[b])[None, :] - whole)
            self.pairs -= rate * share
            self.spans[list(features[a, b])] -= rate * share.sum(axis=0)
        at = before = 0
        for a, b, y in [*gold, (n, n, 0)]:
            for i, j, label in [*((i, i + 1, 0) for i in range(at, a)), *([(a, b, y)] if b > a else [])]:
                self.spans[list(features[i, j]), label] += rate
                self.pairs[before, label] += rate
                before = label
            at = b
        self.pairs[before, 0] += rate

    def plain_words_are_other(self) -> bool:
        """Whether a plain word that no cue stands near is other in every best segmentation, whatever its neighbours are.

        A plain word is up to 15 letters, so of the tests of values it may pass those for both cases and for prefixes only.
        """
        ok = True
        for more in chain.from_iterable(combinations(("trimmed", "both cases", "prefix"), n) for n in range(4)):
            s = self.spans[[_NUMBER[f] for f in ("bias", "words1", "plain", "digits0", *more)]].sum(axis=0)
            through = self.pairs[:, :, None] + s[None, :, None] + self.pairs[None, :, :]  # before, own, after
            ok &= bool((through[:, :1, :] > through[:, 1:, :].max(axis=1, keepdims=True)).all())
        return ok


def _snippet(r: random.Random) -> tuple[list[str], list[tuple[int, int, int]]]:
    """A generated snippet of words with its labelled spans."""
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    digits = lambda n: pick("0123456789", n)
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    name = lambda: pick("aabcdeefghiilmnoorstuuüé", r.randint(1, 11)) + r.choice(["", "", "", ".", ","])
    host = lambda: f"{pick(low, r.randint(2, 8))}.{r.choice(['org', 'com', 'de', 'co.uk'])}"
    quote = lambda x: r.choice([x, f'"{x}"', f"'{x}'", f"{x}.", f"{x},"])

    def card() -> str:
        body = digits(15)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def key() -> str:
        return r.choice([
            pick("0123456789abcdef", r.choice([18, 32, 40, 64])),
            r.choice(["AKIA", "ASIA"]) + pick(up + "234567", 16),
            r.choice(["sk-", "sk_live_", "pk_test_", "ghp_", "gho_", "glpat-", "xoxb-"]) + pick(low + up + "0123456789", r.randint(20, 40)),
            "eyJ" + base64.urlsafe_b64encode(r.randbytes(30)).decode().rstrip("="),
            base64.b64encode(r.randbytes(r.choice([18, 24, 32]))).decode(),
            pick(low + up + "0123456789", r.randint(20, 48)),
        ])

    def password() -> str:
        return r.choice([pick(low, r.randint(8, 22)), pick(low + up + "0123456789!$", r.randint(8, 16)), pick(low, 6) + digits(r.randint(1, 4))])

    def entity() -> tuple[list[str], list[str], int]:
        """What stands before it, its words, its label."""
        kind = r.choice([1, 2, 3, 4, 5, 5, 5])
        if kind == 1:
            who = f"{pick(low, r.randint(2, 9))}{r.choice(['', '.', '_'])}{digits(r.randint(0, 2))}"
            return [], r.choice([[f"{who}@{host()}{r.choice(['', '.', ','])}"], [f"{who}{r.choice(['(at)', '[at]'])}{host()}"], [pick(low, 6), r.choice(["(at)", "[at]"]), host()]]), 1
        if kind == 2:
            return [], [".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(["", ",", "."])], 2
        if kind == 3:
            c = card()
            return [], r.choice([[c], [c[:4], c[4:8], c[8:12], c[12:]], ["-".join(c[i : i + 4] for i in range(0, 16, 4))]]), 3
        if kind == 4:
            return r.choice([[], [r.choice(["call", "tel.", "phone:"])]]), r.choice([["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(12)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(7)]]), 4
        cue = r.choice(sorted(_CUES))
        cue = r.choice([cue, cue.upper(), cue.capitalize()])
        how = r.random()
        if how < 0.3:
            return [], [quote(key())], 5
        if how < 0.55:
            return r.choice([[cue, "="], [cue, ":"], [f"{cue}:"], [f"{cue}="]]), [quote(r.choice([key, password])())], 5
        if how < 0.8:
            return [], [f"{cue}{r.choice(['=', ':'])}{quote(r.choice([key, password])())}"], 5
        return [cue], [key()], 5

    def other() -> list[str]:
        wrong = digits(16)
        wrong = wrong if not luhn(wrong) else wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
        return r.choice([
            [digits(r.choice([1, 2, 4, 4, 6]))], [f"{digits(1)}.{digits(1)}."], [wrong], [f"{digits(2)}%"], [f"{name()}{digits(2)}"], [f"@{name()}"],
            [f"{digits(2)}.{digits(2)}.{digits(4)}"], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"{digits(2)}:{digits(2)}"], [pick(low, r.randint(14, 26)) + r.choice(["", ".", ","])],
            [f"https://{host()}/{pick(low, 8)}/{digits(3)}"], [r.choice(sorted(_CUES)), r.choice(["is", "was", "must", "of", "for", "to", name()]), name()], [name() + ":", name()], [pick(low, 4), "=", digits(2)], [f"{pick(low, 5)}={pick(low, 4)}"],
            [digits(2), digits(2), digits(3)], [r.choice(["call", "phone"]), name()], [f"{pick(low, 5)}-{pick(low, 7)}-{pick(low, 6)}"], [r.choice("#*|$&<>") * r.randint(1, 3)], [f"|{pick(low, 3)}|{digits(2)}|"], [f"({name()})"], [pick(up, 3) + digits(3)],
        ])

    words: list[str] = []
    gold = []
    for _ in range(r.randint(2, 5)):
        words += [name() for _ in range(r.randint(1, 3))]
        choice = r.random()
        if choice < 0.45:
            before, span, kind = entity()
            words += before
            gold.append((len(words), len(words) + len(span), kind))
            words += span
        elif choice < 0.9:
            words += other()
    return words + [name()], gold


@lru_cache(maxsize=1)
def trained(snippets: int = SNIPPETS, epochs: int = EPOCHS, seed: int = 5) -> Field:
    r = random.Random(seed)
    data = [(len(words), segments(words), gold) for words, gold in (_snippet(r) for _ in range(snippets))]
    field = Field()
    for epoch in range(epochs):
        for n, features, gold in data:
            field.learn(n, features, gold, RATE / (1 + epoch / 2))
    if not field.plain_words_are_other():
        raise ValueError("the trained field does not leave plain words alone")
    return field


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = " \t\n\x0b\x0c\r"
#: Where a word may be more than a plain one: digits, signs, characters of no letter inside a word, a cue, sixteen characters in a row.
_HIT = re.compile(r"[0-9@=_/\\+~^\[({<>|#*$%&-]|(?i:token|key|secret|pass|pwd|bearer|credential|auth|call|tel|phone|mobile|fax|fon)|[^\x20\x09-\x0D]{16}|[^\x20\x09-\x0D][.,;:!?'\"`]+[^\x20\x09-\x0D]|:")


def _plain(raw: str) -> bool:
    """Whether a word is plain, and neither a cue nor a sign for the words after it."""
    core = raw.strip(_TRIM)
    if core and not _PLAIN(core) or raw[-1] in "=:" or _AT.fullmatch(raw):
        return False
    return core.lower() not in _CUES and core.lower() not in _PHONE_CUES


def runs(text: str) -> Iterator[tuple[int, int, int]]:
    """(run, start, end) of words that may not be plain, with two words after each cue or sign and one on either side of "(at)"; neighbours are one run."""
    run, last = 0, None  # the end of the last word of the run
    at, after = 0, 0  # where to read on, and how many words after the last one belong to its run
    while at < len(text):
        if after:  # the next word, whatever it is
            found = _WORD.search(text, at)
            if not found:
                break
            a, b = found.span()
        else:
            hit = _HIT.search(text, at)
            if not hit:
                break
            a = hit.start()
            while a > at and text[a - 1] not in _SPACES:
                a -= 1
            b = _WORD.match(text, a).end()
        raw = text[a:b]
        plain = _plain(raw)
        if not plain or after:
            here = seen(raw)
            if last is not None and text[last:a].strip(_SPACES):
                run, last = run + 1, None
            if here.at and last is None:  # the name before it
                i = a
                while i and text[i - 1] in _SPACES:
                    i -= 1
                j = i
                while j and text[j - 1] not in _SPACES:
                    j -= 1
                if j < i:
                    yield run, j, i
            yield run, a, b
            last = b
            after = 2 if here.cue or here.phone_cue or here.sign else max(after - 1, int(here.at), 0)
        at = b


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the field's entities that touch no base span."""
    starts, reach = [], []  # of the base spans, by start; how far those up to each one reach
    for a, _, b in base:
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else b))
    out = []
    for _, run in groupby(runs(text), key=itemgetter(0)):
        for a, b, y in field.decode((i, j, text[i:j]) for _, i, j in run):
            while a < b and text[a] in _TRIM:
                a += 1
            while a < b and text[b - 1] in _TRIM:
                b -= 1
            if KINDS[y - 1] == "secret" and (given := _ASSIGNED.match(text, a, b)):
                a = given.end()
            before = bisect_right(starts, b - 1)
            if a < b and not (before and reach[before - 1] > a):
                out.append((a, y - 1, b))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_found bigint"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_found) of each text."""
    field = trained()
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names[1:]]
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, field)
                counts = [sum(kind == i for _, kind, _ in base) for i in range(4)]
                for o, x in zip(out, (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more), len(base) + len(more)), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, t) for o, t in zip(out, kinds[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def op4(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    return find_personal_data(table(spark, sf_dir, "documents"))
