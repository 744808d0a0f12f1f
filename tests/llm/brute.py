"""Plain versions of the operators, by definition, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


class Groups:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def linked(sets: list[set], percent: int) -> Groups:
    """Groups of sets with a chain of Jaccard similarities of at least ``percent``."""
    groups, where = Groups(len(sets)), defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
        for x in s:
            where[x].append(i)
    return groups


def jaccard(rows):
    words = [tuple((t or "").translate(SMALL).encode().split()) for _, t in rows]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} if len(w) > 4 else {w} - {()} for w in words]
    groups = linked(sets, 75)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[groups.find(i)].append(d)
    least = {g: min((x for x in v if x is not None), default=None) for g, v in ids.items()}
    return [(d, len(sets[i]), least[groups.find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def rlz(rows, window=35):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def repeats(rows, window=50):
    last = 1 << 63
    texts = [(last if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        for i in range(len(b) - window + 1):
            first[b[i : i + window]] = min(first.get(b[i : i + window], last), d)
    out = []
    for (d, _), (order, b) in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < order:
                gone[i : i + window] = b"\1" * window
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def line_groups(texts: list[str], least: int = 40):
    """Groups of lines: 8-character shingles from 80 characters on, 4-character ones under 128; shorter ones than ``least`` stand alone."""
    groups = Groups(len(texts))
    for low, high, chars, test in ((80, 1 << 60, 8, lambda x, y, n: 100 * n >= 80 * (x + y - n)), (least, 128, 4, lambda x, y, n: 100 * n >= 55 * (x + y - n) and max(x, y) - n <= 12)):
        where = defaultdict(list)
        sets = {i: {x[j : j + chars] for j in range(len(x) - chars + 1)} for i, x in enumerate(texts) if max(low, least) <= len(x) < high}
        for i, own in sets.items():
            for j, n in Counter(j for x in own for j in where[x]).items():
                if test(len(own), len(sets[j]), n):
                    groups.join(i, j)
            for x in own:
                where[x].append(i)
    return groups


def left_lines(rows, least=40):
    """The lines of each row's text that do not repeat; rows of one id and text are one document."""
    spots = defaultdict(list)
    for no_id, d, t in sorted({(d is None, d or 0, t) for d, t in rows if t is not None}):
        for i, line in enumerate(t.split("\n")):
            if line.strip():
                spots[line.strip().lower()].append((no_id, d, i, t))
    texts = list(spots)
    groups = line_groups(texts, least)
    stays = {}
    for i, x in enumerate(texts):
        g = groups.find(i)
        stays[g] = min([*spots[x], *([stays[g]] if g in stays else [])], key=lambda s: s[:3])
    keep = set(stays.values())
    return [None if t is None else [line for i, line in enumerate(t.split("\n")) if not line.strip() or (d is None, d or 0, i, t) in keep] for d, t in rows]


def same_lines(rows, got, recall=0.98, least=40):
    """Whether the texts ``got`` lack no line that stays, and nearly all that go: bands find links by chance."""
    gone = missed = 0
    for (_, t), text, left in zip(rows, got, left_lines(rows, least), strict=True):
        if t is None:
            assert text is None
            continue
        whole, kept = t.split("\n"), iter(text.split("\n"))
        rest = iter([*text.split("\n"), *[""] * (text == "" and "" not in whole)])
        assert all(any(x == y for y in rest) for x in left), "a line is gone that stays"
        rest = iter(whole)
        assert text == "" or all(any(x == y for y in rest) for x in kept), "a line that was not there"
        stay = len(text.split("\n")) if text or "" in whole else 0
        gone += len(whole) - len(left)
        missed += stay - len(left)
    assert missed <= (1 - recall) * gone, (missed, gone)
    return gone


class Page(HTMLParser):
    """Title, language, links and text of a page, tag by tag."""

    HIDDEN = {"script", "style", "head", "template", "noscript", "svg"}
    BREAKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav blockquote pre body".split())

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.title, self.lang = [], [], None, ""
        self.hidden, self.in_title = 0, False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "html":
            self.lang = found.get("lang") or ""
        if tag == "a" and "href" in found:
            self.links.append(found["href"] or "")
        if tag == "title" and self.title is None:
            self.title, self.in_title = "", True
        if tag in self.HIDDEN:
            self.hidden += 1
        elif not self.hidden and tag in self.BREAKS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            self.text.append(" ")
        elif not self.hidden and tag in self.BREAKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.hidden:
            self.text.append(data)


def warc(page_id, url, html):
    """All columns of a page's derivatives, from the format's definition."""
    url, body = url or "", (html or "").encode()
    page = Page(html or "")
    b32 = lambda raw: "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()

    def name(kind, *parts):
        raw = hashlib.sha256(kind.encode() + b"\0" + b"\0".join(hashlib.sha256(p).digest() for p in parts)).digest()[:16]
        return f"<urn:uuid:{uuid.UUID(bytes=raw, version=4)}>"

    source = name("response", url.encode(), body)
    text = "\n".join(x for x in (re.sub(r"[ \t\r\f\v]+", " ", line).strip(" ") for line in "".join(page.text).split("\n")) if x).strip().encode()
    fields = [("title", " ".join((page.title or "").split())), ("languages-html", page.lang), ("n-outlinks", str(len(page.links))), *(("outlink", " ".join(x.split())) for x in page.links)]
    fields += [("http-content-type", "text/html; charset=utf-8"), ("http-content-length", str(len(body)))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return (page_id, source, name("metadata", source.encode(), meta), name("conversion", source.encode(), text), True, " ".join(url.split()), b32(body), b32(meta), b32(text), len(text), sha(meta), sha(text))


def media(doc_id, text, stored):
    """All columns of a stored picture, read chunk by chunk and sample by sample."""
    raw = (text or "").encode()
    payload = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
    at, packed = 8, b""
    while at < len(stored):
        size = int.from_bytes(stored[at : at + 4], "big")
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body).to_bytes(4, "big") == stored[at + 8 + size : at + 12 + size]
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 2, 0, 0, 0])
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    flat, rows, above = zlib.decompress(packed), [], bytes(3 * width)
    for y in range(height):
        line = flat[y * (3 * width + 1) :][: 3 * width + 1]
        assert line[0] in (0, 2)
        above = bytes((v + (u if line[0] == 2 else 0)) & 255 for v, u in zip(line[1:], above, strict=True))
        rows.append(above)
    assert b"".join(rows) == payload
    grey = [[sum(r[3 * x : 3 * x + 3]) for x in range(width)] for r in rows]
    if height < 32:
        grey = [grey[y * height // 32] for y in range(32)]
    cuts = [y * len(grey) // 32 for y in range(33)]
    cell = [[sum(grey[y][x] for y in range(a, b) for x in range(2 * c, 2 * c + 2)) / (2 * (b - a)) for c in range(32)] for a, b in zip(cuts, cuts[1:], strict=False)]
    wave = [[math.cos(math.pi * (2 * i + 1) * u / 64) * math.sqrt((1 if u == 0 else 2) / 32) for i in range(32)] for u in range(8)]
    half = [[sum(wave[u][y] * cell[y][x] for y in range(32)) for x in range(32)] for u in range(8)]
    low = [round(sum(half[u][x] * wave[v][x] for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = "".join("1" if i and v > middle else "0" for i, v in enumerate(low))
    return (doc_id, len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(stored), sha(stored), f"{int(bits, 2):016x}")


def pieces(rows, tokenizer, end=2, capacity=1024):
    """(doc_id, piece, start, length, checksum) of documents cut by an untouched tokenizer."""
    out = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out.append((d, i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    return out


def personal(text: str):
    """(start, kind, end) of the fixed patterns, each by one plain search."""

    def luhn(digits):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def simhash(rows):
    """(doc_id, fingerprint, least id of the component) by all pairs of fingerprints."""
    import xxhash

    prints = []
    for _, t in rows:
        w = (t or "").translate(SMALL).encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(len(w) - 2, 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    distinct = sorted(set(prints))
    groups = Groups(len(distinct))
    for i, x in enumerate(distinct):
        for j in range(i):
            if (x ^ distinct[j]).bit_count() <= 3:
                groups.join(i, j)
    of = {x: groups.find(i) for i, x in enumerate(distinct)}
    ids = defaultdict(list)
    for (d, _), x in zip(rows, prints, strict=True):
        ids[of[x]].append(d)
    return [(d, f"{x:016x}", min((i for i in ids[of[x]] if i is not None), default=None)) for (d, _), x in zip(rows, prints, strict=True)]


def manifest(rows, run=3):
    """All columns of op13 for documents (doc_id, text, lang, source, n_chars), each proof walked from its leaf."""
    digest = lambda *parts: sha("".join(parts).encode())
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, source, n: digest(*map(field, (d, source, lang, n, t)))
    by_source = defaultdict(list)
    for r in rows:
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        by_source[r[3]].append((r[0], leaf(*r), leaf(r[0], r[1].replace("\n", "") if touched and r[1] is not None else r[1], *r[2:])))

    def climb(nodes, place, own=None):
        """The top of the tree over ``nodes`` and the siblings of the node at ``place``, which may be another one than was built with."""
        siblings = []
        while len(nodes) > 1:
            low = place - place % run
            others = nodes[low : low + run]
            siblings += others[: place - low] + others[place - low + 1 :]
            if own is not None:
                own = digest(*others[: place - low], own, *others[place - low + 1 :])
            nodes = [digest(*nodes[i : i + run]) for i in range(0, len(nodes), run)]
            place //= run
        return nodes[0], siblings, own

    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subroots = [climb([x[1] for x in by_source[s]], 0)[0] for s in sources]
    out = []
    for g, s in enumerate(sources):
        leaves = [x[1] for x in by_source[s]]
        root, above, _ = climb(subroots, g)
        for i, (d, own, shown) in enumerate(by_source[s]):
            subroot, below, top = climb(leaves, i, shown)
            end = climb(subroots, g, top)[2]
            out.append((d, own, subroot, root, sha("".join(below + above).encode()), end, end == root))
    return out


def phrase_counts(rows, longest=5):
    """{(lang, words): frequency} of all phrases, and {lang: words}."""
    counted, totals = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (t or "").translate(SMALL)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            counted.update((lang, tuple(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    return counted, {x: c for x, c in totals.items() if c}


def collocations(rows, least=100, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by the definition."""
    counted, totals = phrase_counts(rows)
    frequent = {p: f for p, f in counted.items() if f >= least}
    held = set()
    for (lang, w), f in frequent.items():
        held |= {(lang, w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and f >= frequent[lang, w[i:j]]}
    out = defaultdict(list)
    for (lang, w), a in frequent.items():
        if len(w) < 2 or (lang, w) in held:
            continue
        score, cut = min((1000 * a * totals[lang] // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), frequent[lang, w[:cut]], frequent[lang, w[cut:]]))
    return [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
