"""Lines that the fuzzy operator must judge whatever its parameters are."""

import random

import pytest

from epochweave.llm import lines
from tests.llm import brute
from tests.llm.conftest import document


def left(spark, write, rows):
    docs = spark.read.parquet(f"{write([document(*r) for r in rows])}/documents.parquet")
    return {r["doc_id"]: r["text"] for r in lines.drop_lines(docs).collect()}


def test_short_lines_repeat(spark, write):
    """Exact repeats go however short they are; blank lines stay."""
    rows = [(1, "Read more\n\nx\nonly here"), (2, " read MORE \n\ny\nx"), (3, "z\n \t\nRead more\nz"), (4, None), (None, "y\nonly there")]
    assert left(spark, write, rows) == {1: "Read more\n\nx\nonly here", 2: "\ny", 3: "z\n \t", 4: None, None: "only there"}


def distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_one_edited_word_in_short_lines(spark, write):
    """Nearly all lines of 40 to 78 characters that differ in one word of up to seven letters are found, and no line that is far from all others goes."""
    r = random.Random(11)
    word = lambda least, most: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(least, most)))
    pairs = []
    while len(pairs) < 300:
        words = [word(2, 7) for _ in range(r.randint(7, 13))]
        other = list(words)
        other[r.randrange(len(other))] = word(2, 7)
        a, b = " ".join(words), " ".join(other)
        if 40 <= min(len(a), len(b)) and max(len(a), len(b)) <= 78 and 1 <= distance(a, b) <= 7:
            pairs.append((a, b))
    alone = [a for a in (" ".join(word(2, 7) for _ in range(9)) for _ in range(100)) if 40 <= len(a) <= 78 and all(distance(a, x) > 20 for p in pairs for x in p)]
    assert len(alone) > 30
    rows = [(i, x) for i, x in enumerate([*(a for a, _ in pairs), *(b for _, b in pairs), *alone])]
    got = left(spark, write, rows)
    assert sum(got[300 + i] == "" for i in range(300)) >= 294
    assert all(got[i] == rows[i][1] for i in [*range(300), *range(600, len(rows))])


def edited(r, line: str, kind: str) -> str:
    """``line`` after two or three edits of letters, or with a word more or less."""
    out = list(line)
    if kind == "word":
        words = line.split()
        i = r.randrange(len(words))
        words[i : i + r.randint(0, 1)] = ["more"] * r.randint(0, 1)
        return " ".join(words)
    for _ in range(2 if kind == "two" else 3):
        i = r.choice([i for i, c in enumerate(out) if c != " "])
        out[i : i + r.choice([1, 1, 1, 0])] = r.choice(["x", "q", "xy", "z"])
    return "".join(out)


@pytest.mark.parametrize("kind", ["two", "three", "word"])
@pytest.mark.parametrize(("low", "high"), [(40, 60), (60, 80), (80, 127)])
def test_pairs_of_the_rule_become_candidates(kind, low, high):
    """Of all pairs that link, 95 % share a key, whatever was edited."""
    r = random.Random(low)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.choice([1, 2, 3, 3, 4, 5, 6, 7, 9])))
    pairs = []
    while len(pairs) < 400:
        line = ""
        while len(line) < low:
            line = f"{line} {word()}".strip()
        other = edited(r, line, kind)
        if max(len(line), len(other)) < high and min(len(line), len(other)) >= 40 and line != other:
            groups = brute.line_groups([line, other])
            if groups.find(0) == groups.find(1):
                pairs.append((line, other))
    ids = [[(2 * i, a), (2 * i + 1, b)] for i, (a, b) in enumerate(pairs)]
    flat = [x for p in ids for x in p]
    found = [set() for _ in flat]
    for node, key in zip(*(x.tolist() for x in lines.word_keys(flat)), strict=True):
        found[node].add(key)
    for width, bands, rows, factors, judged in ((lines.CHARS, lines.BANDS, lines.ROWS, lines._FACTORS, lambda x: len(x) >= lines.LONG), (lines.SHORT_CHARS, lines.SHORT_BANDS, lines.SHORT_ROWS, lines._SHORT_FACTORS, lambda x: True)):
        mine = [x for x in flat if judged(x[1])]
        if mine:
            keys = lines.band_keys(*lines.shingles([x for _, x in mine], width, mixed=False), bands, rows, factors)
            for (node, _), row in zip(mine, keys.tolist(), strict=True):
                found[node] |= {(width, x) for x in row}
    met = sum(bool(found[2 * i] & found[2 * i + 1]) for i in range(len(pairs)))
    assert met >= 0.95 * len(pairs), met / len(pairs)
