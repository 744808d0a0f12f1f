import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from epochweave.llm import phrases
from tests.conftest import SF
from tests.llm import brute
from tests.llm.conftest import document


def words_of(r, n):
    names = ["new", "york", "city", "Ça", "the", "of", "a-b", "é", *(f"w{i}" for i in range(25))]
    return [r.choice(names) for _ in range(n)]


def corpus(seed: int, n: int):
    r = random.Random(seed)
    fixed = [words_of(r, k) for k in (2, 3, 4, 5, 6, 9)]
    rows = []
    for d in range(n):
        out = []
        for _ in range(r.randint(0, 25)):
            out += r.choice(fixed) if r.random() < 0.6 else words_of(r, r.randint(1, 6))
            out.append(r.choice([",", ". ", "\n", " ", " ", "\t", "\x0b", "!?"]))
        rows.append(document(d, " ".join(out).upper() if d % 5 == 0 else " ".join(out), lang=r.choice(["en", "en", "de", None, "und", ""])))
    text = rows[1][1]
    return [*rows, rows[1], (None, text, "en", None, None), (3, None, "en", "s", None), (4, "", "de", "s", 0), (5, " .,;:!?\n\t", None, "s", 9), (6, "long run " * 4000, "en", "s", 0)]


def collocations(rows, least, top=2000):
    return brute.collocations([(t, lang) for _, t, lang, _, _ in rows], least, top)


@pytest.mark.parametrize(("least", "top", "small"), [(5, 2000, False), (4, 7, True)])
def test_collocations(spark, write, monkeypatch, least, top, small):
    """All columns against counts by hand, in lists of a few words and homes of a few lists, too."""
    if small:
        monkeypatch.setattr(phrases, "LISTED", 200)
        monkeypatch.setattr(phrases, "HOME", 500)
    rows = corpus(least, 120)
    docs = spark.read.parquet(f"{write([*rows])}/documents.parquet").repartition(5).withColumn("phrase", F.lit("x")).withColumn("f", F.lit(1))
    got = sorted(map(tuple, phrases.collocations(docs, least=least, top=top).collect()), key=repr)
    assert got == sorted(collocations(rows, least, top), key=repr) and len(got) > 20


def test_frequencies_are_list_lengths(spark, write):
    rows = corpus(9, 60)
    found, words = phrases.frequent_phrases(spark.read.parquet(f"{write(rows)}/documents.parquet"), least=3)
    counted, totals = brute.phrase_counts([(t, lang) for _, t, lang, _, _ in rows])
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in found.collect()} == {p: f for p, f in counted.items() if f >= 3}
    assert Counter({r["lang"]: r["n"] for r in words.collect()}) == Counter(totals)


def test_exact_beyond_64_bits(spark):
    big = 10**13 + 7
    given = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, 3 * big + 1), ("en", "b", 1, 5 * big + 2)], "lang string, phrase string, size int, f bigint")
    row = phrases.scored(given, spark.createDataFrame([("en", 7 * 10**14 + 1)], "lang string, n bigint")).first()
    assert row["score"] == 1000 * big * (7 * 10**14 + 1) // ((3 * big + 1) * (5 * big + 2))


def test_empty(spark, write):
    assert phrases.op11(spark, write([])).count() == 0


def test_given_documents(spark, write):
    """The query and its SQL, on more copies of the given documents, so that something reaches the production threshold."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    folder = write([(i * 1000 + r[0], *r[1:]) for i in range(8) for r in rows])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = phrases.op11(spark, folder)
    want = con.execute(phrases.SQL).fetchall()
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(want) and len(want) > 30
