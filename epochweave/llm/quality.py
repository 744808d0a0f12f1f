"""Quality rules by distribution divergence, with DataFrame functions only.

Per document: counts of words, symbols, repeated lines and repeated 8-word
windows, and two histograms, of character classes and of common words. A
language's common words are those that most of its documents hold, by count,
and at least ``HELD`` of them;
its references are the means of its documents' histograms, each document
counting alike however long it is. Documents of fewer than ``MIN_WORDS`` words
do not count, and a language with fewer than ``SUPPORT`` others has no
reference. Each histogram is held against its language's reference by the
Jensen-Shannon distance (base 2, so 0 to 1). A document is rejected if a base
rule fails, or if a distance is above its limit, which falls with the number
of words: short texts differ from any reference by chance.

Nulls: a null text has no words and fails the base rule; the null language is
a language. Without a reference only the base rules count. Repeated rows are
judged alike. An empty table gives an empty result. Nothing is shuffled but
counts per language and word and sums per language. Extra columns stay; result
columns take the place of columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochweave.llm.names import quoted, unused
from epochweave.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: Character classes; small letters and all else make up the rest.
CLASSES = ["[A-Z]", "[0-9]", r"[#*$%&|<>]", r"[.,;:!?]", r"[^\x00-\x7F]"]
#: Common words of a language; documents that each must be in; documents that a reference needs; parts of one in which a document's histogram is summed.
COMMON, HELD, SUPPORT, PARTS = 16, 8, 25, 1_000_000
MIN_WORDS = 20
#: Parts of the vocabulary that rank their words apart; a reference table of at most so many languages is broadcast.
SALTS, FEW_LANGS = 64, 10_000
#: Lists of at most so many languages are looked up as one set first.
LISTED = 64


#: Fixed values of the limit, read from the 3,980 labels of sf0.1: of clean texts of 200 words or more the word distance is 0.193
#: at most and the class distance 0.170, from 150 words on 0.214; below that the word distance times the root of the number of words
#: is 2.63 at most from 100 words on, and 2.75 under 100. Of junk of 100 words or more the word distance is 0.238 at least, mostly above 0.3.
FLOOR, NOISE, SHORT, SHORT_NOISE = 0.22, 2.6, 100, 2.9


def limit_of(n: Column) -> Column:
    """The limit of both distances for a text of ``n`` words: their sampling noise falls with the root of ``n``."""
    return F.greatest(F.lit(FLOOR), F.when(n < SHORT, SHORT_NOISE).otherwise(NOISE) / F.sqrt(F.greatest(n, F.lit(1))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words (a power of 2) that occur twice or more in the array."""

    def chained(h: Column, reach: int) -> Column:
        """Hashes of ``reach`` words from hashes of half as many, at each place where they fit."""
        return h if reach == 1 else let(chained(h, reach // 2), lambda half: F.transform(F.slice(half, 1, F.size(half) - reach // 2), lambda x, i: F.xxhash64(x, F.get(half, i + reach // 2))))

    def covered(g: Column) -> Column:
        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + window - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + window).alias("end"))
        total = F.aggregate(let(pairs, places), start, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(g)) < F.size(g), total).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > window, let(chained(F.transform(words, lambda w: F.xxhash64(w)), window), covered)).otherwise(F.lit(0).cast("long"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of the same bins; NULL where one is empty."""
    plus = lambda a, x: a + x

    def of(u: Column) -> Column:
        term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        parts = F.transform(u, lambda x: term(x["p"], (x["p"] + x["q"]) / 2) + term(x["q"], (x["p"] + x["q"]) / 2))
        return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), plus) / 2, F.lit(0.0)))

    total = lambda h: F.aggregate(h, F.lit(0.0), plus)
    joint = let(F.struct(total(p).alias("p"), total(q).alias("q")), lambda t: F.when((t["p"] > 0) & (t["q"] > 0), of(F.zip_with(p, q, lambda a, b: F.struct((a / t["p"]).alias("p"), (b / t["q"]).alias("q"))))))
    return joint


def words_in(text: Column) -> Column:
    """Runs of anything but space and the five ASCII white-space controls; split at single spaces, which takes no pattern."""
    for control in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(control), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def class_counts(text: Column, chars: Column) -> Column:
    """Characters of each class and all others among ``chars`` characters in words."""
    rare = F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")  # no class has these, and they are nearly all
    kept = lambda t: [F.regexp_replace(t, f"[{c[2:-1]}]+" if c[1] == "^" else f"[^{c[1:-1]}]+", "") for c in CLASSES]
    return let(let(rare, lambda t: F.array(*(F.length(x).cast("long") for x in kept(t)))), lambda some: with_rest(some, chars))


def with_rest(some: Column, whole: Column) -> Column:
    return F.concat(some, F.array(F.greatest(whole - F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))))


def word_counts(words: Column, common: Column, known: list[str]) -> Column:
    """How often each of ``common`` stands in ``words``, and the number of all others; NULL without a list.

    ``known``, if any, are the common words of all languages: nearly all other words go by one lookup.
    """
    found = F.filter(words, lambda w: w.isin(known)) if known else words
    counts = let(found, lambda f: F.transform(common, lambda c: (F.size(f) - F.size(F.array_remove(f, c))).cast("long")))
    return F.when(common.isNotNull(), let(counts, lambda some: with_rest(some, F.size(words).cast("long"))))


def known_words(lists: DataFrame) -> list[str]:
    """All words of ``lists`` if these are at most ``LISTED``, else none."""
    some = lists.limit(LISTED + 1).collect()
    return sorted({w for r in some for w in r["ref_words"]}) if len(some) <= LISTED else []


def word_chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))


def common_words(docs: DataFrame) -> DataFrame:
    """(ref_lang, ref_words): the words that most documents of a language hold, ties by code point, of languages with support."""
    held = docs.select("lang", words_in(F.col("text")).alias("words"))
    counted = held.select("lang", F.explode(F.when(F.size("words") >= MIN_WORDS, F.array_distinct("words"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HELD)
    order = [F.desc("n"), F.asc("word")]
    # The best of each part of the vocabulary first, so that no task ranks all words of a language.
    some = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(SALTS))).orderBy(*order))).where(F.col("rank") <= COMMON)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= COMMON)
    lists = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("ranked"))
    return lists.select(F.col("lang").alias("ref_lang"), F.col("ranked.word").alias("ref_words"))


def _by_language(docs: DataFrame, per_language: DataFrame) -> DataFrame:
    """``docs`` with its language's row; broadcast only if the counted languages are few, else joined by a shuffle."""
    few = per_language.limit(FEW_LANGS + 1).count() <= FEW_LANGS
    return docs.join(F.broadcast(per_language) if few else per_language, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")


def references(measured: DataFrame) -> DataFrame:
    """(ref_lang, ref_classes, ref_common): sums of the shares of all documents of a language that has support."""
    # Short texts count nothing, rather than being filtered: a filter would cut their words apart twice.
    parts = lambda x, n: F.expr(f"sum(if(n_words >= {MIN_WORDS}, {x} * {PARTS}L div greatest({n}, 1), 0L))")  # noqa: E731  whole numbers, so that sums do not hang on their order
    sums = [parts(f"classes[{i}]", "word_chars").alias(f"a{i}") for i in range(len(CLASSES) + 1)] + [parts(f"get(common, {i})", "n_words").alias(f"b{i}") for i in range(COMMON + 1)]
    both = measured.groupBy("lang").agg(F.sum(F.when(F.col("n_words") >= MIN_WORDS, 1).otherwise(0)).alias("support"), *sums).where(F.col("support") >= SUPPORT)
    common = F.filter(F.array(*(f"b{i}" for i in range(COMMON + 1))), lambda x: x.isNotNull())
    return both.select(F.col("lang").alias("ref_lang"), F.array(*(f"a{i}" for i in range(len(CLASSES) + 1))).alias("ref_classes"), common.alias("ref_common"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]


def judge(docs: DataFrame, carry: list[str] | None = None, write: bool = False) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default, but for ``MEASURES``) and ``MEASURES``.

    ``write``: the measures are written with ``carry`` and summed from there,
    for few and narrow columns; else texts are measured once for the references
    and once for the result, and nothing of a document is written.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in MEASURES]
    (packed,) = unused(docs, "packed_row")
    # The user's columns travel in one struct, so that no name clashes.
    own = docs.select(F.struct(*map(quoted, carry)).alias(packed) if carry else F.lit(None).alias(packed), (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    lists = materialize(common_words(own), "lists")
    found = _by_language(own.withColumn("words", words_in(F.col("text"))), lists)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    measured = found.select(
        packed,
        "lang",
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("words")).alias("word_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        word_counts(F.col("words"), F.col("ref_words"), known_words(lists)).alias("common"),
        "text",
    ).withColumn("classes", class_counts(F.col("text"), F.col("word_chars")))
    measured = measured.drop("text")
    measured = materialize(measured, "measures") if write else measured
    refs = materialize(references(measured), "references")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    enough = F.col("n_words") >= MIN_WORDS
    far = enough & (F.greatest("class_distance", "word_distance") > limit_of(F.col("n_words")))
    judged = (
        _by_language(measured, refs)
        .withColumn("n_symbols", F.element_at("classes", 3))
        .withColumn("class_distance", distance(F.col("classes"), F.col("ref_classes")))
        .withColumn("word_distance", distance(F.col("common"), F.col("ref_common")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    )
    return judged.select(*[F.col(packed).getField(c).alias(c) for c in carry], *MEASURES)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``."""
    row, fence = unused(docs, "good_row", "fence")
    # A column that is not deterministic keeps the filter above the measures, which would be made once for each of its parts.
    held = docs.select(F.struct(*map(quoted, docs.columns)).alias(row), *(c for c in ("lang", "text") if c in docs.columns))
    good = judge(held, [row]).withColumn(fence, F.monotonically_increasing_id()).where(F.col("kept") & (F.col(fence) >= 0))
    return good.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])


_JS = """CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i:
  CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * log2({p}[i] / list_sum({p}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END
  + CASE WHEN {q}[i] > 0 THEN {q}[i] / list_sum({q}) * log2({q}[i] / list_sum({q}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END)) / 2)) END"""
SQL = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
v AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(ws)) AS word FROM w WHERE len(ws) >= {MIN_WORDS}) GROUP BY lang, word HAVING count(*) >= {HELD}),
c AS (SELECT lang AS l, list(word ORDER BY n DESC, word) AS common FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {COMMON}) GROUP BY lang),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, ws[i:i + 7]) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '{CLASSES[2]}'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  [{", ".join(f"len(regexp_extract_all(text, '{x}'))" for x in CLASSES)}]::BIGINT[] AS cs,
  list_transform(common, lambda y: len(list_filter(ws, lambda x: x = y)))::BIGINT[] AS fs FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN c ON lang IS NOT DISTINCT FROM l),
h AS (SELECT *, list_append(cs, greatest(word_chars - list_sum(cs), 0)::BIGINT) AS k1, CASE WHEN fs IS NOT NULL THEN list_append(fs, greatest(n_words - list_sum(fs), 0)::BIGINT) END AS k2 FROM m),
r AS (SELECT lang AS l, [{", ".join(f"sum(k1[{i + 1}] * {PARTS} // word_chars)" for i in range(len(CLASSES) + 1))}]::DOUBLE[] AS q1,
  list_filter([{", ".join(f"sum(k2[{i + 1}] * {PARTS} // n_words)" for i in range(COMMON + 1))}]::DOUBLE[], lambda x: x IS NOT NULL) AS q2 FROM h WHERE n_words >= {MIN_WORDS} GROUP BY lang HAVING count(*) >= {SUPPORT}),
g AS (SELECT h.* EXCLUDE (k1, k2), k1::DOUBLE[] AS p1, k2::DOUBLE[] AS p2, q1, q2, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM h LEFT JOIN r ON h.lang IS NOT DISTINCT FROM r.l),
j AS (SELECT *, {_JS.format(p="p1", q="q1")} AS d1, {_JS.format(p="p2", q="q2")} AS d2 FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words >= {MIN_WORDS} AND greatest(d1, d2) > greatest({FLOOR}, CASE WHEN n_words < {SHORT} THEN {SHORT_NOISE} ELSE {NOISE} END / sqrt(greatest(n_words, 1))), false) AS kept,
  round(d1, 4) AS class_distance, round(d2, 4) AS word_distance FROM j
"""


def op1(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["doc_id"], write=True)
    return out.withColumn("class_distance", F.round("class_distance", 4)).withColumn("word_distance", F.round("word_distance", 4))
