"""Phrase collocation mining over vertical positional inverted lists.

Texts are cut at punctuation and line breaks into pieces, and pieces into
words. Each task turns its texts into lists by word: the ascending positions
where it stands, with a position left out between pieces. A phrase has such a
list, too, of the places where it begins, and the length of all its lists is
its exact frequency. Phrases grow by a word at a time: the list of a frequent
phrase of k words is merged, by position, with the postings of the words that
stand k places further on, and, as every part of a frequent phrase is frequent,
with the places where a frequent phrase of k words begins one further on.

Lists stay at their home, some ``HOME`` bytes of text. A step begins with the
lengths of the lists one word further on, sent by key; what is frequent comes
back to the homes that have it, and one of them spells it out. All else is
dropped, and so are words that no phrase needs any more. Between two steps a
home keeps the postings of words and the places where a frequent phrase begins:
which one it is follows from the words there, so its list is made again from
them. Languages are counted apart: a key is the hash of the language and the
words. The statistics of frequent phrases are plain joins: of a phrase with the
parts on both sides of each cut, and with the phrases that are one word longer
and hold it. That is enough to find a longer phrase of any length, as all
phrases between the two are as frequent as the longer one at least.

Nulls: a null text has no words; a null language is ``und``, as is the
language of this name. Repeated rows and rows without an id count as rows.
Empty texts and tables give nothing. Very long texts: a text is one list, and
a worker holds one. Ties: equal scores and frequencies go by the phrase's
bytes. Only lang and text are read, so other columns cannot clash. Keys are
64-bit hashes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochweave.llm import anchors as A
from epochweave.llm import kernels as k
from epochweave.session import discard, materialize

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text whose lists are one row, or one home; and that a bucket of keys stands for.
LISTED, HOME, BUCKET = 1 << 20, 8 << 20, 32 << 20
#: Keys that a task holds before it sends their tallies.
HELD = 2_000_000
#: Parts in which a language's best phrases are found first.
SALTS = 32
#: Bytes that end a word, and those of them that end a piece.
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[list(SPACES)] = True

LISTS, WORDS, FOUND = range(3)
LIST_COLUMNS = 6
ROW = "kind int, home bigint, " + ", ".join(f"c{i} binary" for i in range(LIST_COLUMNS)) + ", lang string, phrase string, size int, f bigint"
SCHEMA = pa.schema([("kind", pa.int32()), ("home", pa.int64()), *((f"c{i}", pa.binary()) for i in range(LIST_COLUMNS)), ("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])
TALLY = "home bigint, bucket int, codes binary, counts binary"
TOLD = "home bigint, codes binary, spoken binary, times binary"


def row(kind: int, **values) -> dict:
    return dict.fromkeys(SCHEMA.names) | {"kind": kind} | values


def rows_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, SCHEMA)


def steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def lists(codes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, lengths, positions by code and then ascending, order) of items at ascending positions."""
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=~codes[order][:1]) != 0)
    return codes[order][first], np.diff(np.append(first, len(codes))), positions[order], order


def pack_lists(positions: np.ndarray, counts: np.ndarray) -> bytes:
    """Positions as steps, the first of each list from 0; all lowest bytes first, then the next ones, as the higher ones are mostly zero."""
    gaps = np.diff(positions, prepend=0)
    first = np.cumsum(counts) - counts
    gaps[first] = positions[first]
    return A.squeeze(np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel())


def unpack_lists(blob: bytes, counts: np.ndarray) -> np.ndarray:
    gaps = np.ascontiguousarray(A.expand(blob).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    total = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    return total - np.repeat(total[first] - gaps[first], counts) if len(gaps) else gaps


def by_position(counts: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions ascending, number of the list of each) of some lists."""
    order = np.argsort(positions, kind="stable")
    return positions[order], np.repeat(np.arange(len(counts)), counts)[order]


def met(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted position its index in the ascending ``places``, or -1: two sorted lists are merged."""
    at = np.searchsorted(places, wanted)
    at[at == len(places)] = 0
    return np.where(places[at] == wanted, at, -1) if len(places) else np.full(len(wanted), -1)


def language_code(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), seed=1)


def pack_codes(codes: np.ndarray) -> bytes:
    """Ascending codes, as steps."""
    return A.squeeze(np.diff(codes, prepend=np.uint64(0)))


def unpack_codes(blob: bytes) -> np.ndarray:
    return np.cumsum(A.expand(blob), dtype=np.uint64)


def _listed(docs: DataFrame) -> DataFrame:
    """``ROW``s: the word lists of all texts, and the words of each language."""

    def run(batches):
        task, sub, held, words = TaskContext.get().partitionId(), 0, 0, {}
        for batch in batches:
            for part, data, offsets in k.slices(batch, "text", LISTED):
                data = k.lowered(data)
                starts, ends, bounds = k.words(data, offsets, _BETWEEN)
                if not len(starts):
                    continue
                breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
                of = k.rows_of(bounds)
                apart = (breaks[starts[1:]] != breaks[ends[:-1]]) | (of[1:] != of[:-1])
                places = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(apart)])
                names = [x if x is not None else "und" for x in part.column(0).to_pylist()]
                tags = np.array([language_code(x) for x in names], np.uint64)
                for x, c in zip(names, np.diff(bounds).tolist(), strict=True):
                    words[x] = words.get(x, 0) + c
                _, times, positions, order = lists(k.mix(k.word_hashes(data, starts, ends) + tags[of]), places)
                some = order[np.cumsum(times) - times]  # one occurrence of each word
                size = (ends - starts)[some]
                text = data[np.repeat(starts[some], size) + steps(size)]
                different = sorted(set(names))
                lang = np.array([different.index(x) for x in names], np.uint32)[of[some]]
                yield from rows_table([Lists(different, text, size, lang, times, positions, places).row(task << 20 | sub)]).to_batches()
                held += len(data)
                if held > HOME:
                    sub, held = sub + 1, 0
        yield from rows_table([row(WORDS, lang=x, f=c) for x, c in words.items()]).to_batches()

    return docs.select("lang", "text").mapInArrow(run, ROW)


def _tallied(state: DataFrame, size: int, n: int) -> DataFrame:
    """``TALLY`` rows: each home's phrases of ``size`` words by key, and the lengths of their lists, dealt to buckets."""

    def sent(home: int, codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        found, of = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate(counts), minlength=len(found)).astype(np.uint32)
        bucket = (found % k.U64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        parts = [m for m in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(m)]
        pa.default_memory_pool().release_unused()
        return pa.RecordBatch.from_arrays([pa.array([home] * len(parts), pa.int64()), pa.array([int(bucket[m[0]]) for m in parts], pa.int32()), pa.array([pack_codes(found[m]) for m in parts], pa.binary()), pa.array([A.squeeze(total[m]) for m in parts], pa.binary())], ["home", "bucket", "codes", "counts"])

    def run(batches):
        home, held, codes, counts = None, 0, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if codes and (r["home"] != home or held > HELD):
                    yield sent(home, codes, counts)
                    codes, counts, held = [], [], 0
                home = r["home"]
                found, times, _, _ = lists(*Lists.of(r).grown(size))
                codes.append(found)
                counts.append(times)
                held += len(found)
        if codes:
            yield sent(home, codes, counts)

    return state.select(*_STATE).mapInArrow(run, TALLY)


def _told(tallies: DataFrame, least: int) -> DataFrame:
    """``TOLD`` rows by home: its codes that are frequent over all homes, those that it is to spell out, and their frequencies."""

    def run(key, table):
        codes = [unpack_codes(x.as_py()) for x in table.column("codes")]
        homes = np.repeat(np.asarray(table.column("home")), [len(x) for x in codes])
        codes, times = np.concatenate(codes), np.concatenate([A.expand(x.as_py()) for x in table.column("counts")]).astype(np.int64)
        order = np.lexsort((homes, codes))
        codes, homes, times = codes[order], homes[order], times[order]
        new = np.diff(codes, prepend=~codes[:1]) != 0
        group = np.cumsum(new) - 1
        total = np.add.reduceat(times, np.flatnonzero(new))[group]
        pa.default_memory_pool().release_unused()
        mine = np.flatnonzero(total >= least)
        mine = mine[np.argsort(homes[mine], kind="stable")]
        out = []
        for m in np.split(mine, np.flatnonzero(np.diff(homes[mine])) + 1) if len(mine) else ():
            speaks = m[new[m]]
            out.append((int(homes[m[0]]), A.squeeze(codes[m]), A.squeeze(codes[speaks]), A.squeeze(total[speaks])))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["home", "codes", "spoken", "times"])

    return tallies.groupBy("bucket").applyInArrow(run, TOLD)


_STATE = ["home", "lang", *(f"c{i}" for i in range(LIST_COLUMNS))]


@dataclass
class Lists:
    """The lists of a row: words (bytes one after the other, lengths, languages, postings), and the places where frequent phrases begin."""

    names: list[str]
    text: np.ndarray
    lengths: np.ndarray
    lang: np.ndarray
    counts: np.ndarray
    postings: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, r: dict) -> Lists:
        counts = A.expand(r["c0"]).astype(np.int64)
        return cls(json.loads(r["lang"]), A.expand(r["c2"]), A.expand(r["c3"]).astype(np.int64), A.expand(r["c4"]).astype(np.int64), counts, unpack_lists(r["c1"], counts), np.cumsum(A.expand(r["c5"]), dtype=np.int64))

    def row(self, home: int) -> dict:
        narrow = lambda x: A.squeeze(x.astype(np.uint32))
        return row(LISTS, home=home, c0=narrow(self.counts), c1=pack_lists(self.postings, self.counts), c2=A.squeeze(self.text), c3=narrow(self.lengths), c4=narrow(self.lang), c5=narrow(np.diff(self.begins, prepend=0)), lang=json.dumps(self.names))

    def codes(self) -> np.ndarray:
        """The key of each word."""
        ends = np.cumsum(self.lengths)
        own = np.array([language_code(x) for x in self.names], np.uint64)
        return k.mix(k.word_hashes(self.text, ends - self.lengths, ends) + own[self.lang])

    def grown(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, ascending places) of the phrases of ``size`` words: where one of a word less begins, and another one after it, and the postings have its last word."""
        at, word = by_position(self.counts, self.postings)
        begins = self.begins
        if size > 1:
            begins = begins[(met(begins, begins + 1) >= 0) & (met(at, begins + size - 1) >= 0)]
        of_word = self.codes()
        keys = of_word[word[met(at, begins)]]
        for i in range(1, size):
            keys = k.mix(keys * k.U64(0x9E3779B97F4A7C15) + k.mix(of_word[word[met(at, begins + i)]] + k.U64(i)))
        return keys, begins

    def only(self, begins: np.ndarray, size: int) -> None:
        """Phrases that begin at ``begins`` stay, and the postings that lie in them."""
        self.begins = begins
        covered = np.unique((begins[:, None] + np.arange(size)).ravel())
        hit = met(covered, self.postings) >= 0
        self.counts = np.bincount(np.repeat(np.arange(len(self.counts)), self.counts)[hit], minlength=len(self.counts))
        self.postings = self.postings[hit]
        stands = self.counts > 0
        cut = (np.cumsum(self.lengths) - self.lengths)[stands]
        self.text = self.text[np.repeat(cut, self.lengths[stands]) + steps(self.lengths[stands])]
        self.lengths, self.lang, self.counts = self.lengths[stands], self.lang[stands], self.counts[stands]

    def spelt(self, places: np.ndarray, size: int) -> list[tuple[str, str]]:
        """(language, words) of the phrases that begin at ``places``."""
        at, word = by_position(self.counts, self.postings)
        ids = word[met(at, (places[:, None] + np.arange(size)).ravel())].reshape(-1, size).tolist()
        ends, raw = np.cumsum(self.lengths).tolist(), self.text.tobytes()
        word_of = lambda i: raw[ends[i] - int(self.lengths[i]) : ends[i]].decode("utf-8", "replace")
        return [(self.names[self.lang[x[0]]], " ".join(map(word_of, x))) for x in ids]


def _grown(state: DataFrame, told: DataFrame, size: int, last: bool) -> DataFrame:
    """``ROW``s of the frequent phrases of ``size`` words, from the lists of one word less: spelt out, and the lists to go on with."""

    def run(key, left, right):
        unpacked = lambda c: np.concatenate([A.expand(x.as_py()) for x in right.column(c)]) if right.num_rows else np.zeros(0, np.uint64)
        frequent = np.sort(unpacked("codes"))
        spoken, times = unpacked("spoken"), unpacked("times")
        order = np.argsort(spoken)
        spoken, times, said = spoken[order], times[order], np.zeros(len(spoken), bool)
        out = []
        for batch in left.to_batches(1) if len(frequent) else ():
            own = Lists.of(batch.to_pylist()[0])
            keys, begins = own.grown(size)
            stays = met(frequent, keys) >= 0
            keys, begins = keys[stays], begins[stays]
            if not len(begins):
                continue
            own.only(begins, size)
            found, counts, places, _ = lists(keys, begins)
            speaks = met(spoken, found)
            fresh = np.flatnonzero(speaks >= 0)
            fresh = fresh[~said[speaks[fresh]]]
            if len(fresh):
                said[speaks[fresh]] = True
                first = places[(np.cumsum(counts) - counts)[fresh]]
                out += [row(FOUND, lang=x, phrase=p, size=size, f=f) for (x, p), f in zip(own.spelt(first, size), times[speaks[fresh]].tolist(), strict=True)]
            if not last:
                out.append(own.row(key[0].as_py()))
            pa.default_memory_pool().release_unused()
        return rows_table(out)

    return state.select(*_STATE).groupBy("home").cogroup(told.groupBy("home")).applyInArrow(run, ROW)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to ``longest`` words with a frequency of ``least`` or more, and (lang, n), the words of each language."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(A.buckets(docs.sparkSession), -(-size // BUCKET))
    now = materialize(_listed(docs), "lists")
    words = materialize(now.where(f"kind = {WORDS}").groupBy("lang").agg(F.sum("f").alias("n")), "words")
    found = []
    for size in range(1, longest + 1):
        state = now.where(f"kind = {LISTS}")
        told = materialize(_told(_tallied(state, size, n), least), "told")
        last, now = now, materialize(_grown(state, told, size, size == longest), "lists")
        discard(last, told)
        found.append(materialize(now.where(f"kind = {FOUND}").select("lang", "phrase", "size", "f"), "phrases"))
    discard(now)
    return reduce(DataFrame.unionByName, found), words


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, inside) of phrases of two words or more: ``inside``, the greatest frequency of a phrase that holds this one."""
    many = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    part = lambda low, n: F.array_join(F.slice("words", low, n), " ")
    cuts = many.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    known = lambda side, count: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
    both = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(words, "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    both = both.withColumn("over", F.lit(1000).cast("decimal(38,0)") * exact("a") * exact("n")).withColumn("under", exact("l") * exact("r"))
    least = both.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s"))
    longer = many.where("size > 2").select("lang", "f", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    return least.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score").join(inside, ["lang", "phrase"], "left")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases that no longer one holds at the same frequency."""
    phrases, words = frequent_phrases(docs, least, longest)
    found = scored(phrases, words).where("inside is null or inside < a").drop("inside")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")
    some = salted.withColumn("rank", rank("lang", "salt")).where(F.col("rank") <= top)  # then at most SALTS * top rows a language
    return some.withColumn("rank", rank("lang")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS ws
  FROM documents
),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
spans AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
counted AS (
  SELECT lang, list_slice(ws, i, i + k - 1) AS p, count(*) AS f FROM spans, range(1, 6) t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100
),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM counted WHERE len(p) > 1),
scored AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, n, k, CAST((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.p = c.p[:k] JOIN counted y ON y.lang = c.lang AND y.p = c.p[k + 1:] JOIN totals t ON t.lang = c.lang
),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
parts AS (
  SELECT lang, list_slice(p, i, i + k - 1) AS p, max(f) AS f FROM counted, range(1, 6) s(i), range(2, 5) t(k) WHERE k < len(p) AND i + k - 1 <= len(p) GROUP BY ALL
),
kept AS (SELECT s.* FROM least s LEFT JOIN parts q ON q.lang = s.lang AND q.p = s.p WHERE q.f IS NULL OR 100 * q.f < 100 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM kept)
WHERE rank <= 2000
"""
