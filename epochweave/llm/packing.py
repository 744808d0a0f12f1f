"""Best-fit packing of tokenised documents into sequences.

Token pieces are counted per length; the packing is solved on that histogram
(at most ``capacity`` numbers, however many documents there are) and gives
bin patterns with multiplicities. Each piece then finds its place by its rank
among the pieces of its length. Ranks are counted within (length, salt), with
as many salts as the pieces of a length need, so that a length that a third of
all pieces share is ranked in many tasks.

Large-item matching: no bin holds more than two pieces above a third of its
capacity; such pieces are paired, largest first, each with the largest partner
that fits, at most twice per bin. Smaller pieces, largest first, then go to
the fullest bin that still takes them.

Nulls: a null text is empty and yields the end token alone; a null id is kept.
Repeated rows are pieces of their own. Texts of any length work: a worker
holds one at a time. An empty table gives an empty result. Only doc_id (a
whole number) and text are read, so other columns cannot clash. A special
string of the tokenizer in a text is one token, as ``tokenizers`` has it.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochweave.session import materialize

CAPACITY, END = 1024, 2
#: Pieces of one length that a task ranks, and more only where that makes more than ``GROUPS`` groups.
RANKED, GROUPS = 1000, 65_536
#: Token ids of so many distinct words are kept per worker, those not seen for long go first.
KEPT_WORDS = 500_000
#: White space other than single spaces and single line ends: such texts are encoded whole.
ODD_SPACE = [*(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"), "  ", "\n\n", "\n ", " \n"]
#: Words, maybe after a line end, that are one byte-level pre-token in any version of Unicode.
LETTERS = re.compile(r"\n?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - _VISIBLE))}
_encoders: dict[str, WordStore] = {}


class WordStore(dict):
    """Token ids, as little-endian bytes, of words cut at single spaces or before single line ends.

    A key is a word, encoded with a space before it, or a line end and the word
    after it. Byte-level pre-tokens never reach over such a place, nor from
    letters into punctuation after them, so these parts can be encoded apart.
    A word of letters is one pre-token, which the tokenizer's model takes as it
    is, without the offsets that ``encode`` keeps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tails: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        cut = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
        self.line_end = self.ids("\n")

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def tail(self, marks: str) -> bytes:
        got = self.tails.get(marks)
        if got is None:
            got = self.ids(marks)
            if len(marks) < 8:
                self.tails[marks] = got
        return got

    def letters(self, word: str) -> bytes:
        """Ids of a word of ``LETTERS``."""
        stem = word.lstrip("\n")
        shown = stem if stem.isascii() else stem.encode().decode("latin-1").translate(BYTE_CHARS)
        if len(stem) < len(word):
            return self.line_end + array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return array("I", [t.id for t in self.tokenizer.model.tokenize("Ġ" + shown)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            stem = word.rstrip(string.punctuation)
            if len(stem) < len(word) and stem.lstrip("\n").isalpha():
                got = self[stem] + self.tail(word[len(stem) :])
            elif self.plain and LETTERS.fullmatch(word):
                got = self.letters(word)
            else:
                got = self.ids(word if word[0] == "\n" else " " + word)
        if 2 * len(self) > KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if text[:1] == "\n" or text[-1:].isspace() or any(x in text for x in ODD_SPACE) or any(x in text for x in self.special):
            return self.ids(text)
        words = text.replace("\n", " \n").split(" ")
        return self.ids(words[0]) + b"".join(map(self.__getitem__, words[1:]))


def encoder(path: str) -> WordStore:
    if path not in _encoders:
        _encoders[path] = WordStore(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the end token."""
    last = array("I", [end]).tobytes()

    def cut(batches):
        store = encoder(tokenizer)
        for batch in batches:
            ids, pieces, starts, lengths, crcs = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = store.encode(text.as_py() or "") + last
                n = len(got) // 4
                first = n % capacity or capacity
                begins = [0, *range(first, n, capacity)]
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], n], strict=True)):
                    ids.append(doc_id)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(got[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns (piece lengths) with how many bins use each; every counted piece is placed once."""
    large = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    small = {n: c for n, c in counts.items() if 3 * n <= capacity and c}
    bins: Counter[tuple[int, ...]] = Counter()
    left, order = dict(large), sorted(large)
    for n in reversed(sorted(large)):
        while left[n]:
            fits = [m for m in order[: bisect_left(order, capacity - n + 1)] if left[m] > (m == n)]
            if not fits:
                bins[(n,)] += left[n]
                left[n] = 0
                break
            m = fits[-1]
            times = left[n] // 2 if m == n else min(left[n], left[m])
            bins[(n, m)] += times
            left[n] -= times
            left[m] -= times
    room: dict[int, Counter[tuple[int, ...]]] = defaultdict(Counter)
    for pattern, times in bins.items():
        room[capacity - sum(pattern)][pattern] += times
    gaps = sorted(room)
    for n in sorted(small, reverse=True):
        todo = small[n]
        while todo:
            at = bisect_left(gaps, n)
            if at == len(gaps):  # no bin takes it: new ones, filled with this length
                each = capacity // n
                times, rest = divmod(todo, each)
                for pattern, many in (((n,) * each, times), ((n,) * rest, 1 if rest else 0)):
                    if many:
                        gap = capacity - sum(pattern)
                        if gap not in room or not room[gap]:
                            insort(gaps, gap)
                        room[gap][pattern] += many
                break
            gap = gaps[at]
            pattern, times = next(iter(room[gap].items()))
            each = min(gap // n, todo)
            times = min(times, todo // each)
            room[gap][pattern] -= times
            if not room[gap][pattern]:
                del room[gap][pattern]
            if not room[gap]:
                gaps.pop(at)
            rest = gap - each * n
            if rest not in room or not room[rest]:
                insort(gaps, rest)
            room[rest][pattern + (n,) * each] += times
            todo -= each * times
    return [(p, c) for gap in sorted(room) for p, c in room[gap].items() if c]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first bin, ranks per bin, offset of the first) of runs of slots.

    A pattern used by bins b .. b + c - 1 holds k pieces of one length side by
    side; they take k * c consecutive ranks of that length.
    """
    used: Counter[int] = Counter()
    out, first = [], 0
    for pattern, times in patterns:
        offset = 0
        for n, k in sorted(Counter(pattern).items(), reverse=True):
            out.append((n, used[n], used[n] + k * times - 1, first, k, offset))
            used[n] += k * times
            offset += n * k
        first += times
    return out


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read twice: pass a written table."""
    spark = pieces.sparkSession
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    ranked = max(RANKED, -(-sum(by_length.values()) // GROUPS))
    salts = F.broadcast(spark.createDataFrame([(n, -(-c // ranked)) for n, c in by_length.items()], "length bigint, salts bigint"))
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("salts"))).drop("salts")
    # At most capacity + GROUPS groups, whatever the number of documents.
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: Counter[int] = Counter()
    bases = []
    for length, salt, n in sorted((r["length"], r["salt"], r["n"]) for r in groups):
        bases.append((length, salt, counts[length]))
        counts[length] += n
    runs = slots(pack_lengths(counts, capacity))
    base = F.broadcast(spark.createDataFrame(bases, "length bigint, salt bigint, base bigint"))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.join(base, ["length", "salt"]).withColumn("rank", rank + F.col("base"))
    table = defaultdict(list)
    for run in runs:
        table[run[0]].append(run)
    slots_of = {n: np.array(sorted(rs), np.int64) for n, rs in table.items()}

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), dtype=np.int64) for c in ("length", "rank"))
            bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine, runs_n = np.flatnonzero(length == n), slots_of[int(n)]
                run = runs_n[np.searchsorted(runs_n[:, 1], rank[mine], "right") - 1]
                inner = rank[mine] - run[:, 1]
                bins[mine] = run[:, 3] + inner // run[:, 4]
                offsets[mine] = run[:, 5] + inner % run[:, 4] * n
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their sequence and place there."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return assign(materialize(token_pieces(docs, tokenizer, capacity, end), "pieces"), capacity)


def op10(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    return pack_documents(table(spark, sf_dir, "documents"))
