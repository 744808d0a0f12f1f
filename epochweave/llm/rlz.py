"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is the reference, indexed in blocks: a block holds the distinct
pieces of documents under some anchor keys (``anchors``), so that equal
passages meet in one block wherever they stand, and its suffix array tells for
each place the longest match that the block has elsewhere. The pieces that a
document's anchors name go to their blocks and are factored greedily there, so
a factor ends with its piece at the latest: from each place the longest match
is taken, and at its end the parse steps back to the first window that reaches
over the factor's boundary, so that no window is missed between two factors. Factors of at least ``window`` words are
repeats; all else are literals. A piece that the corpus holds more than once is
matched by its other occurrences. Each piece is parsed once, and its factors
hold for all documents that have it.

Nulls: a null text has no words; a null id is kept. Repeated rows are copies
of each other, so their long passages go from each, and so are rows that share
an id or have none. Empty tables give empty results. Long texts: a worker
holds one whole document at a time. Only doc_id (a whole number) and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from epochweave.llm import anchors as A
from epochweave.llm import kernels as k

WINDOW, SEED = 35, 8


def longest_matches(rule: A.Rule, block: A.Block) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a block, piece by piece: the longest match that stands elsewhere (0: shorter than a window), and the windows' offsets by piece."""
    count = np.maximum(block.size - rule.window + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    best = np.zeros(bounds[-1], np.int64)
    some = A.promising(rule, block)
    piece, start, _, common = A.suffixes(rule, block.take(some))
    near = np.zeros(len(piece) + 1, np.int64)
    near[1:-1] = common
    best[bounds[some[piece]] + start] = np.maximum(near[:-1], near[1:])
    best[best < rule.window] = 0
    # Other occurrences of the same piece match up to its end.
    of = np.repeat(np.arange(len(count)), count)
    rest = block.size[of] - (np.arange(len(of)) - bounds[of])
    return np.where(block.times[of] > 1, rest, best), bounds


def parse(rule: A.Rule, block: A.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of the greedy factors of at least a window."""
    best, bounds = longest_matches(rule, block)
    long = np.append(np.flatnonzero(best), len(best))
    piece = np.searchsorted(bounds, long, "right") - 1
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < len(long) - 1:
        at, p = int(long[i]), int(piece[i])
        start = at - int(bounds[p])
        end = start + int(best[at])
        out.append((p, start, end))
        # The first window over the boundary, but at least one step; a later piece starts anew.
        i = max(i + 1, int(np.searchsorted(long, min(int(bounds[p]) + end - rule.window + 1, int(bounds[p + 1])))))
    none = np.zeros(0, np.int64)
    found = tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (none, none, none)
    return found


def _matcher(rule: A.Rule):
    def match(block: A.Block):
        piece, start, end = parse(rule, block)
        return piece, start, end, np.zeros(len(piece), bool)

    return match


def _repeated(docs: DataFrame, window: int, seed: int, row, schema: str) -> DataFrame:
    rule = A.Rule(window, seed, "word", False)
    return A.repeated(rule, docs, _matcher(rule), row, schema)


def drop_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's words that no repeated window covers, joined by spaces."""

    def row(data, starts, ends):
        ws, we, _ = k.words(data, np.array([0, len(data)]))
        gone = A.covered(len(ws), starts, ends)
        raw = data.tobytes()
        return len(ws), int(gone.sum()), b" ".join(raw[a:b] for a, b, g in zip(ws.tolist(), we.tolist(), gone.tolist(), strict=True) if not g).decode()

    return _repeated(docs, window, seed, row, "n_words long, n_removed long, kept string")


def op7(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    def row(data, starts, ends):
        found = data.tobytes().split()
        if not len(starts):
            return len(found), 0, hashlib.sha256(b" ".join(found)).hexdigest()
        gone = A.covered(len(found), starts, ends)
        return len(found), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(found, gone.tolist(), strict=True) if not g)).hexdigest()

    return _repeated(table(spark, sf_dir, "documents"), WINDOW, SEED, row, "n_words long, n_removed long, kept_sha256 string")
