"""Suffix-array dedup by common-prefix intervals.

Bytes that stand in a smaller document already go. The distinct pieces under
some anchor keys (``anchors``) make up a block; their suffixes of at least
``window`` bytes form an enhanced suffix array: sorted suffixes and the common
prefix of neighbours. A stack scan lists its common-prefix intervals; one
whose suffixes follow different bytes cannot be extended to the left, so it is
a maximal repeat of the block, and it is given with all its occurrences. A
piece that stands in several places is a suffix with several occurrences, so
its leaf is a repeat as well. Of each repeat group the least document keeps
its bytes; the groups' spans hold for all documents that have their pieces.

Nulls: a null text is empty; a null id counts as larger than all others.
Repeated rows: equal ids are not smaller than each other, so nothing goes from
one for the other's sake. Empty tables give empty results. Long texts: a
worker holds one whole document at a time. Only doc_id (a whole number) and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from epochweave.llm import anchors as A

WINDOW, SEED = 50, 20


def maximal_repeats(rule: A.Rule, block: A.Block) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, pieces, starts) of the maximal repeats of a block of at least a window, each with all occurrences."""
    # Alone under its key or not, a piece that stands in several places repeats as a whole; nothing longer is in the block.
    out = [(int(block.size[i]), np.array([i]), np.zeros(1, np.int64)) for i in np.flatnonzero((block.times > 1) & (block.size >= rule.window)).tolist()]
    some = A.promising(rule, block)
    chosen = block.take(some)
    piece, start, _, common = A.suffixes(rule, chosen)
    if not len(piece):
        return out
    begin = chosen.bounds[:-1][piece] + start
    before = np.where(start == 0, -1 - np.arange(len(start)), chosen.flat[np.maximum(begin - 1, 0)].astype(np.int64))
    # How far back the byte before stays the same: an interval is diverse if it reaches further.
    alike = np.concatenate([[0], np.where(before[1:] == before[:-1], 0, np.arange(1, len(before)))])
    since = np.maximum.accumulate(alike)
    stack: list[tuple[int, int]] = []
    close = common >= rule.window
    edges = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # suffixes a .. b share the least length
        for i, height in enumerate([*common[a:b].tolist(), 0], a):
            left = i
            while stack and stack[-1][0] > height:
                size, left = stack.pop()
                if since[i] > left:
                    out.append((size, some[piece[left : i + 1]], start[left : i + 1]))
            if height and (not stack or stack[-1][0] < height):
                stack.append((height, left))
    return out


def _matcher(rule: A.Rule, every: bool = False):
    def match(block: A.Block):
        none = np.zeros(0, np.int64)
        pieces, starts, ends, later = [none], [none], [none], [np.zeros(0, bool)]
        for size, piece, start in maximal_repeats(rule, block):
            least = block.least[piece]
            first = least == least.min()
            # The least document keeps its bytes, but other documents may have its piece.
            goes = ~first | (block.times[piece] > 1) | every
            pieces.append(piece[goes])
            starts.append(start[goes])
            ends.append(start[goes] + size)
            later.append(first[goes])
        return tuple(map(np.concatenate, (pieces, starts, ends, later)))

    return match


def repeat_groups(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, start, size, repeat): all occurrences, in bytes, of the repeats that are maximal within their pieces; one ``repeat`` is one group."""
    rule = A.Rule(window, seed, "byte", True)
    return A.occurrences(rule, docs, _matcher(rule, every=True))


def op8(spark, sf_dir: str) -> DataFrame:
    from epochweave.session import table

    def row(data, starts, ends):
        if not len(starts):
            return len(data), 0, 0, hashlib.sha256(data).hexdigest()
        gone = A.covered(len(data), starts, ends)
        return len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(data[~gone]).hexdigest()

    rule = A.Rule(WINDOW, SEED, "byte", True)
    return A.repeated(rule, table(spark, sf_dir, "documents"), _matcher(rule), row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
