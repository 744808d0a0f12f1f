import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochweave.llm import simhash
from tests.conftest import SF
from tests.llm import brute
from tests.llm.conftest import document
from tests.llm.test_dedup import check, edge_cases, near_copies


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(simhash.op12, brute.simhash, spark, SF, rows)


def test_near_copies_and_edges(spark, write):
    rows = edge_cases(near_copies(21, 150))
    check(simhash.op12, brute.simhash, spark, write([document(*r) for r in rows]), rows)


def test_empty_and_extra_columns(spark, write):
    assert simhash.op12(spark, write([])).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", 5), (2, "A  b c\nd", 6), (None, None, 7)], "doc_id bigint, text string, fp int").withColumn("node", F.lit("x"))
    got = sorted(map(tuple, simhash.near_copies(docs).select("doc_id", "component_id").collect()), key=repr)
    assert got == [(1, 1), (2, 1), (None, None)]


def test_code_is_perfect():
    """Every syndrome has one leader, at 0 to 3 errors, and five words stand at 4 bits from a segment with 3."""
    code = simhash.Golay()
    assert np.bincount(code.weight).tolist() == [1, 23, 253, 1771]
    some = np.random.default_rng(5).integers(0, 1 << 23, 400)
    words = [m << 11 for m in range(1 << 12)]
    words = np.array([w | int(code.low[w & 2047] ^ code.high[w >> 11]) for w in words])
    found, counts = code.keys(some)
    for x, keys, count in zip(some.tolist(), found, counts, strict=True):
        apart = np.bitwise_count(words ^ x)
        assert apart[keys[0]] == apart.min() <= 3
        assert set(keys[count].tolist()) - {int(keys[0])} == set(np.flatnonzero(apart == 4).tolist())


def test_keys_find_all_pairs():
    """Fingerprints at 0 to 3 bits always meet, one of them at home."""
    r, code = np.random.default_rng(6), simhash.Golay()
    one = r.integers(0, 1 << 64, 4000, dtype=np.uint64)
    two = one.copy()
    for i in range(len(two)):
        for b in r.choice(64, r.integers(0, 4), replace=False).tolist():
            two[i] ^= np.uint64(1 << b)
    sets = [[set() for _ in one], [set() for _ in one]]
    for side, fps in enumerate((one, two)):
        for key, row in zip(*(x.tolist() for x in simhash.keys_of(fps, code)), strict=True):
            sets[side][row].add(key)
    assert all(any((x ^ 1) in b or (x % 2 == 0 and x in b) for x in a) for a, b in zip(*sets, strict=True))


@pytest.mark.parametrize(("few", "crowd"), [(2, 1 << 15), (2, 6), (40, 50)])
def test_crowded_groups(spark, monkeypatch, few, crowd):
    """Groups that are searched, or cut into parts, have the same components as all pairs."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(8)
    centres = [r.getrandbits(64) for _ in range(3)]
    fps = set()
    for _ in range(150):
        x = r.choice(centres)
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.choice(range(0, 64, 3))
        fps.add(x)
    fps = sorted(fps)
    groups = brute.Groups(len(fps))
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 3:
                groups.join(i, j)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {x["node"]: x["root"] for x in simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    want = {}
    for i, x in enumerate(signed):
        want.setdefault(groups.find(i), []).append(x)
    assert got == {x: min(v) for v in want.values() if len(v) > 1 for x in v}
