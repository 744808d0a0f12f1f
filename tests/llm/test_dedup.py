import random

import pytest
from pyspark.sql import functions as F

from epochweave.llm import components, jaccard, lines, repeats, rlz
from tests.conftest import SF
from tests.llm import brute
from tests.llm.conftest import document


def edge_cases(rows):
    """``rows`` (id, text) and what no operator may stumble over: nulls, repeats, shared ids, empty and short texts."""
    text = rows[2][1]
    return [*rows, rows[2], (None, text), (None, None), (900, None), (901, ""), (902, " \n\t"), (903, "A  b"), (904, "a b"), (rows[3][0], "other " + text), (905, "the " * 3000)]


def generated(seed: int, n: int):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "é"]
    passages = [[r.choice(words) for _ in range(r.randint(30, 120))] for _ in range(8)]
    rows = []
    for d in range(n):
        out = []
        for _ in range(r.randint(0, 6)):
            pick = r.random()
            if pick < 0.45:
                p = list(r.choice(passages))
                p = p[r.randint(0, 20) :]
                if r.random() < 0.5 and p:
                    p[r.randrange(len(p))] = f"edit{r.randint(0, 5)}"
                out += p
            elif pick < 0.55:
                out += ["the"] * r.randint(1, 60)
            else:
                out += [r.choice(words) for _ in range(r.randint(1, 60))]
        rows.append((d, " ".join(out)))
    return rows


def near_copies(seed: int, n: int):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    bases = [[r.choice(words) for _ in range(r.randint(1, 150))] for _ in range(10)]
    rows = []
    for d in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
            i = r.randrange(len(w))
            w[i : i + r.randint(0, 1)] = [r.choice(words)]
        rows.append((d, " ".join(w)))
    return rows


def check(query, plain, spark, folder, rows):
    assert sorted(map(tuple, query(spark, folder).collect()), key=repr) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize(("query", "plain"), [(rlz.op7, brute.rlz), (repeats.op8, brute.repeats)])
def test_passages(spark, write, query, plain):
    rows = edge_cases(generated(1, 90))
    check(query, plain, spark, write([document(*r) for r in rows]), rows)


@pytest.mark.parametrize(("query", "plain"), [(jaccard.op2, brute.jaccard), (rlz.op7, brute.rlz), (repeats.op8, brute.repeats)])
def test_given_documents(spark, query, plain):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(query, plain, spark, SF, rows)


def test_near_copies(spark, write):
    rows = edge_cases(near_copies(3, 160))
    check(jaccard.op2, brute.jaccard, spark, write([document(*r) for r in rows]), rows)


def test_clusters_in_blocks(spark, write, monkeypatch):
    """Clusters cut into blocks of 16 give the same components."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = near_copies(4, 120)
    check(jaccard.op2, brute.jaccard, spark, write([document(*r) for r in rows]), rows)


def test_fuzzy_lines(spark, write):
    r = random.Random(2)
    base = [" ".join(f"word{r.randrange(50)}" for _ in range(12)) for _ in range(15)]
    vary = lambda x: x if r.random() < 0.5 else x[: (i := r.randrange(len(x)))] + "x" + x[i + 1 :]
    rows = edge_cases([(d, "\n".join([*(vary(r.choice(base)) for _ in range(4)), "short line", ""])) for d in range(60)])
    assert check_lines(spark, write([document(*r) for r in rows])) > 150


def check_lines(spark, folder):
    """``drop_lines`` against its plain version, and the columns of op3 against its texts."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").withColumn("before", F.col("text"))
    got = [tuple(r) for r in lines.drop_lines(docs).collect()]
    gone = brute.same_lines([(d, t) for d, _, t, _ in got], [x for _, x, _, _ in got])
    columns = [(d, 0 if x is None else len(x.split("\n")), n, brute.sha((x or "").encode())) for d, x, _, n in got]
    assert sorted(map(tuple, lines.op3(spark, folder).collect()), key=repr) == sorted(columns, key=repr)
    return gone


def test_fuzzy_lines_of_given_documents(spark):
    assert check_lines(spark, SF) > 100


def test_empty_tables(spark, write):
    folder = write([])
    for query in (jaccard.op2, lines.op3, rlz.op7, repeats.op8):
        assert query(spark, folder).count() == 0


def test_keeps_one_of_each_group_and_all_columns(spark, write):
    rows = near_copies(5, 40)
    docs = spark.read.parquet(f"{write([document(*r) for r in rows])}/documents.parquet").withColumnRenamed("lang", "node")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute.jaccard(rows)})


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: forest.find(x) for x in nodes}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_maximal_repeats_have_all_occurrences():
    import numpy as np

    from epochweave.llm import anchors

    texts = [b"xxabcdefyy", b"zzabcdefww", b"abcdefyy", b"qqqq"]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    block = anchors.Block(np.zeros(4, np.uint64), np.arange(4), np.array([1, 1, 1, 2]), np.array([len(t) for t in texts]), np.array([5, 5, 3, 0]), flat)
    found = {(texts[p[0]][s[0] : s[0] + size], len(p)) for size, p, s in repeats.maximal_repeats(anchors.Rule(4, 1, "byte", True), block)}
    assert found == {(b"abcdef", 3), (b"abcdefyy", 2), (b"qqqq", 1)}


def test_factors_cover_every_repeated_window():
    import numpy as np

    from epochweave.llm import anchors

    words = lambda text: [ord(c) for c in text]
    texts = ["uabcdefv", "wabcdxyz", "cdefgh", "solo"]
    block = anchors.Block(np.zeros(4, np.uint64), np.zeros(4, np.int64), np.array([1, 1, 1, 2]), np.array(list(map(len, texts))), np.array([3, 3, 0, 0]), np.array(words("".join(texts)), np.uint64))
    rule = anchors.Rule(3, 1, "word", False)
    factors = {(texts[p][a:b], p) for p, a, b in zip(*map(np.ndarray.tolist, rlz.parse(rule, block)), strict=True)}
    assert factors == {("abcd", 0), ("cdef", 0), ("abcd", 1), ("cdef", 2), ("solo", 3)}


@pytest.mark.parametrize(("query", "plain"), [(rlz.op7, brute.rlz), (repeats.op8, brute.repeats)])
def test_shared_and_missing_ids(spark, write, query, plain):
    """Many documents without an id or with the same one are told apart by their texts."""
    rows = [(None if d % 3 else 7, t) for d, t in [*generated(5, 250), *generated(6, 250)]]
    check(query, plain, spark, write([document(*r) for r in rows]), rows)


@pytest.mark.parametrize(("query", "plain"), [(rlz.op7, brute.rlz), (repeats.op8, brute.repeats)])
def test_crowded_keys(spark, write, monkeypatch, query, plain):
    """Keys of more than a few pieces are searched window by window, with the same result."""
    from epochweave.llm import anchors

    monkeypatch.setattr(anchors, "CROWD", 3)
    monkeypatch.setattr(anchors, "AT_ONCE", 5)
    rows = edge_cases(generated(8, 120))
    check(query, plain, spark, write([document(*r) for r in rows]), rows)


@pytest.mark.parametrize(("module", "name", "query"), [(rlz, "parse", rlz.op7), (repeats, "maximal_repeats", repeats.op8)])
def test_the_method_decides(spark, write, monkeypatch, module, name, query):
    """Without factors or intervals nothing goes."""
    import numpy as np

    none = np.zeros(0, np.int64)
    monkeypatch.setattr(module, name, lambda *_: (none, none, none) if module is rlz else [])
    rows = [(1, "one two three " * 40), (2, "one two three " * 40)]
    assert {r["n_removed"] for r in query(spark, write([document(*r) for r in rows])).collect()} == {0}


def test_repeat_groups(spark, write):
    """Every group holds one string, at all places where a window of it stands."""
    rows = generated(9, 40)
    docs = spark.read.parquet(f"{write([document(*r) for r in rows])}/documents.parquet")
    texts = {d: t.encode() for d, t in rows}
    groups = {}
    for r in repeats.repeat_groups(docs).collect():
        groups.setdefault(r["repeat"], set()).add((r["doc_id"], r["start"], r["size"]))
    assert groups
    for places in groups.values():
        assert len({texts[d][a : a + n] for d, a, n in places}) == 1 and len(places) > 1
        some, size = next((texts[d][a : a + n], n) for d, a, n in places)
        everywhere = {(d, i, size) for d, t in texts.items() for i in range(len(t) - size + 1) if t[i : i + size] == some}
        assert places <= everywhere


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize(("query", "plain"), [(jaccard.op2, brute.jaccard), (rlz.op7, brute.rlz)])
def test_words_that_break_polynomial_hashes(spark, write, query, plain):
    """Repetitive words of 1,024 letters and their complements are different words."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(34)]
    rows = [(1, one), (2, other), (3, " ".join([one, *rest])), (4, " ".join([other, *rest])), (5, " ".join([one[:40], *rest])), (6, " ".join([other[:40], *rest]))]
    check(query, plain, spark, write([document(*r) for r in rows]), rows)


def test_one_of_each_group_without_ids(spark, write):
    """Copies without an id go where a linked document has one; else one text of the group stays, with its repeated rows."""
    r = random.Random(17)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(60)) for _ in range(3)]
    near = [t + " more" for t in texts]
    rows = [(5, texts[0]), (None, texts[0]), (None, near[0]), (3, near[0]), (None, texts[1]), (None, near[1]), (None, texts[1]), (None, None), (None, ""), (8, texts[2])]
    kept = jaccard.keep_one(spark.read.parquet(f"{write([document(*x) for x in rows])}/documents.parquet")).collect()
    got = sorted(((x["doc_id"], x["text"]) for x in kept), key=repr)
    assert [x for x in got if x[0] is not None] == [(3, near[0]), (8, texts[2])]
    alone = [t for d, t in got if d is None]
    assert {*alone} in ({None, "", texts[1]}, {None, "", near[1]}) and len(alone) == (4 if texts[1] in alone else 3)


def test_windows_have_anchors_of_their_own():
    """The anchor of a window does not hang on the slice that it is read in."""
    import numpy as np

    from epochweave.llm import kernels

    values = np.random.default_rng(3).integers(0, 1 << 34, 5000, dtype=np.uint64) << np.uint64(30)
    whole = kernels.window_minima(values, 28)
    for a in (0, 7, 1000, 4000):
        assert (kernels.window_minima(values[a : a + 900], 28) + a == whole[a : a + 873]).all()


def test_shared_passages_are_not_filed(spark, write, monkeypatch):
    """Passages that an eighth of all documents share bring nobody together, long as the documents are; near copies still meet."""
    r = random.Random(23)
    passages = [[f"p{r.randrange(400)}" for _ in range(60)] for _ in range(8)]
    rows = []
    for d in range(1000):
        own = [f"w{r.randrange(20000)}" for _ in range(2500)]
        at = r.randrange(2500)
        rows.append((d, " ".join([*own[:at], *passages[d % 8], *own[at:]])))
    near = {2000 + d: d for d in range(0, 1000, 100)}
    rows += [(c, rows[d][1] + " and more") for c, d in near.items()]
    found, clusters = [], jaccard._clusters

    def kept(*args):
        found.extend(tuple(x) for x in clusters(*args).collect())
        return spark.createDataFrame(found, "leader bigint, node bigint")

    monkeypatch.setattr(jaccard, "_clusters", kept)
    got = jaccard.op2(spark, write([document(*x) for x in rows])).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {d: near.get(d, d) for d, _ in rows}
    assert 2 * len(near) <= len(found) < 100


def test_rarest_items_of_rows():
    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(50):
        sizes = r.integers(0, 9, 12)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        levels = r.choice(4, bounds[-1], p=[0.5, 0.2, 0.2, 0.1]).astype(np.uint8)
        most = r.integers(0, sizes + 1)
        want = {i for a, b, m in zip(bounds, bounds[1:], most, strict=False) for i in sorted(range(a, b), key=lambda i: (levels[i], i))[:m]}
        got = jaccard.rarest(levels, bounds, most).tolist()
        assert len(got) == len(want) and set(got) == want


def test_word_hashes_by_their_definition():
    import numpy as np
    import xxhash

    from epochweave.llm import kernels

    words = [bytes([97 + i % 26]) * n for i, n in enumerate((1, 2, 3, 47, 48, 49, 300, 2, 48, 1))]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = kernels.words(data, np.array([0, len(data)]))
    sums = [sum(int(kernels._TABLES[i << 8 | c]) for i, c in enumerate(w[: kernels.TABLED])) + len(w) for w in words]
    want = [xxhash.xxh3_64_intdigest(w) if len(w) > kernels.TABLED else int(kernels.mix(np.array([x & (1 << 64) - 1], np.uint64))[0]) for w, x in zip(words, sums, strict=True)]
    assert kernels.word_hashes(data, starts, ends).tolist() == want
    assert not len(kernels.word_hashes(data, starts[:0], ends[:0]))


def test_signatures_of_few_sets_need_no_tree(monkeypatch):
    """Candidates of a small cluster are found without trees, by signatures as wide as they are: all that link, and none that trees rule out."""
    import numpy as np

    r = np.random.default_rng(6)

    def joined(pairs):
        forest = components.Forest()
        for i, j in pairs:
            forest.join(i, j)
        return forest

    cases = []
    for _ in range(300):
        base = r.integers(0, 1 << 63, int(r.choice([20, 120, 130, 140])), dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[: len(base) - r.integers(0, len(base) // 2)], r.integers(0, 1 << 63, r.integers(0, 30), dtype=np.uint64)])) for _ in range(r.integers(2, 7))]
        maps = [jaccard.bitmaps([x], jaccard.signature_width(len(x)))[0] for x in sets]
        sides = np.zeros(len(sets), np.int8) if r.random() < 0.5 else np.arange(len(sets), dtype=np.int8) % 2
        links = [(i, j) for j in range(len(sets)) for i in range(j) if (sides[i] != sides[j] or not sides.any()) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
        args = (maps, np.array(list(map(len, sets))), sides, list(range(len(sets))), 75)
        with monkeypatch.context() as m:
            m.setattr(jaccard, "FEW", 0)
            cases.append((args, links, joined(jaccard.candidate_pairs(*args))))
    assert len({len(m) for (maps, *_), *_ in cases for m in maps}) > 1 and sum(len(x) for _, x, _ in cases) > 100
    monkeypatch.setattr(jaccard, "Tree", None)
    for args, links, trees in cases:
        pairs = jaccard.candidate_pairs(*args)
        few = joined(pairs)
        assert all(few.find(i) == few.find(j) for i, j in links) and all(trees.find(i) == trees.find(j) for i, j in pairs)
