import duckdb
import pytest
from pyspark.sql import functions as F

from epochweave.llm import manifest
from tests.conftest import SF
from tests.llm import brute
from tests.llm.conftest import document


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("groups", [[1], [2], [3, 1], [30, 1, 4, 10, 9]])
def test_trees(spark, write, groups):
    """Sources of all shapes, null ones, nulls in every column, shared ids and repeated rows, against proofs by hand."""
    given = [document(d, f"é {d}\nline\n" if d % 3 else None, source=None if g == 1 else f"s{g}") for g, n in enumerate(groups) for d in range(n)]
    if len(groups) > 3:
        given += [given[3], (None, None, None, None, None), (None, "x\ny", "en", "s0", 3), (7, "other\ntext", None, "s0", None), (7, "", "en", "s0", 0), (8, "long " * 50000, "en", "s0", 250000)]
    assert rows(manifest.op13(spark, write(given))) == sorted(brute.manifest(given), key=repr)


def test_given_documents(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(manifest.SQL)
    at = [[d[0] for d in cursor.description].index(c) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
    got = rows(manifest.op13(spark, SF))
    assert got == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_empty(spark, write):
    assert manifest.op13(spark, write([])).count() == 0


def test_other_columns_and_runs(spark):
    """Names that clash do no harm; proofs of runs of two climb to the root, and not from another leaf."""
    docs = spark.range(11).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.col("id").cast("string").alias("pos"), F.lit(1).alias("digest"), F.lit(2).alias("g"))
    proved = manifest.manifest(docs, fields=("doc_id", "pos"), run=2, keep={"extra": F.col("digest")})
    found = manifest.folded(proved, "leaf", run=2).collect()
    assert len(found) == 11 and all(r["folded_root"] == r["root"] and r["extra"] == 1 for r in found)
    wrong = manifest.folded(proved.withColumn("leaf", F.unhex(F.sha2("leaf", 256))), "leaf", run=2).collect()
    assert not any(r["folded_root"] == r["root"] for r in wrong)
