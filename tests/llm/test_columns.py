"""Operators over tables whose extra columns are named like their own."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import corpus
from waxwing.llm import decontamination, jaccard, lines, mixing, quality, sharding, suffixes, tokencount, tokenorder, work

#: What the operators call columns inside, and what they add.
NAMES = (
    "_score _text _source_size _target _copies _before _rank _source _order _cell _shard _slot _grown_shard _crc32 _node _first _bytes _gone _lines "
    "_n_lines _removed _kept _body _how _spans _of _n_bytes _n_removed _n_spans _rep _bad body name key class salt digest tied before order cell node gone "
    "first bytes lines of how spans words copy bad n size id raw shape hashed cls item_id shard slot _words _copy _rows"
).split()


def crowded(spark):
    return corpus.documents(spark).drop("_size").withColumns({c: F.lit(f"my {c}") for c in NAMES})


def unharmed(out, replaced=()):
    kept = [c for c in NAMES if c not in replaced]
    assert len({c.lower() for c in out.columns}) == len(out.columns) and set(kept) <= set(out.columns)
    rows = out.select("doc_id", *kept).collect()
    assert all(r[c] == f"my {c}" for r in rows for c in kept)
    return len(rows)


def test_operators_leave_other_columns_alone(spark):
    docs, total = crowded(spark), len(corpus.rows())
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(corpus.rows()) if r[0]], "doc_id long, quality int, toxic int")
    assert unharmed(quality.scored(docs, labels), {"_score"}) == total
    mixed = mixing.mixture(docs.withColumn("amount", mixing.word_count()), "amount")
    added = {"_size", "_source_size", "_target", "_copies"}
    assert unharmed(mixed, added) == total
    assert unharmed(mixing.mixture(mixed, "amount"), added) == total
    unharmed(mixing.emitted(mixed), added)
    assert unharmed(sharding.sharded(docs), {"_size", "_crc32", "_shard", "_grown_shard", "_slot"}) == total
    assert unharmed(lines.deduplicated(docs), {"_n_lines", "_removed", "_kept"}) == total
    assert unharmed(suffixes.without_repeats(docs), {"_n_bytes", "_n_removed", "_n_spans", "_kept"}) == total


def test_operators_that_filter_leave_other_columns_alone(spark):
    docs = crowded(spark)
    bench = spark.createDataFrame([(1, "plain words of a question that is in no document here")], "item_id long, text string")
    assert unharmed(jaccard.keep_first(docs)) > 40
    assert unharmed(decontamination.without_benchmark(docs, bench)) > 40
    assert tokencount.document_counts(docs).count() == len(corpus.rows())
    assert tokenorder.in_training_order(docs, length=128).count() > 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_over_odd_tables(spark, tmp_path, empty):
    """Nulls, repeated rows and clashing columns, then an empty table, through all stages."""
    docs = crowded(spark).limit(0) if empty else crowded(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], i % 3 > 0, 0) for i, r in enumerate(corpus.rows()) if r[0]], "doc_id long, quality boolean, toxic int").select("doc_id", F.col("quality").cast("int"), "toxic").limit(0 if empty else 50).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "plain words of a question that is in no document here"), (2, None)][: 0 if empty else 2], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert bool(rows) != empty
    assert unharmed(out, {"shard", "slot"}) == len(rows)
    slots = Counter(r.shard for r in rows)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in slots.items())


def test_private_names():
    class Table:
        columns = ("a", "A_", "b")

    assert work.private(Table, "a", "B", "c") == ["a__", "B_", "c"]


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, other: other)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        work.folder(Unset)
