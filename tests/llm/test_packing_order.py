"""Packing follows the order in which its input was written."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_sequences_follow_the_order_of_the_files(spark, tmp_path):
    words = lambda i: " ".join(["word"] * (5 if i % 3 else 3000))
    docs = spark.createDataFrame([(i, words(i)) for i in range(60)], "doc_id long, text string").cache()
    seen = []
    for name, order in (("up", F.col("doc_id")), ("down", -F.col("doc_id"))):
        docs.repartitionByRange(3, order).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{name}")
        rows = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").collect()
        assert sorted({r.doc_id for r in rows}) == list(range(60)) and "__place" not in rows[0]
        place = (lambda i: i) if name == "up" else (lambda i: -i)
        first = {}
        for r in rows:
            first[r.sequence_id] = min(first.get(r.sequence_id, (99, 0)), (place(r.doc_id), r.piece))
        assert sorted(first) == list(range(len(first))) and [first[k] for k in sorted(first)] == sorted(first.values())
        # pieces of one length: in order, so that an earlier one never lies in a later sequence
        large = sorted((place(r.doc_id), r.sequence_id) for r in rows if r.length > 2048)
        assert [k for _, k in large] == sorted(k for _, k in large)
        seen.append({(r.doc_id, r.sequence_id, r.offset) for r in rows})
    assert seen[0] != seen[1]
