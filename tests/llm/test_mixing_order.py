from quillstone.llm import mixing


def test_documents_lie_in_the_order_of_the_schedule(spark):
    """Input by source: rows come out by block and position, sources mixed and no two uses of a document side by side."""
    rows = sorted(((k, "w " * (k % 11 + 1), "big" if k % 10 else "small") for k in range(3000)), key=lambda r: r[2])
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.mixing_schedule(d, max_repeats=1.5, block_tokens=2_000).orderBy("block", "position").collect()
    mixed = mixing.mix_documents(d, max_repeats=1.5, block_tokens=2_000)
    ids = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == d.columns and len({r.block for r in planned}) > 5 and max(r.copy for r in planned) == 1
    assert ids == [r.doc_id for r in planned] and all(a != b for a, b in zip(ids, ids[1:]))
