from test_decontaminate import ITEMS, expected

from voxelry.llm import decontaminate as D


def test_blocks_keep_every_row(spark):
    """Repeated rows, texts that share an id and rows without one stay rows of their own."""
    rows = [(1, "one two three"), (1, "one two three"), (2, "posted in this forum"), (2, "nothing at all of it"), (None, "one two"), (None, "posted in this forum today"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    order = lambda got: sorted(map(tuple, got), key=str)
    want = sorted(((d, *x[1:]) for d, t in rows for x in expected([(0, t)], ITEMS, 4)), key=str)
    index = D.build_index(docs)
    for block_bytes in (40, D.BLOCK_BYTES):
        assert order(D.search(index, bench, window=4, block_bytes=block_bytes).drop("n_near_items").collect()) == want
