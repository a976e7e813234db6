"""What Python workers and batches may hold, so that an executor's memory doesn't grow with the table."""

import numpy as np
import pandas as pd
import public_tokenizers

from flowsieve.llm import shingle_join, token_files
from flowsieve.llm.queries import op4_token_files, op8_shingle_join

ROWS = "doc_id bigint, text string"


def test_token_files_slice_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE_CHARS", 100)
    texts = ["a" * 30, None, "b" * 60, "c" * 250, "", "d" * 5]
    batches = [pd.DataFrame({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts)]
    found = list(token_files._slices(batches))
    assert [names for names, _ in found] == [[0, 1, 2], [3], [4, 5]]
    assert [t for _, some in found for t in some] == [t or "" for t in texts]


def test_token_files_do_not_depend_on_batches_or_slices(spark, tmp_path, monkeypatch):
    rows = [(i, f"document {i} says " + "some words " * (i % 7)) for i in range(60)] + [(60, None), (61, "")]
    path = public_tokenizers.path("byte_bpe_50k.json")

    def made(name):
        token_files.write_files(spark.createDataFrame(rows, ROWS).coalesce(1), str(tmp_path / name), path, 2)
        return sorted(token_files.documents(token_files.read_files(spark, str(tmp_path / name))).collect())

    whole = made("whole")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(token_files, "SLICE_CHARS", 200)
    try:
        assert made("cut") == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_queries_hold_their_batches_of_whole_texts_small(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five"), (2, "six")], ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size"]
    for query in (op4_token_files, op8_shingle_join):
        for name in names:
            spark.conf.unset(name)
        assert query(spark, str(tmp_path)).count() == 2
        assert int(spark.conf.get(names[0])) <= 2000 and int(spark.conf.get(names[1])) <= 512
        assert int(spark.conf.get(names[2])) <= 1 << 24


def test_large_blocks_give_freed_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(shingle_join, "give_back", lambda: given.append(1))
    monkeypatch.setattr(shingle_join, "LARGE_TASK", 50)
    block = lambda n: pd.DataFrame({"rep": [1, 2], "side": [0, 0], "known": [1, 2], "tokens": [np.arange(n), np.arange(n)]})
    assert shingle_join._open_task(85)(block(10)).values.tolist() == [[1, 2]] and not given
    assert shingle_join._open_task(85)(block(40)).values.tolist() == [[1, 2]] and given
