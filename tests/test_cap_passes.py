"""Caps pass their input twice, and keep their rules for equal and missing draws."""

from pyspark.sql import functions as F

from flowsieve.operators import corpus, selection


def test_capped_and_split_rows_pass_the_input_twice(spark):
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    plain = spark.range(3000, numPartitions=3).select(
        F.col("id").alias("row_id"), selection.draw(1, "id").alias("draw"), F.format_string("f%d", F.col("id") % 2).alias("source_file"),
        F.when(F.col("id") % 3 == 0, "ANOMALY").otherwise("BENIGN").alias("label"))
    capped = corpus.capped(plain.mapInPandas(counted, plain.schema), 400)
    split = selection.stratified_split(capped, "label")
    assert split.count() == 1600 and passed.value == 6000
    lowest = plain.orderBy("draw", "row_id").collect()
    for file, label in [(f, c) for f in ("f0", "f1") for c in ("ANOMALY", "BENIGN")]:
        found = {r["row_id"] for r in capped.filter((F.col("source_file") == file) & (F.col("label") == label)).collect()}
        assert found == {r["row_id"] for r in [r for r in lowest if r["source_file"] == file and r["label"] == label][:400]}


def test_cap_with_equal_and_missing_draws(spark):
    rows = spark.createDataFrame([("a", i, 5) for i in range(30)] + [("b", i, None if i < 2 else i * 10**7) for i in range(30)]
                                 + [("c", i, None) for i in range(30)], "g string, row_id bigint, draw bigint")
    found = {}
    for r in selection.cap_per_group(rows, ["g"], 10).collect():
        found.setdefault(r["g"], set()).add(r["row_id"])
    # rows without a draw come first in the count and are left out; where only they are within the cap, the group is whole
    assert found == {"a": set(range(10)), "b": set(range(2, 10)), "c": set(range(30))}
