"""Batches are bounded in bytes, and long rows are batches of their own."""

import pyarrow as pa

from lodestone.llm.batches import BYTES, map_in_arrow


def test_batches_of_long_rows_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([sum(len(x.as_py()) for x in b.column(0))])], ["rows", "bytes"])

    df = spark.range(60, numPartitions=1).selectExpr("repeat('x', CASE WHEN id = 30 THEN 6000000 WHEN id < 20 THEN 1000000 ELSE 1000 END) AS text")
    got = [(r.rows, r.bytes) for r in map_in_arrow(df, sizes, "rows long, bytes long").collect()]
    assert sum(n for n, _ in got) == 60 and sum(b for _, b in got) == 20_000_000 + 6_000_000 + 39_000
    assert all(b <= BYTES + 6_000_000 for _, b in got) and len(got) >= 6
