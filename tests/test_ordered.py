from pyspark.sql import functions as F

from runsift.operators import ordered


def test_chunked_results_equal_one_window(spark):
    """A tiny chunk size forces every group over many chunks, with gaps between them."""
    rows = [(k, i * 3, (i * 7 + k) % 5) for k in range(3) for i in range(40 if k else 200)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    out = ordered.running_sum(df, ["k"], "o", F.col("v"), "s", chunk=8)
    out = ordered.ordinal(out, ["k"], "o", "n", chunk=8)
    out = ordered.carry_forward(out, ["k"], "o", F.when(F.col("v") == 4, F.col("o")), "c", chunk=8)
    got = {(r.k, r.o): (r.s, r.n, r.c) for r in out.collect()}
    want = {}
    for k in range(3):
        s, c = 0, None
        for n, (_, o, v) in enumerate(r for r in rows if r[0] == k):
            s, c = s + v, o if v == 4 else c
            want[(k, o)] = (s, n + 1, c)
    assert got == want
