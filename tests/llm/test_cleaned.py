"""Cleaned texts are the same on both sides of the broadcast bound."""

from driftline.llm import decontaminate


def test_cleaned_texts_of_a_large_benchmark(odd, documents, benchmark, spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for docs, items in ((odd, benchmark), (documents, items)):
        got, want = (sorted(map(tuple, decontaminate.decontaminate(
            docs, items, with_text=True, max_broadcast_bytes=most).collect()), key=repr)
            for most in (0, 4 << 20))
        assert got == want and any(r[2] for r in want)
