"""Native tokens by Python's own tables, on every code point."""

import re
import sys

from pyspark.sql import functions as F

from sifterra.functions import text

TOKEN = re.compile(r"[^\W_]+(?:[_-][^\W_]+)*")


def test_every_code_point(spark):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = [(i, " ".join(chars[i : i + 400])) for i in range(0, len(chars), 400)] + [(-1 - i, "".join(f"a{c}B_" for c in chars[i : i + 400])) for i in range(0, len(chars), 40_000)]
    df = spark.createDataFrame([*rows, (10**9, None), (10**9 + 1, "")], "i long, t string").repartition(8)
    tokens = df.select("i", "t", text.tokenize(F.col("t"), exact=True).alias("tokens"))
    assert "Python" not in tokens._jdf.queryExecution().executedPlan().toString()
    for r in tokens.collect():
        assert r["tokens"] == (None if r["t"] is None else TOKEN.findall(r["t"].casefold())), r["i"]
