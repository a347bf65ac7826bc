"""Tables whose files are much smaller than their rows don't go through the driver."""

import public_tokenizers
from pyspark.sql import functions as F

from cartolith.llm import tokencount


def test_token_counts_broadcast_nothing(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), (F.col("id") % 7).cast("int")).alias("text"))
    counted = tokencount.report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, eod=50256)
    assert "Broadcast" not in counted._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.n_tokens for r in counted.collect()}
    assert len(got) == 5000 and {got[i] == got[i % 7] for i in range(5000)} == {True} and got[0] == 0 < got[1] < got[2]
    assert "Broadcast" not in counted._jdf.queryExecution().executedPlan().toString()
