"""What the tasks of the text operators hold at once."""
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkclf.llm import gam, ngram_join, pack
from sparkclf.llm.common import BATCH_BYTES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])
    return [r["n"] for r in df.coalesce(1).mapInArrow(run, "n long").collect()]


@pytest.mark.parametrize("operator", [ngram_join.join, pack.pack, lambda d: gam.score(d, gam.Model(0.0))])
def test_long_texts_travel_in_small_batches(spark, operator):
    had = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    try:
        docs = spark.createDataFrame([(i, "word " * 60_000) for i in range(40)], "doc_id long, text string")
        assert operator(docs).count() >= 40
        got = _sizes(docs)
        assert sum(got) == 40 and max(got) <= 2 * BATCH_BYTES // 300_000
        spark.conf.set(KEY, "1g")          # a session's own limit stays
        operator(docs.limit(2)).count()
        assert spark.conf.get(KEY) == "1g" and _sizes(docs) == [40]
    finally:
        spark.conf.unset(KEY) if had is None else spark.conf.set(KEY, had)


def test_tokens_are_counted_over_all_sets():
    rng = np.random.default_rng(3)
    held = ngram_join.Tokens(50)
    for _ in range(2):                     # the array starts anew, and grows where a slice brings more
        sets = [np.unique(rng.integers(0, 300, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
        for t in sets:
            held.add(t)
        assert held.n == sum(map(len, sets))
        want = {k: v for k, v in Counter(int(x) for t in sets for x in t).items() if v > 1}
        tokens, counts = held.repeated()
        assert dict(zip(tokens.tolist(), counts.tolist())) == want and held.n == 0
