"""Words of fewer letters than a stem."""

from __future__ import annotations

import pyarrow as pa

from runloom.llm.toxicity import Lexicon, features, mine_lexicon


def test_short_words_enter_the_lexicon_and_vote(spark):
    rows = [(f"you zog {i} 坏蛋 there", 1) for i in range(10)] + [(f"you are fine {i} 好人 there", 0) for i in range(200)]
    tokens = mine_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"zog", "坏蛋"} <= set(tokens) and not {"you", "好人"} & set(tokens)
    counts = [c for _, c in features(pa.array(["a zog", "zogs", "坏蛋 zog", "you", "zo g"]), Lexicon(["zog", "坏蛋"]))]
    assert [int(x[0]) for c in counts for x in c] == [1, 0, 2, 0, 0]
