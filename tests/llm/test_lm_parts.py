"""A filter larger than one pass may hold is read in several, and gives the scores of one that is held whole."""

import random

from scholiast.llm import lm_filter


def test_scores_do_not_depend_on_the_bound(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(60))) for i in range(300)] + [(None, None), (400, "")], "doc_id long, text string").repartition(3)

    def scores(**how):
        return sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in lm_filter.score(docs, frequent=50, **how).collect())

    assert len(lm_filter.train(docs, frequent=50, max_filter_bytes=1 << 13)[0]) > 1
    assert scores(max_filter_bytes=1 << 13) == scores()
