"""The join finds its target share of pairs at the least similarity."""

import math
import random

from planline.llm import jaccard_join


def test_runs_meet_the_target():
    for recall in (0.99, 0.9999):
        runs = jaccard_join.runs_for(recall, 0.8)
        mean = runs * jaccard_join.BRANCH * 0.8
        few = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(jaccard_join.LEAST_MEETINGS))
        assert few < 1 - recall
    assert jaccard_join.runs_for(0.9999, 0.8) > jaccard_join.runs_for(0.9999, 0.8, least=2)


def test_recall_of_pairs_of_unequal_size_at_the_threshold(spark):
    rnd, rows = random.Random(4), []
    for k in range(2000):
        words = [f"w{rnd.randrange(10**9)}" for _ in range(104)]  # 100 shingles, and 80 of these in the shorter text
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:84]))]
    for k in range(300):  # and pairs just below it
        words = [f"v{rnd.randrange(10**9)}" for _ in range(104)]
        rows += [(10_000 + 2 * k, " ".join(words)), (10_001 + 2 * k, " ".join(words[:83]))]
    out = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    by = {r.doc_id: r for r in out.collect()}
    found = sum(by[2 * k].n_links == 1 and by[2 * k + 1].class_id == 2 * k for k in range(2000))
    assert found >= 0.999 * 2000
    assert all(r.n_links == 0 for d, r in by.items() if d >= 10_000)
