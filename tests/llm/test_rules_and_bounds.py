"""Many shapes of rules, and labelled ids that repeat."""

import random
import time

import pytest

pytest.importorskip("runloom.llm")
from runloom.llm import toxicity as X  # noqa: E402
from runloom.llm.url_filters import url_filters  # noqa: E402


def test_many_shapes_of_rules(spark):
    rng = random.Random(3)
    rules = [(".".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), "/" + "".join(rng.choice("xy") for _ in range(k)), rng.choice(["allow", "block"])) for k in range(400) for _ in range(4)]
    urls = [(i, f"http://{'.'.join(rng.choice('abc') for _ in range(rng.randint(1, 12)))}/{''.join(rng.choice('xy') for _ in range(rng.randint(0, 40)))}") for i in range(200)]
    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters(spark.createDataFrame(urls, "page_id int, url string"), spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert time.perf_counter() - began < 60
    best = {}
    for h, p, a in rules:
        best[h, p] = max(a, best.get((h, p), a))
    for i, url in urls:
        host, path = url[7:].split("/", 1)
        fits = [(len(h + p), h + p, a) for (h, p), a in best.items() if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == (max(fits)[1:] if fits else (None, "allow"))


def test_repeated_labelled_ids_are_one_row_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(X, "FIT_ROWS", 40)
    seen = []
    mine = X.mine_lexicon
    monkeypatch.setattr(X, "mine_lexicon", lambda sample: seen.append(sample.count()) or mine(sample))
    docs = spark.createDataFrame([(i % 60, f"some words {i % 7} of a text {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    X.fit(docs, labels)
    assert seen and seen[0] <= 40
