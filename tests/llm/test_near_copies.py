"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from gaugeframe.llm import near_copies, simhash


def brute_shingles(t, k=5):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stage_keeps_one_of_each_group_of_similar_texts(spark):
    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randint(0, 9999)}" for _ in range(n)]
    texts = ["", "one word", " One  WORD "]
    passage = draw(150)
    for changes in (1, 2, 3, 4, 5, 6, 8, 10):
        for _ in range(4):
            base = draw(200)
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = "other"
            texts += [" ".join(base), " ".join(copy), " ".join(passage + draw(150))]
    base = draw(300)
    for k in range(60):  # a large group, and a chain whose ends aren't similar
        texts.append(" ".join(base[:5 * k % 300] + [f"x{k}"] + base[5 * k % 300 :]))
        texts.append(" ".join(passage[: 150 - 2 * k]))
    sets = [brute_shingles(t) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    group = list(range(len(texts)))
    while any(group[j] < group[i] for i, j in near):
        for i, j in near:
            group[i] = min(group[i], group[j])
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == dict(enumerate(group))
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group))


def test_pairs_beyond_the_first_bands_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FIRST_BANDS", 0)
    test_stage_keeps_one_of_each_group_of_similar_texts(spark)
