"""How the near-duplicate stage gets its links: tries of fingerprints first, then buckets whose pairs stay in one worker."""

import random

import numpy as np
import pytest

from gaugeframe.llm import near_copies, simhash


def test_tries_link_by_themselves_and_the_sets_decide(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "bands", lambda found: np.zeros(0, np.int64))
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(3000)]
    copies = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (5, 700, 1900)]
    # the repeated phrase decides the fingerprint, but not the set
    phrase = ["p q r s t " * 200 + " ".join(f"{x}{k}" for k in range(10)) for x in "ab"]
    texts = [" ".join(base), *copies, *phrase]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    assert any((fps[0] ^ f).bit_count() <= 3 for f in fps[1:4]) and (fps[4] ^ fps[5]).bit_count() <= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got[4] == 4 and got[5] == 5
    for i in range(4):
        for j in range(i):
            assert got[i] == got[j] or (fps[i] ^ fps[j]).bit_count() > 3
    assert sum(got[i] != i for i in range(4)) > 0


@pytest.mark.parametrize("joined", [0, 40])
def test_links_of_a_bucket_join_what_all_its_pairs_join(joined):
    rng = np.random.default_rng(joined)
    base = rng.choice(1 << 30, 100, replace=False).astype(np.uint32)
    sets = []
    for k in range(150):  # texts of one group that agree in part, at 0.8 or more only now and then
        x = base.copy()
        at = rng.choice(100, rng.integers(0, 22), replace=False)
        x[at] = rng.integers(1 << 31, 1 << 32, len(at), dtype=np.uint32)
        sets.append(np.unique(x))
    root = np.arange(150)
    root[:joined] = 0
    near = [(i, j) for i in range(150) for j in range(i) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j])) and (joined == 0 or root[i] != 0 or root[j] != 0)]
    found = near_copies.bucket_links(sets, root, 0 if joined else -1, 0.8)
    assert all((i, j) in near or (j, i) in near for i, j in found) and len(found) < 150
    names = lambda pairs: simhash._roots(150, np.array([a for a, _ in pairs] + list(range(150))), np.concatenate([[b for _, b in pairs], root]).astype(int)).tolist()
    assert names(found) == names(near)
