"""What the operators leave on disk while they go on: no shuffle of a finished step, no table that is read no more."""

import os
import random
import time

import pytest

from gaugeframe.llm import _shared, near_copies, simhash, suffix_dedup


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if "shuffle_" in (f := files.apply(i).getName())}


def left(spark, before):
    """Shuffle files that are new and stay; they are removed in the background."""
    for _ in range(50):
        if not (found := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return found


def tables(spark):
    return set(os.listdir(spark.sparkContext._jsc.getCheckpointDir().get().removeprefix("file:")))


@pytest.mark.parametrize("write", [_shared.cut, suffix_dedup.written])
def test_shuffles_go_when_their_result_is_written(spark, write):
    spark.conf.unset(_shared.REMOVE_SHUFFLES)
    held, before = spark.range(1000).repartition(3, "id"), shuffle_files(spark)
    done = write(held)
    assert not left(spark, before) and done.count() == 1000 and held.count() == 1000
    assert spark.conf.get(_shared.REMOVE_SHUFFLES, "false") == "false"


@pytest.mark.parametrize(("most", "reads"), [(suffix_dedup.TREE_MEMBERS, 1), (40, 3)])
def test_suffix_dedup_holds_what_it_still_reads(spark, most, reads):
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = draw(300)
    texts = [draw(rng.randint(0, 300)) + passage + draw(rng.randint(0, 300)) for _ in range(60)] + [draw(500)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _shared.shared_dir(spark)
    had = tables(spark)
    out = suffix_dedup.digest(docs, most)
    # the covered stretches; where a shard was split up, also how far its members reach to either side
    assert len([x for x in tables(spark) - had if x.startswith("rdd-")]) == reads
    assert out.where("n_removed >= 300").count() == 63


def test_near_duplicates_drop_the_sets(spark, monkeypatch):
    made = []
    monkeypatch.setattr(near_copies, "cut", lambda df: made.append(_shared.cut(df)) or made[-1])
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 3}") for i in range(9)], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    path = lambda df: df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    with_sets = [df for df in made if "found" in df.columns]
    assert len(with_sets) == 2 and not any(os.path.exists(path(df)) for df in with_sets)
    assert sorted(r["component_id"] for r in out.collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
