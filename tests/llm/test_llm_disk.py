"""What the near-duplicate operator sends and leaves on disk, and the exact comparison over blocks."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from spanforge.llm import jaccard
from spanforge.llm.common import written


def _sent(spark) -> int:
    """Bytes of shuffle that this application has written."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def _words(rnd: random.Random, n: int) -> list[str]:
    return ["%010x" % rnd.getrandbits(40) for _ in range(n)]


def test_only_candidates_texts_are_sent(spark):
    rnd = random.Random(1)
    texts = [_words(rnd, 2000) for _ in range(400)]
    texts += [[*texts[0][:-1], "other"], ["other", *texts[1][1:]]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).cache()
    size = sum(len(" ".join(t)) for t in texts)
    docs.count()
    before = _sent(spark)
    got = {r.doc_id: r.class_id for r in jaccard.near_duplicates(docs).collect() if r.n_links}
    assert got == {0: 0, 400: 0, 1: 1, 401: 1}
    assert _sent(spark) - before < size / 4


def test_shuffle_files_go_with_the_write(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left() -> set[str]:
        files = manager.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {name for name in names if name.startswith("shuffle_")}

    before = left()
    docs = written(spark.range(1000).repartition(3, "id"), "rows")
    ends = time.time() + 5
    while left() - before and time.time() < ends:
        time.sleep(0.1)
    assert not left() - before and docs.count() == 1000


@pytest.mark.parametrize("seed", range(4))
def test_shared_tokens_are_counted_by_both_ways(seed):
    rng = np.random.default_rng(seed)
    common = np.arange(50, dtype=np.uint64)
    make = lambda: np.unique(np.concatenate([common[rng.random(50) < 0.8], rng.integers(50, 900, rng.integers(0, 80)).astype(np.uint64)]))
    left, right = ([make() for _ in range(n)] for n in (37, 23))
    assert (jaccard.shared_tokens(left, right) == [[len(np.intersect1d(x, y)) for y in right] for x in left]).all()
    assert (jaccard.shared_tokens(left, left) == [[len(np.intersect1d(x, y)) for y in left] for x in left]).all()


def test_links_over_blocks_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SET_BLOCK", 4 * jaccard.LEAST)  # four sets a block
    monkeypatch.setattr(jaccard, "MARK_BLOCK", 8)
    rnd = random.Random(2)
    base = _words(rnd, 120)
    texts = []
    for _ in range(90):
        words = base[:]
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = "%x" % rnd.getrandbits(20)
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [[i != j and len(x & y) >= 0.8 * len(x | y) - 1e-9 for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    got = {r.doc_id: r.n_text_links for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small=4).collect()}
    assert got == {i: sum(row) for i, row in enumerate(links)} and 0 < sum(got.values()) < len(texts) * (len(texts) - 1)


def test_one_per_class_writes_no_copy_of_the_table(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, " ".join(_words(rnd, 50)), "a") for i in range(40)]
    rows += [rows[0], (0, rows[0][1], "A"), (None, rows[1][1], "c"), (None, "alone in its class", "d"), (None, "alone in its class", "d")]
    tables = []
    monkeypatch.setattr(jaccard, "written", lambda df, name: tables.append(df.columns) or written(df, name))
    got = jaccard.one_per_class(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = [(0, rows[0][1], "A"), *rows[1:40], (None, "alone in its class", "d")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tables and not any("text" in columns for columns in tables)
