import random

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import packing, tokens
from marlstone.llm.tokens import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_public_library(spark):
    rng = random.Random(5)
    signs = [*" \n\t'sdtmreve llaé中　!?.0٣", "'s", "'re", " '", "<|endoftext|>", "🙂", "́", "=="]
    texts = [None, "", " ", "\n\n", "'", "a'", "x 'll", "a" * 3000, "=-" * 700, "abc" * 500 + " z", *("".join(rng.choices(signs, k=rng.randint(0, 50))) for _ in range(3000))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)
    sizes = {r.doc_id: r.tokens for r in tokens.count(df, "doc_id", "text").collect()}
    assert all(sizes[i] == len(got[i]) for i in got)


def test_rounds_and_heap_agree():
    v = tokens.vocabulary(PATH)
    rng = np.random.default_rng(1)
    for _ in range(60):
        word = rng.choice(np.frombuffer(b"aabcethe in=-", np.uint8), rng.integers(1, 200))
        ids, _ = v.words(word, np.array([0, len(word)]))
        assert ids.tolist() == v._long(word).tolist()


def test_empty_batch():
    ids, offsets = tokens.encode_texts(pa.array([], pa.string()), PATH)
    assert len(ids) == 0 and offsets.tolist() == [0]


def test_plan_places_every_item_within_capacity():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.randint(3, 60)
        counts = {n: rng.choice([1, 2, 50]) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        used, seen = {}, {}
        for length, rank, n, first, per in packing.plan(counts, capacity):
            for k in range(n):
                assert rank + k not in seen.setdefault(length, set())
                seen[length].add(rank + k)
                used[first + k // per] = used.get(first + k // per, 0) + length
        assert {x: set(range(n)) for x, n in counts.items()} == seen
        assert max(used.values()) <= capacity and set(used) == set(range(len(used)))
        least = max(-(-sum(x * n for x, n in counts.items()) // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))
        assert len(used) <= 1.25 * least + 1


def test_containers(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([0, 5, 5, 10, 11, 25, 3, *[4] * 300])] + [(1, 5)], "doc_id bigint, tokens bigint")
    caps = spark.createDataFrame([(1, "a", 10), (2, "b", 100), (3, "c", None)], "capacity_id int, purpose string, capacity_tokens int")
    rows = packing.containers(sizes, caps).collect()
    total = sum([0, 5, 5, 10, 11, 25, 3, *[4] * 300, 5])
    for cid, cap in ((1, 10), (2, 100)):
        mine = [r for r in rows if r.capacity_id == cid]
        fill = {}
        for r in mine:
            if r.container is not None:
                fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert sum(r.tokens for r in mine) == total and max(fill.values()) <= cap
        assert [(r.piece, r.tokens, r.container) for r in mine if r.doc_id == 0] == [(0, 0, None)]
        assert all(r.tokens <= cap for r in mine)
        assert sorted(r.tokens for r in mine if r.doc_id == 5) == ([5, 10, 10] if cap == 10 else [25])
    assert {r.capacity_id for r in rows} == {1, 2}
    assert packing.containers(sizes.limit(0), caps).count() == 0


def test_queries(spark, data):
    from marlstone.llm import queries

    fill = queries.p9_fill(spark, data).collect()
    assert len(fill) == 4 and all(r.containers <= 1.02 * r.least_containers + 1 for r in fill)
    assert queries.p8_ids(spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
