import random

import numpy as np
import pytest

from marlstone.llm import neardup, pairing, spans

WORDS = [f"w{i}" for i in range(400)]


def brute(texts, run, threshold, least):
    sets = {}
    for i, t in texts.items():
        w = neardup.WORD.findall((t or "").lower())
        if len(w) >= max(least, run):
            sets[i] = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(rng, n, sizes):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = list(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = [rng.choice(WORDS)] if rng.random() < 0.7 else []
            if rng.random() < 0.3:
                w = w[: rng.randint(len(w) // 2, len(w))]
        else:
            w = rng.choices(WORDS, k=rng.choice(sizes))
        out.append(w)
    return {i: " ".join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize(("run", "threshold", "sizes"), [(3, 0.5, [20, 30, 70, 150]), (5, 0.8, [20, 65, 300]), (3, 0.5, [250, 260, 900])])
def test_pairs_equal_brute_force(spark, run, threshold, sizes):
    texts = corpus(random.Random(run * 7 + len(sizes)), 220, sizes)
    texts |= {1000: None, 1001: "", 1002: "too short", 1003: texts[0].upper(), 1004: texts[0]}
    df = spark.createDataFrame([("t", i, t, 1) for i, t in texts.items()] + [("t", 0, texts[0], 1), ("u", 0, texts[0], 1), ("t", None, texts[0], 1)], "tbl string, id bigint, text string, seq int")
    got = {(r.id_1, r.id_2) for r in neardup.similar_pairs(df, run=run, threshold=threshold).where("tbl = 't'").collect()}
    assert got == brute(texts, run, threshold, 20)


def test_hot_copies_and_groups(spark):
    rng = random.Random(4)
    base = " ".join(rng.choices(WORDS, k=60))
    edit, further = base + " x1 x2", base + " x1 x2 x3 x4 x5 x6"
    texts = {**{i: base for i in range(60)}, 100: edit, 101: further, 102: " ".join(rng.choices(WORDS, k=60))}
    df = spark.createDataFrame([("t", i, t) for i, t in texts.items()], "tbl string, id bigint, text string")
    rows = {r.id: r for r in neardup.groups(df, run=5, threshold=0.8).collect()}
    assert len(rows) == 63 and {rows[i].class_id for i in range(60)} == {0}
    assert rows[101].group_id == rows[100].group_id == rows[5].group_id == 0 and rows[102].group_id == 102 and rows[102].links == 0
    assert neardup.similar_pairs(df.limit(0)).count() == 0 and neardup.groups(df.limit(0)).count() == 0


def test_sets_without_enough_units_go_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LOAD", 30.0)  # so few segments that most sets lack units
    monkeypatch.setattr(neardup, "BLOCK_SETS", 20)
    monkeypatch.setattr(neardup, "BUCKET_BYTES", 500)
    texts = corpus(random.Random(9), 60, [30, 60])
    df = spark.createDataFrame([("t", i, t) for i, t in texts.items()], "tbl string, id bigint, text string")
    got = {(r.id_1, r.id_2) for r in neardup.similar_pairs(df, run=3, threshold=0.5).collect()}
    assert got == brute(texts, 3, 0.5, 20)


def test_signatures_take_no_more_room_where_there_are_more_partitions(spark, monkeypatch):
    rng, found, sizes = random.Random(5), neardup._candidates, []

    def measured(signatures, *rest):
        sizes.append(sum(len(r.pack) for r in signatures.select("pack").collect()))
        return found(signatures, *rest)

    monkeypatch.setattr(neardup, "_candidates", measured)
    df = spark.createDataFrame([("t", i, " ".join(rng.choices(WORDS, k=100))) for i in range(1000)], "tbl string, id bigint, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            neardup.similar_sets(df, run=3, threshold=0.5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sizes[1] < 1.2 * sizes[0]


def test_slots_and_sketches_on_file(spark, monkeypatch):
    texts = corpus(random.Random(12), 150, [20, 60, 250, 900])
    df = spark.createDataFrame([("t", i, t) for i, t in texts.items()], "tbl string, id bigint, text string")
    sets = neardup._sets(df, 3, 20).where("kind = 1").cache()
    monkeypatch.setattr(neardup, "BUCKET_BYTES", 40_000)
    monkeypatch.setattr(neardup, "SLOT_BYTES", 3_000)
    allotted, buckets, slots, total = neardup._allotted(sets)
    assert slots > 3 and buckets > 3
    t = neardup.Fraction("0.5")
    rows = neardup._signatures(sets, neardup._costs(sets, total), t, allotted, slots).where("bucket >= 0").collect()

    def meetings():
        out = []
        for k in sorted({r.bucket for r in rows}):
            told = neardup.Told([r.pack for r in rows if r.bucket == k and r.slot == -1], t)
            for j in sorted({r.slot for r in rows if r.bucket == k and r.slot >= 0}):
                for part in neardup.meet(told, [r.pack for r in rows if r.bucket == k and r.slot == j], t):
                    out += zip(*(x.tolist() for x in part))
        return sorted(out)

    held = meetings()
    monkeypatch.setattr(neardup, "HELD_BYTES", 1)
    assert held and meetings() == held
    got = {(r.id_1, r.id_2) for r in neardup.similar_pairs(df, run=3, threshold=0.5).collect()}
    assert got == brute(texts, 3, 0.5, 20)


def test_sketches_never_tell_more_than_sets_differ():
    rng = np.random.default_rng(3)
    size = np.array([1, 16, 33, 64, 70, 300, 1500])
    runs = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in size]
    size = np.array([len(x) for x in runs])
    words, width, first = neardup.sketches(np.concatenate(runs), np.repeat(np.arange(len(size)), size), size)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(size)), np.arange(len(size))))
    least = neardup.apart(words, first[x], first[y], width[x], width[y])
    assert (least <= [len(np.setxor1d(runs[i], runs[j])) for i, j in zip(x, y)]).all() and (least[x == y] == 0).all() and least.max() > 100


def test_pairs_within_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(pairing, "PART", 7)
    rows = [("a", 1, i) for i in range(30)] + [("a", 2, 1), ("b", 1, 5), ("b", 1, 6)]
    df = spark.createDataFrame(rows, "t string, g int, id int")
    got = sorted(map(tuple, pairing.pairs_within(df, ["t", "g"], "id", "one", "two").collect()))
    assert got == sorted([("a", 1, i, j) for i in range(30) for j in range(i + 1, 30)] + [("b", 1, 5, 6)])


def shared(texts):
    ids = sorted(texts)
    grams = {i: {texts[i][k : k + 200] for k in range(len(texts[i] or "") - 199)} for i in ids if texts[i]}
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if a in grams and b in grams and grams[a] & grams[b]}


def passages(rng, n):
    letters = "abcdefgh \né中"
    pieces = ["".join(rng.choices(letters, k=rng.randint(120, 320))) for _ in range(12)]
    return {i: "".join(rng.choice([rng.choice(pieces), rng.choice(pieces)[rng.randint(0, 60) :], "".join(rng.choices(letters, k=rng.randint(5, 150)))]) for _ in range(rng.randint(1, 7))) for i in range(n)}


@pytest.mark.parametrize("hot", [5000, 3])
def test_spans_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    texts = passages(random.Random(11), 90)
    texts |= {900: None, 901: "", 902: "=" * 900, 903: "x" + "=" * 230, 904: "=" * 199, 905: texts[3], 906: "é" * 250 + "a"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, tid int")
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == shared(texts)
    part = {r.doc_id: r for r in spans.shared_part(df).collect()}
    for i, t in texts.items():
        if t is None:
            assert i not in part
            continue
        marked = [False] * len(t)
        others = set()
        for j, u in texts.items():
            if j != i and u:
                others |= {u[k : k + 200] for k in range(len(u) - 199)}
        for k in range(len(t) - 199):
            if t[k : k + 200] in others:
                marked[k : k + 200] = [True] * 200
        assert part[i].shared_chars == sum(marked), i
    assert spans.shared_pairs(df.limit(0)).count() == 0


def test_many_blocks_of_one_anchor(spark):
    rng = random.Random(2)
    core = "".join(rng.choices("abcdefgh ", k=130))
    texts = {i: "".join(rng.choices("abc", k=90)) + core + "".join(rng.choices("xyz", k=90)) for i in range(40)}
    texts |= {100 + i: texts[i][40:] + "q" * i for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == shared(texts)
