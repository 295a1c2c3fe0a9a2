import random

import duckdb
import pyarrow as pa
import pytest

from marlstone.llm import canonical, language, oracle, quality, queries, truncation
from marlstone.session import table

PROSE = "The board of Acme met on Monday, and it raised the dividend by 3.5 percent. Shares of the firm rose after the news! Did they hold? They did."


KNOWN = frozenset("the of and to in a is that for it as was with be by on not at are this but from or have an they which its were their has after while since near over about within during late worth below past because despite before through".split())

POSTS = frozenset({"social_post"})


def recs(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "tbl string, id bigint, text string, look int")


def test_one_spelling_per_look():
    texts = ["Ｎｅｔ ①", "strongеr", "café café", "a​b­c", "a b c", "ﬁrm K", "\U0001f468‍\U0001f4bb", "É e", None, "", "x" * 100_000]
    want = ["Net ①", "stronger", "café café", "abc", "a b c", "firm K", "\U0001f468‍\U0001f4bb", "É e", None, "", "x" * 100_000]
    assert canonical.canonical_array(pa.array(texts)).to_pylist() == want


def test_same_look_pairs(spark):
    rows = [("d", 1, "ab c"), ("d", 2, "ab c"), ("d", 3, "ab c"), ("e", 4, "ab c"), ("d", 5, "ab  c"), ("d", 6, None), ("d", 7, "AB c"), ("d", 8, ""), ("d", 2, "ab c"), ("d", None, "ａb c")]
    got = {tuple(r) for r in canonical.same_look_pairs(recs(spark, rows)).collect()}
    assert got == {("d", 1, 2), ("d", 2, 3)}
    assert canonical.same_look_pairs(recs(spark, rows[:0])).count() == 0


def test_spelling_groups(spark):
    rows = [("d", 1, "ab c"), ("d", 2, "ab\u00a0c"), ("d", 3, "ab c"), ("e", 4, "ab c"), ("d", 5, "x"), ("d", 6, None), ("d", 7, None), ("d", 8, "")]
    got = {(r.tbl, r.id): (r.canonical, r.spellings, r.rows) for r in canonical.spelling_groups(recs(spark, rows)).collect()}
    assert got == {("d", 1): ("ab c", 2, 3), ("d", 2): ("ab c", 2, 3), ("d", 3): ("ab c", 2, 3), ("e", 4): ("ab c", 1, 1), ("d", 5): ("x", 1, 1), ("d", 6): (None, 1, 1), ("d", 7): (None, 1, 1), ("d", 8): ("", 1, 1)}
    assert canonical.spelling_groups(recs(spark, rows[:0])).count() == 0


def test_canonical_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "ｘ", "old")], "id int, text string, canonical string")
    r = canonical.canonical(df, "text").first()
    assert (r.id, r.text, r.canonical) == (1, "ｘ", "x")
    assert canonical.canonical(df, "text", "text").first().text == "x"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "social_post", "news_item", "common_word"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(oracle.oracle_sql()[name])
    got = queries.queries()[name](spark, data).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


ODD = [
    PROSE, "a" * 9000, "\n\n", "x. \n y.\n", "word " * 2000, "。" * 5, "Wait... what?\" he said.) No", "$ABC +1.5% http://x.y/" + "z" * 3000 + " 🙂 #tag", "wwww.a.b Www.c.d 3.5bn İstanbul ǅ ⅣX ½ '’' -- (a) #", "中文句子没有空格" * 700,
    "and the prices, rose with no end to be seen " * 200, "x.  ", "a\x1cb\x85c\u2028d", "周五，董事会上涨。」 尽管预期不及预期！x。. y", " . , \n;", "HTTPS://A.b/c?d=1#e $1.5 +3 -2,4k 5th_ @me,you",
]


def test_partials_join_in_any_order(spark, data):
    rng = random.Random(1)
    texts = [r.text for r in table(spark, data, "documents").where("length(trim(text)) > 0").limit(12).collect()]
    for t in texts + ODD:
        whole = quality.whole_text(t, KNOWN)
        for n in (1, 64, 1000) if len(t) < 200 else (7, 64, 1000):
            parts = [quality.partial(t[i : i + n], KNOWN) for i in range(0, len(t), n)]
            while len(parts) > 1:
                i = rng.randrange(len(parts) - 1)
                parts[i : i + 2] = [quality.join(parts[i], parts[i + 1], KNOWN)]
            assert quality.close(parts[0], KNOWN) == whole, (t[:80], n)


def test_counts_on_code_points_are_those_of_single_units(spark, data):
    texts = [r.text for n in ("documents", "social_post") for r in table(spark, data, n).where("text is not null").collect()] + ODD
    counts = quality.Pieces(texts, KNOWN).finished()
    for i, t in enumerate(texts):
        got = {k: int(v[i]) for k, v in counts.items()}
        c = quality.Counts(KNOWN)
        for u in quality.units(t):
            c.add(u)
        want = c.n | {"n_words": len(t.split()), "bare_letters": len(quality.LETTER.findall(quality.BARE.sub(" ", t)))}
        lines = {k: got[k] for k in want if k not in ("n_lines", "n_closed_lines")}
        assert lines == {k: want[k] for k in lines}, t[:80]


def test_statistics_don_t_depend_on_chunks(spark):
    rows = [("d", 1, PROSE * 30), ("d", 2, "a;b;1\n" * 400), ("d", 3, None), ("d", 4, " "), ("d", 5, "$ABC +1.5% http://x.y 🙂"), ("d", 5, "$ABC +1.5% http://x.y 🙂"), ("d", 6, "y" * 20_000), ("d", 7, "#tag http://x.y/z 3.5% " * 400), ("d", 8, "cafe\u0301 " * 90), ("d", 9, "")]
    r = recs(spark, rows)
    one, many, some = (sorted(map(tuple, quality.text_statistics(r, ["tbl", "id"], KNOWN, chunk=c).collect())) for c in (1 << 15, 37, 500))
    assert one == many == some and len(one) == 7
    got = {x.id: (x.is_prose, x.is_bare) for x in quality.text_statistics(r, ["tbl", "id"], KNOWN).collect()}
    assert got == {1: (True, False), 2: (False, False), 5: (False, True), 6: (False, False), 7: (False, True), 8: (False, False)}
    assert quality.text_statistics(r.limit(0), ["tbl", "id"], KNOWN).count() == 0


def test_common_words_come_from_a_table(spark):
    words = spark.createDataFrame([("en", " The"), ("en", None), ("de", "der"), ("de", "der")], "lang string, word string")
    assert quality.common_words(words) == {"the", "der"} and quality.common_words(words.limit(0)) == frozenset()


def test_prose_and_lists():
    share = lambda t: (p := quality.whole_text(t, KNOWN))["sentence_chars"] / p["n_chars"]
    assert share(PROSE) > 0.8 and share("\n".join(f"- {s}" for s in PROSE.split(". "))) > 0.6
    assert share("costs, prices, orders, yields, loans, margins, rates") == 0
    assert share("周五晚间，董事会上涨7.8%，尽管预期不及预期。锐岸物流股价公布创纪录成本。") > 0.9


def test_cut_texts(spark):
    many = " ".join(["The quarterly dividend and the inventories of the company remained steady and reluctantly unchanged."] * 3)
    rows = [
        ("documents", 1, many + " The board raised the divid"), ("documents", 2, many), ("documents", 3, many + " The board raised [+120 chars]"), ("documents", 4, many + " [+120 chars]"), ("documents", 5, many + "\nTime will tell..."), ("documents", 6, many + " https://x.y/z"),
        ("documents", 7, many + " — Night desk"), ("documents", 8, None), ("documents", 9, "a | b | c\n1 | 2 | 3"), ("documents", 10, many + " The board of ste..."), ("news_item", 11, many + " The inventories rem &am"), ("news_item", 12, many + " $ABC $XYZ"),
        ("social_post", 20, "so the inventories reluctan"), ("social_post", 21, "so the inventories remained steady"), ("social_post", 22, "the quarterly divid…"), ("social_post", 23, "lol"), ("social_post", 24, "remained steady #inven"), ("social_post", 25, ""),
    ]
    got = {r.id for r in truncation.truncated(recs(spark, rows), KNOWN, POSTS).where("cut").collect()}
    assert got == {1, 3, 10, 11, 20, 22}
    assert truncation.truncated(recs(spark, rows[:0]), KNOWN, POSTS).count() == 0


def test_a_fragment_met_elsewhere_is_still_cut(spark):
    many = "The inventories reluctantly stayed low and went lower. " * 250
    marks = ["Read more", "[+66 chars]", "[more]", "</p>", "&am", "https://t.example/abc"]
    rows = [("documents", 1, many), ("documents", 2, many.replace("inventories", "invent ories", 1)), *[("news_item", 10 + i, PROSE + f" It rose reluctan {m}") for i, m in enumerate(marks)]]
    rows += [("social_post", 20, "so they stayed reluctan"), ("social_post", 21, "see the invent"), ("social_post", 22, "it went low"), ("social_post", 23, "so they stayed reluctantly")]
    assert {r.id for r in truncation.truncated(recs(spark, rows), KNOWN, POSTS).where("cut and tbl = 'social_post'").collect()} == {20, 21}


def test_verdicts_are_alike_at_every_size(spark):
    letters = "abcdefghijklmnopqrst"
    posts = ["the margins widened again " + "x" * n + " ok!" for n in range(60) for _ in range(2)]
    posts += [("they say " + c * 3 + " " + "y" * 26 + " zq" + c * 5)[:45] for c in letters]  # fragments at a limit of 45
    posts += ["they were " + "u" * n + " hmm" for n in range(70, 90)]  # a word that only ends posts, at no limit
    posts += ["a solitary word", "such wizar", *["the wizards came!"] * 5]
    one = [("social_post", i, t) for i, t in enumerate(posts)]
    several = [("social_post", i + k * 1000, t) for k in range(6) for i, t in enumerate(posts)]
    at = lambda rows: {r.id for r in truncation.truncated(recs(spark, rows), KNOWN, POSTS).where("cut").collect()}
    few = at(one)
    assert few >= set(range(120, 140)) and posts.index("such wizar") in few and posts.index("a solitary word") not in few and not few & set(range(140, 160))
    assert at(several) == {i + k * 1000 for k in range(6) for i in few}


def test_rates(spark):
    marked = spark.createDataFrame([("d", 1, True), ("d", 2, False), ("d", 2, False), ("d", 3, True)], "tbl string, id bigint, cut boolean")
    src = spark.createDataFrame([("d", 1, "A "), ("d", 2, "a"), ("d", 3, None)], "tbl string, id bigint, source string")
    assert {(r.source, r.records, r.truncated_count) for r in truncation.truncation_rates(marked, src).collect()} == {("a", 2, 1), ("", 1, 1)}


def test_languages(spark, data):
    sample = [(r.lang, r.text) for r in table(spark, data, "lang_sample").collect()]
    train, held = sample[::2], sample[1::2]
    f = language.Filters.fit(train + [(r.lang, r.word) for r in table(spark, data, "common_word").collect()])
    right = 0
    for lang, text in held:
        s = language.read(f, [text])
        right += language.LANGUAGES[s.scores.sum(axis=0).argmax()] == lang
    assert right / len(held) > 0.97
    of = {x: " ".join(t for k, t in held if k == x) for x in language.LANGUAGES}
    docs = [(1, of["en"], "en"), (2, of["de"], "English"), (3, of["fr"], None), (4, of["es"] + "\n" + of["pt"], "es"), (5, of["zh"], "zh-CN"), (6, of["pt"], "pt_BR"), (7, None, "en"), (8, "", None), (9, "1,2;3\n" * 30, None), (10, of["en"] + ' He said "los costes".', "eng"), (11, of["de"], " ")]
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id bigint, text string, lang string, confidence string")
    got = {tuple(r) for r in language.mislabelled(df, f).collect()}
    assert got == {(2, "de"), (3, "fr"), (4, "es"), (4, "pt"), (11, "de")}
    segs = [(r.lang, r.confidence > 0.5) for r in language.segments(df.where("doc_id = 4"), f).orderBy("segment").collect()]
    assert [x for x, _ in segs] == ["es", "pt"]
    assert language.mislabelled(df.limit(0), f).count() == 0
