"""Whole texts cut at random places, at more than one scale: recall must not fall as data grow."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries, truncation
from marlstone.session import table


def planted(spark, data, share=0.05):
    """(recall, new finds among texts that weren't cut by us, planted) by table; a cut is inside a word, or inside a sentence behind others."""
    posts = table(spark, data, "social_post").select("id", "text").where("text is not null").dropDuplicates(["id"])
    docs = table(spark, data, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")
    recs = posts.select(F.lit("social_post").alias("tbl"), "id", "text").unionByName(docs.select(F.lit("documents").alias("tbl"), "id", "text"))
    known, of = queries.common(spark, data), frozenset({"social_post"})
    before = {(r.tbl, r.id) for r in truncation.truncated(recs, known, of).where("cut").collect()}
    rng, rows, cut = random.Random(5), [], set()
    for r in sorted(recs.collect()):
        text = r.text
        if (r.tbl, r.id) not in before and rng.random() < share:
            if r.tbl == "social_post":
                words = [m for m in re.finditer(r"(?<![$#@\w/.:])[a-z]{6,}(?![\w./:])", text) if m.start() > 20]
                if words:
                    m = rng.choice(words)
                    text = text[: m.start() + rng.randint(3, len(m.group()) - 2)]
            else:
                lines = [m for m in re.finditer(r"(?<=[.!?] )[A-Z][^.!?\n|]{50,}[.!?]", text) if m.start() > 300]
                if lines:
                    m = rng.choice(lines)
                    ends = [x.end() for x in re.finditer(r"[^\W\d_]{2,}(?= [a-z])", m.group())]
                    text = text[: m.start() + rng.choice(ends[2:-1])] if len(ends) > 4 else text
            if text != r.text:
                cut.add((r.tbl, r.id))
        rows.append((r.tbl, r.id, text))
    changed = spark.createDataFrame(rows, "tbl string, id bigint, text string")
    after = {(r.tbl, r.id) for r in truncation.truncated(changed, known, of).where("cut").collect()}
    return {t: (len({x for x in after & cut if x[0] == t}) / max(sum(x[0] == t for x in cut), 1), len({x for x in after - before - cut if x[0] == t}), sum(x[0] == t for x in cut)) for t in ("social_post", "documents")}


@pytest.mark.parametrize("scale", [s for s in os.environ.get("PLANTED_SCALES", "sf0.01").split(",")])
def test_recall_of_planted_cuts(spark, scale):
    found = planted(spark, f"/root/testdata/{scale}")
    print(scale, found)
    for t, (recall, strangers, n) in found.items():
        assert n > 20 and recall >= 0.9, (t, recall)
        assert strangers <= 0.02 * n + 1, (t, strangers)
