"""Texts cut off by field limits and broken transfers.

One pass reads every text's ending and counts the words that aren't the last of their text, nor the last before the marks, tags
and links behind it. The words make a corpus vocabulary trie, a table of its nodes (a proper prefix and how often words go on from
it): a last word that is next to never a word of the vocabulary itself but is such a node was cut. Lengths at which texts heap up are field limits; there an unknown last word is enough.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.canonical import canonical_array
from marlstone.llm.quality import PROSE_SHARE, judge, units
from marlstone.session import settle

#: Words of more letters aren't entered into the trie; a last word of more is no prefix of one.
LONGEST_WORD = 40
FLUSH = 400_000
#: A word counts as none of the vocabulary if it is met at most this share as often as words that go on from it: some of what is
#: met inside texts are fragments too. On sf0.1 and check_l no last word of three or more texts lies from 0.0041 to 0.0080.
KNOWN_SHARE = 1 / 200
#: A length is a field limit if this share of a table's texts has it, so many times as many as the lengths around it, and so many
#: standard deviations of a count beyond them.
LIMIT_SHARE, LIMIT_TIMES, LIMIT_SURE = 0.001, 2.0, 4
#: Words go on from a last word if they are met so many times as often as it ends texts; else it is a word of its own.
ONWARD_TIMES = 5
#: An unknown last word from which no words go on may be cut if at least this share of the texts it ends have the length of a limit.
AT_LIMIT_SHARE = 0.5

WORD = re.compile(r"\w+")
# What is put behind a cut.
MARK = re.compile(r"(?:\.{3}|…|\[\+?\d+ (?:chars|more)\]|\[(?:more|…|\.\.\.)\]|\(?\b(?:read more|continue reading|see more|show more)\b\)?|>>|»»|\[\+\])[\"'”]*\s*$", re.IGNORECASE)
BROKEN = re.compile(r"(?:&(?:#\w{0,6}|[a-zA-Z]{1,8})|</?[a-zA-Z][^<>]{0,60}|<)$")
# What closes a whole text.
CLOSING = re.compile(r"(?:<\|\w+\|>|(?:https?://|www\.)\S+|[$#@]\w+|[(\[][^()\[\]%\n]{1,60}[)\]]|(?:—|–|--)[^.!?。！？\n]{1,60}|\b(?:full story|source|via|contact|more at|related)\s*:[^.!?。\n]{1,60})\s*$", re.IGNORECASE)
ENDED = re.compile(r"[.!?。！？]+[\"'”»)\]」』）]*$|[\"”»」』]$")
PICTURES = re.compile(r"[\s←-⯿\U0001f000-\U0001faff‍️]+$")
APPENDED = re.compile(r"(?:(?:https?://|www\.)\S+|[$#@]\w+)\s*$")
LAST = re.compile(r"(\S*?)(\w+)$")
BULLET = re.compile(r"^\s*(?:[-*•·▪]|\d+[.)]|[a-z][.)])\s")


def near_end(text: str) -> int:
    """A place from which on all that stands at the end of the text begins: links reach back to a blank, all else less than 160 signs."""
    k = len(text.rstrip("\"'”"))
    return max(0, min(k - 160, max(text.rfind(" ", 0, k), text.rfind("\n", 0, k))))


def ended(text: str) -> bool:
    """Whether a sentence end or a closing quote stands at the end."""
    return ENDED.search(text, max(len(text.rstrip("\"'”»)\\]」』）")) - 1, 0)) is not None


def strip_end(text: str) -> tuple[str, bool, bool]:
    """(the text without what was put behind it, a mark of a cut was there, it stood right behind the text)."""
    text, marked, close = text.rstrip(), False, False
    for _ in range(12):
        start = near_end(text)
        if m := MARK.search(text, start):
            rest = text[: m.start()]
            marked, close = True, rest[-1:].strip() != ""
            text = rest.rstrip()
        elif (m := BROKEN.search(text, start)) and m.start() > 0:
            text, marked = text[: m.start()].rstrip(), True
        elif (m := CLOSING.search(text, start)) and m.start() > 0:
            text = text[: m.start()].rstrip()
        else:
            break
    return text, marked, close


def without_pictures(text: str) -> str:
    return PICTURES.sub("", text) if PICTURES.match(text[-1:]) else text


def last_fragment(text: str) -> tuple[str, str]:
    """(last line, what stands behind the last sentence end in it)."""
    line = text[text.rfind("\n") + 1 :]
    return line, units(line)[-1].strip()


def ending(text: str, in_word: bool, known: frozenset[str]) -> tuple[str, str, str, int]:
    """(verdict, last word in lower case, clause, characters before what was put behind it) of one text; verdict: whole, cut, or what has to be asked of the trie.

    word: cut if the last word is cut; trail: cut unless the sentence trails off on purpose; name: a short line of
    names, cut if its last word is.
    """
    if in_word:
        if text.rstrip().endswith("�"):
            return "cut", "", "", len(text.rstrip())
        body = text.rstrip()
        m = MARK.search(body, near_end(body))
        body = body[: m.start()].rstrip() if m else without_pictures(body)
        for _ in range(12):
            if m or not (c := APPENDED.search(body, near_end(body))):
                break
            body = without_pictures(body[: c.start()].rstrip())
        last = LAST.search(body, max(body.rfind(" "), body.rfind("\n")) + 1)
        if last is None or not last.group(2)[-1].isalpha() or last.group(1).startswith(("$", "#", "@", "http")):
            return "whole", "", "", len(body)
        return "word", last.group(2).lower(), "", len(body)
    body, marked, close = strip_end(text)
    size = len(body)
    if body.endswith("�") and _prose(text, known):
        return "cut", "", "", size
    if not body or ended(body):
        return "whole", "", "", size
    line, fragment = last_fragment(body)
    if not fragment or not _prose(text, known):
        return "whole", "", "", size
    token = (WORD.findall(fragment.lower()) or [""])[-1]
    words = fragment.split()
    if marked:
        short = close and len(words) <= 5 and token not in known
        return ("trail" if short else "cut"), token, fragment.lower(), size
    if len(fragment) < len(line.strip()):
        return "cut", token, "", size  # it follows a sentence in its line
    if BULLET.match(line) and not judge(line, known)[2]:
        return "whole", "", "", size
    if judge(fragment, known)[2] or any(0x3400 <= ord(c) <= 0x9FFF for c in fragment):
        return "cut", token, "", size
    if re.search(r"[|\t;:=<>/\\▲▼%]|  |,\S", line):
        return "whole", "", "", size  # a row of a table
    small = sum(w[0].islower() for w in words)
    if len(words) <= 3 and not small:
        return "name", token, "", size
    commas = sum(w.endswith(",") for w in words)
    return ("cut" if small and commas * 2 < len(words) and len(words) > 1 and any(w.lower() in known for w in (token, *words)) else "name"), token, "", size


def _prose(text: str, known: frozenset[str]) -> bool:
    """Whether running sentences make up a third of the text, the unfinished one included."""
    need = PROSE_SHARE * len(text)
    got = 0
    for u in units(text):
        got += judge(u, known)[3]
        if got >= need:
            return True
    # a single sentence that broke off early has few words to be judged by
    return len(text) < 60 and sum(w.isalpha() for w in text.split()) >= 2


def _pass(recs: DataFrame, known: frozenset[str], in_words: frozenset[str]) -> DataFrame:
    """kind 'end': one row a record; kind 'word': counts of the words that aren't their text's last, nor the last before what was put behind it."""
    names = ["kind", "tbl", "id", "verdict", "token", "clause", "n", "m"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def vocabulary(words: Counter) -> pa.RecordBatch:
        n = len(words)
        blank = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays([pa.array(["word"] * n), blank(pa.string()), blank(pa.int64()), blank(pa.string()), pa.array(list(words), pa.string()), blank(pa.string()), pa.array(list(words.values()), pa.int64()), blank(pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            tbls, ids, out = batch.column("tbl").to_pylist(), batch.column("id").to_pylist(), []
            for tbl, i, text in zip(tbls, ids, canonical_array(batch.column("text")).to_pylist()):
                verdict, token, clause, size = ending(text, tbl in in_words, known)
                # the text and what was put behind it each have a last word
                for piece in (text[:size], text[size:]):
                    found = WORD.findall(piece.lower())
                    if found and not (piece[-1] in ".!?" and not piece.endswith("...")):
                        found.pop()
                    words.update(found)
                out.append(("end", tbl, i, verdict, token[: LONGEST_WORD + 1], clause, len(text), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=names)
            if len(words) > FLUSH:
                yield vocabulary(words)
                words.clear()
        if words:
            yield vocabulary(words)

    return recs.where("text is not null and id is not null").mapInArrow(run, "kind string, tbl string, id bigint, verdict string, token string, clause string, n bigint, m bigint")


def truncated(recs: DataFrame, known: frozenset[str], in_words: frozenset[str] = frozenset()) -> DataFrame:
    """(tbl, id, cut, length, at_limit): every record and whether its text was cut.

    recs has tbl, id and text; `known` are the common words. A text is cut if it breaks off inside a sentence, in the tables
    `in_words` if inside a word. Marks of a cut, links, tags, bracketed remarks and signatures behind the text are looked
    through. Null texts are left out; repeated rows come out as often. All limits are shares of the table or of the counts around,
    so that a table's records, given several times over, keep their verdicts; only a heap that chance may have made is none yet.
    """
    seen = settle(_pass(recs, known, in_words))
    ends = seen.where("kind = 'end'").select("tbl", "id", "verdict", "token", "clause", F.col("n").alias("length"))
    words = seen.where("kind = 'word'").groupBy("token").agg(F.sum("n").alias("n"))
    by_length = ends.groupBy("tbl", "length").agg(F.count("*").alias("many"))
    around = by_length.select("tbl", F.explode(F.array(*[F.struct((F.col("length") + d).alias("length"), F.col("many").alias("near")) for d in (-3, -2, -1, 1, 2, 3)])).alias("x")).groupBy("tbl", "x.length").agg((F.sum("x.near") / 6).alias("usual"))
    totals = by_length.groupBy("tbl").agg(F.sum("many").alias("total"))
    usual = F.coalesce("usual", F.lit(0.0))
    limits = by_length.join(around, ["tbl", "length"], "left").join(totals, "tbl").where((F.col("many") >= LIMIT_SHARE * F.col("total")) & (F.col("many") > LIMIT_TIMES * usual) & (F.col("many") - usual >= LIMIT_SURE * F.sqrt(usual + 1))).select("tbl", "length", F.lit(True).alias("at_limit"))
    ends = ends.join(limits, ["tbl", "length"], "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    asked = ends.where("verdict in ('word', 'trail', 'name') and token <> ''").groupBy("token").agg(F.count("*").alias("asked"), F.count_if("at_limit").alias("limited"))
    nodes = (
        words.where((F.length("token") <= LONGEST_WORD) & (F.length("token") > 1))
        .select(F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("k"), "token", "n")
        .groupBy(F.expr("substring(token, 1, k)").alias("token")).agg(F.sum("n").alias("onward"))
    )
    known, onward = F.coalesce("n", F.lit(0)), F.coalesce("onward", F.lit(0))
    told = asked.join(words, "token", "left").join(nodes, "token", "left").select("token", known.alias("known"), (known <= KNOWN_SHARE * onward).alias("rare"), (onward >= ONWARD_TIMES * F.col("asked")).alias("goes_on"), (F.col("limited") >= AT_LIMIT_SHARE * F.col("asked")).alias("by_limit"))
    trails = ends.where("verdict = 'trail'").groupBy("clause").agg(F.count("*").alias("repeats"))
    cut_word = F.col("rare") & (F.col("goes_on") | (F.col("at_limit") & F.col("by_limit") & (F.col("verdict") == "word")))
    whole_trail = ~cut_word & (F.col("known") < 10 * F.coalesce("repeats", F.lit(1)))
    joined = ends.join(told, "token", "left").join(trails, "clause", "left")
    verdict = (
        F.when(F.col("verdict") == "cut", True)
        .when(F.col("verdict").isin("word", "name"), F.coalesce(cut_word, F.lit(False)))
        .when(F.col("verdict") == "trail", ~F.coalesce(whole_trail, F.lit(False)))
        .otherwise(False)
    )
    return joined.select("tbl", "id", verdict.alias("cut"), "length", "at_limit")


def truncation_rates(marked: DataFrame, sources: DataFrame) -> DataFrame:
    """(tbl, source, records, truncated_count, truncated_share) from marked records and (tbl, id, source); a null source is ''."""
    by = marked.select("tbl", "id", "cut").distinct().join(sources.select("tbl", "id", F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source")).distinct(), ["tbl", "id"])
    return by.groupBy("tbl", "source").agg(F.count("*").alias("records"), F.count_if("cut").alias("truncated_count"), F.avg(F.col("cut").cast("double")).alias("truncated_share"))
