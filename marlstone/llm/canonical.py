"""One spelling per look: compatibility forms, invisible characters and look-alikes, mapped by SQL inside Arrow partitions.

Each Arrow batch is a DuckDB relation; one embedded statement strips what can't be seen, makes blanks, look-alike letters
and compatibility forms one, and composes accents. Letter case, accents, digits and punctuation stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.bloom import one_of
from marlstone.llm.pairing import parts, split_pairs
from marlstone.session import settle, spread

# Letters of other scripts that look like a Latin one, in pairs.
LOOK_ALIKES = (
    # Cyrillic
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW "
    # Greek
    "οo νv ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ͿJ"
)
# Ranges whose members have a compatibility form that looks the same (widths, ligatures, letter-like signs,
# Roman numerals, mathematical letters).
SAME_LOOK = ((0xFF01, 0xFFEF), (0xFB00, 0xFB06), (0x212A, 0x212B), (0x2160, 0x217F), (0x1D400, 0x1D7FF), (0x0132, 0x0133), (0x01C7, 0x01CC), (0x2126, 0x2126))
# Blanks, and characters that leave no mark.
BLANKS = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
UNSEEN = r"\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}"
#: A joiner behind an emoji makes one picture of two and is seen; it is kept under this private sign meanwhile.
EMOJI, KEPT = r"\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}", chr(0xE000)


@cache
def statement() -> str:
    """The expression over the column `text` that gives its one spelling."""
    pairs = {p[0]: p[1] for p in LOOK_ALIKES.split()} | dict.fromkeys(BLANKS, " ")
    longer: dict[str, str] = {}
    for a, b in SAME_LOOK:
        for c in map(chr, range(a, b + 1)):
            if (to := unicodedata.normalize("NFKC", c)) != c:
                to = "".join(pairs.get(x, x) for x in to)
                (pairs if len(to) == 1 else longer)[c] = to
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    seen = f"regexp_replace(regexp_replace(text, '([{EMOJI}])\\x{{FE0F}}?\\x{{200D}}', '\\1{KEPT}', 'g'), '[{UNSEEN}]+', '', 'g')"
    one = f"translate({seen}, {quote(''.join(pairs))}, {quote(''.join(pairs.values()))})"
    for c, to in longer.items():
        one = f"replace({one}, {quote(c)}, {quote(to)})"
    return f"replace(nfc_normalize({one}), {quote(KEPT)}, chr(8205))"


@cache
def session() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute("SET memory_limit = '300MB'")
    return c


#: Characters that are their own one spelling and compose with nothing; a text of these alone is passed on.
SETTLED = r"^[\x00-\x7F\x{A1}-\x{AC}\x{AE}-\x{131}\x{134}-\x{1C3}\x{1CD}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{2190}-\x{2BFF}\x{3001}-\x{3029}\x{4E00}-\x{9FFF}\x{FFFD}\x{1F000}-\x{1FAFF}]*$"


def canonical_array(texts: pa.Array) -> pa.Array:
    """The texts' one spelling."""
    settled = pc.fill_null(pc.match_substring_regex(texts, SETTLED), True)
    if pc.all(settled).as_py() is not False:
        return texts
    unsettled = pc.invert(settled)
    odd = texts.filter(unsettled)
    wide = pa.table({"k": pa.array(range(len(odd)), pa.int32()), "text": odd})  # noqa: F841 - the relation in the statement
    done = session().sql(f"SELECT k, {statement()} AS text FROM wide ORDER BY k").to_arrow_table().column("text").combine_chunks()
    return pc.replace_with_mask(texts, unsettled, done.cast(texts.type))


def canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """df and the column `out`: the one spelling of `text`; null stays null, empty stays empty, other columns are kept.

    A column of the name `out` that is there already is replaced.
    """
    df = df.drop(out) if out != text else df
    fields = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = canonical_array(batch.column(text))
            columns = [done if n == text and out == text else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, *([] if out == text else [done])], names=[*batch.schema.names, *([] if out == text else [out])])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.mapInArrow(run, kinds if out == text else f"{kinds}, `{out}` string")


def _looks(df: DataFrame) -> DataFrame:
    """(tbl, id, look, form): digests of the one spelling and of the text as stored, 128 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            looked = pa.table({"tbl": batch.column("tbl"), "id": batch.column("id"), "text": texts, "one": canonical_array(texts)})  # noqa: F841
            yield from session().sql("SELECT tbl, id, unhex(md5(one)) AS look, unhex(md5(text)) AS form FROM looked").to_arrow_table().to_batches()

    return df.mapInArrow(run, "tbl string, id bigint, look binary, form binary")


def records(*tables: tuple[str, DataFrame, str, str]) -> DataFrame:
    """(tbl, id, text) of the tables given as (name, rows, id column, text column); null and blank texts are left out."""
    parts = [df.select(F.lit(n).alias("tbl"), F.col(k).cast("bigint").alias("id"), F.col(t).alias("text")) for n, df, k, t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return spread(out.where(F.col("text").rlike(r"(?U)[^\s\x{00A0}\x{200B}\x{FEFF}]") & F.col("id").isNotNull()))


def same_look_pairs(recs: DataFrame) -> DataFrame:
    """(tbl, id_1, id_2), id_1 < id_2: records of one table that look the same but aren't the same string.

    recs has tbl, id and text. Rows that repeat an id with the same text are one record. Only digests travel: looks with one
    spelling only are dropped behind a partial aggregation, so that a group of exact copies, however large, isn't joined;
    records of the looks that remain meet those of another spelling. Null ids and null texts give no pair.
    """
    looks = _looks(recs.where(F.col("text").isNotNull() & F.col("id").isNotNull()))
    looks = settle(looks)
    mixed = looks.groupBy("tbl", "look").agg(F.min("form").alias("a"), F.max("form").alias("b"), F.count("*").alias("n")).where("a <> b").select("tbl", "look", parts(F.col("n")).alias("_parts"))
    members = looks.join(mixed, ["tbl", "look"]).distinct()
    return split_pairs(members, ["tbl", "look"], "id", "id_1", "id_2", lambda a, b: a["form"] != b["form"]).select("tbl", "id_1", "id_2").distinct()


def spelling_groups(recs: DataFrame) -> DataFrame:
    """(tbl, id, canonical, spellings, rows): every record with its one spelling, and how many spellings and rows share it.

    A null text stands alone. Texts are spelled once and written; looks are counted by 128-bit digests, and only texts whose look
    is shared meet the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            looked = pa.table({"tbl": batch.column("tbl"), "id": batch.column("id"), "text": texts, "one": canonical_array(texts)})  # noqa: F841
            yield from session().sql("SELECT tbl, id, one AS canonical, unhex(md5(one)) AS look, unhex(md5(text)) AS form FROM looked").to_arrow_table().to_batches()

    one = settle(recs.select("tbl", "id", "text").mapInArrow(run, "tbl string, id bigint, canonical string, look binary, form binary"), "spelled")
    forms = one.where("look is not null").groupBy("tbl", "look", "form").agg(F.count("*").alias("n"))
    shared = settle(forms.groupBy("tbl", "look").agg(F.count("*").alias("spellings"), F.sum("n").alias("rows")).where("rows > 1"), "looks")
    key = F.xxhash64("tbl", "look")
    marked = one.drop("form").withColumn("_k", key)
    may = one_of(shared.select(key.alias("k")))
    single = marked.where(~may("_k")).select("tbl", "id", "canonical", F.lit(1).cast("bigint").alias("spellings"), F.lit(1).cast("bigint").alias("rows"))
    several = marked.where(may("_k")).join(shared, ["tbl", "look"], "left")
    return single.unionByName(several.select("tbl", "id", "canonical", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("spellings", "rows")]))
