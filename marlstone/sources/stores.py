"""Readers and sinks of the engine's stores: fixed schemas in, committed partitions out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import web

OHLCV = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"
NEWS = "symbol string, published_date string, publisher string, title string, image string, site string, text string, url string"
VECTOR = "month string, values array<float>"


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] = (), encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """CSV with a header; bad lines are dropped, as are rows that lack a required column's value.

    The first encoding in which no text has an unreadable sign is taken, else the last.
    """
    for encoding in encodings:
        rows = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("encoding", encoding).csv(path)
        texts = [c for c, kind in rows.dtypes if kind == "string"]
        if encoding == encodings[-1] or not texts or rows.where(F.greatest(*[F.contains(c, F.lit("\ufffd")) for c in texts], F.lit(False))).isEmpty():
            break
    return rows.dropna(subset=list(required)) if required else rows


def check_csv(spark: SparkSession, path: str, required: list[str]) -> None:
    """An error if a CSV has no rows or lacks a required column."""
    rows = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns {missing} aren't in {path}")
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")


def read_json_lines(spark: SparkSession, path: str, schema: str = NEWS, since: str | None = None, date: str = "published_date", newest_first: bool = False) -> DataFrame:
    """JSON lines; blank and broken ones are dropped, as are items before the moment `since`.

    A date that can't be read is the earliest.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    rows = rows.dropna(how="all")
    if since:
        rows = rows.where(web.moment(F.col(date)) >= web.moment(F.lit(since)))
    return rows.orderBy(F.desc_nulls_last(web.moment(F.col(date)))) if newest_first else rows


def read_labelled(spark: SparkSession, path: str, splits: tuple[str, ...] = ("test", "validation", "train")) -> DataFrame:
    """(…, split): the first split of a labelled data set that has rows."""
    for split in splits:
        try:
            rows = spark.read.parquet(f"{path}/{split}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if not rows.isEmpty():
            return rows.withColumn("split", F.lit(split))
    raise ValueError(f"{path} has none of {splits}")


def with_columns(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """rows with every column of `defaults`; one that is missing is made, one that is null is filled."""
    return rows.select(*[F.col(c) for c in rows.columns if c not in defaults], *[F.coalesce(F.col(c), F.lit(v)).alias(c) if c in rows.columns else F.lit(v).alias(c) for c, v in defaults.items()])


def price_column(rows: DataFrame) -> DataFrame:
    """(…, price): adj_close, or close where there is none; the column that exists if only one does."""
    have = [c for c in ("adj_close", "close") if c in rows.columns]
    if not have:
        raise ValueError("neither adj_close nor close")
    return rows.withColumn("price", F.coalesce(*have))


def write_series(rows: DataFrame, path: str) -> None:
    """One partition a ticker; only partitions with rows are replaced."""
    price_column(rows).drop("price").repartition("ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def read_series(spark: SparkSession, path: str, schema: str = OHLCV) -> DataFrame:
    """Series of a store; of repeated dates the row that was stored last stays."""
    rows = spark.read.schema(schema).parquet(path)
    order = [F.desc(f"_m.{c}") for c in ("file_modification_time", "file_name", "row_index")]
    last = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(*order))
    return rows.select("*", F.col("_metadata").alias("_m")).withColumn("_n", last).where("_n = 1").drop("_n", "_m")


def flatten_ohlcv(rows: DataFrame, ticker: str) -> DataFrame:
    """OHLCV of one ticker from a vendor's frame, whose price columns may be structs by ticker, in any spelling.

    The columns that are there of OHLCV; adj_close is close where the vendor has none. Without either it is an error.
    """
    plain = {c.lower().replace(" ", "_"): c for c in rows.columns}
    value = {}
    for name in ("open", "high", "low", "close", "adj_close", "volume"):
        if name in plain:
            kind = rows.schema[plain[name]].dataType
            path = f"`{plain[name]}`" + (f".`{ticker if ticker in kind.names else kind.names[0]}`" if hasattr(kind, "names") else "")
            value[name] = F.col(path).cast("double")
    if not {"close", "adj_close"} & set(value):
        raise ValueError(f"neither close nor adj_close in {rows.columns}")
    value.setdefault("adj_close", value.get("close"))
    return dated(rows, tuple(plain.get(c, c) for c in ("date", "datetime", "index")), "_date").select(F.lit(ticker).alias("ticker"), F.col("_date").alias("date"), *[c.alias(n) for n, c in value.items()])


def write_atomic(rows: DataFrame, path: str) -> None:
    """The rows in place of what was at the path, by one rename behind the complete write."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    new, old, at = (place(path + tail) for tail in (".new", ".old", ""))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    rows.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def described(spark: SparkSession, path: str) -> dict[str, str]:
    """Columns and types of a stored table, without reading rows."""
    return dict(spark.read.parquet(path).dtypes)


def write_articles(articles: DataFrame, path: str, keys: list[str] = ("asset", "year", "month"), text: str = "text", mark: bool = False) -> None:
    """Articles as CSV, as JSON lines and as plain texts by their keys, and their numbers as statistics, in four folders.

    mark: the CSV begins with a byte order mark, as some spreadsheets want it.
    """
    csv = articles.withColumnRenamed(articles.columns[0], "\ufeff" + articles.columns[0]) if mark else articles
    csv.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(f"{path}/csv")
    articles.write.mode("overwrite").json(f"{path}/json")
    articles.select(*keys, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*keys).text(f"{path}/txt")
    n = F.size(F.split(F.trim(text), r"\s+"))
    articles.groupBy(*keys).agg(F.count("*").alias("articles"), F.sum(n).alias("words"), F.avg(n).alias("mean_words")).write.mode("overwrite").json(f"{path}/stats")


def write_pages(pages: DataFrame, path: str, keys: list[str] = ("asset", "year", "month")) -> None:
    """Raw pages and their metadata as two tables by the keys; both have the index."""
    heavy = [*keys, "idx", "html"]
    pages.select(*heavy).write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/html")
    pages.drop("html").write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/metadata")


def read_pages(spark: SparkSession, path: str, keys: list[str] = ("asset", "year", "month")) -> DataFrame:
    """Stored pages beside their metadata; metadata without a page has a null page."""
    return spark.read.parquet(f"{path}/metadata").join(spark.read.parquet(f"{path}/html"), [*keys, "idx"], "left")


def append_unseen(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the store doesn't hold, one of each; their number."""
    spark = rows.sparkSession
    new = rows.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def write_vectors(vectors: DataFrame, path: str, length: int) -> None:
    """(month, values), one partition a month; vectors of another length are an error."""
    if vectors.where(F.size("values") != length).limit(1).count():
        raise ValueError(f"a vector hasn't {length} values")
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_vectors(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(month, values) of a store; a vector of another length is an error where it is read."""
    rows = spark.read.schema("values array<float>, month string").parquet(path)
    wrong = F.raise_error(F.format_string(f"the vector of %s hasn't {length} values", "month"))
    return rows.select("month", F.when(F.size("values") == length, F.col("values")).otherwise(wrong.cast("array<float>")).alias("values"))


def write_months(rows: DataFrame, path: str, date: str = "date") -> None:
    """Rows by year and month of their date."""
    rows.withColumns({"year": F.year(date), "month": F.month(date)}).write.mode("overwrite").partitionBy("year", "month").parquet(path)


def write_nested_links(links: DataFrame, path: str, keys: list[str]) -> None:
    """One JSON object a group: its keys, the number of links, and the links."""
    inner = [c for c in links.columns if c not in keys]
    links.groupBy(*keys).agg(F.count("*").alias("link_count"), F.sort_array(F.collect_list(F.struct(*inner))).alias("links")).write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Back-test tables under model=…/seed=…, which become columns."""
    return spark.read.schema(schema + ", model string, seed int").option("basePath", path).parquet(path)


def dated(rows: DataFrame, candidates: tuple[str, ...] = ("Date", "date", "Datetime", "datetime"), to: str = "date") -> DataFrame:
    """rows with a date column from the first candidate there is; what can't be read as a date is dropped."""
    named = next((c for c in candidates if c in rows.columns), None)
    if named is None:
        raise ValueError(f"none of {candidates} is a column")
    text = F.regexp_extract(F.trim(F.col(named).cast("string")), r"^(\d{4}-\d{2}-\d{2})", 1)
    return rows.withColumn(to, text.try_cast("date")).where(F.col(to).isNotNull())
