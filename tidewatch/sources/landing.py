"""Landed files: fetched pages and API answers lie as JSON lines or text; fetching itself is not part of the engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import text as T

ARTICLE = "ordinal long, title string, content string, link string, published string, updated string, created string, label string, cat string"
METRIC = "code string, date string, type string, value double, ordinal long"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a stated schema: no pass over the data to guess one; broken lines become nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def first_entries(rows: DataFrame, source: str, n: int = 30) -> DataFrame:
    """The first n entries of each source, in its own order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(source).orderBy("ordinal"))).where(F.col("__r") <= n).drop("__r")


def by_priority(*sources: DataFrame) -> DataFrame:
    """The rows of the first source that has any, decided in one plan."""
    ranked = None
    for i, df in enumerate(sources):
        own = df.withColumn("__p", F.lit(i))
        ranked = own if ranked is None else ranked.unionByName(own)
    first = ranked.agg(F.min("__p").alias("__p"))
    return ranked.join(F.broadcast(first), "__p").drop("__p")


def sources(catalogue: DataFrame, modes: dict[str, tuple[str, ...]], mode: str) -> DataFrame:
    """The catalogue's rows (label, url, cat, brand, filter, ordinal) for a mode, in the order of the mode's categories; a mode that isn't listed takes all."""
    cats = modes.get(mode)
    if cats is None:
        return catalogue.withColumn("place", F.lit(0))
    place = F.array_position(F.array(*map(F.lit, cats)), F.col("cat")).cast("int")
    return catalogue.where(F.col("cat").isin(*cats)).withColumn("place", place)


def decoded(content: Column, encodings: tuple[str, ...] = ("utf-8", "big5", "cp950")) -> Column:
    """Bytes of a landed page as text, in the first encoding that fits; what fits none loses the bytes that are at fault."""

    @F.pandas_udf("string")
    def decode(pages: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            for encoding in encodings:
                try:
                    return bytes(raw).decode(encoding)
                except UnicodeDecodeError:
                    continue
            return bytes(raw).decode(encodings[0], "ignore")

        return pages.map(one)

    return decode(content)


def html_cells(pages: DataFrame, row: str = "tr", cell: str = "td|th") -> DataFrame:
    """Cells within rows of landed pages (page_id, html), by the names of their tags: page_id, row (from 0), cells.

    Tags within cells go, and white space at their ends. Elements of one name that lie within each other end at the
    first end tag. A page without rows, or null, has none. Built-in functions only.
    """
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(rf"(?is)<(?:{row})\b.*?</(?:{row})\s*>"), F.lit(0))).alias("row", "__row"))
    cells = F.regexp_extract_all("__row", F.lit(rf"(?is)<(?:{cell})\b[^>]*>(.*?)</(?:{cell})\s*>"), F.lit(1))
    return rows.select("page_id", F.col("row").cast("int").alias("row"), F.transform(cells, T.strip_tags).alias("cells"))


def html_links(pages: DataFrame) -> DataFrame:
    """Links of landed pages (page_id, html) in order: page_id, place (from 0), href, text without tags. A link without a quoted address is left out."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>.*?</a\s*>"""), F.lit(0))
    links = pages.select("page_id", F.posexplode(found).alias("place", "__a"))
    href = F.regexp_extract("__a", r"""(?is)\bhref\s*=\s*["']([^"']*)""", 1)
    return links.select("page_id", F.col("place").cast("int").alias("place"), href.alias("href"), T.strip_tags(F.col("__a")).alias("text"))
