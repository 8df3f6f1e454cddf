"""Sitemap XML and cached pages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOC = r"(?i)<loc>\s*(https?://[^<]+?)\s*</loc>"


def locations(xml: DataFrame, column: str = "value") -> DataFrame:
    """(url) of every <loc>, repeats kept."""
    return xml.select(F.explode(F.regexp_extract_all(column, F.lit(LOC), 1)).alias("url"))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Whole sitemap files, gzipped or plain."""
    return spark.read.text(path, wholetext=True)


def profile_urls(xml: DataFrame, prefix: str, column: str = "value") -> DataFrame:
    """(url, slug): distinct pages below a prefix."""
    found = locations(xml, column).where(F.col("url").startswith(prefix)).distinct()
    return found.select("url", F.regexp_replace(F.regexp_extract("url", "([^/]+)/?$", 1), r"[?#].*$", "").alias("slug"))


def rival_candidates(xml: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """(rival_id, rival_slug, url, name): the first url of each id, by url. `pattern` has groups for id and slug."""
    found = locations(xml, column).select("url", F.regexp_extract("url", pattern, 1).alias("rival_id"), F.regexp_extract("url", pattern, 2).alias("rival_slug")).where("rival_id <> ''")
    first = found.groupBy("rival_id").agg(F.min(F.struct("url", "rival_slug")).alias("f"))
    return first.select("rival_id", "f.rival_slug", "f.url", F.regexp_replace("f.rival_slug", "[-_]", " ").alias("name"))


def cached_pages(spark: SparkSession, path: str) -> DataFrame:
    """(slug, html) from a folder of html files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    return files.select(F.regexp_extract("path", r"([^/]+)\.html?$", 1).alias("slug"), "html")


def booking_slots(responses: DataFrame, column: str = "body") -> DataFrame:
    """(practitioner_id, slot_date) from booking answers in JSON; bad JSON and answers without slots give no rows."""
    schema = "response struct<responseData:struct<bookingDetails:array<struct<slotId:string,slotDate:string,slotTime:string,slotDuration:int>>>>"
    slots = F.explode(F.from_json(column, schema)["response"]["responseData"]["bookingDetails"])
    return responses.select("practitioner_id", slots.alias("s")).select("practitioner_id", F.col("s.slotDate").try_cast("date").alias("slot_date"), F.col("s.slotTime").alias("slot_time"))


def booking_prices(responses: DataFrame, column: str = "body") -> DataFrame:
    """(practitioner_id, price): the least number among the prices of an answer, an array or one object."""
    many = F.from_json(column, "array<struct<price:string>>")
    one = F.array(F.from_json(column, "struct<price:string>"))
    prices = F.transform(F.when(F.ltrim(F.col(column)).startswith("["), many).otherwise(one), lambda x: x.price.try_cast("double"))
    return responses.select("practitioner_id", F.array_min(prices).alias("price")).groupBy("practitioner_id").agg(F.min("price").alias("price"))


# Image types by file ending.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif"}


def photos(spark: SparkSession, path: str) -> DataFrame:
    """(slug, mime, bytes) of a folder of images; other files are left out."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.([A-Za-z]+)$", 1).alias("slug"), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("kind"), F.col("content").alias("bytes"))
    mime = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in IMAGE_TYPES.items()])
    return files.select("slug", mime.alias("mime"), "bytes").where("mime is not null")
