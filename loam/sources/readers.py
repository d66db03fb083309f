"""Readers of article and chunk files, question-and-answer dumps, sitemaps and links."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import rules
from loam.functions import text as X

from loam import schemas
from loam.sources.storage import shared_dir

POST = "_Id long, _PostTypeId int, _AcceptedAnswerId long, _ParentId long, _Score string, _Title string, _Body string, _Tags string"


def chunk_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Chunks of JSON lines; a limit takes the first by chunk_id, so that it is the same however the files are named or split;
    scanned() takes the first in the order of the files."""
    rows = scanned(spark, path)[0]
    return rows if limit is None else rows.orderBy("chunk_id").limit(limit)


def scanned(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, quarantine) of JSON lines: rows as chunk_lines, and (file, line, chunk_id where it could be read) of the lines that
    are no record of that schema. A limit takes the first records in the order of the files' names and of the lines in them."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schemas.CHUNK}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = raw.select(parsed.alias("r"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line")).select("r.*", "_file", "_start", "_line")
    good = rows.where("_broken IS NULL")
    if limit is not None:
        good = good.orderBy("_file", "_start", "_line").limit(limit)
    return good.drop("_broken", "_file", "_start", "_line"), rows.where("_broken IS NOT NULL").select(F.col("_file").alias("file"), F.col("_broken").alias("line"), "chunk_id")


def article_files(spark: SparkSession, path: str, one_each: bool = True) -> DataFrame:
    """Articles, one JSON document a file (or one a line), at any depth below the path, with the file's path as `file`: order by it where order
    matters."""
    rows = spark.read.schema(schemas.ARTICLE).option("multiLine", one_each).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def dump_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a dump with one `row` element each; attributes become columns with an underscore."""
    return spark.read.format("xml").option("rowTag", "row").schema(POST).load(path)


def accepted_pairs(posts: DataFrame, tags: list[str] = rules.QA_TAGS, question_score: int = 3, answer_score: int = 1) -> DataFrame:
    """(question_id, title, question, answer, tags): questions of enough score with one of the tags, joined to the answer they accept.

    A question whose score is no integer is left out; an answer's counts as 0. Of questions that accept one answer the last, by
    id, stays. The questions are filtered before they are joined, so that Spark's runtime filter (a Bloom filter of their accepted
    ids) reaches the scan of the answers where that is large.
    """
    tag = X.tags("_Tags")  # a word without delimiters is no tag
    score = F.expr("try_cast(_Score AS int)")
    asked = posts.where((F.col("_PostTypeId") == 1) & F.col("_AcceptedAnswerId").isNotNull() & (score >= question_score)).withColumn("tags", tag)
    asked = asked.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    last = asked.groupBy("_AcceptedAnswerId").agg(F.max("_Id").alias("_Id"))
    asked = asked.join(last, ["_AcceptedAnswerId", "_Id"], "left_semi")
    answers = posts.where((F.col("_PostTypeId") == 2) & (F.coalesce(score, F.lit(0)) >= answer_score)).select(F.col("_Id").alias("_AcceptedAnswerId"), F.col("_Body").alias("answer"))
    return asked.join(answers, "_AcceptedAnswerId").select(F.col("_Id").alias("question_id"), X.unescape("_Title").alias("title"), F.col("_Body").alias("question"), "answer", "tags")


def hrefs(html) -> Column:
    """Targets of double-quoted href attributes without query and fragment, each once, in the order of their first places."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[?#].*$", "")))


def sitemap_urls(text) -> Column:
    """URLs of the loc elements of a sitemap or sitemap index, and of the Sitemap lines of a robots file."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1))))


def sitemap_pages(files: DataFrame, start: str) -> DataFrame:
    """(url, depth, trail) of what the saved files(url, text) lead to from the file `start`: a robots file, an index or a sitemap.

    Entries that are saved files themselves are opened in turn, each once, however they refer to each other; all others are
    pages. Each page comes once, where it is seen first: breadth first, and in the order of entries; trail, the places of the
    entries on the way, sorts so within a depth. What has been seen stays a written table; a round opens the new files only.
    """
    spark = files.sparkSession
    base, depth = f"{shared_dir(spark)}/loam/{uuid.uuid4().hex}", 0
    schema = "url string, trail array<int>, depth int, file boolean"
    names = files.select("url").distinct().withColumn("file", F.lit(True))

    def keep(rows: DataFrame) -> DataFrame:
        rows.select("url", "trail", F.lit(depth).alias("depth"), F.coalesce("file", F.lit(False)).alias("file")).write.parquet(f"{base}/depth{depth}")
        return spark.read.schema(schema).parquet(f"{base}/depth{depth}")

    seen = new = keep(spark.range(1).select(F.lit(start).alias("url"), F.array().cast("array<int>").alias("trail"), F.lit(True).alias("file")))
    while new.where("file").limit(1).count():
        depth += 1
        opened = new.where("file").select("url", "trail").join(files.select("url", "text"), "url")
        entry = opened.select("trail", F.posexplode(sitemap_urls("text")).alias("at", "url")).select("url", F.concat("trail", F.array("at")).alias("trail"))
        first = entry.groupBy("url").agg(F.min("trail").alias("trail"))
        new = keep(first.join(seen.select("url"), "url", "left_anti").join(names, "url", "left"))
        seen = seen.unionByName(new)
    return seen.where("NOT file").select("url", "depth", "trail")
