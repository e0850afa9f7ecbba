"""Files to documents: which formats are read, and how each becomes (path, page_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sheets import workbook_pages
from . import office

#: Formats by extension.
TEXT, MARKUP, TABLES, OFFICE = ["txt"], ["html", "xml", "md"], ["csv"], ["xlsx", "docx", "pptx", "odt", "epub"]
#: Accepted at the gate but not readable with what is installed here: their rows say so.
UNREADABLE = ["pdf", "xls", "ppt", "rtf", "jpg", "jpeg", "png", "tiff", "bmp", "gif"]
#: Read as what printable text they hold.
FALLBACK = ["doc"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def accepted(files: DataFrame) -> DataFrame:
    """Those files (path, ...) whose extension is known."""
    return files.where(extension(F.col("path")).isin(TEXT + MARKUP + TABLES + OFFICE + FALLBACK + UNREADABLE))


def markdown_text(text: Column) -> Column:
    """Markdown without its marks."""
    plain = F.regexp_replace(text, r"!\[.*?\]\(.*?\)", "")
    plain = F.regexp_replace(plain, r"\[([^\]]*)\]\([^)]*\)", "$1")
    plain = F.regexp_replace(plain, r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+", "")
    return F.regexp_replace(plain, r"[*_`]{1,3}([^*_`]+)[*_`]{1,3}", "$1")


def markdown_images(text: Column) -> Column:
    """The images that a Markdown text names."""
    return F.regexp_extract_all(text, F.lit(r"!\[.*?\]\((.*?)\)"), 1)


def markup_text(text: Column) -> Column:
    """The text of simple HTML or XML: scripts, styles and tags gone, blocks on lines of their own, references decoded."""
    plain = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    plain = F.regexp_replace(plain, r"(?i)<(/?(p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|title)\b[^>]*|br\s*/?)>", "\n")
    plain = F.regexp_replace(plain, "<[^>]*>", "")
    # The character references of XML, and the blank.
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, "[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def printable_runs(content: Column) -> Column:
    """Runs of five printable characters or more, what is left of a file of unknown format."""
    return F.array_join(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit("([ -~]{5,})"), 1), "\n")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, text, images, error) of all known files under path (S2); a file that cannot be read is one row with the reason.

    images: what a Markdown file shows; a .doc gives its runs of printable characters."""
    files = accepted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).withColumn("ext", extension(F.col("path")))
    text = F.decode("content", "UTF-8")
    unreadable = F.col("ext").isin(UNREADABLE)
    simple = files.where(~F.col("ext").isin(OFFICE)).select(
        "path",
        F.lit(1).alias("page_no"),
        F.when(unreadable, F.lit(None))
        .when(F.col("ext") == "md", markdown_text(text))
        .when(F.col("ext").isin(MARKUP), markup_text(text))
        .when(F.col("ext").isin(FALLBACK), printable_runs(F.col("content")))
        .otherwise(text)
        .alias("text"),
        F.when(F.col("ext") == "md", markdown_images(text)).otherwise(F.array().cast("array<string>")).alias("images"),
        F.when(unreadable, F.concat(F.lit("no reader for "), "ext")).alias("error"),
    )
    none = F.array().cast("array<string>").alias("images")
    books = office.rows(files)
    sound = books.where("error IS NULL").drop("error")
    whole = sound.select("path").distinct()
    sheets_ = workbook_pages(sound, office.merges(files.join(whole, "path", "left_semi"))).select("path", "page_no", "text", none, F.lit(None).cast("string").alias("error"))
    broken = books.where("error IS NOT NULL").select("path", F.lit(1).alias("page_no"), F.lit(None).cast("string").alias("text"), none, "error")
    others = office.pages(files.where(F.col("ext").isin(OFFICE) & (F.col("ext") != "xlsx"))).select("path", "page_no", "text", none, "error")
    return simple.unionByName(others).unionByName(sheets_).unionByName(broken)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, text) of the files that can be read."""
    return read_all(spark, path).where("error IS NULL").select("path", "page_no", "text")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the others."""
    return read_all(spark, path).where("error IS NOT NULL").select("path", "error")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as a table with names that SQL takes."""
    import csv

    from ..operators.sheets import clean_cells, sql_name, unique_names

    # Spark numbers repeated names in a way of its own, so they are taken from the first line.
    head = spark.read.text(path).first()
    table = spark.read.csv(path, header=True, inferSchema=True)
    return clean_cells(table.toDF(*unique_names([sql_name(n) for n in next(csv.reader([head.value]))])) if head else table)


def read_parsed(spark: SparkSession, path: str, schema: str = "id string, title string, full_text string, content array<struct<number:int,text:string>>") -> DataFrame:
    """Parsed documents, a JSON file each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def document_pages(parsed: DataFrame) -> DataFrame:
    """(id, number, text): a row for each page of parsed documents (T5)."""
    return parsed.select("id", F.explode("content").alias("page")).select("id", "page.number", "page.text")


#: A parsed document.
PARSED = "id string, type string, file_name string, title string, full_text string, content array<struct<number:int,text:string,images:array<string>>>"


def parsed_documents(pages: DataFrame) -> DataFrame:
    """PARSED of the readable pages (path, page_no, text, images, error) of files: the id is a digest of the path, the title the name without its ending."""
    name = F.element_at(F.split("path", "/"), -1)
    content = F.array_sort(F.collect_list(F.struct(F.col("page_no").cast("int").alias("number"), "text", "images")))
    whole = F.array_join(F.transform("content", lambda p: p["text"]), "\n")
    found = pages.where("error IS NULL").groupBy("path").agg(content.alias("content"))
    return found.select(F.sha2("path", 256).alias("id"), extension(F.col("path")).alias("type"), name.alias("file_name"), F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "").alias("title"), whole.alias("full_text"), "content")


def write_parsed(documents: DataFrame, path: str) -> None:
    """K2: parsed documents (PARSED with user_id and thread_id) as JSON, by user and thread; what a thread has there already stays."""
    documents.write.mode("append").partitionBy("user_id", "thread_id").json(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """What write_parsed has written, with user_id and thread_id as text."""
    return spark.read.schema(f"{PARSED}, user_id string, thread_id string").json(path)
