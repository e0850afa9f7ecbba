"""Spreadsheets as tables: header detection, names, and sheets as text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCANNED, LEAST_SCORE = 20, 0.3


def header_scores(rows: DataFrame, width: str = "width") -> DataFrame:
    """rows (sheet, row_no from 0, cells, width) with ``score``, how much a row looks like a header.

    0.4 for the share of cells that are no plain number, 0.3 for that of different ones, 0.3 for that of filled ones;
    a tenth of it with fewer than two cells. Only the first 20 rows are looked at."""
    filled = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    rows = rows.where(F.col("row_no") < SCANNED).withColumn("filled", filled).where(F.size("filled") > 0)
    n = F.size("filled")
    wordy = F.size(F.filter("filled", lambda c: ~F.regexp_replace(c, r"^([^.]*)\.(.*)$", "$1$2").rlike("^[0-9]+$"))) / n
    score = 0.4 * wordy + 0.3 * F.size(F.array_distinct("filled")) / n + 0.3 * n / F.col(width)
    return rows.withColumn("score", F.when(n < 2, score * 0.1).otherwise(score))


def header_rows(rows: DataFrame) -> DataFrame:
    """(sheet, header_row, context): the first row with the best score, 0 if none reaches 0.3, and the text above it."""
    scored = header_scores(rows)
    order = Window.partitionBy("sheet").orderBy(F.desc(F.round("score", 12)), "row_no")
    best = scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("sheet", F.when(F.col("score") < LEAST_SCORE, 0).otherwise(F.col("row_no")).alias("header_row"))
    above = scored.join(best, "sheet").where(F.col("row_no") < F.col("header_row")).groupBy("sheet")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.array_join("filled", " ").alias("line")))), lambda x: x["line"])
    return best.join(above.agg(F.array_join(lines, "\n").alias("context")), "sheet", "left")


def header_levels(headers: DataFrame, merged: DataFrame, most: int = 10) -> DataFrame:
    """headers (sheet, header_row, ...) with ``levels``, the rows that name the columns (S9): with cells merged across columns within a
    row of the header, that row and the one below if it is among the first ten; else the header's row alone.

    merged: sheet, row_no, last_row, column, last_column."""
    wide = merged.where("last_column > column AND row_no = last_row").select(F.col("sheet").alias("_sheet"), F.col("row_no").alias("_row"))
    near = headers.join(wide, (F.col("sheet") == F.col("_sheet")) & (F.abs(F.col("_row") - F.col("header_row")) <= 1), "left")
    first = near.groupBy(*headers.columns).agg(F.min("_row").alias("_row"))
    two = F.col("_row").isNotNull() & (F.col("_row") + 1 < most)
    return first.select(*headers.columns, F.when(two, F.array(F.col("_row"), F.col("_row") + 1)).otherwise(F.array("header_row")).alias("levels"))


def column_names(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, names): each sheet's column names by its header of one row or two, flattened and made different.

    headers: sheet, levels. A merged parent names the columns up to the next."""
    named = rows.join(headers.select("sheet", "levels"), "sheet").where(F.array_contains("levels", F.col("row_no")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"])

    def names(levels: list) -> list[str]:
        above, below = (levels[0], levels[-1]) if len(levels) > 1 else (None, levels[0])
        columns, parent = [], None
        for i, cell in enumerate(below):
            parent = (above[i] if above is not None and i < len(above) and above[i] else parent) if above is not None else None
            columns.append((parent, cell) if above is not None else (cell,))
        return unique_names([sql_name(n) for n in flat_names(columns)])

    @F.pandas_udf("array<string>")
    def of_sheets(levels: pd.Series) -> pd.Series:
        return levels.map(names)

    return named.groupBy("sheet").agg(parts.alias("_parts")).select("sheet", of_sheets("_parts").alias("names"))


#: Blanks of spreadsheets that count as spaces.
_BLANKS = "[\u00a0\u200b\u200c\u200d\ufeff]+"


def annotated(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """rows (sheet, row_no, cells, marks) with the marks of cells below the header behind their values (S12). headers: sheet, levels."""
    last = headers.select("sheet", F.array_max("levels").alias("_header"))
    both = F.zip_with("cells", "marks", lambda c, m: F.when(m.isNull(), c).otherwise(F.concat_ws(" ", c, m)))
    return rows.join(last, "sheet", "left").withColumn("cells", F.when(F.col("row_no") > F.coalesce("_header", F.lit(0)), both).otherwise(F.col("cells"))).drop("_header")


def raw_names(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, names): each sheet's column names as they are written, flattened where a header has two rows; a cell without one is ``Unnamed: i``."""
    named = rows.join(headers.select("sheet", "levels"), "sheet").where(F.array_contains("levels", F.col("row_no")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"])
    found = named.groupBy("sheet").agg(parts.alias("p"))
    below = F.element_at("p", -1)
    # a merged parent names the columns up to the next
    parent = F.transform(F.get("p", F.lit(0)), lambda c, i: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.slice(F.get("p", F.lit(0)), F.lit(1), i + 1), lambda x: x.isNotNull())), -1))
    one = lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("Unnamed: "), i.cast("string")))
    two = F.transform(F.arrays_zip(parent.alias("a"), below.alias("b")), lambda x, i: F.coalesce(F.nullif(F.concat_ws("_", F.nullif(F.trim(x["a"]), F.lit("")), F.nullif(F.trim(x["b"]), F.lit(""))), F.lit("")), F.concat(F.lit("Column_"), i.cast("string"))))
    return found.select("sheet", F.when(F.size("p") > 1, two).otherwise(F.transform(below, one)).alias("names"))


def workbook_summary(rows: DataFrame, names: DataFrame, headers: DataFrame, most: int = 10) -> DataFrame:
    """(sheet, rows, columns, line): how many rows stand below each sheet's header, empty ones included, and its first ten columns (A10)."""
    counted = rows.join(headers.select("sheet", F.array_max("levels").alias("_header")), "sheet").groupBy("sheet").agg(F.max(F.greatest(F.col("row_no") - F.col("_header"), F.lit(0))).alias("rows"), F.max(F.size("cells")).alias("columns"))
    listed = F.concat(F.array_join(F.slice("names", 1, most), ", "), F.when(F.size("names") > most, ", ...").otherwise(""))
    title = F.element_at(F.split("sheet", "\u0001"), -1)
    line = F.concat(F.lit("- Sheet '"), title, F.lit("': "), F.col("rows").cast("string"), F.lit(" rows. Columns: ["), listed, F.lit("]"))
    return counted.join(names, "sheet").select("sheet", "rows", "columns", line.alias("line"))


def sheet_text(rows: DataFrame, headers: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(sheet, columns, n, text): the filled rows of each sheet below its header as a table of bars with a line of names.

    Empty rows and columns go, blanks of spreadsheets are spaces; a column without a name takes its first value if that is short and no
    number, else its place. Without headers all rows are a table without a line of names."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, _BLANKS, " "), "\n", " "))
    own = rows.withColumn("cells", F.transform("cells", lambda c: F.nullif(clean(c), F.lit(""))))
    if headers is not None:
        own = own.join(headers.select("sheet", F.array_max("levels").alias("_header")), "sheet").where(F.col("row_no") > F.col("_header"))
    own = own.where(F.exists("cells", lambda c: c.isNotNull()))
    first = own.select("sheet", "row_no", F.posexplode("cells").alias("i", "value")).where("value IS NOT NULL").groupBy("sheet", "i").agg(F.min_by("value", "row_no").alias("hint"))
    used = first.groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("i", "hint"))).alias("hints"))
    own = own.join(used, "sheet").withColumn("kept", F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), F.coalesce(c, F.lit("")).alias("c"))), lambda x: F.map_contains_key("hints", x["i"])))
    line = F.concat(F.lit("| "), F.array_join(F.transform("kept", lambda x: x["c"]), " | "), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))), lambda x: x["line"])
    tables = own.groupBy("sheet").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("lines"))
    if headers is None:
        return tables.select("sheet", F.lit("").alias("columns"), "n", F.col("lines").alias("text"))

    @F.pandas_udf("array<string>")
    def different(listed: pd.Series) -> pd.Series:
        return listed.map(lambda x: unique_names(list(x)))

    def named(name: Column, i: Column) -> Column:
        hint = F.element_at("hints", i)
        good = hint.isNotNull() & (F.length(hint) < 50) & ~F.regexp_replace(hint, "[.,]", "").rlike("^[0-9]+$")
        plain = F.trim(F.regexp_replace(name, "\u00a0+", " "))
        return F.when(plain.startswith("Unnamed"), F.when(good, hint).otherwise(F.concat(F.lit("Column_"), i.cast("string")))).otherwise(plain)

    heads = names.join(used, "sheet", "left").withColumn("hints", F.coalesce("hints", F.create_map().cast("map<int,string>"))).withColumn("names", different(F.transform("names", named)))
    heads = heads.withColumn("shown", F.transform(F.filter(F.transform("names", lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: F.map_contains_key("hints", x["i"])), lambda x: x["c"]))
    bars = F.concat(F.lit("| "), F.array_join("shown", " | "), F.lit(" |\n|"), F.repeat(F.lit("---|"), F.size("shown")))
    whole = heads.join(tables, "sheet", "left").select("sheet", F.array_join("shown", ", ").alias("columns"), F.coalesce("n", F.lit(0)).alias("n"), F.concat_ws("\n", F.when(F.size("shown") > 0, bars), "lines").alias("text"))
    return whole


def workbook_pages(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """(path, page_no, text): a page for each sheet of workbooks' rows (path, sheet, sheet_no, row_no, cells, marks, width): what the workbook holds, what stands above
    the sheet's header, its columns, how many rows, and its table (S13, A10). merged: path, sheet, row_no, last_row, column, last_column."""
    key = F.concat(F.col("path"), F.lit("\u0001"), F.col("sheet"))
    own, cells = rows.withColumn("title", F.col("sheet")).withColumn("sheet", key), merged.withColumn("sheet", key)
    heads = header_rows(own)
    heads = own.select("sheet").distinct().join(heads, "sheet", "left").withColumn("header_row", F.coalesce("header_row", F.lit(0)))
    heads = header_levels(heads, cells)
    own = annotated(own, heads)
    names = raw_names(own, heads)
    about = workbook_summary(own, names, heads)
    places = own.groupBy("sheet").agg(F.min("path").alias("path"), F.min("title").alias("title"), F.min("sheet_no").alias("page_no"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "line"))), lambda x: x["line"])
    books = about.join(places, "sheet").groupBy("path").agg(F.concat(F.lit("# Workbook Structure Summary\n"), F.array_join(lines, "\n"), F.lit("\n\n")).alias("book"))
    table = sheet_text(own, heads, names).join(places, "sheet").join(books, "path").join(heads.select("sheet", "context"), "sheet")
    file = F.element_at(F.split("path", "/"), -1)
    context = F.when(F.col("context").isNotNull(), F.concat(F.lit("Context/Metadata:\n"), "context", F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("=== Spreadsheet: "), file, F.lit(" | Sheet: "), "title", F.lit(" ===\n"), "book", context, F.lit("Columns: "), "columns", F.lit("\nTotal rows: "), F.col("n").cast("string"), F.lit("\n\nData:\n"), "text")
    return table.select("path", "page_no", F.btrim(F.regexp_replace(text, r"[^\S\n]{2,}", " "), F.lit(" \n\t")).alias("text"))


def unique_names(names: list[str]) -> list[str]:
    """Column names, the second of equal ones (whatever their case) with _2 behind, and so on; never one that is taken."""
    taken, out = {n.lower() for n in names}, []
    used: set[str] = set()
    for name in names:
        new, k = name, 2
        while new.lower() in used or (new != name and new.lower() in taken):
            new, k = f"{name}_{k}", k + 1
        used.add(new.lower())
        out.append(new)
    return out


def flat_names(levels: list[tuple]) -> list[str]:
    """One name for each column of a header of several rows: its parts, without empty and unnamed ones, by an underscore."""
    def parts(column: tuple) -> list[str]:
        found = [str(p).strip() for p in column if p is not None]
        return [p for p in found if p and p.lower() != "nan" and not p.startswith("Unnamed")]

    return ["_".join(p) if (p := parts(c)) else f"Column_{i}" for i, c in enumerate(levels)]


def sql_name(name: str, prefix: str = "col_", empty: str = "unnamed_col") -> str:
    """A name that SQL takes without quotes."""
    x = re.sub(r"\W", "_", str(name).strip(), flags=re.ASCII)
    x = prefix + x if x[:1].isdigit() else x
    return re.sub("_+", "_", x).strip("_").lower() or empty


def sql_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([sql_name(c) for c in df.columns]))


def clean_cells(df: DataFrame, clean: Column | None = None) -> DataFrame:
    """df with its strings cleaned (T15) and rows without any value gone."""
    from ..functions.text import clean_cell

    kinds = dict(df.dtypes)
    return df.na.drop("all").select(*[clean_cell(F.col(f"`{c}`")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`") for c in df.columns])
