"""Entries from segments. Built-ins over text forms that one vectorised UDF makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.dates import date_label
from annolith.functions.keys import book_key
from annolith.functions.text import SPACE, line_forms, strip, words
from annolith.settings import UNKNOWN_AUTHOR

#: Words of a metadata line, as they read without accents.
MONTH_WORDS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
TYPE_WORDS = (("destaque", "highlight"), ("nota", "note"), ("marcador", "bookmark"))
IN_PARENTHESES = r"\(([^)]+)\)\z"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def entry_type(metadata: Column) -> Column:
    kind = F.lit("unknown")
    for word, name in reversed(TYPE_WORDS):
        kind = F.when(F.contains(F.lower(metadata), F.lit(word)), F.lit(name)).otherwise(kind)
    return kind


def location(folded: Column) -> tuple[Column, Column]:
    """(start, end) of a folded metadata line; a single position ends where it starts."""
    pattern = f"(?:posicao|location)(?:[:]|{SPACE})+(\\d+)(?:-(\\d+))?"
    start, end = (_group(folded, pattern, g).try_cast("bigint") for g in (1, 2))
    return start, F.coalesce(end, start)


def page(folded: Column) -> Column:
    return _group(folded, f"pagina{SPACE}+(\\d+)", 1).try_cast("bigint")


def date_parts(folded: Column) -> tuple[Column, Column, Column]:
    """(day, month, year) of the first date; month is null where its word is none."""
    pattern = f"(\\d{{1,2}}){SPACE}+de{SPACE}+([a-z]+){SPACE}+de{SPACE}+(\\d{{4}})"
    numbers = F.create_map(*[x for i, m in enumerate(MONTH_WORDS, 1) for x in (F.lit(m), F.lit(i))])
    return _group(folded, pattern, 1).try_cast("int"), F.try_element_at(numbers, _group(folded, pattern, 2)), _group(folded, pattern, 3).try_cast("int")


def title_and_author(line: Column) -> tuple[Column, Column]:
    """Of a repaired and stripped title line: the last parentheses at its end name the author."""
    line = F.regexp_replace(line, "^\\uFEFF+", "")
    named = line.rlike(IN_PARENTHESES)
    raw = strip(F.regexp_extract(line, IN_PARENTHESES, 1))
    comma = F.split(raw, ",", 2)
    author = F.when(F.contains(raw, F.lit(",")), F.concat(strip(F.get(comma, F.lit(1))), F.lit(" "), strip(F.get(comma, F.lit(0))))).otherwise(raw)
    title = strip(F.regexp_replace(line, f"{SPACE}*\\([^)]+\\)\\z", ""))
    theirs, mine = words(author), words(title)
    last = F.slice(mine, F.greatest(F.size(mine) - F.size(theirs) + 1, F.lit(1)), F.size(theirs))
    repeated = (F.size(theirs) >= 2) & (F.size(mine) >= F.size(theirs)) & (F.lower(F.array_join(last, " ")) == F.lower(author))
    shorter = F.array_join(F.slice(mine, F.lit(1), F.greatest(F.size(mine) - F.size(theirs), F.lit(0))), " ")
    shorter = strip(F.regexp_replace(shorter, f"{SPACE}*[-\\u2013\\u2014]+{SPACE}*\\z", ""))
    return F.when(named, F.when(repeated, shorter).otherwise(title)).otherwise(strip(line)), F.when(named, author).otherwise(F.lit(UNKNOWN_AUTHOR))


def parse(segments: DataFrame) -> DataFrame:
    """Entries with a column is_error; segments of one line are no entries and leave no trace.

    An error is a date that no calendar has (the year 0 among them); a missing date or an unknown month is none: its label is the whole line.
    """
    lines = segments.withColumn("lines", F.split(strip(F.col("raw")), "\n")).filter(F.size("lines") >= 2)
    lines = lines.select("analysis_id", "seq", strip(F.get("lines", F.lit(0))).alias("line"), strip(F.get("lines", F.lit(1))).alias("metadata_line"), strip(F.array_join(F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0))), "\n")).alias("content"))
    lines = lines.withColumn("forms", line_forms(F.col("line"), F.col("metadata_line"))).select("*", "forms.*").drop("forms")
    title, author = title_and_author(F.col("title_line"))
    start, end = location(F.col("metadata_folded"))
    day, month, year = date_parts(F.col("metadata_folded"))
    rows = lines.withColumns({"title": title, "author": author, "start_pos": start, "end_pos": end, "page": page(F.col("metadata_folded")), "month": month, "date_obj": F.when(year >= 1, F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)))})
    rows = rows.withColumn("is_error", F.col("month").isNotNull() & F.col("date_obj").isNull())
    return rows.select(
        "analysis_id",
        "seq",
        book_key(F.col("title"), F.col("author")).alias("book_key"),
        entry_type(F.col("metadata_line")).alias("type"),
        "title",
        "author",
        "page",
        "start_pos",
        "end_pos",
        "content",
        F.coalesce(date_label(F.col("date_obj")), F.col("metadata_fixed")).alias("date_formatted"),
        "date_obj",
        "metadata_line",
        "is_error",
    )


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("is_error")).drop("is_error")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("analysis_id").agg(F.count_if("is_error").alias("errors"))


def served(entries_: DataFrame) -> DataFrame:
    """The fields of an entry that leave the engine."""
    return entries_.select("type", "page", "start_pos", "end_pos", "content", "date_formatted")
