"""Other tables as entries, so that every operator runs on them: entries columns plus slot_seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.dates import date_label
from annolith.functions.keys import book_key


def _entries(rows: DataFrame, **columns: Column) -> DataFrame:
    none = {"page": "bigint", "start_pos": "bigint", "end_pos": "bigint", "date_obj": "timestamp_ntz", "date_formatted": "string", "metadata_line": "string"}
    made = {n: F.lit(None).cast(t) for n, t in none.items()} | columns
    order = ("analysis_id", "seq", "slot_seq", "book_key", "type", "title", "author", "page", "start_pos", "end_pos", "content", "date_formatted", "date_obj", "metadata_line")
    made |= {"analysis_id": F.lit("test"), "slot_seq": made["seq"]}
    return rows.select(*[made[n].alias(n) for n in order])


def of_conversations(rows: DataFrame) -> DataFrame:
    """A book for each conversation, an entry for each turn."""
    title, author = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), F.lit("corpus")
    kind = F.when(F.col("role") == "user", "highlight").when(F.col("role") == "assistant", "note").when(F.col("role") == "system", "bookmark").otherwise("unknown")
    start = F.col("turn") * 10
    return _entries(rows, seq=F.col("conv_id") * 1_000_000 + F.col("turn"), book_key=book_key(title, author), type=kind, title=title, author=author, start_pos=start, end_pos=start + 9, content=F.col("text"))


def of_documents(rows: DataFrame) -> DataFrame:
    """A book for each source and language, an entry without a position for each document."""
    return _entries(rows, seq=F.col("doc_id"), book_key=book_key(F.col("source"), F.col("lang")), type=F.lit("highlight"), title=F.col("source"), author=F.col("lang"), content=F.col("text"))


def of_events(rows: DataFrame) -> DataFrame:
    """A book for each user, types of events as types, a short range for each event."""
    title, author = F.concat(F.lit("User "), F.col("user_id").cast("string")), F.lit("events")
    day = F.col("ts").cast("timestamp_ntz")
    return _entries(rows, seq=F.col("event_id"), book_key=book_key(title, author), type=F.col("event_type"), title=title, author=author, start_pos=F.col("event_id"), end_pos=F.col("event_id") + 3, content=F.col("props"), date_obj=day, date_formatted=date_label(day))


def pairs_of_versions(rows: DataFrame) -> DataFrame:
    """A book for each turn and variant, an entry for each version (k) of it with its range (s, e) and content (c)."""
    title, author = F.concat_ws(" ", F.lit("Turn"), "conv_id", "turn", "variant"), F.lit("corpus")
    seq = (F.col("conv_id") * 1_000_000 + F.col("turn")) * 100 + F.col("variant") * 2 + F.col("k")
    return _entries(rows, seq=seq, book_key=book_key(title, author), type=F.lit("highlight"), title=title, author=author, start_pos=F.col("s").cast("bigint"), end_pos=F.col("e").cast("bigint"), content=F.col("c"))


def clippings_text(entries: DataFrame) -> DataFrame:
    """(analysis_id, text): entries written as a clippings file for each book, in order; the inverse of parsing."""
    words = F.when(F.col("type") == "highlight", "destaque").when(F.col("type") == "note", "nota").when(F.col("type") == "bookmark", "marcador").otherwise("recorte")
    place = F.when(F.col("start_pos") == F.col("end_pos"), F.col("start_pos").cast("string")).otherwise(F.concat_ws("-", F.col("start_pos").cast("string"), F.col("end_pos").cast("string")))
    page = F.when(F.col("page").isNull(), F.lit("")).otherwise(F.concat(F.lit("na página "), F.col("page").cast("string"), F.lit(" | ")))
    spot = F.when(F.col("start_pos").isNull(), F.lit("")).otherwise(F.concat(F.lit("posição "), place, F.lit(" | ")))
    when = F.when(F.col("date_obj").isNull(), F.lit("")).otherwise(F.concat(F.lit("Adicionado: "), date_label(F.col("date_obj"))))
    line = F.concat(F.lit("- Seu "), words, F.lit(" "), page, spot, when)
    one = F.concat("title", F.lit(" ("), "author", F.lit(")\n"), line, F.lit("\n\n"), "content", F.lit("\n==========\n"))
    files = entries.groupBy("book_key").agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("t")))).alias("parts"))
    return files.select(F.col("book_key").alias("analysis_id"), F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("text"))
