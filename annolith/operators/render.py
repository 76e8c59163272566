"""Rendering books as text: one expression per entry, then an ordered concatenation per book. No Python runs.

Entries carry the book's columns; the clock is a literal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.functions.dates import date_label, label_of, or_earliest
from annolith.functions.text import escape_html, slug_text
from annolith.settings import UNKNOWN_AUTHOR, UNKNOWN_PERIOD, Settings

# Words that rendered books carry.
NOTE, BOOKMARK, MARKER = "NOTA ", "MARCADOR ", "Marcador"
METADATA_TITLE = "Metadados do recorte"
SECTION = "# Citações e Destaques"
LABELS = {"author": "Autor", "highlights": "Total de destaques", "notes": "Total de notas", "positions": "Posições marcadas", "period": "Período", "today": "Gerado em"}
FAR = 2**63 - 1


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _join(values: Column, by: str) -> Column:
    return F.array_join(F.array_compact(values), by)


def sort_key() -> list[Column]:
    """Order of entries in a book: position (none last), date (none first), place in the list."""
    return [F.coalesce("start_pos", F.lit(FAR)), or_earliest(F.col("date_obj")), F.col("slot_seq")]


def position_label() -> Column:
    same = F.col("start_pos") == F.col("end_pos")
    return F.when(F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull(), _cat("Posição: ", F.when(same, F.col("start_pos").cast("string")).otherwise(_cat(F.col("start_pos").cast("string"), "-", F.col("end_pos").cast("string")))))


def location(by: str) -> Column:
    """Page, position and date, those that there are."""
    page = F.when(F.col("page").isNotNull(), _cat("Página ", F.col("page").cast("string")))
    date = F.nullif("date_formatted", F.lit(""))
    return _join(F.array(page, position_label(), date), by)


def renders(bookmarks: bool) -> Column:
    """A bookmark counts by its position, anything else by its text."""
    return F.when(F.col("type") == "bookmark", F.lit(bookmarks)).otherwise(F.coalesce("content", F.lit("")) != "")


def blockquote(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.when(line == "", F.lit(">")).otherwise(_cat("> ", line))), "\n")


def paragraphs_html(text: Column) -> Column:
    blocks = F.filter(F.split(text, r"\n[ \t]*\n", -1), lambda p: F.length(F.trim(F.regexp_replace(p, r"\s", ""))) > 0)
    return F.array_join(F.transform(blocks, lambda p: _cat("<p>", F.replace(escape_html(p), F.lit("\n"), F.lit("<br>")), "</p>")), "")


def yaml_text(text: Column) -> Column:
    return _cat('"', F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), '"')


def front_matter(title: Column, author: Column, settings: Settings) -> Column:
    """Eighteen properties; those that clippings cannot know are left blank."""
    known = {"type": F.lit('"livro"'), "title": yaml_text(title), "author": yaml_text(author), "created": F.lit(settings.today.isoformat()), "format": F.lit('\n  - "ebook"'), "documented": F.lit("true")}
    names = ("type", "title", "author", "contributors", "pages", "language", "isbn", "created", "source", "format", "genres", "series", "volume", "started", "finished", "status", "rating", "documented")
    lines = [F.lit(f"{n}:") if n not in known else _cat(f"{n}:" if n == "format" else f"{n}: ", known[n]) for n in names]
    return _cat("---\n", F.concat_ws("\n", *lines), "\n---\n")


# -- books -------------------------------------------------------------------------------------------------------


def books(entries: DataFrame, per_entry: dict[str, Column], settings: Settings) -> DataFrame:
    """One row per book: title (first of its list), author and title as sorted, counts, marks, period, and for each
    name of per_entry the array of its texts (nulls left out) in the order of the book. entries: with slot_seq.
    """
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_key())])
    rows = entries.withColumns({f"_{n}": c for n, c in per_entry.items()}).withColumn("_key", key)
    shown = F.struct(F.col("_key"), *[F.col(f"_{n}") for n in per_entry])
    grouped = rows.groupBy("analysis_id", "book_key").agg(
        F.min_by("title", "slot_seq").alias("title"),
        F.min_by("author", "slot_seq").alias("first_author"),
        F.min_by("author", "_key").alias("author"),
        F.count_if(F.col("type") == "highlight").alias("highlights"),
        F.count_if(F.col("type") == "note").alias("notes"),
        F.count_if(F.col("type") == "bookmark").alias("bookmarks"),
        F.min("date_obj").alias("_from"),
        F.max("date_obj").alias("_to"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "bookmark", F.struct(F.col("_key"), F.col("start_pos").cast("string").alias("at"))))).alias("_marks"),
        F.array_sort(F.collect_list(shown)).alias("_entries"),
    )
    period = F.when(F.col("_from").isNull(), F.lit(UNKNOWN_PERIOD)).otherwise(_cat(date_label(F.col("_from")), " - ", date_label(F.col("_to"))))
    marks = F.when(F.lit(settings.include_bookmarks) & (F.col("bookmarks") > 0), _join(F.transform("_marks", lambda m: m["at"]), ", "))
    full = F.when(F.col("author") != UNKNOWN_AUTHOR, _cat(F.col("title"), " - ", F.col("author"))).otherwise(F.col("title"))
    out = grouped.withColumns({"period": period, "positions": marks, "full_title": full, "today": F.lit(label_of(settings.today))})
    lists = {n: F.array_compact(F.col(f"_entries._{n}")) for n in per_entry}
    return out.withColumns(lists).drop("_from", "_to", "_marks", "_entries")


def _fields(line: Callable[[str, Column], Column], names: tuple[str, ...]) -> list[Column]:
    """The metadata lines that there are, in order; positions only where a book has bookmarks to show."""
    return [F.when(F.col(n).isNotNull(), line(LABELS[n], F.col(n).cast("string"))) for n in names]


ALL_FIELDS = ("author", "highlights", "notes", "positions", "period", "today")


def _prefix() -> Column:
    return F.when(F.col("type") == "note", F.lit(NOTE)).when(F.col("type") == "bookmark", F.lit(BOOKMARK)).otherwise(F.lit(""))


def markdown(entries: DataFrame, settings: Settings, metadata: bool = True) -> DataFrame:
    where, text = location(" | "), F.coalesce("content", F.lit(""))
    one = F.when(F.col("type") == "note", _cat("- **NOTA** ", where, "\n**", text, "**\n\n")).when(F.col("type") == "bookmark", _cat("- **MARCADOR** ", where, "\n\n")).otherwise(_cat("- ", where, "\n", text, "\n\n"))
    rows = books(entries, {"parts": F.when(renders(settings.include_bookmarks), one)}, settings)
    head = _cat(F.concat_ws("", *_fields(lambda n, v: _cat(f"**{n}**: ", v, "  \n"), ALL_FIELDS)), "\n---\n\n") if metadata else F.lit("")
    return rows.withColumn("content", _cat("# ", F.col("full_title"), "\n\n", head, F.array_join("parts", "")))


def plain_text(entries: DataFrame, settings: Settings, metadata: bool = False) -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    one = _cat(_prefix(), location(" | "), "\n", F.when(text == "", F.lit("")).otherwise(_cat(text, "\n\n")))
    rows = books(entries, {"parts": F.when(renders(settings.include_bookmarks), one)}, settings)
    head = _cat(F.concat_ws("", *_fields(lambda n, v: _cat(f"{n}: ", v, "\n"), ALL_FIELDS)), "\n" + "-" * 50 + "\n\n") if metadata else F.lit("")
    underline = F.repeat(F.lit("="), F.length("full_title"))
    return rows.withColumn("content", _cat(F.col("full_title"), "\n", underline, "\n\n", head, F.array_join("parts", "")))


#: Style sheets of our own pages.
STYLE = "body{font:16px/1.6 sans-serif;max-width:50rem;margin:auto;padding:1rem}.entry{margin:1rem 0;padding:.5rem 1rem;border-left:3px solid #bbb}.note{border-color:#c80}.entry-meta{color:#555;font-size:.9em}"
CLIP_STYLE = "body{font:16px/1.6 sans-serif;max-width:46rem;margin:2rem auto}.callout{margin-bottom:1rem;padding:.5rem 1rem;border-left:3px solid #bbb}"


def _page(title: Column, style: str, head: str | Column, body: Column) -> Column:
    safe = escape_html(title)
    return _cat('<!DOCTYPE html>\n<html lang="pt-BR">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>', safe, "</title>\n", head, "<style>", style, "</style>\n</head>\n<body>\n<h1>", safe, "</h1>\n", body, "</body>\n</html>")


def web_page(entries: DataFrame, settings: Settings, metadata: bool = True) -> DataFrame:
    """Bookmarks share the class of highlights."""
    kind = F.when(F.col("type") == "note", F.lit("note")).otherwise(F.lit("highlight"))
    one = _cat('<div class="entry ', kind, '">\n<div class="entry-meta">', _prefix(), escape_html(location(" | ")), '</div>\n<div class="entry-content">', escape_html(F.coalesce("content", F.lit(""))), "</div>\n</div>\n")
    rows = books(entries, {"parts": F.when(renders(settings.include_bookmarks), one)}, settings)
    head = _cat('<div class="metadata">\n', F.concat_ws("", *_fields(lambda n, v: _cat(f"<p><strong>{n}:</strong> ", escape_html(v), "</p>\n"), ALL_FIELDS)), "</div>\n") if metadata else F.lit("")
    return rows.withColumn("content", _page(F.col("full_title"), STYLE, "", _cat(head, F.array_join("parts", ""))))


# -- note blocks: one source for the vault note and the clip page ------------------------------------------------

BLOCK = "struct<kind:string,type:string,fold:string,title:string,text:string,label:string,location:string,fields:array<struct<name:string,value:string>>>"
NOTE_FIELDS = ("highlights", "notes", "positions", "period", "today")


def _block(**parts: Column) -> Column:
    names = ("kind", "type", "fold", "title", "text", "label", "location", "fields")
    return F.struct(*[parts.get(n, F.lit(None)).alias(n) for n in names]).cast(BLOCK)


def note_blocks(entries: DataFrame, settings: Settings, metadata: bool = True) -> DataFrame:
    """Books with blocks: a metadata callout if asked for, then a callout or marker for each entry that renders."""
    where = location(" · ")
    text = F.coalesce("content", F.lit(""))
    marker = _block(kind=F.lit("marker"), label=F.lit(MARKER), location=where)
    note = _block(kind=F.lit("callout"), type=F.lit("note"), title=_cat("Nota — ", where), text=text)
    quote = _block(kind=F.lit("callout"), type=F.lit("quote"), title=where, text=text)
    one = F.when(F.col("type") == "bookmark", marker).when(F.col("type") == "note", note).otherwise(quote)
    rows = books(entries, {"blocks": F.when(renders(settings.include_bookmarks), one)}, settings)
    if metadata:
        fields = F.array_compact(F.array(*_fields(lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value")), NOTE_FIELDS)))
        info = _block(kind=F.lit("callout"), type=F.lit("info"), fold=F.lit("-"), title=F.lit(METADATA_TITLE), fields=fields)
        rows = rows.withColumn("blocks", F.concat(F.array(info), F.col("blocks")))
    return rows


def blocks_markdown(blocks: Column) -> Column:
    def one(b: Column) -> Column:
        fields = F.transform(b["fields"], lambda f: _cat("> **", f["name"], "**: ", f["value"]))
        body = F.when(b["fields"].isNotNull(), F.array_join(fields, "  \n")).otherwise(blockquote(b["text"]))
        callout = _cat("> [!", b["type"], "]", F.coalesce(b["fold"], F.lit("")), " ", b["title"], "\n", body)
        return F.when(b["kind"] == "marker", _cat("**", b["label"], "** — ", b["location"])).otherwise(callout)

    return F.when(F.size(blocks) > 0, _cat(F.array_join(F.transform(blocks, one), "\n\n"), "\n")).otherwise(F.lit(""))


def blocks_html(blocks: Column) -> Column:
    def one(b: Column) -> Column:
        fields = F.transform(b["fields"], lambda f: _cat("<strong>", escape_html(f["name"]), "</strong>: ", escape_html(f["value"])))
        body = F.when(b["fields"].isNotNull(), _cat("<p>", F.array_join(fields, "<br>"), "</p>")).otherwise(paragraphs_html(b["text"]))
        fold = F.when(F.coalesce(b["fold"], F.lit("")) != "", _cat(' data-callout-fold="', escape_html(b["fold"]), '"')).otherwise(F.lit(""))
        callout = _cat('<div class="callout" data-callout="', escape_html(b["type"]), '"', fold, '><div class="callout-title"><div class="callout-title-inner">', escape_html(b["title"]), '</div></div><div class="callout-content">', body, "</div></div>")
        return F.when(b["kind"] == "marker", _cat("<p><strong>", escape_html(b["label"]), "</strong> — ", escape_html(b["location"]), "</p>")).otherwise(callout)

    return F.array_join(F.transform(blocks, one), "\n")


def vault_note(entries: DataFrame, settings: Settings, metadata: bool = True) -> DataFrame:
    rows = note_blocks(entries, settings, metadata)
    return rows.withColumn("content", _cat(front_matter(F.col("title"), F.col("author"), settings), "\n", SECTION, "\n\n", blocks_markdown(F.col("blocks"))))


def book_schema(title: Column, author: Column) -> Column:
    """schema.org description of the book, as JSON."""
    person = F.struct(F.lit("Person").alias("@type"), author.alias("name"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Book").alias("@type"), title.alias("name"), F.array(person).alias("author"), F.lit("EBook").alias("bookFormat")))


def clip_page(entries: DataFrame, settings: Settings, metadata: bool = True) -> DataFrame:
    """The page that a web clipper reads: JSON-LD, title and author, and the blocks of the vault note."""
    rows = note_blocks(entries, settings.with_changes(include_bookmarks=True), metadata)
    head = _cat('<script type="application/ld+json">', book_schema(F.col("title"), F.col("first_author")), "</script>\n")
    body = _cat("<p>", escape_html(F.col("first_author")), '</p>\n<div data-testid="highlights">\n', blocks_html(F.col("blocks")), "\n</div>\n")
    return rows.withColumn("content", _page(F.col("title"), CLIP_STYLE, head, body))


RENDERERS = {"markdown": markdown, "html": web_page, "txt": plain_text, "obsidian": vault_note}


def files(entries: DataFrame, settings: Settings) -> DataFrame:
    """(analysis_id, format, path, book_key, content) of every enabled format and book.

    Books may share a path; unique_files() keeps the one whose list starts later, as a rewritten file would.
    """
    made = []
    firsts = entries.groupBy("analysis_id", "book_key").agg(F.min("slot_seq").alias("first_seq"))
    for f in settings.enabled():
        rows = RENDERERS[f.name](entries, settings, f.include_metadata)
        author = F.coalesce(F.nullif("first_author", F.lit("")), F.lit("autor-desconhecido"))
        path = _cat(f"{f.folder}/", slug_text(F.col("title")), "-", slug_text(author), f".{f.extension}")
        made.append(rows.select("analysis_id", F.lit(f.name).alias("format"), path.alias("path"), "book_key", "content"))
    if not made:
        empty = firsts.limit(0)
        return empty.select("analysis_id", F.lit("").alias("format"), F.lit("").alias("path"), "book_key", F.lit("").alias("content"), "first_seq")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.join(firsts, ["analysis_id", "book_key"])


def unique_files(made: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("book_key", "content"), "first_seq").alias("_last")
    return made.groupBy("analysis_id", "format", "path").agg(last).select("analysis_id", "format", "path", "_last.*")


def files_generated(made: DataFrame) -> DataFrame:
    """Files made by format. Books that share a path count each."""
    return made.groupBy("format").agg(F.count(F.lit(1)).alias("files"))
