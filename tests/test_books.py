"""Snapshots, statuses, history, selection, rendering, sinks, the service and the stream."""

import base64
import datetime as dt
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from annolith.operators import render, selection, snapshots, status
from annolith.plans import service
from annolith.settings import Settings
from annolith.sources import adapters, history, sinks

SETTINGS = Settings(today=dt.date(2024, 3, 5))
COLUMNS = "analysis_id string, book_key string, type string, seq long, slot_seq long, title string, author string, page long, start_pos long, end_pos long, content string, date_formatted string, date_obj timestamp_ntz"


def book(spark, rows, title='A "b": <c>', author="Autor & Cia"):
    made = [("a", "k", kind, i, i, title, author, page, start, end, content, "1 de março de 2024" if day else "", dt.datetime(2024, 3, day) if day else None) for i, (kind, page, start, end, content, day) in enumerate(rows)]
    return spark.createDataFrame(made, COLUMNS).repartition(3)


ROWS = [("note", None, 20, 20, "uma <nota>", 2), ("highlight", 0, 0, 5, "linha 1\n\nlinha 2", 1), ("bookmark", 3, 7, 7, "", None), ("highlight", 4, None, None, "", 3), ("unknown", None, None, None, "sem tipo", None)]


def content(df):
    return df.select("content").first().content


def test_snapshot_hashes(spark):
    got = snapshots.snapshots(book(spark, ROWS + ROWS[:1])).first()
    sign = lambda k, s, e, p, c: hashlib.sha1(f"{k}|{s}|{e}|{p}|{c}".encode()).hexdigest()
    want = sorted({sign(k, s, e, p, " ".join(c.split())) for k, p, s, e, c, _ in ROWS})
    assert got.entry_hashes == want and got.content_hash == hashlib.sha1("||".join(want).encode()).hexdigest()
    assert (got.highlight_count, got.note_count, got.bookmark_count, len(got.highlight_hashes)) == (2, 2, 1, 2)


def state(spark, **known):
    row = dict(book_key="k", title="", author="", entry_hashes=["e"], highlight_hashes=["h"], content_hash="c", highlight_hash="", highlight_count=1, note_count=0, bookmark_count=0, last_analysis_at="2024-01-01T00:00:00Z", last_export_at=None, last_export_formats=None, last_export_signature=None, last_export_highlight_hashes=None, last_export_entry_hashes=None) | known
    return spark.createDataFrame([tuple(row[n] for n in history._names(history.CURRENT))], history.CURRENT)


@pytest.mark.parametrize(
    ("known", "want", "new"),
    [
        ({}, "nunca_exportado", 2),
        ({"last_export_at": "x", "last_export_signature": "same", "last_export_highlight_hashes": ["h1", "h2"]}, "sem_novidades", 0),
        ({"last_export_at": "x", "last_export_signature": "c", "last_export_highlight_hashes": ["h1"]}, "com_novidades", 1),
        ({"last_export_at": "x", "last_export_signature": None, "last_export_highlight_hashes": ["h1", "h2"]}, "com_novidades", 0),
        ({"last_export_at": "x", "last_export_signature": "c", "highlight_hashes": ["h2"]}, "com_novidades", 1),
    ],
)
def test_status(spark, known, want, new):
    now = spark.createDataFrame([("a", "k", "T", "A", ["e1"], ["h1", "h2"], "same", 3, 0, 0, 0)], "analysis_id string, book_key string, title string, author string, entry_hashes array<string>, highlight_hashes array<string>, content_hash string, highlight_count long, note_count long, bookmark_count long, first_seq long")
    got = status.books_table(now, state(spark, **known)).first()
    assert (got.status, got.new_highlights_count, got.has_new_highlights) == (want, new, new > 0)
    assert got.default_selected == (want != "sem_novidades")
    fresh = status.books_table(now, state(spark).limit(0)).first()
    assert (fresh.status, fresh.status_label, fresh.last_export_display) == ("novo", "Novo", "-")


def test_table_order(spark):
    rows = [("1", "novo", "b"), ("2", "sem_novidades", "a"), ("3", "com_novidades", "Z"), ("4", "novo", "A"), ("5", "nunca_exportado", "c"), ("6", "other", "a")]
    table = spark.createDataFrame([(k, s, t, "x", i) for i, (k, s, t) in enumerate(rows)], "book_key string, status string, title string, author string, first_seq long")
    assert [r.book_key for r in table.orderBy(*status.order()).collect()] == ["4", "1", "3", "5", "2", "6"]


def test_markdown(spark):
    text = content(render.markdown(book(spark, ROWS), SETTINGS))
    assert text.startswith('# A "b": <c> - Autor & Cia\n\n**Autor**: Autor & Cia  \n**Total de destaques**: 2  \n**Total de notas**: 1  \n**Posições marcadas**: 7  \n')
    assert "**Período**: 1 de março de 2024 - 3 de março de 2024  \n**Gerado em**: 5 de março de 2024  \n\n---\n\n" in text
    body = text.split("---\n\n", 1)[1]
    assert body == "- Página 0 | Posição: 0-5 | 1 de março de 2024\nlinha 1\n\nlinha 2\n\n- **MARCADOR** Página 3 | Posição: 7\n\n- **NOTA** Posição: 20 | 1 de março de 2024\n**uma <nota>**\n\n- \nsem tipo\n\n"
    bare = content(render.markdown(book(spark, ROWS), SETTINGS.with_changes(include_bookmarks=False), False))
    assert "MARCADOR" not in bare and "Total" not in bare


def test_plain_text(spark):
    text = content(render.plain_text(book(spark, ROWS[:3], "T", "Autor desconhecido"), SETTINGS, True))
    assert text.startswith("T\n=\n\nAutor: Autor desconhecido\n") and "-" * 50 in text
    assert text.endswith("MARCADOR Página 3 | Posição: 7\nNOTA Posição: 20 | 1 de março de 2024\numa <nota>\n\n")


def test_web_page_escapes(spark):
    text = content(render.web_page(book(spark, ROWS), SETTINGS))
    assert "<title>A &quot;b&quot;: &lt;c&gt; - Autor &amp; Cia</title>" in text and "uma &lt;nota&gt;" in text and "<nota>" not in text
    assert text.count('class="entry highlight"') == 3 and text.count('class="entry note"') == 1


def test_vault_note_and_clip_page_agree(spark):
    note = content(render.vault_note(book(spark, ROWS), SETTINGS))
    assert note.startswith('---\ntype: "livro"\ntitle: "A \\"b\\": <c>"\nauthor: "Autor & Cia"\ncontributors:\npages:\n')
    assert 'format:\n  - "ebook"\ngenres:' in note and "created: 2024-03-05\n" in note and "documented: true\n---\n\n# Citações e Destaques\n\n> [!info]- Metadados do recorte\n> **Total de destaques**: 2  \n" in note
    assert "> [!quote] Página 0 · Posição: 0-5 · 1 de março de 2024\n> linha 1\n>\n> linha 2\n\n**Marcador** — Página 3 · Posição: 7\n\n> [!note] Nota — Posição: 20" in note
    page = content(render.clip_page(book(spark, ROWS), SETTINGS))
    schema = json.loads(page.split('ld+json">')[1].split("</script>")[0])
    assert schema["name"] == 'A "b": <c>' and schema["author"][0]["name"] == "Autor & Cia"
    assert page.count('class="callout"') == note.count("> [!") and "<p>linha 1</p><p>linha 2</p>" in page and 'data-callout-fold="-"' in page
    assert content(render.vault_note(book(spark, [("highlight", None, None, None, "", None)]), SETTINGS, False)).endswith("Destaques\n\n")


def test_colliding_paths_keep_the_later_book(spark):
    one = book(spark, ROWS[:2], "T!?", "A").withColumn("book_key", F.lit("k1"))
    two = book(spark, ROWS[:2], "T!", "A").withColumns({"book_key": F.lit("k2"), "slot_seq": F.col("slot_seq") + 10})
    files = render.files(one.unionByName(two), SETTINGS)
    assert files.count() == 4 and {r.book_key for r in render.unique_files(files).collect()} == {"k2"}
    assert render.files(one, SETTINGS.with_changes(formats=())).count() == 0


def test_sinks(spark, tmp_path):
    files = render.files(book(spark, ROWS, "T", "A"), Settings.of_request({"exportTxt": True, "exportObsidian": True, "exportMarkdown": True}, dt.date(2024, 3, 5)))
    with zipfile.ZipFile(io.BytesIO(sinks.zip_archive(files))) as archive:
        assert archive.namelist() == ["markdown/t-a.md", "obsidian/t-a.md", "txt/t-a.txt"]
        text = archive.read("txt/t-a.txt").decode()
    assert sinks.write_folder(files, str(tmp_path)) == 0 and (tmp_path / "txt/t-a.txt").read_text() == text
    (tmp_path / "shut").write_text("")
    assert sinks.write_folder(files, str(tmp_path / "shut")) == 3
    rows = sinks.encoded(files).collect()
    assert [(r.filename, r.format, r.mime_type) for r in rows][2] == ("t-a.txt", "txt", "text/plain; charset=utf-8")
    assert base64.b64decode(rows[2].content_base64).decode() == text
    sinks.write_table(files, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3


def table(spark):
    rows = [("1", "Duna", "Frank", "novo", 3, 3, True), ("2", "Ubik", "Philip", "sem_novidades", 5, 0, False), ("3", "Vulcano", "Frank", "com_novidades", 4, 1, True)]
    return spark.createDataFrame(rows, "book_key string, title string, author string, status string, highlights long, new_highlights_count long, default_selected boolean")


def test_selection(spark):
    rows = table(spark)
    chosen = selection.default_selection(rows)
    keys = lambda df: sorted(r.book_key for r in df.collect())
    assert keys(selection.filter_rows(rows, chosen, search="  FRANK ")) == ["1", "3"]
    assert keys(selection.filter_rows(rows, chosen, author="Philip")) == ["2"]
    assert keys(selection.filter_rows(rows, chosen, status="selecionados")) == ["1", "3"] == keys(selection.filter_rows(rows, chosen, selected_only=True))
    assert keys(selection.filter_rows(rows, chosen, status="com_novidades", search="u")) == ["3"]
    as_dict = lambda s: {r.book_key: r.selected for r in s.collect()}
    visible = rows.filter("book_key < 3")
    assert as_dict(selection.batch(rows, chosen, visible, "select_visible")) == {"1": True, "2": True, "3": True}
    assert as_dict(selection.batch(rows, chosen, visible, "clear_visible")) == {"1": False, "2": False, "3": True}
    assert as_dict(selection.batch(rows, chosen.limit(0), visible, "recommended")) == {"1": True, "2": False}
    assert as_dict(selection.toggle(chosen, visible)) == {"1": True, "2": True, "3": True}
    assert selection.as_map(chosen).first().selection == {"1": True, "2": False, "3": True}
    assert tuple(selection.summary(rows, chosen, 2).first()) == (2, 7, 2) and tuple(selection.summary(rows, chosen, 2, True).first()) == (2, 4, 2)
    assert selection.visible_counts(rows, visible, chosen).first().asDict() == {"visible": 2, "visible_selected": 1, "books": 3, "header": "some"}
    asked = spark.createDataFrame([("9", 0), ("3", 1), ("3", 2)], "book_key string, place int")
    assert [r.place for r in selection.known_keys(asked, rows).orderBy("place").collect()] == [1, 2]


def test_history_tail_keeps_the_last(spark):
    events = spark.range(450).select(F.pmod("id", F.lit(2)).cast("string").alias("book_key"), F.col("id").alias("event_no"))
    kept = history.tail(events, [F.col("event_no").desc()])
    assert kept.groupBy("book_key").count().filter("count = 200").count() == 2 and kept.agg(F.min("event_no")).first()[0] == 50


def test_legacy_document(spark):
    document = {
        "version": 1,
        "books": {
            "k1": {"title": "T", "entry_signatures": ["s", "s", " "], "last_processed_at": "2024-01-01T00:00:00Z", "last_exported_at": "2024-01-02T00:00:00Z", "highlight_count": "4", "note_count": "many", "last_export_formats": ["txt", " markdown"], "export_history": [{"content_signature_hash": "old"}, {"content_signature_hash": "last", "entry_signature_hashes": ["A" * 40]}]},
            "k2": {},
        },
    }
    got = {r.book_key: r for r in history.sanitise(spark.createDataFrame([(json.dumps(document),), ("not json",), ("[]",)], "value string")).collect()}
    one, two = got["k1"], got["k2"]
    assert one.entry_hashes == [hashlib.sha1(b"s").hexdigest()] and (one.highlight_count, one.note_count) == (4, 0)
    assert (one.author, one.last_export_signature, one.last_export_formats, one.last_export_entry_hashes) == ("Autor desconhecido", "last", ["markdown", "txt"], ["a" * 40])
    assert two.content_hash == hashlib.sha1(b"").hexdigest() and two.last_export_at is None and two.entry_hashes == []


def test_events_of_a_legacy_document(spark, tmp_path):
    events = [{"process_id": f"p{i}", "processed_at": f"2023-01-{1 + i % 28:02d}T00:00:00+00:00", "detected_status": "novo", "highlight_count": i} for i in range(210)]
    document = {
        "books": {
            "k1": {"title": "T", "entry_signature_hashes": ["a" * 40], "last_analysis_at": "2024-01-01T00:00:00Z", "highlight_count": 5, "processing_history": [*events, "no event", 7], "export_history": [{"export_id": "x1", "exported_at": "2023-02-01T00:00:00Z", "formats": ["txt"]}, {"export_id": "x2", "content_signature_hash": "c2"}], "last_export_at": "2023-03-01T00:00:00Z"},
            "k2": {"last_detected_processing": {"process_id": "alone"}, "last_analysis_at": "2024-01-02T00:00:00Z", "processing_history": {"not": "a list"}, "export_history": "none"},
            "k3": "no book",
        }
    }
    path = tmp_path / "history.json"
    path.write_text(json.dumps(document))
    store = history.History(spark, str(tmp_path / "store"))
    store.import_document(str(path))
    done = {(r.book_key, r.process_id): r for r in store.processing().collect()}
    assert sorted(k for k in done if k[0] == "k1") == sorted(("k1", f"p{i}") for i in range(10, 210))
    last = done["k1", "p209"]
    assert (last.processed_at, last.highlight_count, last.entry_hashes) == ("2024-01-01T00:00:00Z", 5, ["a" * 40]) and done["k1", "p50"].highlight_count == 50
    assert done["k2", "alone"].processed_at == "2024-01-02T00:00:00Z" and not [k for k in done if k[0] == "k3"]
    assert {r.export_id: (r.exported_at, r.content_hash) for r in store.exports().collect()} == {"x1": ("2023-02-01T00:00:00Z", None), "x2": ("2023-03-01T00:00:00Z", "c2")}
    books = {r.book_key: r for r in store.books().collect()}
    assert books["k1"].last_analysis_at == "2024-01-01T00:00:00Z" and books["k1"].last_export_signature == "c2" and books["k2"].last_export_at is None
    sane = {r.book_key: r for r in history.sanitise(spark.createDataFrame([(json.dumps(document),)], "value string")).collect()}
    assert set(sane) == {"k1", "k2", "k3"} and (sane["k3"].title, sane["k3"].author) == ("", "Autor desconhecido")


SNAPSHOT = "analysis_id string, book_key string, title string, author string, entry_hashes array<string>, highlight_hashes array<string>, content_hash string, highlight_hash string, highlight_count long, note_count long, bookmark_count long, first_seq long"


def test_twenty_writers_lose_no_event(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def save(i):
        book = spark.createDataFrame([("a", f"book-{i}", "T", "A", [f"{i:040x}"], [], "c", "h", 1, 0, 0, 0), ("a", "shared", "T", "A", [f"{i:040x}"], [], f"c{i}", "h", i, 0, 0, 0)], SNAPSHOT).coalesce(1)
        history.History(spark, str(tmp_path / "store")).record_analysis(book, f"2024-01-01T12:{i:02d}:00+00:00")

    with ThreadPoolExecutor(20) as pool:
        list(pool.map(save, range(20)))
    store = history.History(spark, str(tmp_path / "store"))
    events = store.processing().collect()
    assert len(events) == 40 and len({e.event_no for e in events}) == 20
    assert {r.book_key for r in store.books().collect()} == {"shared", *(f"book-{i}" for i in range(20))}
    # Each writer saw what the one before it had written: the shared book was new once only.
    assert sorted(e.detected_status for e in events if e.book_key == "shared") == ["atualizado"] * 19 + ["novo"]
    assert not list((tmp_path / "store/processing_events/_aside").iterdir())


def test_history_is_trimmed_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "MERGED", 4)
    store = history.History(spark, str(tmp_path / "store"), most=3)
    for i in range(7):
        book = spark.createDataFrame([("a", "k", "T", "A", [f"{i:040x}"], [], f"c{i}", "h", i, 0, 0, 0)], SNAPSHOT).coalesce(1)
        store.record_analysis(book, f"2024-01-0{i + 1}T12:00:00+00:00")
    assert sorted(e.highlight_count for e in store.processing().collect()) == [4, 5, 6]
    assert len(store._processing.names()) <= 5 and store._processing.read().count() < 7
    assert store.books().first().content_hash == "c6"


def test_stored_analyses_are_capped_and_keep_their_settings(spark, tmp_path):
    desk = service.Service(spark, str(tmp_path / "store"))
    desk.opened.most = 2
    mine = Settings.of_request({"includeBookmarks": False, "exportTxt": True, "similarityThreshold": 0.9})
    ids = []
    for i in range(6):
        path = tmp_path / f"up{i}.txt"
        path.write_text(CLIPPINGS + f"Livro {i} (A)\n- Sua nota | posição 5\n\nnota {i}\n==========\n")
        ids.append(desk.analyse(str(path), mine, dt.datetime(2024, 2, 1 + i, tzinfo=dt.UTC))[0].analysis_id)
    assert list(desk.opened.held) == ids[-2:]
    assert [r.filename for r in desk.analyses.list().collect()] == [f"up{i}.txt" for i in (5, 4, 3, 2, 1)]
    assert len(desk.analyses._content.names()) == 5 == len(desk.analyses._index.names())
    with pytest.raises(service.UnknownAnalysis):
        desk.reopen(ids[0])
    held = desk.reopen()
    assert held is desk.opened.held[ids[5]] and held.settings == mine
    other = service.Service(spark, str(tmp_path / "store"))  # after a restart
    found = other.reopen(ids[3])
    assert found.settings.as_request() == mine.as_request() and not found.settings.include_bookmarks
    answer = other.response(found)
    assert (answer["analysisId"], answer["uploadedName"]) == (ids[3], "up3.txt")
    events = other.history.processing().count()
    other.reopen(ids[2])
    assert other.history.processing().count() == events  # reopening records nothing
    assert Settings.of_stored("no json").similarity_threshold == 0.8 and Settings.of_stored('["x"]') == Settings()


CLIPPINGS = "Livro (Silva, Ana)\n- Seu destaque na página 1 | posição 10-12 | Adicionado: 1 de janeiro de 2024\n\nprimeiro\n==========\nOutro (B)\n- Sua nota | posição 5\n\nnota\n==========\n"
MORE = CLIPPINGS + "Livro (Silva, Ana)\n- Seu destaque na página 9 | posição 90-92 | Adicionado: 2 de janeiro de 2024\n\nsegundo\n==========\n"


def test_analyse_export_and_only_what_is_new(spark, tmp_path):
    (tmp_path / "one.txt").write_text(CLIPPINGS)
    (tmp_path / "two.txt").write_text(MORE)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xff")
    desk = service.Service(spark, str(tmp_path / "store"))
    at = dt.datetime(2024, 2, 1, 0, 40, tzinfo=dt.UTC)
    with pytest.raises(service.NotReadable):
        desk.analyse(str(tmp_path / "bad.txt"), SETTINGS)
    with pytest.raises(service.UnknownAnalysis):
        desk.reopen(None, SETTINGS)
    made, rows = desk.analyse(str(tmp_path / "one.txt"), SETTINGS, at)
    assert {r["status"] for r in rows} == {"novo"} and rows[0]["last_analysis_display"] == "2024-01-31 21:40"
    keys = [r["book_key"] for r in rows]
    only_new = SETTINGS.with_changes(export_only_new=True)
    assert zipfile.ZipFile(io.BytesIO(desk.export_zip(made, keys, only_new, at))).namelist() == ["html/livro-ana-silva.html", "html/outro-b.html", "markdown/livro-ana-silva.md", "markdown/outro-b.md"]
    with pytest.raises(service.NothingToExport):
        desk.export_files(made, keys, only_new, at)
    again, rows = desk.analyse(str(tmp_path / "two.txt"), SETTINGS, at + dt.timedelta(days=1))
    assert {r["title"]: (r["status"], r["new_highlights_count"]) for r in rows} == {"Livro": ("com_novidades", 1), "Outro": ("sem_novidades", 0)}
    files = {r.path: r.content for r in desk.export_files(again, keys, only_new, at).collect()}
    assert set(files) == {"markdown/livro-ana-silva.md", "html/livro-ana-silva.html"} and "segundo" in files["markdown/livro-ana-silva.md"] and "primeiro" not in files["markdown/livro-ana-silva.md"]
    events = desk.history.exports().collect()
    assert len(events) == 4 and sorted(e.reexport_without_changes for e in events) == [False, False, False, True]
    assert {e.detected_status for e in desk.history.processing().collect()} == {"novo", "atualizado", "sem_mudancas"}
    assert [r.filename for r in desk.analyses.list().collect()] == ["two.txt", "one.txt"]
    reopened = desk.reopen(None, SETTINGS)
    livro = next(k for k in keys if reopened.entries.filter((F.col("book_key") == k) & (F.col("title") == "Livro")).count())
    assert [r.content for r in reopened.book_entries(livro).collect()] == ["primeiro", "segundo"]
    assert "primeiro" in desk.clip(reopened, livro) and desk.clip(reopened, livro, only_new=True) == ""
    with pytest.raises(service.UnknownBook):
        reopened.book("none")
    with pytest.raises(service.NothingToExport):
        desk.export_files(reopened, ["none"], SETTINGS)
    with pytest.raises(service.NothingToExport):
        desk.export_files(reopened, [], SETTINGS)
    answer = desk.response(reopened)
    assert answer["authorOptions"] == ["Ana Silva", "B"] and answer["statusOptions"][0]["value"] == "todos" and answer["stats"][0]["total_entries"] == 3
    assert [f["filename"] for f in desk.export_book(reopened, livro, SETTINGS.with_changes(strict_marking=True), at)] == ["livro-ana-silva.html", "livro-ana-silva.md"]


def test_written_entries_parse_back(spark):
    from annolith.operators import parsing
    from annolith.sources import clippings

    rows = spark.createDataFrame([(1, 0, "user", "oi\ntudo"), (1, 1, "assistant", "resposta"), (2, 0, "system", "regra")], "conv_id long, turn long, role string, text string")
    entries = adapters.of_conversations(rows)
    got = parsing.entries(parsing.parse(clippings.segments(adapters.clippings_text(entries))))
    same = ["book_key", "type", "title", "author", "start_pos", "end_pos", "content"]
    assert sorted(map(tuple, got.select(same).collect())) == sorted(map(tuple, entries.select(same).collect()))


def test_settings():
    made = Settings.of_request({"exportHtml": True, "exportMarkdown": False, "includeMetadata": False, "similarityThreshold": 0.5, "other": 1}, dt.date(2024, 1, 1))
    assert made.format_labels() == ["html"] and made.similarity_threshold == 0.5 and not made.enabled()[0].include_metadata
    merged = Settings().merged({"include_bookmarks": False, "formats": {"txt": {"enabled": True}}})
    assert merged.format_labels() == ["markdown", "html", "txt"] and not merged.include_bookmarks and merged.similarity_threshold == 0.8


def test_stream_folds_as_the_batch_does(spark, tmp_path):
    from annolith.operators import dedup, parsing
    from annolith.sources import clippings
    from annolith.streaming.fold import fold_stream, read_stream

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text(MORE + MORE.replace("primeiro", "primeiro e mais"))
    stream = fold_stream(parsing.entries(parsing.parse(read_stream(spark, str(inbox)))), SETTINGS)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = dedup.decide(parsing.entries(parsing.parse(clippings.segments(clippings.read_uploads(spark, str(inbox))))), SETTINGS)
    columns = ["book_key", "type", "seq", "action", "reason", "matched_slot"]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))


def test_released_analyses():
    gone = []

    class Held:
        def __init__(self, name):
            self.name = name

        def release(self):
            gone.append(self.name)

    opened = service.Opened(2)
    for name in ("a", "b", "a", "c"):
        opened.get(name, lambda name=name: Held(name))
    assert gone == ["b"] and list(opened.held) == ["a", "c"]


def test_today_is_local():
    from annolith.settings import today_local

    assert today_local(dt.datetime(2024, 3, 5, 2, 0, tzinfo=dt.UTC)) == dt.date(2024, 3, 4)


AGAINST_SQL = ("render_html", "vault_note", "clip_page", "encoded_files", "dedup_crowded", "zip_listing", "folder_files", "history_books", "stored_uploads", "parse_errors", "position_predicates", "settings_forms", "visible_counts")


def test_every_query_has_a_stable_schema(spark):
    from annolith.plans import catalogue

    for name, query in catalogue.queries().items():
        if name not in AGAINST_SQL:
            assert query(spark, "/root/testdata/sf0.001").columns, name
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"character_ratio_pairs", "dedup_survivors", "dedup_report"}


def test_queries_equal_their_sql(spark):
    """Rows of the queries that no other test runs, against DuckDB on the smallest data."""
    duckdb = pytest.importorskip("duckdb")
    from annolith.plans import catalogue

    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for name in ("conversations", "customer", "documents", "events", "orders", "part"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    for name in AGAINST_SQL:
        got = catalogue.queries()[name](spark, folder)
        columns = sorted(got.columns)
        want = connection.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want)), name


def test_folds_without_sql_on_documents(spark):
    """The fold of texts without positions, in a plain loop over file order."""
    from annolith.operators import dedup

    rows = [("highlight", None, None, None, t, None) for t in ("um texto longo o bastante para ser lembrado depois", "outro", "um texto longo o bastante para ser lembrado depois!", "um texto longo o bastante para ser lembrado", "", "", "outra")]
    entries = book(spark, rows)
    got = {r.seq: (r.action, r.matched_slot) for r in dedup.decide(entries, SETTINGS).collect()}
    assert got == {0: ("append", 0), 1: ("append", 1), 2: ("drop", 0), 3: ("drop", 0), 4: ("append", 4), 5: ("drop", 4), 6: ("drop", 1)}
    kept = dedup.survivors(entries, dedup.decide(entries, SETTINGS))
    assert {r.slot_seq for r in kept.collect()} == {s for a, s in got.values() if a == "append"}


def test_the_rest_imports_without_the_corpus_part():
    import subprocess
    import sys
    from pathlib import Path

    # As where the folders are deleted; in a copy, so that nothing here is touched.
    import shutil
    import tempfile

    with tempfile.TemporaryDirectory() as copy:
        root = Path(__file__).resolve().parents[1]
        shutil.copytree(root / "annolith", f"{copy}/annolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", copy)
        code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()"
        subprocess.run([sys.executable, "-c", code], check=True, cwd=copy)


def test_an_archive_is_made_of_pieces_without_the_driver(spark, monkeypatch):
    files = spark.range(60).selectExpr("'a' AS analysis_id", "'txt' AS format", "concat('txt/', lpad(id * 7 % 60, 3, '0'), 'é.txt') AS path", "id AS first_seq", "'b' AS book_key", "repeat(concat('x', id), 50) AS content")
    pieces = sinks.zip_pieces(files).orderBy("place").collect()
    assert [p.place for p in pieces] == list(range(60)) and [p.path for p in pieces] == sorted(p.path for p in pieces)
    data = b"".join(p.member for p in pieces)
    assert all(data[p.start : p.start + len(p.member)] == p.member for p in pieces)
    for most in (sinks.MOST_BYTES, 1000):  # beyond 1000 bytes places are ZIP64
        entries = [sinks._placed(bytes(p.entry), p.start) for p in pieces] if most > 1000 else [_as_zip64(p) for p in pieces]
        directory = b"".join(entries)
        with zipfile.ZipFile(io.BytesIO(data + directory + sinks._end(60, len(directory), len(data)))) as archive:
            assert archive.namelist() == [p.path for p in pieces] and archive.testzip() is None
    monkeypatch.setattr(type(files), "toLocalIterator", None)
    listed = sinks.zip_listing(sinks.zip_pieces(files)).orderBy("place")
    assert [(r.path, r.deflated) for r in listed.select("path", "deflated").collect()] == [(p.path, True) for p in pieces]
    assert sinks.zip_pieces(files.limit(0)).count() == 0


def _as_zip64(piece):
    """The piece's entry as it would be with a place beyond 4 GB, put back to its own place."""
    far = 1 << 33
    entry = sinks._placed(bytes(piece.entry), far + piece.start)
    return entry[:-8] + (int.from_bytes(entry[-8:], "little") - far).to_bytes(8, "little")
