"""Segments and entries: the cases that clippings files have shown."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from annolith.functions import dates, keys, text
from annolith.operators import parsing
from annolith.sources import clippings

EXCERPT = (
    "﻿O Farol de Vidro (Prado, Helena M.)\n- Seu destaque na página 8 | posição 114-131 | Adicionado: terça-feira, 9 de novembro de 2021 07:12:44\n\nUm trecho\ncom duas linhas\n==========\n"
    "O Farol de Vidro (Prado, Helena M.)\n- Sua nota na página 9 | posição 131 | Adicionado: terça-feira, 9 de novembro de 2021 07:15:02\n\nUma nota\n==========\n"
    "Livro Sem Autor\n- Seu marcador ou posição 101-99 | Adicionado: 31 de fevereiro de 2024\n\n\n==========\n"
    "só uma linha\n==========\n  \n==========\n"
    "T - Ana Maria – Ana Maria (Ana Maria)\n- Your Highlight on page 3 | location 7-9 | Added on Friday\n\nx\n==========\n"
)


def uploads(spark, *texts):
    rows = [(f"a{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "analysis_id string, text string")


def parsed(spark, content):
    return parsing.parse(clippings.segments(uploads(spark, content))).orderBy("seq").collect()


def test_excerpt(spark):
    got = parsed(spark, EXCERPT)
    first, second, third, last = got
    assert (first.title, first.author, first.type, first.page, first.start_pos, first.end_pos) == ("O Farol de Vidro", "Helena M. Prado", "highlight", 8, 114, 131)
    assert first.content == "Um trecho\ncom duas linhas" and first.date_obj == dt.datetime(2021, 11, 9) and first.date_formatted == "9 de novembro de 2021"
    assert (second.type, second.start_pos, second.end_pos) == ("note", 131, 131)
    assert third.is_error and not first.is_error  # no calendar has 31 February
    assert (last.title, last.author, last.type, last.start_pos, last.end_pos) == ("T - Ana Maria", "Ana Maria", "unknown", 7, 9)
    assert last.date_obj is None and last.date_formatted == last.metadata_line
    assert first.book_key == second.book_key != last.book_key


def test_errors_are_counted_and_dropped(spark):
    rows = parsing.parse(clippings.segments(uploads(spark, EXCERPT)))
    assert parsing.entries(rows).count() == 3 and parsing.errors(rows).first().errors == 1


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Livro (Silva, João)", ("Livro", "João Silva")),
        ("Livro (Silva,)", ("Livro", " Silva")),
        ("Livro", ("Livro", "Autor desconhecido")),
        ("Livro - João Silva (Silva, João)", ("Livro", "João Silva")),
        ("Livro (um) (dois)", ("Livro (um)", "dois")),
        ("A (b, c, d)", ("A", "c, d b")),
        ("Livro ()", ("Livro ()", "Autor desconhecido")),
        ("TÃ­tulo (JosÃ©)", ("Título", "José")),
    ],
)
def test_title_and_author(spark, line, want):
    rows = parsed(spark, f"{line}\n- Seu destaque\n\nx\n==========")
    assert (rows[0].title, rows[0].author) == want


def test_the_year_zero_is_an_error(spark):
    rows = parsed(spark, "T (A)\n- Seu destaque | posição 1 | 1 de janeiro de 0000\n\nx\n==========\nT (A)\n- Seu destaque | posição 1 | 1 de janeiro de 0001\n\nx\n==========")
    assert [r.is_error for r in rows] == [True, False]


@pytest.mark.parametrize("meta", ["na página 12 | posição 20-25 |", "na pÃ¡gina 12 | posiÃ§Ã£o 20-25 |", "NA PÁGINA 12 | Location: 20-25"])
def test_positions_of_repaired_lines(spark, meta):
    rows = parsed(spark, f"T (A)\n- Seu destaque {meta}\n\nx\n==========")
    assert (rows[0].page, rows[0].start_pos, rows[0].end_pos) == (12, 20, 25)


def test_unreadable_uploads_are_set_aside(spark, tmp_path):
    (tmp_path / "good.txt").write_text(EXCERPT, encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00x")
    found = clippings.read_uploads(spark, str(tmp_path))
    assert clippings.quarantined(found).count() == 1
    assert parsing.parse(clippings.segments(found)).count() == 4


def test_normal_forms_differ():
    raw = "  Ação—№  ﬁm, ÇÉ! "
    assert text.comparison_form(raw) == "acao fim ce"
    assert text.key_form(raw) == "ação—no fim, çé!"
    assert text.matching_form(raw).endswith("fim, ce!")
    assert text.slug('A  B: "É"? /x') == "a-b-e-x"
    assert text.repaired("Ã©") == "é" and text.repaired("Ãx") == "Ãx" and text.repaired("â\x80\x9cĀ") == "â\x80\x9cĀ" and text.repaired("â\x80\x9c") == "\u201c"
    for raw in ("TÃ\xadtulo Ã", "é", "Ã\x80", "", None, "â", "Ã¯Â¿Â½", "ï¿½Ã©"):
        try:
            want = (raw or "").encode("latin-1").decode() if set("Ãâ") & set(raw or "") else raw or ""
        except UnicodeError:
            want = raw
        assert text.repaired(raw) == want
    assert len(text.slug("x" * 300)) == 100


def test_signatures_print_none_for_missing_values(spark):
    rows = spark.createDataFrame([("note", None, 2, None, " A  b ")], "type string, start_pos long, end_pos long, page long, content string")
    got = rows.select(keys.entry_signature(text.key_text(F.col("content"))).alias("e"), keys.highlight_signature(text.key_text(F.col("content"))).alias("h")).first()
    assert (got.e, got.h) == ("note|None|2|None|a b", "note|None|2|a b")


def test_clean_hashes(spark):
    sha = "A" * 40
    rows = spark.createDataFrame([([f" {sha} ", "x", None, "", "x"],)], "v array<string>")
    import hashlib

    assert rows.select(keys.clean_hashes(F.col("v")).alias("c")).first().c == sorted([sha.lower(), hashlib.sha1(b"x").hexdigest()])


def test_iso_dates(spark):
    texts = ["2024-01-01T12:00:00Z", "2024-01-01T12:00:00+00:00", "2024-01-01T09:00:00-03:00", "2024-01-01T12:00", "2024-01-01", "soon", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r.d for r in rows.select(dates.display(F.col("t")).alias("d")).collect()] == ["2024-01-01 09:00"] * 4 + ["2023-12-31 21:00", "-", "-", "-"]
