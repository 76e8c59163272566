"""Settings of an analysis. Values are bound into plans as literals, the clock included."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from datetime import UTC, date, datetime, timedelta, timezone
from typing import Any
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

# Words and labels that results must carry.
UNKNOWN_AUTHOR = "Autor desconhecido"
UNKNOWN_PERIOD = "Período desconhecido"
APP_TIMEZONE = "America/Sao_Paulo"
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
STATUS_LABELS = {"novo": "Novo", "nunca_exportado": "Pendente", "com_novidades": "Alterado", "sem_novidades": "Exportado"}
STATUS_ORDER = ("novo", "com_novidades", "nunca_exportado", "sem_novidades")
FILTER_LABELS = {"todos": "Todos", "novo": "Novo", "nunca_exportado": "Pendente", "com_novidades": "Alterado", "sem_novidades": "Exportado", "selecionados": "Selecionado"}
HISTORY_KEPT = 200
ANALYSES_KEPT = 5


def today_local(now: datetime | None = None) -> date:
    """Today in the application's time zone; three hours behind UTC where the system knows no time zones."""
    now = now or datetime.now(UTC)
    try:
        return now.astimezone(ZoneInfo(APP_TIMEZONE)).date()
    except ZoneInfoNotFoundError:
        return now.astimezone(timezone(timedelta(hours=-3))).date()


@dataclass(frozen=True)
class Format:
    """One export format: whether it is made, its metadata header, its folder and file extension."""

    name: str
    enabled: bool
    include_metadata: bool
    extension: str

    @property
    def folder(self) -> str:
        return self.name


def _formats() -> tuple[Format, ...]:
    return (
        Format("markdown", True, True, "md"),
        Format("html", True, True, "html"),
        Format("txt", False, False, "txt"),
        Format("obsidian", False, True, "md"),
    )


@dataclass(frozen=True)
class Settings:
    remove_duplicates: bool = True
    similarity_threshold: float = 0.8
    position_overlap_ratio: float = 0.60
    token_overlap_threshold: float = 0.75
    session_window_minutes: float = 15
    include_bookmarks: bool = True
    export_only_new: bool = False
    formats: tuple[Format, ...] = field(default_factory=_formats)
    today: date = field(default_factory=today_local)
    #: Mark exactly the books and entries that were exported; False marks what was asked for, with the store's latest hashes.
    strict_marking: bool = False

    def with_changes(self, **changes: Any) -> Settings:
        return replace(self, **changes)

    def enabled(self) -> list[Format]:
        return [f for f in self.formats if f.enabled]

    @classmethod
    def of_request(cls, payload: dict[str, Any], today: date | datetime | None = None) -> Settings:
        """From the flat camel-case form that clients send; unknown names are ignored, missing ones take defaults."""
        flag = lambda name, default: bool(payload.get(name, default))
        metadata = flag("includeMetadata", True)
        wanted = {"markdown": flag("exportMarkdown", True), "html": flag("exportHtml", False), "txt": flag("exportTxt", False), "obsidian": flag("exportObsidian", False)}
        formats = tuple(replace(f, enabled=wanted[f.name], include_metadata=metadata) for f in _formats())
        numbers = {
            "similarity_threshold": "similarityThreshold",
            "position_overlap_ratio": "dedupPositionOverlapRatio",
            "token_overlap_threshold": "dedupTokenOverlapThreshold",
            "session_window_minutes": "dedupSessionWindowMinutes",
        }
        found = {ours: float(payload[theirs]) for ours, theirs in numbers.items() if theirs in payload}
        clock = {"today": today.date() if isinstance(today, datetime) else today} if today else {}
        return cls(remove_duplicates=flag("removeDuplicates", True), include_bookmarks=flag("includeBookmarks", True), export_only_new=flag("exportOnlyNew", False), formats=formats, **found, **clock)

    def as_request(self) -> dict[str, Any]:
        """The flat form that of_request reads; the clock and strict marking are not part of it."""
        on = {f.name: f.enabled for f in self.formats}
        return {
            "removeDuplicates": self.remove_duplicates,
            "includeBookmarks": self.include_bookmarks,
            "includeMetadata": any(f.include_metadata for f in self.formats if f.name != "txt"),
            "exportOnlyNew": self.export_only_new,
            **{f"export{n.capitalize()}": on.get(n, False) for n in ("markdown", "html", "txt", "obsidian")},
            "similarityThreshold": self.similarity_threshold,
            "dedupPositionOverlapRatio": self.position_overlap_ratio,
            "dedupTokenOverlapThreshold": self.token_overlap_threshold,
            "dedupSessionWindowMinutes": self.session_window_minutes,
        }

    @classmethod
    def of_stored(cls, text: str | None) -> Settings:
        """From what was stored with an analysis; defaults where that cannot be read."""
        try:
            return cls.of_request(json.loads(text or "{}"))
        except (ValueError, TypeError, AttributeError):
            return cls()

    def merged(self, override: dict[str, Any]) -> Settings:
        """With a nested override applied: plain fields by name, formats by name and field; the rest stays."""
        plain = {f.name for f in fields(self)} - {"formats"}
        formats = tuple(replace(f, **{k: v for k, v in override.get("formats", {}).get(f.name, {}).items() if hasattr(f, k) and k != "folder"}) for f in self.formats)
        return replace(self, formats=formats, **{k: v for k, v in override.items() if k in plain})

    def format_labels(self) -> list[str]:
        return [f.name for f in self.enabled()]
