"""What an adapter returns, and the registry of adapters."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

SYMBOLS = "file_path string, name string, kind string, signature string, start_line int, end_line int, is_exported boolean, is_default boolean, source_code string, extends_name string, implements_names array<string>, ordinal int"
IMPORTS = "file_path string, module_specifier string, kind string, bindings array<struct<imported:string,local:string>>, line int"
CALLS = "file_path string, name string, line int, owner string"
REFS = "file_path string, name string, line int, owner string"


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    exported: bool
    source: str
    signature: str = ""
    default: bool = False
    extends: str | None = None
    implements: list[str] = field(default_factory=list)


@dataclass
class Import:
    module: str
    kind: str  # named, default, namespace, require, side-effect
    bindings: list[tuple[str, str]]
    line: int


@dataclass
class Facts:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    calls: list[tuple[str, int, str | None]] = field(default_factory=list)  # name, line, owner
    refs: list[tuple[str, int, str | None]] = field(default_factory=list)


class Adapter(Protocol):
    def parse(self, path: str, source: str) -> Facts: ...


ADAPTERS: dict[str, Adapter] = {}


def register(language: str, adapter: Adapter) -> None:
    ADAPTERS[language] = adapter


def adapter(language: str) -> Adapter | None:
    if not ADAPTERS:
        from lodegraph.parse import curly, python

        register("python", python.Python())
        register("typescript", curly.Script())
        register("javascript", curly.Script())
        register("go", curly.Go())
        register("java", curly.Java())
    return ADAPTERS.get(language)


def owner_at(symbols: list[Symbol], line: int) -> str | None:
    """The innermost symbol that spans the line."""
    around = [s for s in symbols if s.start <= line <= s.end]
    return min(around, key=lambda s: (s.end - s.start, -s.start)).name if around else None
