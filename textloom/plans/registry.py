"""Names under which parsers, chunkers, embedders and language models are found."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("parser", "chunker", "embedder", "llm", "retriever")


class Registry:
    """A table of callables by kind and name; unknown names raise ``ValueError``."""

    def __init__(self) -> None:
        self._known: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}

    def register(self, kind: str, name: str, value: Callable) -> None:
        self._of(kind)[name.lower()] = value

    def get(self, kind: str, name: str) -> Callable:
        table = self._of(kind)
        if name.lower() not in table:
            raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(table)) or 'none'}")
        return table[name.lower()]

    def has(self, kind: str, name: str) -> bool:
        return name.lower() in self._of(kind)

    def names(self, kind: str) -> list[str]:
        return sorted(self._of(kind))

    def unregister(self, kind: str, name: str) -> None:
        self._of(kind).pop(name.lower(), None)

    def _of(self, kind: str) -> dict[str, Callable]:
        if kind not in self._known:
            raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
        return self._known[kind]
