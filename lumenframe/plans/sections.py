"""Report sections that are computed when they are first asked for, and kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping


class Sections(Mapping):
    """A mapping of names to frames; each is made once, on first access."""

    def __init__(self) -> None:
        self._make: dict[str, Callable] = {}
        self._made: dict = {}

    def add(self, name: str, make: Callable) -> None:
        self._make[name] = make

    def __getitem__(self, name: str):
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._make

    def __iter__(self) -> Iterator[str]:
        return iter(self._make)

    def __len__(self) -> int:
        return len(self._make)
