"""Settings as plain values; importing them touches no file."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class StoreSettings:
    """How a collection is indexed and searched; without ``lists`` and ``probes`` they follow the size and the measured recall."""

    metric: str = "IP"
    index: str = "Flat"
    lists: int | None = None
    probes: int | None = None
    top_k: int = 5
    normalise: bool = True


@dataclass(frozen=True)
class Settings:
    """Settings of one run."""

    data: Path = Path("data")
    experiment: str = "experiment"
    provider: str = "hash"
    kind: str = "text"
    coverage_threshold: float = 0.15
    section_size: int = 1000
    code_size: int = 1500
    least_code: int = 100
    ks: tuple[int, ...] = (1, 3, 5, 10)
    stores: dict[str, StoreSettings] = field(default_factory=lambda: {"file": StoreSettings()})

    def store(self, name: str) -> StoreSettings:
        """Settings of a named store; ValueError for an unknown one."""
        if name not in self.stores:
            raise ValueError(f"unknown store {name!r}")
        return self.stores[name]

    def chunks_path(self, given: str | None = None) -> Path:
        """Where chunks lie: the default, an absolute or existing path, or a name below the data folder."""
        if given is None:
            return self.data / "chunks" / self.experiment
        path = Path(given)
        if path.is_absolute() or path.exists():
            return path
        if path.parts[0] == self.data.name:
            return self.data.parent / path
        return self.data / path if path.parts[0] == "chunks" else self.data / "chunks" / path

    def collection_path(self) -> Path:
        """Where the collection lies."""
        return self.data / "collections" / self.experiment

    def with_store(self, name: str, **changes: object) -> Settings:
        """The same settings with one store's values changed."""
        return replace(self, stores={**self.stores, name: replace(self.store(name), **changes)})


def top_k(given: int | None, settings: StoreSettings) -> int:
    """The given number of hits; none and 0 mean the store's."""
    return given or settings.top_k
