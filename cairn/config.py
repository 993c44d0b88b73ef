"""Process-wide defaults of collections, ceilings on what they store, and the version."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field, fields

from cairn.errors import CairnError, invalid

VERSION = (0, 2, 0)
#: How commits are made durable, and how index files are read. Both are checked and kept; a
#: commit here is always a whole one, and Spark's file sources read the files.
DURABILITY = ("always", "interval", "manual")
IO_BACKENDS = ("positioned", "mmap")


@dataclass(frozen=True)
class Ceilings:
    """Most bytes of what a collection stores; more is ``resource_exhausted``. The defaults are fixed values for
    one workstation; None is unlimited, and collections without ceilings (the default) have none."""

    #: One checkpoint, when it is written and when it is opened.
    snapshot_bytes: int | None = 8 << 30
    #: The derived tables of one field.
    index_cache_bytes: int | None = 8 << 30
    #: The parts since the last checkpoint, when they are opened.
    wal_replay_bytes: int | None = 8 << 30
    #: The graph of one disk index.
    diskann_file_bytes: int | None = 512 << 20

    def __post_init__(self) -> None:
        for f in fields(self):
            if (most := getattr(self, f.name)) is not None and most <= 0:
                raise invalid(f"{f.name} must be positive")

    def admit(self, name: str, size: int) -> None:
        """An error if ``size`` is above the ceiling of this name."""
        if (most := getattr(self, name)) is not None and size > most:
            raise CairnError("resource_exhausted", f"{size} bytes exceed {name} of {most}")


NO_CEILINGS = Ceilings(None, None, None, None)


@dataclass(frozen=True)
class Config:
    """Defaults that a collection takes over when it is created or opened."""

    durability: str = "always"
    #: A change checkpoints the collection when so many parts, or bytes of parts, follow the last checkpoint;
    #: 0 and None are never.
    checkpoint_parts: int | None = None
    checkpoint_bytes: int | None = None
    io_backend: str = "positioned"
    ceilings: Ceilings = field(default_factory=lambda: NO_CEILINGS)

    def __post_init__(self) -> None:
        if self.durability not in DURABILITY:
            raise invalid(f"unknown durability {self.durability!r}")
        if self.io_backend not in IO_BACKENDS:
            raise invalid(f"unknown io_backend {self.io_backend!r}")
        for name in ("checkpoint_parts", "checkpoint_bytes"):
            value = getattr(self, name)
            if value is not None and value < 0:
                raise invalid(f"{name} must not be negative")
            object.__setattr__(self, name, value or None)


_mutex = threading.Lock()
_chosen: Config | None = None


def initialize(config: Config | None = None) -> None:
    """Set the defaults of collections opened from now on; open ones keep theirs."""
    global _chosen
    with _mutex:
        _chosen = config or Config()


def shutdown() -> None:
    """Back to the built-in defaults."""
    global _chosen
    with _mutex:
        _chosen = None


def is_initialized() -> bool:
    return _chosen is not None


def current() -> Config:
    return _chosen or Config()


def version() -> str:
    return ".".join(map(str, VERSION))


def check_version(major: int, minor: int = 0, patch: int = 0) -> bool:
    """Whether this version is at least the one given."""
    return (major, minor, patch) <= VERSION
