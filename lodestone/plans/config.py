"""Settings: dataclasses, read from YAML, with the environment for the token."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

PROJECT_ROOT = Path(__file__).resolve().parents[2]
PACKAGE = Path(__file__).resolve().parents[1]
TOKEN_VARIABLE = "SWH_BEARER_TOKEN"


def environment(name: str, folder: Path | None = None) -> str | None:
    """A variable of the process, or else of a file named .env in folder (the working directory, then the project's)."""
    if name in os.environ:
        return os.environ[name]
    for place in (folder,) if folder else (Path.cwd(), PROJECT_ROOT):
        if (place / ".env").is_file():
            for line in (place / ".env").read_text().splitlines():
                key, found, value = line.strip().removeprefix("export ").partition("=")
                if found and key.strip() == name:
                    return value.strip().strip("\"'")
    return None


# Defaults of the settings.
@dataclass
class DatasetConfig:
    s3_url: str = "s3://softwareheritage/graph/2019-01-28-popular-3k-python/parquet/"
    dataset_name: str = "2019-01-28-popular-3k-python"
    parallelism: int = 5
    auto_download: bool = True
    in_place: bool = False  #: read the source where it is instead of copying it


@dataclass
class BatchConfig:
    batch_size: int = 4  #: repositories that a task of the walk starts with

    def __post_init__(self):
        if self.batch_size < 1:
            raise ValueError("batch_size is less than 1")


@dataclass
class ApiConfig:
    base_url: str = "https://archive.softwareheritage.org/api/1"
    max_concurrent: int = 10
    requests_per_hour: int = 120
    timeout: int = 30
    max_retries: int = 3
    bearer_token: str | None = field(default_factory=lambda: environment(TOKEN_VARIABLE))
    max_files: int | None = None
    store: str = "auto"  #: contents as "files" in a mounted folder, as a "table" in any store, or "auto": files where they can be
    wave: int = 10_000  #: files that are asked for before their outcomes are kept for good

    def __post_init__(self):
        if self.store not in ("auto", "files", "table"):
            raise ValueError(f"store: {self.store!r} is none of auto, files, table")
        if self.wave < 1:
            raise ValueError("wave is less than 1")

    @property
    def headers(self) -> dict[str, str]:
        out = {"Accept": "application/json", "User-Agent": "lodestone/1.0"}
        if self.bearer_token:
            out["Authorization"] = f"Bearer {self.bearer_token}"
        return out

    @property
    def hourly(self) -> int:
        """Requests an hour: a token raises them to 1200."""
        return 1200 if self.bearer_token else self.requests_per_hour


@dataclass
class SelectConfig:
    file_extensions: list[str] = field(default_factory=lambda: [".py"])
    file_patterns: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Layout:
    """Places of the data, each a URI or an absolute path that Hadoop can open."""

    tables: str  #: the archive's tables, a folder each
    metadata: str  #: what parse writes
    outcomes: str  #: what download writes
    contents: str  #: fetched files, or the table of contents
    history: str  #: every run's outcomes
    logs: Path  #: always on this machine

    @classmethod
    def below(cls, root: str, dataset: str) -> Layout:
        remote = "://" in root and not root.startswith("file:")
        home = root.rstrip("/") if "://" in root else str((PROJECT_ROOT / root).resolve())
        logs = PROJECT_ROOT / "logs" if remote else Path(home.removeprefix("file://")) / "logs"
        return cls(f"{home}/raw/{dataset}", f"{home}/processed/file_metadata.parquet", f"{home}/processed/download_stats.parquet", f"{home}/content", f"{home}/processed/download_history", logs)


@dataclass
class Config:
    data_dir: str = "data"
    s3_dataset: DatasetConfig = field(default_factory=DatasetConfig)
    batch: BatchConfig = field(default_factory=BatchConfig)
    swh_api: ApiConfig = field(default_factory=ApiConfig)
    processing: SelectConfig = field(default_factory=SelectConfig)

    def layout(self) -> Layout:
        return Layout.below(self.data_dir, self.s3_dataset.dataset_name)

    def shown(self) -> dict:
        """The settings for a log, without the token."""

        def plain(x):
            if is_dataclass(x):
                return {f.name: "***" if f.name == "bearer_token" and getattr(x, f.name) else plain(getattr(x, f.name)) for f in fields(x)}
            return x

        return plain(self)


#: Names that a file may use for a section.
_ALIASES = {"ray": "batch"}


def from_dict(values: dict) -> Config:
    """A Config from nested mappings; unknown keys are ignored, and values must have the default's type."""

    def build(cls, given: dict):
        out = cls()
        for f in fields(cls):
            if f.name not in given:
                continue
            value, now = given[f.name], getattr(out, f.name)
            if is_dataclass(now):
                value = build(type(now), value or {})
            elif now is not None and value is not None and not isinstance(value, type(now)):
                raise ValueError(f"{f.name}: {value!r} is not of type {type(now).__name__}")
            setattr(out, f.name, value)
        if hasattr(out, "__post_init__"):
            out.__post_init__()
        return out

    return build(Config, {_ALIASES.get(k, k): v for k, v in values.items()})


def load_config(path: str | Path = "config/config.yaml") -> Config:
    """Settings from a YAML file, by default the package's own. An empty file gives the defaults; a missing one is an error."""
    import yaml

    with open(PACKAGE / path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})
