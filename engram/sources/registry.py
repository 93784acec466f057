"""Named sources: where their files are and which parser reads them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from . import parsers
from .files import read_files, skipped_files

#: Literal facts of the last source, as (section, text); a deployment writes its own.
STATIC = (("infrastructure", "Points of this collection are written by one ingest job at a time."), ("infrastructure", "Backups of deleted points are kept as JSON lines beside the collection."))


@dataclass(frozen=True)
class Source:
    """Files and their parser; without a path the parser gets none and makes its facts itself."""

    path: str | None
    parser: Callable[[DataFrame], DataFrame]
    mode: str = "replace"
    pattern: str | None = None
    recursive: bool = False
    exclude: tuple[str, ...] = ()

    def files(self, spark: SparkSession) -> DataFrame | None:
        return read_files(spark, self.path, self.pattern, self.recursive, self.exclude) if self.path else None

    def skipped(self, spark: SparkSession) -> list[str]:
        """A line for each file that holds no text."""
        if not self.path:
            return []
        return [f"skipped {r.path}: {r.reason}" for r in skipped_files(spark, self.path, self.pattern, self.recursive, self.exclude).toLocalIterator()]


def default_sources(spark: SparkSession, config: Config) -> dict[str, Source]:
    """The six sources by name, over the paths of the configuration."""
    return {
        "vps-docs": Source(os.path.expanduser(config.docs), parsers.markdown_facts),
        "changelog": Source(config.changelog, parsers.changelog_facts, mode="append"),
        "instructions": Source(config.www_root, lambda f: parsers.project_facts(f, config.www_root), pattern="{INSTRUKCJA*,README.md}", recursive=True, exclude=("node_modules", ".git")),
        "nginx": Source(config.proxy_dir, parsers.proxy_facts, exclude=("default",)),
        "systemd": Source(config.unit_dir, parsers.service_facts, pattern="*.service"),
        "infrastructure": Source(None, lambda _: parsers.static_facts(spark, list(STATIC))),
    }


def ingest_all(engine, sources: dict[str, Source], only: str | None = None, replace: bool = False, report: Callable[[str], None] = lambda _: None) -> dict[str, int | str]:
    """Points offered by each source; a source that fails is reported by its error and the others go on.

    replace clears a source that otherwise only gains what is new; report gets a line for each file left out.
    """
    if only and only not in sources:
        raise KeyError(f"unknown source {only}; there are {', '.join(sources)}")
    done: dict[str, int | str] = {}
    for name, source in sources.items():
        if only in (None, name):
            try:
                files = source.files(engine.spark)
                for line in source.skipped(engine.spark):
                    report(line)
                done[name] = engine.ingest(source.parser(files), "replace" if replace else source.mode, files)
            except Exception as e:  # one source's failure must not stop the rest
                done[name] = f"{type(e).__name__}: {e}"[:300]
    return done
