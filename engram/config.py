"""Settings of one collection."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """time_aware defaults to whether the collection's name ends in -v2; such vectors carry eight time features.

    embedder names what loads the embedding model, as module:function: called without arguments, it gives a function from a
    list of texts to vectors. Without one, words are hashed.
    """

    collection: str = "memory"
    base_dim: int = 384
    metric: str = "cosine"
    time_aware: bool | None = None
    decay: float = 0.01
    limit: int = 10
    overshoot: int = 3
    time_zone: str = "UTC"
    fallback_date: str = "2026-05-01"
    blacklist: tuple[str, ...] = ()
    special_paths: dict[str, str] = field(default_factory=dict)
    path_map: dict[str, str] = field(default_factory=dict)
    www_root: str = "/var/www"
    docs: str = "~/SERVER.md"
    changelog: str = "CHANGELOG.md"
    proxy_dir: str = "/etc/nginx/sites-enabled"
    unit_dir: str = "/etc/systemd/system"
    embedder: str = ""

    def __post_init__(self):
        if not self.collection:
            raise ValueError("a collection needs a name")
        if self.time_aware is None:
            object.__setattr__(self, "time_aware", self.collection.endswith("-v2"))

    @property
    def dim(self) -> int:
        return self.base_dim + (8 if self.time_aware else 0)

    @classmethod
    def from_settings(cls, spark=None, environ: Mapping[str, str] | None = None, **given) -> Config:
        """Settings given here, else spark.engram.<name> of the session, else ENGRAM_<NAME> of the environment, else
        the defaults. COLLECTION_NAME names the collection too. blacklist is a value a line; special_paths and path_map
        are objects in JSON."""
        environ = os.environ if environ is None else environ
        found: dict[str, object] = {}
        for name, kind in (("collection", str), ("base_dim", int), ("decay", float), ("limit", int), ("time_zone", str), ("fallback_date", str), ("www_root", str), ("docs", str), ("changelog", str), ("proxy_dir", str), ("unit_dir", str), ("embedder", str), ("blacklist", lambda v: tuple(filter(None, v.split("\n")))), ("special_paths", json.loads), ("path_map", json.loads)):
            value = (spark.conf.get(f"spark.engram.{name}", None) if spark is not None else None) or environ.get(f"ENGRAM_{name.upper()}")
            if value is None and name == "collection":
                value = environ.get("COLLECTION_NAME")
            if value:
                found[name] = kind(value)
        return cls(**(found | {k: v for k, v in given.items() if v is not None}))
