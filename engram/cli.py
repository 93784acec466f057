"""Command line over MemoryEngine. Changes are previews unless --yes is given."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .engine import Change, MemoryEngine
from .sources.registry import default_sources, ingest_all

CHANGES = {"edit", "edit-payload", "update-vector", "reindex-source", "dedupe", "delete-id", "delete-source", "delete-text", "delete-fragment"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="engram")
    p.add_argument("--root", required=True)
    p.add_argument("--collection", help="else spark.engram.collection, ENGRAM_COLLECTION or COLLECTION_NAME")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple, **options) -> None:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a[0], **(a[1] if len(a) > 1 else {}))
        if name in CHANGES:
            either = c.add_mutually_exclusive_group()
            either.add_argument("--yes", action="store_true")
            either.add_argument("--dry-run", action="store_true")

    for name in ("setup", "stats", "sources", "find-dupes", "index"):
        add(name)
    ingest = [("source", {"nargs": "?"}), ("--replace", {"action": "store_true"}), ("--sequential", {"action": "store_true"})]
    add("ingest", *ingest, *[(f"--{x}", {}) for x in ("docs", "changelog", "www-root", "proxy-dir", "unit-dir")])
    add("search", ("text",), ("limit", {"nargs": "?", "type": int}), ("--all", {"action": "store_true"}), ("--indexed", {"action": "store_true"}), ("--since",), ("--window", {"type": lambda s: float(s.rstrip("d"))}))
    add("store", ("text",), ("source", {"nargs": "?", "default": "manual"}))
    add("backup", ("path", {"nargs": "?"}))
    add("show", ("id",))
    add("list-source", ("source",), ("--limit", {"type": int, "default": 50}))
    add("find-by-file", ("path",))
    add("edit", ("id",), ("--text",))
    add("edit-payload", ("id",), ("pairs", {"nargs": "+"}))
    add("update-vector", ("id",))
    add("reindex-source", ("source",))
    add("dedupe")
    add("delete-id", ("ids", {"nargs": "+"}))
    add("delete-source", ("source",))
    add("delete-text", ("text",))
    add("delete-fragment", ("text", {"nargs": "?"}), ("--regex",), ("--source",))
    return p


def _pairs(given: list[str], said: list[str]) -> dict[str, str]:
    """key=value pairs; what is none is named and left out."""
    for p in given:
        if "=" not in p:
            said.append(f"left out {p!r}: key=value is needed")
    return dict(p.split("=", 1) for p in given if "=" in p)


def _ingest(spark: SparkSession, e: MemoryEngine, a: argparse.Namespace) -> str:
    """A line for each source. Sources are ingested one after the other, each a job of its own that holds no other's
    rows; --sequential, by which other tools save memory, is accepted and changes nothing."""
    said: list[str] = []
    done = ingest_all(e, default_sources(spark, e.config), a.source, a.replace, said.append)
    lines = [f"{name}: {n} facts" if isinstance(n, int) else f"{name}: failed: {n}" for name, n in done.items()]
    ready = sum(isinstance(n, int) for n in done.values())
    return "\n".join([*said, *lines, f"{ready} of {len(done)} sources ready"])


def _hit(r) -> list[str]:
    age = "-" if r.age_days is None else f"{r.age_days:.0f}d"
    return [f"score={r.final_score:.3f} ({age}) ID={r.id}  src={r.source or '?'}", f"    text: {(r.text or '')[:120]}"]


def _shown(e: MemoryEngine, point_id: str) -> str:
    keys = {r.key: r.value for r in e.show(point_id).toLocalIterator()}
    head, dim = f"ID: {keys.pop('id')} ({keys.pop('id_type')})", keys.pop("dim")
    return "\n".join([head, *(f"  {k}: {v}" for k, v in keys.items()), f"  vector dim: {dim}"])


def _stats(e: MemoryEngine) -> str:
    rows = e.stats().collect()  # a row for each source
    if not rows:
        return ""
    lines = [f"{'source':22s} {'count':>5s} {'ts_epoch':>9s} {'no_ts':>8s}", *(f"{r.source:22s} {r['count']:5d} {r.with_ts:9d} {r.no_ts:8d}" for r in rows)]
    return "\n".join([f"Total points: {sum(r['count'] for r in rows)}", *lines])


def _listed(e: MemoryEngine, source: str, limit: int) -> str:
    about, rows = e.list_source_dated(source, limit)
    lines = [f"Source '{source}': {about.total} points", *(f"  ID={r.id}  date={r.date or '-':12s} {r.text[:80]}" for r in rows.collect())]
    return "\n".join([*lines, *([f"  ... (+{about.more} more, use --limit)"] if about.more else [])])


def _by_file(e: MemoryEngine, path: str) -> str:
    found = e.find_by_file(path)
    lines = [f"  [{r.date}] ID={r.id}  {(r.text or '')[:80]}" for r in found.toLocalIterator()]
    return "\n".join([f"File '{path}': {len(lines)} points", *lines])


def _dupes(e: MemoryEngine) -> str:
    found = e.find_dupes()
    total = found.agg(F.countDistinct("group").alias("groups"), F.count("*").alias("points")).first()
    if not total.groups:
        return "  No duplicates"
    lines, last = [f"Found {total.groups} duplicate groups ({total.points} points total):"], None
    for r in found.orderBy("group", "id").toLocalIterator():
        if r.group != last:
            lines.append(f"  Group ({r.group_size} points):")
            last = r.group
        lines.append(f"    [{r.date}] ID={r.id} src={r.source} {r.head}")
    return "\n".join(lines)


def run(spark: SparkSession, argv: list[str] | None = None) -> str:
    a = parser().parse_args(argv)
    paths = {k: getattr(a, k, None) for k in ("docs", "changelog", "www_root", "proxy_dir", "unit_dir")}
    e = MemoryEngine(spark, a.root, Config.from_settings(spark, collection=a.collection, **paths))
    said: list[str] = []
    calls = {
        "setup": lambda: "made" if e.setup() else "exists",
        "ingest": lambda: _ingest(spark, e, a),
        "search": lambda: "\n".join(line for r in e.search(a.text, a.limit, not a.all, a.since, a.window, indexed=a.indexed).collect() for line in _hit(r)),
        "store": lambda: e.store(a.text, a.source),
        "backup": lambda: e.backup(a.path),
        "show": lambda: _shown(e, a.id),
        "stats": lambda: _stats(e),
        "sources": e.sources,
        "index": lambda: "{} parts got a text index, {} codes of vectors".format(*e.index()),
        "find-dupes": lambda: _dupes(e),
        "list-source": lambda: _listed(e, a.source, a.limit),
        "find-by-file": lambda: _by_file(e, a.path),
        "edit": lambda: e.edit(a.id, a.text),
        "edit-payload": lambda: e.edit_payload(a.id, _pairs(a.pairs, said)),
        "update-vector": lambda: e.update_vector(a.id),
        "reindex-source": lambda: e.reindex_source(a.source),
        "dedupe": e.dedupe,
        "delete-id": lambda: e.delete_ids(a.ids),
        "delete-source": lambda: e.delete_source(a.source),
        "delete-text": lambda: e.delete_text(a.text),
        "delete-fragment": lambda: e.delete_fragment(a.text, a.regex, a.source),
    }
    found = calls[a.command]()
    if isinstance(found, Change):
        told = f"{found.commit()} points changed" if a.yes and not a.dry_run else f"{found.count()} points would change; --yes changes them"
        return "\n".join([*said, told])
    if isinstance(found, str):
        return found
    rows = found.drop("vector") if "vector" in found.columns else found
    return "\n".join(" | ".join("-" if v is None else str(v)[:120].replace("\n", " ") for v in r) for r in rows.toLocalIterator())


def main() -> None:
    print(run(SparkSession.builder.appName("engram").getOrCreate()))


if __name__ == "__main__":
    main()
