"""A vector index beside each part: coarse cells and product codes of residuals, candidates for an exact second look."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import create_file, list_names, read_file, remove_path
from .store import COLUMNS, Snapshot, Store

#: Vectors that a model is fitted to, at most, and their bytes.
MOST_FITTED, FITTED_BYTES = 20_000, 64 << 20
#: Numbers of a vector that share a code of one byte; rounds of fitting.
CODE_WIDTH, ROUNDS = 4, 10
#: Part of the nearest neighbours whose cells a search reads; candidates that are looked at exactly, for each one asked for.
REACHED, LOOKED_AT = 0.99, 10
#: Vectors of the sample whose neighbours in it settle how many cells that takes, and neighbours of each.
TRIED, NEIGHBOURS = 200, 30

CODES = "cell int, codes binary, source string, ts_epoch long, _file string, _row long"


# --- the model ---------------------------------------------------------------------------------------------------


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre next to each row, in blocks of bounded size."""
    half = (centres * centres).sum(1) / 2
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([(x[i : i + step] @ centres.T - half).argmax(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def centres_of(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k means of the rows; one that loses its rows starts anew at the row furthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if (~full).any():
            far = np.argsort(-((x - centres[own]) ** 2).sum(1))[: (~full).sum()]
            centres[np.flatnonzero(~full)[: len(far)]] = x[far]
    return centres


@dataclass
class Quantizer:
    """cells: coarse centres of unit vectors. books: for each run of CODE_WIDTH numbers of what is left, up to 256 centres.
    probed: the part of the cells, nearest first, that holds REACHED of the nearest neighbours within the sample; few where
    vectors gather, near all where they have no order."""

    cells: np.ndarray
    books: list[np.ndarray]
    probed: float = 1.0

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    @classmethod
    def fit(cls, vectors: np.ndarray) -> Quantizer:
        x = units(vectors)
        cells = centres_of(x, max(1, int(len(x) ** 0.5)), 1)
        own = nearest(x, cells)
        left = x - cells[own]
        tried = np.arange(0, len(x), max(1, len(x) // TRIED))
        scores = x[tried] @ x.T
        near = np.argsort(-scores, axis=1, kind="stable")[:, :NEIGHBOURS]
        place = np.argsort(np.argsort(-(x[tried] @ cells.T), axis=1, kind="stable"), axis=1)
        reached = np.quantile(np.take_along_axis(place, own[near], 1) + 1, REACHED, method="higher")
        books = [centres_of(left[:, j : j + CODE_WIDTH], 256, j) for j in range(0, x.shape[1], CODE_WIDTH)]
        return cls(cells, books, float(reached / len(cells)))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = units(vectors)
        own = nearest(x, self.cells)
        left = x - self.cells[own]
        codes = [nearest(left[:, j * CODE_WIDTH : (j + 1) * CODE_WIDTH], book) for j, book in enumerate(self.books)]
        return own, np.stack(codes, 1).astype(np.uint8)

    def tables(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of a unit query with the cells, and with every centre of every book."""
        parts = np.zeros((len(self.books), 256))
        for j, book in enumerate(self.books):
            parts[j, : len(book)] = book @ query[j * CODE_WIDTH : (j + 1) * CODE_WIDTH]
        return self.cells @ query, parts

    def dump(self) -> bytes:
        flat = lambda a: {"shape": a.shape, "data": base64.b64encode(a.astype(np.float32).tobytes()).decode()}
        return json.dumps({"cells": flat(self.cells), "books": [flat(b) for b in self.books], "probed": self.probed}).encode()

    @classmethod
    def load(cls, text: str) -> Quantizer:
        array = lambda a: np.frombuffer(base64.b64decode(a["data"]), np.float32).reshape(a["shape"]).astype(np.float64)
        made = json.loads(text)
        return cls(array(made["cells"]), [array(b) for b in made["books"]], made["probed"])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- the index -----------------------------------------------------------------------------------------------------


class VectorIndex:
    """Codes of a store's parts under root/codes by part, made by one model under root/quantizer.

    The model is fitted once, to at most MOST_FITTED vectors by order of a hash of their identifiers; parts are coded one by
    one as they come, old ones stay. Vectors that are null, without direction, or of another length than most have no code:
    search doesn't find them either. Parts without codes are searched row by row.
    """

    def __init__(self, store: Store):
        self.store, self.spark, self.path = store, store.spark, f"{store.root}/codes"

    def _usable(self, dim: int) -> Column:
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return (F.size("vector") == dim) & (length > 0) & (length < float("inf"))

    def model(self) -> Quantizer | None:
        made = read_file(self.spark, f"{self.store.root}/quantizer/model.json")
        return Quantizer.load(made) if made else None

    def _fit(self, base: Snapshot) -> Quantizer | None:
        points = self.store.points(base).where("vector is not null")
        sizes = points.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
        if not sizes or not sizes[0].dim:
            return None
        dim = sizes[0].dim
        most = max(1, min(MOST_FITTED, FITTED_BYTES // (4 * dim)))
        some = points.where(self._usable(dim)).orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow()
        if not some.num_rows:
            return None
        made = Quantizer.fit(some["vector"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim))
        create_file(self.spark, f"{self.store.root}/quantizer/model.json", made.dump())
        return self.model()

    def parts(self) -> set[str]:
        return {n for n in list_names(self.spark, self.path) if "_SUCCESS" in list_names(self.spark, f"{self.path}/{n}")}

    def build(self, base: Snapshot | None = None) -> int:
        """Codes the parts that have none yet, each by itself and without an exchange; returns their number."""
        base = base or self.store.snapshot()
        known = self.parts()
        new = [p for p in base.parts if p["part"] not in known]
        model = self.model() or self._fit(base)
        if model is None:
            return 0

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells, codes = model.encode(batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, model.dim))
                    packed = pa.array([c.tobytes() for c in codes], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), packed, *(batch[c] for c in ("source", "ts_epoch", "_file", "_row"))], [c.split()[0] for c in CODES.split(", ")])

        for p in new:
            remove_path(self.spark, f"{self.path}/{p['part']}")
            rows = self.store._read([{"part": p["part"], "without": []}], located=True).where(self._usable(model.dim))
            coded = rows.select("source", "ts_epoch", "_file", "_row", "vector").mapInArrow(code, CODES)
            coded.sortWithinPartitions("cell").write.option("parquet.page.row.count.limit", "2000").parquet(f"{self.path}/{p['part']}")
        return len(new)

    def candidates(self, query: Sequence[float], most: int, base: Snapshot, since: float | None = None, source: str | None = None, probed: float | None = None) -> DataFrame:
        """Points among which the best by cosine are, with all rows of parts that have no codes.

        Bounds on time and source hold before the candidates are chosen. The cells nearest to the query are read, the
        probed part of them, by default as the model has it; every task keeps its best by codes, most * LOOKED_AT of them.
        """
        known, model = self.parts(), self.model()
        indexed = [p for p in base.parts if p["part"] in known]
        others = [p for p in base.parts if p["part"] not in known]
        q = np.asarray(query, np.float64)
        size = float(np.linalg.norm(q))

        def bounded(rows: DataFrame) -> DataFrame:
            rows = rows if since is None else rows.where(F.col("ts_epoch") >= F.lit(since))
            return rows if source is None else rows.where(F.col("source") == source)

        found = [bounded(self.store._read(others, since=since))] if others or not indexed else []
        if not indexed:
            return found[0]
        if model is None or len(q) != model.dim or not 0 < size < float("inf"):
            return reduce(DataFrame.unionByName, [*found, bounded(self.store._read(indexed, since=since))])
        near, tables = model.tables(q / size)
        cells = np.argsort(-near, kind="stable")[: int(np.ceil((model.probed if probed is None else probed) * len(near)))]
        keep = most * LOOKED_AT

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, held = None, []
            at = np.arange(len(tables))

            def cut(rows: pa.Table) -> pa.Table:
                if rows.num_rows <= keep:
                    return rows
                scores = rows["score"].to_numpy()
                return rows.take(pa.array(np.sort(np.argpartition(-scores, keep - 1)[:keep])))

            for batch in batches:
                if batch.num_rows:
                    codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, len(tables))
                    scores = near[batch["cell"].to_numpy()] + tables[at, codes].sum(1)
                    held.append(pa.table([batch["_file"], batch["_row"], pa.array(scores)], ["_file", "_row", "score"]))
                    if sum(t.num_rows for t in held) > 4 * keep:
                        held = [cut(pa.concat_tables(held))]
            if held:
                best = cut(pa.concat_tables(held))
                yield from best.combine_chunks().to_batches()

        chosen = bounded(self.store.counting(self.spark.read.schema(CODES).parquet(*[f"{self.path}/{p['part']}" for p in indexed]), indexed).where(F.col("cell").isin(cells.tolist())))
        places = chosen.select("cell", "codes", "_file", "_row").mapInArrow(score, "_file string, _row long, score double").orderBy(F.desc("score"), "_file", "_row").limit(keep).toArrow()
        if places.num_rows:
            # a few rows, kept by the limit; only their files are opened
            rows = self.store._read(indexed, located=True, files=set(places["_file"].to_pylist()))
            table = self.spark.createDataFrame(places.select(["_file", "_row"]))
            found.append(rows.join(table, ["_file", "_row"], "left_semi").select(*COLUMNS))
        return reduce(DataFrame.unionByName, found) if found else self.store.points(base).limit(0)
