"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of rows of one input partition, of about SHARD_BYTES of text: its words are numbered, its suffixes
sorted, and the transform of its words kept as a wavelet matrix (the bit planes of a wavelet tree, level by level) with
word positions at every SAMPLE-th suffix. Test phrases are searched backward, all of a shard at once: each step maps the
ends of the suffix ranges through the ranks of the planes. Ranges that are left are located by stepping to a sampled
suffix, and the words that occurrences cover are merged to spans.

The index knows nothing of the phrases, so one index serves any benchmark. No text is shuffled: shards are made where
the rows are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, trimmed

WINDOW_WORDS, SHARD_BYTES, SAMPLE = 10, 6 << 20, 8
#: Bytes of test phrases that are broadcast at once; more go in blocks, one after the other.
PHRASE_BYTES = 4 << 20

_DELIMITERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: A-Z to lower case, ASCII that is no letter or digit to blanks, so that words are what blanks separate.
FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + _DELIMITERS, bytes(range(0x61, 0x7B)) + b" " * len(_DELIMITERS))
#: Symbols that end the shard and a text; no phrase holds them.
END, BREAK = 0, 1


# --- suffixes ----------------------------------------------------------------------------------------------------


def suffix_order(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of s in order; s ends with a symbol that is smallest and stands nowhere else.

    Several symbols fit a first key; from there the sorted length doubles, for suffixes that are not told apart yet.
    """
    n = len(s)
    bits = max(1, int(symbols - 1).bit_length())
    depth = min(63 // bits, n)
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key <<= bits
        key[: n - i] |= s[i:]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    at = np.arange(n)
    group = np.maximum.accumulate(np.where(new, at, 0))
    rank[order] = group
    alone = new.copy()
    alone[:-1] &= new[1:]
    left = np.flatnonzero(~alone)
    while len(left):
        mine, of = order[left], group[left]
        then = rank[np.minimum(mine + depth, n - 1)]
        pair = of * n + then
        by = np.argsort(pair)
        mine, pair = mine[by], pair[by]
        # groups keep their places, as the group leads the key
        order[left] = mine
        new = np.ones(len(left), bool)
        new[1:] = pair[1:] != pair[:-1]
        of = np.maximum.accumulate(np.where(new, left, 0))
        group[left] = of
        rank[mine] = of
        alone = new.copy()
        alone[:-1] &= new[1:]
        left = left[~alone]
        depth *= 2
    return order


# --- bit planes --------------------------------------------------------------------------------------------------


class Bits:
    """A bit vector with ranks: bits in 64-bit words and the number of ones before each word."""

    def __init__(self, packed: bytes):
        self.words = np.frombuffer(packed, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @staticmethod
    def pack(bits: np.ndarray) -> bytes:
        """With a word to spare, so that the rank at the end needs no test."""
        out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        out[: len(packed)] = packed
        return out.tobytes()

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def planes(symbols: np.ndarray, bits: int) -> list[bytes]:
    """The wavelet matrix: a plane for each bit, high to low, of the symbols sorted stably by the bits above."""
    out, symbols = [], symbols.astype(np.int32)
    for b in range(bits - 1, -1, -1):
        one = ((symbols >> b) & 1).astype(bool)
        out.append(Bits.pack(one))
        symbols = np.concatenate([symbols.take(np.flatnonzero(~one)), symbols.take(np.flatnonzero(one))])
    return out


class FMIndex:
    """Backward search and location over one shard."""

    def __init__(self, size: int, symbols: int, packed: Sequence[bytes], marks: bytes, samples: bytes):
        self.size, self.planes, self.marks = size, [Bits(p) for p in packed], Bits(marks)
        self.samples = np.frombuffer(samples, np.int32)
        ends = np.full(len(self.planes), size)
        self.zeros = [size - int(p.rank(e[None])[0]) for p, e in zip(self.planes, ends, strict=True)]
        every = np.arange(symbols)
        self.first = self._down(every, np.zeros(symbols, np.int64))
        counts = self._down(every, np.full(symbols, size)) - self.first
        self.starts = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def parts(cls, s: np.ndarray, symbols: int, sample: int) -> dict:
        """What is stored of the index of s."""
        order = suffix_order(s, symbols)
        marked = order % sample == 0
        return {"planes": planes(s[order - 1], max(1, (symbols - 1).bit_length())), "marks": Bits.pack(marked), "samples": order[marked].astype(np.int32).tobytes()}

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions come to under a symbol's bits, all levels down."""
        for b, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.rank(at)
            at = np.where((symbol >> (len(self.planes) - 1 - b)) & 1, zeros + ones, at - ones)
        return at

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The suffix rank that a symbol in front of the suffixes ranked below at gives."""
        return self.starts[symbol] + self._down(symbol, at) - self.first[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges (low, high) of suffixes that start with each phrase; rows of phrases are symbols, last one first."""
        low, high = self.starts[phrases[:, 0]], self.starts[phrases[:, 0] + 1]
        live = np.flatnonzero(high > low)
        for t in range(1, phrases.shape[1]):
            live = live[(high[live] > low[live])]
            go = live[lengths[live] > t]
            if not len(go):
                break
            symbol = phrases[go, t]
            ends = self.before(np.tile(symbol, 2), np.concatenate([low[go], high[go]]))
            low[go], high[go] = ends[: len(go)], ends[len(go) :]
        return low, high

    def locate(self, rank: np.ndarray) -> np.ndarray:
        """Positions of suffixes by rank: back word by word to a sampled one."""
        out, rank, of, steps = np.zeros(len(rank), np.int64), rank.copy(), np.arange(len(rank)), 0
        while len(of):
            known = self.marks.get(rank)
            out[of[known]] = self.samples[self.marks.rank(rank[known])] + steps
            of, rank = of[~known], rank[~known]
            symbol, at = np.zeros(len(rank), np.int64), rank
            for plane, zeros in zip(self.planes, self.zeros, strict=True):
                one, ones = plane.get(at), plane.rank(at)
                symbol = symbol * 2 + one
                at = np.where(one, zeros + ones, at - ones)
            rank = self.starts[symbol] + at - self.first[symbol]
            steps += 1
        return out


# --- shards ------------------------------------------------------------------------------------------------------

SHARD = (
    "size int, symbols int, words binary, planes array<binary>, marks binary, samples binary, starts binary, "
    "parts array<struct<row:bigint,doc_id:bigint,text:int,start:bigint,fresh:bigint,pieces:int>>"
)


def numbered(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """The words of a folded text as symbols, by first appearance from BREAK on, with END at the end; the different words."""
    edges = np.flatnonzero(np.diff((np.frombuffer(text, np.uint8) == 0x20).view(np.int8), prepend=1, append=1))
    ends = np.zeros(len(edges) // 2 + 1, np.int32)
    np.cumsum(edges[1::2] - edges[::2], out=ends[1:])
    words = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text.translate(None, b" "))]).dictionary_encode()
    return np.append(words.indices.to_numpy().astype(np.int64) + BREAK, END), words.dictionary


def pieces(text: bytes, limit: int, overlap: int) -> Iterator[tuple[bytes, int, int]]:
    """(folded text, first word, new words) of parts of a text of about limit bytes; a part repeats the last overlap words before it.

    Words are counted as they are split only where a text has several parts; for one alone the counts are -1.
    """
    folded = text.translate(FOLD)
    if len(folded) <= limit:
        yield folded, 0, -1
        return
    at, done, tail = 0, 0, []
    while at < len(folded):
        cut = len(folded)
        if at + limit < cut:
            cut = folded.rfind(b" ", at + 1, at + limit)
            if cut < 0:
                cut = folded.find(b" ", at + limit)
                cut = len(folded) if cut < 0 else cut
        words = folded[at:cut].split()
        yield b" ".join([*tail, *words]), done - len(tail), len(words)
        tail = [*tail, *words][-overlap:] if overlap else []
        done, at = done + len(words), cut


def index_shards(docs: DataFrame, window: int = WINDOW_WORDS, shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE) -> DataFrame:
    """One row per shard of docs (doc_id, text): its FM-index, and the rows it holds.

    Texts that are equal within a shard are indexed once. A text longer than a shard is cut, with window - 1 words
    repeated, so a phrase of window words is found whole in one part.
    """

    def shard(texts: list[bytes], parts: list[list]) -> pa.RecordBatch:
        s, words = numbered(b"\x00 " + b" \x00 ".join([*texts, b""]))
        breaks = np.flatnonzero(s == BREAK)
        starts, sizes = breaks[:-1] + 1, np.diff(breaks) - 1
        for p in parts:
            p[4] = int(sizes[p[2]]) if p[4] < 0 else p[4]
        made = FMIndex.parts(s, len(words) + 1, sample)
        columns = list(zip(*parts, strict=True))
        kinds = dict(row=pa.int64(), doc_id=pa.int64(), text=pa.int32(), start=pa.int64(), fresh=pa.int64(), pieces=pa.int32())
        rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))
        values = {
            "size": pa.array([len(s)], pa.int32()), "symbols": pa.array([len(words) + 1], pa.int32()), "words": pa.array([b" ".join(words.to_pylist())], pa.binary()),
            "planes": pa.array([made["planes"]], pa.list_(pa.binary())), "marks": pa.array([made["marks"]], pa.binary()), "samples": pa.array([made["samples"]], pa.binary()),
            "starts": pa.array([starts.astype(np.int32).tobytes()], pa.binary()), "parts": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
        }
        release_memory()
        return pa.RecordBatch.from_arrays(list(values.values()), list(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known, texts, parts, size = TaskContext.get().partitionId() << 33, {}, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                cut = list(pieces(text.as_py() or b"", shard_bytes, window - 1))
                for folded, start, fresh in cut:
                    at = known.setdefault(folded, len(texts))
                    if at == len(texts):
                        texts.append(folded)
                        size += len(folded) + 8
                    parts.append([row, doc_id, at, start, fresh, len(cut)])
                    if size >= shard_bytes or len(parts) >= 1 << 18:
                        yield shard(texts, parts)
                        known, texts, parts, size = {}, [], [], 0
                row += 1
        if parts:
            yield shard(texts, parts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), SHARD)


# --- phrases -----------------------------------------------------------------------------------------------------


@dataclass
class Phrases:
    """Different phrases of a set of items: numbers of words, last one first, and the items that have each."""

    words: list[bytes]
    phrases: np.ndarray
    lengths: np.ndarray
    items: list[str]
    item_of: np.ndarray
    item_starts: np.ndarray

    @classmethod
    def of(cls, items: Sequence[tuple[str, str | None]], window: int) -> Phrases:
        """Every window of window words of an item; an item of fewer, but not none, is one phrase."""
        alphabet, found = {}, {}
        names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        for name, text in items:
            s = [alphabet.setdefault(w, len(alphabet)) for w in (text or "").encode().translate(FOLD).split()]
            for i in range(max(1, len(s) - window + 1) if s else 0):
                found.setdefault(tuple(reversed(s[i : i + window])), set()).add(number[name])
        phrases = np.zeros((len(found), window), np.int64)
        for i, p in enumerate(found):
            phrases[i, : len(p)] = p
        counts = np.array([len(x) for x in found.values()], np.int64)
        return cls(list(alphabet), phrases, np.array([len(p) for p in found], np.int64), names, np.array([x for xs in found.values() for x in sorted(xs)], np.int64), np.concatenate([[0], np.cumsum(counts)]))


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ..., counts[i] of them, for all i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


FOUND = "row long, doc_id long, start long, pieces int, n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def search_shard(shard: dict, asked: Phrases) -> pa.RecordBatch:
    """The parts of a shard with the spans that phrases cover and the items that have them."""
    symbol = dict(zip(shard["words"].split(b" "), range(1, shard["symbols"]), strict=True))
    known = np.array([symbol.get(w, -1) for w in asked.words], np.int64)
    phrases = known[asked.phrases]
    inside = np.arange(phrases.shape[1]) < asked.lengths[:, None]
    here = np.flatnonzero(((phrases >= 0) | ~inside).all(axis=1))
    size, starts = shard["size"], np.frombuffer(shard["starts"], np.int32).astype(np.int64)
    cover, pairs = np.zeros(size + 1, np.int64), np.zeros(0, np.int64)
    if len(here):
        index = FMIndex(size, shard["symbols"], shard["planes"], shard["marks"], shard["samples"])
        low, high = index.search(np.maximum(phrases[here], 0), asked.lengths[here])
        counts = np.maximum(high - low, 0)
        of, at = np.repeat(here, counts), index.locate(expand(low, counts))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + asked.lengths[of], -1)
        text = np.searchsorted(starts, at, "right") - 1
        both = np.unique(text * len(asked.lengths) + of)
        text, of = both // max(1, len(asked.lengths)), both % max(1, len(asked.lengths))
        n = asked.item_starts[of + 1] - asked.item_starts[of]
        pairs = np.unique(np.repeat(text, n) * len(asked.items) + asked.item_of[expand(asked.item_starts[of], n)])
    hit = np.diff((np.cumsum(cover[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    owner = np.searchsorted(starts, begin, "right") - 1
    begin, end = begin - starts[owner], end - starts[owner]
    span_at = np.searchsorted(owner, np.arange(len(starts) + 1))
    item_text = pairs // max(1, len(asked.items))
    item_at = np.searchsorted(item_text, np.arange(len(starts) + 1))
    part = shard["parts"]
    text, start = part["text"], part["start"]
    n_spans, n_items = (span_at[text + 1] - span_at[text]), (item_at[text + 1] - item_at[text])
    pick, shift = expand(span_at[text], n_spans), np.repeat(start, n_spans)
    spans = pa.StructArray.from_arrays([pa.array(begin[pick] + shift), pa.array(end[pick] + shift)], fields=list(_SPAN))
    names = pa.array(asked.items, pa.string()).take(pa.array(pairs[expand(item_at[text], n_items)] % max(1, len(asked.items))))
    offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    columns = [part["row"], part["doc_id"], pa.array(start), part["pieces"], part["fresh"], pa.ListArray.from_arrays(offsets(n_spans), spans), pa.ListArray.from_arrays(offsets(n_items), names)]
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "start", "pieces", "n_words", "spans", "items"])


def search_shards(shards: DataFrame, asked: Phrases) -> DataFrame:
    """FOUND for each part of each row of the shards."""
    sent = shards.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {c: batch[c][i].as_py() for c in ("size", "symbols", "words", "planes", "marks", "samples", "starts")}
                rows = batch["parts"][i].values
                shard["parts"] = {c: rows.field(c) for c in ("row", "doc_id", "pieces", "fresh")} | {c: rows.field(c).to_numpy().astype(np.int64) for c in ("text", "start")}
                yield search_shard(shard, sent.value)
                release_memory()

    return shards.mapInArrow(trimmed(run), FOUND)


def merge_parts(parts: pa.Table) -> pa.Table:
    """The parts of one row as one: words added up, spans that meet joined, items once each."""
    spans = pc.list_flatten(parts["spans"]).combine_chunks()
    order = np.argsort(start := spans.field("start").to_numpy(), kind="stable")
    start, end = start[order], np.maximum.accumulate(spans.field("end").to_numpy()[order])
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]][: len(start)])
    last = np.r_[first[1:], len(end)][: len(first)] - 1
    merged = [{"start": a, "end": b} for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)]
    # a part comes once for each block of phrases
    words = parts.group_by("start").aggregate([("n_words", "max")])["n_words_max"]
    values = {"doc_id": parts["doc_id"][0].as_py(), "n_words": pc.sum(words).as_py(), "spans": merged, "items": sorted(set(pc.list_flatten(parts["items"]).to_pylist()))}
    return pa.Table.from_pylist([values], pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))]))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """doc_id, n_words, spans [(start, end)] of words that benchmark windows cover, items: ids of the items, sorted.

    docs has doc_id and text, benchmark item_id and text; other columns play no part. A window is window consecutive
    words of an item, or all words of an item of fewer; words are runs of characters other than ASCII signs, A-Z in lower
    case. One row for each row of docs: rows that repeat a doc_id, or have none, are judged each by its own text. Null and
    empty texts have no words; an item without an id counts under the empty name; items that share an id count once.
    Without items nothing is covered; an empty table gives no row.

    The index is written to the shared folder, so lost executors cost their tasks alone. Phrases are broadcast in blocks
    of phrase_bytes at most on average, each searched in one pass over the index.
    """
    shards = materialize(index_shards(docs, window, shard_bytes, sample), "shards")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // phrase_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))

    def phrases(block: int) -> Phrases:
        return Phrases.of([tuple(r) for r in items.where(place == block).collect()], window)

    columns = ("doc_id", "n_words", "spans", "items")
    if blocks == 1:
        asked, cut = phrases(0), F.exists("parts", lambda p: p["pieces"] > 1)
        whole = search_shards(shards, asked).where("pieces = 1").select(*columns)
        # few texts are longer than a shard, so few shards are searched for them
        several = search_shards(shards.where(cut), asked).where("pieces > 1")
    else:
        found = reduce(DataFrame.unionByName, [materialize(search_shards(shards, phrases(b)), "found") for b in range(blocks)])
        whole, several = None, found
    merged = several.groupBy("row").applyInArrow(merge_parts, "doc_id long, n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>")
    return merged if whole is None else whole.unionByName(merged)


def digest_hits(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_IS_WORD = np.array([FOLD[b] != 0x20 for b in range(256)])


def cut_spans(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """found with the words of its spans, and what stands between them in a span, cut out of its text; null spans cut nothing."""

    def cut(value: bytes, ranges: list[dict]) -> bytes:
        edges = np.flatnonzero(np.diff(_IS_WORD[np.frombuffer(value, np.uint8)].view(np.int8), prepend=0, append=0))
        out, at = [], 0
        for r in ranges:
            out.append(value[at : edges[2 * r["start"]]])
            at = int(edges[2 * r["end"] - 1])
        return b"".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [cut(t.as_py(), r.as_py()) if t.is_valid and r.is_valid and len(r) else t.as_py() for t, r in zip(batch[text].cast(pa.binary()), batch[spans], strict=True)]
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(values, pa.binary()).cast(batch.schema.field(at).type))

    return found.mapInArrow(trimmed(run), found.schema)
