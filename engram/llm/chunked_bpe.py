"""BPE encoding with reuse of content-defined chunks, and exact decoding.

Texts are cut where a rolling hash of the last bytes says so, so passages that documents share become equal chunks
wherever they stand. A chunk that several groups of documents hold is encoded once, by its owner, and its ids are
handed to the others; one that a single group holds is encoded once there. A chunk is encoded as a text of its own, which
can be wrong at its ends. So each join of two chunks is repaired: a window around it, from a piece that the left chunk
is sure of to some pieces into the right one, is encoded anew, and widened until the window's pieces and the right
chunk's meet in one place; before it the window's ids hold, from it on the chunk's.

Why meeting in one place is enough: the pre-tokenizer goes from left to right and looks at nothing left of a piece's
start, so two cuttings that share a start are equal from there on, up to the end of the shorter one. At an end without
the text that follows, only the last two pieces can be wrong ("'" and "r" are one piece with an "e" behind).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import binary_rows, byte_table, decode_flat, encoder
from .common import group_count, materialize, mix, pack_rows, powers, trimmed, unpack_blobs, with_group

#: Bytes that the rolling hash sees (a power of two), bits of it that must be 0 at a cut, least bytes of a chunk.
ROLL, CUT_BITS, LEAST = 32, 9, 64
GEAR = (mix(powers(0x9E3779B97F4A7C15, 256)[1:]) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
#: Pieces of the right chunk in a window at first; it grows fourfold. Last pieces of a cutting that can be wrong.
REACH, UNSURE = 4, 2


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of texts end to end; none within a character, none shorter than LEAST but a
    text's last; an empty text has none."""
    h = GEAR[data]
    span = 1
    while span < ROLL and span < len(h):  # h[i] = sum of GEAR[data[i - j]] << j over j < span
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    # a cut stands LEAST bytes behind its text's start at least, so the bytes hashed are all of that text
    ends, last, edges = [], int(offsets[0]), iter(offsets[1:].tolist())
    edge = next(edges, None)
    for e in [*at.tolist(), None]:
        while edge is not None and (e is None or edge <= e):
            if edge > last:
                ends.append(edge)
            last = edge
            edge = next(edges, None)
        if e is not None and edge is not None and e - last >= LEAST:
            ends.append(e)
            last = e
    return ends


def cut_table(table: pa.Table) -> pa.Table:
    """doc_id, text to doc_id, text, ends (of chunks within the text, 4 bytes each), names (16 bytes each)."""
    text = column(table, "text")
    data, offsets = flat(text)
    ends = np.array(chunk_ends(data, offsets), np.int64)
    owner = np.searchsorted(offsets[1:], ends, "left")
    raw = data.tobytes()
    begins = np.r_[offsets[:1], ends[:-1]] if len(ends) else ends
    names = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
    counts = np.bincount(owner, minlength=len(text))
    upto = np.r_[0, np.cumsum(counts)]
    within = (ends - offsets[owner]).astype("<i4")
    lists = [pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((upto * w).astype(np.int32)), pa.py_buffer(b)]) for w, b in ((4, within.tobytes()), (16, names))]
    return pa.table({"doc_id": table["doc_id"], "text": text, "ends": lists[0], "names": lists[1]})


def column(table: pa.Table, name: str) -> pa.Array:
    """A column as one array of large binaries, nulls as empty ones."""
    c = table[name].cast(pa.large_binary()).fill_null(b"").combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes end to end, offsets from 0) of a column of large binaries without nulls."""
    if not len(text):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of a table that cut_table made: its bytes, offsets of texts, ends of chunks in the bytes and their names."""
    data, offsets = flat(column(table, "text"))
    ends, edges = flat(column(table, "ends"))
    names = flat(column(table, "names"))[0].tobytes()
    return data, offsets, ends.view("<i4").astype(np.int64) + np.repeat(offsets[:-1], np.diff(edges) // 4), [names[i : i + 16] for i in range(0, len(names), 16)]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each run, end to end."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def repair(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, meeting, end) of the windows whose ids up to the meeting replace those of the chunks [begin, end).

    first marks a text's first chunk. Windows ascend and don't overlap. Each holds one join at least, starts where a
    piece of the left chunk surely starts, and its pieces meet the right chunk's before its end, or it ends with its text.
    """
    bpe = encoder(vocabulary)
    margin = max([16, *map(len, bpe.special)])  # so that a special token lies in a chunk or in a window as a whole
    own = bpe.pieces(data, begins)
    chunk_at = np.searchsorted(own, begins)
    after = np.r_[chunk_at[1:], len(own)]
    bounds = np.r_[own, len(data)]
    last_of_text = np.r_[first[1:], True]
    text = np.cumsum(first) - 1
    text_end = ends[last_of_text][text] if len(text) else ends
    join = np.flatnonzero(~first)  # the right chunk of each join
    reach, through = np.full(len(join), REACH), np.zeros(len(join), bool)
    settled: list[np.ndarray] = [np.empty((3, 0), np.int64)]
    while len(join):
        b, left = begins[join], join - 1
        low = np.minimum(chunk_at[join] - UNSURE, np.searchsorted(own, b - margin, "right") - 1)
        unsure = (low <= chunk_at[left]) & ~first[left]  # the left chunk's start is sure only if it is the text's
        low = np.maximum(low, chunk_at[left])
        high = np.minimum(np.maximum(chunk_at[join], np.searchsorted(own, b + margin)) + reach + UNSURE, after[join])
        start, end = bounds[low], bounds[high]
        new_text = np.r_[True, text[join[1:]] != text[join[:-1]]]
        apart = new_text | ~(unsure | np.r_[False, start[1:] <= end[:-1]] | np.r_[False, through[:-1]])
        at = np.flatnonzero(apart)
        window = np.cumsum(apart) - 1
        start, end = start[at], np.maximum.reduceat(end, at)
        final = np.r_[at[1:], len(join)] - 1  # the window's last join
        sizes = end - start
        offsets = np.cumsum(sizes) - sizes
        cut = bpe.pieces(gather(data, start, sizes), offsets)
        owner = np.searchsorted(offsets, cut, "right") - 1
        place = cut - offsets[owner] + start[owner]
        to_end = np.bincount(owner, minlength=len(at))[owner] - (np.arange(len(cut)) - np.searchsorted(owner, np.arange(len(at)))[owner])
        meets = (bounds[np.minimum(np.searchsorted(own, place), len(own))] == place) & (place >= b[final][owner] + margin) & (to_end > UNSURE)
        # a place in the chunk of the window's last join
        meets &= place < ends[join[final]][owner]
        met = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(met, owner[meets], place[meets])
        whole = end == text_end[join[final]]
        met = np.where(whole, end, met)
        open_ = met == np.iinfo(np.int64).max
        # texts whose windows are all settled are done; the others go on with wider windows
        again = np.zeros(int(text[-1]) + 1, bool)
        again[text[join[at[open_]]]] = True
        done = ~again[text[join[at]]]
        settled.append(np.stack([start[done], met[done], end[done]]))
        widen = np.zeros(len(join), bool)
        widen[final[open_]] = True
        through |= widen & (high >= after[join])
        reach = np.where(widen, reach * 4, reach)
        stay = again[text[join]]
        join, reach, through = join[stay], reach[stay], through[stay]
    found = np.concatenate(settled, 1)
    return tuple(found[:, np.argsort(found[0], kind="stable")])


def encode_group(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, names: Sequence[bytes], given: dict[bytes, bytes], vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, number of each text) of whole texts, from the ids of their chunks, given or made here once."""
    if not len(ends):
        return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    begins = np.r_[0, ends[:-1]]
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(n, len(numbers)) for n in names], np.int64)
    one = np.zeros(len(numbers), np.int64)
    one[which[::-1]] = np.arange(len(names))[::-1]  # the first chunk of each name
    ready = [given.get(n) for n in numbers]
    own = np.array([i for i, r in enumerate(ready) if r is None], np.int64)
    sizes = (ends - begins)[one[own]]
    made, counts = encoder(vocabulary).encode_flat(gather(data, begins[one[own]], sizes), np.r_[0, np.cumsum(sizes)])
    windows, until, upto_end = repair(data, begins, ends, np.isin(begins, offsets[:-1]), vocabulary)
    again, again_counts = encoder(vocabulary).encode_flat(gather(data, windows, upto_end - windows), np.r_[0, np.cumsum(upto_end - windows)])
    # one pool of ids: own chunks, given chunks, windows
    handed = [np.frombuffer(r, "<u4") for r in ready if r is not None]
    pool = np.concatenate([made, *handed, again])
    pool_sizes = np.concatenate([counts, [len(h) for h in handed], again_counts]).astype(np.int64)
    pool_start = np.cumsum(pool_sizes) - pool_sizes
    slot = np.empty(len(numbers), np.int64)
    slot[own] = np.arange(len(own))
    slot[[i for i, r in enumerate(ready) if r is not None]] = len(own) + np.arange(len(handed))
    # what stays of a chunk: a window that starts before it can cover its begin, one that starts in it covers its end
    before, upto = np.searchsorted(windows, begins) - 1, np.searchsorted(windows, ends) - 1
    low = np.maximum(begins, np.r_[until, 0][before])
    high = np.where(upto > before, np.r_[windows, 0][upto], ends)
    keep = low < high
    raw, byte_starts = byte_table(vocabulary)
    widths = np.r_[0, np.cumsum((byte_starts[1:] - byte_starts[:-1])[pool])]
    base = widths[pool_start[slot[which]]][keep]
    # chunks' rests and windows in the order of the text
    at = np.concatenate([low[keep], windows])
    from_byte = np.concatenate([base + (low - begins)[keep], widths[pool_start[len(own) + len(handed) :]]])
    to_byte = np.concatenate([base + (high - begins)[keep], from_byte[keep.sum() :] + until - windows])
    start, stop = np.searchsorted(widths, from_byte), np.searchsorted(widths, to_byte)
    if (widths[start] != from_byte).any() or (widths[stop] != to_byte).any():
        raise AssertionError("no id ends where chunks and windows meet")
    size = stop - start
    order = np.argsort(at, kind="stable")
    ids = gather(pool, start[order], size[order])
    totals = np.zeros(len(offsets) - 1, np.int64)
    np.add.at(totals, np.searchsorted(offsets, at, "right") - 1, size)
    return ids, totals


def encode_texts(texts: Sequence[str], given: dict[bytes, bytes], vocabulary: str) -> list[bytes]:
    """Ids of each text as bytes, by chunks: what a group of documents goes through."""
    table = cut_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    return binary_rows(*encode_group(*chunks_of(table), given, vocabulary)).to_pylist()


def encode_chunked(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (doc_id, text; null text: empty) to (doc_id, ids, text): ids as little-endian 4-byte integers, text decoded from them.

    Equals the library's encode of each whole text without special tokens added, and its decode of the ids. One row
    per row of docs, repeated identifiers included; an empty text has no ids; an empty table gives no row. Chunks are
    known by 128-bit hashes, counted with map-side combine; a chunk that very many groups hold is joined by a skewed
    join that can be split. Texts are exchanged once, compressed, in groups of bounded size, with their chunks' ends and
    names beside them.
    """
    groups = group_count(docs)
    rows = with_group(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), groups)

    def name_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = cut_table(pa.table({"doc_id": batch["grp"], "text": batch["text"]}))
            counts = np.array([len(x) // 16 for x in cut["names"].to_pylist()], np.int64)
            found = np.empty(int(counts.sum()), [("h1", "<i8"), ("h2", "<i8"), ("grp", "<i4")])
            names = np.frombuffer(b"".join(cut["names"].to_pylist()), "<i8").reshape(-1, 2)
            found["h1"], found["h2"], found["grp"] = names[:, 0], names[:, 1], np.repeat(batch["grp"].to_numpy(), counts)
            found = np.unique(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in ("h1", "h2", "grp")], ["h1", "h2", "grp"])

    held = materialize(rows.select("grp", "text").mapInArrow(trimmed(name_chunks), "h1 long, h2 long, grp int").distinct(), "chunks")
    shared = held.groupBy("h1", "h2").agg(F.min("grp").alias("owner"), F.max("grp").alias("last")).where("owner < last").select("h1", "h2", "owner")
    packed = pack_rows(rows, ["doc_id", "text"], prepare=cut_table).groupBy("grp")

    def joined(h1: pa.ChunkedArray, h2: pa.ChunkedArray) -> list[bytes]:
        both = np.stack([h1.to_numpy(), h2.to_numpy()], 1).astype("<i8").tobytes()
        return [both[i : i + 16] for i in range(0, len(both), 16)]

    def encode_owned(packed: pa.Table, owned: pa.Table) -> pa.Table:
        wanted, found = set(joined(owned["h1"], owned["h2"])), {}
        if wanted and packed.num_rows:
            data, _, ends, names = chunks_of(unpack_blobs(packed["blob"].to_pylist()))
            for i, name in enumerate(names):
                if name in wanted:
                    found.setdefault(name, i)
            at = np.array(list(found.values()), np.int64)
            begins = np.r_[0, ends[:-1]][at]
            sizes = ends[at] - begins
            ids = binary_rows(*encoder(vocabulary).encode_flat(gather(data, begins, sizes), np.r_[0, np.cumsum(sizes)]))
        else:
            ids = pa.array([], pa.binary())
        halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        return pa.table({"h1": np.ascontiguousarray(halves[:, 0]), "h2": np.ascontiguousarray(halves[:, 1]), "ids": ids})

    owners = shared.select(F.col("owner").alias("grp"), "h1", "h2").groupBy("grp")
    encoded = packed.cogroup(owners).applyInArrow(encode_owned, "h1 long, h2 long, ids binary")
    given = held.join(encoded, ["h1", "h2"]).select("grp", "h1", "h2", "ids").groupBy("grp")

    def assemble(packed: pa.Table, given: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "text": pa.array([], pa.string())})
        table = unpack_blobs(packed["blob"].to_pylist())
        ready = dict(zip(joined(given["h1"], given["h2"]), given["ids"].to_pylist(), strict=True))
        ids, counts = encode_group(*chunks_of(table), ready, vocabulary)
        return pa.table({"doc_id": table["doc_id"], "ids": binary_rows(ids, counts), "text": pa.array(decode_flat(ids, counts, vocabulary), pa.string())})

    return packed.cogroup(given).applyInArrow(assemble, "doc_id long, ids binary, text string")


def library_digest(text: str, vocabulary: str) -> tuple[int, str, str]:
    """(n_tokens, ids_sha256, decoded_sha256) straight from the library, for comparison."""
    tokenizer = encoder(vocabulary).tokenizer
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
