"""Byte-level BPE through the tokenizers library, with pieces cut and remembered in arrays.

The pre-tokenizer's pieces are found by vector operations over the bytes of many texts at once. Each distinct piece goes
through the library's model once; its ids are kept in one array, and a hash table of piece bytes gives their place, so a
known piece costs two gathers and no Python object.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import MIX_1, MIX_2

#: Classes of bytes: other characters, letters, digits, white space; lead bytes of U+0080 to U+023F; what is not classed.
OTHER, LETTER, DIGIT, SPACE, LEAD, ODD = range(6)
#: Letters, digits and white space below U+0240, whose classes no Unicode version changes.
LETTERS = [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x23F)]
DIGITS = [(0x30, 0x39), (0xB2, 0xB3), (0xB9, 0xB9), (0xBC, 0xBE)]
SPACES = [(0x09, 0x0D), (0x20, 0x20)]
#: White space of two bytes: a text that holds one is cut at safe blanks only, as are texts beyond U+023F.
WIDE_SPACES = [(0x85, 0x85), (0xA0, 0xA0)]
BLANK, APOSTROPHE = 0x20, 0x27

#: How a byte-level vocabulary spells bytes: printable ones as themselves, the others by characters from U+0100.
PRINTABLE = frozenset([*range(33, 127), *range(161, 173), *range(174, 256)])
SPELLING = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}

#: Bytes of text in one step, and the longest piece that the table holds: two 8-byte words, the last byte is its length.
STEP_BYTES, LONGEST = 1 << 20, 15


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and of each code point below U+0240."""
    points = np.full(0x240, OTHER, np.uint8)
    for kind, ranges in ((LETTER, LETTERS), (DIGIT, DIGITS), (SPACE, SPACES), (ODD, WIDE_SPACES)):
        for a, b in ranges:
            points[a : b + 1] = kind
    of_byte = np.full(256, ODD, np.uint8)
    of_byte[:128] = points[:128]
    of_byte[0xC2:0xC9] = LEAD
    return of_byte, points


CLASS_OF_BYTE, CLASS_OF_POINT = _classes()
SAFE_AFTER = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def safe_blanks(data: np.ndarray, special: Sequence[bytes]) -> np.ndarray:
    """For each byte but the last, whether it is a blank before a visible ASCII character that starts no special token."""
    after = SAFE_AFTER.copy()
    after[[s[0] for s in special]] = False
    return (data[:-1] == BLANK) & after[data[1:]]


def cut_pieces(data: np.ndarray, begins: np.ndarray, special: Sequence[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(starts, odd) of the pieces of texts end to end; begins: where a text that is not empty starts.

    data ends with 16 zero bytes that belong to no text. A text with characters that are not classed, or with a special
    token, is odd: it is cut only at safe blanks, which always start a piece and left of which the text is cut as at its
    end, so that these parts can be encoded apart.
    """
    n = len(data) - 16
    kind = CLASS_OF_BYTE[data[:n]]
    begin = np.zeros(n + 16, bool)
    begin[begins] = True
    leads = np.flatnonzero(kind == LEAD)
    if len(leads):
        points = CLASS_OF_POINT[(data[leads].astype(np.int64) & 0x1F) << 6 | data[leads + 1] & 0x3F]
        kind[leads] = points
        kind[np.minimum(leads + 1, n - 1)] = points
    start = begin[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before other characters starts a piece, and if it is a blank they belong to it
    white = kind == SPACE
    after = np.flatnonzero(white[:-1] & ~white[1:] & ~begin[1:n]) + 1
    start[after - 1] = True
    start[after[data[after - 1] == BLANK]] = False
    # 's 't 'm 'd 're 've 'll where the apostrophe starts a piece
    mark = np.flatnonzero(data[:n] == APOSTROPHE)
    mark = mark[start[mark] & ~begin[mark + 1]]
    if len(mark):
        one, two = data[mark + 1], data[mark + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~begin[mark + 2]
        mark, size = mark[short | long], np.where(short, 2, 3)[short | long]
        start[mark + 1] = False
        ends = mark + size
        ends = ends[ends < n]
        start[ends[kind[ends] == LETTER]] = True
    odd_at = np.flatnonzero(kind == ODD)
    raw = data[:n].tobytes() if special else b""
    for token in special:
        at = raw.find(token)
        while at >= 0:
            odd_at = np.append(odd_at, at)
            at = raw.find(token, at + 1)
    if not len(odd_at):
        return np.flatnonzero(start), np.zeros(0, bool)
    odd_text = np.zeros(len(begins), bool)
    odd_text[np.searchsorted(begins, odd_at, "right") - 1] = True
    odd = np.repeat(odd_text, np.diff(np.r_[begins, n]))
    start = np.where(odd, begin[:n] | safe_blanks(data[: n + 1], special) & ~begin[1 : n + 1], start)
    starts = np.flatnonzero(start)
    return starts, odd[starts]


class PieceTable:
    """Open hash table of pieces, in arrays: (low word, high word with the length, place << 8 | number of ids)."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.rows, self.used = np.zeros((1 << 15, 3), np.uint64), 0
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ high * MIX_2) * MIX_1
        return (h ^ h >> np.uint64(29)) & np.uint64(len(self.rows) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The third word of each piece, 0 where it is not known."""
        slot = self._slots(low, high).view(np.int64)
        row = self.rows[slot]
        same = (row[:, 0] == low) & (row[:, 1] == high)
        out = np.where(same, row[:, 2], np.uint64(0))
        left = np.flatnonzero(~same & (row[:, 2] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.rows) - 1)
            row = self.rows[slot[left]]
            same = (row[:, 0] == low[left]) & (row[:, 1] == high[left])
            out[left[same]] = row[same, 2]
            left = left[~same & (row[:, 2] != 0)]
        return out

    def _place(self, rows: np.ndarray) -> None:
        slot = self._slots(rows[:, 0], rows[:, 1]).view(np.int64)
        left = np.arange(len(rows))
        while len(left):
            free = left[self.rows[slot[left], 2] == 0]
            self.rows[slot[free]] = rows[free]
            left = left[(self.rows[slot[left]] != rows[left]).any(1)]
            slot[left] = (slot[left] + 1) & (len(self.rows) - 1)
        self.used += len(rows)

    def room(self, n: int) -> None:
        """Makes room for n more ids behind those that stay."""
        if self.n_ids + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(self.n_ids, n), np.uint32)])

    def add(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Pieces that are not known, each once, and their ids end to end."""
        self.room(len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        place = self.n_ids + np.cumsum(counts) - counts
        self.n_ids += len(ids)
        if 2 * (self.used + len(low)) > len(self.rows):
            old, size = self.rows[self.rows[:, 2] != 0], len(self.rows)
            while 2 * (self.used + len(low)) > size:
                size *= 2
            self.rows, self.used = np.zeros((size, 3), np.uint64), 0
            self._place(old)
        self._place(np.stack([low, high, place.astype(np.uint64) << np.uint64(8) | counts.astype(np.uint64)], 1))

    def forget(self) -> None:
        """Above the limit the pieces met first stay, which the frequent ones are among, up to half the limit."""
        if self.used > self.limit:
            rows = self.rows[self.rows[:, 2] != 0]
            rows = rows[np.argsort(rows[:, 2])][: self.limit // 2]
            ids = self.ids[: int(rows[-1, 2] >> np.uint64(8)) + int(rows[-1, 2] & np.uint64(255))].copy()
            self.clear()
            self.ids, self.n_ids = ids, len(ids)
            while 2 * len(rows) > len(self.rows):
                self.rows = np.zeros((2 * len(self.rows), 3), np.uint64)
            self._place(rows)


class WordBpe:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` of a byte-level tokenizer does.

    Bytes that are no UTF-8 are encoded as the replacement character. ``limit`` bounds the pieces remembered, of about 60
    bytes each; pieces of more than LONGEST bytes are not remembered.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)  # the same model, not a copy
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = PieceTable(limit)

    def _model_ids(self, pieces: Sequence[bytes], odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each): odd pieces by the whole tokenizer, others by its model alone."""
        if odd:
            found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        else:
            spelled = b"".join(pieces).decode("latin-1").translate(SPELLING)
            ends = np.cumsum([len(p) for p in pieces]).tolist()
            found = self.model.encode_batch_fast([spelled[a:b] for a, b in zip([0, *ends], ends, strict=False)], add_special_tokens=False)
        ids = [e.ids for e in found]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())), counts

    def _look_up(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table's ids, number of ids) of each piece; ids of long pieces stand there until the next step."""
        words = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
        short = np.minimum(sizes, LONGEST)
        low = words[starts] & LOW_BYTES[np.minimum(short, 8)]
        high = words[starts + 8] & LOW_BYTES[np.maximum(short - 8, 0)] | sizes.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(sizes > LONGEST)
        value = self.table.find(low, high)
        lost = np.flatnonzero((value == 0) & (sizes <= LONGEST))
        for kind in (False, True) if len(odd) else (False,):
            some = lost[odd[lost] == kind] if len(odd) else lost
            if not len(some):
                continue
            some = some[self.table.find(low[some], high[some]) == 0] if kind else some
            order = some[np.lexsort((high[some], low[some]))]
            new = np.ones(len(order), bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            first = order[new]
            if len(first):
                raw = data.tobytes()
                ids, counts = self._model_ids([raw[a : a + n] for a, n in zip(starts[first].tolist(), sizes[first].tolist(), strict=True)], kind)
                self.table.add(low[first], high[first], counts, ids)
        if len(lost):
            value[lost] = self.table.find(low[lost], high[lost])
        place, count = (value >> np.uint64(8)).view(np.int64), (value & np.uint64(255)).view(np.int64)
        if len(long):
            raw, end = data.tobytes(), self.table.n_ids
            for kind in (False, True) if len(odd) else (False,):
                some = long[odd[long] == kind] if len(odd) else long
                pieces = [raw[a : a + n] for a, n in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)]
                names = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
                ids, counts = self._model_ids(list(names), kind)
                which = np.array([names[p] for p in pieces], np.int64)
                self.table.room(end - self.table.n_ids + len(ids))
                self.table.ids[end : end + len(ids)] = ids
                place[some], count[some] = (end + np.cumsum(counts) - counts)[which], counts[which]
                end += len(ids)
        return place, count

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last byte, starts of parts, text of each part) of steps: whole texts, very long ones cut at safe blanks."""
        begins, owners, low = [], [], int(offsets[0])
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            while a < b:
                if begins and b - low > STEP_BYTES:
                    yield low, a, np.array(begins), np.array(owners)
                    begins, owners = [], []
                if not begins:
                    low = a
                end = b
                if b - a > 2 * STEP_BYTES:
                    at = a + STEP_BYTES
                    while at < b:  # the first safe blank from here
                        near = data[at : min(b, at + STEP_BYTES) + 1]
                        safe = np.flatnonzero(safe_blanks(near, self.special))
                        safe = safe[at + safe + 1 < b]
                        if len(safe):
                            end = at + int(safe[0])
                            break
                        at += STEP_BYTES
                begins.append(a - low)
                owners.append(i)
                a = end
        if begins:
            yield low, int(offsets[-1]), np.array(begins), np.array(owners)

    def pieces(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces start in texts end to end, as cut_pieces finds them for each text by itself; begins ascend."""
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[:-16] = data
        return cut_pieces(padded, begins, self.special)[0]

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end as unsigned 32-bit integers, number of each text) of texts end to end in UTF-8."""
        out, totals = [], np.zeros(len(offsets) - 1, np.int64)
        for low, high, begins, owners in self._parts(data, offsets):
            self.table.forget()
            step = np.zeros(high - low + 16, np.uint8)
            step[:-16] = data[low:high]
            starts, odd = cut_pieces(step, begins, self.special)
            sizes = np.diff(np.r_[starts, high - low])
            place, count = self._look_up(step, starts, sizes, odd)
            ends = np.cumsum(count)
            at = np.repeat(place - (ends - count), count) + np.arange(ends[-1])
            out.append(self.table.ids[at])
            first = np.searchsorted(starts, begins)
            np.add.at(totals, owners, np.diff(np.r_[(ends - count)[first], ends[-1]]))
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), totals

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode_flat of a column of strings without nulls."""
        texts = texts.cast(pa.large_binary())
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        return self.encode_flat(np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at)

    def encode_batch(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as bytes of little-endian unsigned 32-bit integers."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids end to end, each with one more id behind it."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def binary_rows(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ids end to end as binary values of little-endian unsigned 32-bit integers; a batch holds below 2 GB."""
    ends = np.r_[0, np.cumsum(4 * counts)]
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch holds more ids than a column of 2 GB; lower the bytes per batch")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


@lru_cache
def encoder(path: str, remembered: int = 1_000_000) -> WordBpe:
    """This process's encoder for a vocabulary file; kept between tasks of a worker."""
    return WordBpe(path, remembered)


@lru_cache
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids of a byte-level vocabulary end to end, where each starts; one more start than ids)."""
    tokenizer = encoder(path).tokenizer
    to_byte = {SPELLING.get(b, chr(b)): b for b in range(256)}
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    tokens = [tokenizer.id_to_token(i) or "" for i in range(size)]
    spelled = [bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t in tokens]
    return np.frombuffer(b"".join(spelled), np.uint8), np.r_[0, np.cumsum([len(s) for s in spelled])]


def decode_flat(ids: np.ndarray, counts: np.ndarray, path: str) -> list[str]:
    """The text of each run of ids, as the library's decode(ids, skip_special_tokens=False) gives it."""
    raw, starts = byte_table(path)
    sizes = (starts[1:] - starts[:-1])[ids]
    ends = np.cumsum(sizes)
    data = raw[np.repeat(starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    cuts = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
