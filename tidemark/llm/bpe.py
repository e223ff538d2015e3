"""Byte-level BPE encoding and decoding in numpy.

A text is cut into the matches of the public split pattern by classifying code points; the distinct matches of a
block are laid out as padded matrices, one per length bucket, and every row merges its leftmost pair of minimum rank
each round. Pairs are looked up in an open-addressing hash table; finished rows leave the matrix. Long rows merge all
pairs of that rank in a round, as far as single merges would come to the same.

Defined results: a null text counts as empty; an empty text has no ids; every row in gives a row out, repeated rows
and null ids included; other columns play no part. Memory is bounded by a block of ``BLOCK`` or one document.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import blocks, ragged, texts

#: Bytes of text that a worker encodes at once, unless one document alone is longer.
BLOCK = 1 << 19
#: Pieces of more bytes are laid end to end, about LINE bytes of them at once: a matrix would need as many rounds as they have bytes.
LONG_PIECE, LINE = 192, 1 << 16
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = range(4)


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point in the split pattern."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        for m in regex.finditer(f"{name}+", every):
            out[[ord(c) for c in m[0]]] = kind
    out[WHITE] = SPACE
    return out


def split_points(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where matches of the split pattern start, in the code points of texts laid end to end; first: each text's start."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    start = np.zeros(n + 1, bool)  # of runs of a class, then of matches
    start[0], start[n] = True, True
    start[1:n] = kind[1:] != kind[:-1]
    start[first] = True
    begins = np.flatnonzero(start[:n])
    ends = np.append(begins[1:], n)
    last_of_text = np.zeros(n + 1, bool)
    last_of_text[first] = True
    last_of_text[n] = True
    # white space before something else in its text: the last character stands alone, or leads the next run if it is a blank
    white = kind[begins] == SPACE
    inner = white & ~last_of_text[ends]
    tail = ends[inner] - 1
    start[tail] = True
    leads = tail[points[tail] == 32]
    start[leads + 1] = False
    # contractions: an apostrophe that starts a match and is a run of its own, before certain letters
    quote = begins[(kind[begins] == OTHER) & (points[begins] == 39) & (ends - begins == 1) & ~last_of_text[ends]]
    quote = quote[start[quote]]
    if len(quote):
        text_end = np.append(first[1:], n)[np.searchsorted(first, quote, side="right") - 1]
        c1 = points[quote + 1]
        c2 = np.where(quote + 2 < text_end, points[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (c1 == ord(a)) & (c2 == ord(b))
        hit = quote[one | two]
        size = np.where(one, 2, 3)[one | two]
        start[hit + 1] = False
        after = hit + size
        inside = after[(after < n)]
        start[inside] = True  # the rest of the letters, or a new run or text anyway
    return np.flatnonzero(start[:n])


class Coder:
    """The vocabulary: ranks, token bytes laid end to end, and a hash table from pairs of ids to merged ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        by_id: list[bytes] = [b""] * size
        for token, i in ranks.items():
            by_id[i] = token
        self.vocabulary = pa.array([x or None for x in by_id], pa.large_binary())
        self.length = np.fromiter(map(len, by_id), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        self.shift = int(size).bit_length()
        pairs = {}
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << self.shift | b] = i
        self.mask = (1 << (4 * max(1, len(pairs))).bit_length()) - 1
        self.keys, self.merged = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, self.none, np.int32)
        key, value = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self.slot(key)
        while len(key):
            free = self.keys[slot] == -1
            _, pick = np.unique(slot[free], return_index=True)  # one key per slot; the others go on
            pick = np.flatnonzero(free)[pick]
            self.keys[slot[pick]], self.merged[slot[pick]] = key[pick], value[pick]
            rest = np.ones(len(key), bool)
            rest[pick] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & self.mask

    none = np.iinfo(np.int32).max

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair; ``none`` where it doesn't merge."""
        key = (left.astype(np.int64) << self.shift) | right
        key = np.where((left < 0) | (right < 0), -2, key)
        out = np.full(len(key), self.none, np.int32)
        slot, at = self.slot(key), np.flatnonzero(key != -2)
        slot, key = slot[at], key[at]
        while len(at):
            there = self.keys[slot]
            found = there == key
            out[at[found]] = self.merged[slot[found]]
            go = ~found & (there != -1)
            at, key, slot = at[go], key[go], (slot[go] + 1) & self.mask
        return out

    def matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a padded matrix (-1: nothing there) until none merges. Gives the rows and their lengths."""
        out, length = ids.copy(), (ids >= 0).sum(1)
        rows = np.arange(len(ids))
        left = ids.astype(np.int64)
        rank = self.look_up(left[:, :-1].ravel(), left[:, 1:].ravel()).reshape(len(left), -1)
        while len(rows) and left.shape[1] > 1:
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            more = best != self.none
            if not more.all():
                done = ~more
                out[rows[done]] = -1
                out[rows[done], : left.shape[1]] = left[done]
                length[rows[done]] = (left[done] >= 0).sum(1)
                rows, left, rank, at, best = rows[more], left[more], rank[more], at[more], best[more]
                if not len(rows):
                    return out, length
            # compaction: what stands right of the merged pair moves one place to the left
            width, each = left.shape[1], np.arange(len(rows))
            cols = np.arange(width - 1)
            take = cols[None, :] + (cols[None, :] > at[:, None])
            left = np.take_along_axis(left, take, 1)
            left[each, at] = best
            rank = np.take_along_axis(rank, np.minimum(take[:, :-1], width - 2), 1) if width > 2 else np.zeros((len(rows), 0), np.int32)
            if width > 2:
                has = at < width - 2
                rank[each[has], at[has]] = self.look_up(left[each[has], at[has]], left[each[has], at[has] + 1])
                has = at > 0
                rank[each[has], at[has] - 1] = self.look_up(left[each[has], at[has] - 1], left[each[has], at[has]])
        if len(rows):
            out[rows] = -1
            out[rows, : left.shape[1]] = left
            length[rows] = (left >= 0).sum(1)
        return out, length

    def line(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long rows, laid end to end without padding. Gives what is left of them and their lengths.

        In a round a row merges its pair of minimum rank wherever it occurs, from the left, up to the first merge that makes a
        pair of lower rank, which the next round takes. That is what single merges would do, in as many rounds as a row has
        ranks, not bytes. Merged places leave once they are half of all.
        """
        ids, after, before, first = self.links(ids, size)
        rank = self.look_up(ids[:-1], ids[after[:-1]])
        live = len(rank)
        while live:
            least = np.minimum.reduceat(rank, first)
            at = np.flatnonzero((rank == (least if len(least) == 1 else np.repeat(least, np.diff(first, append=len(rank))))) & (rank != self.none))
            if not len(at):
                break
            # of pairs that overlap in a run, every second one merges
            each = np.arange(len(at))
            chained = np.append(False, at[1:] == after[at[:-1]])
            at = at[(each - np.maximum.accumulate(np.where(chained, 0, each))) % 2 == 0]
            second, made = after[at], rank[at].astype(np.int64)
            beside = np.append(False, before[at[1:]] == second[:-1])  # the pair on the left has merged by then
            lower = self.look_up(made, ids[after[second]]) < made
            lower |= self.look_up(np.where(beside, made, ids[before[at]]), made) < made
            if lower.any():
                row = np.searchsorted(first, at, side="right")
                earlier = np.cumsum(lower) - lower
                fine = earlier == earlier[np.searchsorted(row, row)]
                at, second, made = at[fine], second[fine], made[fine]
            ids[at], ids[second], rank[second] = made, -1, self.none
            after[at] = after[second]
            before[after[at]] = at
            touched = np.concatenate([at, before[at]])
            touched = touched[touched < len(rank)]
            rank[touched] = self.look_up(ids[touched], ids[after[touched]])
            live -= len(at)
            if 2 * live < len(rank):
                there = ids[:-1] >= 0
                size, rank = np.add.reduceat(there, first, dtype=np.int64), rank[there]
                ids, after, before, first = self.links(ids[:-1][there], size)
        there = ids[:-1] >= 0
        return ids[:-1][there], np.add.reduceat(there, first, dtype=np.int64)

    @staticmethod
    def links(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows end to end with a place for nothing behind them; each place's next and last in its row; and where rows start."""
        n = len(ids)
        first = np.cumsum(size) - size
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[first + size - 1], after[n], before[first] = n, n, n
        return np.append(ids, -1), after, before, first

    def pieces(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, laid end to end, and how many each has."""
        n = len(unique)
        offsets = np.frombuffer(unique.buffers()[1], np.int64)[unique.offset : unique.offset + n + 1]
        data = np.frombuffer(unique.buffers()[2], np.uint8)
        size = np.diff(offsets)
        parts, owner, counts = [], [], np.zeros(n, np.int64)
        whole = pc.fill_null(pc.index_in(unique, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        direct = np.flatnonzero(whole >= 0)
        counts[direct] = 1
        parts.append(whole[direct])
        owner.append(direct)
        rest = whole < 0
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, LONG_PIECE):
            at = np.flatnonzero(rest & (size > low) & (size <= high))
            low = high
            step = max(1, (1 << 21) // high)
            for k in range(0, len(at), step):
                own = at[k : k + step]
                grid = np.full((len(own), high), -1, np.int64)
                fill = np.arange(high)[None, :] < size[own][:, None]
                grid[fill] = self.single[data[ragged(offsets[own], size[own])]]
                ids, length = self.matrix(grid)
                counts[own] = length
                parts.append(ids[ids >= 0])
                owner.append(np.repeat(own, length))
        at = np.flatnonzero(rest & (size > LONG_PIECE))
        at = at[np.argsort(size[at], kind="stable")]
        group = np.cumsum(size[at]) // LINE
        for own in np.split(at, np.flatnonzero(np.diff(group)) + 1) if len(at) else ():
            ids, length = self.line(self.single[data[ragged(offsets[own], size[own])]], size[own])
            counts[own] = length
            parts.append(ids)
            owner.append(np.repeat(own, length))
        own = np.concatenate(owner)
        return np.concatenate(parts)[np.argsort(own, kind="stable")].astype(np.uint32), counts

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, laid end to end, and each text's number of ids."""
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        if high == low:
            return np.zeros(0, np.uint32), np.zeros(len(text), np.int64)
        raw = np.frombuffer(text.buffers()[2], np.uint8)[low:high]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of each code point
        full = np.diff(offsets) > 0
        first = np.searchsorted(place, offsets[:-1][full] - low)
        start = place[split_points(points, first)]
        data = pa.py_buffer(raw)
        bounds = np.append(start, len(raw)).astype(np.int64)
        made = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), data])
        coded = made.dictionary_encode()
        ids, counts = self.pieces(coded.dictionary)
        piece = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        each = counts[piece]
        out = ids[ragged((np.cumsum(counts) - counts)[piece], each)]
        done = np.append(0, np.cumsum(each))
        edge = done[np.searchsorted(start, offsets - low)]
        return out, np.diff(edge)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, laid end to end."""
        return self.bytes[ragged(self.offset[ids], self.length[ids])]


@functools.lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, with_digest: bool = True) -> DataFrame:
    """Per row: the kept columns, n_tokens, and ids (array<int>) and/or digests of the ids and of the decoded bytes."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"{fields}, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in blocks(batches, text, BLOCK):
            ids, counts = own.encode(texts(batch, text))
            edge = np.append(0, np.cumsum(counts))
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(counts)]
            names = [*keep, "n_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            if with_digest:
                back, width = own.decode(ids).tobytes(), np.append(0, np.cumsum(own.length[ids]))[edge]
                view, little = memoryview(back), memoryview(ids.astype("<u4").tobytes())
                columns += [pa.array([hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)])]
                columns += [pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(width[:-1], width[1:], strict=True)])]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
