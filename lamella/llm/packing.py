"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, in groups: randomised, or ranges
of a given order."""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, typed

LENGTH = 1024
GROUP_DOCS = 4096
GROUP_PIECES = 1 << 16
END_TEXT, END_ID, CLOSING = "<|endoftext|>", 50256, 0


@cache
def tokenizer(path: str):
    """path: a .tiktoken file of ranks (fast), or a tokenizers JSON file; a bare name is one of the public files. Both
    kinds give the same ids for one vocabulary."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: np.asarray(t.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        parts = text.split(END_TEXT)
        out = [np.asarray(t.encode_ordinary(parts[0]), np.uint32)]
        for p in parts[1:]:
            out += [np.array([END_ID], np.uint32), np.asarray(t.encode_ordinary(p), np.uint32)]
        return np.concatenate(out)

    return ids


class Tournament:
    """First fit in O(log n): leaves are bins in order, a node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, n: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with room n; the room is taken."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < n:
                i += 1
        had = room[i]
        room[i] -= n
        at = i - self.size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece, by decreasing length, ties in the given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Tournament(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], had = tree.place(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


PACKED = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long,padded_length long"
PIECES = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,place long"


def pieces(df: DataFrame, tokens: str, length: int = LENGTH, order: str | None = None) -> DataFrame:
    """Each document's ids and a closing id 0, cut into pieces of length ids and a rest; lengths and checksums only.

    place is the column order, or a checksum of the text without one.
    """

    def cut(batch: pa.RecordBatch) -> dict:
        encode, known = tokenizer(tokens), {}
        cols: dict[str, list] = {n.split()[0]: [] for n in PIECES.split(",")}
        places = batch.column(order).to_pylist() if order else [None] * batch.num_rows
        for doc, text, place in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), places):
            text = text or ""
            if text not in known:
                ids = np.append(encode(text), np.uint32(CLOSING)).astype("<u4")
                known[text] = len(ids), [(a, min(length, len(ids) - a), zlib.crc32(ids[a : a + length].tobytes())) for a in range(0, len(ids), length)], zlib.crc32(text.encode())
            total, cuts, salt = known[text]
            for a, n, crc in cuts:
                for name, x in zip(cols, (doc, a, n, crc, total, place if order else salt)):
                    cols[name].append(x)
        return cols

    return map_texts(df, cut, PIECES, ["doc_id", "text", *([order] if order else [])])


def pack(df: DataFrame, tokens: str, length: int = LENGTH, group_docs: int = GROUP_DOCS, order: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    Documents go to groups by a hash of id and text, about group_docs each (the number follows the count of rows), and
    each group is packed alone, so a task holds some thousand piece lengths whatever the table's size. Null texts count
    as empty and give their closing id. Repeated rows are packed as often as they stand; a null doc_id stays null.
    A group of more than GROUP_PIECES pieces (many repeated rows, very long texts) is packed in stretches of so many.
    Sequences are padded to length, or stay as they are when their size is a power of two.

    With order, a column of places from 0 without repeats or gaps, groups are ranges of group_docs places, and a group's
    sequences are numbered by a random place among those of their pieces. So sequence_id follows the order by ranges:
    any range of places has its documents in the sequences of the same groups.
    """
    if order:
        cut = pieces(df, tokens, length, order).withColumn("grp", F.expr(f"place div {group_docs}"))
    else:
        groups = max(1, -(-df.count() // group_docs))
        cut = pieces(df, tokens, length).withColumn("grp", F.pmod(F.xxhash64("doc_id", "place"), F.lit(groups)))
    sort = ["grp", "place", "start"] if order else ["grp", "doc_id", "start", "ids_crc32"]
    ready = cut.repartition("grp").sortWithinPartitions(*sort)

    def pack_group(table: pa.Table, grp: int, base: int) -> tuple[pa.RecordBatch, int]:
        """Sequences of one group's pieces, numbered from base on, and the next number."""
        if order:  # ties in length are broken in a fixed random order, so that a sequence's pieces come from all of the range
            table = table.take(pa.array(np.random.default_rng(grp).permutation(len(table))))
        lengths = table.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(lengths, length)
        if order:
            of, first = np.unique(bins, return_index=True)
            at = np.empty(len(of), np.int64)
            at[np.argsort(table.column("place").to_numpy()[first], kind="stable")] = np.arange(len(of))
            bins = at[bins]
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        whole = np.where(used & (used - 1), length, used)
        own = [table.column(c).combine_chunks() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        made = [pa.array(x) for x in ((grp << 32) + base + bins, offsets, whole[bins])]
        return pa.RecordBatch.from_arrays([*own, *made], [x.split()[0] for x in PACKED.split(",")]), base + len(used)

    def fill(batches):
        held, n, grp, base = [], 0, None, 0
        for b in batches:
            g = b.column("grp").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, z in zip(edges, edges[1:]):
                if a < z and g[a] != grp:
                    if held:
                        yield pack_group(pa.Table.from_batches(held), grp, base)[0]
                    held, n, grp, base = [], 0, int(g[a]), 0
                while a < z:
                    take = min(z - a, GROUP_PIECES - n)
                    held.append(b.slice(a, take))
                    a, n = a + take, n + take
                    if n == GROUP_PIECES:
                        out, base = pack_group(pa.Table.from_batches(held), grp, base)
                        yield out
                        held, n = [], 0
        if held:
            yield pack_group(pa.Table.from_batches(held), grp, base)[0]

    return ready.mapInArrow(typed(fill, PACKED), PACKED)
