"""Removal of repeated byte strings by suffix sorting, in the deep-shallow manner.

A window is a string of ``width`` bytes. Each window is named by the least hash of the 24-byte grams inside
it, so equal windows have equal names wherever they stand, and neighbouring windows mostly share one. A run
is a stretch of windows of one document with the same name. The steps, by blocks of documents:

1. each block tells each bucket of names which names it has, once each, and which in two documents already;
2. a bucket answers, in one bit a name, whether the name is in two documents at least;
3. blocks send the runs with such names to the bucket, each distinct string once, from its first document;
4. a bucket sorts all suffixes of these runs to ``width`` bytes: multikey quicksort on 8-byte characters
   to a shallow depth, then blind tries, which look at the first byte where a group with a long common
   prefix differs, and nowhere else. Of equal windows the one in the document with the smallest id is the
   owner; a bucket answers in one bit a window whether it is the owner;
5. blocks remove the bytes of windows with shared names that their document doesn't own.

A common passage reaches a bucket once from each block, not once from each document. Beyond ``SLOT`` blocks, the
blocks of a slot (``SLOT`` of them) meet by bucket first, and a bucket hears of each name and run once from each
slot; what it answers a slot, the slot tells its blocks. Different windows that share a name still all meet. Equality is
decided on bytes; hashes only choose who meets.

Defined cases: null or empty texts have no bytes; texts shorter than ``width`` keep all; rows with a null id
neither remove nor lose anything; rows with the same id never remove from each other; empty tables give no
rows; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import integral, table
from .neardup import mix

GRAM, SHALLOW, BLOCK_BYTES, BUCKET_BYTES = 24, 16, 3 << 20, 3 << 20
#: Blocks that send to a bucket directly.
SLOT = 1 << 14


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each offset on, as big-endian numbers; ``data`` is padded by 8 bytes."""
    return np.ndarray((len(data) - 7,), ">u8", data.data, strides=(1,))


class Block:
    """The documents of a block in the order of their ids, and the runs of their windows."""

    def __init__(self, rows: pa.Table, width: int, buckets: int):
        ids, texts = rows.column("doc_id").to_pylist(), [x or b"" for x in rows.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.ids, self.texts, self.width = [ids[k] for k in order], [texts[k] for k in order], width
        self.doc_id = np.array([0 if x is None else x for x in self.ids], np.int64)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join(self.texts) + bytes(32), np.uint8)
        self.find_runs(width)
        self.name, self.of_run = np.unique(self.key, return_inverse=True)
        at = (mix(self.name) % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(at, kind="stable")
        back = np.empty_like(by_bucket)
        back[by_bucket] = np.arange(len(back))
        self.name, self.bucket, self.of_run = self.name[by_bucket], at[by_bucket], back[self.of_run]

    def find_runs(self, width: int) -> None:
        n = len(self.data) - 32 - width + 1
        self.key, self.at, self.size, self.doc = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        if n <= 0:
            return
        words = words_at(self.data)
        grams = n + width - GRAM
        low = words[16 : grams + 16].astype(np.uint64)
        for at in (8, 0):
            low = mix(low) + words[at : grams + at].astype(np.uint64)
        low = mix(low)
        span, need = 1, width - GRAM + 1
        while span < need:  # minima over ever longer stretches
            step = min(span, need - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        ok = np.zeros(n + 1, bool)
        for s, e, i in zip(self.starts.tolist(), self.ends.tolist(), self.ids, strict=True):
            if i is not None and e - s >= width:
                ok[s : e - width + 1] = True
        low &= ~np.uint64(1)
        new = np.append(True, low[1:] != low[:-1])
        new[self.starts[self.starts < n]] = True
        heads = np.flatnonzero((new & ok[:-1]) | np.append(False, ok[1:-1] & ~ok[:-2]))
        cuts = np.union1d(heads, np.flatnonzero(ok[:-1] & ~ok[1:]) + 1)
        nxt = cuts[np.searchsorted(cuts, heads, "right")] if len(heads) else heads
        self.key, self.at, self.size = low[heads], heads, nxt - heads
        self.doc = np.searchsorted(self.ends, heads, "right")

    def of_buckets(self):
        """(bucket, slice of names) for those that have any."""
        if not len(self.bucket):
            return
        bounds = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1]))
        for s, e in zip(bounds, [*bounds[1:], len(self.bucket)], strict=True):
            yield int(self.bucket[s]), slice(int(s), int(e))

    def shared(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which runs have a shared name, by the buckets' answers."""
        out = np.zeros(len(self.name), bool)
        for b, own in self.of_buckets():
            out[own] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=own.stop - own.start)
        return out[self.of_run]

    def distinct(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the given runs: the number of the distinct string each has, and the first run of each string, by bucket."""
        known: dict[bytes, int] = {}
        raw, more = self.data.tobytes(), self.width - 1
        of = np.fromiter((known.setdefault(raw[a : a + s + more], len(known)) for a, s in zip(self.at[runs].tolist(), self.size[runs].tolist(), strict=True)), np.int64, len(runs))
        first = np.full(len(known), len(runs))
        np.minimum.at(first, of, np.arange(len(runs)))
        order = np.argsort(self.bucket[self.of_run[runs[first]]], kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return back[of], runs[first[order]]


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


NAMES, BITS = "block long, bucket long, names binary", "block long, bucket long, step int, bits binary"
RUNS = "block long, bucket long, sizes binary, docs binary, bytes binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def tell_names(rows: pa.Table, width: int, buckets: int) -> pa.Table:
    block = Block(rows, width, buckets)
    low = np.full(len(block.name), np.iinfo(np.int64).max)
    high = np.full(len(block.name), np.iinfo(np.int64).min)
    np.minimum.at(low, block.of_run, block.doc_id[block.doc])
    np.maximum.at(high, block.of_run, block.doc_id[block.doc])
    names = block.name | (low < high).astype(np.uint64)
    got = [(b, names[own].tobytes()) for b, own in block.of_buckets()]
    number = rows.column("block")[0].as_py()
    return _table(NAMES, [number] * len(got), [b for b, _ in got], [x for _, x in got])


class Names:
    """The distinct names that some blocks tell a bucket, and which of them are in two documents at least."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        parts = [np.frombuffer(x, np.uint64) for x in rows.column("names").to_pylist()]
        every = np.concatenate(parts)
        self.name, self.of, count = np.unique(every & ~np.uint64(1), return_inverse=True, return_counts=True)
        self.shared = (count > 1) | (np.bincount(self.of, every & np.uint64(1), minlength=len(count)) > 0)
        self.stops = np.cumsum([len(p) for p in parts])

    def answer(self, shared: np.ndarray) -> pa.Table:
        bits = [np.packbits(x).tobytes() for x in np.split(shared[self.of], self.stops[:-1])]
        return _table(BITS, self.rows.column("block"), self.rows.column("bucket"), [2] * len(bits), bits)


def answer_names(rows: pa.Table) -> pa.Table:
    """A name is shared if a block has it in two documents or two blocks have it."""
    names = Names(rows)
    return names.answer(names.shared)


def merge_names(rows: pa.Table) -> pa.Table:
    """What the blocks of a slot tell a bucket, each name once."""
    names = Names(rows)
    return _table(NAMES, rows.column("slot")[:1], rows.column("bucket")[:1], [(names.name | names.shared.astype(np.uint64)).tobytes()])


def pass_names(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """What the bucket answered the slot, for each of its blocks."""
    names = Names(rows)
    return names.answer(_bits(answers, len(names.name)))


def _bits(answers: pa.Table, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(answers.column("bits")[0].as_py(), np.uint8), count=n).astype(bool)


def _answers(rows: pa.Table, step: int) -> dict[int, bytes]:
    return {b: x for b, s, x in zip(*(rows.column(c).to_pylist() for c in ("bucket", "step", "bits")), strict=True) if s == step}


def send_runs(rows: pa.Table, answers: pa.Table, width: int, buckets: int) -> pa.Table:
    if not len(rows):
        return _table(RUNS, *[[]] * 5)
    block = Block(rows, width, buckets)
    _, first = block.distinct(np.flatnonzero(block.shared(_answers(answers, 2))))
    raw, out, bucket = block.data.tobytes(), [], block.bucket[block.of_run[first]]
    for b in np.unique(bucket).tolist():
        own = first[bucket == b]
        text = b"".join(raw[a : a + s + width - 1] for a, s in zip(block.at[own].tolist(), block.size[own].tolist(), strict=True))
        out.append((b, block.size[own].astype(np.uint32).tobytes(), block.doc_id[block.doc[own]].tobytes(), text))
    number = rows.column("block")[0].as_py()
    return _table(RUNS, [number] * len(out), *([x[k] for x in out] for k in range(4)))


def _refine(order: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each group (numbers ascend along ``order``) by ``key``, and split it where the key changes."""
    at = np.lexsort((key, group))
    group, key = group[at], key[at]
    return order[at], np.cumsum(np.append(0, (group[1:] != group[:-1]) | (key[1:] != key[:-1])))


def _first_byte(x: np.ndarray) -> np.ndarray:
    """The place of the first byte of big-endian words that isn't 0; 8 if all are."""
    out = np.zeros(len(x), np.int64)
    for half in (32, 16, 8):
        none = (x >> np.uint64(64 - half)) == 0
        out += none * (half // 8)
        x = np.where(none, x << np.uint64(half), x)
    return out + ((x >> np.uint64(56)) == 0)


def deep_shallow(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``offsets`` by their first ``width`` bytes, and numbers that are equal for equal ones along it."""
    words = words_at(data)
    order, group = np.arange(len(offsets)), np.zeros(len(offsets), np.int64)
    for depth in range(0, SHALLOW, 8):  # multikey quicksort, a character of 8 bytes at a time
        if depth:
            alone = np.bincount(group)[group] == 1
            rest = np.flatnonzero(~alone)
            o, g = _refine(order[rest], group[rest], words[offsets[order[rest]] + depth].astype(np.uint64))
            order[rest] = o
            finer = np.zeros(len(order), np.int64)
            finer[rest] = g + 1
            group = np.cumsum(np.append(0, (group[1:] != group[:-1]) | (finer[1:] != finer[:-1])))
        else:
            order, group = _refine(order, group, words[offsets].astype(np.uint64))
    # Blind tries over all groups at once: a node skips to the first byte in which its suffixes differ, and branches there.
    final = np.bincount(group, minlength=1)[group] == 1
    opened = np.flatnonzero(~final)
    while len(opened):
        at, own = offsets[order[opened]], group[opened]
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        node = np.cumsum(np.append(0, own[1:] != own[:-1]))
        lead = at[head][node]
        differ = np.full(len(at), width)
        same = np.ones(len(at), bool)
        for depth in range(SHALLOW, width, 8):
            rest = np.flatnonzero(same)
            x = words[at[rest] + depth].astype(np.uint64) ^ words[lead[rest] + depth].astype(np.uint64)
            hit = x != 0
            differ[rest[hit]] = np.minimum(depth + _first_byte(x[hit]), width)
            same[rest[hit]] = False
        branch = np.minimum.reduceat(differ, head)
        live = branch[node] < width
        opened, at, node = opened[live], at[live], node[live]
        if not len(opened):
            break
        byte = data[at + branch[node]]
        o, g = _refine(order[opened], group[opened], byte)
        order[opened] = o
        finer = np.zeros(len(order), np.int64)
        finer[opened] = g + 1
        sizes = np.bincount(g)[g]
        group = np.cumsum(np.append(0, (group[1:] != group[:-1]) | (finer[1:] != finer[:-1])))
        opened = opened[sizes > 1]
    return order, group


class Runs:
    """The different runs that some blocks send to a bucket, each with the smallest document that has it, in the order of the blocks."""

    def __init__(self, rows: pa.Table, width: int):
        self.rows = rows = rows.sort_by("block")
        sizes = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows.column("sizes").to_pylist()]
        self.docs = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("docs").to_pylist()])
        self.raw = b"".join(rows.column("bytes").to_pylist())
        self.all, self.stops = np.concatenate(sizes), np.cumsum([int(s.sum()) for s in sizes])
        n = self.all + width - 1
        begin = np.cumsum(n) - n
        # equal runs are one: only those of the smallest document can own anything
        known: dict[bytes, int] = {}
        self.of = np.fromiter((known.setdefault(self.raw[a : a + k], len(known)) for a, k in zip(begin.tolist(), n.tolist(), strict=True)), np.int64, len(n))
        _, first = np.unique(self.of, return_index=True)
        self.begin, self.size = begin[first], self.all[first]
        self.doc = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(self.doc, self.of, self.docs)

    def answer(self, owner: np.ndarray) -> pa.Table:
        """For each window of all runs, one bit: its document is the owner, given this for the windows of the different runs."""
        starts = np.cumsum(self.size) - self.size
        place = np.arange(int(self.all.sum())) - np.repeat(np.cumsum(self.all) - self.all, self.all)
        mine = owner[np.repeat(starts[self.of], self.all) + place] & np.repeat(self.docs == self.doc[self.of], self.all)
        bits = [np.packbits(x).tobytes() for x in np.split(mine, self.stops[:-1])]
        return _table(BITS, self.rows.column("block"), self.rows.column("bucket"), [4] * len(bits), bits)


def own_windows(rows: pa.Table, width: int) -> pa.Table:
    """For each window of the runs, one bit: its document has the smallest id of all with that window."""
    runs = Runs(rows, width)
    return runs.answer(_owned(np.frombuffer(runs.raw + bytes(64), np.uint8), runs.begin, runs.size, runs.doc, width))


def merge_runs(rows: pa.Table, width: int) -> pa.Table:
    """What the blocks of a slot send to a bucket, each different run once, from its smallest document."""
    runs = Runs(rows, width)
    text = b"".join(runs.raw[a : a + n + width - 1] for a, n in zip(runs.begin.tolist(), runs.size.tolist(), strict=True))
    return _table(RUNS, rows.column("slot")[:1], rows.column("bucket")[:1], [runs.size.astype(np.uint32).tobytes()], [runs.doc.tobytes()], [text])


def pass_windows(rows: pa.Table, answers: pa.Table, width: int) -> pa.Table:
    """What the bucket answered the slot, for each of its blocks."""
    runs = Runs(rows, width)
    return runs.answer(_bits(answers, int(runs.size.sum())))


def _owned(data: np.ndarray, begin: np.ndarray, size: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """For each window of different runs, whether its run's document is the smallest of all that have it."""
    ends = np.cumsum(size)
    offsets = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
    doc = np.repeat(docs, size)
    order, group = deep_shallow(data, offsets, width)
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(doc[order], heads)
    owner = np.zeros(len(doc), bool)
    owner[order] = doc[order] == least[np.cumsum(np.append(0, group[1:] != group[:-1]))]
    return owner


def remove_spans(rows: pa.Table, answers: pa.Table, width: int, buckets: int) -> pa.Table:
    if not len(rows):
        return _table(RESULT, *[[]] * 5)
    block = Block(rows, width, buckets)
    runs = np.flatnonzero(block.shared(_answers(answers, 2)))
    of, first = block.distinct(runs)
    bucket, size = block.bucket[block.of_run[first]], block.size[first]
    owned, got, at = np.zeros(int(size.sum()), bool), _answers(answers, 4), 0
    for b in np.unique(bucket).tolist():
        n = int(size[bucket == b].sum())
        owned[at : at + n] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=n)
        at += n
    begin = np.cumsum(size) - size
    change = np.zeros(len(block.data) + 1, np.int32)
    if len(runs):
        own_doc = block.doc_id[block.doc[runs]] == block.doc_id[block.doc[first]][of]
        n = block.size[runs]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        gone = ~(owned[np.repeat(begin[of], n) + place] & np.repeat(own_doc, n))
        where = (np.repeat(block.at[runs], n) + place)[gone]
        np.add.at(change, where, 1)
        np.add.at(change, where + width, -1)
    removed = np.cumsum(change) > 0
    out = []
    for i, s, e in zip(block.ids, block.starts.tolist(), block.ends.tolist(), strict=True):
        r = removed[s:e]
        spans = int(r[:1].sum() + (r[1:] & ~r[:-1]).sum())
        out.append((i, e - s, int(r.sum()), spans, hashlib.sha256(block.data[s:e][~r].tobytes()).hexdigest()))
    return _table(RESULT, *zip(*out, strict=True))


def repeated_bytes(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    if width < GRAM + 1:
        raise ValueError(f"width is {GRAM + 1} at least")
    text = F.col(text_col).cast("string")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    by_block = docs.select(integral(docs, id_col).alias("doc_id"), text.cast("binary").alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text)), F.lit(blocks)).alias("block"))
    names = by_block.groupBy("block").applyInArrow(lambda t: tell_names(t, width, buckets), NAMES)
    shared = _met(names, blocks, answer_names, merge_names, NAMES, pass_names)
    runs = by_block.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda t, a: send_runs(t, a, width, buckets), RUNS)
    owned = _met(runs, blocks, lambda t: own_windows(t, width), lambda t: merge_runs(t, width), RUNS, lambda t, a: pass_windows(t, a, width))
    return by_block.groupBy("block").cogroup(shared.union(owned).groupBy("block")).applyInArrow(lambda t, a: remove_spans(t, a, width, buckets), RESULT)


def _met(sent: DataFrame, blocks: int, answer, merge, kind: str, passed_on) -> DataFrame:
    """The answers to what blocks send to buckets, slot by slot where there are more than ``SLOT`` blocks."""
    if blocks <= SLOT:
        return sent.groupBy("bucket").applyInArrow(answer, BITS)
    by_slot = sent.withColumn("slot", F.floor(F.col("block") / SLOT)).groupBy("bucket", "slot")
    answers = by_slot.applyInArrow(merge, kind).groupBy("bucket").applyInArrow(answer, BITS)
    return by_slot.cogroup(answers.groupBy("bucket", "block")).applyInArrow(passed_on, BITS)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
