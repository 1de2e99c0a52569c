"""Best-fit packing with Martello-Toth dominance reduction.

Texts become token ids (then id 0); only documents longer than ``capacity`` are cut, into pieces of that
length. What decides a packing is how many pieces have each length, at most ``capacity`` numbers however
large the corpus is. On that histogram the reduction fixes, many equal bins at once, sets that provably
dominate all other bins with their largest piece: a piece that nothing fits beside; a pair that fills the
bin exactly, or where only one more piece fits; a pair or a triple of the largest pieces that fit, where no
more than two fit beside it. The rest is packed best-fit decreasing, again by whole classes of equal bins,
with the same result as piece by piece. Spark then gives each piece its rank among the pieces of its length
(salted, so that a length with a third of all pieces is dealt out) and the rank decides the place.

Defined cases: a null or empty text is the single id 0; repeated rows are packed as documents of their own;
an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_texts, partitions, saved, table, texts_of

#: Chunks and words that a worker knows at most, beside those of the slice at hand, and those that stay when there are more: the ones found most often.
VOCABULARY, CACHE, STAY = "word_bpe_49k.json", 320_000, 120_000
#: Marks that stand alone beside a word: not the apostrophe, which starts endings, nor what special tokens are made of.
MARKS = ".,;:!?\"()[]{}*#$%&/-_+=@~^"


class ChunkTokenizer:
    """Ids of texts, by chunks between white space and, within most chunks, by words and marks around them.

    No token crosses white space, nor the border of a run of letters and a run of marks, so both can be kept
    in bounded caches. Each word's last token, and no other, ends with the end mark of the vocabulary, so many
    words are encoded in one call and told apart by it. Chunks of other shapes are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.chunks, self.words = Known(), Known()

    def parts(self, chunk: bytes) -> tuple[str, ...] | None:
        """Marks, word and marks in lower case, if that is what the chunk is made of."""
        text = chunk.decode()
        if not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text)):
            return None
        low = text.lower()
        if low.isalpha():
            return (low,)
        word = low.rstrip(MARKS)
        if word.isalpha():
            return (word, low[len(word) :])
        word = low.strip(MARKS)
        if word.isalpha():
            at = low.find(word)
            return tuple(x for x in (low[:at], word, low[at + len(word) :]) if x)
        return None

    def learn_words(self, new: list[str]) -> None:
        for k in range(0, len(new), 20_000):
            own = new[k : k + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            self.words.put(own, ids, np.diff(ends, prepend=0))

    def learn(self, new: list[bytes]) -> None:
        found = list(map(self.parts, new))
        split = [p for p in found if p]
        if split:
            flat = [w for p in split for w in p]
            ids, lens = self.words.ids(self.words.find(flat, self.learn_words))
            first = np.cumsum([0, *map(len, split)])[:-1]
            self.chunks.put([x for x, p in zip(new, found, strict=True) if p], ids, np.add.reduceat(lens, first))
        for x in [x for x, p in zip(new, found, strict=True) if not p]:
            ids = np.array(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids, np.uint32)
            self.chunks.put([x], ids, np.array([len(ids)]))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has; ``at`` and ``n_chunks`` then say which known chunks they were."""
        for known in (self.chunks, self.words):
            if len(known.index) > CACHE:
                known.shrink(STAY)
        chunks = [x.split() for x in texts]
        self.at, self.n_chunks = self.chunks.find([c for x in chunks for c in x], self.learn), np.array([len(x) for x in chunks], np.int64)
        ids, lens = self.chunks.ids(self.at)
        bounds = np.append(0, np.cumsum(lens))[np.append(0, np.cumsum(self.n_chunks))]
        return ids, np.diff(bounds)


class Known:
    """Strings and their ids, in one growing array."""

    def __init__(self):
        self.index: dict = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens, self.hits = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def shrink(self, most: int) -> None:
        """Keep the ``most`` keys that were found most often; what they were found counts half from here on."""
        n = len(self.index)
        stay = np.sort(np.argsort(-self.hits[:n], kind="stable")[:most])
        keys = np.array(list(self.index), object)[stay].tolist()
        (ids, lens), hits = self.ids(stay), self.hits[stay] // 2
        self.__init__()
        self.put(keys, ids, lens)
        self.hits[: len(keys)] = hits

    def put(self, keys: list, ids: np.ndarray, lens: np.ndarray) -> None:
        at, n = len(self.index), len(keys)
        if at + n > len(self.starts):
            more = max(2 * len(self.starts), at + n)
            self.starts, self.lens = np.resize(self.starts, more), np.resize(self.lens, more)
            self.hits = np.append(self.hits[:at], np.zeros(more - at, np.int32))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at : at + n], self.lens[at : at + n] = self.used + np.cumsum(lens) - lens, lens
        self.used += len(ids)
        self.index.update(zip(keys, range(at, at + n), strict=True))

    def find(self, keys: list, learn) -> np.ndarray:
        """Where each key is; ``learn`` is told the unknown ones first."""
        get = self.index.get
        at = np.fromiter(map(get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            learn(list({keys[k] for k in missing}))
            at[missing] = [get(keys[k]) for k in missing]
        self.hits[: len(self.index)] += np.bincount(at, minlength=len(self.index)).astype(np.int32)
        return at

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(total)], lens


def tokens_of(path: str) -> ChunkTokenizer:
    """One tokenizer for each Python worker, so that its caches serve all of the worker's tasks."""
    return kept(("tokens", path), lambda: ChunkTokenizer(path))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: ``doc_id, piece, start, length, ids_crc32``."""
    path = path or tokenizer_path(VOCABULARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        tokens = tokens_of(path)
        for batch in batches:
            for rows, texts in texts_of(batch, limit=1 << 20):
                ids, counts = tokens.encode(texts)
                out, at = [], 0
                for doc, n in zip(rows.column(0).to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(0)).astype("<u4")
                    at += n
                    for k in range(0, n + 1, capacity):
                        out.append((doc, k // capacity, k, min(capacity, n + 1 - k), crc32(own[k : k + capacity].tobytes())))
                doc, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, rows.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    return map_texts(source, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Fix dominating sets in ``count`` (pieces by length, changed in place): the sets and how often each is used."""
    fixed = []

    def below(limit: int, without: tuple[int, ...] = ()) -> int:
        """The largest length up to ``limit`` that is left, once those in ``without`` are gone; 0 if none."""
        for x in np.flatnonzero(count[1 : limit + 1])[::-1] + 1 if limit > 0 else ():
            if count[x] > without.count(x):
                return int(x)
        return 0

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for x in np.flatnonzero(count):
            out += [int(x)] * min(n - len(out), int(count[x]) - (x == without))
            if len(out) == n:
                break
        return out

    def dominating(s: int) -> list[int] | None:
        room, few = capacity - s, smallest(3, s)
        if not few or few[0] > room:
            return [s]
        t = below(room, (s,))
        if t == room or len(few) < 2 or few[0] + few[1] > room:
            return [s, t]
        if len(few) == 3 and sum(few) <= room:
            return None  # three more can fit
        best = second = 0
        for y in np.flatnonzero(count[1 : room // 2 + 1])[::-1] + 1:
            if count[y] > (s == y) and (x := below(room - int(y), (s, int(y)))) >= y:
                second, best = max(second, int(y)), max(best, int(x + y))
        if t >= best:
            return [s, t]
        y = below(room - t, (s, t))
        return [s, t, y] if y and y >= second else None

    again = True
    while again:
        again = False
        for s in np.flatnonzero(count)[::-1].tolist():
            while count[s] and (found := dominating(s)):
                need = Counter(found)
                times = min(int(count[x]) // n for x, n in need.items())
                for x, n in need.items():
                    count[x] -= n * times
                fixed.append((found, times))
                again = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over classes of equal bins: ([(length, copies)], how many such bins)."""
    bins: dict[int, list] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def add(fill: list, times: int, room: int) -> None:
        if times:
            if not bins[room]:
                insort(rooms, room)
            bins[room].append((fill, times))

    for s in np.flatnonzero(count)[::-1].tolist():
        n = int(count[s])
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                fill, times, room = [], n, capacity
            else:
                room = rooms[at]
                fill, times = bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
            copies = room // s
            full = min(times, n // copies)
            n -= full * copies
            add([*fill, (s, copies)], full, room - copies * s)
            if full < times and n:
                add([*fill, (s, n)], 1, room - n * s)
                n, full = 0, full + 1
            if fill:
                add(fill, times - full, room)
    return [x for group in bins.values() for x in group]


def plan_places(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of ranks: (length, first rank, rank after the last, copies in a bin, first sequence, offset). Their number depends on ``capacity`` alone."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    groups = [(list(Counter(found).items()), times) for found, times in reduce_by_dominance(count, capacity)] + best_fit(count, capacity)
    used, runs, sequence = Counter(), [], 0
    for fill, times in groups:
        offset = 0
        for length, copies in fill:
            runs.append((length, used[length], used[length] + copies * times, copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    return runs


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(2 * partitions(spark))).cast("int")
    pieces = saved(cut_pieces(docs, capacity, path, id_col, text_col).withColumn("salt", salt), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``capacity`` rows at most
    runs = plan_places(histogram, capacity)
    plan = spark.createDataFrame(runs or [(0, 0, 0, 1, 0, 0)], "run_length long, first long, last long, copies long, sequence long, run_offset long")
    before = F.sum("n").over(_by("length").orderBy("salt")) - F.col("n")
    offsets = counts.select(F.col("length").alias("c_length"), F.col("salt").alias("c_salt"), before.alias("before"))
    rank = F.row_number().over(_by("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("rank", rank).join(offsets, (F.col("length") == F.col("c_length")) & (F.col("salt") == F.col("c_salt")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank") - 1)
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    k = F.col("rank") - F.col("first")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.expr("(rank - first) div copies")).alias("sequence_id"), (F.col("run_offset") + k % F.col("copies") * F.col("length")).alias("offset"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
