"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures.

A document's set holds its distinct word shingles (``size`` words; fewer words are one shingle), as 64-bit
hashes. A signature is ``SYMBOLS`` minima of ``b`` = 16 bits each. Two signatures that differ in at most
``MAX_DISTANCE`` symbols agree, by the pigeonhole principle, in all but one symbol of some chunk of
``CHUNK`` symbols: of ``SYMBOLS / CHUNK`` chunks with two errors each at least, 2 * 8 = 16 errors would be
needed to miss. So each document enumerates, chunk by chunk, the chunk with each one symbol left out, and
all pairs within the distance share a key. At a similarity of 0.85 a symbol differs with probability 0.15,
and 16 or more of 32 differ with a probability of about 3e-6. Every link is confirmed on the full sets.

Equal sets are one class; only class representatives (smallest id) are joined, so copies are never expanded.
What shares a key is first compared, on signatures, with one document of the key only (its smallest id), in
counts that grow with the documents, and not with the square of a group. The loose components of these
comparisons are clusters. Within a cluster all members are confirmed against the cluster's first document, in a
join that deals a large cluster to several tasks. Those that this leaves apart meet the others block by block:
first by signatures alone, which says who has a candidate in which pair of blocks; then only these bring
their sets there. A block gives out links of a spanning forest, never all pairs, and two blocks of what is in
one component already are not compared. Candidates across clusters, the few that are left, are found key by
key and confirmed by joins.

Tables that several steps read are kept on the executors' disks, and what a lost executor held is computed
anew; rounds of the components and the result are written to the shared folder.

Defined cases: null or empty texts have the empty set and are linked with nothing; rows with a null id are
never linked and keep a null component; repeated rows are one class, of which ``keep_one`` keeps one row; ids
must be integers; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, held, integral, kept, map_texts, partitions, saved, table, texts_of, without

SYMBOLS, CHUNK, MAX_DISTANCE = 32, 4, 15
#: Distance up to which a document joins the cluster of its key's first document.
LOOSE_DISTANCE = 24
#: Members of a cluster, their shingles, and members of a key that one task compares with as many others.
BLOCK, BLOCK_SHINGLES, KEY_BLOCK = 1024, 1 << 20, 512
#: Members of a cluster that one hub's set meets in one place, and rows of keys that are compared in one call.
STAR, SLOT = 10_000, 20_000
#: Ids are broadcast up to this many; beyond, the same join shuffles.
BROADCAST_IDS = 2_000_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self, most: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of one document's word hashes, sorted."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = mix(out ^ words[k : k + n]) + np.uint64(k + 1)
    return np.unique(out)


def sets_of(batch: pa.RecordBatch, hashes: WordHashes, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, texts in texts_of(batch):
        words = [x.lower().split() for x in texts]  # bytes: only A-Z, and only the six ASCII spaces
        flat = hashes([w for x in words for w in x])
        ends = np.cumsum([len(x) for x in words])
        yield rows, [shingles(flat[e - len(x) : e], size) for x, e in zip(words, ends, strict=True)]


def _signature(s: np.ndarray, seeds: np.ndarray) -> bytes:
    low = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):  # shingles are well mixed, so odd multipliers are enough to order them anew
        low = np.minimum(low, (s[k : k + 2048, None] * (seeds | np.uint64(1)) + (seeds >> np.uint64(7))).min(axis=0))
    return mix(low).astype("<u2").tobytes()


def _binary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(integral(docs, id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_key, signature``; equal sets have equal ``set_key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes, seeds = kept("hashes", WordHashes), mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64))
        for batch in batches:
            for rows, sets in sets_of(batch, hashes, size):
                keys = [xxh3_128_digest(s.tobytes()) for s in sets]
                signs = [_signature(s, seeds) if len(s) else b"" for s in sets]
                columns = [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "signature"])

    return map_texts(_binary(docs, id_col, text_col), run, "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary")


def set_table(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shingles``: the full sets as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("hashes", WordHashes)
        for batch in batches:
            for rows, sets in sets_of(batch, hashes, size):
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "shingles"])

    return map_texts(_binary(docs, id_col, text_col), run, "doc_id long, shingles array<long>")


def _symbol(k: int) -> Column:
    return F.substring("signature", 2 * k + 1, 2)


def chunk_keys(reps: DataFrame) -> DataFrame:
    """A row for each chunk of each signature and each one symbol of it left out."""
    keys = [F.xxhash64(F.lit(c), F.lit(out), *[_symbol(c + k) for k in range(CHUNK) if k != out]) for c in range(0, SYMBOLS, CHUNK) for out in range(CHUNK)]
    return reps.select("rep", "n_shingles", "signature", F.explode(F.array(*keys)).alias("key"))


def _distance(a: str, b: str) -> Column:
    """Symbols in which two signatures differ."""
    return sum((F.substring(a, 2 * k + 1, 2) != F.substring(b, 2 * k + 1, 2)).cast("int") for k in range(SYMBOLS))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` with 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    out = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return out.where(F.col("both") * (100 + percent) >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``rep, component`` of all that has a link: the smallest id reachable. Each round hooks neighbouring labels and then jumps to the label's label."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("near")).select("rep", F.least("rep", "near").alias("component"))
    label = saved(label, "labels")
    while True:
        near = both.join(label.select(F.col("rep").alias("b"), "component"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("component").alias("near"))
        hooked = label.join(near, "rep").select("rep", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = hooked.select(F.col("rep").alias("component"), F.col("component").alias("further"))
        new = saved(hooked.join(jump, "component").select("rep", "old", F.least("component", "further").alias("component")), "labels")
        discard(label)
        label, done = new, new.where("old != component").isEmpty()
        if done:
            break
    discard(both)
    return label


def find(label: np.ndarray, i: int) -> int:
    while label[i] != i:
        label[i] = i = label[label[i]]
    return i


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of incidence matrices a stretch of shingles at a time."""
    every = np.concatenate(sets)
    _, column = np.unique(every, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    used = np.bincount(column) > 1
    column, row = (np.cumsum(used) - 1)[column][used[column]], row[used[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [k, k + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        out += part[left] @ part[right].T
    return out


def candidates(joined: np.ndarray, first: np.ndarray, size: np.ndarray, signatures: np.ndarray, percent: int, one_block: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the ``left`` can be linked with which of the ``right``, in one block or between two; members with equal ``joined`` are together already."""
    left, right = (np.arange(len(size)),) * 2 if one_block else (np.flatnonzero(first), np.flatnonzero(~first))
    if not len(left) or not len(right):
        return left, right, np.zeros((len(left), len(right)), bool)
    near = np.concatenate([(signatures[left[k : k + 32], None] != signatures[right]).sum(axis=2) <= MAX_DISTANCE for k in range(0, len(left), 32)])
    near &= joined[left][:, None] != joined[right]
    if one_block:
        near &= left[:, None] < right
    near &= 100 * np.minimum(size[left][:, None], size[right]) >= percent * np.maximum(size[left][:, None], size[right])
    return left, right, near


def forest(rep: np.ndarray, joined: np.ndarray, first: np.ndarray, sets: list[np.ndarray], found: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what is apart among the candidates ``found``, confirmed on the sets."""
    left, right, near = found
    if not near.any():
        return []
    size = np.array([len(s) for s in sets])
    i, j = np.nonzero(near)
    if len(i) < 20:
        both = np.array([len(np.intersect1d(sets[left[x]], sets[right[y]], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:
        both = shared_counts(sets, left, right)[i, j]
    i, j = left[i], right[j]
    ok = both * (100 + percent) >= percent * (size[i] + size[j])
    _, label = np.unique(joined, return_inverse=True)
    up, out = np.arange(label.max() + 1), []
    for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
        a, b = find(up, label[x]), find(up, label[y])
        if a != b:
            up[a] = b
            out.append((int(min(rep[x], rep[y])), int(max(rep[x], rep[y]))))
    return out


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def links_to_hubs(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a < b`` of each cluster's members with its first, from ``rep, cluster, places, shingles``: a hub's set goes to each of the cluster's ``places``."""
    hubs = members.where("rep = cluster").select(F.col("cluster").alias("hub"), F.col("shingles").alias("hub_set"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    both = F.size(F.array_intersect("shingles", "hub_set"))
    at = F.pmod(F.xxhash64("rep"), F.col("places")).cast("int")
    star = members.where("rep != cluster").withColumn("at", at).join(hubs, (F.col("cluster") == F.col("hub")) & (F.col("at") == F.col("place")))
    star = star.where(both * (100 + percent) >= percent * (F.size("shingles") + F.size("hub_set")))
    return star.select(F.col("hub").alias("a"), F.col("rep").alias("b"))


def _facing(rest: Column, cores: Column, core: Column) -> Column:
    """The blocks that one of the rest or of the core must meet; those of the rest come first, those of the core don't meet each other."""
    return F.explode(F.sequence(F.lit(0), F.when(core, rest).otherwise(rest + cores) - 1))


def dealt_to_blocks(members: DataFrame, star: DataFrame) -> DataFrame:
    """A row, without its set, for each member and each pair of blocks that it takes part in."""
    core = star.select(F.col("b").alias("rep"), F.lit(True).alias("core"))
    known = members.select("rep", "cluster", "n_shingles", "signature").join(core, "rep", "left").withColumn("core", F.coalesce("core", F.col("rep") == F.col("cluster")))

    def blocks_of(some: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(some) / BLOCK, F.sum(F.when(some, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")

    blocks = known.groupBy("cluster").agg(blocks_of(~F.col("core")).alias("rest"), blocks_of(F.col("core")).alias("cores")).where("rest > 0")
    mine = F.when(F.col("core"), F.col("rest") + F.pmod(F.xxhash64("rep"), F.col("cores"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rest"))).cast("int")
    dealt = known.join(blocks, "cluster").withColumn("mine", mine).withColumn("other", _facing(F.col("rest"), F.col("cores"), F.col("core")))
    return dealt.select("cluster", "rep", "core", "n_shingles", "signature", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))


def links_in_clusters(members: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Links ``a < b`` that, with those in ``star``, make the components of each cluster, from ``rep, cluster, n_shingles, signature, shingles``."""
    dealt = dealt_to_blocks(members, star)

    def arrays(rows: pa.Table) -> tuple:
        rep, core, mine, size = (rows.column(c).to_numpy() for c in ("rep", "core", "mine", "n_shingles"))
        joined = np.where(core.astype(bool), rows.column("cluster").to_numpy(), rep)
        signs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u2").reshape(len(rows), SYMBOLS)
        return rep, joined, mine == rows.column("x")[0].as_py(), size, signs, rows.column("x")[0] == rows.column("y")[0]

    def meeting(rows: pa.Table) -> pa.Table:
        _, joined, first, size, signs, one_block = arrays(rows)
        left, right, near = candidates(joined, first, size, signs, percent, one_block)
        meets = np.zeros(len(rows), bool)
        meets[left[near.any(axis=1)]] = meets[right[near.any(axis=0)]] = True
        return rows.filter(pa.array(meets))

    def linked(rows: pa.Table) -> pa.Table:
        rep, joined, first, size, signs, one_block = arrays(rows)
        sets = [x.values.to_numpy() for x in rows.column("shingles")]
        return _links(forest(rep, joined, first, sets, candidates(joined, first, size, signs, percent, one_block), percent))

    met = dealt.groupBy("cluster", "x", "y").applyInArrow(meeting, dealt.schema)
    return met.join(members.select("rep", "shingles"), "rep").groupBy("cluster", "x", "y").applyInArrow(linked, "a long, b long")


def pairs_across(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Candidates ``a < b`` that share a key and lie in different clusters, from ``n`` rows; keys of a slot are taken together, large ones by blocks."""
    slots = max(partitions(members.sparkSession), n // SLOT + 1)
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / KEY_BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "rep", "cluster", "n_shingles", "signature", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "rep", "cluster", "n_shingles", "signature", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.pmod("key", F.lit(slots)).alias("slot"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("key").to_numpy(), kind="stable")))
        key, rep, cluster, n, mine = (rows.column(c).to_numpy() for c in ("key", "rep", "cluster", "n_shingles", "mine"))
        sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u2").reshape(len(rows), SYMBOLS)
        x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
        heads, found = np.flatnonzero(np.append(True, key[1:] != key[:-1])), []
        for s, e in zip(heads, np.append(heads[1:], len(key)), strict=True):
            own = np.arange(s, e)
            left, right = (own, own) if x == y else (own[mine[s:e] == x], own[mine[s:e] != x])
            for k in range(0, len(left), 64):
                i = left[k : k + 64]
                ok = (cluster[i][:, None] != cluster[right]) & (100 * np.minimum(n[i][:, None], n[right]) >= percent * np.maximum(n[i][:, None], n[right]))
                p, q = np.nonzero(ok)
                near = (sig[i[p]] != sig[right[q]]).sum(axis=1) <= MAX_DISTANCE
                p, q = rep[i[p[near]]], rep[right[q[near]]]
                found.append(np.column_stack([np.minimum(p, q), np.maximum(p, q)]))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("slot", "x", "y").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_shingles, class_id`` (smallest id with an equal set), ``component_id``, ``kept``; a written table."""
    spark = docs.sparkSession
    sigs = held(signatures(docs, size, id_col, text_col))
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    reps = held(reps)
    keys = chunk_keys(reps)
    buckets = held(keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    # What each document has in common with one document of each of its keys.
    to_hub = keys.select("rep", "key").join(buckets.select("key", "hub"), "key").where("rep != hub").select("rep", "hub").distinct()
    about = reps.select(F.col("rep").alias("hub"), F.col("signature").alias("hub_signature"))
    to_hub = to_hub.join(reps.select("rep", "signature"), "rep").join(about, "hub").where(_distance("signature", "hub_signature") <= LOOSE_DISTANCE)
    found = components(spark, to_hub.select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    clusters = found.select("rep", F.col("component").alias("cluster"))
    large = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / STAR).cast("int").alias("places")).where("places > 1")
    sets = _sets(docs, clusters.select("rep"), size, id_col, text_col).withColumnRenamed("doc_id", "rep")
    members = clusters.join(large, "cluster", "left").fillna(1, "places").join(reps, "rep").join(sets, "rep").drop("set_key")
    members = held(members)
    star = held(links_to_hubs(members, percent))
    links = saved(star.union(links_in_clusters(members, star, percent)), "links")
    star.unpersist()
    members.unpersist()
    # What shares a key across clusters.
    labelled = keys.join(buckets.select("key"), "key").join(clusters, "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    apart = held(labelled.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"))
    n = apart.agg(F.sum("n")).first()[0] or 0
    rest = saved(pairs_across(labelled.join(apart.select("key"), "key"), n, percent), "pairs")
    wanted = rest.select(F.col("a").alias("rep")).union(rest.select("b")).distinct()
    across = confirmed(rest, held(sets := _sets(docs, wanted, size, id_col, text_col)), percent)
    joined = components(spark, links.union(across))
    found_in = reps.select("rep").join(joined.select("rep", "component"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
    classes = reps.select("set_key", F.col("rep").alias("class_id")).join(found_in.withColumnRenamed("rep", "class_id"), "class_id")
    out = some.join(classes, "set_key").select("doc_id", "text_hash", "n_shingles", "class_id", F.col("component").alias("component_id"))
    alone = sigs.where("n_shingles = 0 or doc_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    out = saved(out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "groups")
    for x in (sigs, reps, buckets, apart, sets):
        x.unpersist()
    discard(found, rest, links, joined)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """The full sets of the documents with the ids in ``wanted``."""
    ids = wanted.select(F.col("rep").alias("_wanted"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    some = docs.select(integral(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return set_table(some.join(ids, F.col("doc_id") == F.col("_wanted"), "left_semi"), size)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, and one row of what is repeated with id and text; columns as they were."""
    groups = near_duplicates(docs, size, percent)
    gone = groups.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    left = without(docs, gone)
    again = saved(groups.where("kept and doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "again")
    discard(groups)
    if again.isEmpty():
        return left
    key = again.select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash"))
    same = (F.col("doc_id") == F.col("again_id")) & (F.xxhash64("text") == F.col("again_hash"))
    one = left.join(key, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(key, same, "left_anti").unionByName(one)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def neardup_sql(size: int, percent: int, documents: str = "documents") -> str:
    """DuckDB SQL for the groups, over the given table."""
    return f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + {size} - 1), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size} + 1, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM l JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM {documents} d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


QUERIES = {"op5_minhash_neardup": op5_minhash_neardup}
ORACLE_SQL = {"op5_minhash_neardup": neardup_sql(3, 85)}
