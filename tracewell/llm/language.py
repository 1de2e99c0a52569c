"""Language identification by hyperdimensional profiles.

Every letter (and one mark for whatever stands between letters) has a random vector of +1 and -1. A trigram's
vector binds its three letters' vectors, rotated by two places, one and none, by multiplication; a text's
vector bundles (sums) those of all its trigrams; a language's prototype bundles those of its training
texts. A text gets the language whose prototype, less the mean prototype's direction, has the highest
cosine with it.

Letters are lower-cased. A text is padded with the mark, so that one letter is enough for a trigram.
Defined cases: null texts and texts without letters are ``und`` with score 0; ties go to the language that
sorts first; without any labelled text everything is ``und``; rows without a language are not learnt from;
repeated rows count again; null ids are kept; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, kept, map_texts, table, texts_of, without

#: Bytes of text and texts that are bundled at once, trigrams for which vectors are made at once, and letters whose vectors are kept.
SLICE, TEXTS, COLUMNS, LETTERS = 512 << 10, 1024, 4096, 20_000
DIMENSIONS = 1024
#: Score that a long text needs to stay, and the number of letters up to which none is needed.
MIN_SCORE, FEW = 0.24, 50


@lru_cache(None)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_vector(letter: int, dimensions: int) -> np.ndarray:
    known = kept("letters", dict)
    if (letter, dimensions) not in known:
        if len(known) >= LETTERS:
            known.clear()
        known[letter, dimensions] = np.random.default_rng([letter, dimensions]).choice(np.array([-1, 1], np.float32), dimensions)
    return known[letter, dimensions]


def letter_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, marks as 0, each text padded by one mark; the text of each; how many letters each text has."""
    parts = [np.frombuffer(x.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    sizes = np.array([len(p) + 1 for p in parts])
    flat, ends = np.zeros(sizes.sum(), np.uint32), np.cumsum(sizes)
    for p, e in zip(parts, ends, strict=True):
        flat[e - 1 - len(p) : e - 1] = p
    flat[~_letters()[flat]] = 0
    doc = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(doc[flat > 0], minlength=len(texts))
    keep = np.append(True, (flat[1:] > 0) | (flat[:-1] > 0))
    return flat[keep], doc[keep], letters


def bundle(texts: list[bytes], groups: np.ndarray, n_groups: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed trigram vectors of each group of texts, and the number of letters of each text."""
    flat, doc, letters = letter_codes(texts)
    alphabet, code = np.unique(flat, return_inverse=True)
    n = len(alphabet)
    out = np.zeros((n_groups, dimensions), np.float32)
    if n < 2:
        return out, letters
    code = np.concatenate([[0], code, [0]]).astype(np.int64)  # alphabet[0] is the mark
    tri = (code[:-2] * n + code[1:-1]) * n + code[2:]
    tri, group = tri[code[1:-1] > 0], groups[doc][code[1:-1] > 0]
    if n**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(tri, minlength=n**3))
        place = np.zeros(n**3, np.int64)
        place[used] = np.arange(len(used))
        column = place[tri]
    else:
        used, column = np.unique(tri, return_inverse=True)
    vectors = np.stack([letter_vector(int(a), dimensions) for a in alphabet])
    one, two = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
    for k in range(0, len(used), COLUMNS):
        own = used[k : k + COLUMNS]
        here = slice(None) if len(used) <= COLUMNS else (column >= k) & (column < k + COLUMNS)
        counts = np.bincount(group[here] * len(own) + (column[here] - k), minlength=n_groups * len(own)).reshape(n_groups, len(own))
        out += counts.astype(np.float32) @ (two[own // (n * n)] * one[own // n % n] * vectors[own % n])
    return out, letters


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """A unit vector for each language; the sums are made on the executors, ``dimensions`` numbers for each language come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, texts in texts_of(batch, limit=SLICE, rows=TEXTS):
                langs, group = np.unique(np.array(rows.column(0).to_pylist(), object), return_inverse=True)
                for lang, v in zip(langs, bundle(texts, group, len(langs), dimensions)[0], strict=True):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    some = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sums = map_texts(some, run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang", "k").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r["lang"], np.zeros(dimensions))[r["k"]] = r["x"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, n_letters`` for every row; the score is the cosine, 0 at least."""
    names = list(profiles)
    raw = np.stack([profiles[k] for k in names]) if names else np.zeros((0, dimensions))
    centre = raw.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    own = raw - centre
    own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in texts_of(batch, limit=SLICE, rows=TEXTS):
                v, letters = bundle(texts, np.arange(len(texts)), len(texts), dimensions)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                langs, score = ["und"] * len(texts), np.zeros(len(texts))
                if names:
                    cos = (v - centre.astype(np.float32)) @ own.T
                    best = cos.argmax(axis=1)
                    cosine = np.clip((v * raw.astype(np.float32)[best]).sum(axis=1), 0, 1)
                    langs = [names[b] if n else "und" for b, n in zip(best, letters, strict=True)]
                    score = np.where(letters > 0, cosine, 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.int64())], ["doc_id", "lang_pred", "score", "n_letters"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_texts(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, lang_pred string, score double, n_letters long")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that have no letters or are in no learnt language; columns as they were.

    Short clean texts can score low, so a text of n letters needs ``min_score * (1 - FEW / n)``. Without any profile
    all texts with letters stay.
    """
    profiles = prototypes(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = identify(docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text"), profiles)
    needed = min_score * (1 - FEW / F.greatest("n_letters", F.lit(1)))
    bad = found.where((F.col("n_letters") == 0) | (F.lit(bool(profiles)) & (F.col("score") < needed)))
    return without(docs, bad.select(F.col("doc_id.doc_id").alias("gone_id"), F.col("doc_id.h").alias("gone_hash")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    found = identify(docs, prototypes(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
