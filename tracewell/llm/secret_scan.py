"""Secret scans: three fixed patterns, and strings that are novel to a dictionary-primed zstandard compressor.

A candidate is a run of 16 or more key characters with letters and digits, or with letters whose case changes
again and again, outside the pattern spans, with a sensitive word in the ``NEAR`` characters before it. Its novelty
is marginal: the compressed bytes of the text around it with the candidate, less those without it, by a compressor
primed with a dictionary of identifiers: those that most documents of the corpus hold, ``IDENTIFIERS`` of them, and
usual ones. Names and repeated strings cost little there. What a random string costs depends on the place too,
so the cost is held against the mean cost of fixed random strings of the same length in the same place; the same is
measured beside plain code, for places that hold little else than keys, and the lower share counts. A candidate
that costs ``MIN_NOVELTY`` of a random string or more is reported as kind ``novel``. Identifiers with digits are
not learnt, so that a key that was copied often stays novel.

A candidate that only a dot or a line break parts from one with sensitive context has that context too. Runs joined
by dots are one secret: with one of them all are reported. So are the lines between the heading and the end of a
private key.

Offsets count code points, ends are exclusive. Defined cases: null or empty texts have no spans; repeated
rows each get their row; null ids are kept; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_texts, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as longer matches of [0-9a-f]+
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "private key", "credential", "bearer", "authorization", "signature")
#: What may stand between two parts of one secret: dots, or a line break, also an escaped one (its n is read as the next part's).
DOTS, BREAK = re.compile(r"\.{1,2}"), re.compile(r"[\x20\t]*\r?\n[\x20\t>|]*|\\(?:r\\)?")
KEY, KEY_END, LINE, PART = re.compile(r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----"), "-----END", re.compile(r"[^\r\n]+"), re.compile(r"[A-Za-z0-9+/_=-]+")
NEAR, AROUND, MIN_NOVELTY, REFERENCES = 48, 512, 0.8, 4
KEY_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Words of an identifier, joined by underscores or by capitals; how many are learnt, and how many documents must hold one.
IDENTIFIER, IDENTIFIERS, LEAST = r"\b(?:[A-Za-z]{1,24}(?:_[A-Za-z]{1,24}){1,6}|[A-Za-z][a-z]{1,24}(?:[A-Z][a-z]{1,24}){1,6})\b", 1500, 3
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])|(?:.*?[a-z][A-Z]){3}")
KINDS = ("assign", "access", "hex", "novel")


#: Plain code, beside which candidates are measured too.
PLAIN = """for each row in the table: if the time limit of that worker is over then close it, else keep what it did so far.
def load_config(path, default=None): with open(path) as f: return parse(f.read()) or default  # nothing to do yet
class QueueWorker: def run(self, jobs): self.count += 1; log.info("took %d jobs of %s", len(jobs), self.host_name)
void copyBytes(char *from, size_t n) { while (n-- > 0) emit(*from++); } /* see the notes on buffers and on blocks */
"""


def identifier_dictionary() -> bytes:
    """Identifiers as code writes them: words joined by the usual conventions."""
    first = ("get", "set", "is", "has", "new", "load", "read", "write", "parse", "build", "create", "update", "delete", "find", "open", "close")
    last = ("value", "name", "key", "token", "secret", "password", "config", "client", "server", "request", "response", "user", "session", "path", "file", "index", "string", "number", "buffer", "handler")
    joined = [f(a, b) for a in first for b in last for f in (lambda a, b: f"{a}_{b}", lambda a, b: a + b.title(), lambda a, b: f"{a}-{b}".upper())]
    lines = [f'{w} = "' for w in SENSITIVE]
    return "\n".join([*joined, *lines, "return self.", "import ", "function ", "const ", "https://www.example.com/", "0123456789", "abcdefghijklmnopqrstuvwxyz"]).encode()


def learned_identifiers(docs: DataFrame, text_col: str = "text", most: int = IDENTIFIERS, least: int = LEAST) -> tuple[str, ...]:
    """The identifiers that most documents hold, the most common last; counted over all whole texts, ``most`` rows come back."""
    text = F.col(text_col).cast("string")
    words = docs.where(text.rlike("[a-z][A-Z]|[A-Za-z]_[A-Za-z]")).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)))).alias("word"))
    counts = words.where(F.length("word").between(6, 64)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return tuple(r["word"] for r in counts.orderBy(F.col("n").desc(), "word").limit(most).collect()[::-1])


class Novelty:
    def __init__(self, learned: tuple[str, ...] = ()):
        import zstandard

        words = ("\n".join(learned) + "\n").encode() + identifier_dictionary()
        data = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(6, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.compress = zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress

    def __call__(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes of ``text[start:end]`` by those of random strings, in its place or beside plain code, whichever is less."""
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND] + "\n"
        return min(self.share(around, text[start:end]), self.share(PLAIN, text[start:end]))

    def share(self, around: str, candidate: str) -> float:
        cost = lambda x: len(self.compress((around + x).encode("utf-8", "surrogatepass")))
        without = cost("")
        usual = sum(cost(x) - without for x in random_strings(len(candidate))) / REFERENCES
        return (cost(candidate) - without) / max(usual, 1)


@lru_cache(256)
def random_strings(n: int) -> list[str]:
    """The same few strings of letters and digits for each length."""
    rng = random.Random(n)
    return ["".join(rng.choices(KEY_LETTERS, k=n)) for _ in range(REFERENCES)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    low, out = text.lower(), []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    low, out = text.lower(), []
    if not any(w in low for w in SENSITIVE):
        return out
    free = lambda s, e: not any(a < e and s < b for a, _, b in base)
    is_novel = lambda s, e: free(s, e) and novelty(text, s, e) >= MIN_NOVELTY
    groups, end = key_parts(text), None
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        between = text[end:s] if end is not None and s - end <= NEAR else ""
        mixed = MIXED.match(m[0])
        if DOTS.fullmatch(between):
            groups[-1].append((s, e))
        elif mixed and (BREAK.fullmatch(between) or any(w in text[max(0, s - NEAR) : s].lower() for w in SENSITIVE)):
            groups.append([(s, e)])
        else:
            end = None
            continue
        end = e
    for group in groups:
        if any(e - s >= 16 and is_novel(s, e) for s, e in group):
            out += [(s, 3, e) for s, e in group if free(s, e)]
    return sorted(set(out))


def key_parts(text: str) -> list[list[tuple[int, int]]]:
    """The runs of key characters of each private key between its heading and its end, without its header fields."""
    out, end = [], 0
    while (m := KEY.search(text, end)) and (end := text.find(KEY_END, m.end())) >= 0:
        out.append([x.span() for line in LINE.finditer(text, m.end(), end) if ":" not in line[0] for x in PART.finditer(text, *line.span())])
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and hash of the pattern spans, and all spans."""
    learned = learned_identifiers(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = kept(("novelty", hash(learned)), lambda: Novelty(learned))
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, novelty))
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; columns as they were, ``n_chars`` (if there) counted anew."""
    names = docs.columns
    learned = learned_identifiers(docs, text_col)
    at, count_at = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str, novelty: Novelty) -> str:
        base = base_spans(text)
        out, end = [], 0
        for s, _, e in sorted(base + novel_spans(text, base, novelty)):
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = kept(("novelty", hash(learned)), lambda: Novelty(learned))
        for batch in batches:
            cols = list(batch.columns)
            texts = [None if t is None else clean(t, novelty) for t in (x.as_py() for x in cols[at])]
            cols[at] = pa.array(texts, cols[at].type)
            if count_at is not None:
                old = cols[count_at].to_pylist()
                cols[count_at] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], cols[count_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_texts(docs, run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE_SQL: dict[str, str] = {}
