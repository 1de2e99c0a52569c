"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Candidates are the spans of four fixed patterns (email, ip, card, phone) and of wider ones: addresses spelled out, IPv6,
cards that fail their checksum or use other separators, national phone numbers, identity numbers, and names. Seven
labelers vote for, against or not at all: the fixed pattern, the shape, the checksum (patterns); known endings,
issuers, calling codes, given names and words that are no names (gazetteers); words before that speak for the kind or against it, and
what the span touches (context). What Spark counts over all documents is how often each kind has each combination
of votes: ``KINDS * 3^7`` rows at most. From these counts expectation-maximisation estimates how often each labeler
says what about true and false spans, by kind, without any label. The probabilities it gives train the final classifier, a
logistic regression over votes, shape and surrounding words, on a bounded ``SAMPLE`` of different candidates (those with the
smallest hash) and on all combinations of votes. It adds a wider span where its probability is ``MIN_P`` or more and no checksum
speaks against it, which in a small corpus weighs too little; spans of the fixed
patterns always stay, and what overlaps them is no candidate.

Offsets count code points, ends are exclusive. Defined cases: null or empty texts have no spans; repeated rows
each get their row; null ids are kept; a corpus without candidates has the priors as its model; very long texts are read
whole; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, saved, table

KINDS = ("email", "ip", "card", "phone", "ident", "name")
EMAIL, IP, CARD, PHONE, IDENT, NAME = range(6)
#: The fixed patterns. Runs are possessive where giving back could not help, so long runs cost their length once.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
FOUR = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The wider patterns, and what must be in the text before one is searched.
SPELLED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?(?!(?:the|an?|this|that|my|our|your|its)\x20)[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,24}){1,4}(?![A-Za-z0-9])")
SPELLING = ("(at)", "[at]", "{at}", " dot ", "[dot]", "(dot)", "{dot}")
COLONS = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![\w:])")
GROUPED = re.compile(r"(?<![\w./_-])[0-9]{4}([./_\x20-])[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,4})?(?![\w./_-])")
NATIONAL = re.compile(r"(?<![\w+./-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![\w/-]|\.[0-9])")
SOCIAL = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NAMES = re.compile(r"(?<![\w'’-])[A-ZÀ-Þ][a-zß-ÿ]{1,24}(?:\x20[A-ZÀ-Þ]\.)?(?:\x20[A-ZÀ-Þ][a-zß-ÿ'’-]{1,24}){1,2}(?!\w)")

#: Gazetteers. Short lists of what is common; what they don't hold gets no vote, or one vote against among seven.
ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be ch at pt se no dk fi pl cz ru ua tr in cn jp kr br mx ar au nz ca us eu example test".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "971", "972")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|62")
GIVEN = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Anna Maria Peter Paul Hans Klaus Jürgen Sabine Monika Ursula Andreas Stefan Jean Pierre Michel Marie Nathalie Isabelle Jacques Philippe José Juan Carlos Luis Carmen Ana Lucía Javier Miguel Sofia Ahmed Fatima Wei Li Priya Raj".split())
TITLES = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?\x20$")
NO_NAMES = frozenset("License Licence Public Street Avenue Road University Institute Inc Ltd Corp Company Foundation Version Software North South East West New United States City River Island County January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday The This That".split())
#: Words before a span that speak for its kind, and words that speak against any.
CUES = tuple(re.compile(rf"(?i)(?<![a-zß-ÿ])(?:{x})(?![a-zß-ÿ])") for x in (
    "e-?mail|mail|contact|write to|reach|courriel|correo|adresse", "ip|host|address|server|adresse|dirección", "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta", "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|téléphone|teléfono|móvil",
    "ssn|social security|iban|account|konto|compte|cuenta", "name is|named|contact|dear|signed|regards|sincerely|ask for|call|meet|mein name ist|ich heiße|je m'appelle|nom|me llamo|nombre",
))
AGAINST = re.compile(r"(?i)(?<![a-z])(?:version|ver|v|release|section|chapter|isbn|issn|doi|order|invoice|sku|part|build|rfc|commit|serial|ratio|page|pages|fig|figure|table|date|since|until|port)(?![a-z])[\x20:.#=]*$")
BEFORE, AFTER, CLOSE = 40, 24, 24

SAMPLE, FEATURES, MIN_P, STEPS, L2 = 20_000, 4096, 0.9, 300, 1e-4
#: Hashes of candidates with their surroundings are below this.
HASHES = 1 << 56
LABELERS = ("pattern", "shape", "checksum", "gazetteer", "cue", "against", "touching")
CHECKSUM = LABELERS.index("checksum")
#: What a labeler is taken to say before anything is counted, about a true span: for, nothing, against; turned round about a false one (a checksum fails by chance alone). So many spans' worth.
PRIOR, CHECKSUM_PRIOR, WEIGHT, ROUNDS = (0.5, 0.45, 0.05), (0.5, 0.499, 0.001), 20.0, 100


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out, free = [], 0
    while "@" in text and (m := AT.search(text, free)):  # what stands before an @ can't hold one: each stretch is read once
        stretch = text[max(free, text.rfind("@", free, m.start()) + 1) : m.start()]
        start = m.start() - (len(stretch) - len(stretch.rstrip(LOCAL)))
        if start < m.start():
            out.append((start, EMAIL, m.end()))
            free = m.end()
        else:
            free = m.start() + 1
    out += [(m.start(), IP, m.end()) for m in FOUR.finditer(text) if all(len(n := p.lstrip("0")) < 4 and int(n or 0) < 256 for p in m[0].split("."))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        out += [(m.start(), PHONE, m.end()) for m in PLUS.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(out)


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the wider patterns, where no fixed one has a span; of those that overlap one counts, by the order of the searches below."""
    found = []
    low = text.lower()
    if any(x in low for x in SPELLING):
        found += [(m.start(), EMAIL, m.end()) for m in SPELLED.finditer(text)]
    if ":" in text:
        found += [(m.start(), IP, m.end()) for m in COLONS.finditer(text) if "::" in m[0] or m[0].count(":") == 7]
    if any(c in text for c in "0123456789"):
        found += [(m.start(), IDENT, m.end()) for p in (SOCIAL, ACCOUNT) for m in p.finditer(text)]
        found += [(m.start(), CARD, m.end()) for m in DIGITS.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(only_digits(m[0])) <= 19]
        found += [(m.start(), CARD, m.end()) for m in GROUPED.finditer(text) if 14 <= len(only_digits(m[0])) <= 19]
        found += [(m.start(), PHONE, m.end()) for m in NATIONAL.finditer(text) if 9 <= len(only_digits(m[0])) <= 13]
    for m in NAMES.finditer(text):
        first = m[0].split(" ", 1)[0]
        if first in GIVEN or TITLES.search(text, max(0, m.start() - 12), m.start()) or CUES[NAME].search(text, max(0, m.start() - CLOSE), m.start()):
            found.append((m.start(), NAME, m.end()))
    if not found:
        return found
    out, starts, ends = [], [], []  # of what is taken: disjoint, in order
    for s, _, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for s, k, e in found:
        i = bisect_right(ends, s)
        if i == len(ends) or e <= starts[i]:
            out.append((s, k, e))
            starts.insert(i, s)
            ends.insert(i, e)
    return sorted(out)


def shape_vote(kind: int, value: str, digits: str) -> int:
    if kind == EMAIL:
        return 1 if re.search(r"(?i)(?:\.|dot[\])}]?)\x20?[a-z]{2,24}$", value) and ".." not in value and value[0] != "." else -1
    if kind == IP:
        if ":" in value:
            try:
                return 1 if ipaddress.IPv6Address(value) else -1
            except ValueError:
                return -1
        parts = value.split(".")
        return -1 if all(len(p) == 1 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in parts) else 1
    if kind == CARD:
        return 1 if len(digits) in (15, 16) and digits[0] in "23456" else -1
    if kind == PHONE:
        if value[0] == "+":
            return 1 if len(digits) <= 13 else 0
        groups = [len(g) for g in re.findall(r"[0-9]+", value)]
        return 1 if groups in ([3, 3, 4], [3, 7], [5, 5], [4, 7]) or digits[0] == "0" and 10 <= len(digits) <= 12 else -1
    if kind == IDENT:
        return 1 if "-" not in value or digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" else -1
    words = value.split(" ")
    return -int(len(set(words)) < len(words))


def checksum_vote(kind: int, value: str, digits: str) -> int:
    if kind == CARD:
        return 1 if luhn(digits) else -1
    if kind == IDENT and "-" not in value:
        code = value.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else -1
    return 0


def gazetteer_vote(kind: int, value: str, digits: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[^a-z]+", value.lower())[-1] in ENDINGS else -1
    if kind == IP:
        return -1 if re.match(r"(?:0|10|127|192\.168|255)\.", value) else 0
    if kind == CARD:
        return 1 if ISSUERS.match(digits) else -1
    if kind == PHONE:
        return (1 if digits.startswith(CALLING) else -1) if value[0] == "+" else 0
    if kind == NAME:
        words = value.split(" ")
        return -1 if NO_NAMES.intersection(words) else int(words[0] in GIVEN)
    return 0


def votes_of(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, ...]:
    value = text[start:end]
    digits = only_digits(value)
    before, after = text[start - 1 : start], text[end : end + 1]
    glued = sum(bool(c) and (c.isalnum() or c in "_=@/") for c in (before, after))
    left = text[max(0, start - BEFORE) : start]
    cue = bool(CUES[kind].search(left)) or kind == NAME and bool(TITLES.search(left))
    return (int(strict), shape_vote(kind, value, digits), checksum_vote(kind, value, digits), gazetteer_vote(kind, value, digits), int(cue), -int(bool(AGAINST.search(left[-CLOSE:]))), (1, 0, -1)[glued])


def hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def features_of(text: str, start: int, kind: int, end: int, votes: tuple[int, ...]) -> list[int]:
    """Hashed: the votes by kind, the shape, and the words around."""
    value = text[start:end]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: f"9{len(m[0])}", value))[:40]
    words = [f"<{w}" for w in re.findall(r"\w+", text[max(0, start - BEFORE) : start].lower())[-2:]] + [f">{w}" for w in re.findall(r"\w+", text[end : end + AFTER].lower())[:1]]
    return sorted({*vote_features(kind, votes), hashed(f"{kind} shape {shape}"), *(hashed(f"{kind} {w}") for w in words)})


def vote_features(kind: int, votes) -> list[int]:
    return [hashed(f"{kind}"), *(hashed(f"{kind} {name} {v}") for name, v in zip(LABELERS, votes, strict=True) if v)]


class LabelModel:
    """Expectation-maximisation over counted combinations of votes: for each kind the share of true spans, and what each labeler says about true and about false ones."""

    def __init__(self, counts: dict[tuple[int, tuple[int, ...]], int]):
        # by labeler, [false, true], [for, nothing, against]
        first = np.array([[PRIOR[::-1], CHECKSUM_PRIOR if x == "checksum" else PRIOR] for x in LABELERS])
        self.share = np.full(len(KINDS), 0.5)
        self.says = np.tile(first, (len(KINDS), 1, 1, 1))
        for kind in range(len(KINDS)):
            own = sorted((v, n) for (k, v), n in counts.items() if k == kind)
            if not own:
                continue
            said, n = 1 - np.array([v for v, _ in own]), np.array([n for _, n in own], float)  # 0: for, 1: nothing, 2: against
            for _ in range(ROUNDS):
                true = self.true(kind, said)
                self.share[kind] = (n @ true + WEIGHT / 2) / (n.sum() + WEIGHT)
                for y, p in enumerate((1 - true, true)):
                    for l in range(len(LABELERS)):  # noqa: E741
                        self.says[kind, l, y] = (np.bincount(said[:, l], n * p, 3) + WEIGHT * first[l, y]) / (n @ p + WEIGHT)

    def true(self, kind: int, said: np.ndarray) -> np.ndarray:
        logs = [np.log(self.says[kind, np.arange(len(LABELERS)), y][np.arange(len(LABELERS)), said]).sum(axis=1) for y in (0, 1)]
        odds = logs[1] - logs[0] + np.log(self.share[kind] / (1 - self.share[kind]))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def probability(self, kind: int, votes) -> float:
        return float(self.true(kind, 1 - np.array([votes]))[0])


class SpanClassifier:
    """Logistic regression on hashed features, fitted to probabilities."""

    def __init__(self, rows: list[list[int]], target: list[float], weight: list[float]):
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        cols, y, w = np.array([c for r in rows for c in r], np.int64), np.array(target), np.array(weight) / max(sum(weight), 1e-9)
        p = np.zeros(FEATURES)
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, STEPS + 1):
            x = np.bincount(at, p[cols], minlength=len(rows))
            error = w * (1 / (1 + np.exp(-np.clip(x, -40, 40))) - y)
            grad = np.bincount(cols, error[at], minlength=FEATURES) + L2 * p / 10
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        self.weights = p

    def __call__(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features].sum(), -40, 40))))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``kind, votes, features, h``: a row for each candidate of all whole texts; votes as text of + 0 -."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple = ([], [], [], [])
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                for spans, strict in ((base, True), (wide_spans(text, base), False)):
                    for s, k, e in spans:
                        votes = votes_of(text, s, k, e, strict)
                        features = features_of(text, s, k, e, votes)
                        key = text[max(0, s - BEFORE) : e + AFTER].encode("utf-8", "surrogatepass")
                        for c, x in zip(out, (k, "".join("0+-"[v] for v in votes), features, int.from_bytes(hashlib.blake2b(key, digest_size=7).digest())), strict=True):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64()), strict=True)], ["kind", "votes", "features", "h"])

    return map_texts(docs.select(F.col(text_col).cast("string").alias("text")), run, "kind int, votes string, features array<int>, h long")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, SpanClassifier]:
    """Labelers' reliabilities from all documents, and the classifier they train."""
    votes = lambda text: tuple({"+": 1, "0": 0, "-": -1}[c] for c in text)
    found = saved(candidates(docs, id_col, text_col), "candidates")
    model = LabelModel({(r["kind"], votes(r["votes"])): r["n"] for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()})
    # the sample: of what differs, since copies teach nothing more; a bound on the hash keeps all but about twice as many rows where they are
    different = saved(found.groupBy("h", "kind", "votes").agg(F.min("features").alias("features")), "different")
    bound = min(1.0, 2 * sample / max(1, different.count()))
    chosen = different.where(F.col("h") <= F.lit(int(bound * HASHES))).orderBy("h", "kind", "votes").limit(sample).select("kind", "votes", "features").collect()
    discard(found, different)
    known: dict = {}
    for r in chosen:
        known.setdefault((r["kind"], r["votes"]), model.probability(r["kind"], votes(r["votes"])))
    rows, target, weight = [list(r["features"]) for r in chosen], [known[r["kind"], r["votes"]] for r in chosen], [1.0] * len(chosen)
    # all combinations of votes, so that what the labelers say holds also where the sample has no span like it
    every = list(product((1, 0, -1), repeat=len(LABELERS)))
    for kind in range(len(KINDS)):
        rows += [vote_features(kind, v) for v in every]
        target += model.true(kind, 1 - np.array(every)).tolist()
        weight += [max(2000, len(chosen)) / len(every) / len(KINDS)] * len(every)
    return model, SpanClassifier(rows, target, weight)


def added_spans(text: str, base: list[tuple[int, int, int]], classifier: SpanClassifier) -> list[tuple[int, int, int]]:
    judged = [(span, votes_of(text, *span, False)) for span in wide_spans(text, base)]
    return [span for span, votes in judged if votes[CHECKSUM] >= 0 and classifier(features_of(text, *span, votes)) >= MIN_P]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, classifier: SpanClassifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and hash of the spans of the fixed patterns, and all spans."""
    classifier = classifier or fit(docs, id_col, text_col)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                added = added_spans(text, base, classifier)
                kinds = [k for _, k, _ in base]
                out.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, classifier: SpanClassifier | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null texts stay null, all other columns stay as they are."""
    classifier = classifier or fit(docs, text_col=text_col)[1]
    at = docs.columns.index(text_col)

    def clean(text: str) -> str:
        base = base_spans(text)
        out, end = [], 0
        for s, k, e in sorted(base + added_spans(text, base, classifier)):
            if s >= end:
                out += [text[end:s], f"[{KINDS[k].upper()}]"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([None if t is None else clean(t) for t in (x.as_py() for x in cols[at])], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_texts(docs, run, docs.schema)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op12_pii": op12_pii}
#: Offsets of leftmost spans and the classifier have no SQL form; tests hold the patterns as stated and planted cases.
ORACLE_SQL: dict[str, str] = {}
