"""Operator 1, secret scans: patterns plus dictionary-primed zstandard novelty.

Three fixed patterns give the base spans. Beyond them, every long run of key-like characters that
follows a sensitive word, or goes on after one, is a candidate, and each is measured: how many bytes
does it add to a zstandard frame primed with a dictionary? One dictionary holds common identifiers and
the words that most documents of the table have, another one the identifiers and the text around the
candidate. Names that either explains cost little; random material of any alphabet costs a byte a
character. The frame begins with a few incompressible bytes, so that characters which are not matched
cost what they are, and long candidates are measured in pieces, so that their alphabet does not lower
the cost. Other occurrences of the candidate are taken out of its surroundings: a secret that a text
repeats is reported at each place.

Defined results: null text is an empty text without spans; each row of the input gives one row, so
repeated rows repeat; a null doc_id stays null; extra columns are ignored. All of a text is read, in
time that grows with its length and its candidates. Texts that tie in any respect are independent of
each other. There is one span for a run, which ends where the run does. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base spans, with the least lengths that count.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "novel")

#: A text without any of these has no assignment; lower() never loses an ASCII letter.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Sensitive context: a candidate must start within REACH characters after one of these.
SENSITIVE = re.compile(r"(?i:passw|passphrase|secret|token|api.?key|credential|private.?key|auth|bearer|signing)", re.A)
SENSITIVE_WORDS = ("passw", "passphrase", "secret", "token", "api", "credential", "private", "auth", "bearer", "signing")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_RUN, REACH, AROUND, LEAST_COST = 16, 48, 512, 0.88
#: How frames are made (matches of three bytes and more, the best sequence of them), the longest piece that is measured at once, and incompressible bytes before it.
FRAME = zstandard.ZstdCompressionParameters(compression_level=12, window_log=17, chain_log=15, hash_log=15, search_log=6, min_match=3, target_length=48, strategy=zstandard.STRATEGY_BTOPT, write_checksum=False, write_content_size=False, write_dict_id=False)
PIECE, FILLER = 48, random.Random(5).randbytes(24)
#: Letters of the words that documents add to the dictionary, and its bytes at most (a bound of the dictionary, not of what is scanned).
WORD, WORD_BYTES = r"[A-Za-z]{4,}", 24_000

#: Identifiers that prime the compressor: what code and settings usually have next to a secret.
IDENTIFIERS = (
    "access_key access_token account accountName address api_key apikey application authorization auth_token "
    "authenticate bearer basic bucket callback certificate client_id client_secret configuration connection "
    "connectionString container credential credentials database default development digest document domain "
    "encoding encryption endpoint environment expires expiration false fingerprint function global header "
    "hostname identifier import instance integer interface internal https://www.example.com/ json keyring "
    "language localhost location message method namespace object organization parameter password passphrase "
    "permission private_key production project properties protected provider public_key refresh_token region "
    "register repository request resource response return role scope secret_access_key secret_key security "
    "server service session session_token setting signature signing_key staging static storage string system "
    "template test timeout token transaction true undefined update username user_name validate value variable "
    "version webhook workspace 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ example"
)


def primed(dictionary: str) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=FRAME)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=FRAME)


def cost(compressor: zstandard.ZstdCompressor, candidate: str, lead: str = "") -> float:
    """Bytes that the candidate adds after its lead, for each of its characters; capitals may be explained by small letters."""
    n = -(-len(candidate) // PIECE)
    cuts = [len(candidate) * i // n for i in range(n + 1)]
    size = lambda x: len(compressor.compress(FILLER + x.encode()))
    added = 0
    for start, end in zip(cuts, cuts[1:]):
        piece, before = candidate[start:end], lead[-PIECE:] if start == 0 else ""
        added += min(size(b + p) - size(b) for b, p in {(before, piece), (before.lower(), piece.lower())})
    return added / len(candidate)


class Novelty:
    """Tells runs that neither the dictionary nor their surroundings explain."""

    def __init__(self, dictionary: str = "", least_cost: float = LEAST_COST) -> None:
        self.least_cost = least_cost
        self.fixed = primed(f"{dictionary} {IDENTIFIERS}")

    def is_novel(self, run: str, around: str, lead: str = "") -> bool:
        if cost(self.fixed, run, lead) < self.least_cost:
            return False
        return cost(primed(f"{IDENTIFIERS} {around.replace(run, ' ')}"), run, lead) >= self.least_cost


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of every base span, unordered."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start of the run, start, end): runs of key-like characters that begin soon after a sensitive word, or what follows the last one inside a run."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    ends = [m.end() for m in SENSITIVE.finditer(text)]
    out = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        k = bisect.bisect_right(ends, end - LEAST_RUN) - 1  # the last sensitive word that leaves enough of the run
        if k >= 0 and ends[k] > start:
            out.append((start, ends[k], end))
        elif k >= 0 and ends[k] >= start - REACH:
            out.append((start, start, end))
    return out


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Candidates that overlap no base span and that compression cannot explain."""
    out, taken = [], sorted((s, e) for s, _, e in taken)
    reach = [0, *(e for _, e in taken)]
    for k in range(1, len(reach)):
        reach[k] = max(reach[k], reach[k - 1])
    for run, start, end in candidates(text):
        if reach[bisect.bisect_left(taken, (end, 0))] > start:
            continue
        around = text[max(0, run - AROUND) : run] + " " + text[end : end + AROUND]
        if novelty.is_novel(text[start:end], around, text[run:start]):
            out.append((start, 3, end))
    return out


def scan_text(text: str | None, novelty: Novelty) -> dict:
    text = text or ""
    base = sorted(base_spans(text))
    every = sorted(base + novel_spans(text, base, novelty))
    said = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    count = [sum(k == i for _, k, _ in every) for i in range(4)]
    return {
        "n_assign": count[0], "n_access": count[1], "n_hex": count[2], "n_novel": count[3],
        "base_sha256": hashlib.sha256(said(base).encode()).hexdigest(), "spans": said(every),
    }


def common_words(df: DataFrame, text_col: str = "text", most_bytes: int = WORD_BYTES) -> str:
    """The words that most documents have, the most common one last, as text of so many bytes at most.

    Words are counted over all documents. Those as long as a candidate are left out, so that no secret
    explains itself.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD})"), 1))
    counts = df.select(F.explode(words).alias("word")).where(F.length("word") < LEAST_RUN).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    most = counts.orderBy(F.desc("n"), "word").limit(most_bytes // 5).select("word").collect()  # the bound of the dictionary
    out, size = [], 0
    for r in most:
        size += len(r["word"]) + 1
        if size > most_bytes:
            break
        out.append(r["word"])
    return " ".join(reversed(out))


SCAN_SCHEMA = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = LEAST_COST, dictionary: str | None = None) -> DataFrame:
    """One row for each row of df: the id, counts of spans by kind, a digest of the base spans, all spans.

    Spans are kind:start:end in code points, the end exclusive, by start and then kind. The dictionary is
    that of df's common words unless one is given.
    """
    dictionary = common_words(df, text_col) if dictionary is None else dictionary
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary, least_cost)
        for batch in batches:
            rows = [scan_text(t.as_py(), novelty) for t in batch.column(1)]
            names = [x.split()[0] for x in SCAN_SCHEMA.split(", ")]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[n] for r in rows], t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, f"`{id_col}` {kind}, {SCAN_SCHEMA}")


def redact(text: str, spans: str, mask: str = "[redacted]") -> str:
    """text with every listed span replaced."""
    cuts = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for start, end in cuts:
        if end > at:
            out += [text[at : max(at, start)], mask]
            at = end
    return "".join(out) + text[at:]
