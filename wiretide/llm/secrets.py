"""Secret scans: fixed patterns, and strings in sensitive context that a primed compressor finds new."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from wiretide.llm.common import as_bytes

#: Kinds of spans in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A match of ASSIGN holds one of these in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Words near which a string may be a secret.
CONTEXT = re.compile(r"(?:auth|bearer|credential|passphrase|passw(?:or)?d|pwd|private|secret|session|signature|token|api.?key|access.?key)", re.ASCII | re.IGNORECASE)
CONTEXT_WORDS = ("auth", "bearer", "credential", "passphrase", "passw", "pwd", "private", "secret", "session", "signature", "token", "key")
#: Characters after a context word in which a candidate may start, text on either side that it is compressed with, and characters of a candidate at least.
REACH, AROUND, LEAST = 64, 256, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}", re.ASCII)
#: A candidate is new if it takes this share of what random strings of its own form take, of which so many are compressed.
NOVEL, RANDOM = 0.85, 5
#: What is compressed before the text around, so that marginal bytes don't hold what starting a block costs.
FRAME = "def connect(host, port):\n    # open the channel on which the other side listens, and say which key we hold\n    return client.start(host, port=port or 8443, timeout=30)\n"
#: What identifiers, settings and paths are made of.
IDENTIFIERS = (
    "import from class def return function const let var public static void string int self this new null true false None "
    "config settings environment variable default value name path file host port user admin root database server client "
    "request response session token secret password passwd api_key apikey access_key private_key public_key credential "
    "authorization bearer basic header signature hash digest encode decode base64 sha256 sha512 md5 certificate example placeholder "
    "changeme your_api_key_here xxxxxxxx test sample localhost http https www com org net index main src lib include version "
    "account address archive array backup batch block buffer build cache callback channel code column command connection content "
    "context controller cookie count create current data date delete device document domain download email enable engine entry error "
    "event expire export factory feature field filter first folder format frame group handler image info input instance internal "
    "items journal keyring language last length level limit list local location lock login logout manager mapping max member message "
    "method min mode model module network node number object offset option order output owner package page parameter parse partition "
    "payload permission policy primary process production profile project protocol provider proxy query queue rate record refresh "
    "region release remote report resource result retry role route rotation sandbox schema scope search section security select send service "
    "shared source staging start state status storage store stream system table target task template thread time timestamp "
    "title total transfer type update upload url validation valid vault view window worker write "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 2020-01-01 2023 2024-12-31T00:00:00Z 2025 2026 v1 v2 v3 .json .yaml .html .com/"
).encode()


@cache
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def _alphabet(candidate: str, few: str, many: str) -> str:
    used = set(candidate) & set(many)
    return "" if not used else few if used <= set(few) else many


def random_like(candidate: str, rng: random.Random) -> str:
    """A string of the candidate's length in which letters and digits are drawn anew from the kinds that it uses (letters up to f
    alone, up to z, of either case; digits from 2 to 7 with capitals, or all); other characters stay."""
    low, up = _alphabet(candidate, "abcdef", string.ascii_lowercase), _alphabet(candidate, "ABCDEF", string.ascii_uppercase)
    digits = _alphabet(candidate, "234567" if len(up) > 6 and not low else string.digits, string.digits)
    every = low + up + digits
    return "".join(rng.choice(every) if c.isalnum() else c for c in candidate)


def novelty(candidate: str, before: str, after: str) -> float:
    """The bytes that the candidate adds to the text around it, for a compressor primed with a dictionary of identifiers, as a
    share of those that random strings of its own alphabet and length add in its place."""
    size = lambda s: len(_compressor().compress(f"{FRAME}{before}{s}{after}".encode("utf-8", "replace")))
    nothing, rng = size(""), random.Random(len(candidate))
    usual = sum(size(random_like(candidate, rng)) - nothing for _ in range(RANDOM)) / RANDOM
    return (size(candidate) - nothing) / max(1.0, usual)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, in code points: the leftmost matches of each kind that don't overlap, less those that are too short."""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def mixed(candidate: str) -> bool:
    """Letters and digits."""
    return re.search("[0-9]", candidate) is not None and re.search("[A-Za-z]", candidate) is not None


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the strings that follow a context word within REACH characters, or that one begins: what is after the last
    such word in them. Strings and words are each found once and walked together."""
    words = CONTEXT.finditer(text)
    word, before = next(words, None), -REACH - 1
    for found in CANDIDATE.finditer(text):
        start = found.start()
        while word is not None and word.end() <= found.end():
            before = word.end()
            word = next(words, None)
        if before > start:
            start = before
            while start < found.end() and not text[start].isalnum():
                start += 1
        if start <= before + REACH and found.end() - start >= LEAST:
            yield start, found.end()


def novel_spans(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Candidates that hold letters and digits, touch no span taken, and don't compress against what surrounds them."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out, spans, at, until = [], sorted((a, b) for a, _, b in taken), 0, 0
    for start, end in candidates(text):
        while at < len(spans) and spans[at][0] < end:
            until = max(until, spans[at][1])
            at += 1
        if until <= start and mixed(text[start:end]) and novelty(text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]) >= NOVEL:
            out.append((start, "novel", end))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row, by start and then kind; positions are code points of the
    whole text, the end exclusive. Kinds: assign, access, hex by fixed patterns; novel by compression.

    A null or empty text has no spans; the time for a text grows in proportion to its length. Repeated rows and null ids come out as they go in; other columns are not read. The work
    on a text depends on that text alone, so there is no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                text = x.as_py().decode("utf-8", "replace")
                spans = base_spans(text)
                spans += novel_spans(text, spans)
                spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
                out.append([{"kind": k, "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind string, start int, end int>>")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    from wiretide.llm.common import table

    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(said(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        count("novel").alias("n_novel"),
    )
