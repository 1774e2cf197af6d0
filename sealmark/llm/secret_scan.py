"""Secrets in texts: three fixed patterns, and strings that a primed compressor finds novel.

The added kind: a candidate is a run of 16 or more of ``[A-Za-z0-9+/_=.-]`` with a digit and a
letter, up to 80 characters after something that names a secret (on its line or one before), and outside
the fixed patterns' spans. A zstandard compressor primed with a dictionary of identifiers (common ones, and those
that most documents of the corpus write, see identifiers()) compresses the text around the candidate, and that text
with the candidate. The bytes that the candidate adds, per byte of its own, are its novelty. The
candidate's own repeats are taken out of that text, since a key is defined and then used; only what
already stood in it twice counts as known. Identifiers, paths and strings made of the surroundings cost
little; random strings can't be compressed and are reported, and so is every other place of the text that has
them. The body of a private key block is reported whole.

Null and empty texts have no secrets. Very long texts are scanned whole; one text at a time is held.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Cheap test: without one of these words in either case a text can't have an assignment.
NAMES = re.compile(r"(?ai:passw|secret|token|api_?key)")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
SENSITIVE = re.compile(r"(?ai:pass(?:word|wd|phrase)?|pwd|secret|token|api|key|credential|auth|bearer|private|access|login|session|signature)")

BLOCK = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\s|\\[rn])*+(?:[A-Z][A-Za-z-]*+: [^\n\\]*+(?:\n|\\[rn])(?:\s|\\[rn])*+)*+"
    r"([A-Za-z0-9+/=]{16,}+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\s|\\[rn])*[A-Za-z0-9+/=]+){0,2}(?=(?:\s|\\[rn])*-----END)|[A-Za-z0-9+/=]{16,}+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{16,}+)*+)"
)

#: What code and configuration are full of; primes the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_secret client_id "
    "authorization bearer basic username user email login session cookie signature credential certificate "
    "localhost example.com http:// https:// www index.html config.yaml settings.json environment variable "
    "function return import class static const string integer boolean default value name type version "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2020-01-01 00:00:00 1.0.0"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = []
    if NAMES.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: Names of several words, as code writes them; without digits, so that no secret is one.
NAME = "[A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+(?:[A-Z][a-z]+)+"


def identifiers(df: DataFrame, text: str = "text", most: int = 1000) -> bytes:
    """The names that stand in most documents (two or more), the most frequent last, where a dictionary is nearest; ties by name.

    `most` names of 40 characters or fewer come to the driver. A JVM pass over all texts, counts before the shuffle.
    """
    names = df.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)))).alias("name")).filter(F.length("name").between(5, 40))
    top = names.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "name").limit(most).collect()
    return " ".join(r["name"] for r in reversed(top)).encode()


@functools.lru_cache(4)
def primed(names: bytes = b"") -> zstandard.ZstdCompressor:
    """A compressor primed with names of the corpus and the common ones."""
    primer = zstandard.ZstdCompressionDict(names + b" " + IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, context: str, names: bytes = b"") -> float:
    """Compressed bytes that the candidate adds to its context, per byte of its own; identifiers prime both."""
    press = primed(names)
    around, raw = context.encode("utf-8", "replace") + b"\n", candidate.encode("utf-8", "replace")
    return (len(press.compress(around + raw)) - len(press.compress(around))) / max(1, len(raw))


def mixed(word: str) -> bool:
    """Whether a run may be a candidate: 16 characters with a digit and a letter."""
    return len(word) >= 16 and any("0" <= c <= "9" for c in word) and re.search("[A-Za-z]", word) is not None


def parts(word: str) -> list[str]:
    """A run and the values in it, as of name=value."""
    return [word, *(x for x in word.split("=") if x != word and mixed(x))]


def without(words: list[str], before: str, after: str) -> str:
    """The text around a candidate without its repeats; what stands before it twice is left."""
    for w in words:
        if before.count(w) < 2:
            before = before.replace(w, "")
        after = after.replace(w, "")
    return before + after


def novel_spans(text: str, base: list[tuple[int, int, int]], least: float = 0.5, window: int = 400, near: int = 80, names: bytes = b"") -> list[tuple[int, int, int]]:
    """(start, 3, end) of private key blocks, and of the incompressible candidates in a sensitive context and their repeats."""
    blocks = [(m.start(1), 3, m.end(1)) for m in BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    taken: list[list[int]] = []  # base spans and blocks, merged
    for s, _, e in sorted(base + blocks):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    k, runs = 0, []  # the candidates that nothing has taken
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if mixed(m.group()) and not (k < len(taken) and taken[k][0] < end):
            runs.append((start, end, m.group()))
    found: set[tuple[int, int]] = set()
    known: set[str] = set()  # strings reported once, to be reported wherever they stand
    for start, end, word in runs:
        if not SENSITIVE.search(text, max(0, start - near), start):
            continue
        words = parts(word)
        context = without(words, text[max(0, start - window) : start], text[end : end + window])
        if novelty(word, context, names) >= least:
            found.add((start, end))
            known.update(x for x in words if x == word or novelty(x, context, names) >= least)
    if known:
        found.update((start, end) for start, end, word in runs if not known.isdisjoint(parts(word)))
    return sorted(blocks + [(start, 3, end) for start, end in found])


def scan_text(text: str | None, least: float = 0.5, names: bytes = b"") -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed patterns' spans, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, least, names=names))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"


def clean(df: DataFrame, text: str = "text", least: float = 0.5, mark: str = "[SECRET]", names: bytes = b"") -> DataFrame:
    """df with every secret in a text column replaced by a mark; nulls stay. No shuffle; other columns, of any name, pass as they are."""
    at = df.columns.index(text)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for scalar in b.column(at):
                t = scalar.as_py()
                spans = scan_text(t, least, names)[1]
                out.append(redacted(t, spans, mark) if spans else t)
            yield pa.RecordBatch.from_arrays([pa.array(out, b.column(at).type) if k == at else b.column(k) for k in range(b.num_columns)], schema=b.schema)

    return df.mapInArrow(run, df.schema)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5, names: bytes = b"") -> DataFrame:
    """keep's columns and, for each row, counts by kind, a digest of the fixed patterns' spans, and all spans.

    No shuffle; rows come out as they went in.
    """
    frame = df.select(*keep, text)
    fields = {f.name: f for f in frame.schema.fields}
    kept = [fields[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), SCHEMA])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
            for scalar in b.column(len(keep)):
                t = scalar.as_py() or ""
                base, spans = scan_text(t, least, names)
                for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                    cols[c].append(sum(x[1] == k for x in base))
                cols["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                cols["spans"].append(written(spans))
                cols["n_novel"].append(len(spans) - len(base))
            types = {c: pa.int64() if c.startswith("n_") else pa.string() for c in cols}
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(cols[c], types[c]) for c in cols)], [*keep, *cols])

    return frame.mapInArrow(run, schema)
