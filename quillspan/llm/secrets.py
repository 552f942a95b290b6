"""Secret scans (operator 7): three patterns, and a token-efficiency test.

Patterns, leftmost and non-overlapping per kind: ``assign`` (a credential word, a
separator, a value of 6 or more characters), ``access`` (AKIA keys of 20 or more)
and ``hex`` (runs of 24 or more).  The method adds kind ``random``: runs of 16 or more characters
of a key's alphabet that a tiktoken vocabulary needs many tokens for (few characters
per token), whatever they are made of and whatever stands beside them.  Left out are
only: known digests (hexadecimal of a digest's length), UUIDs, numbers, mail
addresses, URLs (but not a password before their host), identifiers whose parts
between separators are each of one case or a number, parts of words that go on in
another script, and what a pattern has found already.

Spans count code points, end exclusive, and cover the whole match.  A null or
empty text has no spans.  Texts of any length are scanned whole.  Repeated rows
are scanned row by row; other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernels as K

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
MIN_RUN = 16
#: Words of four languages, repeated syllables too, have 2.0 or more; random strings of letters and digits 1.8 at most.
MAX_CHARS_PER_TOKEN = 1.95
#: Longer runs are encoded in stretches, so that no run costs more than its length.
STRETCH = 4096
MARK = "[secret]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_URL = re.compile(r"://\S+")
_WORDLIKE = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]+|[0-9]+)\Z")
_SEPARATORS = re.compile(r"[+/_=-]")
_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_hex_byte = np.zeros(256, dtype=bool)
_hex_byte[list(b"0123456789abcdef")] = True
_run_byte = np.zeros(256, dtype=bool)
_run_byte[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(run: str, vocabulary: str) -> float:
    encode = _encoding(vocabulary).encode_ordinary
    return len(run) / sum(len(encode(run[i : i + STRETCH])) for i in range(0, len(run), STRETCH))


def known(run: str, before: str, after: str, in_url: bool) -> bool:
    """A digest, an identifier or a part of a word: what the test leaves out."""
    if not any(c.isalpha() for c in run) or _UUID.match(run) or (len(run) in _DIGEST_SIZES and _DIGEST.match(run)):
        return True
    if (before.isalnum() or after.isalnum()) and not any(c.isdigit() for c in run):
        return True
    if (in_url or after == "@") and not (before == ":" and after == "@"):  # user:password@host holds a secret
        return True
    parts = _SEPARATORS.split(run)
    return before == "@" or (len(parts) > 1 and all(map(_WORDLIKE.match, parts)))


def looks_random(run: str, before: str, after: str, in_url: bool, vocabulary: str, most: float = MAX_CHARS_PER_TOKEN) -> bool:
    """The token-efficiency test, then the exclusions."""
    return chars_per_token(run, vocabulary) < most and not known(run, before, after, in_url)


def find_spans(text: str, vocabulary: str, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind as listed in KINDS."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    found, at, reach = sorted((a, b) for _, a, b in out), 0, 0
    urls, url_end = iter([*(m.span() for m in _URL.finditer(text)), (len(text) + 1, 0)]), 0
    url = next(urls)
    for m in _RUN.finditer(text):
        s, e = m.span()
        while at < len(found) and found[at][0] < e:  # runs and found spans both go from left to right
            reach, at = max(reach, found[at][1]), at + 1
        while url[0] < e:
            url_end, url = url[1], next(urls)
        if reach > s:
            continue
        if looks_random(m[0], text[s - 1 : s] if s else "", text[e : e + 1], s < url_end, vocabulary, most):
            out.append(("random", s, e))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _long_run(flags: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """The texts that have a run of at least n flagged bytes; a run ends with its text."""
    cut = np.zeros(len(flags) + 1, dtype=bool)
    cut[bounds] = True
    edged = np.concatenate([[False], flags, [False]])
    starts = np.flatnonzero(flags & (~edged[:-2] | cut[:-1]))
    ends = np.flatnonzero(flags & (~edged[2:] | cut[1:])) + 1
    at = starts[ends - starts >= n]
    return np.unique(np.searchsorted(bounds, at, side="right") - 1)


def suspects(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts in which any span is possible: the regular expressions run on these alone.

    The test is by bytes and may let a text through, but never holds one back.
    """
    some = [_long_run(_hex_byte[data], bounds, 24)]
    run = _run_byte[data]
    some.append(_long_run(run, bounds, MIN_RUN))
    whole = K._LOWER[data].tobytes()
    for hint in (*_HINTS, b"akia"):
        at, hits = whole.find(hint), []
        while at >= 0:
            i = int(np.searchsorted(bounds, at, side="right")) - 1
            hits.append(i)
            at = whole.find(hint, int(bounds[i + 1]) - len(hint) + 1) if bounds[i + 1] - len(hint) + 1 > at else whole.find(hint, at + 1)
        some.append(np.array(hits, dtype=np.int64))
    return np.unique(np.concatenate(some).astype(np.int64))


def _spans_of(part: pa.RecordBatch, column: str, vocabulary: str, most: float) -> list[list[tuple[str, int, int]]]:
    data, bounds = K.raw(part.column(column))
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(part.num_rows)]
    for i in suspects(data, bounds):
        out[i] = find_spans(data[bounds[i] : bounds[i + 1]].tobytes().decode(), vocabulary, most)
    return out


def _as_arrow(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], type=_SPANS_ARROW)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end)."""
    path = vocabulary or vocabulary_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _as_arrow(_spans_of(part, "text", path, most))], names=["doc_id", "spans"])

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(K.tidy(scan), f"doc_id long, spans {SPANS}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every stretch that spans cover replaced by a mark."""
    out, at, i = [], 0, 0
    while i < len(spans):
        s, e = spans[i][1:]
        while i + 1 < len(spans) and spans[i + 1][1] < e:
            i += 1
            e = max(e, spans[i][2])
        out += [text[at:s], MARK]
        at, i = e, i + 1
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", vocabulary: str | None = None, most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """The same rows and columns, secrets replaced by a mark; n_chars, if there is such a column, follows where the text changed."""
    path, schema, sized = vocabulary or vocabulary_path(), docs.schema, n_chars in docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, text):
                found = _spans_of(part, text, path, most)
                hit = [i for i, x in enumerate(found) if x]
                if hit:
                    column = part.column(text)
                    new = [redact(column[i].as_py(), found[i]) for i in hit]
                    mask = np.zeros(part.num_rows, dtype=bool)
                    mask[hit] = True
                    put = {text: pc.replace_with_mask(column, mask, pa.array(new, type=column.type))}
                    if sized:
                        size = part.column(n_chars)
                        put[n_chars] = pc.replace_with_mask(size, mask, pa.array([len(x) for x in new], type=size.type))
                    part = pa.RecordBatch.from_arrays([put.get(c, part.column(c)) for c in part.schema.names], schema=part.schema)
                yield part

    return docs.mapInArrow(K.tidy(scan), schema)


def _of(kinds: tuple[str, ...]) -> Column:
    return F.filter("spans", lambda x: x["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts per pattern, the digest of the pattern spans, and all spans as one string."""
    return found.select(
        "doc_id",
        *(F.size(_of((k,))).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(_of(BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
