"""Secret scans: three base patterns, and random strings by token efficiency.

A string of ordinary words takes few tokens for its length; a random one takes many. Runs of 20 or more characters with
fewer than LEAST_RATIO characters for each token of a public byte-level vocabulary are spans of the kind `random`. So
are such stretches of a run between its pieces of ordinary words, where / = _ and - part the pieces: a key at the end of a
path or behind its name. Known digests (hex of 32, 40, 56, 64, 96 or 128 digits, UUIDs), identifiers whose parts are
words of the vocabulary, letters of few kinds and what overlaps a base span are none.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import kept, map_batches, map_rows

#: The base patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "random")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_RATIO = 2.2
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\Z")
PARTS, PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|\+"), re.compile(r"[A-Za-z0-9+]+")
#: Length of a run; of a word that counts for an identifier; of a stretch's longest piece and its kinds of letters if it has no digits.
LEAST_RUN, LEAST_WORD, LEAST_PIECE, LEAST_KINDS = 20, 4, 8, 8
KEYWORDS = re.compile(r"[:=]")
RANDOM_CACHE = 50_000


class Scanner:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = {w.lower() for w in (t.decode("ascii", "replace").strip() for t in ranks) if w.isascii() and w.isalpha()}
        self.known: dict[str, tuple[tuple[int, int], ...]] = {}

    def ratio(self, run: str) -> float:
        # very long runs are cut for the tokenizer, whose merges take more than linear time; the ratio is of the whole
        return len(run) / sum(len(self.encode(run[i : i + 400])) for i in range(0, len(run), 400))

    def is_identifier(self, run: str) -> bool:
        """Words of the vocabulary, those of LEAST_WORD letters or more being half of the run, joined by separators, digits or case."""
        parts = PARTS.findall(run)
        if not all(len(p) <= 4 if p.isdigit() else p.lower() in self.words for p in parts):
            return False
        return 2 * sum(len(p) for p in parts if len(p) >= LEAST_WORD and p.isalpha()) >= len(run)

    def is_random(self, run: str) -> bool:
        letters = {c for c in run if c.isalpha()}
        if len(run) < LEAST_RUN or not letters or DIGEST.match(run) or self.is_identifier(run):
            return False
        if not any(c.isdigit() for c in run) and (len(letters) < LEAST_KINDS or max(map(len, PIECE.findall(run))) < LEAST_PIECE):
            return False
        return self.ratio(run) < LEAST_RATIO

    def random_parts(self, run: str) -> tuple[tuple[int, int], ...]:
        """(start, end) of the random stretches of a run, or of the whole run if it is random itself."""
        got = self.known.get(run)
        if got is None:
            got = ((0, len(run)),) if self.is_random(run) else tuple(self._stretches(run))
            if len(self.known) >= RANDOM_CACHE:
                self.known.clear()
            self.known[run] = got
        return got

    def _stretches(self, run: str):
        start = end = 0
        pieces = list(PIECE.finditer(run))
        for m in pieces if len(pieces) > 1 else ():
            if self.ratio(m[0]) < LEAST_RATIO and not DIGEST.match(m[0]) and not self.is_identifier(m[0]):
                start, end = start if end else m.start(), m.end()
                continue
            if end and self.is_random(run[start:end]):
                yield start, end
            end = 0
        if end and self.is_random(run[start:end]):
            yield start, end

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place in KINDS, end), ascending; ends are exclusive."""
        out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        if KEYWORDS.search(text):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
        base = sorted(out)
        at, reach = 0, -1
        for m in RUN.finditer(text):
            for a, b in self.random_parts(m[0]):
                a, b = m.start() + a, m.start() + b
                while at < len(base) and base[at][0] < b:
                    reach = max(reach, base[at][2])
                    at += 1
                if a >= reach:
                    out.append((a, 3, b))
        return sorted(out)


def scanner(ranks_path: str, pattern: str) -> Scanner:
    return kept(__name__, f"{ranks_path} {pattern}", lambda: Scanner(ranks_path, pattern))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row of docs (doc_id, text).

    A span is the whole match, in code points. Null and empty texts have none, and the digest of an empty string.
    Repeated rows each have their own row.
    """

    def make():
        find = scanner(ranks_path, pattern).spans

        def rows(batch):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                spans = find(text.as_py() or "")
                n = [sum(s[1] == k for s in spans) for k in range(4)]
                base = _joined([s for s in spans if s[1] < 3])
                yield doc_id, *n[:3], hashlib.sha256(base.encode()).hexdigest(), _joined(spans), n[3]

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long", make)


def redacted(docs: DataFrame, ranks_path: str, pattern: str, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by mask in text and n_chars brought up to date; no row goes.

    Null and empty texts stay as they are, long texts are scanned whole, and all other columns are carried along.
    """
    schema = docs.schema
    at = schema.names.index("text")

    def clean(find, text: str | None) -> str | None:
        if not text:
            return text
        parts, end = [], 0
        for a, _, b in find(text):
            if a >= end:
                parts += [text[end:a], mask]
            end = max(end, b)
        return "".join([*parts, text[end:]])

    def make():
        find = scanner(ranks_path, pattern).spans

        def change(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([clean(find, t.as_py()) for t in batch.column(at)], type=batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(batch.num_columns)], schema=batch.schema)

        return change

    out = map_batches(docs, make)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
