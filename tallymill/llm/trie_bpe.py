"""Byte-level BPE by traversal of a trie of the distinct words.

The encoding of a prefix ends in one token, and what precedes that token is the encoding of the
shorter prefix.  So a trie node needs only its last token: the vocabulary token that ends there
and that BPE leaves unmerged after the last token of the node where it begins.  Sorted words
visit their trie depth-first; states of the prefix shared with the word before stay on the path
and are computed once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallymill.llm import batches, tokens

#: Fixed values of the published byte-level BPE: its word pattern, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

#: Pairs of tokens that a worker remembers before it starts afresh.
FITS = 1 << 20

_words = regex.compile(PATTERN)
_plain = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*")


@lru_cache(None)
def alphabet() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Trie:
    """Last-token states for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = alphabet()
        as_bytes = lambda s: bytes(map(to_byte.__getitem__, s))
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.vocab = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.bytes_of = {i: s for s, i in self.vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.special = special
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.fits: dict[int, bool] = {}  # FITS pairs at most

    def merged(self, word: bytes) -> list[bytes]:
        """BPE by definition, for a pair of tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether BPE leaves ``token`` after ``before`` (-1: the word's start) unmerged."""
        key = (before + 1) << 32 | token
        if (found := self.fits.get(key)) is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            head = [self.bytes_of[before]] if before >= 0 else []
            want = [*head, self.bytes_of[token]]
            found = self.fits[key] = self.merged(b"".join(want)) == want
        return found

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of each of the distinct words."""
        vocab, fits, longest, out = self.vocab, self.fits, self.longest, {}
        size = {i: len(s) for i, s in self.bytes_of.items()}
        path: list[int] = []  # last token of the node at each depth
        before = b""
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del path[shared:]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    token = vocab.get(word[start:end])
                    if token is not None:
                        u = path[start - 1] if start else -1
                        ok = fits.get((u + 1) << 32 | token)
                        if self.follows(u, token) if ok is None else ok:
                            break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                path.append(token)
            ids, end = [], n
            while end:
                ids.append(path[end - 1])
                end -= size[ids[-1]]
            out[word] = ids[::-1]
            before = word
        return out


class Spelled:
    """The bytes that stand for each id."""

    def __init__(self, each: list[bytes]):
        self.bytes, self.size = np.frombuffer(b"".join(each), np.uint8), np.array([len(x) for x in each])
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and how many each has."""
        return self.bytes[batches.gather(self.start[ids], self.size[ids])], self.size[ids]


class TrieEncoder(tokens.Encoder):
    """Chunks are cut into words and encoded through the trie."""

    def __init__(self, path: str):
        super().__init__(path)
        self.trie = Trie(path)
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.trie.special, key=len, reverse=True)))) if self.trie.special else None
        n = max(self.trie.bytes_of) + 1
        self.raw, self.decimal = Spelled([self.trie.bytes_of.get(i, b"") for i in range(n)]), Spelled([b"%d," % i for i in range(n)])

    def words(self, text: str) -> list[bytes]:
        """Pre-tokens of a text, by the library where it holds rare characters (Unicode versions differ)."""
        if _plain.fullmatch(text):
            return [x.encode() for x in _words.findall(text)]
        back = alphabet()
        return [bytes(map(back.__getitem__, x)) for x, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[list] = []
        for chunk in chunks:
            if self.splits is None or not (cuts := list(self.splits.finditer(chunk))):
                parts.append(self.words(chunk))
                continue
            own, at = [], 0
            for m in cuts:
                own += self.words(chunk[at : m.start()])
                own.append(self.trie.special[m[0]])
                at = m.end()
            parts.append(own + self.words(chunk[at:]))
        ids = self.trie.encode({x for p in parts for x in p if not isinstance(x, int)})
        flat = [[i for x in p for i in ([x] if isinstance(x, int) else ids[x])] for p in parts]
        lens = np.array([len(x) for x in flat], np.int64)
        return np.fromiter((i for x in flat for i in x), np.uint32, int(lens.sum())), lens

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        return self.raw.of(ids)[0].tobytes().decode("utf-8", "replace")


@lru_cache(None)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids and decoded text: doc_id, ids (array of int), decoded, for every row of ``docs``.

    Null text is empty (no ids, empty decoded text); repeated rows give repeated results; an
    empty table gives no row; columns other than doc_id and text are ignored.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for doc_ids, ids, counts in _encoded(it, enc):
            ends = np.cumsum(counts)
            each = [ids[a:b] for a, b in zip(ends - counts, ends)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(each, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in each], pa.string())], ["doc_id", "ids", "decoded"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As :func:`encode`, with digests in place of ids and text, made where the ids are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for doc_ids, ids, counts in _encoded(it, enc):
            shas = []
            for spelled in (enc.decimal, enc.raw):
                data, size = spelled.of(ids)
                ends = np.cumsum(batches.sums(size, counts)).tolist()
                shas.append((memoryview(data.tobytes()), zip([0, *ends], ends)))
            (decimals, of_ids), (raw, of_texts) = shas
            id_shas = [sha(decimals[a : max(a, b - 1)]) for a, b in of_ids]  # without the last comma
            text_shas = [sha(bytes(raw[a:b]).decode("utf-8", "replace").encode()) for a, b in of_texts]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), pa.array(id_shas, pa.string()), pa.array(text_shas, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")


def _encoded(it, enc):
    for batch in it:
        for run in batches.runs(batch):
            ids, counts = enc.spans(*batches.spans(run.column("text")))
            yield run.column("doc_id"), ids, counts
