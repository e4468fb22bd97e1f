"""Exact token ids from the tokenizers library, each distinct chunk encoded once.

A text is cut before spaces that a non-space follows.  No token of the supported pre-tokenizers
spans such a place, nor one where a word ends at a mark (:func:`marks` takes that from the tokenizer file;
of other kinds of files whole texts go to the library), so the ids of a text are those of its chunks end to end.  Chunks
recur often and are kept per Python worker, by 128 bits of their bytes.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tallymill.llm import batches, words
from tallymill.llm.batches import gather, sums

#: Distinct chunks that a worker remembers before it starts afresh.
KEEP = 1_000_000
#: Chunks that are encoded as one text.
GROUP = 256

#: Stands between the chunks of a group; a control character that the pre-tokenizers keep apart.
MARK = "\x01"

#: Bytes before which a text is not cut: control characters and white space, and first bytes of wider white space.
_STAYS = np.zeros(256, bool)
_STAYS[:33] = True
_STAYS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII letters and digits.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

# Fixed value: the pattern of the published tokenizer that keeps words and drops white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(None)
def library(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def marks(spec: dict) -> np.ndarray | None:
    """Bytes before which a text may be cut where an ASCII letter or digit stands in front, by its tokenizer file; None for unknown kinds of files.

    Either known pre-tokenizer ends a token where letters or digits end, other than at an apostrophe, and none of
    its tokens spans a space that a non-space follows.  Characters of added tokens are no places to cut.
    """
    own = spec["pre_tokenizer"] or {}
    steps = own.get("pretokenizers", [own])
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
    kept = steps == [byte_level | {"use_regex": True}]
    drops = len(steps) == 2 and steps[0] == {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True} and steps[1] == byte_level | {"use_regex": False}
    normalizer = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    plain = all(x["type"] in ("NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for x in normalizer.get("normalizers", [normalizer]))
    whole = all(" " not in x["content"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])
    if not ((kept or drops) and plain and whole):
        return None
    out = np.zeros(256, bool)
    out[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" if not any(c in x["content"] for x in spec["added_tokens"])]] = True
    return out


def cut(data: np.ndarray, offs: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of all texts begin, their bytes, and how many each text has; a chunk keeps the space in front."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    begin = data == 32
    begin[:-1] &= ~_STAYS[data[1:]]
    begin[1:] |= before[data[1:]] & _PLAIN[data[:-1]]
    full = offs[1:] > offs[:-1]
    last = offs[1:][full] - 1
    begin[last] &= data[last] != 32
    begin[offs[:-1][full]] = True
    starts = np.flatnonzero(begin)
    return starts, np.diff(starts, append=len(data)), np.diff(np.searchsorted(starts, offs))


class Numbers:
    """Numbers of 128-bit keys in the order of their arrival: a hash table with open addressing."""

    def __init__(self):
        self.a, self.b, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.full(1 << 16, -1, np.int32)

    def __len__(self) -> int:
        return len(self.a)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        mask = len(self.slots) - 1
        at = (a & np.uint64(mask)).astype(np.int64)
        out = self.slots[at]
        if not len(self):
            return out
        todo = np.flatnonzero((out >= 0) & ((self.a[out] != a) | (self.b[out] != b)))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            got = out[todo] = self.slots[at[todo]]
            todo = todo[(got >= 0) & ((self.a[got] != a[todo]) | (self.b[got] != b[todo]))]
        return out

    def put(self, a: np.ndarray, b: np.ndarray) -> None:
        """Give numbers to distinct keys that have none."""
        new = np.arange(len(self), len(self) + len(a))
        self.a, self.b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        if 3 * len(self.a) > len(self.slots):
            self.slots = np.full(1 << (3 * len(self.a)).bit_length(), -1, np.int32)
            new = np.arange(len(self.a))
        mask = len(self.slots) - 1
        at = (self.a[new] & np.uint64(mask)).astype(np.int64)
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            lost = self.slots[at] != new
            new, at = new[lost], (at[lost] + 1) & mask


class Encoder:
    """Encodes texts with the tokenizer file at ``path`` as its library does."""

    def __init__(self, path: str, keep: int = KEEP):
        self.lib, self.keep = library(path), keep
        with open(path, encoding="utf-8") as f:
            self.marks = marks(json.load(f))
        self.mark = self.lib.encode(f" {MARK}", add_special_tokens=False).ids
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character a byte
        for token, k in vocab.items():
            self.bytes[k] = len(token.removesuffix("</w>"))
        self.drops = self.lib.encode(" ", add_special_tokens=False).ids == []  # white space has no token
        self._clear()

    def _clear(self) -> None:
        self.known = Numbers()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each; ``data``: their UTF-8 bytes, from ``offs`` on."""
        if self.marks is None:
            raw = data.tobytes()
            got = self.lib.encode_batch_fast([raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], add_special_tokens=False)
            lens = np.array([len(e.ids) for e in got], np.int64)
            return np.fromiter(chain.from_iterable([e.ids for e in got]), np.uint32, int(lens.sum())), lens
        if len(self.known) > self.keep:
            self._clear()
        starts, size, counts = cut(data, offs, self.marks)
        a, b = words.names(data, starts, size)
        at = self.known.find(a, b)
        new = np.flatnonzero(at < 0)
        if len(new):
            order = new[np.lexsort((b[new], a[new]))]
            head = np.ones(len(order), bool)
            head[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            one = order[head]
            self._learn([data[s : s + n].tobytes().decode() for s, n in zip(starts[one].tolist(), size[one].tolist())])
            self.known.put(a[one], b[one])
            at[order] = len(self.known) - len(one) - 1 + np.cumsum(head)
        lens = self.len[at]
        return self.ids[gather(self.start[at], lens)], sums(lens, counts)

    def _learn(self, chunks: list[str]) -> None:
        ids, lens = self.encode_chunks(chunks)
        self.start = np.concatenate([self.start, self.used + np.cumsum(lens) - lens])
        self.len = np.concatenate([self.len, lens])
        self._put(ids)

    def _put(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, len(ids)) + len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, and the number of ids of each.

        Chunks with a space in front are encoded in groups, as one text with a mark between
        them; the others, and any that hold the mark, one by one.
        """
        odd = [k for k, x in enumerate(chunks) if x[:1] != " " or len(x) < 2 or x[1].isspace() or MARK in x]
        held = set(odd)
        rest = [x for k, x in enumerate(chunks) if k not in held] if odd else chunks
        ids, lens = self._grouped(rest)
        if not odd:
            return ids, lens
        alone = [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast([chunks[k] for k in odd], add_special_tokens=False)]
        all_lens, at = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        is_odd = np.zeros(len(chunks), bool)
        is_odd[odd] = True
        all_lens[is_odd], all_lens[~is_odd] = [len(x) for x in alone], lens
        tail = np.concatenate(alone)
        at[is_odd] = len(ids) + np.cumsum(all_lens[is_odd]) - all_lens[is_odd]
        at[~is_odd] = np.cumsum(lens) - lens
        return np.concatenate([ids, tail])[gather(at, all_lens)], all_lens

    def _grouped(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_chunks, for chunks with a space in front.

        The bytes of the tokens tell the chunks apart; where they don't add up (a normaliser may
        change lengths), a mark between the chunks does.
        """
        if self.drops and not all(map(str.isascii, chunks)):
            plain = np.array([x.isascii() for x in chunks])
            ids, n = self._grouped([x for x in chunks if x.isascii()])
            more, m = self._marked([x for x in chunks if not x.isascii()])
            lens, begin = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
            lens[plain], lens[~plain] = n, m
            begin[plain], begin[~plain] = np.cumsum(n) - n, len(ids) + np.cumsum(m) - m
            return np.concatenate([ids, more])[gather(begin, lens)], lens
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = self._flat(["".join(chunks[i : i + GROUP]) for i in range(0, len(chunks), GROUP)])
        if self.drops:
            size = [sum(map(len, x.split())) for x in chunks]
        else:
            size = [len(x) if x.isascii() else len(x.encode()) for x in chunks]
        ends, wanted = np.cumsum(self.bytes[ids]), np.cumsum(size)
        at = np.searchsorted(ends, wanted)
        if at[-1] + 1 == len(ids) and (ends[at] == wanted).all():
            return ids, np.diff(at + 1, prepend=0)
        return self._marked(chunks)

    def _marked(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._flat([f" {MARK}".join(chunks[i : i + GROUP]) + f" {MARK}" for i in range(0, len(chunks), GROUP)])
        ends = np.flatnonzero(ids == self.mark[-1]) + 1
        lens = np.diff(ends, prepend=0) - len(self.mark)
        if len(ends) != len(chunks):
            raise AssertionError("the tokenizer joined a chunk with the mark after it")
        return ids[gather(ends - len(self.mark) - lens, lens)], lens

    def _flat(self, texts: list[str]) -> np.ndarray:
        got = self.lib.encode_batch_fast(texts, add_special_tokens=False)
        return np.fromiter(chain.from_iterable([e.ids for e in got]), np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        return self.spans(*batches.spans(pa.array(texts, pa.string())))


@lru_cache(None)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end``."""
    out = np.insert(ids, np.cumsum(counts), end) if len(counts) else ids
    return out.astype(np.uint32, copy=False), counts + 1
