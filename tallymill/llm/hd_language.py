"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram binds its letters' vectors, permuted by
their places, with an elementwise product; a document bundles the vectors of its trigrams by
summing them; a language's prototype bundles its documents.  A document is of the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import batches

SIZE = 2048
#: Trigrams of a run that the most of its texts hold, whose vectors are multiplied as one matrix.
DENSE = 1024
#: Bits of a code point in a trigram; letters whose vectors a worker remembers.
BITS, REMEMBERED = 21, 1 << 13
#: A document below this cosine with every prototype is of no learned language, whatever its length.
LEAST = 0.05
#: By length, so is one below SHARE of the cosine that all but LOW of the labelled documents reach; a
#: class of lengths decides from FEW labelled documents on.  CLASSES: of distinct trigrams, by powers of two.
SHARE, LOW, FEW, CLASSES = 0.6, 0.05, 10, 20

_letter = np.zeros(1 << 16, bool)
for _c in range(1 << 16):
    _letter[_c] = not 0xD800 <= _c < 0xE000 and chr(_c).isalpha()


@lru_cache(REMEMBERED)
def letter(code: int) -> np.ndarray:
    """The vector of a letter, drawn from its code point; code 0 is the gap between words."""
    return np.random.default_rng([20_011, code]).integers(0, 2, SIZE, np.int8) * np.int8(2) - np.int8(1)


def bound(grams: np.ndarray) -> np.ndarray:
    """The vectors of trigrams of three code points, BITS bits each."""
    low = (1 << BITS) - 1
    codes, at = np.unique(np.stack([grams >> 2 * BITS, grams >> BITS & low, grams & low]), return_inverse=True)
    vectors = np.stack([letter(c) for c in codes.tolist()]).astype(np.float32) if len(codes) else np.zeros((0, SIZE), np.float32)
    first, second, third = at.reshape(3, -1)
    return np.roll(vectors, 2, 1)[first] * np.roll(vectors, 1, 1)[second] * vectors[third]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, trigram and count of each distinct trigram of each text, and letters of each text."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    at = np.concatenate(points) if points else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    s = np.where(_letter[np.minimum(at, 0xFFFF)], at, 0).astype(np.int64)
    for k in np.flatnonzero(at > 0xFFFF):
        s[k] = int(at[k]) if chr(at[k]).isalpha() else 0
    letters = np.bincount(doc, s > 0, len(texts))
    keep = (s > 0) | np.concatenate([[True], s[:-1] > 0]) | np.concatenate([[True], np.diff(doc) > 0])  # one gap for a run of them
    s, doc = s[keep], doc[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), letters
    seen = np.zeros(1 << BITS, bool)
    seen[s] = seen[0] = True
    codes = np.flatnonzero(seen)
    n, number = len(codes), np.zeros(1 << BITS, np.int64)
    number[codes] = np.arange(n)
    s = number[s]
    tri = (s[:-2] * n + s[1:-1]) * n + s[2:]
    own = (doc[:-2] == doc[2:]) & (tri > 0)
    doc, tri = doc[:-2][own], tri[own]
    names, base = None, n**3
    if len(texts) * base >= 1 << 62:  # very many kinds of letters at once
        names, tri = np.unique(tri, return_inverse=True)
        base = len(names)
    keys, counts = np.unique(doc * base + tri, return_counts=True)
    doc, tri = keys // base, keys % base
    tri = tri if names is None else names[tri]
    return doc, codes[tri // (n * n)] << 2 * BITS | codes[tri // n % n] << BITS | codes[tri % n], counts.astype(np.float32), letters


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vector of each text, its number of letters, and of distinct trigrams."""
    doc, tri, counts, letters = trigrams(texts)
    out, kinds = np.zeros((len(texts), SIZE), np.float32), np.bincount(doc, minlength=len(texts))
    if len(doc):
        grams, at = np.unique(tri, return_inverse=True)
        vectors = bound(grams)
        often = np.argsort(-np.bincount(at), kind="stable")[:DENSE]
        place = np.full(len(grams), -1)
        place[often] = np.arange(len(often))
        dense = place[at] >= 0
        matrix = vectors[often]
        for lo in range(0, len(texts), 2048):
            own = dense & (doc >= lo) & (doc < lo + 2048)
            shares = np.zeros((min(2048, len(texts) - lo), len(often)), np.float32)
            shares[doc[own] - lo, place[at[own]]] = counts[own]
            out[lo : lo + 2048] = shares @ matrix
        doc, at, counts = doc[~dense], at[~dense], counts[~dense]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            lo, hi = bounds[k], bounds[k + 1]
            out[k] += counts[lo:hi] @ vectors[at[lo:hi]]
    return out, letters, kinds


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit vectors) from the rows of ``docs`` with text and lang.

    Each document weighs the same.  Partitions bundle on their own; one vector a language remains.
    """

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in it:
            for run in batches.runs(batch):
                doc, tri, counts, _ = trigrams(batches.texts(run.column("text")))
                share = counts / np.bincount(doc, counts)[doc] if len(doc) else counts
                langs, of = np.unique(np.array(run.column("lang").to_pylist(), str), return_inverse=True)
                for k, lang in enumerate(langs.tolist()):
                    own = of[doc] == k
                    grams, at = np.unique(tri[own], return_inverse=True)
                    total.setdefault(lang, np.zeros(SIZE))
                    total[lang] += np.bincount(at, share[own], len(grams)) @ bound(grams)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * SIZE), pa.array(range(SIZE)), pa.array(v)], ["lang", "place", "v"])

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    sums = known.mapInArrow(partial, "lang string, place long, v double").groupBy("lang", "place").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("v")).orderBy("lang").collect()  # SIZE numbers a language
    if not rows:
        return [], np.zeros((0, SIZE))
    vectors = np.array([[x["v"] for x in r.v] for r in rows])
    return [r.lang for r in rows], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _predict(texts: list[str], langs: list[str], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and class of length of each text."""
    vectors, letters, kinds = bundles(texts)
    of = np.minimum(np.log2(np.maximum(kinds, 1)).astype(int), CLASSES - 1)
    cos = vectors @ prototypes.T.astype(np.float32) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    names = np.array([*langs, "und"], object)
    if not langs:
        return np.full(len(texts), "und", object), np.zeros(len(texts)), of
    best = np.where(letters > 0, cos.argmax(1), len(langs))
    return names[best], np.where(letters > 0, np.clip(cos.max(1), 0, 1), 0.0).astype(float), of


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score (the cosine, 0 at least).

    Learns from the rows that :func:`held_out` leaves, unless a model is given.  Null text and
    texts without a letter are ``und`` with score 0, as is everything where no language was learned;
    ties go to the first language by name.  Repeated rows give repeated results; an empty table
    gives no row; other columns are ignored.
    """
    langs, prototypes = model or learn(docs.where(~held_out()))

    def run_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for run in batches.runs(batch):
                lang, s, _ = _predict(batches.texts(run.column("text")), langs, prototypes)
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), run.column("held_out"), pa.array(lang, pa.string()), pa.array(s)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run_, "doc_id long, held_out boolean, lang_pred string, score double")


def least(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> np.ndarray:
    """The cosine that a text of each class of lengths must reach, from the scores of all rows of ``docs`` with text and lang.

    It does not fall with length: a class of too few documents takes that of the shorter ones.
    """
    langs, prototypes = model

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * 101, np.int64)
        for batch in it:
            for run in batches.runs(batch):
                lang, s, of = _predict(batches.texts(run.column("text")), langs, prototypes)
                total += np.bincount((of * 101 + (s * 100).astype(int))[lang != "und"], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text")
    total = np.zeros(CLASSES * 101)
    for at, n in known.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # CLASSES * 101 rows at most
        total[at] = n
    sums = total.reshape(CLASSES, 101).cumsum(1)
    low = (sums > LOW * sums[:, -1:]).argmax(1) / 100
    return np.maximum.accumulate(np.where(sums[:, -1] >= FEW, np.maximum(LEAST, SHARE * low), LEAST))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a learned language (see LEAST and :func:`least`), with all their columns.

    Null text, texts without a letter, and all rows where no language was learned go; repeated rows stay or go
    alike; texts of any length are judged whole; an empty table gives no row.
    """
    langs, prototypes = learn(docs.where(~held_out()))
    enough = least(docs, (langs, prototypes))

    def run_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for run in batches.runs(batch):
                lang, s, of = _predict(batches.texts(run.column("text")), langs, prototypes)
                yield run.filter(pa.array((lang != "und") & (s >= enough[of])))

    return docs.mapInArrow(run_, docs.schema)
