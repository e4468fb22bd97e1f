"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or nothing on each document.  Expectation-maximisation over the
counts of vote patterns of the whole corpus estimates how each labeller votes on bad and on good
documents, without any gold label; the posterior of a document's pattern then trains a linear
scorer over hashed character-class trigrams, words and pairs of words, which scores every document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import batches, words

#: Documents that train the scorer (chosen by hash): the bound of what the driver holds.
SAMPLE = 8192
#: Hashed features of the scorer by kind (trigrams of classes and, last, the share of echoes; words; pairs of words), and
#: the score from which on a document is kept.
KINDS, KEEP = (1024, 1024, 1024), 0.4
FEATURES = sum(KINDS)
#: Trigrams, words and pairs of the mean document that each document is given besides its own.
PRIOR = (100, 50, 50)
#: Trigrams at which a text's own score and the sample's mean label count alike.
SHORT = 20
#: Shares of good and of bad votes that a labeller is taken to cast on good and on bad documents before any is seen, counted as
#: STRENGTH votes of either class, and the share of bad documents: they decide in a corpus of a few rows and are nothing in a large one.
EXPECTED, STRENGTH, BAD_SHARE = ((0.93, 0.07), (0.4, 0.6)), 10.0, 0.2
VOTERS = ("capitals", "symbols", "signs", "lone", "echoes", "variety", "sentences", "word_length")
#: Classes of code points: letters (of scripts with spaces between words), capitals, digits, blanks, line ends, ends of
#: sentences, other punctuation, exclamation marks, letters of scripts without spaces, everything else.
LETTER, CAPITAL, DIGIT, BLANK, LINE, END, POINT, SHOUT, SOLID, OTHER = range(10)
CLASSES = 10
#: Letters of a script without spaces that count as one word.
SOLID_WORD = 2
#: Ends of sentences and exclamation marks of several scripts, ASCII punctuation that prose uses, and
#: what names of letters begin with in scripts that are written without spaces.
ENDS, SHOUTS, PROSE = ".?\u3002\uff1f\uff0e\uff61\u0964\u0965\u061f\u06d4\u104b\u17d4\u1362", "!\uff01\u00a1", ",;:'\"-()"
UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "HALFWIDTH KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN", "YI ", "BOPOMOFO")
#: First code point of the planes of rare ideographs, which share one entry of the table.
_RARE = 0x20000


@lru_cache(None)
def _table() -> np.ndarray:
    """Class of each code point below _RARE, and of those beyond it in a last entry."""

    def kind(x: int) -> int:
        c = chr(x)
        if c in SHOUTS or c in ENDS:
            return SHOUT if c in SHOUTS else END
        if c in " \t\n\v\f\r":
            return LINE if c == "\n" else BLANK
        what = unicodedata.category(c)
        if what[0] in "LM":
            return SOLID if unicodedata.name(c, "").startswith(UNSPACED) else CAPITAL if what in ("Lu", "Lt") else LETTER
        if what[0] in "NZ":
            return DIGIT if what[0] == "N" else BLANK
        return POINT if c in PROSE or (x > 127 and what[0] == "P") else OTHER

    return np.array([kind(x) for x in range(_RARE)] + [SOLID], np.uint8)


def points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point of all texts, and where the texts begin and end among them."""
    table = _table()
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    kind = table[lead]
    wide = np.flatnonzero(lead >= 128)
    if len(wide):
        tail = np.append(data, np.zeros(3, np.uint8))
        head, first = lead[wide].astype(np.int32), at[wide]
        one, two, three = (tail[first + k].astype(np.int32) & 63 for k in (1, 2, 3))
        code_ = np.where(head < 224, (head & 31) << 6 | one, np.where(head < 240, (head & 15) << 12 | one << 6 | two, (head & 7) << 18 | one << 12 | two << 6 | three))
        kind[wide] = table[np.minimum(code_, _RARE)]
    return kind, np.searchsorted(at, offs)


def _counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point, the text of each, and code points of each class in each text."""
    kind, offs = points(data, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    return kind, doc, np.bincount(doc * CLASSES + kind, minlength=CLASSES * (len(offs) - 1)).reshape(-1, CLASSES).astype(float)


def _lone(kind: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Share of each text's words that hold neither a letter nor a digit."""
    word = np.append((kind != BLANK) & (kind != LINE), False)
    starts = word[:-1].copy()
    starts[1:] &= ~word[:-2] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(n)
    told = np.isin(kind, (LETTER, CAPITAL, DIGIT, SOLID))
    bare = np.add.reduceat(told.astype(np.int64), at) == 0  # the blanks after a word hold nothing
    return np.bincount(doc[at], bare, n) / np.maximum(1, np.bincount(doc[at], minlength=n))


def votes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Votes of each labeller on each text: 2 bad, 1 good, 0 none.

    Three labellers look at signs: symbols a word, all signs a word, and words that are nothing but signs.
    Labellers that need words say nothing on texts mostly of scripts without spaces.
    """
    kind, doc, n = _counts(data, offs)
    hashed, n_words = words.hashes(data, offs)
    of = np.repeat(np.arange(len(n)), n_words)
    echo = np.zeros(len(hashed), np.int64)
    if len(hashed):
        echo[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
    echoes = batches.sums(echo, n_words) / np.maximum(1, n_words)
    order = np.lexsort((hashed, of))
    new = np.ones(len(hashed), np.int64)
    new[1:] = (np.diff(hashed[order]) != 0) | (np.diff(of) != 0)
    variety = np.log(np.maximum(1, batches.sums(new, n_words))) / np.log(np.maximum(2, n_words))  # as alike at every length
    letters = np.maximum(1, n[:, [LETTER, CAPITAL, SOLID]].sum(1))
    capitals, solid = n[:, CAPITAL] / letters, n[:, SOLID] / letters > 0.5
    length = (n.sum(1) - n[:, [BLANK, LINE]].sum(1)) / np.maximum(1, n_words)
    units = 1 + n_words + n[:, SOLID] / SOLID_WORD  # one more: a sign says little in a few words
    odd = n[:, [SHOUT, OTHER]].sum(1) / units
    signs = odd + n[:, [END, POINT]].sum(1) / units
    sentences = n[:, END] / units
    lone = _lone(kind, doc, len(n))

    def vote(bad, good, told=True):
        return np.where(told, np.where(bad, 2, np.where(good, 1, 0)), 0)

    out = np.stack(
        [
            vote(capitals > 0.5, capitals < 0.15),
            vote(odd > 0.3, odd < 0.08),
            vote(signs > 0.7, signs < 0.36),
            vote(lone > 0.1, lone < 0.02),
            vote(echoes > 0.3, echoes < 0.05),
            vote((variety < 0.6) & (n_words > 20), variety > 0.8, ~solid),
            vote((sentences < 0.01) & (n_words > 20), (sentences > 0.03) & (sentences < 0.5), ~solid),
            vote((length > 14) | (length < 2.5), (length > 3.5) & (length < 9), ~solid),
        ],
        1,
    )
    return np.where(n_words[:, None] > 0, out, 0).astype(np.int64)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, as shares of each of the KINDS; and how many of each kind it has."""
    kind, doc, _ = _counts(data, offs)
    k = kind.astype(np.int64)
    tri = (k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:]
    own = doc[:-2] == doc[2:]
    hashed, n_words = words.hashes(data, offs)
    of = np.repeat(np.arange(len(n_words)), n_words)
    near = of[1:] == of[:-1]
    with np.errstate(over="ignore"):
        pair = words.mix(hashed[:-1][near] * np.uint64(3) + hashed[1:][near])
    where = [doc[:-2][own], of, of[1:][near]]
    what = [(tri[own] * 2654435761 >> 7) % (KINDS[0] - 1), (hashed % np.uint64(KINDS[1])).astype(np.int64), (pair % np.uint64(KINDS[2])).astype(np.int64)]
    parts, sizes = [], []
    for size, d, x in zip(KINDS, where, what):
        part = np.bincount(d * size + x, minlength=size * len(n_words)).reshape(-1, size).astype(np.float32)
        sizes.append(part.sum(1))
        parts.append(part / np.maximum(1, sizes[-1])[:, None])
    if len(hashed):
        echo = np.concatenate([[0], (hashed[1:] == hashed[:-1]) & near])
        parts[0][:, -1] = batches.sums(echo, n_words) / np.maximum(1, n_words)
    return np.concatenate(parts, 1), np.stack(sizes, 1)


def smoothed(shares: np.ndarray, n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Square roots of shares to which PRIOR of each kind of the mean document are added: short texts say little.  ``shares`` is overwritten."""
    begin = 0
    for k, size in enumerate(KINDS):
        weight = (n[:, k] / (n[:, k] + PRIOR[k]))[:, None].astype(np.float32)
        part = shares[:, begin : begin + size]
        part *= weight
        part += mean[begin : begin + size].astype(np.float32) * (1 - weight)
        begin += size
    return np.sqrt(shares, out=shares)


def _scores(data: np.ndarray, offs: np.ndarray, scorer) -> np.ndarray:
    w, b, mean, base = scorer
    x, n = features(data, offs)
    s = 1 / (1 + np.exp(-(smoothed(x, n, mean) @ w + b)))
    told = n[:, 0] / (n[:, 0] + SHORT)
    s = told * s + (1 - told) * base
    return np.where(words.hashes(data, offs)[1] > 0, s, 0.0)


def code(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def posterior(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability that documents of each vote pattern are bad, by expectation-maximisation.

    Given its class, a document's votes are independent; each labeller has a share of bad ones
    among the votes it casts on either class, to which EXPECTED is added; a labeller that says nothing is no
    evidence.  Starts from any bad vote; documents without a vote count for nothing; the bad class is
    the one of more bad votes.
    """
    p, counts = np.where((patterns == 2).any(1), 0.9, 0.1), np.where((patterns > 0).any(1), counts, 0)
    believed = STRENGTH * np.array(EXPECTED)[:, None, :]
    one_hot = patterns[:, :, None] == np.array([1, 2])
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p], 1)
        prior = (w.sum(0) + STRENGTH * np.array([1 - BAD_SHARE, BAD_SHARE])) / (w.sum() + STRENGTH)
        rates = np.einsum("pc,pvk->cvk", w, one_hot) + believed
        rates /= rates.sum(2, keepdims=True)
        logs = np.log(prior) + np.einsum("pvk,cvk->pc", one_hot, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p if rates[1, :, 1].sum() >= rates[0, :, 1].sum() else 1 - p


def fit(x: np.ndarray, good: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels (Adam, from zero); x stays in single precision."""
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-(x @ w[:-1].astype(np.float32) + w[-1]))) - good).astype(np.float32)
        g = np.append(error @ x, error.sum()) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, np.ndarray, float]:
    """The scorer: pattern counts cover every document, the fit ``sample`` different rows (doc_id and text) at most."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(VOTERS), np.int64)
        for batch in it:
            for run in batches.runs(batch):
                total += np.bincount(code(votes(*batches.spans(run.column("text")))), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pattern", "n"])

    texts = docs.select("text")
    found = texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # 3 ** voters rows at most
    if not found:
        return np.zeros(FEATURES), 0.0, np.zeros(FEATURES), 0.5
    codes = np.array([r.pattern for r in found])
    patterns, counts = codes[:, None] // 3 ** np.arange(len(VOTERS)) % 3, np.array([r.n for r in found], float)
    bad = dict(zip(codes.tolist(), posterior(patterns, counts)))

    def examples(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # SAMPLE digests at most
        for batch in it:
            fresh = []
            for k, h in enumerate(batch.column("h").to_pylist()):
                if h not in seen:
                    seen.add(h)
                    fresh.append(k)
            for run in batches.runs(batch.take(pa.array(fresh, pa.int64()))):
                data, offs = batches.spans(run.column("text"))
                x, size = features(data, offs)
                raw = [r.tobytes() for r in x.astype(np.float16)]
                sizes = [r.tobytes() for r in size.astype("<f4")]
                yield pa.RecordBatch.from_arrays([run.column("h"), pa.array(code(votes(data, offs))), pa.array(sizes, pa.binary()), pa.array(raw, pa.binary())], ["h", "pattern", "size", "x"])

    # The rows of the smallest digests; a digest covers doc_id too, so copies of a text come in by their share of the rows.
    drawn = docs.where(F.length("text") > 0).select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("h"), "text")
    last = drawn.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = []
    if last is not None:
        chosen = drawn.where(F.col("h") <= last).mapInArrow(examples, "h long, pattern long, size binary, x binary")
        rows = chosen.dropDuplicates(["h"]).orderBy("h").collect()  # ``sample`` rows at most
    if not rows:
        return np.zeros(FEATURES), 0.0, np.zeros(FEATURES), 0.5
    x = np.zeros((len(rows), FEATURES), np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r.x, np.float16)
    size, good = np.stack([np.frombuffer(r.size, "<f4") for r in rows]), 1 - np.array([bad.get(r.pattern, 0.5) for r in rows])
    del rows
    mean = x.mean(0)
    return *fit(smoothed(x, size, mean), good), mean, float(good.mean())


def score(docs: DataFrame, scorer: tuple[np.ndarray, float, np.ndarray, float] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, quality_score (0 to 1), kept.

    Null text and texts without a word score 0 and are not kept.  Equal texts get equal scores,
    repeated rows repeated results; an empty table gives no row; other columns are ignored.
    """
    scorer = scorer or train(docs)

    def run_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for run in batches.runs(batch):
                s = _scores(*batches.spans(run.column("text")), scorer)
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(s), pa.array(s >= KEEP)], ["doc_id", "quality_score", "kept"])

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run_, "doc_id long, quality_score double, kept boolean")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps (see :func:`score`), with all their columns, scored in one pass."""
    scorer = train(docs)

    def run_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for run in batches.runs(batch):
                yield run.filter(pa.array(_scores(*batches.spans(run.column("text")), scorer) >= KEEP))

    return docs.mapInArrow(run_, docs.schema)
