"""Operator 7: language identification by interpolated Kneser-Ney character models.

One model for each language, over the characters of a word and the gaps around
it, kept as sorted arrays of n-gram hashes with log-probabilities and back-off
weights.  A document gets the language with the lowest cross-entropy per
character; no n-gram spans two words, so a word's log-probability is the same
everywhere and each task scores every distinct word once.

Models are fitted on a bounded sample of every label: at most ``documents``
documents with a text, in the order of a hash of their ids, and of these as many as
``characters`` allow; with many labels each gets its share of ``total`` characters,
and the sample is halved until the models have at most ``bytes`` bytes.  One in five
documents is set aside to calibrate rejection.  A document is rejected if it has no letter, or
if its cross-entropy, with every word in the language that fits it best (so that documents that
mix known languages stay), exceeds the mean of its language by more than ``spread`` deviations
for its length and by more than the limit of the language.  The limit is half the distance
between known languages: of the words of a set-aside document that fit its language best, as the
model that knows them least sees them (the median of the languages); but not less than any
set-aside document of the language has.  ``slack`` is the limit where there is one language only.

Edge cases: null, empty and letterless texts are ``und`` with score 0; ties go
to the language that sorts first; without any labelled text everything is
``und``; repeated rows are predicted alike; a null doc_id is neither held out
nor learned from; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.tokens import loaded, sliced, trim

ORDER = 5
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(ORDER + 1)], np.uint64)
#: Characters that no model has seen share one unit of probability.
UNSEEN = 1000.0
#: Bytes of text scored at a time: every run of letters in it has a row of numbers.
SLICE_BYTES = 1_000_000
#: Rows of two values that may be sent to all tasks.
FEW = 100_000
#: A text is rejected at this share of the distance between known languages.
FOREIGN = 0.5


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case runs of letters, the place of every run among them, and the runs' bounds for each text.

    Runs that touch a digit (keys, hashes) are left out of a text that has others.
    """
    text = pc.utf8_lower(texts)
    plain = pc.replace_substring_regex(text, r"\pL*\pN[\pL\pN]*|\PL+", " ")
    bare = pc.equal(pc.ascii_trim_whitespace(plain), "")
    lower = pc.if_else(bare, pc.replace_substring_regex(pc.if_else(bare, text, ""), r"\PL+", " "), plain)
    split = pc.split_pattern(lower, " ")
    coded = split.flatten().dictionary_encode()
    bounds = split.offsets.to_numpy()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds - bounds[0]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every predicted character: its word, its place in the word (from 1), and hashes of the n-grams that end there (index n)."""
    text = "".join(f" {w} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = [np.zeros(len(codes), np.uint64)]
    for n in range(1, ORDER + 1):
        older = np.zeros(len(codes), np.uint64)
        older[n - 1 :] = codes[: max(0, len(codes) - n + 1)] * _POWERS[n - 1]
        hashes.append(hashes[-1] + older)
    return owner, place, hashes


@dataclass
class Model:
    """Sorted hashes with log-probabilities for each order, and back-off weights of contexts of each length."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float

    def characters(self, place: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        """Log-probability of every character; only those with ``place`` above 0 mean anything."""
        out, open_ = np.zeros(len(place)), place > 0
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(open_ & (place >= n - 1))
            if not len(at):
                continue
            row, known = _found(self.grams[n], hashes[n][at])
            hit = at[known]
            out[hit] += self.logp[n][row[known]]
            open_[hit] = False
            miss = at[~known]
            before = hashes[n - 1][miss - 1] if n > 1 else np.zeros(len(miss), np.uint64)
            row, known = _found(self.contexts[n], before)
            out[miss[known]] += self.weights[n][row[known]]
        out[open_] += self.floor
        return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


def train(texts: list[str]) -> Model:
    """Interpolated Kneser-Ney model of the words of ``texts``."""
    distinct, at, _ = words_of(pa.array(texts, pa.large_string()))
    times = np.bincount(at, minlength=len(distinct))
    keep = [i for i, w in enumerate(distinct) if w]
    owner, place, hashes = _grams([distinct[i] for i in keep])
    weight = times[keep][owner]
    grams, logp, contexts, weights = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, np.uint64)], [np.zeros(0)]
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(1, ORDER + 1):
        full = (place >= max(1, n - 1))
        if n == ORDER:
            own, counts = hashes[n][full], weight[full]
        else:  # continuation counts, but plain ones where nothing can stand before
            first, inner = full & (place == n - 1), np.flatnonzero(full & (place >= n))
            _, once = np.unique(hashes[n + 1][inner], return_index=True)
            own = np.concatenate([hashes[n][first], hashes[n][inner[once]]])
            counts = np.concatenate([weight[first], np.ones(len(once), np.int64)])
        keys, back = np.unique(own, return_inverse=True)
        count = np.bincount(back, weights=counts, minlength=len(keys))
        # One position of each n-gram tells its context and its shorter n-gram.
        where = np.flatnonzero(full)
        _, example = np.unique(hashes[n][where], return_index=True)
        sample = where[example]
        context = hashes[n - 1][sample - 1] if n > 1 else np.zeros(len(sample), np.uint64)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.75
        held, group = np.unique(context, return_inverse=True)
        total = np.bincount(group, weights=count)
        types = np.bincount(group)
        less = np.minimum(discount, count)
        leftover = np.bincount(group, weights=less) / total
        if lower is None:
            below = np.full(len(keys), 1.0 / UNSEEN)
        else:
            row, known = _found(lower[0], hashes[n - 1][sample])
            below = np.where(known, lower[1][row], 1e-9)
        p = (count - less) / total[group] + leftover[group] * below
        assert len(types) == len(held)
        grams.append(keys)
        logp.append(np.log(p))
        contexts.append(held)
        weights.append(np.log(np.maximum(leftover, 1e-12)))
        lower = (keys, p)
    return Model(grams, logp, contexts, weights, -float(np.log(UNSEEN)))


@dataclass
class Identifier:
    """Models by language with the calibration of rejection; ``calibration`` has (mean, deviation for one character, limit above the mean) for each language."""

    languages: list[str]
    models: list[Model]
    calibration: np.ndarray
    spread: float

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for m in self.models for arrays in (m.grams, m.logp, m.contexts, m.weights) for a in arrays)


class Scorer:
    """Scores texts; a table of at most about ``limit`` distinct words stays in memory."""

    def __init__(self, identifier: Identifier, limit: int = 200_000) -> None:
        self._of, self._limit = identifier, limit
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._logp = np.zeros((0, len(self._of.languages)))
        self._size = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        owner, place, hashes = _grams(words)
        inner = place > 0
        logp = np.stack([np.bincount(owner[inner], weights=m.characters(place, hashes)[inner], minlength=len(words)) for m in self._of.models], axis=1)
        self._place.update(zip(words, range(len(self._size), len(self._size) + len(words)), strict=True))
        self._logp = np.concatenate([self._logp, logp])
        self._size = np.concatenate([self._size, np.fromiter(map(len, words), np.int64, len(words)) + 1])

    def _runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every run of letters: its text, its log-probability in each language and its characters."""
        if len(self._place) > self._limit:
            self._clear()
        distinct, at, bounds = words_of(texts)
        fresh = [w for w in distinct if w and w not in self._place]
        for k in range(0, len(fresh), 50_000):
            self._learn(fresh[k : k + 50_000])
        rows = np.fromiter((self._place.get(w, -1) for w in distinct), np.int64, len(distinct))[at]
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        owner, rows = owner[rows >= 0], rows[rows >= 0]
        return owner, self._logp[rows], self._size[rows]

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character for each language, the characters of letter runs of each text (0: no letter), and its cross-entropy with every word in the language that fits it best."""
        owner, logp, size = self._runs(texts)
        total = lambda values: np.bincount(owner, weights=values, minlength=len(texts))
        chars = total(size)
        each = np.maximum(chars, 1)
        return -np.stack([total(logp[:, k]) for k in range(logp.shape[1])], axis=1) / each[:, None], chars, -total(logp.max(axis=1)) / each

    def as_seen(self, texts: pa.Array, language: int) -> np.ndarray:
        """Cross-entropy in each language of the words of ``texts`` that fit ``language`` best; NaN if there are none."""
        _, logp, size = self._runs(texts)
        own = logp.argmax(axis=1) == language
        return -logp[own].sum(axis=0) / size[own].sum() if own.any() else np.full(logp.shape[1], np.nan)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score from 0 to 1, rejected) of each text; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        names, scores, rejected = [], [], []
        for piece in sliced(texts, SLICE_BYTES):
            if not self._of.languages:
                names += ["und"] * len(piece)
                scores.append(np.zeros(len(piece)))
                rejected.append(np.ones(len(piece), bool))
                continue
            entropy, chars, mixed = self.entropies(piece)
            pick = entropy.argmin(axis=1)
            none = chars == 0
            names += ["und" if n else self._of.languages[p] for p, n in zip(pick, none, strict=True)]
            share = np.exp(entropy.min(axis=1, keepdims=True) - entropy)
            scores.append(np.where(none, 0.0, 1 / share.sum(axis=1)))
            mean, deviation, limit = self._of.calibration[pick].T
            rejected.append(none | (mixed - mean > np.maximum(limit, self._of.spread * deviation / np.sqrt(np.maximum(chars, 1)))))
        trim()
        return names, np.concatenate(scores or [np.zeros(0)]), np.concatenate(rejected or [np.zeros(0, bool)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, documents: int, characters: int, total: int) -> dict[str, list[str]]:
    """Texts by label from rows of ``docs`` (doc_id, text, lang) that are not held out.

    Of a label at most ``documents`` documents, and as many as its characters allow (its share of ``total``,
    ``characters`` at most); documents of a quarter of these or more only where others leave room (one at least).
    """
    size = F.length("text")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    labels = labelled.select("lang").distinct().count()
    allowed = min(characters, total // max(1, labels))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = labelled.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(1, min(documents, allowed)))
    chosen = ranked.select("doc_id", "lang").distinct()
    if labels * max(1, min(documents, allowed)) <= FEW:  # so many rows at most; else texts meet them in a shuffle
        chosen = F.broadcast(chosen)
    texts = labelled.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi").distinct().select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", "text", (size * 4 >= allowed).alias("long"))
    room = Window.partitionBy("lang").orderBy("long", "h", "doc_id", "text")
    fitting = texts.withColumns({"r": F.row_number().over(room), "upto": F.sum(size).over(room.rowsBetween(Window.unboundedPreceding, 0))}).where((F.col("r") == 1) | (F.col("upto") <= allowed))
    by: dict[str, list[str]] = {}
    for row in sorted(fitting.select("lang", "r", "text").collect(), key=lambda r: (r["lang"], r["r"])):  # at most `total` characters, or one document a label
        by.setdefault(row["lang"], []).append(row["text"])
    return by


def learned(by: dict[str, list[str]], slack: float = 3.0, spread: float = 8.0) -> Identifier:
    """Models of the labels in ``by`` and the calibration of rejection, from every fifth text of a label (from all where there are fewer)."""
    learn = {lang: [t for k, t in enumerate(texts) if k % 5 != 4] for lang, texts in sorted(by.items())}
    learn = {lang: texts for lang, texts in learn.items() if any(map(str.isalpha, "".join(texts)))}
    names = list(learn)
    aside = {k: pa.array([t for i, t in enumerate(by[k]) if i % 5 == 4] or learn[k], pa.large_string()) for k in names}
    calibration = np.zeros((len(names), 3))
    calibration[:, 2] = slack
    identifier = Identifier(names, [train(learn[k]) for k in names], calibration, spread)
    if not names:
        return identifier
    scorer = Scorer(identifier)
    scored = [scorer.entropies(aside[lang]) for lang in names]
    means = np.array([np.average(mixed, weights=chars) if chars.any() else 0.0 for _, chars, mixed in scored])
    # How far the words of a language are from the model that knows them least: models of mixed documents know their neighbours.
    far = np.array([np.max(np.delete(scorer.as_seen(aside[lang], k) - means, k), initial=-np.inf) for k, lang in enumerate(names)])
    far = far[np.isfinite(far)]
    for k, (_, chars, mixed) in enumerate(scored):
        excess, chars = (mixed - means[k])[chars > 0], chars[chars > 0]
        if len(chars):
            # The median, as a few documents that mix languages deviate far more.
            deviation = 1.4826 * np.median(np.abs(excess) * np.sqrt(chars))
            calibration[k] = means[k], deviation, max(FOREIGN * np.median(far), excess.max()) if len(far) else slack
    return identifier


def fit(docs: DataFrame, documents: int = 150, characters: int = 600_000, total: int = 6_000_000, most_bytes: int = 200 << 20, slack: float = 3.0, spread: float = 8.0) -> Identifier:
    """Models of all labels of ``docs`` (doc_id, text, lang), from a bounded sample of rows that are not held out; together at most ``most_bytes`` large."""
    by = sample(docs, documents, characters, total)
    while (identifier := learned(by, slack, spread)).nbytes > most_bytes and any(len(texts) > 1 for texts in by.values()):
        by = {lang: texts[: -(-len(texts) // 2)] for lang, texts in by.items()}
    if identifier.nbytes > most_bytes:
        raise ValueError(f"the models of {len(by)} labels take {identifier.nbytes} bytes; allow more or merge labels")
    return identifier


def _scorer(shared, name: str) -> Scorer:
    """One scorer for each worker process and broadcast."""
    return loaded(lambda _: Scorer(shared.value), f"broadcast {name}")


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of ``docs`` (doc_id, text)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(identifier), uuid.uuid4().hex  # at most `most_bytes` large, see fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared, name)
        for batch in batches:
            names, scores, rejected = scorer.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns unchanged."""
    shared, name = docs.sparkSession.sparkContext.broadcast(identifier), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared, name)
        for batch in batches:
            yield batch.filter(pa.array(~scorer.predict(batch.column("text"))[2]))

    return docs.mapInArrow(run, docs.schema)
