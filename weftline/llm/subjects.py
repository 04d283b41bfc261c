"""Subject areas of documents.

Complement naive Bayes is trained on labelled documents and refined by
expectation-maximization over the sentences of all documents; the posteriors of
the subjects, which don't exclude each other in a document, are calibrated one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import checkpoint

#: Words are hashed to so many features and pairs of words to so many others; the model has a row for each.
WORDS, PAIRS = 1 << 17, 1 << 17
FEATURES = WORDS + PAIRS
#: Rounds of expectation-maximization.
ROUNDS = 6
#: Labelled documents used to calibrate, at most.
CALIBRATION_DOCS = 20_000
#: Most subject areas: the counts of all features then fill 136 MB in a task and in the driver.
MAX_SUBJECTS = 64
#: A document is about a subject that this share of its sentences deals with.
SHARE = 0.125
#: Smoothing count of a feature.
ALPHA = 2.0
#: A feature tells of a subject from this part of the way between the subject's base rate and SURE, in log odds; a sentence's features must make up for DOUBT.
COMMON, SURE, DOUBT = 0.35, 0.85, 1.5
#: All sentences of a document together weigh n / (1 + n / SAY) of their number n: nearly that of short ones, and never more than SAY, lest a very long or repetitive document drown the others.
SAY = 64
#: Less of a sentence than this part deals with none of the subjects instead.
LEAST_PART = 1e-4
#: How much less likely a subject is in a labelled document that doesn't name it (annotators err).
UNNAMED = 0.15
#: Lines compared between sentences that deal with a subject and others, as log odds of the sentence's posterior, and how far off even odds is a likely place.
LINES, LINE_SD = (-3.0, -2.0, -1.25, -0.6, 0.0, 0.6, 1.25, 2.0, 3.0), 1.0
#: Weight of an even mix against the document's own mix of subjects.
EVEN = 0.5

# What precedes the words of a line - bullet, time, clip reference, speaker.
_PREFIX = r"(?m)^[ \t]*(?:[-*•–][ \t]*)?(?:\d{1,3}:\d\d(?::\d\d)?[ \t]+)?(?:seg \d+ / \S+ @ [\d.]+s:[ \t]*)?(?:[^\s:.!?।]{1,30}:[ \t]+)?"

# Strings that mix Latin letters and digits, such as codes and encoded data, are no words; marks at their end still end a sentence.
_CODE = r"(?<!\S)\S*?(?:\d\p{IsLatin}|\p{IsLatin}\d)\S*?(?=[.!?।॥…]*+(?!\S))"


def sentences(text: Column) -> Column:
    """The sentences of a text as arrays of lower-case words; tags in brackets, links, codes and line prefixes are no words."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?|[\x{85}\x{2028}\x{2029}]", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\[[\p{L}_ ]{1,30}\]|https?://\S+", " "), r"\p{Cf}+", "")
    t = F.regexp_replace(F.regexp_replace(t, _PREFIX, ""), _CODE, " ")
    words = F.transform(F.split(F.lower(t), r"[.!?।॥…]+(?=\s|$)|\n+"), lambda s: F.regexp_extract_all(s, F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0)))
    return F.filter(words, lambda w: F.size(w) > 0)


def features(text: Column) -> Column:
    """The sentences with each word hashed to a feature."""
    return F.transform(sentences(text), lambda s: F.transform(s, lambda w: F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("int")))


@dataclass
class Batch:
    """Features of a batch of documents: word and pair features end to end, where each sentence begins, and the document of each sentence."""

    word: np.ndarray
    pair: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    docs: int

    @classmethod
    def of(cls, column: pa.ListArray) -> Batch:
        per_doc = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = column.flatten()
        size = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        word = inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        pair = np.empty_like(word)
        pair[1:] = WORDS + (word[:-1] * 40503 + word[1:] * 31 + 12345) % PAIRS
        pair[begin] = WORDS + (word[begin] * 31 + 12345) % PAIRS
        return cls(word, pair, begin, np.repeat(np.arange(len(per_doc)), per_doc), len(per_doc))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each sentence's words, and of those pairs of which a word tells of the same subject.

        So a rare pair that shares its feature with another one's has no say.
        """
        out = np.zeros((len(self.begin), weights.shape[1]), np.float32)
        telling = weights.any(1)[self.word]
        near = telling.copy()
        near[1:] |= telling[:-1]
        near[self.begin] = telling[self.begin]
        at = np.flatnonzero(near)
        if not len(at):
            return out
        first = np.zeros(len(self.word), bool)
        first[self.begin] = True
        word = weights[self.word[at]]
        before = weights[self.word[np.maximum(at - 1, 0)]] * ~first[at][:, None]
        value = word + weights[self.pair[at]] * ((word > 0) | (before > 0))
        sentence = np.searchsorted(self.begin, at, "right") - 1
        begins = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
        out[sentence[begins]] = np.add.reduceat(value, begins, axis=0)
        return out

    def posteriors(self, weights: np.ndarray, doubt: float, allowed: np.ndarray) -> np.ndarray:
        """Of each sentence over subjects and none, given its document's own mix; parts below LEAST_PART go to none.

        ``allowed`` has the factor of each subject in each document.
        """
        logit = self.scores(weights) + np.log(allowed)[self.doc]
        logit[:, -1] += doubt
        post = _softmax(logit)
        count = np.bincount(self.doc, minlength=self.docs)[:, None]
        mix = np.stack([np.bincount(self.doc, post[:, k], self.docs) for k in range(post.shape[1])], 1)
        mix = (mix + EVEN * count / post.shape[1] + 1e-3) / (count * (1 + EVEN) + 1e-3 * post.shape[1])
        post = _softmax(logit + 0.5 * np.log(mix)[self.doc])
        post[:, :-1][post[:, :-1] < LEAST_PART] = 0
        post[:, -1] = 1 - post[:, :-1].sum(1)
        return post

    def shares(self, weights: np.ndarray, doubt: float, lines: np.ndarray) -> np.ndarray:
        """The share of each document's sentences whose posterior of each subject reaches its line: documents x subjects for ``lines`` by subject, or documents x subjects x lines for a table of them."""
        classes = weights.shape[1]
        post = self.posteriors(weights, doubt, np.ones((self.docs, classes)))[:, :-1]
        least = 1 / (1 + np.exp(-np.atleast_2d(lines)))
        n = np.maximum(1, np.bincount(self.doc, minlength=self.docs))[:, None]
        out = np.stack([np.stack([np.bincount(self.doc, post[:, k] >= row[k], self.docs) for k in range(classes - 1)], 1) / n for row in least], 2)
        return out[:, :, 0] if np.ndim(lines) == 1 else out


def _softmax(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def complement_weights(counts: np.ndarray) -> np.ndarray:
    """Log odds of each feature in a subject against its complement - all other subjects, and what deals with none - beyond COMMON, else 0.

    Words that all subjects share, such as those of a language, so have no part and
    can't draw its sentences to one subject.  The last class, none, is what the
    subjects are weighed against and has no weights.
    """
    mine = counts[:, :-1]
    rest = counts.sum(1, keepdims=True) - mine
    base = (mine.sum(0) + 1) / (counts.sum() + counts.shape[1])
    odds = np.log(base / (1 - base))
    w = np.log((mine + ALPHA * base) / (rest + ALPHA * (1 - base))) - odds
    common = COMMON * np.maximum(np.log(SURE / (1 - SURE)) - odds, 0)
    return np.concatenate([np.maximum(w - common, 0), np.full((len(w), 1), 0.0)], 1).astype(np.float32)


def _collect(parts: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of features by class, and sentences by class, summed over partitions; at most FEATURES + 1 rows come to the driver."""
    total = parts.groupBy("f").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(classes))).toPandas()
    counts, sizes = np.zeros((FEATURES, classes)), np.zeros(classes)
    if len(total):
        f = total["f"].to_numpy(np.int64)
        values = total[[f"c{k}" for k in range(classes)]].to_numpy(np.float64)
        counts[f[f >= 0]] = values[f >= 0]
        sizes += values[f < 0].sum(0)
    return counts, sizes


def _counts(docs: DataFrame, classes: int, model: object | None) -> tuple[np.ndarray, np.ndarray]:
    """One pass over the documents: expected counts under ``model``, or by the labels alone where it is None."""
    names = [f"c{k}" for k in range(classes)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros((FEATURES, classes)), np.zeros(classes)
        for b in batches:
            batch = Batch.of(b.column("x"))
            allowed = _allowed(b.column("labels"), classes)
            if shared.value is None:
                named = allowed == 1
                named[:, -1] &= named.sum(1) == 1
                post = (named / named.sum(1, keepdims=True))[batch.doc]
            else:
                weights, doubt = shared.value
                post = batch.posteriors(weights, doubt, allowed)
            post = post / (1 + np.bincount(batch.doc, minlength=batch.docs) / SAY)[batch.doc][:, None]
            length = np.diff(np.append(batch.begin, len(batch.word)))
            for k in range(classes):
                some = np.flatnonzero(post[:, k])
                n_words = length[some]
                at = np.repeat(batch.begin[some] - (np.cumsum(n_words) - n_words), n_words) + np.arange(n_words.sum())
                weight = np.repeat(post[some, k], n_words)
                for feature, lo, size in ((batch.word, 0, WORDS), (batch.pair, WORDS, PAIRS)):
                    counts[lo : lo + size, k] += np.bincount(feature[at] - lo, weight, size)
            sizes += post.sum(0)
        some = np.flatnonzero(counts.sum(1) > 1e-6)
        f = np.append(some, -1).astype(np.int32)
        values = np.vstack([counts[some], sizes[None]])
        yield pa.RecordBatch.from_arrays([pa.array(f), *(pa.array(values[:, k]) for k in range(classes))], ["f", *names])

    parts = docs.mapInArrow(run, "f int, " + ", ".join(f"{n} double" for n in names))
    try:
        return _collect(parts, classes)
    finally:
        shared.unpersist()


def _allowed(labels: pa.Array, classes: int) -> np.ndarray:
    """Factor of each class in each document: 1, or UNNAMED for subjects that the document's annotators didn't name.  The last class is none of the subjects."""
    out = np.ones((len(labels), classes))
    named = labels.is_valid().to_numpy(zero_copy_only=False)
    size = labels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out[named, :-1] = UNNAMED
    rows = np.repeat(np.arange(len(labels)), size)
    out[rows, labels.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = 1
    return out


def _calibrate(x: np.ndarray, named: np.ndarray, slope: float = 6.0) -> tuple[float, float]:
    """Slope of P(is about the subject | x) = 1 / (1 + exp(-slope * x)), whose middle is SHARE by definition, and how likely the labels then are (a logarithm).

    Annotators err, so how often they miss a subject and name a wrong one is fitted
    as well; where labels are few, the slope stays near the one given.
    """
    miss, wrong = 0.1, 0.02
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        yes, no = p * np.where(named, 1 - miss, miss), (1 - p) * np.where(named, wrong, 1 - wrong)
        z = yes / np.maximum(yes + no, 1e-12)
        miss = (z[~named].sum() + 1) / (z.sum() + 10)
        wrong = ((1 - z)[named].sum() + 0.2) / ((1 - z).sum() + 10)
        gradient = x @ (p - z) + (slope - 6.0) / 9
        curve = (x * x) @ (p * (1 - p)) + 1 / 9
        slope = float(np.clip(slope - np.clip(gradient / curve, -1, 1), 0.5, 50))
    p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
    likely = p * np.where(named, 1 - miss, miss) + (1 - p) * np.where(named, wrong, 1 - wrong)
    return slope, float(np.log(np.maximum(likely, 1e-12)).sum())


def fit_line(shares: np.ndarray, n: np.ndarray, named: np.ndarray) -> tuple[float, float]:
    """The line of LINES at which the documents' ``shares`` (documents x lines) agree best with the labels, and the slope there.

    Lines away from even odds have to earn it: where labels are few, the line stays there.
    """
    best = (0.0, 6.0, -np.inf)
    for i, line in enumerate(LINES):
        slope, likely = _calibrate(_odds(shares[:, i], n), named)
        likely -= line * line / (2 * LINE_SD**2)
        if likely > best[2]:
            best = (line, slope, likely)
    return best[:2]


def _prepare(documents: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, x, labels): hashed sentences and the numbers of the subjects named by annotators, null without annotation."""
    number = F.create_map(*(F.lit(v) for i, n in enumerate(names) for v in (n, i)))
    named = (
        labels.where("doc_id IS NOT NULL")
        .select("doc_id", F.when(F.col("subject").isNotNull(), number[F.col("subject")]).alias("k"), F.col("subject").isNull().alias("none"))
        .where("none OR k IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("k")).alias("labels"))
    )
    docs = documents.select("doc_id", features(F.col("text")).alias("x"))
    return docs.join(named, "doc_id", "left")


def _names(subjects: DataFrame) -> list[str]:
    rows = subjects.where("subject IS NOT NULL").select("subject").distinct().limit(MAX_SUBJECTS + 1).collect()
    if len(rows) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    return sorted(r[0] for r in rows)


def _shares(docs: DataFrame, weights: np.ndarray, lines: np.ndarray) -> DataFrame:
    """(doc_id, labels, n_sentences, shares), the shares of a document end to end."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, lines))
    width = (weights.shape[1] - 1) * (1 if np.ndim(lines) == 1 else len(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, lines = shared.value
        for b in batches:
            batch = Batch.of(b.column("x"))
            shares = batch.shares(weights, DOUBT, lines)
            n = np.bincount(batch.doc, minlength=batch.docs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.docs + 1, dtype=np.int32) * width), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("labels"), pa.array(n.astype(np.int32)), lists], ["doc_id", "labels", "n_sentences", "shares"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, labels array<int>, n_sentences int, shares array<double>")


def train(docs: DataFrame, classes: int, rounds: int = ROUNDS) -> np.ndarray | None:
    """Weights of the features: from the labelled of ``docs`` (see _prepare), then refined by expectation-maximization over all; null without labels."""
    counts, sizes = _counts(docs.where("labels IS NOT NULL"), classes, None)
    if not sizes.sum():
        return None
    for _ in range(rounds):
        counts, _ = _counts(docs, classes, (complement_weights(counts), DOUBT))
    return complement_weights(counts)


def calibrate(docs: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and slope of each subject, fitted one by one on at most CALIBRATION_DOCS labelled documents."""
    few = docs.where("labels IS NOT NULL AND size(x) > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_DOCS)
    table = np.repeat(np.array(LINES)[:, None], weights.shape[1] - 1, 1)
    sample = _shares(few, weights, table).toPandas()
    if not len(sample):
        return np.zeros(weights.shape[1] - 1), np.full(weights.shape[1] - 1, 6.0)
    shares = np.stack(sample["shares"].to_list()).reshape(len(sample), -1, len(LINES))
    n, labels = sample["n_sentences"].to_numpy(np.float64), [set(v) for v in sample["labels"]]
    fits = [fit_line(shares[:, k], n, np.array([k in v for v in labels], bool)) for k in range(weights.shape[1] - 1)]
    return np.array([f[0] for f in fits]), np.array([f[1] for f in fits])


def _odds(share: np.ndarray | Column, n: np.ndarray | Column, log=np.log):
    """Log of the share against SHARE, with half a sentence added."""
    return log((share * n + 0.5) / (SHARE * n + 0.5 - 1e-9))


def subject_posteriors(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject, n_sentences, share, posterior) for every document with sentences and each subject one of them deals with.

    Each subject is calibrated on its own, on at most CALIBRATION_DOCS labelled
    documents and allowing for annotators' errors: from which posterior on a sentence
    deals with it (fit_line; low lines let a sentence deal with several subjects), and
    how fast the posterior of a document rises with the log of its share of such
    sentences against SHARE, where it is one half.  Null and blank texts have no row.
    Labels of unknown documents or subjects are ignored; without labels, or
    without subjects, there are no rows.  Repeated documents are judged alike.
    """
    names = _names(subjects)
    docs = checkpoint(_prepare(documents, labels, names)) if names else None
    weights = train(docs, len(names) + 1, rounds) if names else None
    if weights is None:
        return documents.sparkSession.createDataFrame([], f"doc_id {dict(documents.dtypes)['doc_id']}, subject string, n_sentences int, share double, posterior double")
    lines, slopes = calibrate(docs, weights)
    shares = _shares(docs, weights, lines).where("n_sentences > 0")
    table = F.array(*(F.struct(F.lit(n).alias("subject"), F.lit(float(a)).alias("slope")) for n, a in zip(names, slopes)))
    each = shares.select("doc_id", "n_sentences", F.explode(F.arrays_zip(F.col("shares").alias("share"), table.alias("fit"))).alias("z"))
    share, n = F.col("z.share"), F.col("n_sentences")
    posterior = 1 / (1 + F.exp(-F.col("z.fit.slope") * _odds(share, n, F.log)))
    return each.where(share > 0).select("doc_id", F.col("z.fit.subject").alias("subject"), "n_sentences", share.alias("share"), posterior.alias("posterior"))


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject): the subjects with a posterior of one half or more, each once."""
    return subject_posteriors(documents, labels, subjects).where("posterior >= 0.5").select("doc_id", "subject").distinct()
