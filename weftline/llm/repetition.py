"""Repetition inside a single document.

A text is a sequence of words (letters, marks and digits; case, punctuation and
spacing don't count).  A suffix array over the words of many texts at once, in
which no suffix reaches beyond its text, has equal passages side by side; its
longest-common-prefix intervals are the maximal repeated passages.  The spans of
all occurrences but the first are united.  Repetition within words is found in the
same way over their letters.
"""

from __future__ import annotations

import unicodedata as ud

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A passage of several words.
PASSAGE_WORDS = 3
#: Letters of a script that is written without spaces, that count as much as a word.
LETTERS_A_WORD = 3

#: Words of whole texts sorted together in a worker; a longer text is sorted alone.
BLOCK_WORDS = 1 << 18

# Scripts written without spaces, whose letters are taken one by one: Thai, Lao, Tibetan, Burmese, Khmer, Kana, Han.
_SPACELESS = r"\x{e00}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"
_WORD = r"[\p{L}\p{M}\p{N}]+"
_PART = rf"[\p{{L}}&&[{_SPACELESS}]]\p{{M}}*|[\p{{L}}\p{{M}}\p{{N}}&&[^{_SPACELESS}]]+"
#: A short unit three times in a row within a word; longer units need longer words than LONG_WORD.
_RUN, LONG_WORD = r"([\p{L}\p{M}]{1,24}?)\1\1", 72


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\p{M}+", ""))


def plain(text: Column) -> Column:
    """Lower case without invisible characters, which don't part words."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Cf}+", ""))


def words_of(plain_text: Column, spaceless: Column) -> Column:
    """Array of words, in ``spaceless`` texts of letters of scripts without spaces and of other words."""
    found = lambda pattern: F.regexp_extract_all(plain_text, F.lit(pattern), F.lit(0))
    return F.when(spaceless, found(_PART)).otherwise(found(_WORD))


def common(levels: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b have in common; ``levels`` ranks the passages of 1, 2, 4... words."""
    n, got = len(end), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        same = (x < end[a]) & (y < end[b]) & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        got += same * (1 << k)
    return got


def suffix_array(word: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its LCP (in words) with the suffix before, and the ranks of passages of 1, 2, 4... words, for texts laid end to end.

    ``doc`` is the number of each position's text, ``end`` the position after that
    text.  Suffixes of different texts never tie: texts come one after another, and
    the LCP between them is 0.  Prefixes double in length, and only suffixes that
    still tie are sorted again.
    """
    n = len(word)
    order = np.lexsort((word, doc))
    w, d = word[order], doc[order]
    new = np.ones(n, bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, h = [rank.copy()], 1
    tied = np.flatnonzero(~new | np.append(~new[1:], False))
    while len(tied):
        at = order[tied]
        far = at + h
        second = np.where(far < end[at], rank[np.minimum(far, n - 1)] + 1, 0)
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        m = len(at)
        group = np.ones(m, bool)
        group[1:] = first[1:] != first[:-1]
        begin = np.maximum.accumulate(np.where(group, np.arange(m), 0))
        order[first + np.arange(m) - begin] = at
        split = group.copy()
        split[1:] |= second[1:] != second[:-1]
        sub = np.maximum.accumulate(np.where(split, np.arange(m), 0))
        rank[at] = first + sub - begin
        levels.append(rank.copy())
        h *= 2
        still = ~split | np.append(~split[1:], False)
        tied = np.sort(rank[at[still]])
        tied = tied + np.arange(len(tied)) - np.maximum.accumulate(np.where(np.append(True, tied[1:] != tied[:-1]), np.arange(len(tied)), 0)) if len(tied) else tied
    lcp = np.zeros(n, np.int64)
    pairs = np.flatnonzero(~new)
    lcp[pairs] = common(levels, end, order[pairs - 1], order[pairs])
    return order, lcp, levels


def repeated_words(word: np.ndarray, doc: np.ndarray, end: np.ndarray, passage: int = PASSAGE_WORDS, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word stands in a passage that stood earlier in its text, and the LCP at each position (of its place in the suffix array).

    An LCP interval of at least ``passage`` words (by ``weight``, 1 each) holds all
    occurrences of a repeated passage.  All but the first are later ones; a longer
    passage gives such an interval at each of its words but the last ones, so that
    spans of ``passage`` words from all later occurrences have the same union as the
    maximal spans.  A word that follows itself and a pair that follows itself count
    too; letters that stand for parts of words, which weigh less than 1, count three
    in a row.
    """
    n = len(word)
    order, lcp, _ = suffix_array(word, doc, end)
    if weight is None:
        far, stop = lcp >= passage, np.minimum(np.arange(n) + passage, n)
    else:
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        far = upto[order + lcp] - upto[order] >= passage - 1e-6
        stop = np.minimum(np.searchsorted(upto, upto[:-1] + passage - 1e-6), n)
    begins = np.flatnonzero(~far)
    sizes = np.diff(np.append(begins, n))
    earliest = np.repeat(np.minimum.reduceat(order, begins), sizes)
    later = order[order != earliest]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, later, 1)
    np.add.at(edge, stop[later], -1)
    covered = np.cumsum(edge[:-1]) > 0
    same = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    whole = np.ones(n, bool) if weight is None else weight > 1 - 1e-6
    covered[1:] |= same & whole[1:]
    triple = same[1:] & same[:-1]
    covered[1:-1] |= triple
    covered[2:] |= triple
    if n > 3:
        pair = (word[2:-1] == word[:-3]) & (word[3:] == word[1:-2]) & (doc[3:] == doc[:-3])
        covered[2:-1] |= pair
        covered[3:] |= pair
    longest = np.zeros(n, np.int64)
    longest[order] = lcp
    return covered, longest


def runs(letter: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each letter stands in a unit of any length that follows itself at least twice, in other than its first place.

    A unit of p letters three times in a row has at least 2p letters in common with
    itself p letters on.  Such a neighbour is the next equal passage of 2**k letters,
    for the k with p <= 2**k <= 2p.
    """
    n = len(letter)
    _, _, levels = suffix_array(letter, doc, end)
    edge = np.zeros(n + 1, np.int64)
    for k, rank in enumerate(levels):
        fits = np.flatnonzero(np.arange(n) + (1 << k) <= end)
        by = fits[np.lexsort((fits, rank[fits]))]
        gap = np.diff(by)
        near = (rank[by[1:]] == rank[by[:-1]]) & (gap <= 1 << k) & (2 * gap >= 1 << k)
        a, p = by[:-1][near], gap[near]
        shared = common(levels, end, a, a + p)
        long = shared >= 2 * p
        np.add.at(edge, (a + p)[long], 1)
        np.add.at(edge, (a + p + shared)[long], -1)
    return np.cumsum(edge[:-1]) > 0


def run_letters(words: list[str | None]) -> np.ndarray:
    """Of each word the letters that runs() finds, without marks; digits repeat nothing, and null is 0."""
    size = np.array([len(w or "") for w in words], np.int64)
    found = np.zeros(len(words), np.int64)
    if not size.sum():
        return found
    text = "".join(w or "" for w in words)
    kind = [ud.category(c)[0] for c in text]
    digit, mark = np.array([k == "N" for k in kind]), np.array([k == "M" for k in kind])
    letter = np.where(digit, -1 - np.arange(len(text)), np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64))
    doc = np.repeat(np.arange(len(words)), size)
    hit = runs(letter, doc, np.repeat(np.cumsum(size), size)) & ~mark
    return np.bincount(doc[hit], minlength=len(words))


def _measure(words: pa.Array, letters: pa.Array, spaceless: pa.Array, suspects: pa.Array) -> pa.Array:
    words, letters, spaceless, suspects = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (words, letters, spaceless, suspects))
    size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().to_numpy(zero_copy_only=False)
    chars = letters.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    part = np.zeros(len(flat), bool)
    inner = np.zeros(len(flat), np.int64)
    for row in np.flatnonzero(spaceless.is_valid().to_numpy(zero_copy_only=False)):
        part[at[row] : at[row + 1]] = spaceless[int(row)].as_py()
    for row in np.flatnonzero(suspects.is_valid().to_numpy(zero_copy_only=False)):
        inner[at[row] : at[row + 1]] = run_letters(suspects[int(row)].as_py())
    share, longest = np.zeros(len(size)), np.zeros(len(size), np.int32)
    row = 0
    while row < len(size):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK_WORDS, "right")) - 1)
        lo, hi = at[row], at[stop]
        some = np.flatnonzero(size[row:stop] > 0)
        if hi > lo:
            sizes = size[row:stop]
            doc = np.repeat(np.arange(stop - row), sizes)
            end = np.repeat(at[row + 1 : stop + 1] - lo, sizes)
            weight = np.where(part[lo:hi], 1 / LETTERS_A_WORD, 1.0) if part[lo:hi].any() else None
            covered, lcp = repeated_words(flat[lo:hi], doc, end, weight=weight)
            c = chars[lo:hi]
            begins = (at[row:stop] - lo)[some]
            got = np.add.reduceat(np.where(covered, c, inner[lo:hi]), begins)
            share[row + some] = got / np.maximum(1, np.add.reduceat(c, begins))
            longest[row + some] = np.maximum.reduceat(lcp, begins)
        row = stop
    return pa.StructArray.from_arrays([pa.array(share), pa.array(longest)], ["share", "longest"])


def repetition(rows: DataFrame, text: str = "text", share: str = "repeated_share", longest: str = "longest_repeat") -> DataFrame:
    """``rows`` with the share of letters and digits that stand in repeated passages, and the length in words of the longest repeated passage.

    A passage of PASSAGE_WORDS words or more counts wherever it stood before; a
    single word or a pair only if it follows itself directly; a unit within a word,
    of any length but without digits, only if it stands three times in a row.  In scripts
    written without spaces each letter is taken for a third of a word.  Null, empty and
    wordless texts have the share 0 and the length 0.  Texts of any length are
    measured whole.  Rows keep their order, number and columns; columns named like
    the results are replaced.
    """
    measure = F.arrow_udf(_measure, "struct<share: double, longest: int>")
    t = F.col("__weft_t")
    return (
        rows.drop(share, longest)
        .withColumn("__weft_t", plain(F.col(text)))
        .withColumn("__weft_odd", t.rlike(f"[{_SPACELESS}]"))
        .withColumn("__weft_w", words_of(t, F.col("__weft_odd")))
        .withColumn("__weft_parts", F.when(F.col("__weft_odd"), F.transform("__weft_w", lambda x: x.rlike(f"^[{_SPACELESS}]"))))
        .withColumn("__weft_runs", F.when(t.rlike(_RUN) | F.exists("__weft_w", lambda x: F.length(x) > LONG_WORD), F.transform("__weft_w", lambda x: F.when((F.length(x) > LONG_WORD) | x.rlike(_RUN), x))))
        .withColumn("__weft_m", measure(F.transform("__weft_w", lambda x: F.xxhash64(x)), F.transform("__weft_w", _letters), "__weft_parts", "__weft_runs"))
        .withColumns({share: F.col("__weft_m.share"), longest: F.col("__weft_m.longest")})
        .drop("__weft_t", "__weft_odd", "__weft_w", "__weft_parts", "__weft_runs", "__weft_m")
    )


def repetitive_texts(transcripts: DataFrame, lane_transcripts: DataFrame, least: float = 0.4, longest: int | None = None) -> DataFrame:
    """(tbl, video_id, rec_id) of the texts whose repeated share is ``least`` or more, or whose longest repeat has ``longest`` words or more, each once."""
    one = transcripts.select(F.lit("transcripts").alias("tbl"), "video_id", F.col("seg_id").alias("rec_id"), "text")
    two = lane_transcripts.select(F.lit("lane_transcripts").alias("tbl"), "video_id", F.col("chunk_id").alias("rec_id"), "text")
    over = F.col("repeated_share") >= least
    return repetition(one.unionByName(two)).where(over if longest is None else over | (F.col("longest_repeat") >= longest)).select("tbl", "video_id", "rec_id").distinct()
