import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from weftline.llm import canon

SAME = [
    ("ｔｕｎｅ the strings", "tune the strings"),
    ("abοut", "about"),
    ("hаin aur mashhоor", "hain aur mashhoor"),
    ("é", "é"),
    ("क़लम", "क़लम"),
    ("अाप बोलिए", "आप बोलिए"),
    ("zero​width­ and⁠ marks‎﻿", "zerowidth and marks"),
    ("no break  gap", "no break gap"),
    ("ﬁrst oﬃce ﬂag", "first office flag"),
    ("300 K", "300 K"),
    ("Å Ω", "Å Ω"),
    ("a\nb\r\nc", "a b c"),
    ("ё", "ё"),
    ("ё", "ë"),
    ("q̣̇", "q̣̇"),
    ("각", "각"),
]
SAME += [("\u2f00", "\u4e00"), ("\ufe8d", "\u0627"), ("\u13aa", "A"), ("\ua4d0", "B"), ("\u2c9e", "O"), ("n\u1d0f", "no"), ("a\ufe0f", "a"), ("a\u3164b", "ab"), ("a\U000e0067", "a"), ("a\u200d", "a"), ("a\ue0f0\u200b", "a\ue0f0")]
DIFFERENT = [("a\ue0f0b", "ab"), ("a\ue0f0\u200bb", "a\u200bb"), ("\u2764", "\u2764\ufe0f"), ("\U0001f3f4", "\U0001f3f4\U000e0067\U000e007f"), ("\U0001f469\u200d\U0001f4bb", "\U0001f469\U0001f4bb"), ("a", "A"), ("e", "é"), ("2", "²"), ("3", "③"), ("कि", "की"), ("a b", "ab"), ("a.", "a"), ("one two", "two one"), ("!", "!!"), ("ज", "ज़"), ("क्‍ष", "क्ष")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_reading(a, b):
    assert canon.canonical(a) == canon.canonical(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_other_reading(a, b):
    assert canon.canonical(a) != canon.canonical(b)


def samples():
    rng = random.Random(8)
    pool = [chr(c) for c in (*range(0x20, 0x7F), *range(0xC0, 0x250), *range(0x300, 0x370), *range(0x391, 0x3CA), *range(0x400, 0x460), *range(0x900, 0x980), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), 0x2126, 0x212A, 0x1F469, 0x1F4BB, 0x1F3F4, 0xE0067, 0xE007F, 0xFE0E, 0xFE0F, *range(0xE0E8, 0xE0F8), 0xE000, 0xF8FF, *range(0x2F00, 0x2F10), *range(0xFE80, 0xFEA0), 0x3164, 0x13AA, 0xA4D0, 0x2C9E)]
    weighted = [*pool, *(list(canon.IGNORED + canon.SPACES) + [a for a in canon.SEQUENCES for _ in (0,)]) * 3]
    return ["".join(rng.choice(weighted) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]


def test_splicing_equals_normalising_the_whole_text():
    """Segments with their context give what whole-text normalisation gives."""

    def whole(text):
        text = "".join(c for i, c in enumerate(text) if c not in canon.IGNORED)
        text = text.translate(dict.fromkeys(map(ord, canon.SPACES), " "))
        out = canon._segment.__wrapped__(text)
        return " ".join(x for x in out.split(" ") if x)

    for s in samples():
        if canon._SHAPING.search(s):
            continue
        assert canon.canonical(s) == whole(s), [hex(ord(c)) for c in s]


def test_idempotent_and_composed():
    for s in samples():
        once = canon.canonical(s)
        assert canon.canonical(once) == once, [hex(ord(c)) for c in s]
        assert unicodedata.is_normalized("NFC", once)


def test_quick_check_misses_nothing(spark):
    rows = [(i, s) for i, s in enumerate(samples())]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {r.i: (r.f, r.p, r.c) for r in df.select("i", canon.canonical_form(F.col("s")).alias("f"), F.col("s").rlike(canon._PLAIN).alias("p"), F.col("s").rlike(canon.tables()["check"]).alias("c")).collect()}
    for i, s in rows:
        form, plain, check = got[i]
        assert form == canon.canonical(s), [hex(ord(c)) for c in s]
        assert plain or not check


def test_null_blank_long_and_empty(spark):
    long = "हैं ज़्यादा " * 20_000 + "abοut"
    df = spark.createDataFrame([(None,), ("",), ("  ​ ",), (long,)], "s string")
    got = [r[0] for r in df.select(canon.canonical_form(F.col("s"))).collect()]
    assert got[:3] == [None, "", ""] and got[3] == long[:-5] + "about"
    assert df.limit(0).select(canon.canonical_form(F.col("s"))).count() == 0


def test_same_reading_pairs(spark):
    left = spark.createDataFrame([("k1", "abοut"), ("k1", "abοut"), ("k2", "x"), ("k3", "a"), (None, "q"), ("k4", None), ("k5", "ab"), ("k6", "p"), ("k6", "ｐ")], "seg_id string, text string")
    right = spark.createDataFrame([("k1", "about"), ("k2", "x"), ("k3", "A"), (None, "ｑ"), ("k4", ""), ("k6", "p"), ("k7", "z")], "seg_id string, text_plain string")
    got = sorted(r[0] for r in canon.same_reading(left, right, "seg_id", "text", "text_plain").collect())
    assert got == ["k1", "k6"]


def test_joiners_are_judged_by_what_is_left_before_them():
    """Canonically equivalent texts, and those that differ by invisible characters, are treated alike."""
    assert canon.canonical("\u0915\u094d\u093c\u200d\u0937") == canon.canonical("\u0915\u093c\u094d\u200d\u0937")
    assert canon.canonical("\u0915\u094d\u200b\u200d\u0937") == canon.canonical("\u0915\u094d\u200d\u0937") != canon.canonical("\u0915\u094d\u0937")
    assert canon.canonical("a\u200d\u0301") == "\u00e1"
