"""One consistent form for text that looks the same.

Most text is already in that form.  A quick check, compiled from the Unicode
properties into one pattern that runs in the JVM, finds the texts with a segment
that may change; only those reach Python, where such segments are normalised with
the character before them as context and spliced into the unchanged rest.
"""

from __future__ import annotations

import functools
import re
import unicodedata as ud

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that show nothing: marks of direction and of breaks, joiners, fillers.
IGNORED = "\u115f\u1160\u3164\uffa0\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
# White space of all kinds, each a gap between words.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters of other scripts drawn like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "µ": "μ", "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "հ": "h",
    "‐": "-", "‑": "-", "․": ".", "‥": "..", "…": "...",
    "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
}
# Devanagari sequences drawn like one letter or sign.
SEQUENCES = {
    "अॅ": "ॲ", "अा": "आ", "अॉ": "ऑ", "अॊ": "ऒ", "अो": "ओ", "अौ": "औ",
    "आॅ": "ऑ", "आॆ": "ऒ", "आे": "ओ", "आै": "औ",
    "एॅ": "ऍ", "एॆ": "ऎ", "एे": "ऐ",
    "ाॅ": "ॉ", "ाॆ": "ॊ", "ाे": "ो", "ाै": "ौ",
}
#: Characters that shape what they follow or join, and show nothing elsewhere: joiners, emoji style, flag letters.
_JOINERS, _STYLES, _FLAGS = "\u200c\u200d", "\ufe0e\ufe0f", "\U000e0020-\U000e007f"
#: Devanagari: the signs that may end such a sequence.
_SIGNS = "ाॅ-ौ"


def _class(points: list[int] | set[int]) -> str:
    """The inside of a character class, in the notation of Java."""
    out, points = [], sorted(points)
    i = 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@functools.cache
def tables() -> dict:
    """What the Unicode properties say: ``fold`` maps a character to the text that looks the same, ``check`` is the pattern of the quick check."""
    fold: dict[int, str] = {}
    never: set[int] = set()
    marks: set[int] = set()
    composed: set[int] = set()
    before: dict[int, set[int]] = {}
    for p in [*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
        c = chr(p)
        if ud.combining(c):
            marks.add(p)
        d = ud.decomposition(c)
        if not d:
            continue
        kind, _, rest = d.rpartition(">")
        parts = [int(x, 16) for x in rest.split()]
        if not kind:
            if ud.normalize("NFC", c) != c:
                never.add(p)
            else:
                composed.add(p)
                if len(parts) == 2:
                    before.setdefault(parts[1], set()).add(parts[0])
        elif (
            kind in ("<wide", "<narrow")
            or kind in ("<initial", "<medial", "<final", "<isolated") and not {0x20, 0x640} & set(parts)
            or kind == "<compat" and (0xFB00 <= p <= 0xFB17 or 0x2160 <= p <= 0x217F or 0x2E80 <= p < 0x2FE0)
        ):
            fold[p] = "".join(map(chr, parts))
    fold = {p: x for p, x in fold.items() if chr(p) not in IGNORED} | {ord(a): b for a, b in LOOKALIKES.items()}
    for base, like in LOOKALIKES.items():  # an accented look-alike
        for p in composed:
            if ud.normalize("NFD", chr(p))[0] == base:
                never.add(p)
    plain = {p for p in marks if ud.combining(chr(p)) not in (7, 9)}
    high, low = ({p for p in marks if ud.combining(chr(p)) == k} for k in (9, 7))
    single = never | set(fold) | set(map(ord, IGNORED + SPACES + _STYLES)) | set(range(0xE0020, 0xE0080))
    pairs = [rf"[{_class(a)}]\x{{{b:x}}}" for b, a in sorted(before.items())]
    pairs += [rf"[\x{{1100}}-\x{{1112}}][\x{{1161}}-\x{{1175}}]|[\x{{ac00}}-\x{{d7a3}}][\x{{11a8}}-\x{{11c2}}]"]
    pairs += [rf"[{_class(composed)}][{_class(plain)}]", rf"[{_class(plain)}][{_class(marks)}]", rf"[{_class(marks)}][{_class(plain)}]", rf"[{_class(high)}][{_class(low)}]"]
    pairs += ["|".join(f"\\x{{{ord(a[0]):x}}}\\x{{{ord(a[1]):x}}}" for a in SEQUENCES)]
    check = rf"[{_class(single)}]|  |^ | $|(?:[{_class(set(before) | plain | high | set(range(0x93E, 0x94D)))}\x{{11a8}}-\x{{11c2}}\x{{1161}}-\x{{1175}}](?<={'|'.join(f'(?:{x})' for x in pairs)}))"
    drop = dict.fromkeys(ord(c) for c in IGNORED if c not in _JOINERS)
    gaps = dict.fromkeys(map(ord, SPACES), " ")
    python = "".join(f"{chr(p)}" if chr(p) not in "\\]^-" else "\\" + chr(p) for p in sorted(never | set(fold) | marks | set(before)))
    return {"fold": fold, "check": check, "first": drop | gaps, "segment": re.compile(f".?[{python}{_SIGNS}ᅡ-ᅵᆨ-ᇂ]+", re.S)}


#: The quick check's first step: ASCII and Devanagari without any sequence that may change.  All but such texts take the full check.
_PLAIN = rf"[^ -~\x{{900}}-\x{{950}}\x{{955}}-\x{{957}}\x{{960}}-\x{{97f}}]|  |^ | $|[{''.join(sorted({x[0] for x in SEQUENCES}))}][{_SIGNS}]|[\x{{928}}\x{{930}}\x{{933}}]\x{{93c}}|\x{{94d}}\x{{93c}}"

_SHAPING = re.compile(f"[{_JOINERS}{_STYLES}{_FLAGS}]+")
_SEQUENCE = re.compile("|".join(SEQUENCES))


def _seen(before: str, c: str) -> bool:
    """Whether a shaping character can be seen after this one: it shapes a conjunct, an emoji or a flag."""
    symbol = ud.category(before) in ("So", "Sk", "Sm") or before in "0123456789#*\u203c\u2049"
    if c in _STYLES:
        return symbol
    if c in _JOINERS:
        return ud.combining(before) == 9 or before == "\ufe0f" or symbol and before not in "0123456789#*"
    return before == "\U0001f3f4" or "\U000e0020" <= before <= "\U000e007f"


def _shaped(found: re.Match) -> str:
    """The shaping characters of a run that can be seen, each judged by what is left before it."""
    kept, before = "", found.string[found.start() - 1] if found.start() else ""
    for c in found[0]:
        if before and _seen(before, c):
            kept += c
            before = c
    return kept


@functools.lru_cache(1 << 16)
def _segment(text: str) -> str:
    fold = tables()["fold"]
    out = ud.normalize("NFD", text.translate(fold)).translate(fold)
    out = ud.normalize("NFC", out)
    while (new := _SEQUENCE.sub(lambda m: SEQUENCES[m[0]], out)) != out:
        out = new
    return out


def canonical(text: str | None) -> str | None:
    """The consistent form of one text; null stays null, a text of blanks becomes empty."""
    if text is None:
        return None
    t = tables()
    settled = lambda x: " ".join(w for w in t["segment"].sub(lambda m: _segment(m[0]), x).split(" ") if w)
    text = settled(text.translate(t["first"]))
    while _SHAPING.search(text):
        shaped = _SHAPING.sub(_shaped, text)
        if shaped == text:
            break
        text = settled(shaped)
    return text


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore").astype(object).where(texts.notna(), None)


def canonical_form(text: Column) -> Column:
    """The consistent form of ``text``: texts that look the same become equal, others stay different.

    Composed and decomposed letters, full-width and half-width forms, ligatures,
    look-alike letters of other scripts, Devanagari sequences drawn like one letter,
    invisible characters and kinds and numbers of blanks don't count; case, accents,
    vowel signs, raised and circled digits and punctuation do.  Idempotent; null
    stays null, and a text of blanks or invisible characters becomes empty.
    """
    unstable = F.when(text.rlike(_PLAIN), F.when(text.rlike(tables()["check"]), text))
    return F.coalesce(_canonical(unstable), text)


def same_reading(left: DataFrame, right: DataFrame, key: str, left_text: str, right_text: str) -> DataFrame:
    """Each ``key`` for which a text of ``left`` and one of ``right`` differ but look the same.

    Both sides are reduced to the hashes of their texts by key and consistent form and
    never joined: a group holds two differing texts unless all of it is one text.
    Null keys and null texts belong to no case.
    """
    both = left.select(F.col(key), F.col(left_text).alias("_t"), F.lit(0).alias("_side")).unionByName(right.select(F.col(key), F.col(right_text).alias("_t"), F.lit(1).alias("_side")))
    raw = lambda side: F.when(F.col("_side") == side, F.col("_raw"))
    return (
        both.where(F.col(key).isNotNull() & F.col("_t").isNotNull())
        .select(key, "_side", F.xxhash64("_t").alias("_raw"), F.xxhash64(canonical_form(F.col("_t"))).alias("_form"))
        .groupBy(key, "_form")
        .agg(F.min(raw(0)).alias("a"), F.max(raw(0)).alias("b"), F.min(raw(1)).alias("c"), F.max(raw(1)).alias("d"))
        .where("a IS NOT NULL AND c IS NOT NULL AND NOT (a = b AND c = d AND a = c)")
        .select(key)
        .distinct()
    )
