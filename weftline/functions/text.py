"""Scalar functions on text and ids, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that count as fillers in the rules.
FILLERS = ["uh", "um", "hmm", "haan", "अ", "अं", "आं", "उह", "हम्म", "हाँ", "अच्छा"]
# Fixed value: fillers counted in a comparison of engines.
FILLER_PATTERN = r"उह+|हम्+म?|अं+|अच्छा|मतलब|यानी|हाँ|\b(?:uh+|um+|hmm+|haan|like)\b"
#: The same with the ends of a word as ASCII has them, as other scripts may adjoin.
_FILLER = "(?i)" + FILLER_PATTERN.replace(r"\b(", r"(?<![A-Za-z0-9_])(").replace(r"\b", r"(?![A-Za-z0-9_])")
# Fixed value: addresses that carry a video id of 11 characters.
VIDEO_URL = r"(?:youtube\.com/(?:watch\?(?:.*&)?v=|shorts/|live/|embed/)|youtu\.be/)([A-Za-z0-9_-]{11})"


def half_up(x: Column, places: int) -> Column:
    """x rounded to ``places`` decimals by floor(x * 10^places + 0.5), alike in every engine."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def tokens(text: Column) -> Column:
    """Tokens parted by white space of any kind; null for null."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def norm_token(token: Column) -> Column:
    """Lower case, word characters and Devanagari only."""
    return F.regexp_replace(F.lower(token), r"(?U)[^\w\x{900}-\x{97F}]", "")


def is_filler(token: Column) -> Column:
    return norm_token(token).isin(FILLERS)


def filler_count(text: Column) -> Column:
    """Matches of the comparison's filler pattern, whatever their case; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_FILLER)), F.lit(0))


# Devanagari letters and signs in Latin letters.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलळवशषसह", "k kh g gh ng c ch j jh ny t th d dh n t th d dh n p ph b bh m y r l l v sh sh s h".split()))
DOTTED = {"क": "q", "ख": "kh", "ग": "g", "ज": "z", "ड": "r", "ढ": "rh", "फ": "f", "य": "y"}
VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍऎऒॲ", "a aa i ii u uu ri e ai o au o e e o a".split()))
SIGNS = dict(zip("ािीुूृेैोौॉॅॆॊंँः", "aa i ii u uu ri e ai o au o e e o n n h".split()))

def romanized(text: Column) -> Column:
    """``text`` with Devanagari in Latin letters: consonants keep their vowel a unless a sign or a virama follows.  Other scripts stay."""
    dot, vowel = "\u093c", "\u0905"
    out = text
    for k, letter in enumerate(DOTTED):
        out = F.replace(out, F.lit(chr(0x958 + k)), F.lit(letter + dot))
    out = F.regexp_replace(out, f"([{''.join(CONSONANTS)}]{dot}?)(?![{dot}\u093e-\u094d\u0962\u0963])", f"$1{vowel}")
    for letter, latin in ({k + dot: v for k, v in DOTTED.items()} | CONSONANTS | VOWELS | SIGNS).items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return F.regexp_replace(out, f"[{dot}\u094d]", "")


def alignable(token: Column) -> Column:
    """The ASCII letters and apostrophes of a romanised token; empty means that it can't be aligned."""
    plain = F.when(token.rlike(r"[\x{900}-\x{97F}]"), romanized(token)).otherwise(token)
    return F.regexp_replace(F.lower(plain), "[^a-z']", "")


def script_profile(text: Column) -> Column:
    """struct(chars, deva_frac, latin_frac, script_switches) of a text.

    White space and punctuation (of any script, the danda as well) aren't counted;
    switches are counted between Devanagari and ASCII letters only.  Null and empty
    texts give zeros.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\p{P}]", "")
    chars = F.length(bare)
    deva = F.length(F.regexp_replace(bare, r"[^\x{900}-\x{97F}]", ""))
    latin = F.length(F.regexp_replace(bare, "[^A-Za-z]", ""))
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[^\x{900}-\x{97F}A-Za-z]", ""), r"[\x{900}-\x{97F}]+", "1"), "[A-Za-z]+", "2")
    share = lambda n: F.when(chars > 0, half_up(n / chars, 4)).otherwise(F.lit(0.0))
    return F.struct(
        chars.alias("chars"), share(deva).alias("deva_frac"), share(latin).alias("latin_frac"), F.greatest(F.length(runs) - 1, F.lit(0)).alias("script_switches")
    )


def slug(name: Column) -> Column:
    """Lower case with every run of other characters than a-z and 0-9 as one underscore."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")


def job_id(stem: Column, content: Column, ascii_only: bool = False) -> Column:
    """up_{stem of at most 40 characters}_{6 digits of the content's SHA-256}.

    The command line keeps every letter and digit and replaces others one by one; the
    server keeps ASCII only and replaces runs.
    """
    clean = F.regexp_replace(stem, "[^A-Za-z0-9_-]+", "_") if ascii_only else F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_")
    return F.concat(F.lit("up_"), F.substring(clean, 1, 40), F.lit("_"), F.substring(F.sha2(content, 256), 1, 6))


def video_id(url: Column) -> Column:
    """The id inside a video address, or null."""
    found = F.regexp_extract(url, VIDEO_URL, 1)
    return F.when(found != "", found)


def split_of(video: Column, share: float = 0.05) -> Column:
    """'val' for a share of the ids, by the first 8 hex digits of their SHA-256, else 'train'."""
    h = F.conv(F.substring(F.sha2(video, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.when(h < share, "val").otherwise("train")


def clock(seconds: Column) -> Column:
    """m:ss.s"""
    tenths = F.floor((seconds - F.floor(seconds / 60) * 60) * 10 + 0.5)
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(tenths / 10).cast("string"), 2, "0"), F.lit("."), (tenths % 10).cast("string"))


def lane_label(name: Column) -> Column:
    """A readable label of an audio lane."""
    numbered = F.regexp_extract(name, r"^sam_speaker_(\d+)_clean(?:_\w+)?$", 1)
    named = F.regexp_extract(name, r"^sam_(.+)_clean(?:_\w+)?$", 1)
    return (
        F.when(name == "original", "Original sound")
        .when(name == "denoised", "Denoised (demucs)")
        .when(numbered != "", F.concat(F.lit("Clean S"), numbered))
        .when(named != "", F.concat(F.lit("Clean "), F.replace(named, F.lit("_"), F.lit(" "))))
        .when(name.startswith("SPEAKER_"), F.replace(name, F.lit("SPEAKER_"), F.lit("S")))
        .otherwise(name)
    )


def lane_owner(name: Column) -> Column:
    """The speaker that an audio lane belongs to, or null."""
    numbered = F.upper(F.regexp_extract(name, r"(?i)^(?:sam_)?(speaker_\d+)", 1))
    return F.when(numbered != "", numbered).when(name.startswith("SPEAKER_"), name)


def clean_owner(name: Column) -> Column:
    """The speaker whose clean lane this is, or null."""
    found = F.upper(F.regexp_extract(name, r"^sam_(speaker_\d+)_clean", 1))
    return F.when(found != "", found)
