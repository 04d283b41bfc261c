"""Views that bring the test tables into the shapes that the operators work on, in Spark and in SQL.

Times are integer ms.  The tables hold no word timings, so words get them from
integer rules on the texts, alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import tokens
from weftline.operators.detectors import LAUGHS, REACTIONS
from weftline.operators.periods import to_ms, valid_intervals
from weftline.operators.rows import latest
from weftline.runtime import table

#: The sound classes that the detectors look for.
SOUNDS = [c for tags in (LAUGHS, REACTIONS) for names in tags.values() for c in names]
SPEAKER = r"_(SPEAKER_[0-9]+)_[0-9]+$"


def turns(spark: SparkSession, directory: str, column: str = "turns") -> DataFrame:
    """(video_id, speaker, s, e): valid diarized turns, each once."""
    rows = table(spark, directory, "speakers").where("trim(speaker) <> ''").select("video_id", "speaker", F.explode(column).alias("x"))
    return valid_intervals(rows, ["video_id", "speaker"], F.col("x.start"), F.col("x.end")).distinct()


def clips(spark: SparkSession, directory: str) -> DataFrame:
    """Segments as written last, with s and e in ms (null if unknown)."""
    rows = latest(table(spark, directory, "segments"), ["seg_id"], ties=("start", "end", "speaker", "purity", "source"))
    return rows.select("seg_id", "video_id", "speaker", to_ms(F.col("start")).alias("s"), to_ms(F.col("end")).alias("e"), "wav", "source", "separated", "separated_frac", "purity", "purity_pass")


def spans(spark: SparkSession, directory: str) -> DataFrame:
    """Clips with a speaker and a positive length: (seg_id, video_id, speaker, s, e)."""
    return clips(spark, directory).where("speaker IS NOT NULL AND e > s").select("seg_id", "video_id", "speaker", "s", "e")


def texts(spark: SparkSession, directory: str) -> DataFrame:
    return latest(table(spark, directory, "transcripts"), ["seg_id"], ties=("text", "asr")).select("seg_id", "video_id", "text", "asr", "script")


def samples(spark: SparkSession, directory: str) -> DataFrame:
    """Dataset rows as written last."""
    return latest(table(spark, directory, "dataset"), ["sample_id"], ties=("video_id", "speaker", "text", "dur", "align_status"))


def words(spark: SparkSession, directory: str) -> DataFrame:
    """(seg_id, i, w, s, e) of every token of the texts."""
    toks = texts(spark, directory).select("seg_id", F.posexplode(tokens(F.col("text"))).alias("i", "w"))
    n = F.length("w")
    gap = F.when((F.col("i") * 131 + n * 17) % 7 == 0, (F.col("i") * 97 + n * 13) % 1900).otherwise(50)
    upto = Window.partitionBy("seg_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        toks.withColumns({"_g": gap.cast("long"), "_d": (40 + 60 * n).cast("long")})
        .withColumn("e", F.sum(F.col("_g") + F.col("_d")).over(upto))
        .select("seg_id", "i", "w", (F.col("e") - F.col("_d")).alias("s"), "e")
    )


def islands(spark: SparkSession, directory: str) -> DataFrame:
    """(seg_id, s, e): some longer gaps between words, 50 ms shorter at both ends."""
    w = words(spark, directory)
    after = F.lead("s").over(Window.partitionBy("seg_id").orderBy("i"))
    return w.withColumn("_n", after).where((F.col("_n") - F.col("e") >= 300) & ((F.col("i") + F.length("w")) % 5 == 0)).select("seg_id", (F.col("e") + 50).alias("s"), (F.col("_n") - 50).alias("e"))


def candidates(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates as written last: (cand_id, seg_id, video_id, tag, score, detector, position_ms, evidence)."""
    rows = latest(table(spark, directory, "candidates"), ["cand_id"], ties=("detector", "tag", "score", "position_s", "evidence"))
    score = F.when((F.col("score") >= 0) & (F.col("score") <= 1) & ~F.isnan("score"), F.col("score"))
    tag = F.lower(F.regexp_replace("tag", r"^[\s\[\]]+|[\s\[\]]+$", ""))
    return rows.select("cand_id", "seg_id", "video_id", tag.alias("tag"), score.alias("score"), F.lower(F.trim("detector")).alias("detector"), to_ms(F.col("position_s")).alias("position_ms"), "evidence")


def features(spark: SparkSession, directory: str) -> DataFrame:
    """Stand-ins for measured features of clips, from integer rules on their bounds: speaker, f0_mean, f0_std, voiced, rms, arousal, valence."""
    s = spans(spark, directory)
    n = F.col("e") - F.col("s")
    part = lambda x, m: (x % m).cast("double") / F.lit(float(m))
    return s.select(
        "seg_id", "video_id", "speaker",
        (80 + part(n * 7, 97) * 200).alias("f0_mean"), F.when(n % 11 > 0, part(n * 13 + F.col("s"), 89) * 5).alias("f0_std"),
        part(F.col("s") * 3 + n, 101).alias("voiced"), part(F.col("s"), 103).alias("rms"), part(n + F.col("s") * 5, 83).alias("arousal"), part(n * 3 + F.col("s"), 79).alias("valence"),
    )


def frames(spark: SparkSession, directory: str) -> DataFrame:
    """(seg_id, f, one column per sound class): stand-ins for the scores of a model of sound events, up to 40 frames a clip, from integer rules on its bounds."""
    s = spans(spark, directory)
    n = F.col("e") - F.col("s")
    at = s.select("seg_id", "s", n.alias("n"), F.explode(F.sequence(F.lit(0), F.least(F.lit(39), n / 100).cast("int"))).alias("f"))
    score = lambda j: (((F.col("n") * (7 + 2 * j) + F.col("f") * (13 + 3 * j) + F.col("s")) % 101).cast("double") / 101 * 0.4)
    return at.select("seg_id", "f", *(score(j).alias(c) for j, c in enumerate(SOUNDS)))


def signal(spark: SparkSession, directory: str) -> DataFrame:
    """(clip, i, x): quantities of order lines as samples of one clip per supplier."""
    rows = table(spark, directory, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rows.select(F.col("l_suppkey").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("i"), (F.col("l_quantity") - 25).alias("x"))


WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

SQL = rf"""
turns AS (
  SELECT DISTINCT video_id, speaker, floor(x."start" * 1000 + 0.5)::BIGINT AS s, floor(x."end" * 1000 + 0.5)::BIGINT AS e
  FROM (SELECT video_id, speaker, unnest(turns) AS x FROM speakers WHERE trim(speaker) <> '')
  WHERE floor(x."end" * 1000 + 0.5) > floor(x."start" * 1000 + 0.5)),
exclusive AS (
  SELECT DISTINCT video_id, speaker, floor(x."start" * 1000 + 0.5)::BIGINT AS s, floor(x."end" * 1000 + 0.5)::BIGINT AS e
  FROM (SELECT video_id, speaker, unnest(exclusive_turns) AS x FROM speakers WHERE trim(speaker) <> '')
  WHERE floor(x."end" * 1000 + 0.5) > floor(x."start" * 1000 + 0.5)),
clips AS (
  SELECT seg_id, video_id, speaker, floor("start" * 1000 + 0.5)::BIGINT AS s, floor("end" * 1000 + 0.5)::BIGINT AS e, wav, source, separated, separated_frac, purity, purity_pass
  FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY written_at DESC NULLS LAST, "start" DESC NULLS LAST, "end" DESC NULLS LAST, speaker DESC NULLS LAST, purity DESC NULLS LAST, source DESC NULLS LAST) AS rn
        FROM segments WHERE seg_id IS NOT NULL) WHERE rn = 1),
spans AS (SELECT seg_id, video_id, speaker, s, e FROM clips WHERE speaker IS NOT NULL AND e > s),
texts AS (
  SELECT seg_id, video_id, text, asr, script
  FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY written_at DESC NULLS LAST, text DESC NULLS LAST, asr DESC NULLS LAST) AS rn FROM transcripts WHERE seg_id IS NOT NULL) WHERE rn = 1),
samples AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY written_at DESC NULLS LAST, video_id DESC NULLS LAST, speaker DESC NULLS LAST, text DESC NULLS LAST, dur DESC NULLS LAST, align_status DESC NULLS LAST) AS rn
        FROM dataset WHERE sample_id IS NOT NULL) WHERE rn = 1),
toks AS (
  SELECT seg_id, unnest(range(len(l)))::INTEGER AS i, unnest(l) AS w
  FROM (SELECT seg_id, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS l FROM texts WHERE text IS NOT NULL)),
timed AS (
  SELECT *, CASE WHEN (i * 131 + length(w) * 17) % 7 = 0 THEN (i * 97 + length(w) * 13) % 1900 ELSE 50 END AS g, 40 + 60 * length(w) AS d FROM toks),
words AS (
  SELECT seg_id, i, w, (t - d)::BIGINT AS s, t::BIGINT AS e
  FROM (SELECT *, sum(g + d) OVER (PARTITION BY seg_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS t FROM timed)),
near AS (SELECT *, lead(s) OVER x AS next_s, lead(w) OVER x AS next_w, lag(e) OVER x AS prev_e FROM words WINDOW x AS (PARTITION BY seg_id ORDER BY i)),
islands AS (SELECT seg_id, e + 50 AS s, next_s - 50 AS e FROM near WHERE next_s - e >= 300 AND (i + length(w)) % 5 = 0),
cands AS (
  SELECT cand_id, seg_id, video_id, lower(regexp_replace(tag, '^[\s\[\]]+|[\s\[\]]+$', '', 'g')) AS tag,
         CASE WHEN score >= 0 AND score <= 1 AND NOT isnan(score) THEN score END AS score, lower(trim(detector)) AS detector,
         floor(position_s * 1000 + 0.5)::BIGINT AS position_ms, evidence
  FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY written_at DESC NULLS LAST, detector DESC NULLS LAST, tag DESC NULLS LAST, score DESC NULLS LAST, position_s DESC NULLS LAST, evidence DESC NULLS LAST) AS rn
        FROM candidates WHERE cand_id IS NOT NULL) WHERE rn = 1),
features AS (
  SELECT seg_id, video_id, speaker, 80 + ((e - s) * 7 % 97) / 97.0::DOUBLE * 200 AS f0_mean, CASE WHEN (e - s) % 11 > 0 THEN (((e - s) * 13 + s) % 89) / 89.0::DOUBLE * 5 END AS f0_std,
         ((s * 3 + e - s) % 101) / 101.0::DOUBLE AS voiced, (s % 103) / 103.0::DOUBLE AS rms, ((e - s + s * 5) % 83) / 83.0::DOUBLE AS arousal, (((e - s) * 3 + s) % 79) / 79.0::DOUBLE AS valence FROM spans),
framed AS (SELECT seg_id, s, e - s AS n, unnest(range(least(39, (e - s) // 100) + 1)) AS f FROM spans),
sound_frames AS (SELECT seg_id, f, {", ".join(f'((n * {7 + 2 * j} + f * {13 + 3 * j} + s) % 101) / 101.0::DOUBLE * 0.4::DOUBLE AS "{c}"' for j, c in enumerate(SOUNDS))} FROM framed),
signal AS (SELECT l_suppkey AS clip, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS i, l_quantity - 25 AS x FROM lineitem)"""


def merged(name: str, source: str, gap: int = 0, keys: str = "video_id, speaker") -> str:
    """A view of the intervals of ``source`` merged across ``gap``; repeated ones go first, as their order is open."""
    return f"""{name} AS (
  SELECT {keys}, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT {keys}, s, e FROM {source})))
  GROUP BY {keys}, g)"""


def query(body: str, *views: str, recursive: bool = False) -> str:
    """SQL over the common views and ``views``."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([SQL, *views]) + "\n" + body
