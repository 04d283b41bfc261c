"""Queries on candidates, export, percentiles, signals and embeddings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.text import FILLER_PATTERN, filler_count, half_up
from weftline.operators import export as X
from weftline.operators import percentiles as P
from weftline.operators import rows
from weftline.operators import signals as S
from weftline.operators import words as W
from weftline.plans.views import candidates, clips, features, query, samples, signal, spans, texts, words
from weftline.plans.word_queries import _PAUSES
from weftline.runtime import table

SPEAKER = ["video_id", "speaker"]
DIMS = 64
#: Name of candidates without a detector; no file stem has brackets.
NO_DETECTOR = "(none)"


def threshold_filter(spark, directory):
    return X.passing(candidates(spark, directory)).select("cand_id", "tag", "score")


def candidate_union(spark, directory):
    """Candidates of every detector by name; those without one count as NO_DETECTOR."""
    c = candidates(spark, directory).select(F.coalesce("detector", F.lit(NO_DETECTOR)).alias("detector_name"), "tag")
    return c.groupBy("detector_name", "tag").agg(F.count("*").alias("n"))


def _flags(spark, directory):
    d = samples(spark, directory).select(F.col("sample_id").alias("seg_id"), "clipped", "align_status", F.lit(True).alias("known"))
    all_ = clips(spark, directory).join(texts(spark, directory).select("seg_id", "text"), "seg_id", "left").join(d, "seg_id", "left")
    return all_, X.clip_flags(F.col("text"), F.col("purity"), F.col("purity_pass"), F.col("clipped"), F.col("separated"), F.col("align_status"))


def export_gate(spark, directory):
    df, flags = _flags(spark, directory)
    return df.select("seg_id", X.gate(flags).alias("reason"))


def dropped_histogram(spark, directory):
    df, flags = _flags(spark, directory)
    return df.select(X.gate(flags).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def ui_exclusion_reason(spark, directory):
    df, flags = _flags(spark, directory)
    return df.select("seg_id", X.listed_reason(flags, F.coalesce("known", F.lit(False))).alias("reason"))


def badges(spark, directory):
    df, f = _flags(spark, directory)
    return df.agg(
        F.count("*").alias("clips"), F.count_if("known").alias("in_dataset"), F.count_if(F.col("known").isNull()).alias("excluded"), F.count_if(f["separated"]).alias("rescued"), F.count_if(f["impure"]).alias("impure"), F.count_if(f["clipped"]).alias("clipped")
    )


def dataset_membership(spark, directory):
    """Clips that are no sample of the dataset."""
    return clips(spark, directory).select("seg_id").join(samples(spark, directory).select(F.col("sample_id").alias("seg_id")), "seg_id", "left_anti")


def _tags(spark, directory):
    c = X.passing(candidates(spark, directory).where("seg_id IS NOT NULL AND tag IS NOT NULL"))
    return X.with_silences(c, W.pauses(words(spark, directory), ["seg_id"]))


def pause_reclassify(spark, directory):
    return _tags(spark, directory)


def _lines(spark, directory):
    t = texts(spark, directory).select("seg_id", "text")
    return t, X.render(t, words(spark, directory), _tags(spark, directory))


def tag_render(spark, directory):
    return _lines(spark, directory)[1].drop("tags")


#: Names given to speakers, as a job holds them.
NAMES = {"SPEAKER_00": "Host", "SPEAKER_01": " ", "SPEAKER_02": "Guest"}


def dataset_rows(spark, directory):
    """The dataset made anew; clipped edges and the status of alignment are those of the stored one.  The fields of script are columns of their own."""
    _, lines = _lines(spark, directory)
    known = samples(spark, directory).select(F.col("sample_id").alias("seg_id"), "clipped", "align_status")
    rows = X.training_rows(clips(spark, directory).join(known, "seg_id", "left"), texts(spark, directory), lines, NAMES)
    return rows.select(*(c for c in rows.columns if c != "script"), "script.*")


def speaker_tag_matrix(spark, directory):
    return X.matrix(samples(spark, directory), by=("video_id",))


def corpus_matrix(spark, directory):
    return X.matrix(samples(spark, directory))


def corpus_totals(spark, directory):
    ms = F.floor(F.col("dur") * 1000 + 0.5).cast("long")
    return samples(spark, directory).agg(F.count("*").alias("n_rows"), F.sum(ms).alias("total_ms"), F.countDistinct("speaker").alias("n_speakers"))


def tagged_neutral(spark, directory):
    n = F.coalesce(F.size("tags"), F.lit(0)) > 0
    ms = F.sum(F.floor(F.col("dur") * 1000 + 0.5).cast("long"))
    return samples(spark, directory).groupBy("video_id").agg(F.count_if(n).alias("tagged"), F.count_if(~n).alias("neutral"), half_up(ms / 60_000, 1).alias("minutes"))


def speaker_rename(spark, directory):
    return spans(spark, directory).select("seg_id", rows.rename(F.col("speaker"), NAMES).alias("name"))


def hits_table(spark, directory):
    w = Window.partitionBy("video_id", "detector").orderBy(F.col("score").desc_nulls_last(), "cand_id")
    return candidates(spark, directory).where("detector IS NOT NULL").withColumn("place", F.row_number().over(w)).where("place <= 60").select("video_id", "detector", "cand_id", "place")


def cache_antijoin(spark, directory):
    done = samples(spark, directory).select(F.col("sample_id").alias("seg_id"), F.when(F.col("align_status") == "align_error", "failed").alias("error"))
    return rows.to_do(spans(spark, directory), done, "seg_id", "error").select("seg_id")


def engine_bakeoff(spark, directory):
    """Per engine: texts, misses and fillers, over the texts of the same clips."""
    t, d = texts(spark, directory), samples(spark, directory)
    long = t.select("seg_id", F.lit("transcripts").alias("engine"), "text").unionByName(d.select(F.col("sample_id").alias("seg_id"), F.lit("dataset").alias("engine"), F.col("text_plain").alias("text")))
    both = long.groupBy("seg_id").agg(F.countDistinct("engine").alias("_n")).where("_n = 2").select("seg_id")
    return long.join(both, "seg_id", "left_semi").groupBy("engine").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("misses"), F.sum(filler_count(F.col("text"))).cast("long").alias("fillers"))


def speaker_percentile(spark, directory):
    s = spans(spark, directory).withColumn("x", F.col("e") - F.col("s"))
    return P.strict_percentile(s, SPEAKER, "x", "p", width=1000.0).select("seg_id", half_up(F.col("p"), 6).alias("p"))


def whispers(spark, directory):
    return P.whispers(features(spark, directory), ["video_id"]).select("seg_id", "score")


def tones(spark, directory):
    return P.tones(features(spark, directory), SPEAKER).select("seg_id", "tag", "score")


def states(spark, directory):
    return P.states(features(spark, directory), SPEAKER).select("seg_id", "tag", "score")


def frame_rms(spark, directory):
    return S.rms_rounded(S.frame_rms(signal(spark, directory), ["clip"], 16))


def peaks(spark, directory):
    return S.peaks(signal(spark, directory), ["clip"], 40)


def active_frames(spark, directory):
    from weftline.operators.intervals import runs

    beat = signal(spark, directory).withColumn("x", F.col("x") * (F.floor(F.col("i") / 32) % 4))
    return runs(S.active_frames(S.rms_rounded(S.frame_rms(beat, ["clip"], 4)), ["clip"]), ["clip"], "f", "active")


def sed_peak(spark, directory):
    s = signal(spark, directory).select("clip", F.col("i").alias("f"), ((F.col("x") + 25) / 50).alias("a"), (F.col("i") % 17 / 17.0).cast("double").alias("b"))
    return S.event_peak(s, ["clip"], ["a", "b"], 0.05)


def _embeddings(spark, directory):
    return table(spark, directory, "embeddings")


def centroid(spark, directory):
    c = S.centroids(_embeddings(spark, directory), "label", "embedding", DIMS)
    return c.select("label", F.posexplode("centroid").alias("d", "x")).select("label", "d", half_up(F.col("x"), 6).alias("x"))


def purity_gate(spark, directory):
    e = _embeddings(spark, directory)
    p = S.purity(e, S.centroids(e, "label", "embedding", DIMS), "label", "embedding")
    return p.select("vec_id", half_up(F.col("purity"), 5).alias("purity"), (half_up(F.col("purity"), 5) >= 0.55).alias("pass"))


def stream_pick(spark, directory):
    c = candidates(spark, directory).where("score IS NOT NULL AND seg_id IS NOT NULL")
    return S.nearest(c, ["seg_id"], "score", "cand_id")


def embedding_sink(spark, directory):
    from weftline.functions.vectors import usable

    return _embeddings(spark, directory).where(usable(F.col("embedding"))).groupBy("label").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (threshold_filter, candidate_union, export_gate, dropped_histogram, ui_exclusion_reason, badges, dataset_membership, pause_reclassify, tag_render, dataset_rows, speaker_tag_matrix, corpus_matrix, corpus_totals, tagged_neutral, speaker_rename, hits_table, cache_antijoin, engine_bakeoff, speaker_percentile, whispers, tones, states, frame_rms, peaks, active_frames, sed_peak, centroid, purity_gate, stream_pick, embedding_sink)}


def _half(x: str, places: int) -> str:
    return f"floor(({x}) * {10**places}.0::DOUBLE + 0.5) / {10**places}.0::DOUBLE"


_LEAST = "CASE tag " + " ".join(f"WHEN '{t}' THEN {s}::DOUBLE" for t, s in X.THRESHOLDS.items()) + " END"
_UTTERANCE = ", ".join(f"'{t}'" for t in X.UTTERANCE)
_FLAGS = r"""flags AS (
  SELECT c.seg_id, d.sample_id IS NOT NULL AS known, trim(regexp_replace(coalesce(t.text, ''), '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', '', 'g')) = '' AS no_text,
         c.purity IS NOT NULL AND NOT coalesce(c.purity_pass, true) AS impure, coalesce(len(d.clipped) > 0, false) AS clipped, coalesce(c.separated, false) AS separated,
         coalesce(d.align_status = 'major_gap', false) AS major_gap, coalesce(d.align_status = 'align_error', false) AS align_error
  FROM clips c LEFT JOIN texts t ON t.seg_id = c.seg_id LEFT JOIN samples d ON d.sample_id = c.seg_id)"""
_GATE = "CASE " + " ".join(f"WHEN {k} THEN '{k}'" for k, on in X.GATES.items() if on) + " END"
_TAGS = [
    _PAUSES,
    f"""pass AS MATERIALIZED (SELECT cand_id AS n, seg_id, tag, score, position_ms, tag IN ('pauses', 'silence') AND position_ms IS NOT NULL AS quiet FROM cands
             WHERE seg_id IS NOT NULL AND tag IS NOT NULL AND ({_LEAST} IS NULL OR coalesce(score, 0) >= {_LEAST}))""",
    "pair AS MATERIALIZED (SELECT q.n, q.seg_id, p.tag, p.mid FROM pass q JOIN pauses p ON p.seg_id = q.seg_id AND abs(p.mid - q.position_ms) < 300 WHERE q.quiet)",
    """tags AS MATERIALIZED (
  SELECT q.seg_id, coalesce(m.tag, q.tag) AS tag, q.score, q.position_ms::DOUBLE AS position_ms, false AS derived FROM pass q LEFT JOIN (SELECT n, arg_max(tag, mid) AS tag FROM pair GROUP BY n) m ON m.n = q.n
  UNION ALL SELECT p.seg_id, p.tag, p.score, p.mid, true FROM pauses p ANTI JOIN pair x ON x.seg_id = p.seg_id AND x.mid = p.mid)""",
]
_LINES = [
    *_TAGS,
    f"""marks AS (
  SELECT t.seg_id, '[' || t.tag || ']' AS x, CASE WHEN lead_ THEN -1 ELSE coalesce(at_ * 2, 1073741824) END AS place, CASE WHEN lead_ THEN -coalesce(t.score, 0.0) ELSE t.position_ms END AS ord
  FROM (SELECT g.*, (g.tag IN ({_UTTERANCE}) OR g.position_ms IS NULL OR NOT EXISTS (SELECT 1 FROM words w WHERE w.seg_id = g.seg_id)) AS lead_,
               (SELECT min(i) FROM words w WHERE w.seg_id = g.seg_id AND w.s > g.position_ms) AS at_ FROM tags g) t
  WHERE t.seg_id IN (SELECT seg_id FROM texts))""",
    """lines AS (SELECT seg_id, string_agg(x, ' ' ORDER BY place, ord, x) AS tagged FROM (SELECT seg_id, x, place, ord FROM marks UNION ALL SELECT seg_id, w, i * 2 + 1, 0.0 FROM words) GROUP BY seg_id)""",
]


def _pct(value: str, keys: str) -> str:
    """Strict percentile of ``value``: nulls sort behind all values."""
    return f"CASE WHEN {value} IS NULL THEN NULL WHEN count({value}) OVER (PARTITION BY {keys}) < 10 THEN 0.5 ELSE (rank() OVER (PARTITION BY {keys} ORDER BY {value} NULLS LAST) - 1) / count({value}) OVER (PARTITION BY {keys})::DOUBLE END"


def _matrix(by: str) -> str:
    return f"""SELECT {by}speaker, tag, count(*) AS n FROM (
      SELECT {by}speaker, unnest(list_concat(['_rows'], CASE WHEN coalesce(len(tags), 0) = 0 THEN ['_neutral'] ELSE list_distinct(tags) END)) AS tag FROM samples) GROUP BY ALL"""


_VEC = """dim AS (SELECT vec_id, label, unnest(range(64))::INTEGER AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
units AS (SELECT vec_id, label, d, x / (sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 1e-9::DOUBLE) AS u FROM dim),
means AS (SELECT label, d, avg(u) AS m FROM units GROUP BY label, d),
cent AS (SELECT label, d, m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-9::DOUBLE) AS x FROM means)"""
_RMS = "frames AS (SELECT clip, (i // {n})::BIGINT AS f, " + _half("sqrt(avg(x * x))", 6) + " AS rms FROM signal GROUP BY clip, i // {n} HAVING count(*) = {n})"

ORACLE = {
    "threshold_filter": query(f"SELECT cand_id, tag, score FROM cands WHERE {_LEAST} IS NULL OR coalesce(score, 0) >= {_LEAST}"),
    "candidate_union": query(f"SELECT coalesce(detector, '{NO_DETECTOR}') AS detector_name, tag, count(*) AS n FROM cands GROUP BY ALL"),
    "export_gate": query(f"SELECT seg_id, {_GATE} AS reason FROM flags", _FLAGS),
    "dropped_histogram": query(f"SELECT reason, count(*) AS n FROM (SELECT {_GATE} AS reason FROM flags) WHERE reason IS NOT NULL GROUP BY reason", _FLAGS),
    "ui_exclusion_reason": query(
        """SELECT seg_id, CASE WHEN known THEN NULL WHEN no_text THEN 'no text' WHEN separated THEN 'separated audio (SepFormer artifacts)' WHEN major_gap THEN 'audible speech with no text'
           WHEN align_error THEN 'alignment failed' WHEN clipped THEN 'clipped edge word' ELSE 'export gate' END AS reason FROM flags""",
        _FLAGS,
    ),
    "badges": query("SELECT count(*) AS clips, count(*) FILTER (known) AS in_dataset, count(*) FILTER (NOT known) AS excluded, count(*) FILTER (separated) AS rescued, count(*) FILTER (impure) AS impure, count(*) FILTER (clipped) AS clipped FROM flags", _FLAGS),
    "dataset_membership": query("SELECT seg_id FROM clips WHERE seg_id NOT IN (SELECT sample_id FROM samples)"),
    "pause_reclassify": query("SELECT * FROM tags", *_TAGS),
    "tag_render": query("SELECT * FROM lines", *_LINES),
    "dataset_rows": query(
        rf"""SELECT c.seg_id AS sample_id, c.video_id, n.name AS speaker, c.speaker AS speaker_label, l.tagged AS text, t.plain AS text_plain, n.name || ': ' || l.tagged AS line, coalesce(g.tags, []::VARCHAR[]) AS tags, c.wav,
             {_half("(c.e - c.s) / 1000.0::DOUBLE", 3)} AS dur, c.s / 1000.0::DOUBLE AS start, c.e / 1000.0::DOUBLE AS "end", CASE WHEN ('0x' || substr(sha256(c.video_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.05 THEN 'val' ELSE 'train' END AS split,
             coalesce(c.source, 'original') AS source, coalesce(c.separated_frac, 0.0::DOUBLE) AS separated_frac, c.purity, d.align_status, coalesce(d.clipped, []::VARCHAR[]) AS clipped, t.asr, t.script.chars AS chars, t.script.deva_frac AS deva_frac, t.script.latin_frac AS latin_frac, t.script.script_switches AS script_switches
           FROM clips c JOIN (SELECT seg_id, asr, script, regexp_replace(text, '^[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+|[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+$', '', 'g') AS plain FROM texts) t ON t.seg_id = c.seg_id
           JOIN (SELECT seg_id, {_GATE} AS reason FROM flags) f ON f.seg_id = c.seg_id AND f.reason IS NULL
           JOIN (SELECT seg_id, CASE speaker WHEN 'SPEAKER_00' THEN 'Host' WHEN 'SPEAKER_02' THEN 'Guest' ELSE speaker END AS name FROM spans) n ON n.seg_id = c.seg_id
           JOIN lines l ON l.seg_id = c.seg_id LEFT JOIN samples d ON d.sample_id = c.seg_id LEFT JOIN (SELECT seg_id, list_sort(list_distinct(list(tag))) AS tags FROM tags GROUP BY seg_id) g ON g.seg_id = c.seg_id""",
        *_LINES, _FLAGS,
    ),
    "speaker_tag_matrix": query(_matrix("video_id, ")),
    "corpus_matrix": query(_matrix("")),
    "corpus_totals": query("SELECT count(*) AS n_rows, sum(floor(dur * 1000 + 0.5)::BIGINT)::BIGINT AS total_ms, count(DISTINCT speaker) AS n_speakers FROM samples"),
    "tagged_neutral": query("SELECT video_id, count(*) FILTER (coalesce(len(tags), 0) > 0) AS tagged, count(*) FILTER (coalesce(len(tags), 0) = 0) AS neutral, floor(sum(floor(dur * 1000 + 0.5)::BIGINT)::BIGINT / 60000.0::DOUBLE * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS minutes FROM samples GROUP BY video_id"),
    "speaker_rename": query("SELECT seg_id, CASE speaker WHEN 'SPEAKER_00' THEN 'Host' WHEN 'SPEAKER_02' THEN 'Guest' ELSE speaker END AS name FROM spans"),
    "hits_table": query("SELECT video_id, detector, cand_id, place FROM (SELECT *, row_number() OVER (PARTITION BY video_id, detector ORDER BY score DESC NULLS LAST, cand_id)::INTEGER AS place FROM cands WHERE detector IS NOT NULL) WHERE place <= 60"),
    "cache_antijoin": query("SELECT seg_id FROM spans WHERE seg_id NOT IN (SELECT sample_id FROM samples WHERE align_status IS DISTINCT FROM 'align_error')"),
    "engine_bakeoff": query(
        f"""SELECT engine, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') AS misses, sum(len(regexp_extract_all(coalesce(text, ''), '(?i){FILLER_PATTERN}')))::BIGINT AS fillers FROM (
              SELECT seg_id, 'transcripts' AS engine, text FROM texts WHERE seg_id IN (SELECT sample_id FROM samples) UNION ALL SELECT sample_id, 'dataset', text_plain FROM samples WHERE sample_id IN (SELECT seg_id FROM texts)) GROUP BY engine"""
    ),
    "speaker_percentile": query(f"SELECT seg_id, {_half('p', 6)} AS p FROM (SELECT seg_id, {_pct('x', 'video_id, speaker')} AS p FROM (SELECT *, e - s AS x FROM spans))"),
    "whispers": query(f"SELECT seg_id, {_half('1 - voiced', 3)} AS score FROM features WHERE voiced <= 0.25 AND rms >= coalesce((SELECT quantile_cont(g.rms, 0.2) FROM features g WHERE g.rms > 0 AND g.video_id = features.video_id), 0)"),
    "tones": query(
        f"""SELECT seg_id, CASE WHEN ps <= 0.1::DOUBLE THEN 'flatly' ELSE 'cheerfully' END AS tag,
              CASE WHEN ps <= 0.1::DOUBLE THEN {_half("1.0::DOUBLE - ps / 0.1::DOUBLE * 0.5::DOUBLE", 3)} ELSE {_half("0.5::DOUBLE + (pm - 0.9::DOUBLE) / (1 - 0.9::DOUBLE) * 0.5::DOUBLE", 3)} END AS score
            FROM (SELECT *, {_pct("f0_std", "video_id, speaker")} AS ps, {_pct("f0_mean", "video_id, speaker")} AS pm, count(*) OVER (PARTITION BY video_id, speaker) AS many FROM features)
            WHERE many >= 20 AND f0_std IS NOT NULL AND coalesce(voiced, 1) >= 0.25 AND (ps <= 0.1::DOUBLE OR (pm >= 0.9::DOUBLE AND ps >= 0.6::DOUBLE))"""
    ),
    "states": query(
        f"""SELECT seg_id, tag, {_half("least(1.0::DOUBLE, 0.3::DOUBLE + v)", 3)} AS score FROM (
              SELECT seg_id, unnest(['excited', 'nervous', 'frustrated', 'sorrowful', 'calm']) AS tag, unnest([
                CASE WHEN pa >= 0.8::DOUBLE AND pv >= 0.6::DOUBLE THEN (pa - 0.8::DOUBLE) / 0.2::DOUBLE * 0.5::DOUBLE + (pv - 0.6::DOUBLE) / 0.4::DOUBLE * 0.5::DOUBLE END,
                CASE WHEN pa >= 0.8::DOUBLE AND pv <= 0.4::DOUBLE AND coalesce(f0_std > q, false) THEN (pa - 0.8::DOUBLE) / 0.2::DOUBLE * 0.5::DOUBLE + (0.4::DOUBLE - pv) / 0.4::DOUBLE * 0.5::DOUBLE END,
                CASE WHEN pa >= 0.6::DOUBLE AND pv <= 0.3::DOUBLE THEN (pa - 0.6::DOUBLE) / 0.4::DOUBLE * 0.5::DOUBLE + (0.3::DOUBLE - pv) / 0.3::DOUBLE * 0.5::DOUBLE END,
                CASE WHEN pa <= 0.3::DOUBLE AND pv <= 0.3::DOUBLE THEN (0.3::DOUBLE - pa) / 0.3::DOUBLE * 0.5::DOUBLE + (0.3::DOUBLE - pv) / 0.3::DOUBLE * 0.5::DOUBLE END,
                CASE WHEN pa <= 0.3::DOUBLE AND pv >= 0.6::DOUBLE THEN (0.3::DOUBLE - pa) / 0.3::DOUBLE * 0.5::DOUBLE + (pv - 0.6::DOUBLE) / 0.4::DOUBLE * 0.5::DOUBLE END]) AS v
              FROM (SELECT *, {_pct("arousal", "video_id, speaker")} AS pa, {_pct("valence", "video_id, speaker")} AS pv, count(*) OVER (PARTITION BY video_id, speaker) AS many, quantile_cont(f0_std, 0.75) OVER (PARTITION BY video_id, speaker) AS q FROM features) WHERE many >= 20)
            WHERE v IS NOT NULL"""
    ),
    "frame_rms": query("SELECT * FROM frames", _RMS.format(n=16)),
    "peaks": query(
        """SELECT clip, bin::BIGINT AS bin, min(x) AS low, max(x) AS high FROM (SELECT s.clip, s.x, s.i // n.hop AS bin FROM signal s JOIN (SELECT clip, count(*) AS n, greatest(1, count(*) // 40) AS hop FROM signal GROUP BY clip) n
           ON n.clip = s.clip AND s.i < n.n // n.hop * n.hop) GROUP BY clip, bin"""
    ),
    "active_frames": query(
        """SELECT clip, min(f) AS first, max(f) + 1 AS stop FROM (
             SELECT clip, f, f - row_number() OVER (PARTITION BY clip ORDER BY f) AS g FROM (SELECT *, quantile_cont(rms, 0.1) OVER (PARTITION BY clip) AS low, max(rms) OVER (PARTITION BY clip) AS high FROM frames)
             WHERE rms > greatest(low * 3, high * 0.05::DOUBLE)) GROUP BY clip, g HAVING count(*) >= 3""",
        _RMS.format(n=4).replace("x * x", "x * x * (i // 32 % 4) * (i // 32 % 4)"),
    ),
    "sed_peak": query(
        """SELECT clip, score, frame, a, b FROM (SELECT clip, max(top) AS score, arg_min(f, (-top, f)) AS frame, max(a) AS a, max(b) AS b FROM (
             SELECT clip, i AS f, (x + 25) / 50 AS a, (i % 17) / 17.0::DOUBLE AS b, greatest((x + 25) / 50, (i % 17) / 17.0::DOUBLE) AS top FROM signal) GROUP BY clip) WHERE score >= 0.05"""
    ),
    "centroid": query(f"SELECT label, d, {_half('x', 6)} AS x FROM cent", _VEC),
    "purity_gate": query(f"SELECT vec_id, {_half('p', 5)} AS purity, {_half('p', 5)} >= 0.55::DOUBLE AS pass FROM (SELECT u.vec_id, sum(u.u * c.x) AS p FROM units u JOIN cent c ON c.label = u.label AND c.d = u.d GROUP BY u.vec_id)", _VEC),
    "stream_pick": query("SELECT seg_id, cand_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY score DESC, cand_id) AS r FROM cands WHERE score IS NOT NULL AND seg_id IS NOT NULL) WHERE r = 1"),
    "embedding_sink": "SELECT label, count(*) AS n FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY label",
}
