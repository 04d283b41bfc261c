"""Further queries: islands of speech, windows, prosody, engines side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import detectors as D
from weftline.operators import intervals as I
from weftline.operators import rows as R
from weftline.operators import signals as S
from weftline.operators import words as W
from weftline.plans import export_queries, word_queries
from weftline.plans.export_queries import _RMS, _half
from weftline.plans.interval_queries import _SUSPECT, _SWEEP, KEYS, _minus, _them
from weftline.plans.views import candidates, features, frames, islands, merged, query, samples, signal, spans, texts, turns, words
from weftline.runtime import table


def speech_islands(spark, directory):
    w = words(spark, directory)
    speech = w.groupBy("seg_id").agg(F.lit(0).cast("long").alias("s"), F.max("e").alias("e"))
    return I.speech_islands(speech, w, ["seg_id"])


def lane_windows(spark, directory):
    """Turns inside the chunks of their speaker, in time from the chunk's start."""
    lanes = R.latest(table(spark, directory, "lane_transcripts"), ["video_id", "chunk_id"], ties=("start", "end", "speaker"))
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c[0])
    windows = lanes.where("speaker IS NOT NULL").select(*KEYS, F.col("chunk_id").alias("window"), ms("start"), ms("end")).where("e > s")
    return I.clipped_to(turns(spark, directory), windows, KEYS)


def paste_regions(spark, directory):
    t = turns(spark, directory)
    return I.paste_regions(I.suspects(t, I.overlap_sweep(t, ["video_id"])), t, KEYS)


def prosody_features(spark, directory):
    s = signal(spark, directory)
    rms = S.active_frames(S.rms_rounded(S.frame_rms(s, ["clip"], 4)), ["clip"])
    eighths = F.floor(F.col("rms") * 8 + 0.5) / 8  # sums are exact in any order
    frames = rms.withColumns({"rms": eighths, "active": eighths > 13, "voiced": F.col("f") % 3 > 0, "f0": (80 + (F.col("f") * 37) % 211).cast("double")})
    clips = s.groupBy("clip").agg(F.floor(F.count("*") / 7).alias("n_words"), (F.count("*") / 100).alias("dur"))
    return S.prosody(frames, ["clip"], clips)


def engine_texts(spark, directory):
    """The texts of a clip by where they come from, side by side."""
    one = texts(spark, directory).select("seg_id", F.lit("transcripts").alias("engine"), "text")
    two = samples(spark, directory).select(F.col("sample_id").alias("seg_id"), F.lit("dataset").alias("engine"), F.col("text_plain").alias("text"))
    return R.engine_map(one.unionByName(two), "seg_id", "engine", "text").select("seg_id", F.element_at("engines", "dataset").alias("dataset"), F.element_at("engines", "transcripts").alias("transcripts"))


def retried_texts(spark, directory):
    """Texts of clips, those without one taken from the dataset."""
    first = texts(spark, directory).select("seg_id", "text", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").alias("error"))
    again = samples(spark, directory).select(F.col("sample_id").alias("seg_id"), F.col("text_plain").alias("text"), F.lit(None).cast("string").alias("error"))
    return R.retried(first, again, "seg_id", "text")


def skipped_words(spark, directory):
    """Clips, and those whose words all lack letters, which can't be aligned."""
    st = W.alignment_status(words(spark, directory), islands(spark, directory), ["seg_id"])
    return st.agg(F.count("*").alias("n"), F.count_if(F.col("n_skipped") == F.col("n_words")).alias("errors"))


def detected(spark, directory):
    """Candidates of all registered detectors."""
    dur = spans(spark, directory).select("seg_id", (F.col("e") - F.col("s")).alias("dur_ms"))
    tables = {"words": words(spark, directory), "islands": islands(spark, directory), "features": features(spark, directory), "frames": frames(spark, directory), "clips": dur}
    label = D.chip_label(F.col("tag"), F.col("score"), F.col("evidence"))
    return D.detect(tables).select("seg_id", "tag", "score", "position_s", "detector_name", label.alias("label"), F.array_sort(F.json_object_keys("evidence")).alias("fields"))


def _hits(spark, directory):
    """Candidates, their evidence null unless it is JSON."""
    return candidates(spark, directory).withColumn("evidence", F.when(F.expr("try_parse_json(evidence) IS NOT NULL"), F.col("evidence")))


def chip_labels(spark, directory):
    return _hits(spark, directory).select("cand_id", D.chip_label(F.col("tag"), F.col("score"), F.col("evidence")).alias("label"))


def chip_titles(spark, directory):
    return _hits(spark, directory).select("cand_id", D.chip_title(F.col("tag"), F.col("score"), F.col("detector"), F.col("evidence")).alias("title"))


def failure_counts(spark, directory):
    return R.failures(table(spark, directory, "lane_transcripts"), "error", ["engine"])


QUERIES = {f.__name__: f for f in (detected, chip_labels, chip_titles, failure_counts, speech_islands, lane_windows, paste_regions, prosody_features, engine_texts, retried_texts, skipped_words)}

def _body(sql: str) -> str:
    """The SELECT behind the common views of another query's SQL."""
    return sql[len(query("")) - 1 :].lstrip()


_AT = "floor(({}) / 1000.0::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE"
_W, _E = word_queries.ORACLE, export_queries.ORACLE
_J = "json_extract_string(evidence, '$.{}')"
_HITS = "hits AS (SELECT * REPLACE (CASE WHEN json_valid(evidence) THEN evidence END AS evidence) FROM cands)"
_TWO = "printf('%.2f', floor(({}) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE)"


_PASTE = [
    _them("them", 400), _SWEEP, _SUSPECT, merged("suspect", "raw_suspects", 200),
    """tiled AS (SELECT video_id, speaker, s, e, unnest(range(s // 10000, (e - 1) // 10000 + 1)) AS "window" FROM suspect WHERE e > s)""",
    """part AS (SELECT c.video_id, c.speaker, c."window", greatest(c.s, t.s) AS s, least(c.e, t.e) AS e FROM (
         SELECT video_id, speaker, "window", greatest(s, "window" * 10000) AS s, least(e, ("window" + 1) * 10000) AS e FROM tiled) c JOIN turns t ON t.video_id = c.video_id AND t.speaker = c.speaker AND c.s < t.e AND t.s < c.e)""",
    """padded AS (SELECT video_id, speaker, "window", greatest(s - 100, "window" * 10000) AS s, least(e + 100, ("window" + 1) * 10000) AS e FROM part WHERE e - s > 20)""",
    merged("p", "padded", 50, 'video_id, speaker, "window"'),
]


def _Q(field: str) -> str:
    return f"coalesce({_J.format(field)}, '?')"


ORACLE = {
    "detected": query(
        f"""SELECT seg_id, 'pauses' AS tag, score, {_AT.format("mid")} AS position_s, 'beats' AS detector_name, {_TWO.format(_AT.format("gap"))} || 's' AS label, ['after_word', 'before_word', 'gap_s'] AS fields
              FROM pauses p WHERE NOT EXISTS (SELECT 1 FROM islands i WHERE i.seg_id = p.seg_id AND i.s < p.mid AND p.mid < i.e)
            UNION ALL SELECT seg_id, 'hesitates', {_half("least(1.0::DOUBLE, 0.5 + g / 1000.0::DOUBLE)", 3)}, {_AT.format("s")}, 'beats', '"' || w || '"', ['filler', 'gap_s'] FROM (
              SELECT *, greatest(coalesce(s - prev_e, 0), coalesce(next_s - e, 0)) AS g FROM near) WHERE g >= 300 AND {word_queries._NORM.format("w")} IN ({word_queries._FILLERS})
            UNION ALL SELECT seg_id, 'hesitates', {_half("least(1.0::DOUBLE, (e - s) / 1000.0::DOUBLE)", 3)}, {_AT.format("(s + e) / 2.0::DOUBLE")}, 'beats', {_TWO.format(_AT.format("e") + " - " + _AT.format("s"))} || 's', ['island', 'kind'] FROM islands WHERE e - s BETWEEN 300 AND 1000
            UNION ALL SELECT seg_id, 'stammers', 0.7::DOUBLE, {_AT.format('"at"')}, 'beats', '"' || word || '"', ['join_s', 'repeated'] FROM ({_body(_W["beats_stammers"])})
            UNION ALL SELECT seg_id, 'stammers', 0.5::DOUBLE, {_AT.format('"at"')}, 'beats', '3×', ['island_cluster'] FROM ({_body(_W["island_cluster"]).replace("9000", "2000")})
            UNION ALL SELECT seg_id, 'whispers', score, NULL, 'whispers', {_TWO.format("score")}, ['rms', 'voiced_ratio'] FROM ({_body(_E["whispers"])})
            UNION ALL SELECT seg_id, tag, score, NULL, 'tones', {_TWO.format("score")}, CASE tag WHEN 'flatly' THEN ['f0_std_st', 'pctl_in_speaker'] ELSE ['f0_mean', 'f0_std_st', 'pctl_mean', 'pctl_std'] END FROM ({_body(_E["tones"])})
            UNION ALL SELECT seg_id, tag, score, NULL, 'states', {_TWO.format("score")}, ['arousal', 'pctl_a', 'pctl_v', 'valence', 'weak'] FROM ({_body(_E["states"])})
            UNION ALL SELECT seg_id, tag, {_half("top", 3)}, {_AT.format("at_f * (SELECT max(c.e - c.s) FROM spans c WHERE c.seg_id = p.seg_id) / n")}, CASE tag WHEN 'laughs' THEN 'laughs' ELSE 'reactions' END, {_TWO.format(_half("top", 3))}, ['class_scores'] FROM (
              SELECT seg_id, tag, max(x) AS top, arg_min(f, (-x, f)) AS at_f, max(f) + 1 AS n FROM (
                {" UNION ALL ".join(f"SELECT seg_id, '{t}' AS tag, f, greatest({', '.join(chr(34) + c + chr(34) for c in names)}) AS x FROM sound_frames" for t, names in (D.LAUGHS | D.REACTIONS).items())}) GROUP BY seg_id, tag) p
              WHERE top >= CASE tag WHEN 'laughs' THEN 0.05 ELSE 0.03 END::DOUBLE AND EXISTS (SELECT 1 FROM spans c WHERE c.seg_id = p.seg_id AND c.e - c.s >= 250)""",
        word_queries._PAUSES,
    ),
    "chip_labels": query(
        f"""SELECT cand_id, CASE WHEN tag = 'pauses' AND {_J.format("gap_s")} IS NOT NULL THEN {_TWO.format(_J.format("gap_s") + "::DOUBLE")} || 's'
              WHEN tag = 'hesitates' AND {_J.format("filler")} IS NOT NULL THEN '"' || {_J.format("filler")} || '"'
              WHEN tag = 'hesitates' AND {_J.format("island")} IS NOT NULL THEN {_TWO.format(_J.format("island[1]") + "::DOUBLE - " + _J.format("island[0]") + "::DOUBLE")} || 's'
              WHEN tag = 'stammers' AND {_J.format("repeated")} IS NOT NULL THEN '"' || {_J.format("repeated")} || '"'
              WHEN tag = 'stammers' AND {_J.format("island_cluster")} IS NOT NULL THEN json_array_length(evidence, '$.island_cluster')::VARCHAR || '×'
              WHEN score IS NOT NULL THEN {_TWO.format("score")} END AS label FROM hits""",
        _HITS,
    ),
    "chip_titles": query(
        f"""SELECT cand_id, concat_ws(chr(10), 'detector: ' || detector, 'score: ' || printf('%.3f', floor(score * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE),
              CASE WHEN tag = 'pauses' AND {_J.format("gap_s")} IS NOT NULL THEN {_Q("gap_s")} || 's of silence between "' || {_Q("after_word")} || '" and "' || {_Q("before_word")} || '"'
                WHEN tag = 'hesitates' AND {_J.format("filler")} IS NOT NULL THEN 'filler "' || {_Q("filler")} || '" beside a ' || {_Q("gap_s")} || 's gap'
                WHEN tag = 'hesitates' AND {_J.format("island")} IS NOT NULL THEN {_TWO.format(_J.format("island[1]") + "::DOUBLE - " + _J.format("island[0]") + "::DOUBLE")} || 's of speech with no transcript'
                WHEN tag = 'stammers' AND {_J.format("repeated")} IS NOT NULL THEN '"' || {_Q("repeated")} || '" repeated ' || {_Q("join_s")} || 's apart'
                WHEN {_J.format("class_scores")} IS NOT NULL THEN 'class scores: ' || json_extract(evidence, '$.class_scores')::VARCHAR
                WHEN {_J.format("arousal")} IS NOT NULL THEN 'arousal ' || {_Q("arousal")} || ' (pctl ' || {_Q("pctl_a")} || ') · valence ' || {_Q("valence")} || ' (pctl ' || {_Q("pctl_v")} || ')' || CASE WHEN {_J.format("weak")} = 'true' THEN ' · WEAK evidence (English-trained model on Hindi)' ELSE '' END
                WHEN {_J.format("f0_std_st")} IS NOT NULL THEN 'pitch variability ' || {_Q("f0_std_st")} || ' semitones (speaker pctl ' || coalesce({_J.format("pctl_in_speaker")}, {_J.format("pctl_std")}, '?') || ')' END,
              'click to play ±2s around it') AS title FROM hits""",
        _HITS,
    ),
    "failure_counts": "SELECT engine, count(*) AS n, count(error) AS n_failed FROM lane_transcripts GROUP BY engine",
    "speech_islands": query(
        "SELECT seg_id, s, e FROM d WHERE e - s >= 300",
        "speech AS (SELECT seg_id AS video_id, seg_id AS speaker, seg_id, 0::BIGINT AS s, max(e) AS e FROM words GROUP BY seg_id)",
        "padded AS (SELECT seg_id AS video_id, seg_id AS speaker, greatest(s - 120, 0) AS s, e + 120 AS e FROM words)",
        merged("cover", "padded", 50),
        *_minus("raw", "speech", "cover"),
        "d AS (SELECT video_id AS seg_id, s, e FROM raw)",
    ),
    "lane_windows": query(
        """SELECT t.video_id, t.speaker, l.chunk_id AS "window", greatest(t.s, l.s) - l.s AS s, least(t.e, l.e) - l.s AS e FROM turns t JOIN lanes l ON l.video_id = t.video_id AND l.speaker = t.speaker AND t.s < l.e AND l.s < t.e""",
        """lanes AS (SELECT video_id, speaker, chunk_id, s, e FROM (SELECT video_id, speaker, chunk_id, floor("start" * 1000 + 0.5)::BIGINT AS s, floor("end" * 1000 + 0.5)::BIGINT AS e,
             row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY written_at DESC NULLS LAST, "start" DESC NULLS LAST, "end" DESC NULLS LAST, speaker DESC NULLS LAST) AS rn FROM lane_transcripts
             WHERE video_id IS NOT NULL AND chunk_id IS NOT NULL) WHERE rn = 1 AND speaker IS NOT NULL AND e > s)""",
    ),
    "paste_regions": query('SELECT video_id, speaker, "window", s, e FROM p', *_PASTE),
    "prosody_features": query(
        f"""SELECT a.clip, f0_mean, f0_std_st, voiced_ratio, rms, {_half("nullif(n // 7, 0) / (n / 100.0::DOUBLE)", 2)} AS rate_wps FROM (
              SELECT clip, {_half("avg(CASE WHEN v THEN f0 END)", 2)} AS f0_mean, CASE WHEN count(*) FILTER (v) > 3 THEN {_half("stddev_pop(CASE WHEN v THEN 12 * log2(f0) END)", 3)} END AS f0_std_st,
                     coalesce({_half("avg(CASE WHEN rms > 13 THEN v::INTEGER::DOUBLE END)", 3)}, 0.0::DOUBLE) AS voiced_ratio, coalesce({_half("avg(CASE WHEN rms > 13 THEN rms END)", 5)}, 0.0::DOUBLE) AS rms
              FROM (SELECT *, f % 3 > 0 AS v, (80 + (f * 37) % 211)::DOUBLE AS f0 FROM (SELECT clip, f, floor(rms * 8 + 0.5) / 8.0::DOUBLE AS rms FROM frames)) GROUP BY clip) a JOIN (SELECT clip, count(*) AS n FROM signal GROUP BY clip) b ON a.clip = b.clip""",
        _RMS.format(n=4),
    ),
    "engine_texts": query(
        """SELECT coalesce(t.seg_id, d.sample_id) AS seg_id, CASE WHEN d.sample_id IS NOT NULL THEN coalesce(d.text_plain, '') END AS dataset, CASE WHEN t.seg_id IS NOT NULL THEN coalesce(t.text, '') END AS transcripts
           FROM texts t FULL JOIN samples d ON d.sample_id = t.seg_id"""
    ),
    "retried_texts": query(
        """SELECT t.seg_id, CASE WHEN t.bad AND d.text_plain IS NOT NULL THEN d.text_plain ELSE t.text END AS text, CASE WHEN t.bad AND d.text_plain IS NULL THEN 'empty' END AS error
           FROM (SELECT *, coalesce(trim(text), '') = '' AS bad FROM texts) t LEFT JOIN samples d ON d.sample_id = t.seg_id"""
    ),
    "skipped_words": query(r"SELECT count(*) AS n, count(*) FILTER (k = c) AS errors FROM (SELECT seg_id, count(*) AS c, count(*) FILTER (NOT regexp_matches(w, '\p{L}')) AS k FROM words GROUP BY seg_id)"),
}
