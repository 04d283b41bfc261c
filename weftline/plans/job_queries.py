"""Queries on lanes, jobs and ordered reads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import intervals as I
from weftline.operators import lanes as L
from weftline.operators import rows as R
from weftline.operators import status as S
from weftline.operators import words as W
from weftline.plans.cut_sql import CHUNKS
from weftline.plans.interval_queries import _SWEEP, KEYS, _minus, _them
from weftline.plans.more_queries import _PASTE
from weftline.plans.views import clips, islands, merged, query, samples, spans, turns, words
from weftline.plans.word_queries import lane_words
from weftline.runtime import table


def chunk_aligned(spark, directory):
    """Texts as chunks, whose speech runs from their start to their last word."""
    w = words(spark, directory)
    chunks = w.groupBy("seg_id").agg(F.count_if(~F.col("w").rlike(r"\p{L}")).alias("n_skipped"))
    speech = w.groupBy("seg_id").agg(F.lit(0).cast("long").alias("s"), F.max("e").alias("e"))
    return W.chunk_status(chunks, speech, islands(spark, directory), ["seg_id"])


def engine_default(spark, directory):
    """Chunks with the engine of their transcript."""
    rows = table(spark, directory, "lane_transcripts")
    chunks = rows.where("video_id IS NOT NULL AND chunk_id IS NOT NULL").select("video_id", "chunk_id").distinct()
    return R.with_engine(chunks, rows, ["video_id", "chunk_id"])


def dropped_short(spark, directory):
    return R.short_dropped(spans(spark, directory), ["video_id"], F.col("e") - F.col("s"), 2500)


def longest_overlaps(spark, directory):
    """The first 200 regions of a recording in which several speak."""
    return R.in_order(I.overlap_sweep(turns(spark, directory), ["video_id"]), ["video_id"], ["s", "e"], 200).drop("place")


def segments_by_start(spark, directory):
    rows = clips(spark, directory).where("s IS NOT NULL").select("video_id", "seg_id", "s")
    return R.numbered(rows, ["video_id"], "s", ["s", "seg_id"], 3_600_000, "place", "n").select("video_id", "seg_id", "place")


def speakers_by_rows(spark, directory):
    n = samples(spark, directory).where("speaker IS NOT NULL").groupBy("speaker").agg(F.count("*").alias("n"))
    return R.in_order(n, [], [F.col("n").desc(), "speaker"])


def _lane_names(spark, directory):
    s = spans(spark, directory).select("video_id", "speaker").distinct()
    slug = T.slug(F.col("speaker"))
    forms = F.array("speaker", F.concat(F.lit("sam_"), slug, F.lit("_clean")), F.lit("original"), F.lit("sam_old_name_clean"))
    return s.select("video_id", F.explode(forms).alias("name")).where("name NOT LIKE '%03%clean'").distinct()


def lane_owners(spark, directory):
    return _lane_names(spark, directory).select("name").distinct().select("name", T.lane_owner(F.col("name")).alias("owner"), T.clean_owner(F.col("name")).alias("clean_of"))


def clean_speakers(spark, directory):
    """The speakers of a recording that have a clean lane."""
    return _lane_names(spark, directory).groupBy("video_id").agg(F.array_sort(F.collect_set(T.clean_owner(F.col("name")))).alias("speakers"))


def romanized_tokens(spark, directory):
    """How many tokens in Devanagari keep letters, and how many none, once romanized."""
    w = words(spark, directory).where(F.col("w").rlike(r"[\x{905}-\x{939}]"))
    return w.groupBy("seg_id").agg(F.count("*").alias("n"), F.count_if(T.alignable(F.col("w")) != "").alias("n_alignable"))


def _streams(windows):
    """Stand-ins for what separation and embedding give: two streams a window, by integer rules."""
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("stream")
    n = F.col("window") + F.col("stream")
    like = ((F.col("window") * 13 + F.col("stream") * 29 + F.length("video_id")) % 97).cast("double") / 97
    return windows.select(*KEYS, "window", k).select(*KEYS, "window", "stream", F.when(n % 11 > 0, like).alias("similarity"), ((n % 7).cast("double") * 0.001).alias("rms"))


def _lane(spark, directory):
    t = turns(spark, directory)
    heard = I.overlap_sweep(t, ["video_id"])
    return L.clean_lane(t, heard, _streams)


def window_verdicts(spark, directory):
    return _lane(spark, directory)["windows"]


def rescued_regions(spark, directory):
    return _lane(spark, directory)["rescued"]


def clean_forbidden(spark, directory):
    return _lane(spark, directory)["forbidden"]


def masked_forbidden(spark, directory):
    return L.forbidden_masked(turns(spark, directory))


def clip_levels(spark, directory):
    levels = L.levels(spans(spark, directory), _lane(spark, directory)["rescued"])
    return levels.select("seg_id", "over_len", "separated_s", "separated", "separated_frac")


def solo_snippets(spark, directory):
    return L.solo_snippets(turns(spark, directory))


def lane_word_counts(spark, directory):
    """Tokens of the lane transcripts and the time that they take, by chunk."""
    lanes = R.latest(table(spark, directory, "lane_transcripts"), ["video_id", "chunk_id"], ties=("text", "engine", "start"))
    named = lanes.where("text IS NOT NULL AND `start` IS NOT NULL AND speaker IS NOT NULL").select("video_id", "speaker", "chunk_id", F.floor(F.col("start") * 1000 + 0.5).alias("start"), T.tokens(F.col("text")).alias("tokens"))
    return lane_words(named).groupBy("video_id", "chunk_id").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("ms"))


def _status(spark, directory):
    """Stand-ins for noted statuses, by rules on the recordings' names; ``denoise`` is a stage no more."""
    jobs = turns(spark, directory).select(F.col("video_id").alias("job")).distinct()
    names = [*S.STAGES, "denoise", "beats", "tones"]
    k, rows = F.col("k"), jobs.select("job", F.posexplode(F.array(*map(F.lit, names))).alias("k", "name"))
    word = F.get(F.array(*map(F.lit, [S.DONE, S.RUNNING, S.QUEUED, S.ERROR, S.PENDING])), ((F.length("job") * 7 + F.ascii(F.substring("job", -1, 1)) * 3 + k * 5 + F.floor(k / 3) * 2) % 5).cast("int"))
    return rows.select("job", F.when(k < 8, "stage").otherwise("detector").alias("kind"), "name", word.alias("status"), F.lit("").alias("msg"), (k.cast("double") / 10).alias("progress"))


def _markers(spark, directory):
    there = {"diarize": "speakers", "asr": "lane_transcripts", "segment": "segments", "export": "dataset"}
    parts = {stage: table(spark, directory, name).select(F.col("video_id").alias("job")) for stage, name in there.items()}
    return R.union_all(parts, "name").distinct()


def stage_status(spark, directory):
    return S.reconciled(S.recovered(_status(spark, directory)), _markers(spark, directory))


def queue_summary(spark, directory):
    return S.queue_summary(_status(spark, directory))


def job_summary(spark, directory):
    return S.job_summary(stage_status(spark, directory), samples(spark, directory))


QUERIES = {f.__name__: f for f in (chunk_aligned, engine_default, dropped_short, longest_overlaps, segments_by_start, speakers_by_rows, lane_owners, clean_speakers, romanized_tokens, window_verdicts, rescued_regions, clean_forbidden, masked_forbidden, clip_levels, solo_snippets, lane_word_counts, stage_status, queue_summary, job_summary)}

_R3 = "floor(({}) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE"
_NAMES = """lanes AS (SELECT DISTINCT video_id, name FROM (SELECT video_id, unnest([speaker, 'sam_' || regexp_replace(lower(speaker), '[^a-z0-9]+', '_', 'g') || '_clean', 'original', 'sam_old_name_clean']) AS name FROM (SELECT DISTINCT video_id, speaker FROM spans)) WHERE name NOT LIKE '%03%clean')"""
_CLEAN = "nullif(upper(regexp_extract(name, '^sam_(speaker_\\d+)_clean', 1)), '')"
_LANE = [
    *_PASTE,
    """win AS (SELECT DISTINCT video_id, speaker, unnest(range(s // 10000, greatest(s // 10000, (e - 1) // 10000) + 1)) AS "window" FROM suspect)""",
    """streams AS (SELECT video_id, speaker, "window", k AS stream, CASE WHEN ("window" + k) % 11 > 0 THEN (("window" * 13 + k * 29 + length(video_id)) % 97) / 97.0::DOUBLE END AS similarity, (("window" + k) % 7) * 0.001::DOUBLE AS rms
         FROM win, (SELECT unnest(range(2))::INTEGER AS k))""",
    f"""verdict AS (SELECT video_id, speaker, "window", stream, purity, purity >= 0.55::DOUBLE AS pass FROM (
         SELECT *, CASE WHEN rms < 0.003::DOUBLE THEN 1.0::DOUBLE WHEN similarity IS NOT NULL THEN {_R3.format("similarity")} END AS purity,
           row_number() OVER (PARTITION BY video_id, speaker, "window" ORDER BY coalesce(similarity, -2) DESC, stream) AS r FROM streams) WHERE r = 1)""",
    """kept AS (SELECT p.video_id, p.speaker, p.s, p.e FROM p JOIN verdict v ON v.video_id = p.video_id AND v.speaker = p.speaker AND v."window" = p."window" WHERE v.pass)""",
    merged("rescued", "kept", 50),
]
_STAGES = ", ".join(f"'{x}'" for x in S.STAGES)
_NOTED = f"""noted AS (SELECT job, CASE WHEN k < 8 THEN 'stage' ELSE 'detector' END AS kind, name, ['done', 'running', 'queued', 'error', 'pending'][(length(job) * 7 + ascii(right(job, 1)) * 3 + k * 5 + (k // 3) * 2) % 5 + 1] AS status, '' AS msg, k / 10.0::DOUBLE AS progress
  FROM (SELECT job, unnest(range(10))::INTEGER AS k, unnest([{_STAGES}, 'denoise', 'beats', 'tones']) AS name FROM (SELECT DISTINCT video_id AS job FROM turns)))"""
_STATUS = [
    _NOTED,
    f"""after_crash AS (SELECT job, kind, name, CASE WHEN status = 'running' OR (kind = 'detector' AND status = 'queued') THEN 'error' WHEN kind = 'stage' AND status = 'queued' THEN 'pending' ELSE status END AS status,
      CASE WHEN status = 'running' OR (kind = 'detector' AND status = 'queued') THEN '{S.INTERRUPTED}' ELSE msg END AS msg, progress FROM noted)""",
    """there AS (SELECT DISTINCT job, name FROM (SELECT video_id AS job, 'diarize' AS name FROM speakers UNION ALL SELECT video_id, 'asr' FROM lane_transcripts UNION ALL SELECT video_id, 'segment' FROM segments UNION ALL SELECT video_id, 'export' FROM dataset))""",
    f"""stages AS (SELECT o.job, o.place, o.name, CASE WHEN t.job IS NOT NULL THEN 'done' WHEN a.status = 'done' THEN 'pending' ELSE coalesce(a.status, 'pending') END AS status,
      CASE WHEN (t.job IS NOT NULL) <> (coalesce(a.status, '') = 'done') THEN '' ELSE a.msg END AS msg,
      CASE WHEN t.job IS NOT NULL AND coalesce(a.status, '') <> 'done' THEN 1.0 WHEN t.job IS NULL AND a.status = 'done' THEN 0.0 ELSE a.progress END AS progress
      FROM (SELECT job, unnest(range(7))::INTEGER AS place, unnest([{_STAGES}]) AS name FROM (SELECT DISTINCT job FROM after_crash)) o
      LEFT JOIN after_crash a ON a.job = o.job AND a.name = o.name AND a.kind = 'stage' LEFT JOIN there t ON t.job = o.job AND t.name = o.name)""",
]

ORACLE = {
    "solo_snippets": query(
        """SELECT video_id, speaker, s, least(e, s + 5000) AS e FROM (SELECT *, row_number() OVER (PARTITION BY video_id, speaker ORDER BY s, e) AS r FROM d WHERE e - s >= 1000) WHERE r <= 8
           UNION ALL SELECT video_id, speaker, s, least(e, s + 5000) FROM (SELECT *, row_number() OVER (PARTITION BY video_id, speaker ORDER BY e - s DESC, s) AS r FROM d
             WHERE (video_id, speaker) NOT IN (SELECT (video_id, speaker) FROM d WHERE e - s >= 1000)) WHERE r <= 4""",
        _them("them", 0), *_minus("d", "turns", "them"),
    ),
    "lane_word_counts": query("SELECT video_id, chunk_id, count(*) AS n, sum(40 + 60 * length(w))::BIGINT AS ms FROM (SELECT video_id, chunk_id, unnest(l) AS w FROM lane) GROUP BY ALL", CHUNKS),
    "chunk_aligned": query(
        f"""SELECT seg_id, speech, island, CASE WHEN i IS NULL THEN 'clean' WHEN n_skipped > 0 THEN 'digits_uncertain' WHEN longest <= 1500 THEN 'filler_suspect' ELSE 'major_gap' END AS status, {_R3.format("1 - island / nullif(speech, 0)::DOUBLE")} AS aligned_frac FROM (
              SELECT w.seg_id, w.speech, w.n_skipped, i.seg_id AS i, coalesce(i.island, 0)::BIGINT AS island, i.longest FROM (SELECT seg_id, max(e) AS speech, count(*) FILTER (NOT regexp_matches(w, '\\p{{L}}')) AS n_skipped FROM words GROUP BY seg_id) w
              LEFT JOIN (SELECT seg_id, sum(e - s) AS island, max(e - s) AS longest FROM islands GROUP BY seg_id) i ON i.seg_id = w.seg_id)"""
    ),
    "engine_default": "SELECT video_id, chunk_id, coalesce(max(engine), 'lane') AS asr FROM lane_transcripts WHERE video_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL",
    "dropped_short": query("SELECT video_id, count(*) FILTER (e - s >= 2500) AS kept, count(*) FILTER (e - s < 2500) AS dropped, coalesce(sum(e - s) FILTER (e - s < 2500), 0)::BIGINT / 1000.0::DOUBLE AS dropped_s FROM spans GROUP BY video_id"),
    "longest_overlaps": query("SELECT video_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, e) AS r FROM sweep) WHERE r <= 200", _SWEEP),
    "segments_by_start": query("SELECT video_id, seg_id, row_number() OVER (PARTITION BY video_id ORDER BY s, seg_id) - 1 AS place FROM clips WHERE s IS NOT NULL AND video_id IS NOT NULL"),
    "speakers_by_rows": query("SELECT speaker, n, row_number() OVER (ORDER BY n DESC, speaker)::INTEGER AS place FROM (SELECT speaker, count(*) AS n FROM samples WHERE speaker IS NOT NULL GROUP BY speaker)"),
    "lane_owners": query(
        f"SELECT DISTINCT name, coalesce(nullif(upper(regexp_extract(name, '(?i)^(?:sam_)?(speaker_\\d+)', 1)), ''), CASE WHEN starts_with(name, 'SPEAKER_') THEN name END) AS owner, {_CLEAN} AS clean_of FROM lanes", _NAMES
    ),
    "clean_speakers": query(f"SELECT video_id, list_sort(list_distinct(list({_CLEAN}) FILTER ({_CLEAN} IS NOT NULL))) AS speakers FROM lanes GROUP BY video_id", _NAMES),
    "romanized_tokens": query(r"SELECT seg_id, count(*) AS n, count(*) AS n_alignable FROM words WHERE regexp_matches(w, '[\x{905}-\x{939}]') GROUP BY seg_id"),
    "window_verdicts": query("SELECT * FROM verdict", *_LANE),
    "rescued_regions": query("SELECT * FROM rescued", *_LANE),
    "clean_forbidden": query(
        "SELECT * FROM m", *_LANE,
        """closed AS (SELECT video_id, speaker, "window" * 10000 AS s, ("window" + 1) * 10000 AS e FROM verdict WHERE NOT pass UNION ALL SELECT video_id, speaker, s - 60, e + 60 FROM rescued)""",
        merged("m", "closed"),
    ),
    "masked_forbidden": query("SELECT * FROM m", _them("them", 150), merged("m", "them")),
    "clip_levels": query(
        f"""SELECT seg_id, n > 20000 AS over_len, floor(ms / 1000.0::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS separated_s, ms > 50 AS separated, {_R3.format("ms / n::DOUBLE")} AS separated_frac FROM (
              SELECT c.seg_id, any_value(c.e - c.s) AS n, coalesce(sum(CASE WHEN r.s IS NOT NULL THEN least(c.e, r.e) - greatest(c.s, r.s) END), 0)::BIGINT AS ms FROM spans c
              LEFT JOIN rescued r ON r.video_id = c.video_id AND r.speaker = c.speaker AND c.s < r.e AND r.s < c.e GROUP BY c.seg_id)""",
        *_LANE,
    ),
    "stage_status": query("SELECT * FROM stages", *_STATUS),
    "queue_summary": query(
        """SELECT count(*) FILTER (status = 'queued') AS queue_len, count(*) FILTER (status = 'running') AS running, arg_min(job, o) FILTER (status = 'running') AS job, arg_min(kind, o) FILTER (status = 'running') AS kind, arg_min(name, o) FILTER (status = 'running') AS name
           FROM (SELECT *, row_number() OVER (ORDER BY kind <> 'stage', job, name) AS o FROM noted)""",
        _NOTED,
    ),
    "job_summary": query(
        """SELECT s.job, s.done, s.failed, s.next_stage, coalesce(d.n, 0) AS n_rows, floor(coalesce(d.ms, 0)::BIGINT / 6000.0::DOUBLE + 0.5) / 10.0::DOUBLE AS minutes FROM (
             SELECT job, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS failed, arg_min(name, place) FILTER (status <> 'done') AS next_stage FROM stages GROUP BY job) s
           LEFT JOIN (SELECT video_id, count(*) AS n, sum(floor(dur * 1000 + 0.5)::BIGINT) AS ms FROM samples GROUP BY video_id) d ON d.video_id = s.job""",
        *_STATUS,
    ),
}
