"""Queries on words, islands, texts and ids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import intervals, rows
from weftline.operators import words as W
from weftline.plans.views import WS, candidates, islands, query, samples, spans, texts, turns, words
from weftline.runtime import checkpoint, table

KEY = ["seg_id"]


def pause_silence(spark, directory):
    return W.pauses(words(spark, directory), KEY)


def beats_pauses(spark, directory):
    return W.silent_pauses(words(spark, directory), islands(spark, directory), KEY)


def beats_hesitates(spark, directory):
    return W.hesitations(words(spark, directory), islands(spark, directory), KEY)


def beats_stammers(spark, directory):
    return W.stammers(words(spark, directory), KEY)


def island_cluster(spark, directory):
    return W.island_clusters(islands(spark, directory), KEY, 9000)


def island_status(spark, directory):
    return W.alignment_status(words(spark, directory), islands(spark, directory), KEY, 500)


def status_histogram(spark, directory):
    return W.alignment_status(words(spark, directory), islands(spark, directory), KEY, 500).groupBy("status").agg(F.count("*").alias("n"))


def clipped_edges(spark, directory):
    dur = spans(spark, directory).select("seg_id", (F.col("e") - F.col("s")).alias("dur"))
    return W.clipped_edges(words(spark, directory).join(dur, "seg_id"), KEY, "dur")


def token_ownership(spark, directory):
    return W.token_owner(words(spark, directory).select("seg_id", "i", "w"), KEY, F.col("w").rlike(r"\p{L}"))


def word_groups(spark, directory):
    return W.word_groups(words(spark, directory), islands(spark, directory), KEY)


def bridge_groups(spark, directory):
    return W.bridge_groups(W.word_groups(words(spark, directory), islands(spark, directory), KEY), KEY)


def edge_sacrifice(spark, directory):
    w = words(spark, directory)
    return W.clean_edges(w, W.word_groups(w, islands(spark, directory), KEY, gap=100), KEY)


def lane_words(lanes):
    """(video_id, speaker, chunk_id, i, w, s, e, next_s) of every token of the lane transcripts, timed from the chunk's start as in views.words."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id", "chunk_id").orderBy("i")
    n = F.length("w")
    gap = F.when((F.col("i") * 131 + n * 17) % 7 == 0, (F.col("i") * 97 + n * 13) % 1900).otherwise(50)
    at = lanes.select("video_id", "speaker", "chunk_id", "start", F.posexplode("tokens").alias("i", "w")).withColumn("e", (F.sum(gap + 40 + 60 * n).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("start")).cast("long"))
    timed = at.withColumn("s", (F.col("e") - 40 - 60 * n).cast("long"))
    return timed.withColumn("next_s", F.lead("s").over(w)).drop("start")


def _word_lists(lanes):
    """(video_id, chunk_id, speaker, words, islands, first, last): the words with letters of each chunk, its islands, and the bounds of its words."""
    spoken = F.col("w").rlike(r"\p{L}")
    quiet = (F.col("next_s") - F.col("e") >= 300) & ((F.col("i") + F.length("w")) % 5 == 0)
    island = F.struct((F.col("e") + 50).alias("s"), (F.col("next_s") - 50).alias("e"))
    return lane_words(lanes).groupBy("video_id", "chunk_id", "speaker").agg(
        F.collect_list(F.when(spoken, F.struct("i", "s", "e"))).alias("words"), F.array_sort(F.collect_list(F.when(quiet, island))).alias("islands"),
        F.min(F.when(spoken, F.col("s"))).alias("first"), F.max(F.when(spoken, F.col("e"))).alias("last"),
    )


def _neighbours(lists, at):
    """(video_id, speaker, t, prev_end, next_start) of the first start and the last end of each chunk in ``at``, over all words of the speaker.

    Of chunks that lie wholly before or behind t only the bounds matter; words are looked
    at only in those that t lies in.
    """
    chunk, who = ["video_id", "chunk_id"], ["video_id", "speaker"]
    points = at.select(*who, F.col("chunk_id").alias("own"), F.explode(F.array("first", "last")).alias("t"))
    outer = intervals.as_of(points, at.select(*who, F.col("first").alias("s"), F.col("last").alias("e")), who)
    spans = at.select(*who, "chunk_id", F.col("first").alias("rs"), F.col("last").alias("re"))
    inside = intervals.overlap_join(points.withColumns({"s": F.col("t") - 1, "e": F.col("t") + 1}), spans, who).where("own <> chunk_id")
    asked = inside.groupBy(*chunk).agg(F.collect_set("t").alias("asked"))
    words = lists.select(*who, "chunk_id", "words").join(asked, chunk)
    ends = F.array_max(F.transform(F.filter("words", lambda x: x.e < F.col("t")), lambda x: x.e))
    starts = F.array_min(F.transform(F.filter("words", lambda x: x.s > F.col("t")), lambda x: x.s))
    inner = words.select(*who, F.explode("asked").alias("t"), "words").select(*who, "t", ends.alias("prev_end"), starts.alias("next_start"))
    return outer.unionByName(inner).groupBy(*who, "t").agg(F.max("prev_end").alias("prev_end"), F.min("next_start").alias("next_start"))


def cut_chunks(lanes, turns, guard: int = 150):
    """The chunks that cut_clips works on.

    ``lanes`` are chunks (video_id, speaker, chunk_id, start, tokens) and ``turns`` all
    turns of their recordings.  Others are the turns of other speakers at the chunk's
    words, forbidden is what lies within ``guard`` of one; prev_end and next_start are
    the nearest words of the speaker before and behind the chunk's, of all chunks.
    """
    chunk, who = ["video_id", "chunk_id"], ["video_id", "speaker"]
    lists = checkpoint(_word_lists(lanes))
    at = lists.where("first IS NOT NULL").select(*who, "chunk_id", "first", "last")
    near = _neighbours(lists, at)
    before, behind = near.select(*who, F.col("t").alias("first"), "prev_end"), near.select(*who, F.col("t").alias("last"), "next_start")
    them = turns.select("video_id", F.col("speaker").alias("other"), (F.col("s") - guard).alias("rs"), (F.col("e") + guard).alias("re"))
    # one ms more at both ends, as a word that touches a region lies in it
    heard = intervals.overlap_join(at.select(*who, "chunk_id", (F.col("first") - 1).alias("s"), (F.col("last") + 1).alias("e")), them, ["video_id"]).where("speaker <> other")
    regions = heard.groupBy(*chunk).agg(F.array_sort(F.collect_list(F.struct(F.col("rs").alias("s"), F.col("re").alias("e")))).alias("forbidden"))
    voices = F.transform("forbidden", lambda x: F.struct((x.s + guard).alias("s"), (x.e - guard).alias("e")))
    known = at.join(regions, chunk, "left").join(before, [*who, "first"], "left").join(behind, [*who, "last"], "left").select(*chunk, "forbidden", voices.alias("others"), "prev_end", "next_start")
    full = lists.select(*chunk, "words", "islands").join(known, chunk, "left")
    return lanes.join(full, chunk, "left").select("video_id", "speaker", "chunk_id", "start", "tokens", "words", "islands", "forbidden", "others", "prev_end", "next_start")


def word_cut_segments(spark, directory):
    """Clips cut anew from the words of the lane transcripts, a chunk at a time, beside the other speakers' turns and the words of neighbouring chunks."""
    lanes = rows.latest(table(spark, directory, "lane_transcripts"), ["video_id", "chunk_id"], ties=("text", "engine", "start"))
    named = lanes.where("text IS NOT NULL AND `start` IS NOT NULL AND speaker IS NOT NULL").select("video_id", "speaker", "chunk_id", F.floor(F.col("start") * 1000 + 0.5).alias("start"), T.tokens(F.col("text")).alias("tokens"))
    return W.cut_clips(cut_chunks(named, turns(spark, directory))).select("video_id", "speaker", "n", "chunk_id", "s", "e", "text", "status", "clipped", "aligned_frac")


def script_profile(spark, directory):
    return texts(spark, directory).select("seg_id", T.script_profile(F.col("text")).alias("p")).select("seg_id", "p.*")


def token_norm(spark, directory):
    w = words(spark, directory).select(T.norm_token(F.col("w")).alias("norm")).where("norm <> ''")
    return w.groupBy("norm").agg(F.count("*").alias("n"))


def alignable_tokens(spark, directory):
    a = T.alignable(F.col("w"))
    return words(spark, directory).groupBy("seg_id").agg(F.count_if(a != "").alias("n_alignable"), F.count_if(a == "").alias("n_skipped"))


def filler_counts(spark, directory):
    t = texts(spark, directory)
    return t.groupBy("asr").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("misses"), F.sum(T.filler_count(F.col("text"))).cast("long").alias("fillers"))


def slug_ids(spark, directory):
    s = spans(spark, directory).select("video_id", "speaker").distinct()
    stem = F.concat("video_id", F.lit(" .é"), "speaker")
    return s.select("video_id", "speaker", T.slug(F.col("speaker")).alias("slug"), T.job_id(stem, F.col("video_id")).alias("job"), T.job_id(stem, F.col("video_id"), True).alias("server_job"))


def video_id_extract(spark, directory):
    v = spans(spark, directory).select("video_id").distinct()
    forms = F.array(*(F.concat(F.lit(a), "video_id", F.lit(b)) for a, b in (("https://www.youtube.com/watch?v=", ""), ("https://youtu.be/", "?t=4"), ("https://youtube.com/shorts/", ""), ("https://www.youtube.com/watch?list=x&v=", "&a=b"), ("https://example.com/", ""))))
    return v.select("video_id", F.posexplode(forms).alias("form", "url")).select("video_id", "form", T.video_id(F.col("url")).alias("found"))


def hash_split(spark, directory):
    return samples(spark, directory).where("video_id IS NOT NULL").select("video_id").distinct().select("video_id", T.split_of(F.col("video_id")).alias("split"))


def clock_labels(spark, directory):
    return spans(spark, directory).select("seg_id", T.clock(F.col("s") / 1000).alias("at"))


def lane_labels(spark, directory):
    s = spans(spark, directory).select("speaker").distinct()
    forms = F.array("speaker", F.concat(F.lit("sam_"), T.slug(F.col("speaker")), F.lit("_clean")), F.concat(F.lit("sam_"), T.slug(F.col("speaker")), F.lit("_clean_sepformer")), F.lit("original"), F.lit("denoised"), F.lit("sam_old_name_clean"), F.lit("other"))
    return s.select(F.explode(forms).alias("name")).distinct().select("name", T.lane_label(F.col("name")).alias("label"))


def evidence_fields(spark, directory):
    """Fields of the candidates' evidence, which differ by detector."""
    c = candidates(spark, directory).where("try_parse_json(evidence) IS NOT NULL").select("detector", F.explode(F.json_object_keys("evidence")).alias("field"))
    return c.groupBy("detector", "field").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (pause_silence, beats_pauses, beats_hesitates, beats_stammers, island_cluster, island_status, status_histogram, clipped_edges, token_ownership, word_groups, bridge_groups, edge_sacrifice, word_cut_segments, script_profile, token_norm, alignable_tokens, filler_counts, slug_ids, video_id_extract, hash_split, clock_labels, lane_labels, evidence_fields)}

_R3 = "floor(({}) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE"
_NORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200C}}\x{{200D}}\x{{900}}-\x{{97F}}]', '', 'g')"
_FILLERS = ", ".join(f"'{x}'" for x in T.FILLERS)
_PAUSES = f"""pauses AS (SELECT seg_id, CASE WHEN next_s - e >= 1500 THEN 'silence' ELSE 'pauses' END AS tag, {_R3.format("least(1.0::DOUBLE, (next_s - e) / 2000.0::DOUBLE)")} AS score,
  (e + next_s) / 2.0::DOUBLE AS mid, next_s - e AS gap FROM near WHERE next_s - e >= 500)"""
_STATUS = f"""status AS (
  SELECT *, CASE WHEN n_islands = 0 THEN 'clean' WHEN n_skipped > 0 THEN 'digits_uncertain' WHEN longest <= 500 THEN 'filler_suspect' ELSE 'major_gap' END AS status FROM (
    SELECT w.seg_id, w.n_words, w.n_skipped, coalesce(i.n, 0) AS n_islands, coalesce(i.t, 0)::BIGINT AS island, coalesce(i.m, 0)::BIGINT AS longest,
           {_R3.format("w.c / (w.c + coalesce(i.t, 0))::DOUBLE")} AS aligned_frac
    FROM (SELECT seg_id, count(*) AS n_words, count(*) FILTER (NOT regexp_matches(w, '\\p{{L}}')) AS n_skipped, sum(e - s) AS c FROM words GROUP BY seg_id) w
    LEFT JOIN (SELECT seg_id, count(*) AS n, sum(e - s) AS t, max(e - s) AS m FROM islands GROUP BY seg_id) i ON i.seg_id = w.seg_id))"""


def _groups(gap: int) -> list[str]:
    return [
        "good AS (SELECT * FROM words w WHERE e - s <= 2000 AND NOT EXISTS (SELECT 1 FROM islands x WHERE x.seg_id = w.seg_id AND (w.s BETWEEN x.s AND x.e OR w.e BETWEEN x.s AND x.e)))",
        "chained AS (SELECT *, lag(e) OVER (PARTITION BY seg_id ORDER BY i) AS l FROM good)",
        f"""cutting AS (SELECT *, CASE WHEN l IS NULL OR s - l >= {gap} OR EXISTS (SELECT 1 FROM islands x WHERE x.seg_id = c.seg_id AND x.s < c.s AND x.e > c.l) THEN 1 ELSE 0 END AS new FROM chained c)""",
        """grouped AS (SELECT seg_id, g, min(i) AS i0, max(i) AS i1, min(s) AS s, max(e) AS e, count(*) AS n FROM (
             SELECT *, sum(new) OVER (PARTITION BY seg_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS g FROM cutting) GROUP BY seg_id, g)""",
    ]


ORACLE = {
    "pause_silence": query("SELECT * FROM pauses", _PAUSES),
    "beats_pauses": query("SELECT seg_id, score, mid, gap FROM pauses p WHERE NOT EXISTS (SELECT 1 FROM islands i WHERE i.seg_id = p.seg_id AND i.s < p.mid AND p.mid < i.e)", _PAUSES),
    "beats_hesitates": query(
        f"""SELECT seg_id, 'filler' AS kind, {_R3.format("least(1.0::DOUBLE, 0.5 + g / 1000.0::DOUBLE)")} AS score, s::DOUBLE AS at FROM (
              SELECT *, greatest(coalesce(s - prev_e, 0), coalesce(next_s - e, 0)) AS g FROM near) WHERE g >= 300 AND {_NORM.format("w")} IN ({_FILLERS})
            UNION ALL SELECT seg_id, 'island', {_R3.format("least(1.0::DOUBLE, (e - s) / 1000.0::DOUBLE)")}, (s + e) / 2.0::DOUBLE FROM islands WHERE e - s BETWEEN 300 AND 1000"""
    ),
    "beats_stammers": query(f"SELECT seg_id, w AS word, s AS at, next_s - e AS gap FROM near WHERE length({_NORM.format('w')}) >= 2 AND {_NORM.format('w')} = {_NORM.format('next_w')} AND next_s - e <= 300"),
    "island_cluster": query('SELECT seg_id, "at", stop FROM (SELECT seg_id, s AS "at", stop, row_number() OVER (PARTITION BY seg_id ORDER BY s) AS r FROM (SELECT *, lead(e, 2) OVER (PARTITION BY seg_id ORDER BY s, e) AS stop FROM islands) WHERE stop - s <= 9000) WHERE r = 1'),
    "island_status": query("SELECT seg_id, n_words, n_skipped, n_islands, island, longest, status, aligned_frac FROM status", _STATUS),
    "status_histogram": query("SELECT status, count(*) AS n FROM status GROUP BY status", _STATUS),
    "clipped_edges": query(
        "SELECT w.seg_id, list_filter([CASE WHEN min(w.s) <= 15 THEN 'start' END, CASE WHEN max(w.e) >= any_value(c.e - c.s) - 15 THEN 'end' END], lambda x: x IS NOT NULL) AS clipped FROM words w JOIN spans c ON c.seg_id = w.seg_id GROUP BY w.seg_id"
    ),
    "token_ownership": query(
        r"""SELECT seg_id, i, w, coalesce(max(CASE WHEN regexp_matches(w, '\p{L}') THEN i END) OVER (PARTITION BY seg_id ORDER BY i ROWS UNBOUNDED PRECEDING),
              min(CASE WHEN regexp_matches(w, '\p{L}') THEN i END) OVER (PARTITION BY seg_id)) AS owner FROM words"""
    ),
    "word_groups": query("SELECT * FROM grouped", *_groups(600)),
    "bridge_groups": query(
        "SELECT seg_id, k, min(cs) AS s, max(e) AS e FROM fold GROUP BY seg_id, k",
        *_groups(600),
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY s, e) AS r FROM grouped)",
        """fold AS (
  SELECT seg_id, r, e, s AS cs, 0::INTEGER AS k FROM numbered WHERE r = 1
  UNION ALL
  SELECT n.seg_id, n.r, n.e, CASE WHEN (f.e - f.cs < 1000 OR n.e - n.s < 1000) AND n.s - f.e <= 2000 THEN f.cs ELSE n.s END,
         CASE WHEN (f.e - f.cs < 1000 OR n.e - n.s < 1000) AND n.s - f.e <= 2000 THEN f.k ELSE f.k + 1 END
  FROM fold f JOIN numbered n ON n.seg_id = f.seg_id AND n.r = f.r + 1)""",
        recursive=True,
    ),
    "edge_sacrifice": query(
        """SELECT seg_id, g, i0, i1 FROM (SELECT g.seg_id, g.g, min(CASE WHEN n.prev_e IS NULL OR n.s - n.prev_e >= 115 THEN n.i END) AS i0, max(CASE WHEN n.next_s IS NULL OR n.next_s - n.e >= 115 THEN n.i END) AS i1
           FROM grouped g JOIN near n ON n.seg_id = g.seg_id AND n.i BETWEEN g.i0 AND g.i1 GROUP BY g.seg_id, g.g) WHERE i0 <= i1""",
        *_groups(100),
    ),
    "script_profile": query(
        rf"""SELECT seg_id, chars::INTEGER AS chars, CASE WHEN chars > 0 THEN floor(d / chars::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE ELSE 0.0::DOUBLE END AS deva_frac,
             CASE WHEN chars > 0 THEN floor(l / chars::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE ELSE 0.0::DOUBLE END AS latin_frac, greatest(r - 1, 0)::INTEGER AS script_switches FROM (
               SELECT seg_id, length(b) AS chars, length(regexp_replace(b, '[^\x{{900}}-\x{{97F}}]', '', 'g')) AS d, length(regexp_replace(b, '[^A-Za-z]', '', 'g')) AS l,
                      length(regexp_replace(regexp_replace(regexp_replace(b, '[^\x{{900}}-\x{{97F}}A-Za-z]', '', 'g'), '[\x{{900}}-\x{{97F}}]+', '1', 'g'), '[A-Za-z]+', '2', 'g')) AS r
               FROM (SELECT seg_id, regexp_replace(coalesce(text, ''), '{WS}|\p{{P}}', '', 'g') AS b FROM texts))"""
    ),
    "token_norm": query(f"SELECT norm, count(*) AS n FROM (SELECT {_NORM.format('w')} AS norm FROM words) WHERE norm <> '' GROUP BY norm"),
    "alignable_tokens": query(r"SELECT seg_id, count(*) FILTER (a) AS n_alignable, count(*) FILTER (NOT a) AS n_skipped FROM (SELECT seg_id, regexp_matches(lower(w), '[a-z'']|[\x{901}-\x{903}\x{905}-\x{90B}\x{90D}-\x{914}\x{915}-\x{928}\x{92A}-\x{930}\x{932}\x{933}\x{935}-\x{939}\x{93E}-\x{943}\x{945}-\x{94C}\x{958}-\x{95F}\x{972}]') AS a FROM words) GROUP BY seg_id"),
    "filler_counts": query(f"SELECT asr, count(*) AS n, count(*) FILTER (coalesce(trim(text), '') = '') AS misses, sum(len(regexp_extract_all(coalesce(text, ''), '(?i){T.FILLER_PATTERN}')))::BIGINT AS fillers FROM texts GROUP BY asr"),
    "slug_ids": query(
        r"""SELECT video_id, speaker, regexp_replace(lower(speaker), '[^a-z0-9]+', '_', 'g') AS slug,
             'up_' || substr(regexp_replace(video_id || ' .é' || speaker, '[^\p{L}\p{N}_-]', '_', 'g'), 1, 40) || '_' || substr(sha256(video_id), 1, 6) AS job,
             'up_' || substr(regexp_replace(video_id || ' .é' || speaker, '[^A-Za-z0-9_-]+', '_', 'g'), 1, 40) || '_' || substr(sha256(video_id), 1, 6) AS server_job
           FROM (SELECT DISTINCT video_id, speaker FROM spans)"""
    ),
    "video_id_extract": query(
        r"""SELECT video_id, form::INTEGER AS form, nullif(regexp_extract(url, '(?:youtube\.com/(?:watch\?(?:.*&)?v=|shorts/|live/|embed/)|youtu\.be/)([A-Za-z0-9_-]{11})', 1), '') AS found FROM (
             SELECT video_id, unnest(range(5)) AS form, unnest(['https://www.youtube.com/watch?v=' || video_id, 'https://youtu.be/' || video_id || '?t=4', 'https://youtube.com/shorts/' || video_id,
               'https://www.youtube.com/watch?list=x&v=' || video_id || '&a=b', 'https://example.com/' || video_id]) AS url FROM (SELECT DISTINCT video_id FROM spans))"""
    ),
    "hash_split": query("SELECT video_id, CASE WHEN ('0x' || substr(sha256(video_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.05 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT video_id FROM samples WHERE video_id IS NOT NULL)"),
    "clock_labels": query(
        "SELECT seg_id, (s // 60000)::VARCHAR || ':' || lpad((t // 10)::VARCHAR, 2, '0') || '.' || (t % 10)::VARCHAR AS at FROM (SELECT seg_id, s, floor((s / 1000.0::DOUBLE - floor(s / 1000.0::DOUBLE / 60) * 60) * 10 + 0.5)::BIGINT AS t FROM spans)"
    ),
    "lane_labels": query(
        r"""SELECT DISTINCT name, CASE WHEN name = 'original' THEN 'Original sound' WHEN name = 'denoised' THEN 'Denoised (demucs)'
             WHEN regexp_matches(name, '^sam_speaker_\d+_clean(_\w+)?$') THEN 'Clean S' || regexp_extract(name, '^sam_speaker_(\d+)_clean', 1)
             WHEN regexp_matches(name, '^sam_.+_clean(_\w+)?$') THEN 'Clean ' || replace(regexp_extract(name, '^sam_(.+)_clean(?:_\w+)?$', 1), '_', ' ')
             WHEN starts_with(name, 'SPEAKER_') THEN replace(name, 'SPEAKER_', 'S') ELSE name END AS label
           FROM (SELECT unnest([speaker, 'sam_' || regexp_replace(lower(speaker), '[^a-z0-9]+', '_', 'g') || '_clean', 'sam_' || regexp_replace(lower(speaker), '[^a-z0-9]+', '_', 'g') || '_clean_sepformer', 'original', 'denoised', 'sam_old_name_clean', 'other']) AS name FROM (SELECT DISTINCT speaker FROM spans))"""
    ),
    "evidence_fields": query("SELECT detector, field, count(*) AS n FROM (SELECT detector, unnest(json_keys(evidence::JSON)) AS field FROM cands WHERE json_valid(evidence)) GROUP BY ALL"),
}
