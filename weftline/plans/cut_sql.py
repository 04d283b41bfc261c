"""SQL of word_cut_segments: the cutter on rows, with recursion where one decision needs the one before."""

from __future__ import annotations

from weftline.plans.views import WS, query

_K = "video_id, chunk_id"


def _on(a: str, b: str) -> str:
    return f"{a}.video_id = {b}.video_id AND {a}.chunk_id = {b}.chunk_id"


CHUNKS = rf"""lane AS MATERIALIZED (SELECT video_id, chunk_id, speaker, floor("start" * 1000 + 0.5)::BIGINT AS start, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS l FROM (
         SELECT *, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY written_at DESC NULLS LAST, text DESC NULLS LAST, engine DESC NULLS LAST, "start" DESC NULLS LAST) AS rn
         FROM lane_transcripts WHERE video_id IS NOT NULL AND chunk_id IS NOT NULL) WHERE rn = 1 AND text IS NOT NULL AND "start" IS NOT NULL AND speaker IS NOT NULL)"""
_VIEWS = [
    CHUNKS,
    f"""spelt AS MATERIALIZED (SELECT *, e - d AS s, lead(e - d) OVER (PARTITION BY {_K} ORDER BY i) AS after FROM (
         SELECT *, (start + sum(g + d) OVER (PARTITION BY {_K} ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM (
           SELECT *, CASE WHEN (i * 131 + length(w) * 17) % 7 = 0 THEN (i * 97 + length(w) * 13) % 1900 ELSE 50 END AS g, 40 + 60 * length(w) AS d FROM (
             SELECT video_id, chunk_id, speaker, start, len(l) AS n, unnest(range(len(l)))::INTEGER AS i, unnest(l) AS w FROM lane)))""" + ")",
    f"sound AS MATERIALIZED (SELECT {_K}, e + 50 AS s, after - 50 AS e FROM spelt WHERE after - e >= 300 AND (i + length(w)) % 5 = 0)",
    r"said AS MATERIALIZED (SELECT * FROM spelt WHERE regexp_matches(w, '\p{L}'))",
    f"bound AS MATERIALIZED (SELECT {_K}, speaker, min(s) AS a, max(e) AS b FROM said GROUP BY ALL)",
    """beside AS MATERIALIZED (SELECT c.video_id, c.chunk_id, max(w.e) FILTER (w.e < c.a) AS prev_end, min(w.s) FILTER (w.s > c.b) AS next_start
         FROM bound c JOIN said w ON w.video_id = c.video_id AND w.speaker = c.speaker GROUP BY ALL)""",
    f"""word AS MATERIALIZED (SELECT w.video_id, w.chunk_id, w.speaker, w.start, w.i, w.s, w.e, coalesce(lag(w.e) OVER o, x.prev_end) AS before, coalesce(lead(w.s) OVER o, x.next_start) AS behind
         FROM said w JOIN beside x ON {_on("x", "w")} WINDOW o AS (PARTITION BY w.video_id, w.chunk_id ORDER BY w.s, w.i))""",
    """voice AS MATERIALIZED (SELECT c.video_id, c.chunk_id, t.s, t.e FROM bound c JOIN turns t ON t.video_id = c.video_id AND t.speaker <> c.speaker AND c.a - 1 < t.e + 150 AND t.s - 150 < c.b + 1)""",
    f"shut AS MATERIALIZED (SELECT {_K}, s - 150 AS s, e + 150 AS e FROM voice UNION ALL SELECT {_K}, s + 50, e - 50 FROM word WHERE e - s > 2000)",
    f"""good AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY s, i) - 1 AS u, lag(e) OVER (PARTITION BY {_K} ORDER BY s, i) AS pe FROM word w
         WHERE e - s <= 2000 AND NOT EXISTS (SELECT 1 FROM shut x WHERE {_on("x", "w")} AND (w.s BETWEEN x.s AND x.e OR w.e BETWEEN x.s AND x.e)))""",
    f"""joined AS (SELECT *, sum(new) OVER (PARTITION BY {_K} ORDER BY u ROWS UNBOUNDED PRECEDING) AS g FROM (
         SELECT *, CASE WHEN pe IS NULL OR s - pe >= 600 OR EXISTS (SELECT 1 FROM shut x WHERE {_on("x", "w")} AND x.s < w.s AND x.e > w.pe) THEN 1 ELSE 0 END AS new FROM good w))""",
    f"""team AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY a) AS r, pe IS NOT NULL AND s - pe <= 2000
           AND coalesce((SELECT sum(greatest(0, least(t.s, v.e) - greatest(t.pe, v.s))) FROM voice v WHERE {_on("v", "t")}), 0) <= 600
           AND NOT EXISTS (SELECT 1 FROM shut x WHERE {_on("x", "t")} AND x.s < t.s AND x.e > t.pe) AS open
         FROM (SELECT {_K}, min(u) AS a, max(u) + 1 AS b, min(s) AS s, arg_max(e, u) AS e, arg_min(pe, u) AS pe FROM joined GROUP BY {_K}, g) t)""",
    f"""bridge AS (
         SELECT {_K}, r, a, b, s AS cs, a AS ca FROM team WHERE r = 1
         UNION ALL SELECT t.video_id, t.chunk_id, t.r, t.a, t.b, CASE WHEN t.open AND least(t.pe - f.cs, t.e - t.s) < 1000 THEN f.cs ELSE t.s END, CASE WHEN t.open AND least(t.pe - f.cs, t.e - t.s) < 1000 THEN f.ca ELSE t.a END
         FROM bridge f JOIN team t ON {_on("t", "f")} AND t.r = f.r + 1)""",
    f"""part AS (
         SELECT {_K}, ca AS a, max(b) AS b FROM bridge GROUP BY {_K}, ca
         UNION ALL SELECT video_id, chunk_id, unnest([a, c]), unnest([c, b]) FROM (
           SELECT p.video_id, p.chunk_id, p.a, p.b, max({{'gap': w.s - w.pe, 'u': w.u}}).u AS c FROM part p
           JOIN good x ON {_on("x", "p")} AND x.u = p.a JOIN good y ON {_on("y", "p")} AND y.u = p.b - 1
           JOIN good w ON {_on("w", "p")} AND w.u > p.a AND w.u < p.b
             AND (greatest(1, (p.b - p.a) * 4 // 5) <= greatest(1, (p.b - p.a) // 5) OR w.u - p.a >= greatest(1, (p.b - p.a) // 5) AND w.u - p.a < greatest(1, (p.b - p.a) * 4 // 5))
           WHERE y.e - x.s > 20000 AND p.b - p.a >= 2 GROUP BY ALL))""",
    f"""whole AS MATERIALIZED (SELECT DISTINCT p.video_id, p.chunk_id, p.a, p.b FROM part p JOIN good x ON {_on("x", "p")} AND x.u = p.a JOIN good y ON {_on("y", "p")} AND y.u = p.b - 1 WHERE y.e - x.s <= 20000 OR p.b - p.a < 2)""",
    f"""begun AS (SELECT p.*, min(w.u) AS k0 FROM whole p JOIN good w ON {_on("w", "p")} AND w.u >= p.a AND w.u < p.b WHERE w.before IS NULL OR w.s - w.before >= 115 GROUP BY ALL)""",
    f"""ended AS (SELECT p.*, max(w.u) AS k1 FROM begun p JOIN good w ON {_on("w", "p")} AND w.u >= p.k0 AND w.u < p.b WHERE w.behind IS NULL OR w.behind - w.e >= 115 GROUP BY ALL)""",
    f"""core AS MATERIALIZED (SELECT p.video_id, p.chunk_id, p.k0, p.k1, x.speaker, x.start, x.s AS w0, y.e AS w1, y.i AS last, x.before, y.behind, min(w.i) AS mi, max(w.i) AS ma, count(*) AS nw, sum(w.e - w.s) AS spoken
         FROM ended p JOIN good x ON {_on("x", "p")} AND x.u = p.k0 JOIN good y ON {_on("y", "p")} AND y.u = p.k1 JOIN good w ON {_on("w", "p")} AND w.u BETWEEN p.k0 AND p.k1 WHERE y.e - x.s >= 1000 GROUP BY ALL)""",
    f"""owned AS MATERIALIZED (SELECT c.*, CASE WHEN c.mi > (SELECT min(i) FROM said w WHERE {_on("w", "c")}) THEN c.mi ELSE 0 END AS i0,
           coalesce((SELECT min(i) FROM said w WHERE {_on("w", "c")} AND w.i > c.ma), (SELECT max(n) FROM spelt w WHERE {_on("w", "c")}))::INTEGER - 1 AS i1 FROM core c)""",
    f"""timed_clip AS MATERIALIZED (SELECT *, greatest(w0 - 150, coalesce(before + 100, 0), 0) AS c0,
           least(greatest(w1 + 200, CASE WHEN i1 > last THEN coalesce((SELECT arg_min(x.e, (x.s, x.e)) + 100 FROM sound x WHERE {_on("x", "o")} AND x.s BETWEEN o.w1 - 200 AND o.w1 + 1000), 0) ELSE 0 END), coalesce(behind - 100, 9000000000000000)) AS te,
           row_number() OVER (PARTITION BY video_id, speaker ORDER BY start, chunk_id, k0) AS r FROM owned o)""",
    """placed AS (
         SELECT video_id, speaker, r, c0 AS ts, te - c0 >= 1000 AS kept, CASE WHEN te - c0 >= 1000 THEN te END AS upto, CASE WHEN te - c0 >= 1000 THEN 1 ELSE 0 END AS n FROM timed_clip WHERE r = 1
         UNION ALL SELECT video_id, speaker, r, ts, te - ts >= 1000, CASE WHEN te - ts >= 1000 THEN te ELSE upto END, n + CASE WHEN te - ts >= 1000 THEN 1 ELSE 0 END FROM (
           SELECT c.video_id, c.speaker, c.r, c.te, f.upto, f.n, greatest(c.c0, coalesce(f.upto + 10, 0)) AS ts FROM placed f JOIN timed_clip c ON c.video_id = f.video_id AND c.speaker = f.speaker AND c.r = f.r + 1))""",
    """clip AS MATERIALIZED (SELECT c.*, p.ts, p.n - 1 AS n FROM timed_clip c JOIN placed p ON p.video_id = c.video_id AND p.speaker = c.speaker AND p.r = c.r WHERE p.kept)""",
    f"""heard AS (SELECT c.video_id, c.chunk_id, c.k0, count(*) AS m, max(least(x.e, c.te) - greatest(x.s, c.ts)) AS longest, sum(least(x.e, c.te) - greatest(x.s, c.ts)) AS total
         FROM clip c JOIN sound x ON {_on("x", "c")} AND x.e > c.ts AND x.s < c.te GROUP BY ALL)""",
    f"""line AS (SELECT c.video_id, c.chunk_id, c.k0, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM clip c JOIN spelt w ON {_on("w", "c")} AND w.i BETWEEN c.i0 AND c.i1 GROUP BY ALL)""",
]

WORD_CUT = query(
    f"""SELECT c.video_id, c.speaker, c.n::INTEGER AS n, c.chunk_id, c.ts::BIGINT AS s, c.te::BIGINT AS e, t.text,
          CASE WHEN h.m IS NULL THEN 'clean' WHEN c.i1 - c.i0 + 1 > c.nw THEN 'digits_uncertain' WHEN h.longest <= 1500 THEN 'filler_suspect' ELSE 'major_gap' END AS status,
          list_filter([CASE WHEN c.w0 - c.ts <= 15 THEN 'start' END, CASE WHEN c.w1 >= c.te - 15 THEN 'end' END], lambda x: x IS NOT NULL) AS clipped,
          floor(c.spoken / (c.spoken + coalesce(h.total, 0))::DOUBLE * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS aligned_frac
        FROM clip c JOIN line t ON {_on("t", "c")} AND t.k0 = c.k0 LEFT JOIN heard h ON {_on("h", "c")} AND h.k0 = c.k0""",
    *_VIEWS,
    recursive=True,
)
