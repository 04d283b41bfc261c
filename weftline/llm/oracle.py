"""SQL with the results of those llm queries that SQL can express."""

from __future__ import annotations

from weftline.plans.views import WS

_P1 = r"""
WITH RECURSIVE link AS (
  SELECT DISTINCT sample_id AS s, v FROM (
    SELECT sample_id, video_id AS v FROM dataset
    UNION ALL SELECT sample_id, regexp_extract(sample_id, '^(.+)_SPEAKER_\d+_\d+$', 1) FROM dataset)
  WHERE trim(sample_id) <> '' AND trim(v) <> ''),
edge AS (
  SELECT DISTINCT a.v AS a, b.v AS b FROM link a JOIN link b ON a.s = b.s WHERE a.v <> b.v),
reach(a, b) AS (
  SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
present AS (SELECT DISTINCT video_id AS v FROM dataset WHERE trim(video_id) <> ''),
part AS (SELECT a AS v, least(a, min(b)) AS component FROM reach GROUP BY a)
"""

_P2 = r"""
WITH goal AS (
  SELECT lower(regexp_replace(detector, '^[\s\[\]]+|[\s\[\]]+$', '', 'g')) AS detector,
         lower(regexp_replace(tag, '^[\s\[\]]+|[\s\[\]]+$', '', 'g')) AS tag, max(keep_permille)::BIGINT AS keep_permille
  FROM keep_targets WHERE detector IS NOT NULL AND tag IS NOT NULL AND keep_permille IS NOT NULL GROUP BY 1, 2),
last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY written_at DESC NULLS LAST, detector DESC NULLS LAST, tag DESC NULLS LAST, score DESC NULLS LAST) AS rn
                 FROM candidates WHERE cand_id IS NOT NULL) WHERE rn = 1),
hit AS (
  SELECT l.cand_id, g.detector, g.tag, g.keep_permille, l.score FROM last l JOIN goal g
    ON g.detector = lower(regexp_replace(l.detector, '^[\s\[\]]+|[\s\[\]]+$', '', 'g'))
   AND g.tag = lower(regexp_replace(l.tag, '^[\s\[\]]+|[\s\[\]]+$', '', 'g'))
  WHERE l.score >= 0 AND l.score <= 1 AND NOT isnan(l.score)),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY detector, tag) AS n, count(*) OVER (PARTITION BY detector, tag ORDER BY score DESC) AS above FROM hit),
cut AS (
  SELECT detector, tag, max(keep_permille) AS keep_permille, max(n) AS counted, max(score) AS cutoff
  FROM counted WHERE above * 1000 >= keep_permille * n GROUP BY detector, tag)
"""


# Windows of three words with an earlier like, words and pairs behind themselves, and units three times in a row within a word.
_P3 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, * FROM (
    SELECT 'transcripts' AS tbl, video_id, seg_id AS rec_id, text FROM transcripts UNION ALL SELECT 'lane_transcripts', video_id, chunk_id, text FROM lane_transcripts)),
listed AS MATERIALIZED (SELECT d, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '\p{Cf}+', '', 'g')), '[\p{L}\p{M}\p{N}]+') AS l FROM doc),
word AS MATERIALIZED (SELECT d, unnest(range(len(l))) AS i, unnest(l) AS w FROM listed),
near AS (SELECT *, lag(w) OVER o AS b1, lag(w, 2) OVER o AS b2, lag(w, 3) OVER o AS b3, lead(w) OVER o AS n1, lead(w, 2) OVER o AS n2 FROM word WINDOW o AS (PARTITION BY d ORDER BY i)),
later AS (
  SELECT d, i FROM (SELECT d, i, row_number() OVER (PARTITION BY d, w, n1, n2 ORDER BY i) AS k FROM near WHERE n2 IS NOT NULL) WHERE k > 1),
covered AS (
  SELECT d, i + j AS i FROM later, (SELECT unnest(range(3)) AS j)
  UNION SELECT d, i FROM near WHERE w = b1
  UNION SELECT d, i FROM near WHERE w = b2 AND n1 = b1
  UNION SELECT d, i FROM near WHERE w = b2 AND b1 = b3),
tested AS (SELECT w, length(w) AS m FROM (SELECT DISTINCT w FROM word) WHERE length(w) >= 3),
cut AS (SELECT w, p, unnest(range(1, m - 3 * p + 2)) AS a FROM (SELECT w, m, unnest(range(1, m // 3 + 1)) AS p FROM tested)),
run AS (
  SELECT DISTINCT w, unnest(range(a + p, a + 3 * p)) AS pos FROM cut
  WHERE substr(w, a, 2 * p) = substr(w, a + p, 2 * p) AND NOT regexp_matches(substr(w, a, 3 * p), '\p{N}')),
gain AS (SELECT w, count(*) AS g FROM run WHERE NOT regexp_matches(substr(w, pos, 1), '\p{M}') GROUP BY w),
share AS (
  SELECT x.d, sum(CASE WHEN c.d IS NOT NULL THEN x.n ELSE coalesce(g.g, 0) END) / greatest(1, sum(x.n)) AS share
  FROM (SELECT d, i, w, length(regexp_replace(w, '\p{M}+', '', 'g')) AS n FROM word) x LEFT JOIN covered c ON c.d = x.d AND c.i = x.i LEFT JOIN gain g ON g.w = x.w GROUP BY x.d)
SELECT DISTINCT tbl, video_id, rec_id FROM doc JOIN share ON share.d = doc.d WHERE share >= 0.4::DOUBLE
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Tables of the SQL's own, so that it doesn't share an omission: invisible characters, letters drawn alike, signs written apart.
_NOTHING = r"\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}"
_DRAWN = [("АВЕКМНОРСТХІЅЈ", "ABEKMHOPCTXISJ"), ("асеорхуіјѕ", "aceopxyijs"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("ονρµ", "ovpμ")]
_APART = {"अ": {"ा": "आ", "ॅ": "ॲ", "ॉ": "ऑ", "ो": "ओ", "ौ": "औ"}, "आ": {"े": "ओ", "ै": "औ", "ॅ": "ऑ"}, "ए": {"े": "ऐ", "ॅ": "ऍ"}, "ा": {"े": "ो", "ै": "ौ", "ॅ": "ॉ"}}


def _form(column: str) -> str:
    """The consistent form in SQL.  Joiners are dropped: the test tables hold none that can be seen."""
    out = f"regexp_replace({column}, '[{_NOTHING}]', '', 'g')"
    out = f"regexp_replace({out}, '{WS}+', ' ', 'g')"
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    out = f"translate({out}, {_quoted(wide)}, {_quoted(''.join(map(chr, range(0x21, 0x7F))))})"
    for a, b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "...")):
        out = f"replace({out}, '{a}', '{b}')"
    out = f"nfc_normalize(translate({out}, {_quoted(''.join(a for a, _ in _DRAWN))}, {_quoted(''.join(b for _, b in _DRAWN))}))"
    for letter, signs in _APART.items():
        for sign, whole in signs.items():
            out = f"replace({out}, '{letter}{sign}', '{whole}')"
    return f"trim({out})"


ORACLE: dict[str, str] = {
    "p1_found": _P1 + "SELECT DISTINCT a AS video_id_a, b AS video_id_b FROM reach WHERE a < b AND a IN (SELECT v FROM present) AND b IN (SELECT v FROM present)",
    "p1_members": _P1 + """SELECT * FROM (SELECT v AS video_id, component, count(*) OVER (PARTITION BY component) AS n_members FROM part WHERE v IN (SELECT v FROM present)) WHERE n_members > 1""",
    "p1_parted": _P1
    + r"""SELECT coalesce(p.component, r.v) AS split_unit, count(*) AS n_rows, 1::BIGINT AS n_splits FROM (
  SELECT coalesce(CASE WHEN trim(video_id) <> '' THEN video_id END, nullif(trim(regexp_extract(sample_id, '^(.+)_SPEAKER_\d+_\d+$', 1)), ''), (SELECT min(l.v) FROM link l WHERE l.s = d.sample_id)) AS v FROM dataset d) r
LEFT JOIN part p ON p.v = r.v WHERE r.v IS NOT NULL GROUP BY 1""",
    "p2_found": _P2 + "SELECT h.cand_id FROM hit h JOIN cut c ON h.detector = c.detector AND h.tag = c.tag WHERE h.score >= c.cutoff",
    "p2_cutoffs": _P2
    + """SELECT h.detector, h.tag, any_value(c.keep_permille) AS keep_permille, any_value(c.counted)::BIGINT AS counted, any_value(c.cutoff) AS cutoff, count(*) AS kept
FROM hit h JOIN cut c ON h.detector = c.detector AND h.tag = c.tag WHERE h.score >= c.cutoff GROUP BY h.detector, h.tag""",
    "p3_found": _P3,
    "p4_found": f"""
SELECT DISTINCT t.seg_id FROM transcripts t JOIN dataset d ON d.sample_id = t.seg_id
WHERE t.text <> d.text_plain AND {_form("t.text")} = {_form("d.text_plain")}""",
    "p7_whole": """SELECT container, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS overflow, 0::BIGINT AS broken, 0::BIGINT AS "cut"
FROM (SELECT DISTINCT container FROM container_sizes WHERE capacity_tokens > 0 AND container IS NOT NULL)""",
    "p4_forms": f"SELECT seg_id, text, {_form('text')} AS form FROM (SELECT seg_id, text FROM transcripts UNION ALL SELECT sample_id, text_plain FROM dataset)",
}
