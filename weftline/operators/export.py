"""From clips, texts and candidates to tagged training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import half_up, split_of, tokens
from weftline.operators.rows import rename
from weftline.runtime import computed, settle

# Least score of a tag; tags not named always pass.
THRESHOLDS = {
    "laughs": 0.20, "sigh": 0.10, "gasps": 0.10, "pauses": 0.25, "hesitates": 0.50, "stammers": 0.50, "whispers": 0.60,
    "flatly": 0.60, "cheerfully": 0.60, "excited": 0.60, "nervous": 0.60, "frustrated": 0.60, "sorrowful": 0.60, "calm": 0.60,
}
# Tags of a whole utterance, written before its first word.
UTTERANCE = ["whispers", "flatly", "cheerfully", "deadpan", "playfully", "excited", "nervous", "frustrated", "sorrowful", "calm", "resigned"]
# Reasons that keep a clip out, in order, and whether each is on.
GATES = {"impure": False, "clipped": True, "separated": True, "major_gap": True, "align_error": True, "no_text": True}


def passing(candidates: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Candidates at or above their tag's threshold; a null score is 0, and tags without threshold pass."""
    table = F.create_map(*(F.lit(x) for pair in sorted((THRESHOLDS if thresholds is None else thresholds).items()) for x in pair))
    least = table[F.col("tag")]
    return candidates.where(least.isNull() | (F.coalesce("score", F.lit(0.0)) >= least))


def gate(flags: dict[str, Column], order: dict[str, bool] | None = None) -> Column:
    """The first enabled reason whose flag is true, or null."""
    return F.coalesce(*(F.when(flags[k], k) for k, on in (GATES if order is None else order).items() if on), F.lit(None).cast("string"))


def clip_flags(text: Column, purity: Column, purity_pass: Column, clipped: Column, separated: Column, status: Column) -> dict[str, Column]:
    """The flags of a clip; what is unknown doesn't count against it, but a missing text does."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return {
        "no_text": F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")) == 0,
        "impure": purity.isNotNull() & ~F.coalesce(purity_pass, F.lit(True)),
        "clipped": F.coalesce(F.size(clipped) > 0, F.lit(False)),
        "separated": sure(separated),
        "major_gap": sure(status == "major_gap"),
        "align_error": sure(status == "align_error"),
    }


def listed_reason(flags: dict[str, Column], in_dataset: Column) -> Column:
    """The reason shown for a clip that isn't in the dataset; its order differs from the gate's."""
    return F.when(
        ~in_dataset,
        F.when(flags["no_text"], "no text")
        .when(flags["separated"], "separated audio (SepFormer artifacts)")
        .when(flags["major_gap"], "audible speech with no text")
        .when(flags["align_error"], "alignment failed")
        .when(flags["clipped"], "clipped edge word")
        .otherwise("export gate"),
    )


def with_silences(candidates: DataFrame, gaps: DataFrame, key: str = "seg_id", near: float = 300.0) -> DataFrame:
    """(key, tag, score, position_ms, derived): candidates with pauses and silences as the word gaps say.

    ``candidates`` has key, tag, score and position_ms; ``gaps`` has key, tag, score and
    mid (see words.pauses).  A pause or silence nearer than ``near`` to a gap takes the
    tag of the last such gap; a gap with none near becomes a candidate of its own.
    The gaps of a clip are gathered beside each of its candidates, which stay as often
    as they are given.
    """
    settle(candidates.sparkSession)
    rows = candidates.select(key, "tag", "score", F.col("position_ms").cast("double").alias("position_ms"))
    quiet = F.col("tag").isin("pauses", "silence") & F.col("position_ms").isNotNull()
    lists = gaps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mid", "tag"))).alias("_gaps"))
    beside = F.filter("_gaps", lambda g: F.abs(g.mid - F.col("position_ms")) < near)
    last = F.get(beside, F.size(beside) - 1).tag
    kept = rows.join(lists, key, "left").select(key, F.when(quiet, F.coalesce(last, "tag")).otherwise(F.col("tag")).alias("tag"), "score", "position_ms", F.lit(False).alias("derived"))
    taken = rows.where(quiet).select(F.col(key).alias("_k"), F.col("position_ms").alias("_at"))
    free = gaps.join(taken, (F.col(key) == F.col("_k")) & (F.abs(F.col("mid") - F.col("_at")) < near), "left_anti")
    return kept.unionByName(free.select(key, "tag", "score", F.col("mid").alias("position_ms"), F.lit(True).alias("derived")))


def render(texts: DataFrame, words: DataFrame, tags: DataFrame, key: str = "seg_id") -> DataFrame:
    """(key, tagged, tags): texts with their tags in brackets, and the distinct tags in order.

    Tags of the whole utterance, and tags without position, lead by falling score; others
    stand before the first word that starts after their position, or at the end.  Equal
    places go by position, then tag.  A text without words has all its tags in front.
    ``words`` has key, i, s; ``tags`` has key, tag, score and position_ms.  Tokens stay
    in the row of their text; only tags and word starts are gathered beside it.
    """
    settle(texts.sparkSession)
    timed = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "i"))).alias("_w"))
    hits = tags.groupBy(key).agg(F.collect_list(F.struct("tag", "score", "position_ms")).alias("_t"), F.array_sort(F.collect_set("tag")).alias("tags"))
    rows = texts.select(key, tokens(F.col("text")).alias("_k")).join(timed, key, "left").join(hits, key, "left").where(F.coalesce(F.size("_k"), F.lit(0)) + F.coalesce(F.size("_t"), F.lit(0)) > 0)
    words_of = F.coalesce("_k", F.expr("cast(array() as array<string>)"))

    def place(t: Column) -> Column:
        leads = t.tag.isin(UTTERANCE) | t.position_ms.isNull() | F.col("_w").isNull()
        before = F.get(F.filter("_w", lambda x: x.s > t.position_ms), F.lit(0)).i
        at = F.when(leads, -1).otherwise(F.when(before < F.size(words_of), before).otherwise(F.size(words_of)))
        return F.struct(at.alias("at"), F.when(leads, -F.coalesce(t.score, F.lit(0.0))).otherwise(t.position_ms.cast("double")).alias("order"), F.concat(F.lit("["), t.tag, F.lit("]")).alias("x"))

    rows = computed(rows, {"_m": F.coalesce(F.array_sort(F.transform("_t", place)), F.expr("cast(array() as array<struct<at:int,order:double,x:string>>)")), "_k": words_of})
    at = lambda k: F.transform(F.filter("_m", lambda m: m.at == k), lambda m: m.x)
    parts = F.when(F.size("_m") > 0, F.concat(at(F.lit(-1)), F.flatten(F.transform("_k", lambda w, i: F.concat(at(i), F.array(w)))), at(F.size("_k")))).otherwise(F.col("_k"))
    return rows.select(key, F.array_join(parts, " ").alias("tagged"), F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"))


def matrix(rows: DataFrame, speaker: str = "speaker", tags: str = "tags", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., speaker, tag, n): rows by speaker ('_rows'), those without tags ('_neutral') and those with each tag."""
    base = rows.select(*by, speaker, F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))).alias("_t"))
    cells = F.concat(F.array(F.lit("_rows")), F.when(F.size("_t") == 0, F.array(F.lit("_neutral"))).otherwise(F.col("_t")))
    return base.select(*by, speaker, F.explode(cells).alias("tag")).groupBy(*by, speaker, "tag").agg(F.count("*").alias("n"))


def training_rows(clips: DataFrame, texts: DataFrame, lines: DataFrame, names: dict[str, str] | None = None, key: str = "seg_id") -> DataFrame:
    """The rows of the dataset: one per clip that passes the gate.

    ``clips`` has key, video_id, speaker, s and e in ms, wav, source, separated,
    separated_frac, purity, purity_pass, align_status and clipped; ``texts`` has key,
    text, asr and script; ``lines`` is what render() gives.  ``names`` rename speakers;
    speaker_label keeps the label.  Clips without speaker or with a null or empty span,
    and those that the gate keeps out, have no row.
    """
    plain = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = clips.where("speaker IS NOT NULL AND e > s").join(texts.select(key, "text", plain.alias("text_plain"), "asr", "script"), key, "left")
    flags = clip_flags(F.col("text"), F.col("purity"), F.col("purity_pass"), F.col("clipped"), F.col("separated"), F.col("align_status"))
    name = rename(F.col("speaker"), names or {})
    return (
        rows.where(gate(flags).isNull())
        .join(lines, key)
        .select(
            F.col(key).alias("sample_id"), "video_id", name.alias("speaker"), F.col("speaker").alias("speaker_label"), F.col("tagged").alias("text"), "text_plain", F.concat(name, F.lit(": "), "tagged").alias("line"),
            "tags", "wav", half_up((F.col("e") - F.col("s")) / 1000, 3).alias("dur"), (F.col("s") / 1000).alias("start"), (F.col("e") / 1000).alias("end"), split_of(F.col("video_id")).alias("split"),
            F.coalesce("source", F.lit("original")).alias("source"), F.coalesce("separated_frac", F.lit(0.0)).alias("separated_frac"), "purity", "align_status",
            F.coalesce("clipped", F.expr("cast(array() as array<string>)")).alias("clipped"), "asr", "script",
        )
    )
