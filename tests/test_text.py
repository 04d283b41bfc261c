import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("नमस्ते। ok ₹5 हाँ-yes", (16, 0.5625, 0.3125, 3)),
        ("", (0, 0.0, 0.0, 0)),
        (None, (0, 0.0, 0.0, 0)),
        ("abc", (3, 0.0, 1.0, 0)),
        ("é", (1, 0.0, 0.0, 0)),
        ("a क b क", (4, 0.5, 0.5, 3)),
    ],
)
def test_script_profile(spark, text, want):
    assert tuple(one(spark, T.script_profile(F.lit(text).cast("string")))) == want


def test_tokens_split_at_any_white_space(spark):
    assert one(spark, T.tokens(F.lit(" a b c\n\td "))) == ["a", "b", "c", "d"]
    assert one(spark, T.tokens(F.lit(""))) == []
    assert one(spark, T.tokens(F.lit(None).cast("string"))) is None


def test_tokens_and_fillers(spark):
    assert one(spark, T.norm_token(F.lit("Uh-Huh!"))) == "uhhuh"
    assert one(spark, T.is_filler(F.lit("हाँ,"))) is True
    assert one(spark, T.filler_count(F.lit("Uh umm, मतलब like I like it"))) == 5
    assert one(spark, T.alignable(F.lit("Don't 42"))) == "don't"


def test_ids(spark):
    assert one(spark, T.video_id(F.lit("https://www.youtube.com/watch?list=q&v=abcdefghijk&t=1"))) == "abcdefghijk"
    assert one(spark, T.video_id(F.lit("https://example.com/abcdefghijk"))) is None
    assert one(spark, T.slug(F.lit("SPEAKER 00-x"))) == "speaker_00_x"
    assert one(spark, T.job_id(F.lit("a  é.b"), F.lit("q"))).startswith("up_a__é_b_")
    assert one(spark, T.job_id(F.lit("a  é.b"), F.lit("q"), True)).startswith("up_a_b_")


def test_split_share(spark):
    n = spark.range(20_000).select(T.split_of(F.concat(F.lit("v"), "id")).alias("s")).where("s = 'val'").count()
    assert 850 < n < 1150


def test_clock_and_labels(spark):
    assert one(spark, T.clock(F.lit(65.25))) == "1:05.3"
    assert one(spark, T.lane_label(F.lit("sam_speaker_01_clean_sepformer"))) == "Clean S01"
    assert one(spark, T.lane_label(F.lit("sam_old_name_clean"))) == "Clean old name"
    assert one(spark, T.half_up(F.lit(0.12345), 4)) == 0.1235


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, V.dot(a, b)) == 3.0 and one(spark, V.norm(a)) == 5.0
    assert one(spark, V.unit(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.usable(a)) and not one(spark, V.usable(F.array(F.lit(0.0)))) and not one(spark, V.usable(F.array(F.lit(float("nan")), F.lit(1.0))))
