import random

import numpy as np

from weftline.llm import subjects

TERMS = {"law": "court verdict appeal lawyer statute".split(), "food": "curry spice dough oven butter".split(), "sport": "goal striker league coach penalty".split()}
SHARED = ["the {} was old and quiet", "nobody wants another {} today", "some call it a {} others call it luck", "she sold the {} for nine coins"]
TALK = ["please hold the line", "can everybody hear me now", "thank you for writing in", "my dog barks all day", "we will call again soon"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        mine = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 2]))
        lines = [rng.choice(TALK) for _ in range(rng.randrange(3, 8))]
        for s in mine:
            lines += [rng.choice(SHARED).format(rng.choice(TERMS[s])) for _ in range(4)]
        rng.shuffle(lines)
        docs.append((i, ". ".join(lines) + "."))
        truth[i] = set(mine)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(1200)
    labels = [(i, s, "a") for i in range(200) for s in (truth[i] or {None})]
    out = subjects.document_subjects(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), spark.createDataFrame([(s, "") for s in TERMS], "subject string, description string")
    )
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = range(200, 1200)
    hit = sum(len(got.get(i, set()) & truth[i]) for i in held)
    assert hit / sum(len(truth[i]) for i in held) > 0.95
    assert hit / sum(len(got.get(i, set())) for i in held) > 0.95


def test_odd_rows(spark):
    docs, truth = corpus(150, 3)
    rng = random.Random(4)
    long = " ".join(rng.choice(SHARED).format(rng.choice(TERMS["law"])) + "." for _ in range(9000))
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, "..."), (1004, long), (5, docs[5][1])]
    labels = [(i, s, "a") for i in range(60) for s in (truth[i] or {None})] * 2 + [(None, "law", "b"), (7777, "law", "b"), (3, "unknown", "b")]
    S = spark.createDataFrame([(s, "") for s in TERMS] + [(None, "x")], "subject string, description string")
    D, L = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    got = {(r.doc_id, r.subject) for r in subjects.document_subjects(D, L, S).collect()}
    assert not {d for d, _ in got} & {1000, 1001, 1002, 1003} and (1004, "law") in got
    for d, l, s in ((D.limit(0), L, S), (D, L.limit(0), S), (D, L, S.limit(0))):
        assert subjects.document_subjects(d, l, s).count() == 0


def test_sentences(spark):
    text = "Kelvo: First one here. [laughs] Second 7.5 one!\r\n* 12:01 Third\n\thttps://x.example/a?b=1\nseg 12 / sigh @ 3.4s: Fourth? ... "
    df = spark.createDataFrame([(text,), (None,), ("aB3+x/Q9=_f\nOne 0x1F more. " + "x" * 50_000,)], "t string")
    rows = [r[0] for r in df.select(subjects.sentences(df.t)).collect()]
    assert rows == [[["first", "one", "here"], ["second", "one"], ["third"], ["fourth"]], [], [["one", "more"], ["x" * 50_000]]]


def test_shared_words_have_no_weight():
    counts = np.zeros((subjects.FEATURES, 4))
    counts[0] = [50, 50, 50, 0]
    counts[1] = [40, 0, 0, 1]
    w = subjects.complement_weights(counts)
    assert not w[0].any() and w[1, 0] > 1 and w[1, 1] == 0


def test_calibration_allows_for_annotators_errors():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 4000)
    named = (rng.random(4000) < 1 / (1 + np.exp(-4 * x))) & (rng.random(4000) > 0.2)
    assert 3 < subjects._calibrate(x, named)[0] < 5.5


def test_calibration_moves_the_line_where_labels_say_so():
    """Annotators who go by sentences of a posterior above 0.87 in one case, above 0.13 in another, and five labels that can't tell."""
    rng = np.random.default_rng(2)
    n = np.full(3000, 40.0)
    odds = rng.normal(0, 2, (3000, 40)) - rng.choice([6, 0, 3], (3000, 1))
    shares = np.stack([(odds >= line).mean(1) for line in subjects.LINES], 1)
    for line in (2.0, -2.0):
        truth = (odds >= line).mean(1) >= subjects.SHARE
        named = truth & (rng.random(3000) > 0.1)
        assert subjects.fit_line(shares, n, named)[0] == line
    assert subjects.fit_line(shares[:2], n[:2], np.array([True, False]))[0] in subjects.LINES
    assert subjects.fit_line(np.zeros((0, len(subjects.LINES))), np.zeros(0), np.zeros(0, bool))[0] == 0.0


def test_sentence_marks_behind_codes():
    import re

    code = subjects._CODE.replace(r"\p{IsLatin}", "[A-Za-z]").replace("*+", "*")
    assert re.sub(code, " ", "it was COVID19. Then x9y, no 7.5 or \u0967\u0968\u0915.") == "it was  . Then   no 7.5 or \u0967\u0968\u0915."


def test_shares_by_line():
    batch = subjects.Batch(np.array([0, 1, 0]), np.full(3, subjects.WORDS), np.array([0, 1, 2]), np.array([0, 0, 1]), 3)
    w = np.zeros((subjects.FEATURES, 3), np.float32)
    w[0, 0], w[1, 1] = 9, 1
    got = batch.shares(w, 1.5, np.array([0.0, 0.0]))
    assert got.tolist() == [[0.5, 0.0], [1.0, 0.0], [0.0, 0.0]]
    assert batch.shares(w, 1.5, np.repeat(np.array([[-9.0], [0.0]]), 2, 1)).shape == (3, 2, 2)
