"""The analyzer in batches: what becomes of odd texts and replies, and that its state is built once per worker."""

import os
import uuid

from pyspark.sql import types as T

from strata.operators.analysis import analyze_texts, fit_word_votes, word_vote_analyzer

SCHEMA = T.StructType([T.StructField("sentiment", T.StringType()), T.StructField("n", T.LongType())])


def test_every_kind_of_reply_is_a_row(spark):
    def odd_analyzer():
        def analyze(text):
            return {"obj": {"sentiment": "neutral", "n": 3}, "json": '{"sentiment": "positive", "n": 1}', "fence": '```json\n{"sentiment": "negative"}\n```',
                    "bare fence": '```\n{"n": 7}```', "cut": '{"sentiment": "pos', "prose": "I cannot do that", "array": '[{"n": 1}]', "number": "5", "none": None,
                    "blank": "", "extra": '{"n": 2, "more": [1]}', "wrong type": '{"n": "many"}'}.get(text) if text != "boom" else 1 / 0
        return analyze

    texts = ["obj", "json", "fence", "bare fence", "cut", "prose", "array", "number", "none", "blank", "extra", "wrong type", "boom", None, "", "a\nb"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id long, text string, reply string").repartition(3)
    got = {r.id: r for r in analyze_texts(df, "text", ["id", "reply"], odd_analyzer, uuid.uuid4().hex, SCHEMA).collect()}
    status = {t: got[i].status for i, t in enumerate(texts)}
    assert status == {"obj": "ok", "json": "ok", "fence": "fenced", "bare fence": "fenced", "cut": "malformed", "prose": "malformed", "array": "malformed", "number": "malformed",
                      "none": "empty", "blank": "malformed", "extra": "ok", "wrong type": "ok", "boom": "error", None: "empty", "": "empty", "a\nb": "empty"}
    by = {t: got[i] for i, t in enumerate(texts)}
    assert (by["obj"].sentiment, by["obj"].n, by["fence"].sentiment, by["bare fence"].n, by["extra"].n, by["wrong type"].n) == ("neutral", 3, "negative", 7, 2, None)
    assert by["boom"].raw_output.startswith("Error: division") and by["cut"].raw_output == '{"sentiment": "pos' and by["json"].raw_output is None
    assert all(r.reply == "own" for r in got.values()) and len(got) == len(texts)


def test_state_is_built_once_per_worker(spark, tmp_path):
    folder, name = str(tmp_path), uuid.uuid4().hex

    def factory():
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(str(os.getpid()))
        return lambda text: {"n": os.getpid()}

    df = spark.range(0, 400, 1, 40).selectExpr("id", "'x' AS text")
    for _ in range(2):
        pids = {r.n for r in analyze_texts(df, "text", ["id"], factory, name, SCHEMA).collect()}
    built = [open(os.path.join(folder, f)).read() for f in os.listdir(folder)]
    assert len(built) == len(set(built)) <= 2 * os.cpu_count() < 80 and set(map(str, pids)) <= set(built)


def test_votes_are_the_words_whose_shares_differ_most(spark):
    rows = [("good day, all", 0), ("good good work.", 0), ("bad day", 1), ("bad work all", 1), ("bad thing", 1), ("unknown", None), (None, 1), ("Good\tthing", 0)]
    df = spark.createDataFrame(rows, "text string, y int")
    votes = {r.word: r.vote for r in fit_word_votes(df, "text", "y", 3).collect()}
    # of 3 good and 4 bad texts: good 3 to 0, bad 0 to 3, then the smallest word of those with 1 to 1
    assert votes == {"good": 1, "bad": -1, "all": 1}
    assert fit_word_votes(df.where("y is null"), "text", "y").collect() == []


def test_the_word_vote_analyzer():
    analyze = word_vote_analyzer({"good": 1, "bad": -1}, 60)
    assert '"sentiment": "positive"' in analyze("Good, é !") and '"urgent": true' in analyze("Good, é !")
    assert '"sentiment": "neutral"' in analyze("good bad") and analyze("bad. a. b. c").startswith("```json\n")
    assert not analyze("good " * 20).endswith("}")
