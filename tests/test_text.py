import math
import random

import pytest
from pyspark.sql import functions as F

from textsieve.functions import text
from textsieve.operators import lm
from textsieve.operators.sentences import corpus, ranked, sentence_ids, split_train_test, text_to_sentences


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "text string").select(expression(F.col("text"))).first()[0]


def test_verse_references_go_only_where_whole(spark):
    out = one(spark, "глава1:23 x 1:23a 38.9 в1:2б", lambda c: text.normalize_raw(c))
    assert out == "глава1 . 23 x в1 . 2б"


def test_flags_keep_tags_and_references(spark):
    assert one(spark, "<b>x</b> 1:2", lambda c: text.normalize_raw(c, drop_tags=False, drop_verse_refs=False)) == "<b>x</b> 1 . 2"


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [("сло­во", ["сло", "во"]), ("schpfö", ["schpf"]), ("б҃гъ", ["бгъ"]), ("Ꙋ", ["ꙋ"]), ("abc1 d", ["d"]), ("", [])],
)
def test_tokens(spark, raw, tokens):
    assert one(spark, raw, lambda c: text.tokenize(text.normalize_raw(c))) == tokens


def test_length_filter_and_breaks(spark):
    word = lambda n: " ".join(["w"] * n)
    docs = spark.createDataFrame([(1, f"{word(5)}. {word(6)}! {word(80)}; {word(81)}\n{word(7)}"), (2, None)], "doc_id long, text string")
    assert [r["n"] for r in text_to_sentences(docs).select(F.size("tokens").alias("n")).collect()] == [6, 80, 7]


def test_levenshtein_limit(spark):
    rows = spark.createDataFrame([("кот", "кит"), ("abc", "xyz")], "a string, b string").select(text.levenshtein_limit(F.col("a"), F.col("b"), 2)).collect()
    assert [r[0] for r in rows] == [1, None]


def test_render(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    t = F.col("t")
    assert tuple(df.select(text.render_sentence(t, F.lit(1)), text.render_sentence(t), text.render_gap(t, F.lit(0)), text.render_gap(t, F.lit(2))).first()) == ("a **b** c", "a b c", "a **[?]** b c", "a b c")


def test_corpus_needs_input(spark):
    with pytest.raises(ValueError, match="no input"):
        corpus()
    docs = spark.createDataFrame([("x", "a b c d e f")], "doc_id string, text string")
    assert corpus(docs, docs).count() == 2


def test_ranks_and_numbers_follow_order(spark):
    words = sorted({"".join(random.Random(i).choices("абвab", k=3)) for i in range(200)})
    got = {r["w"]: r["rank"] for r in ranked(spark.createDataFrame([(w,) for w in words], "w string"), "w", 0).collect()}
    assert got == {w: i for i, w in enumerate(words)}
    s = spark.createDataFrame([(d, p, ["a"]) for d in (5, 9000, 3) for p in (4, 1, 7)], "doc_id long, sent_pos int, tokens array<string>")
    got = sorted((r["doc_id"], r["sent_pos"], r["sent_id"]) for r in sentence_ids(s).collect())
    assert [x[2] for x in got] == [f"s{i}" for i in range(9)]


def test_split_is_disjoint_and_repeatable(spark):
    s = spark.createDataFrame([(i, 0, ["a"]) for i in range(400)], "doc_id long, sent_pos int, tokens array<string>")
    a, b = (sorted((r["doc_id"], r["is_train"]) for r in split_train_test(s, 0.75, 7).collect()) for _ in range(2))
    assert a == b and 250 < sum(x[1] for x in a) < 350


# --- language model, hand-computed on [a b], [a c] ---


@pytest.fixture(scope="module")
def tiny(spark):
    s = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["a", "c"])], "doc_id long, sent_pos int, tokens array<string>")
    return s, lm.fit(s)


def test_counts(tiny):
    _, m = tiny
    assert m.stats.first().asDict() == {"n_total": 10, "v_size": 5, "n_sent": 2}
    assert {r["w"]: r["c"] for r in m.uni.collect()} == {"<s>": 4, "a": 2, "b": 1, "c": 1, "</s>": 2}
    b = {(r["w1"], r["w"]): r["c"] for r in m.bi.collect()}
    assert b["<s>", "<s>"] == 2 and b["<s>", "a"] == 2


@pytest.mark.parametrize(("direction", "want"), [("forward", (0.409473, 0.900230)), ("backward", (0.385662, 1.056100)), ("both", (0.397568, 0.978165))])
def test_surprisal(tiny, direction, want):
    s, m = tiny
    got = [r["surprisal"] for r in lm.token_surprisal(s.where("sent_pos = 0"), m, direction).orderBy("idx").collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_gap_scores(spark, tiny):
    s, m = tiny
    assert lm.gap_scores(s.where("sent_pos = 0"), m).first()["gap_score"] == pytest.approx(0.565568, abs=1e-6)
    unseen = spark.createDataFrame([(1, 0, ["x", "y"]), (1, 1, ["z"])], "doc_id long, sent_pos int, tokens array<string>")
    assert [r["gap_score"] for r in lm.gap_scores(unseen, m).collect()] == [pytest.approx(math.log(5))]


def test_model_checks(spark, tmp_path, tiny):
    with pytest.raises(ValueError):
        lm.LmParams(order=2)
    with pytest.raises(ValueError):
        lm.LmParams(lambdas=(0.5, 0.3, 0.1))
    with pytest.raises(RuntimeError):
        lm.NgramModel().require_fit()
    tiny[1].save(str(tmp_path / "lm"))
    assert lm.NgramModel.load(spark, str(tmp_path / "lm")).tri.count() == tiny[1].tri.count()


def test_backward_scores_are_those_of_reversed_text(spark):
    rng = random.Random(4)
    rows = [(i, 0, rng.choices("abcd", k=rng.randint(1, 9))) for i in range(80)]
    schema = "doc_id long, sent_pos int, tokens array<string>"
    plain, turned = spark.createDataFrame(rows, schema), spark.createDataFrame([(i, p, t[::-1]) for i, p, t in rows], schema)
    a = {(r["doc_id"], r["idx"]): r["surprisal"] for r in lm.token_surprisal(plain, lm.fit(plain), "backward").collect()}
    b = {(r["doc_id"], len(rows[r["doc_id"]][2]) - 1 - r["idx"]): r["surprisal"] for r in lm.token_surprisal(turned, lm.fit(turned), "forward").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
