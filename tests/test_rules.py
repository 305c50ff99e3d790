import pytest
from pyspark.sql import functions as F

from quillmill.functions import metrics as M
from quillmill.functions import rules as R
from quillmill.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("current", "candidate", "before", "after", "reason"),
    [("a" * 100, "b" * 110, 0.2, 0.23, "expansion_without_strong_gain"), ("a" * 100, "b" * 110, 0.2, 0.3, "quality_gain"), ("a" * 100, "b" * 151, 0.2, 0.9, "hard_length_limit"), ("abc", "abd", 0.5, 0.4, "insufficient_quality_gain"), ("abc", "", 0.2, 0.9, "empty_or_identical"), ("abc", "abc", 0.2, 0.9, "empty_or_identical")],
)
def test_quality_gate(spark, current, candidate, before, after, reason):
    got = one(spark, R.quality_gate(F.col("a"), F.col("b"), F.col("c"), F.col("d"), allowance=0), a=current, b=candidate, c=before, d=after)
    assert got.reason == reason and got.valid == (reason == "quality_gain")


def test_nonfinite_scores_are_errors(spark):
    with pytest.raises(Exception, match="nonfinite"):
        one(spark, R.quality_gate(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a="x", b="y", c=float("nan"), d=0.5)
    with pytest.raises(Exception, match="nonfinite"):
        one(spark, R.label(F.col("d")), d=float("inf"))


def test_labels_and_ties(spark):
    rows = spark.createDataFrame([(0.0,), (-0.1,), (0.00001,), (0.2,)], "d double").select(R.label(F.col("d")).alias("x")).collect()
    assert [r.x for r in rows] == ["Reject", "Reject", "Accept", "Accept"]
    assert one(spark, R.decision(F.col("a"), F.col("b")), a=0.5, b=0.5) == "Reject"


def test_pair_validity_order(spark):
    why = lambda **v: one(spark, R.pair_reason(F.col("cur"), F.col("cand"), F.col("fin"), chinese=F.col("zh") == 1), **v)
    assert why(cur="abc", cand="", fin="length", zh=1) == "length"
    assert why(cur="abc", cand=" ", fin="stop", zh=1) == "empty"
    assert why(cur="abc", cand="<think>x", fin="stop", zh=1) == "format"
    assert why(cur="abc", cand="english", fin="stop", zh=1) == "no_chinese"
    assert why(cur="ab", cand="中" * 40, fin="stop", zh=1) == "length"
    assert why(cur="abc", cand="中文", fin="stop", zh=1) is None
    assert why(cur="abc", cand="english", fin="stop", zh=0) is None


def test_blank_is_any_white_space(spark):
    blank = " \n\t\r\u3000\u00a0\x1f"
    assert blank.strip() == "" == one(spark, T.strip(F.col("a")), a=blank)
    assert one(spark, R.format_reason(F.lit("stop"), F.col("a")), a=blank) == "empty"
    assert one(spark, R.quality_gate(F.lit("abc"), F.col("a"), F.lit(0.1), F.lit(0.9)), a="\n").reason == "empty_or_identical"
    assert one(spark, T.answer(F.col("a")), a='Summary:\n"The end"\n') == "The end"
    assert one(spark, T.strip_prefix(F.col("a")), a="Fix:\nthis \n") == "this"
    assert one(spark, R.winner(F.col("a"), F.lit(False)), a="A\n") == "worse"
    assert one(spark, T.json_object(F.col("a")), a='```json\n{"x": 1}\n```\n') == '{"x": 1}'


def test_runtime_validity_has_its_own_order(spark):
    why = lambda **v: one(spark, R.runtime_reason(F.col("cur"), F.col("cand"), F.col("fin")), **v)
    assert why(cur="", cand="", fin="context_length_exceeded") == "context_length_exceeded"
    assert why(cur="", cand="", fin="length") == "empty"
    assert why(cur="", cand="x", fin="length") == "unfinished"


def test_the_two_ways_to_combine(spark):
    assert one(spark, R.combine_strict(F.col("a"), F.col("b")), a="Better", b="Tie") == "Uncertain"
    assert one(spark, R.combine_soft(F.col("a"), F.col("b")), a="better", b="tie") == "tie"
    assert one(spark, R.combine_soft(F.col("a"), F.col("b")), a="better", b="worse") == "uncertain"
    assert one(spark, R.winner(F.col("a"), F.lit(True)), a=" a ") == "better"


def test_controller_replies(spark):
    got = lambda x: one(spark, R.controller_action(F.col("a")), a=x)
    assert got('```json\n{"action": "stop", "reason": "ok"}\n```').action == "STOP"
    assert got('Sure: {"action": "edit", "instruction": "shorten"} done').action == "REFINE"
    assert got('{"action": "?"}').action == "STOP"
    assert got("no json").failure


def test_normal_form_and_tokens(spark):
    assert one(spark, T.norm(F.col("a")), a="Ｓtraße  ﬁn") == "strassefin"
    assert one(spark, T.field_tokens(F.col("a")), a="Éa b2-C") == ["a", "b2", "c"]
    assert one(spark, T.field_tokens(F.col("a")), a="中 文x") == ["中", "文", "x", "中文", "文x"]
    assert one(spark, T.approx_tokens(F.col("a")), a="中文 two words") == 2 + 2 + 8
    assert one(spark, T.language_aware_tokens(F.col("a")), a="It's Ok!") == ["it", "'", "s", "ok", "!"]


def test_parsers(spark):
    assert one(spark, T.answer(F.col("a")), a='<think>x</think> Summary: "The end"') == "The end"
    assert one(spark, T.last_paragraph(F.col("a")), a="a\n\n b \n\n  ") == "b"
    assert one(spark, T.strip_prefix(F.col("a")), a="Fix: this: now") == "this: now"
    assert [tuple(x) for x in one(spark, T.verdicts(F.col("a")), a='x [1] [{"id": "p", "winner": "a"}, {"id": "p", "winner": "B"}, {"id": "q", "winner": "?"}]')] == [("p", "A", "")]
    assert one(spark, T.split_of_path(F.col("a")), a="/x/dev/y.json") == "dev"
    assert one(spark, T.id_part(F.col("a")), a="t/m/s/1/0") == "s/1"
    assert one(spark, T.half_even(F.col("a"), F.lit(2)), a=2.675) == 2.67
    assert one(spark, T.canonical_digest(F.col("a")), a='{"b": 1, "a": 2}') == one(spark, T.canonical_digest(F.col("a")), a='{"a":2,"b":1}')


def test_json_texts(spark):
    spark.udtf.register("json_texts", T.JsonTexts)
    rows = spark.sql("""SELECT * FROM json_texts('{"b": ["x", 1, {"c": "y"}], "a": "z"}')""").collect()
    assert [tuple(r) for r in rows] == [("$.a", "z"), ("$.b[0]", "x"), ("$.b[2].c", "y")]
    assert spark.sql("SELECT * FROM json_texts('{')").count() == 0


def test_metrics_by_hand(spark):
    m = lambda f, r, c: one(spark, f(F.col("r"), F.col("c")), r=r, c=c)
    assert m(M.rouge1_f1, "the cat sat", "the cat") == pytest.approx(0.8)
    assert m(M.bleu_words, "a b c d e", "a b c d e") == pytest.approx(1.0)
    assert m(M.sentence_bleu_proxy, "a b", "a b") == pytest.approx(1.0)  # missing orders are left out
    assert m(M.bleu_words, "a b", "a b") == pytest.approx((1e-9) ** 0.5)  # here they count as epsilon
    assert m(M.sentence_gleu, "a b c", "a b") == pytest.approx(3 / 6)
    assert m(M.gleu_like, "a b c", "a b") == pytest.approx((2 / 3 + 1 / 2) / 2)
    assert m(M.rouge, "cats running", "cat runs").rouge1 == pytest.approx(1.0)
    assert m(M.rouge, "", "x").rougeL == 0.0
    assert m(M.bleu_chars, "", "x") == 0.0


def test_wilson_and_softmax(spark):
    w = one(spark, R.wilson(F.col("k"), F.col("n")), k=8, n=10)
    assert (w.low, w.high) == (pytest.approx(0.490162, abs=1e-5), pytest.approx(0.943318, abs=1e-5))
    assert one(spark, R.wilson(F.col("k"), F.col("n")), k=0, n=0) is None
    assert sum(one(spark, R.softmax(F.array(F.col("a"), F.col("b"))), a=1000.0, b=1001.0)) == pytest.approx(1.0)
