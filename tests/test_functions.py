"""Column functions on literals whose results are known."""

import pytest
from pyspark.sql import functions as F

from lumenspark.functions import numbers as N
from lumenspark.functions import program as P
from lumenspark.functions import render as R
from lumenspark.functions import scoring as S
from lumenspark.functions import text as X
from lumenspark.functions import tokens as K
from lumenspark.operators import curate
from lumenspark.operators.graph import connected_components
from lumenspark.plans.ranking import with_position

def none():
    return F.lit(None).cast("string")

def no_table():
    return F.array().cast("array<array<string>>")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2.05% ( 2.05 % )", "2.05%"), ("$ -23158 ( 23158 )", "$-23158"), ("( 10 ) % ( % )", "(10) %"), ("company 2019s plan", "company's plan"), ("in 2019", "in 2019"), ("progress ..", "progress ."), ("２０ ﬁn", "20 fin"), ("a\xa0, b", "a, b"), ("", "")],
)
def test_clean_text(spark, text, want):
    assert value(spark, X.clean_text(F.lit(text))) == want


def test_clean_arrays(spark):
    assert value(spark, X.clean_sentences(F.array(F.lit("a ,"), F.lit(" . "), F.lit("")))) == ["a,"]
    assert value(spark, X.clean_table(F.array(F.array(F.lit("$ 5"), F.lit("x"))))) == [["$5", "x"]]
    hits = value(spark, X.rule_hits(F.lit("a , b ; 5 %")))
    assert hits["space_before_punct"] == 2 and hits["percent_space"] == 1


def test_numbers(spark):
    assert value(spark, N.numbers_in(F.lit("a .76 and 1,234.5 and .76"))) == [0.76, 1234.5]
    for text, want in (("12.4%", 0.124), ("const_m1", -1.0), ("const_100", 100.0), ("abc", None), ("5f", None), ("1,000", 1000.0), ("inf", None)):
        assert value(spark, N.to_number(F.lit(text))) == pytest.approx(want) if want is not None else value(spark, N.to_number(F.lit(text))) is None
    assert [value(spark, N.show_number(F.lit(x))) for x in (3.0, 0.00012345, 1.23456, 2.5, 1e16, -0.5)] == ["3", "0.000123", "1.2346", "2.5", "10000000000000000", "-0.5"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("(12.5)", (None, -12.5, 1, False)), ("$ 3.8 million", (None, 3.8, 1, False)), ("yes.", ("yes", None, None, None)), ("n/a", (None, None, None, None)), ("12%", (None, 12.0, 0, True))],
)
def test_parse_answer(spark, text, want):
    assert tuple(value(spark, N.parse_answer(F.lit(text)))) == want


@pytest.mark.parametrize(("text", "num", "word", "want"), [("12.4%", 0.124, None, True), ("12", 0.124, None, True), ("", 1.0, None, None), ("yes", None, "Yes", True), ("up 38.6% or so", 0.386, None, True), ("none", 1.0, None, None), ("7", 1.0, None, False)])
def test_answer_agrees(spark, text, num, word, want):
    assert value(spark, N.answer_agrees(F.lit(text), F.lit(num).cast("double"), F.lit(word).cast("string"))) is want


def test_same_result(spark):
    same = lambda a, b: value(spark, N.same_result(F.lit(a).cast("double"), none(), F.lit(b).cast("double"), none()))
    assert same(1.0, 1.00009) and not same(1.0, 1.01) and not same(None, 1.0)
    assert value(spark, N.same_result(F.lit(None).cast("double"), F.lit("Yes"), F.lit(None).cast("double"), F.lit("yes ")))


@pytest.mark.parametrize(
    ("text", "want"),
    [("subtract(112.4, 100), divide(#0, 100)", (0.124, None)), ("greater(5, 3)", (None, "yes")), ("divide(1, 0)", None), ("greater(5, 3), add(#0, 1)", None), ("add(1,2)", None), ("exp(2, 3)", (8.0, None)), ("unknown(1, 2)", None), ("", None), ("add(1, 2", None), ("multiply(const_m1, 12%)", (-0.12, None))],
)
@pytest.mark.parametrize("deep", [False, True])
def test_execute(spark, text, want, deep):
    got = value(spark, P.execute(F.lit(text), no_table(), deep))
    assert (got if got is None else (got["num"] and round(got["num"], 9), got["txt"])) == want


def test_table_rows(spark):
    grid = F.array(*[F.array(*map(F.lit, r)) for r in (["x", "1"], ["net (loss), adjusted", "$ -3 ( 3 )", "5"], ["bad", "1", "n/a"])])
    text = "table_sum(net (loss), adjusted, none), table_average(net (loss), adjusted, none)"
    assert [r["num"] for r in value(spark, P.execute_steps(P.parse(F.lit(text)), grid))] == [2.0, 1.0]
    assert value(spark, P.execute(F.lit("table_max(bad, none)"), grid)) is None
    assert value(spark, P.execute(F.lit("table_max(missing, none)"), grid)) is None
    assert value(spark, P.argument_set(P.parse(F.lit("add(5, const_3), divide(#0, 5)")))) == [5.0]


@pytest.mark.parametrize(
    ("output", "gold", "question", "want", "strict"),
    [("Answer: declined 2.6%", -0.026, "", True, False), ("Answer: 45.25%", 0.4510, "", False, False), ("Answer: 1\nAnswer: 2", 2.0, "", True, True), ("Answer: 5", -5.0, "difference of a and b", True, False), ("", 1.0, "", False, False), ("it is (12.5)", -12.5, "", True, True)],
)
def test_is_correct(spark, output, gold, question, want, strict):
    args = (F.lit(output), F.lit(gold), none(), F.lit(question))
    assert value(spark, S.is_correct(*args))["correct"] is want
    assert value(spark, S.is_correct(*args, strict_sign=True))["correct"] is strict


def test_scoring_rest(spark):
    assert value(spark, S.is_correct(F.lit("Answer: 45.25%"), F.lit(0.4510), none(), F.lit(""), rel=S.REL_TOL_LENIENT))["correct"]
    assert value(spark, S.is_correct(F.lit("no, Yes"), F.lit(None).cast("double"), F.lit("yes"), F.lit("")))["correct"]
    assert tuple(value(spark, S.last_number(F.lit("from 5 to (12.5)%")))) == (12.5, 1) or tuple(value(spark, S.last_number(F.lit("from 5 to (12.5)%")))) == (-12.5, 1)
    for b, c, p in ((91, 84, 0.6503), (36, 35, 1.0), (81, 49, 0.0063), (80, 49, 0.008), (67, 54, 0.2753), (64, 45, 0.0842), (273, 108, 0.0), (0, 0, 1.0)):
        assert value(spark, S.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize(("q", "want"), [("what was the value of", True), ("what was the value of?", True), ("what about series a?", False), ("what is it?", False), ("", False)])
def test_truncated(spark, q, want):
    assert bool(value(spark, curate.truncated_question(F.lit(q)))) is want


@pytest.mark.parametrize(("q", "context", "want"), [("in 2018", "the '18 year", False), ("in 2018", "no 12018", False), ("in 2018", "none", True), ("if in 2018", "none", False)])
def test_year_mismatch(spark, q, context, want):
    assert value(spark, curate.year_mismatch(F.lit(q), F.lit(context))) is want


def test_tables_and_masks(spark):
    grid = F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("d")))
    assert value(spark, R.table_markdown(grid)) == "| a/b | c |\n| --- | --- |\n| d |  |"
    assert value(spark, R.table_markdown(no_table())) == ""
    ids, header = F.array(*map(F.lit, [1, 2, 3, 2, 3, 4])), F.array(F.lit(2), F.lit(3))
    assert value(spark, K.response_labels(ids, header)) == [-100] * 5 + [4]
    assert value(spark, K.find_last(ids, F.array(F.lit(9)))) == -1
    with pytest.raises(Exception, match="header"):
        value(spark, K.response_labels(ids, F.array(F.lit(9))))


def test_components_and_positions(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 11), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8, 11: 8} | {100 + i: 100 for i in range(41)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r["p"] == r["v"] for r in with_position(rows, ["v"], 7, "p").collect())


def test_response_mask_of_batches(spark):
    """The last header of every row, by Column and over batches: headers that overlap, end a row, or run across two rows."""
    rows = [[1, 2, 1, 2, 1, 7], [3, 1, 2, 1], [1, 2, 1, 1], [9, 1, 2, 1, 1, 2], [1, 2, 1, None, 21]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<int>").coalesce(1)
    want = [[-100] * 5 + [7], [-100] * 4, [-100] * 3 + [1], [-100] * 4 + [1, 2], [-100] * 3 + [None, 21]]
    got = df.select("i", K.response_mask([1, 2, 1])("ids").alias("a"), K.response_labels(F.col("ids"), F.array(*map(F.lit, [1, 2, 1]))).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in got] == want and [r["b"] for r in got] == want
    with pytest.raises(Exception, match="assistant header not found"):
        df.union(spark.createDataFrame([(9, [2, 1])], "i int, ids array<int>")).select(K.response_mask([1, 2, 1])("ids")).collect()


def test_last_of_many_ids(spark):
    """A thousand rows of two thousand ids are searched in seconds, and 12 is not found in 112 or 121."""
    import time

    df = spark.range(1000).select(F.concat(F.array(F.lit(12)), F.array_repeat(F.lit(112), 2000), F.array(F.lit(121))).alias("ids")).cache()
    df.count()
    begin = time.time()
    assert df.filter(K.find_last(F.col("ids"), F.array(F.lit(12))) != 0).count() == 0
    assert time.time() - begin < 20
    assert value(spark, K.find_last(F.array(F.lit(1), F.lit(2)), F.array().cast("array<int>"))) == 2


def test_rewriting_rules_in_stages(spark):
    """Stages that a text skips leave it as all rules one after the other would."""
    import random

    rng = random.Random(3)
    bits = [" ", "  ", "\t", "201c", "201d", "2018", "2018 2018", " 2019 2019", "2019s", "f0b7", "5", "1,200.5", "-7", "%", " %", "( ", " )", "(", ")", "$ ", "$", " ,", " .", "..", ";.", "'s", " 's", " n't", "word", "a", "\xa0", "\n", "?"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    c = F.col("t")
    for _, pattern, replacement in X.RULES:
        c = F.regexp_replace(c, X._FLAGS + pattern, replacement)
    d = F.col("t")
    for _, pattern, replacement in X.DECODE_RULES:
        d = F.regexp_replace(d, X._FLAGS + pattern, replacement)
    both = df.select("t", X.strip(c).alias("a"), X.rewrite(F.col("t")).alias("b"), d.alias("c"), X.decode_artifacts(F.col("t")).alias("d"))
    assert both.filter("not (a <=> b) or not (c <=> d)").count() == 0


def test_texts_are_read_once(spark):
    """Answers, scores and tables compute what they use several times once: few searches stand in their expressions."""
    df = spark.createDataFrame([("Answer: 5", 5.0, "", [["a", "b"], ["1"]])], "t string, n double, w string, g array<array<string>>")
    count = lambda c, name: df.select(c)._jdf.queryExecution().analyzed().toString().count(name)  # once in the expression, once in its name
    assert count(N.answer_agrees(F.col("t"), F.col("n"), F.col("w")), "regexp_extract(") <= 4
    assert count(S.is_correct(F.col("t"), F.col("n"), F.col("w"), F.col("t")), "regexp_extract_all(") <= 6
    assert count(R.table_markdown(F.col("g")), "array_max(") <= 2
