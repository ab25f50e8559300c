"""Scoring of model outputs against gold answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenspark.functions.numbers import STATED, let, near, safe_double
from lumenspark.functions.text import comparable, strip

# Tolerances, and words that state a decrease or leave the sign open.
REL_TOL = 0.001
REL_TOL_LENIENT = 0.005
DECREASE = r"(?iU)\b(decrease[sd]?|decline[sd]?|dropped|drop|fell|fall|lower|reduc\w*|down)\b"
DIFFERENCE = r"(?iU)\bdifference\b"
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}


def extract_answer(output: Column) -> Column:
    """The last answer line, else the whole output; null if blank."""
    lines = F.regexp_extract_all(output, F.lit(r"(?iUd)answer\s*[:：]\s*(.+)"), 1)
    nothing = F.lit(None).cast("string")
    whole = lambda: let(strip(output), lambda t: F.when(t != "", t).otherwise(nothing))
    return let(F.try_element_at(lines, F.lit(-1)), lambda last: F.when(last.isNotNull(), strip(last)).otherwise(whole()))


def _stated(raw: Column) -> Column:
    def read(s: Column, bare: Column) -> Column:
        value = safe_double(bare)
        decimals = F.when(bare.contains("."), F.length(F.split_part(bare, F.lit("."), F.lit(2)))).otherwise(0)
        return F.struct(F.when(s.startswith("(") & s.endswith(")"), -F.abs(value)).otherwise(value).alias("value"), decimals.alias("decimals"))

    return let(F.regexp_replace(raw, "[$,% ]", ""), lambda s: let(F.regexp_replace(s, r"^[()]+|[()]+$", ""), lambda bare: read(s, bare)))


def stated_numbers(text: Column) -> Column:
    """array of struct(value, decimals) of the numbers in a text, in order."""
    found = F.regexp_extract_all(F.translate(text, "−", "-"), F.lit(STATED), 0)
    return F.filter(F.transform(found, _stated), lambda s: s["value"].isNotNull())


def last_number(text: Column) -> Column:
    return F.try_element_at(stated_numbers(text), F.lit(-1))


def is_correct(output: Column, gold_num: Column, gold_word: Column, question: Column, strict_sign: bool = False, rel: float = REL_TOL) -> Column:
    """struct(correct, extracted) of a numeric or yes/no question."""

    def right(answer: Column) -> Column:
        words = F.regexp_extract_all(answer, F.lit(r"(?iU)\b(yes|no)\b"), 1)
        by_word = F.coalesce(F.lower(F.try_element_at(words, F.lit(-1))) == F.lower(strip(gold_word)), F.lit(False))
        return answer.isNotNull() & F.coalesce(F.when(gold_word.isNotNull(), by_word).otherwise(let(last_number(answer), lambda p: by_number(answer, p["value"], p["decimals"]))), F.lit(False))

    def by_number(answer: Column, v: Column, d: Column) -> Column:
        hit = near(v, d, gold_num, rel)
        if strict_sign:
            return hit
        turned = near(-v, d, gold_num, rel)
        return hit | (turned & (gold_num < 0) & (v > 0) & answer.rlike(DECREASE)) | (turned & question.rlike(DIFFERENCE))

    return let(extract_answer(output), lambda answer: F.struct(right(answer).alias("correct"), answer.alias("extracted")))


def plain_number(s: Column) -> Column:
    """The number that the whole text is, else null."""
    t = strip(F.regexp_replace(strip(s), "[,$%]", ""))
    return safe_double(F.regexp_replace(t, r"^\((.*)\)$", "-$1"))


def scaled_match(answer: Column, gold: Column, scale: Column) -> Column:
    """Any number in the answer is the gold value, as written, as a ratio or expanded by its scale."""
    factor = F.when(scale == "percent", 0.01)
    for name, x in SCALES.items():
        factor = factor.when(scale == name, x)
    other = F.when(scale == "percent", gold / 100).otherwise(gold * factor)
    return F.exists(stated_numbers(answer), lambda n: near(n["value"], n["decimals"], gold, REL_TOL) | near(n["value"], n["decimals"], other, REL_TOL))


def is_correct_spans(output: Column, items: Column, scale: Column) -> Column:
    """struct(correct, extracted): every gold item must match, as a number or as normalised text."""
    answer = extract_answer(output)
    one = lambda item: F.when(plain_number(item).isNotNull(), scaled_match(answer, plain_number(item), scale)).otherwise(F.contains(comparable(answer), comparable(item)))
    return F.struct((answer.isNotNull() & F.coalesce(F.forall(items, one), F.lit(False))).alias("correct"), answer.alias("extracted"))


def score(dataset: Column, output: Column, gold_num: Column, gold_word: Column, items: Column, scale: Column, question: Column, **how) -> Column:
    """The scorer of the record's dataset."""
    return F.when(dataset == "tatqa", is_correct_spans(output, items, scale)).otherwise(is_correct(output, gold_num, gold_word, question, **how))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p-value of discordant counts, to 4 decimals."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    # the log of each binomial term follows from the one before it
    none = -n * F.log(F.lit(2.0))
    first = F.struct(none.alias("log"), F.exp(none).alias("sum"))
    step = lambda acc, i: let(acc["log"] + F.log((n - i + 1) / i), lambda x: F.struct(x.alias("log"), (acc["sum"] + F.exp(x)).alias("sum")))
    terms = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.round(F.least(F.lit(1.0), 2 * F.aggregate(terms, first, step)["sum"]), 4)
