"""Numbers in text: parsing, comparing and showing them, as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.functions.text import strip

# Patterns that must find exactly these spellings of numbers.
MENTION = r"\d[\d,]*(?:\.\d+)?|\.\d+"
ANSWER = r"^\(?(-?\$?\s*-?[\d,]*\.?\d+)\)?\s*(%|million|billion|thousand|m|b|k)?$"
ANY = r"-?\d[\d,]*\.?\d*"
STATED = r"-?\$?\s*\(?-?\d[\d,]*\.?\d*\)?\s*%?|-?\.\d+\s*%?"
_DOUBLE = "0123456789.+-eE \t\n\r"


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row; lambda bodies get no common-subexpression elimination."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_double(c: Column) -> Column:
    """The double that a decimal spelling stands for, else null; no suffixes, infinities or digit separators."""
    return F.when(F.translate(c, _DOUBLE, "") == "", c.try_cast("double"))


def numbers_in(c: Column) -> Column:
    """Distinct absolute values mentioned in a text, sorted."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MENTION), 0)
    # a mention without its commas is digits with at most one point, so every one is a number
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))))


def lost_numbers(before: Column, after: Column) -> Column:
    """Values mentioned before but not after, sorted."""
    return F.array_sort(F.array_except(numbers_in(before), numbers_in(after)))


def to_number(c: Column) -> Column:
    """A cell or program argument: thousands commas, a percent sign, const_N or const_m1."""
    def read(t: Column) -> Column:
        return F.coalesce(
            safe_double(t),
            F.when(t.contains("%"), safe_double(F.replace(t, F.lit("%"), F.lit(""))) / 100),
            F.when(t == "const_m1", F.lit(-1.0)).when(t.startswith("const_"), safe_double(F.substr(t, F.lit(7)))),
        )

    return let(F.replace(c, F.lit(","), F.lit("")), read)


def _decimals(num: Column) -> Column:
    return F.when(num.contains("."), F.length(F.split_part(num, F.lit("."), F.lit(2)))).otherwise(0)


def parse_answer(c: Column) -> Column:
    """struct(word, value, decimals, percent): word is yes or no; all null if the text is neither that nor one number."""

    def told(t: Column, squeezed: Column, num: Column, value: Column) -> Column:
        signed = F.when(t.startswith("(") & t.endswith(")"), -F.abs(value)).otherwise(value)
        word = F.when(t.isin("yes", "no"), t)
        is_number = word.isNull() & value.isNotNull()
        return F.struct(
            word.alias("word"),
            F.when(is_number, signed).alias("value"),
            F.when(is_number, _decimals(num)).alias("decimals"),
            F.when(is_number, F.regexp_extract(squeezed, "(?i)" + ANSWER, 2) == "%").alias("percent"),
        )

    def read(t: Column) -> Column:
        squeezed = F.replace(t, F.lit(" "), F.lit(""))
        num = F.regexp_replace(F.regexp_extract(squeezed, "(?i)" + ANSWER, 1), "[$,]", "")
        return let(num, lambda n: let(safe_double(n), lambda value: told(t, squeezed, n, value)))

    return let(F.regexp_replace(F.lower(strip(c)), r"\.+$", ""), read)


def near(value: Column, decimals: Column, target: Column, rel: float | Column) -> Column:
    """Equal to target or to 100 * target, within half a shown digit or the relative tolerance."""
    rel = F.lit(rel) if isinstance(rel, float) else rel
    tol = 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9
    return F.coalesce((F.abs(value - target) <= F.greatest(tol, rel * F.abs(target))) | (F.abs(value - target * 100) <= F.greatest(tol, rel * F.abs(target * 100))), F.lit(False))


def answer_agrees(text: Column, num: Column, word: Column) -> Column:
    """Three-valued: does an annotator's text agree with a result (num or word)? Null: nothing to compare."""
    none = (strip(text) == "") | text.isNull() | (num.isNull() & word.isNull())

    def loosely(loose: Column) -> Column:
        hit = F.exists(loose, lambda n: near(safe_double(n), _decimals(n), num, 0.005))
        return F.when(F.size(loose) > 0, hit)

    def compared(p: Column) -> Column:
        parsed = p["word"].isNotNull() | p["value"].isNotNull()
        shown = F.coalesce(p["word"], p["value"].cast("string"))
        loose = F.transform(F.regexp_extract_all(text, F.lit(ANY), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))
        return (
            F.when(parsed & (p["word"].isNotNull() | word.isNotNull()), shown == F.lower(strip(F.coalesce(word, num.cast("string")))))
            .when(word.isNotNull(), F.lit(None).cast("boolean"))
            .when(p["value"].isNotNull(), near(p["value"], p["decimals"], num, 0.005))
            .otherwise(let(loose, loosely))
        )

    return F.when(none, F.lit(None).cast("boolean")).otherwise(let(parse_answer(text), compared))


def same_result(a_num: Column, a_word: Column, b_num: Column, b_word: Column, rel: float = 1e-4, tol: float = 1e-5) -> Column:
    """Results are the same: words without regard to case, numbers within a relative or absolute tolerance; null never."""
    words = F.lower(strip(a_word)) == F.lower(strip(b_word))
    close = F.abs(a_num - b_num) <= F.greatest(rel * F.greatest(F.abs(a_num), F.abs(b_num)), F.lit(tol))
    return F.coalesce(F.when(a_word.isNotNull() | b_word.isNotNull(), words).otherwise(close), F.lit(False))


@F.arrow_udf(T.StringType())
def py_format(x: pa.Array, decimals: pa.Array) -> pa.Array:
    """Fixed decimals rounded from the exact binary value, which JVM formatting doesn't do."""
    return pa.array([None if v is None or v != v else f"{v:.{d}f}" for v, d in zip(x.to_pylist(), decimals.to_pylist(), strict=True)], pa.string())


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "0+$", ""), r"\.$", "")


def _whole(x: Column) -> Column:
    return (x == F.floor(x)) & (F.abs(x) < 1e15)


def _fixed(x: Column, decimals: Column) -> Column:
    """Integers plainly, without Python; else fixed decimals without trailing zeros."""
    part = _trimmed(py_format(F.when(~_whole(x), x), decimals))
    return F.when(_whole(x), F.floor(x).cast("decimal(20,0)").cast("string")).otherwise(part)


def show_number(x: Column) -> Column:
    """Integers plainly; else 4 decimals, or 6 below 0.001, without trailing zeros."""
    return _fixed(x, F.when(F.abs(x) < 0.001, 6).otherwise(4))


def shown(x: float) -> str:
    """show_number() of one finite number."""
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    return f"{x:.{6 if abs(x) < 0.001 else 4}f}".rstrip("0").rstrip(".")


def show_answer(num: Column, word: Column, text: Column) -> Column:
    """A result as the annotator's text suggests: as a percentage if the text means 100 times it."""
    percent = text.contains("%")
    meant = lambda p: F.when(p["value"].isNotNull(), F.abs(p["value"] - num * 100) < F.abs(p["value"] - num)).otherwise(p["word"].isNull() & percent & (F.abs(num) < 10))
    ratio = let(parse_answer(text), meant)
    shown = _fixed(num, F.when(F.abs(num) >= 1, 2).when(F.abs(num) < 0.001, 6).otherwise(4))
    return F.when(word.isNotNull(), word).when(ratio, F.concat(_trimmed(py_format(num * 100, F.lit(2))), F.lit("%"))).otherwise(F.concat(shown, F.when(percent, "%").otherwise("")))


def step_count(program: Column, strict: bool = False) -> Column:
    """Opening parentheses of a program; strict leaves out those that directly follow another."""
    n = F.regexp_count(program, F.lit(r"\("))
    return F.when(F.coalesce(program, F.lit("")) == "", 0).otherwise(n - F.regexp_count(program, F.lit(r"\(\(")) if strict else n)


def length_ratio(response: Column, question: Column) -> Column:
    return F.round(response / F.greatest(F.lit(1), question), 3)
