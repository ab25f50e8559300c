"""Text normalisation: ordered rewriting rules as chained regular expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how a number is spelled in the rules below.
_NUM = r"\d[\d,]*(?:\.\d+)?"
# The artefacts of a known text extraction, in the order in which they must be rewritten.
DECODE_RULES = [
    ("decode_curly_double_quote", r"\b201[cd](?=\d{4}\b|[a-z]|\s|$)", '"'),
    ("decode_double_open_quote", r"\b2018 2018(?=[a-z])", '"'),
    ("decode_double_close_quote", r"(?<=[a-z.]) 2019 2019\b", '"'),
    ("decode_possessive", r"(?<=\w) 2019s\b", "'s"),
    ("decode_open_quote", r"\b2018(?=[a-z])", "'"),
    ("decode_close_quote", r"(?<=[a-z])2019\b", "'"),
    ("decode_bullet", r"\bf0b7\b", "-"),
]
# Spacing and annotation rules, in order.
SPACING_RULES = [
    ("dup_percent", rf"(-?{_NUM})\s*%\s*\(\s*-?{_NUM}\s*%\s*\)", "$1%"),
    ("dup_negative", rf"-({_NUM})\s*\(\s*\1\s*\)", "-$1"),
    ("empty_percent_annotation", r"%\s*\(\s*%\s*\)", "%"),
    ("dollar_space", r"\$\s+(?=-?\d)", r"\$"),
    ("percent_space", r"(\d)\s+%", "$1%"),
    ("space_before_punct", r"\s+([,.;:!?])(?=\s|$)", "$1"),
    ("paren_inner_space", r"\(\s+([^()]*?)\s+\)", "($1)"),
    ("double_terminal_punct", r"([.:;])\.(?=\s|$)", "$1"),
    ("possessive_space", r"\s+'(s|re|ve|ll|d|t)\b", "'$1"),
    ("negation_space", r"\s+n't\b", "n't"),
    ("multi_space", r"[ \t]{2,}", " "),
]
RULES = DECODE_RULES + SPACING_RULES
PUNCTUATION_ONLY = r"^[\s.,;:!?\-–—*]*$"
_FLAGS = "(?Ud)"
_SPACE = r"\s\x1c-\x1f"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, which Spark lacks."""
    return pd.Series([None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x) for x in s])


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")


def is_blank(c: Column) -> Column:
    """Nothing but white space of any kind, the first other character settles it; null for null."""
    return ~c.rlike(f"(?U)[^{_SPACE}]")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _applied(c: Column, rules: list[tuple[str, str, str]]) -> Column:
    for _, pattern, replacement in rules:
        c = F.regexp_replace(c, _FLAGS + pattern, replacement)
    return c


# Rules that follow each other, and what a text must hold for any of them to match: most texts hold little of it.
_DECODE = (DECODE_RULES, lambda t: t.contains("201") | t.contains("f0b7"))
_STAGES = [
    _DECODE,
    (SPACING_RULES[:3], lambda t: t.contains("(")),  # annotations in parentheses
    (SPACING_RULES[3:4], lambda t: t.contains("$")),
    (SPACING_RULES[4:5], lambda t: t.contains("%")),
    (SPACING_RULES[5:], lambda t: t.rlike(_FLAGS + r"\s[\s.,;:!?'n]|\(\s|[.;:]\.")),
]


def _staged(c: Column, stages: list) -> Column:
    def one(rules: list, needed):
        return lambda t: F.when(needed(t), _applied(t, rules)).otherwise(t)

    for rules, needed in stages:
        c = _let(c, one(rules, needed))
    return c


def decode_artifacts(c: Column) -> Column:
    return _staged(c, [_DECODE])


def decoded_join(c: Column) -> Column:
    """The texts of an array, each with its artefacts decoded, joined by spaces."""
    whole = F.array_join(c, " ")
    return F.when(_DECODE[1](whole), F.array_join(F.transform(c, decode_artifacts), " ")).otherwise(whole)


def rewrite(c: Column) -> Column:
    """All rules in order, then strip; the text must be in compatibility form already."""
    return strip(_staged(c, _STAGES))


def clean_text(c: Column) -> Column:
    return rewrite(nfkc(c))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_array(s: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in v] for v in s])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _nfkc_table(s: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [[None if x is None else unicodedata.normalize("NFKC", x) for x in r] for r in t] for t in s])


def clean_sentences(c: Column) -> Column:
    """Clean each sentence; those that are only punctuation go."""
    return F.filter(F.transform(_nfkc_array(c), rewrite), lambda x: ~x.rlike("(?U)" + PUNCTUATION_ONLY))


def clean_table(c: Column) -> Column:
    return F.transform(_nfkc_table(c), lambda row: F.transform(row, rewrite))


def is_ascii(c: Column) -> Column:
    """Such a text is in compatibility form as it is; null for null."""
    return F.octet_length(c) == F.char_length(c)


def rule_hits(c: Column, normal: bool = False) -> Column:
    """map of rule to how often it rewrites the text, in compatibility form, as its predecessors left it.

    `normal`: the text is in compatibility form already.
    """
    text, counts = F.coalesce(c if normal else nfkc(c), F.lit("")), []
    for _, pattern, replacement in RULES:  # the generated code computes each stage of the text once
        counts.append(F.regexp_count(text, F.lit(_FLAGS + pattern)))
        text = F.regexp_replace(text, _FLAGS + pattern, replacement)
    return F.map_from_arrays(F.array(*[F.lit(name) for name, _, _ in RULES]), F.array(*counts))


def comparable(c: Column) -> Column:
    """Lower case, punctuation but % . - as spaces, no articles, single spaces."""
    c = F.regexp_replace(F.lower(c), r"(?U)[^\w\s%.-]", " ")
    c = F.regexp_replace(c, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"(?U)\s+", " "))


def exact_key(c: Column) -> Column:
    """Lower case and single spaces: equal keys are exact copies."""
    return F.trim(F.regexp_replace(F.lower(c), rf"(?U)[{_SPACE}]+", " "))


def dedup_text(question: Column, evidence: Column) -> Column:
    """`evidence` is an array of struct(key, value)."""
    return F.concat(F.lit("question: "), question, F.lit("\nevidence: "), F.array_join(F.transform(evidence, lambda e: e["value"]), " "))


def context_text(pre: Column, post: Column, table: Column, evidence: Column) -> Column:
    return F.array_join(F.concat(pre, post, F.flatten(table), F.transform(evidence, lambda e: e["value"])), " ")


def parse_report_id(c: Column) -> Column:
    """struct(company, year) of company/year/...; nulls below three parts, year only if all digits."""
    parts = F.split(c, "/")
    enough = F.size(parts) >= 3
    year = F.get(parts, F.lit(1))
    return F.struct(F.when(enough, F.get(parts, F.lit(0))).alias("company"), F.when(enough & year.rlike("^[0-9]+$"), year.try_cast("int")).alias("year"))
