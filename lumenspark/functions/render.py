"""Prompts, tables and chat examples as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenspark.functions.numbers import let, show_answer
from lumenspark.functions.program import row_values
from lumenspark.functions.text import rewrite, strip

# How operations and table operations are worded.
SIGNS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "exp": "^"}
TABLE_WORDS = {"table_max": "maximum", "table_min": "minimum", "table_sum": "sum", "table_average": "average"}
DATE = "26 Jul 2024"


def table_markdown(table: Column) -> Column:
    """First row as header, rows padded to the widest, | in cells as /."""

    def shown(t: Column, width: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.translate(c, "|", "/")), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
        body = lambda lines: F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")
        return F.when(F.size(t) > 0, let(F.transform(t, line), body)).otherwise("")

    return let(table, lambda t: let(F.array_max(F.transform(t, lambda r: F.size(r))), lambda width: shown(t, width)))


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: strip(p) != ""), "\n\n")


def context(pre: Column, table: Column, post: Column) -> Column:
    return _joined([F.array_join(pre, " "), table_markdown(table), F.array_join(post, " ")])


def prompt(pre: Column, table: Column, post: Column, question: Column) -> Column:
    return F.concat(context(pre, table, post), F.lit("\n\nQuestion: "), question)


def longest_prompt(pre: Column, table: Column, post: Column, question: Column) -> Column:
    """A number of characters that prompt() doesn't exceed, told from the lengths of its parts."""
    sides = [F.length(F.array_join(t, " ")) for t in (pre, post)]
    width = F.array_max(F.transform(table, lambda r: F.size(r)))
    cells = F.length(F.array_join(F.flatten(table), "")) + (F.size(table) + 1) * (6 * width + 5)
    return sides[0] + sides[1] + cells + F.length(question) + 32


def paragraph_prompt(table: Column, paragraphs: Column, question: Column) -> Column:
    return F.concat(_joined([table_markdown(table), F.array_join(paragraphs, "\n\n")]), F.lit("\n\nQuestion: "), question)


def display_answer(items: Column, scale: Column) -> Column:
    suffix = F.create_map(*[F.lit(x) for x in ("percent", "%", "thousand", " thousand", "million", " million", "billion", " billion")])
    return F.concat(F.array_join(items, ", "), F.coalesce(F.try_element_at(suffix, scale), F.lit("")))


def argument_text(a: Column, shown: Column) -> Column:
    """`shown`: the results so far as text."""
    return (
        F.when(a.startswith("#"), F.get(shown, F.substr(a, F.lit(2)).try_cast("int")))
        .when(a == "const_m1", "-1")
        .when(a.startswith("const_"), F.substr(a, F.lit(7)))
        .otherwise(a)
    )


def response(steps: Column, num: Column, word: Column, answer_text: Column) -> Column:
    """Numbered calculation steps and the final answer.

    steps: array of struct(op, a1, a2, shown, row): each step's result as text and, for table steps, the row's values as
    text. The fold carries the results so far, which arguments may refer to.
    """
    words, signs = (F.create_map(*[F.lit(v) for kv in d.items() for v in kv]) for d in (TABLE_WORDS, SIGNS))
    nothing = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        x, y = argument_text(s["a1"], acc["shown"]), argument_text(s["a2"], acc["shown"])
        body = (
            F.when(s["op"].startswith("table_"), F.concat(F.try_element_at(words, s["op"]), F.lit(" of the '"), rewrite(s["a1"]), F.lit("' row ("), s["row"], F.lit(") = "), s["shown"]))
            .when(s["op"] == "greater", F.concat(F.lit("is "), x, F.lit(" greater than "), y, F.lit("? "), s["shown"]))
            .otherwise(F.concat(x, F.lit(" "), F.try_element_at(signs, s["op"]), F.lit(" "), y, F.lit(" = "), s["shown"]))
        )
        line = F.concat((F.size(acc["lines"]) + 1).cast("string"), F.lit(". "), body)
        return F.struct(F.concat(acc["shown"], F.array(s["shown"])).alias("shown"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    lines = F.aggregate(steps, F.struct(nothing.alias("shown"), nothing.alias("lines")), step, lambda acc: F.array_join(acc["lines"], "\n"))
    return F.concat(F.lit("Calculation:\n"), lines, F.lit("\n\nAnswer: "), show_answer(num, word, answer_text))


def messages(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))])


def chat(turns: Column) -> Column:
    """Chat text with the template's headers, its date pinned so that prompts don't change from day to day; no BOS."""
    head = lambda r: F.concat(F.lit("<|start_header_id|>"), r, F.lit("<|end_header_id|>\n\n"))
    date = F.lit(f"Cutting Knowledge Date: December 2023\nToday Date: {DATE}\n\n")
    one = lambda m: F.concat(head(m["role"]), F.when(m["role"] == "system", date).otherwise(""), strip(m["content"]), F.lit("<|eot_id|>"))
    return F.array_join(F.transform(turns, one), "")


__all__ = ["row_values", "table_markdown", "context", "prompt", "paragraph_prompt", "display_answer", "argument_text", "response", "messages", "chat"]
