"""Standardising raw records, checking them and dropping the bad ones with a reason for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.functions import numbers as N
from lumenspark.functions import program as P
from lumenspark.functions import render as R
from lumenspark.functions import text as X
from lumenspark.functions.tokens import token_count

EVIDENCE = "array<struct<key:string,value:string>>"
# Names and order of the checks, the length limit, and the words a cut question ends in.
CHECKS = ["structural", "number_preservation", "program_executes", "answer_agreement", "grounding", "length"]
MAX_PROMPT_TOKENS = 1728
DROP_RULES = ["truncated_question", "question_year_mismatch"]
CUT_TAILS = ["of", "the", "a", "an", "and", "or", "with", "by", "was", "were", "is", "are"]
YEAR = r"\b(19[5-9]\d|20[0-2]\d)\b"
SHORT_YEAR = r"(?:'|/)(\d{2})\b"
HYPOTHETICAL = r"(?U)\b(would|will|expect\w*|assum\w*|if|project\w*|forecast\w*|estimat\w*|anticipat\w*|next)\b"


def union_answer(c: Column) -> tuple[Column, Column]:
    """num and txt of a JSON value that is a number or a text."""
    num = N.safe_double(c)
    return num.alias("exe_num"), F.when(num.isNull(), c).alias("exe_txt")


def standardize_program_records(raw: DataFrame, split: str) -> DataFrame:
    """Raw records with a nested qa struct to the canonical columns; nothing is dropped."""
    report = X.parse_report_id(F.col("filename"))
    num, txt = union_answer(F.col("qa.exe_ans"))
    return raw.select(
        "id",
        F.lit("finqa").alias("source"),
        F.lit("financial_reasoning").alias("domain"),
        F.lit(split).alias("original_split"),
        F.col("filename").alias("report_id"),
        report["company"].alias("company"),
        report["year"].alias("year"),
        F.col("qa.question").alias("question"),
        "pre_text",
        "table",
        "post_text",
        F.transform(F.map_entries("qa.gold_inds"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))).alias("gold_evidence"),
        F.col("qa.program").alias("program"),
        F.col("qa.program_re").alias("program_nested"),
        num,
        txt,
        F.col("qa.answer").alias("answer_text"),
    )


def standardize_span_records(raw: DataFrame, split: str) -> DataFrame:
    """Contexts with many questions to one row per question, questions and paragraphs by their order."""
    by_order = lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)
    paragraphs = F.transform(F.array_sort("paragraphs", by_order), lambda p: p["text"])
    rows = raw.select("table", paragraphs.alias("paragraphs"), F.posexplode(F.array_sort("questions", by_order)).alias("place", "q"))
    return rows.select(
        F.col("q.uid").alias("id"),
        F.lit("tatqa").alias("source"),
        F.lit("financial_reasoning").alias("domain"),
        F.lit(split).alias("original_split"),
        F.col("table.uid").alias("context_id"),
        F.col("q.question").alias("question"),
        F.col("table.table").alias("table"),
        "paragraphs",
        *[F.col(f"q.{c}").alias(c) for c in ("answer", "answer_type", "answer_from", "derivation", "scale")],
    )


def blank(c: Column) -> Column:
    return F.coalesce(X.is_blank(c), F.lit(True))


def labels(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def structural_issues(source: str = "finqa") -> Column:
    filled = F.exists("table", lambda r: F.exists(r, lambda c: X.strip(c) != ""))
    widths = F.array_distinct(F.transform("table", lambda r: F.size(r)))
    found = {"empty_question": blank(F.col("question")), "empty_table": ~F.coalesce(filled, F.lit(False)), "ragged_table": F.size(widths) > 1}
    if source == "finqa":
        found |= {
            "empty_program": blank(F.col("program")),
            "no_gold_evidence": F.coalesce(F.size("gold_evidence"), F.lit(0)) <= 0,
            "empty_answer_text": blank(F.col("answer_text")),
            "non_numeric_exe_ans": F.col("exe_txt").isNotNull(),
            "unparsed_report_id": F.col("company").isNull() | F.col("year").isNull(),
        }
    else:
        found["empty_answer"] = F.col("answer").isNull() | F.col("answer").isin("", "[]")
    return labels(found)


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys that occur more than once; empty for a sound table."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def clean_records(df: DataFrame) -> DataFrame:
    """Question, texts, table and evidence cleaned; the raw table and context stay beside them for the checks."""
    evidence = F.transform("gold_evidence", lambda e: e["value"])
    raw_context = X.decoded_join(F.concat("pre_text", "post_text", F.flatten("table")))
    return df.withColumns(
        {
            "raw_table": F.col("table"),
            "raw_context": raw_context,
            "question": X.clean_text(F.col("question")),
            "pre_text": X.clean_sentences(F.col("pre_text")),
            "post_text": X.clean_sentences(F.col("post_text")),
            "table": X.clean_table(F.col("table")),
            "gold_evidence": F.transform(F.arrays_zip(F.col("gold_evidence").alias("e"), X.clean_table(F.array(evidence))[0].alias("v")), lambda z: F.struct(z["e"]["key"].alias("key"), z["v"].alias("value"))),
        }
    )


def run_checks(df: DataFrame, tokens=token_count, max_tokens: int = MAX_PROMPT_TOKENS) -> DataFrame:
    """failed_checks (all that fail), first_failed and keep; test rows are always kept."""
    clean_context = F.array_join(F.concat("pre_text", "post_text", F.flatten("table")), " ")
    ran = df.withColumns({"__run": P.run(F.col("program"), F.col("raw_table")), "__stated": N.numbers_in(clean_context)})
    ran = ran.withColumns({"lost": F.array_sort(F.array_except(N.numbers_in(F.col("raw_context")), "__stated")), "agreement": N.answer_agrees(F.col("answer_text"), F.col("exe_num"), F.col("exe_txt"))})
    prompt = R.prompt(F.col("pre_text"), F.col("table"), F.col("post_text"), F.col("question"))
    ran = ran.withColumn("prompt_tokens", tokens(prompt))
    # no text has more tokens than characters and one, so most prompts need neither be rendered nor counted
    short = R.longest_prompt(F.col("pre_text"), F.col("table"), F.col("post_text"), F.col("question")) < max_tokens if tokens is token_count else F.lit(False)
    passes = {
        "structural": ~blank(F.col("question")) & (F.size("table") > 0) & ~blank(F.col("program")),
        "number_preservation": F.size("lost") == 0,
        "program_executes": N.same_result(F.col("__run.num"), F.col("__run.txt"), F.col("exe_num"), F.col("exe_txt")),
        "answer_agreement": F.coalesce("agreement", F.lit(False)),
        "grounding": F.coalesce(P.grounded(P.literals(F.col("__run.steps")), F.array_union("__stated", N.numbers_in(F.col("question")))), F.lit(True)),
        "length": F.when(short, F.lit(True)).otherwise(F.col("prompt_tokens") <= max_tokens),
    }
    return funnel(ran, {k: ~v for k, v in passes.items()}, F.col("original_split") == "test").drop("__run", "__stated")


def funnel(df: DataFrame, failures: dict[str, Column], exempt: Column | None = None) -> DataFrame:
    """failed_checks in order, first_failed (what a drop is charged to) and keep."""
    out = df.withColumn("failed_checks", labels(failures))
    out = out.withColumn("first_failed", F.get("failed_checks", F.lit(0)))
    fine = F.size("failed_checks") == 0
    return out.withColumn("keep", fine | exempt if exempt is not None else fine)


def funnel_report(df: DataFrame, names: list[str], exempt: Column | None = None) -> DataFrame:
    """(step, n): in, dropped_<name> for every name whether it fired or not, out; exempt rows aren't counted."""
    rows = df.filter(~exempt) if exempt is not None else df
    one = rows.agg(F.count("*").alias("in"), *[F.count_if(F.col("first_failed") == n).alias(f"dropped_{n}") for n in names], F.count_if(F.col("first_failed").isNull()).alias("out"))
    return one.unpivot([], one.columns, "step", "n")


def label_counts(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """How often each label of an array column occurs; a row counts for each of its labels."""
    return df.select(*groups, F.explode(column).alias("label")).groupBy(*groups, "label").agg(F.count("*").alias("n"))


def rule_totals(df: DataFrame, column: str) -> DataFrame:
    """(rule, n) of the rewriting rules over a text column, only those that fired, most frequent first.

    Only texts that aren't ASCII are normalised in Python; they are dealt out anew, so no worker starts where there are none.
    """
    texts = df.select(F.col(column).alias("t")).filter("t is not null")
    plain, other = texts.filter(X.is_ascii(F.col("t"))), texts.filter(~X.is_ascii(F.col("t"))).hint("rebalance")
    names = [name for name, _, _ in X.RULES]
    parts = [rows.select(X.rule_hits(F.col("t"), normal).alias("h")).agg(*[F.sum(F.col("h")[n]).alias(n) for n in names]) for rows, normal in ((plain, True), (other, False))]
    one = parts[0].unionByName(parts[1]).agg(*[F.sum(n).cast("long").alias(n) for n in names])
    return one.unpivot([], one.columns, "rule", "n").filter("n > 0").orderBy(F.desc("n"), "rule")


def truncated_question(question: Column) -> Column:
    """The last word is one that no sentence ends in, but for a `series a`."""
    q = X.strip(question)
    bare = F.regexp_replace(q, r"\?+$", "")
    tail = F.lower(F.try_element_at(F.split(X.strip(bare), r"(?U)\s+"), F.lit(-1)))
    return tail.isin(CUT_TAILS) & ~F.lower(bare).endswith("series a")


def missing_years(question: Column, context: Column) -> Column:
    """Years of the question that the context holds neither in full (as any substring) nor as 'YY or /YY."""
    short = F.transform(F.regexp_extract_all(context, F.lit(SHORT_YEAR), 1), lambda y: F.concat(F.lit("20"), y))
    return F.filter(F.regexp_extract_all(question, F.lit(YEAR), 1), lambda y: ~F.contains(context, y) & ~F.array_contains(short, y))


def year_mismatch(question: Column, context: Column) -> Column:
    return (F.size(missing_years(question, context)) > 0) & ~F.lower(question).rlike(HYPOTHETICAL)


def repetitive(sentences: Column) -> Column:
    """Of the sentences beyond 30 characters under 80 % are distinct."""
    long = F.filter(sentences, lambda s: F.length(s) > 30)
    return (F.size(long) > 0) & (F.size(F.array_distinct(long)) < 0.8 * F.size(long))


def quality_signals(df: DataFrame, tokens=token_count) -> DataFrame:
    """Signals of cleaned records with a response, then the drop funnel over DROP_RULES."""
    context = X.context_text(F.col("pre_text"), F.col("post_text"), F.col("table"), F.col("gold_evidence"))
    q = X.strip(F.col("question"))
    out = df.withColumns(
        {
            "truncated_question": truncated_question(F.col("question")),
            "missing_years": missing_years(q, context),
            "question_year_mismatch": year_mismatch(q, context),
            "question_tokens": tokens(q),
            "response_tokens": tokens(F.col("response")),
            "repetitive_context": repetitive(F.concat("pre_text", "post_text")),
            "program_steps": N.step_count(F.col("program"), strict=True),
        }
    )
    out = out.withColumn("length_ratio", N.length_ratio(F.col("response_tokens"), F.col("question_tokens"))).withColumn("low_length_ratio", F.col("response_tokens") / F.greatest(F.lit(1), "question_tokens") < 0.5)
    return funnel(out, {k: F.col(k) for k in DROP_RULES})


def examples(df: DataFrame, split: str, system: str) -> DataFrame:
    """The final projection: id, split, report, question, program, result, shown answer and messages."""
    user = R.prompt(F.col("pre_text"), F.col("table"), F.col("post_text"), F.col("question"))
    return df.select(
        "id",
        F.lit(split).alias("split"),
        *[c for c in ("report_id", "company", "year", "question", "program", "exe_num", "exe_txt") if c in df.columns],
        N.show_answer(F.col("exe_num"), F.col("exe_txt"), F.col("answer_text")).alias("answer"),
        R.messages(F.lit(system), user, F.coalesce("response", F.lit(""))).alias("messages"),
    )


def span_examples(df: DataFrame, system: str) -> DataFrame:
    """The projection of records with answer spans: no program, the spans as result, the shown answer and messages."""
    shown = R.display_answer(F.col("answer"), F.col("scale"))
    user = R.paragraph_prompt(F.col("table"), F.col("paragraphs"), F.col("question"))
    return df.select(
        "id",
        F.lit("tatqa").alias("dataset"),
        "question",
        F.lit("").alias("program"),
        F.col("answer").alias("exe_ans"),
        shown.alias("answer"),
        *[c for c in ("answer_type", "answer_from", "scale") if c in df.columns],
        R.messages(F.lit(system), user, F.concat(F.lit("Answer: "), shown)).alias("messages"),
    )


def with_response(df: DataFrame) -> DataFrame:
    """response: the executed calculation as text, null where the program can't be executed; and table_values, the row
    that each table step reads. Uses raw_table."""
    out = df.withColumn("__told", P.tell(F.col("program"), F.col("raw_table")))
    text = R.response(F.col("__told"), F.col("exe_num"), F.col("exe_txt"), F.col("answer_text"))
    return out.withColumns({"response": F.when(F.col("__told").isNotNull(), text), "table_values": F.transform("__told", lambda t: t["values"])}).drop("__told")


def with_raw_table(records: DataFrame, raw: DataFrame) -> DataFrame:
    """records with raw_table, the table of the raw record of the same id; records without one go."""
    return records.drop("raw_table").join(raw.select("id", F.col("table").alias("raw_table")), "id")


def status_counts(df: DataFrame) -> DataFrame:
    """(group, status, n): how many answers agree, disagree or are missing among test rows and the pool. Uses run_checks()."""
    group = F.when(F.col("original_split") == "test", "test").otherwise("pool")
    status = F.when(F.col("agreement").isNull(), "missing").when(F.col("agreement"), "agree").otherwise("disagree")
    return df.groupBy(group.alias("group"), status.alias("status")).agg(F.count("*").alias("n"))


def sentence_totals(df: DataFrame, *columns: str) -> DataFrame:
    """(rule, n) over array columns of sentences: rule_totals() and the sentences that go because only punctuation is left."""
    lines = df.select(F.explode(F.concat(*columns)).alias("s"))
    gone = lines.filter(X.clean_text(F.col("s")).rlike("(?U)" + X.PUNCTUATION_ONLY)).agg(F.count("*").alias("n"))
    return rule_totals(lines, "s").unionByName(gone.filter("n > 0").select(F.lit("dropped_empty_sentence").alias("rule"), "n"))
