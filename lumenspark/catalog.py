"""Every query of the library outside the training-data package, and its SQL.

Each query applies an operator to whole tables of a folder; records of the kinds that the tables lack are made from
orders, line items and conversations, the same way in the query and in its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspark.functions import numbers as N
from lumenspark.functions import program as P
from lumenspark.functions import render as R
from lumenspark.functions import scoring as S
from lumenspark.functions import text as X
from lumenspark.functions import tokens as K
from lumenspark.operators import curate, evaluate, labels, preference, similar, split
from lumenspark.operators.generate import generate
from lumenspark.operators.generate import request_issues as request_checks
from lumenspark.plans.spread import spread
from lumenspark.sources import files
from lumenspark.streaming import log

QUERIES: dict = {}
ORACLES: dict = {}
SEED = 11


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str, heavy: bool = False) -> DataFrame:
    """A whole table; `heavy` deals out small ones to all cores, for costly expressions."""
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if heavy else rows


# --- exact copies

_KEYS = r"WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM documents)"


def _keyed(s: SparkSession, d: str) -> DataFrame:
    """Copies are grouped by a 256-bit digest of the key, so that whole texts don't go through the shuffle."""
    return table(s, d, "documents", heavy=True).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), F.sha2(X.exact_key(F.col("text")), 256).alias("key"))


@query(f"{_KEYS} SELECT min(doc_id) AS first_id, count(*) AS copies FROM k GROUP BY key HAVING count(*) > 1")
def exact_dup_groups(s, d):
    return _keyed(s, d).groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").select("first_id", "copies")


@query(f"{_KEYS} SELECT coalesce(sum(n - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM k GROUP BY key)")
def exact_dup_extra_copies(s, d):
    return similar.extra_copies(_keyed(s, d), "key")


@query(f"{_KEYS} SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY key) AS a, doc_id AS b FROM k) WHERE a <> b")
def exact_dup_edges(s, d):
    return similar.star_edges(_keyed(s, d), "key").select("a", F.col("b"))


# --- numbers and text

_NUMS = r"list_distinct(list_filter(list_transform(regexp_extract_all({0}, '\d[\d,]*(?:\.\d+)?|\.\d+'), lambda x: abs(try_cast(replace(x, ',', '') AS DOUBLE))), lambda x: x IS NOT NULL))"


@query(f"WITH n AS (SELECT doc_id, {_NUMS.format('text')} AS v FROM documents) SELECT doc_id, len(v)::INT AS n, list_max(v) AS largest, list_min(v) AS smallest FROM n")
def numbers_in_docs(s, d):
    n = table(s, d, "documents", heavy=True).select("doc_id", N.numbers_in(F.col("text")).alias("v"))
    return n.select("doc_id", F.size("v").alias("n"), F.array_max("v").alias("largest"), F.array_min("v").alias("smallest"))


@query(
    f"WITH h AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS part FROM documents), n AS (SELECT doc_id, {_NUMS.format('text')} AS a, {_NUMS.format('part')} AS b FROM h) SELECT doc_id, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS lost FROM n"
)
def number_preservation(s, d):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(s, d, "documents").select("doc_id", F.size(N.lost_numbers(F.col("text"), first)).alias("lost"))


_W = r"[\p{L}\p{N}\p{M}_]"
_TOKENS = r"(len(regexp_extract_all({0}, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')) + 1)"


@query("SELECT doc_id, " + _TOKENS.replace("{0}", "text") + "::INT AS tokens, round(" + _TOKENS.replace("{0}", "text") + " / greatest(1, " + _TOKENS.replace("{0}", "split_part(text, chr(10), 1)") + "), 3) AS ratio FROM documents")
def token_lengths(s, d):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(s, d, "documents").select("doc_id", K.token_count(F.col("text")).alias("tokens"), N.length_ratio(K.token_count(F.col("text")), K.token_count(first)).alias("ratio"))


@query(
    r"""SELECT l_orderkey, l_linenumber, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf(CASE WHEN abs(x) < 0.001 THEN '%.6f' ELSE '%.4f' END, x), '0'), '.') END AS shown
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity / 7 AS x FROM lineitem)"""
)
def shown_numbers(s, d):
    return table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", N.show_number(F.col("l_extendedprice") / F.col("l_quantity") / 7).alias("shown"))


_ANSWER_TEXT = "CASE l_linenumber % 5 WHEN 0 THEN '(' || CAST(l_quantity AS BIGINT) || '.5)' WHEN 1 THEN '$ ' || CAST(l_quantity AS BIGINT) || '.25 million' WHEN 2 THEN CAST(l_quantity AS BIGINT) || '%' WHEN 3 THEN 'Yes.' ELSE 'n/a' END"


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN k = 3 THEN 'yes' END AS word, CASE k WHEN 0 THEN -(q + 0.5) WHEN 1 THEN q + 0.25 WHEN 2 THEN q END AS value, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END::INT AS decimals, CASE WHEN k < 3 THEN k = 2 END AS percent
FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS k, floor(l_quantity) AS q FROM lineitem)"""
)
def parsed_answers(s, d):
    return table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", N.parse_answer(F.expr(_ANSWER_TEXT)).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN true WHEN k = 1 THEN abs(q + 0.25 - (q + 9)) <= greatest(0.005 + 1e-9, 0.005 * abs(q + 9)) OR abs(q + 0.25 - 100 * (q + 9)) <= greatest(0.005 + 1e-9, 0.005 * abs(100 * (q + 9))) WHEN k = 2 THEN true WHEN k = 3 THEN 'yes' = (q / 100)::VARCHAR END AS agrees
FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS k, floor(l_quantity) AS q FROM lineitem)"""
)
def answer_agreement(s, d):
    q, k = F.floor("l_quantity").cast("double"), F.col("l_linenumber") % 5
    result = F.when(k == 0, -(q + 0.5)).when(k == 1, q + 9).otherwise(q / 100)
    return table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", N.answer_agrees(F.expr(_ANSWER_TEXT), result, F.lit(None).cast("string")).alias("agrees"))


_DIRTY = [
    ("2.05% ( 2.05 % )", "2.05%"),
    ("$ -23158 ( 23158 )", "$-23158"),
    ("( 10 ) % ( % )", "(10) %"),
    ("company 2019s plan", "company's plan"),
    ("progress ..", "progress ."),
    ("201cword said 201d", '"word said "'),
    ("don 't do n't  go", "don't don't go"),
    ("f0b7 item ; next", "- item; next"),
]


@query("SELECT c_custkey AS id, [" + ", ".join("'" + c.replace("'", "''") + "'" for _, c in _DIRTY) + "][c_custkey % " + str(len(_DIRTY)) + " + 1] AS cleaned FROM customer")
def clean_text_rules(s, d):
    """Each customer with one of the texts above."""
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _DIRTY]), (F.col("c_custkey") % len(_DIRTY) + 1).cast("int"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), X.clean_text(text).alias("cleaned"))


# Line items as reports word them; each kind sets off three or four rules once.
_WORDED = [
    ("rose 5 % ( 5.1 % ) to $ 12 ..", ["dup_percent", "dollar_space", "double_terminal_punct"]),
    ("( 8 ) , they don 't or do n't", ["paren_inner_space", "space_before_punct", "possessive_space", "negation_space"]),
    ("f0b7 a  b fell -3 ( 3 )", ["decode_bullet", "dup_negative", "multi_space"]),
]


@query("SELECT rule, count(*) AS n FROM lineitem JOIN (VALUES " + ", ".join(f"({i}, '{r}')" for i, (_, rules) in enumerate(_WORDED) for r in rules) + ") AS t(k, rule) ON k = l_linenumber % 3 GROUP BY rule")
def rule_totals(s, d):
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _WORDED]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return curate.rule_totals(table(s, d, "lineitem", heavy=True).select(text.alias("text")), "text")


@query()
def cleaned_documents(s, d):
    docs = table(s, d, "documents", heavy=True)
    return docs.select("doc_id", F.sha2(X.clean_text(F.col("text")), 256).alias("cleaned_sha256"), F.sha2(X.comparable(F.col("text")), 256).alias("comparable_sha256"))


@query("SELECT o_orderkey, CASE WHEN k < 2 THEN 'c' || (o_custkey % 50) END AS company, CASE WHEN k = 0 THEN year(o_orderdate)::INT END AS year FROM (SELECT *, o_orderkey % 3 AS k FROM orders)")
def report_ids(s, d):
    k = F.col("o_orderkey") % 3
    name = F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string"))
    rid = F.when(k == 0, F.concat_ws("/", name, F.year("o_orderdate").cast("string"), F.lit("page_1.pdf"))).when(k == 1, F.concat_ws("/", name, F.lit("20x9"), F.lit("p"))).otherwise(F.concat_ws("/", name, F.lit("2009")))
    return table(s, d, "orders").select("o_orderkey", X.parse_report_id(rid).alias("r")).select("o_orderkey", "r.*")


# --- curation

_ISSUES = "WITH i AS (SELECT d.doc_id, d.n_chars < 400 AS short_text, d.lang <> 'en' AS other_language, l.quality IS NULL AS unlabelled, coalesce(l.quality = 0, false) AS low_quality FROM documents d LEFT JOIN labels l USING (doc_id))"
_ISSUE_NAMES = ["short_text", "other_language", "unlabelled", "low_quality"]


def _issues(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    conditions = {"short_text": F.col("n_chars") < 400, "other_language": F.col("lang") != "en", "unlabelled": F.col("quality").isNull(), "low_quality": F.coalesce(F.col("quality") == 0, F.lit(False))}
    return curate.funnel(rows, conditions)


@query(_ISSUES + " SELECT label, n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM i WHERE {n}" for n in _ISSUE_NAMES) + ") WHERE n > 0")
def structural_issues_count(s, d):
    return curate.label_counts(_issues(s, d), "failed_checks")


@query(
    _ISSUES + ", f AS (SELECT CASE WHEN short_text THEN 'short_text' WHEN other_language THEN 'other_language' WHEN unlabelled THEN 'unlabelled' WHEN low_quality THEN 'low_quality' END AS c FROM i) SELECT 'in' AS step, count(*) AS n FROM f UNION ALL "
    + " UNION ALL ".join(f"SELECT 'dropped_{n}', count(*) FILTER (WHERE c = '{n}') FROM f" for n in _ISSUE_NAMES)
    + " UNION ALL SELECT 'out', count(*) FILTER (WHERE c IS NULL) FROM f"
)
def funnel_first_fail(s, d):
    return curate.funnel_report(_issues(s, d), _ISSUE_NAMES)


@query("SELECT doc_id, len(l) > 0 AND len(list_distinct(l)) < 0.8 * len(l) AS repetitive FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 30) AS l FROM documents)")
def repetitive_lines(s, d):
    return table(s, d, "documents").select("doc_id", curate.repetitive(F.split("text", "\n")).alias("repetitive"))


_TAILS = ", ".join(f"'{w}'" for w in curate.CUT_TAILS)


@query(
    rf"""SELECT conv_id, turn, lower(list_extract(string_split_regex(trim(regexp_replace(trim(t), '\?+$', '')), '\s+'), -1)) IN ({_TAILS}) AND NOT ends_with(lower(regexp_replace(trim(t), '\?+$', '')), 'series a') AS truncated
FROM (SELECT conv_id, turn, regexp_replace(trim(text), '[.]$', '') AS t FROM conversations)"""
)
def truncated_tail(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", curate.truncated_question(F.regexp_replace(F.trim("text"), "[.]$", "")).alias("truncated"))


@query(
    r"""WITH q AS (SELECT o_orderkey, 'total of ' || year(o_orderdate) || ' and ' || (2000 + o_orderkey % 13) || CASE WHEN o_orderkey % 5 = 0 THEN ' if sold' ELSE '' END AS q, 'in ' || year(o_orderdate) || CASE WHEN o_orderkey % 2 = 0 THEN ' fy''' || printf('%02d', o_orderkey % 13) ELSE ' x' END AS c, o_orderkey % 13 AS y, year(o_orderdate) AS oy FROM orders)
SELECT o_orderkey, (NOT contains(c, (2000 + y)::VARCHAR)) AND o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0 AS mismatch FROM q"""
)
def year_mismatch(s, d):
    year, y = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 13
    question = F.concat(F.lit("total of "), year, F.lit(" and "), (2000 + y).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, " if sold").otherwise(""))
    context = F.concat(F.lit("in "), year, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" fy'"), F.lpad(y.cast("string"), 2, "0"))).otherwise(" x"))
    return table(s, d, "orders").select("o_orderkey", curate.year_mismatch(question, context).alias("mismatch"))


def _records(s, d):
    """One canonical record per order, made from its line items; some are broken on purpose."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("string").alias("q"))
    per = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "q")))["q"].alias("qs"), F.sum(F.col("q").cast("double")).alias("total"))
    k, total = F.col("l_orderkey"), F.col("total")
    shown = total.cast("long").cast("string")
    return per.select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"),
        k.alias("number"),
        F.lit("finqa").alias("source"),
        F.when(k % 11 == 0, "test").otherwise("train").alias("original_split"),
        F.when(k % 13 == 0, "short/id").otherwise(F.concat_ws("/", F.lit("co"), F.lit("2009"), k.cast("string"))).alias("report_id"),
        F.lit("co").alias("company"),
        F.when(k % 13 != 0, F.lit(2009)).alias("year"),
        F.when(k % 17 == 0, " ").otherwise("what is the total of quantity ?").alias("question"),
        F.array(F.lit("order of goods ,"), F.lit(".")).alias("pre_text"),
        F.array(F.lit("end .")).alias("post_text"),
        F.array(F.concat(F.array(F.lit("item")), F.transform("qs", lambda x, i: (i + 1).cast("string"))), F.concat(F.array(F.lit("quantity")), F.transform("qs", lambda x: F.concat(F.lit("$ "), x)))).alias("table"),
        F.array(F.struct(F.lit("table_1").alias("key"), F.lit("the quantity").alias("value"))).alias("gold_evidence"),
        F.when(k % 19 == 0, "add(99999, 1), subtract(#0, 100000)").otherwise("table_sum(quantity, none), add(#0, const_0)").alias("program"),
        F.when(k % 7 == 0, total + 5).otherwise(F.when(k % 19 == 0, 0.0).otherwise(total)).alias("exe_num"),
        F.lit(None).cast("string").alias("exe_txt"),
        F.when(k % 5 == 0, "").otherwise(F.when(k % 19 == 0, "0").otherwise(shown)).alias("answer_text"),
    )


_REC = """WITH r AS (SELECT l_orderkey AS k, sum(floor(l_quantity)) AS t FROM lineitem GROUP BY 1), c AS (SELECT k, t, k % 17 = 0 AS f_structural, k % 7 = 0 AS f_runs,
 k % 5 = 0 OR (k % 19 = 0 AND k % 7 = 0 AND NOT (abs(0 - (t + 5)) <= greatest(0.5 + 1e-9, 0.005 * (t + 5)))) OR (k % 19 <> 0 AND k % 7 = 0 AND NOT (5 <= greatest(0.5 + 1e-9, 0.005 * (t + 5)))) AS f_agree, k % 19 = 0 AS f_ground FROM r)"""


@query(
    _REC
    + """, f AS (SELECT CASE WHEN f_structural THEN 's' WHEN f_runs THEN 'p' WHEN f_agree THEN 'a' WHEN f_ground THEN 'g' END AS x FROM c WHERE k % 11 <> 0)
SELECT 'in' AS step, count(*) AS n FROM f UNION ALL SELECT 'dropped_structural', count(*) FILTER (WHERE x = 's') FROM f UNION ALL SELECT 'dropped_number_preservation', 0 UNION ALL SELECT 'dropped_program_executes', count(*) FILTER (WHERE x = 'p') FROM f
UNION ALL SELECT 'dropped_answer_agreement', count(*) FILTER (WHERE x = 'a') FROM f UNION ALL SELECT 'dropped_grounding', count(*) FILTER (WHERE x = 'g') FROM f UNION ALL SELECT 'dropped_length', 0 UNION ALL SELECT 'out', count(*) FILTER (WHERE x IS NULL) FROM f"""
)
def curation_funnel(s, d):
    checked = curate.run_checks(curate.clean_records(_records(s, d)))
    return curate.funnel_report(checked, curate.CHECKS, F.col("original_split") == "test")


def _harder(s, d):
    """The records, of which some lose a number in cleaning and some have a question beyond the length limit."""
    k = F.col("number")
    pre = F.when(k % 23 == 0, F.array(F.lit("sales rose 5 % ( 66 % ) .")))
    asked = F.when((k % 29 == 0) & (k % 17 != 0), F.concat(F.lit("what is "), F.repeat(F.lit("very "), F.lit(1800)), F.lit("large ?")))
    return _records(s, d).withColumns({"pre_text": F.coalesce(pre, "pre_text"), "question": F.coalesce(asked, "question")})


_HARD = _REC.replace("k % 19 = 0 AS f_ground FROM r)", "k % 19 = 0 AS f_ground, k % 23 = 0 AS f_lost, k % 29 = 0 AND k % 17 <> 0 AS f_long, k % 5 = 0 AS f_empty FROM r)")
_HARD_FIRST = "CASE WHEN f_structural THEN 'structural' WHEN f_lost THEN 'number_preservation' WHEN f_runs THEN 'program_executes' WHEN f_agree THEN 'answer_agreement' WHEN f_ground THEN 'grounding' WHEN f_long THEN 'length' END"


@query(
    _HARD
    + f", f AS (SELECT {_HARD_FIRST} AS x FROM c WHERE k % 11 <> 0) SELECT 'in' AS step, count(*) AS n FROM f"
    + "".join(f" UNION ALL SELECT 'dropped_{c}', count(*) FILTER (WHERE x = '{c}') FROM f" for c in curate.CHECKS)
    + " UNION ALL SELECT 'out', count(*) FILTER (WHERE x IS NULL) FROM f"
)
def curation_funnel_all_checks(s, d):
    checked = curate.run_checks(curate.clean_records(_harder(s, d)))
    return curate.funnel_report(checked, curate.CHECKS, F.col("original_split") == "test")


@query(_HARD + """ SELECT CASE WHEN k % 11 = 0 THEN 'test' ELSE 'pool' END AS "group", CASE WHEN f_empty THEN 'missing' WHEN f_agree THEN 'disagree' ELSE 'agree' END AS status, count(*) AS n FROM c GROUP BY ALL""")
def answer_statuses(s, d):
    return curate.status_counts(curate.run_checks(curate.clean_records(_harder(s, d))))


@query(
    """WITH r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), n AS (SELECT count(*) AS a, count(*) FILTER (WHERE k % 23 <> 0) AS b, count(*) FILTER (WHERE k % 23 = 0) AS c FROM r)
SELECT rule, n FROM (SELECT 'space_before_punct' AS rule, a + b + c AS n FROM n UNION ALL SELECT 'dup_percent', c FROM n UNION ALL SELECT 'dropped_empty_sentence', b FROM n) WHERE n > 0"""
)
def sentence_rules(s, d):
    return curate.sentence_totals(_harder(s, d), "pre_text", "post_text")


@query("SELECT l_orderkey AS number, (count(*) + 1)::INT AS width FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1")
def raw_tables(s, d):
    records = _records(s, d)
    joined = curate.with_raw_table(records.drop("table"), records.filter("number % 3 <> 0"))
    return joined.select("number", F.size(F.col("raw_table")[1]).alias("width"))


@query(
    """WITH r AS (SELECT l_orderkey AS number, sum(floor(l_quantity))::BIGINT AS t FROM lineitem GROUP BY 1)
SELECT number, 'Answer: ' || CASE WHEN number % 7 = 0 THEN t + 5 WHEN number % 19 = 0 THEN 0 ELSE t END AS answer FROM r"""
)
def rendered_answers(s, d):
    out = curate.with_response(_records(s, d).withColumn("raw_table", F.col("table")))
    return out.select("number", F.split_part("response", F.lit("\n\n"), F.lit(2)).alias("answer"))


@query(
    """SELECT l_orderkey || '-' || l_linenumber AS id, 'tatqa' AS dataset, '' AS program, floor(l_quantity)::BIGINT || CASE WHEN l_linenumber % 2 = 0 THEN '%' ELSE ' million' END AS answer,
md5('| a/b |' || chr(10) || '| --- |' || chr(10) || chr(10) || 'paid ' || l_linenumber || chr(10) || chr(10) || 'Question: how much?') AS user_md5, 'Answer: ' || floor(l_quantity)::BIGINT || CASE WHEN l_linenumber % 2 = 0 THEN '%' ELSE ' million' END AS reply FROM lineitem"""
)
def span_examples(s, d):
    rows = table(s, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.lit("how much?").alias("question"),
        F.array(F.array(F.lit("a|b"))).alias("table"),
        F.array(F.concat(F.lit("paid "), F.col("l_linenumber").cast("string"))).alias("paragraphs"),
        F.array(F.floor("l_quantity").cast("string")).alias("answer"),
        F.when(F.col("l_linenumber") % 2 == 0, "percent").otherwise("million").alias("scale"),
    )
    return curate.span_examples(rows, "Answer.").select("id", "dataset", "program", "answer", F.md5(F.col("messages")[1]["content"]).alias("user_md5"), F.col("messages")[2]["content"].alias("reply"))


@query("WITH r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT label, n FROM (SELECT 'empty_question' AS label, count(*) FILTER (WHERE k % 17 = 0) AS n FROM r UNION ALL SELECT 'empty_answer_text', count(*) FILTER (WHERE k % 5 = 0) FROM r UNION ALL SELECT 'unparsed_report_id', count(*) FILTER (WHERE k % 13 = 0) FROM r) WHERE n > 0")
def record_issues(s, d):
    return curate.label_counts(_records(s, d).withColumn("issues", curate.structural_issues()), "issues")


@query(
    """WITH r AS (SELECT l_orderkey AS number, list(floor(l_quantity)::BIGINT::VARCHAR ORDER BY l_linenumber, floor(l_quantity)::BIGINT::VARCHAR) AS q, sum(floor(l_quantity))::BIGINT AS t FROM lineitem GROUP BY 1)
SELECT number, CASE WHEN number % 19 = 0 THEN 'Calculation:' || chr(10) || '1. 99999 + 1 = 100000' || chr(10) || '2. 100000 - 100000 = 0' ELSE 'Calculation:' || chr(10) || '1. sum of the ''quantity'' row (' || array_to_string(q, ', ') || ') = ' || t || chr(10) || '2. ' || t || ' + 0 = ' || t END AS calculation FROM r"""
)
def rendered_responses(s, d):
    out = curate.with_response(_records(s, d).withColumn("raw_table", F.col("table")))
    return out.select("number", F.split_part("response", F.lit("\n\n"), F.lit(1)).alias("calculation"))


@query()
def final_examples(s, d):
    cleaned = curate.with_response(curate.clean_records(_records(s, d)))
    return curate.examples(cleaned, "train", "Answer from the report.").select("id", "split", "answer", F.sha2(F.to_json("messages"), 256).alias("messages_sha256"))


@query()
def quality_report(s, d):
    scored = curate.quality_signals(curate.with_response(curate.clean_records(_records(s, d))))
    return curate.funnel_report(scored, curate.DROP_RULES)


@query("SELECT conv_id, conv_id || '-' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, md5(text) AS question_md5 FROM conversations WHERE role = 'user'")
def span_records(s, d):
    turns = table(s, d, "conversations")
    uid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    none = F.lit(None).cast("string")
    q = F.struct(uid.alias("uid"), F.col("turn").cast("int").alias("order"), F.col("text").alias("question"), none.alias("answer"), none.alias("answer_type"), none.alias("answer_from"), none.alias("derivation"), none.alias("scale"))
    contexts = turns.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", q)).alias("questions"), F.collect_list(F.when(F.col("role") != "user", F.struct(F.col("turn").cast("int").alias("order"), "text"))).alias("paragraphs"))
    raw = contexts.select(F.struct(F.col("conv_id").cast("string").alias("uid"), F.array(F.array(F.lit("x"))).alias("table")).alias("table"), "paragraphs", "questions")
    rows = curate.standardize_span_records(raw, "dev")
    number = F.split_part("id", F.lit("-"), F.lit(2)).cast("int")
    place = F.row_number().over(W.partitionBy("context_id").orderBy(number)) - 1
    return rows.select(F.col("context_id").cast("long").alias("conv_id"), "id", place.cast("long").alias("place"), F.md5("question").alias("question_md5"))


# --- programs

_LINE = "SELECT l_orderkey, l_linenumber, l_extendedprice AS p, l_quantity AS q, l_discount AS s FROM lineitem"


def _program(s, d):
    text = F.concat(F.lit("divide("), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(", "), F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.lit("), multiply(#0, const_100), subtract(#1, 12.5%), greater(#2, "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(")"))
    return table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", text.alias("program"))


@query(f"SELECT l_orderkey, l_linenumber, round(p / q, 8) AS r0, round(p / q * 100 - 0.125, 8) AS r2, CASE WHEN p / q * 100 - 0.125 > p THEN 'yes' ELSE 'no' END AS r3 FROM ({_LINE})")
def program_exec(s, d):
    run = _program(s, d).withColumn("res", P.results(F.col("program"), F.array().cast("array<array<string>>")))
    return run.select("l_orderkey", "l_linenumber", F.round(F.col("res")[0]["num"], 8).alias("r0"), F.round(F.col("res")[2]["num"], 8).alias("r2"), F.col("res")[3]["txt"].alias("r3"))


@query(f"SELECT l_orderkey, l_linenumber, 4 AS steps, (2 + CASE WHEN p = q THEN 0 ELSE 1 END)::INT AS literals FROM ({_LINE})")
def program_parse_deep(s, d):
    run = _program(s, d).withColumn("steps", P.parse(F.col("program"), deep=True))
    return run.select("l_orderkey", "l_linenumber", F.size("steps").alias("steps"), F.size(P.argument_set(F.col("steps"))).alias("literals"))


@query(
    """WITH r AS (SELECT l_orderkey, max(l_quantity) AS hi, min(l_quantity) AS lo, sum(l_quantity) AS total, avg(l_quantity) AS mean FROM lineitem GROUP BY 1) SELECT l_orderkey, hi, lo, round(total, 4) AS total, round(mean, 4) AS mean FROM r"""
)
def table_ops_exec(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: F.concat(F.lit("$ "), x["l_quantity"].cast("string"), F.lit(" ( x )"))).alias("cells"))
    grid = F.array(F.array(F.lit("head")), F.concat(F.array(F.lit(" net (loss) ")), F.col("cells")))
    program = F.lit("table_max(net (loss), none), table_min(net (loss), none), table_sum(net (loss), none), table_average(net (loss), none)")
    run = lines.select("l_orderkey", P.execute_steps(P.parse(program), grid).alias("res"))
    return run.select("l_orderkey", F.col("res")[0]["num"].alias("hi"), F.col("res")[1]["num"].alias("lo"), F.round(F.col("res")[2]["num"], 4).alias("total"), F.round(F.col("res")[3]["num"], 4).alias("mean"))


@query(f"SELECT l_orderkey, l_linenumber, abs(q - round(q)) <= 1e-9 + 1e-6 * round(q) AS grounded FROM ({_LINE})")
def grounded_numbers(s, d):
    t = table(s, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", P.grounded(F.array("l_quantity"), F.array(F.round("l_quantity"), F.lit(1e12))).alias("grounded"))


# --- scoring

_OUT = "SELECT l_orderkey, l_linenumber, l_orderkey % 4 AS k, floor(l_quantity) AS q FROM lineitem"


def _outputs(s, d):
    q, k = F.floor("l_quantity"), F.col("l_orderkey") % 4
    qs = q.cast("string")
    output = (
        F.when(k == 0, F.concat(F.lit("so\nAnswer: 3\nanswer: "), qs, F.lit(".0")))
        .when(k == 1, F.concat(F.lit("It declined "), qs, F.lit("%")))
        .when(k == 2, F.concat(F.lit("ANSWER： ("), qs, F.lit(")")))
        .otherwise(F.concat(F.lit("Answer: yes, about "), (q + 2).cast("string")))
    )
    gold = F.when(k == 0, q.cast("double")).when(k == 1, -q / 100).when(k == 2, q.cast("double")).otherwise(q.cast("double"))
    question = F.when(F.col("l_linenumber") % 2 == 0, "what is the difference?").otherwise("what is it?")
    t = table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", k.alias("k"), F.col("l_quantity"), output.alias("output"), gold.alias("gold"), question.alias("question"))
    none = F.lit(None).cast("string")
    lenient = S.is_correct(F.col("output"), F.col("gold"), none, F.col("question"))
    strict = S.is_correct(F.col("output"), F.col("gold"), none, F.col("question"), strict_sign=True)
    return t.withColumn("x", lenient).withColumn("y", strict).select("*", F.col("x.correct").alias("correct"), F.col("x.extracted").alias("extracted"), F.col("y.correct").alias("strict"))


_NEAR = "(abs({v} - g) <= greatest(0.5 * pow(10, -{d}) + 1e-9, 0.001 * abs(g)) OR abs({v} - 100 * g) <= greatest(0.5 * pow(10, -{d}) + 1e-9, 0.001 * abs(100 * g)))"
_SCORED = f"""WITH o AS (SELECT *, CASE k WHEN 0 THEN q WHEN 1 THEN -q / 100 ELSE q END AS g, CASE k WHEN 0 THEN q WHEN 1 THEN q WHEN 2 THEN -q ELSE q + 2 END AS v, CASE k WHEN 0 THEN 1 ELSE 0 END AS dd FROM ({_OUT})),
sc AS (SELECT *, {_NEAR.format(v="v", d="dd")} AS strict, {_NEAR.format(v="v", d="dd")} OR (k = 1 AND g < 0 AND v > 0 AND {_NEAR.format(v="(-v)", d="dd")}) OR (l_linenumber % 2 = 0 AND {_NEAR.format(v="(-v)", d="dd")}) AS correct FROM o)"""


@query(_SCORED + " SELECT l_orderkey, l_linenumber, correct, strict, CASE k WHEN 0 THEN q::BIGINT || '.0' WHEN 1 THEN 'It declined ' || q::BIGINT || '%' WHEN 2 THEN '(' || q::BIGINT || ')' ELSE 'yes, about ' || (q + 2)::BIGINT END AS extracted FROM sc")
def score_answers(s, d):
    return _outputs(s, d).select("l_orderkey", "l_linenumber", "correct", "strict", "extracted")


@query(_SCORED + " SELECT CASE WHEN k >= 3 THEN '3+' ELSE k::VARCHAR END AS bucket, count(*) AS n, round(avg(correct::INT), 4) AS accuracy FROM sc GROUP BY 1")
def accuracy_by_bucket(s, d):
    return evaluate.accuracy_by(_outputs(s, d), evaluate.step_bucket(F.col("k")))


@query(_SCORED + " SELECT count(*) AS n, round(avg(correct::INT), 4) AS accuracy, round(avg((k IN (0, 3))::INT), 4) AS answer_line_rate, round(avg((q > 40)::INT), 4) AS hit_max_new_tokens_rate, round(avg(q), 1) AS mean_output_tokens FROM sc")
def summary(s, d):
    rows = _outputs(s, d).withColumns({"hit_limit": F.floor("l_quantity") > 40, "output_tokens": F.floor("l_quantity")})
    return evaluate.summary(rows)


@query(_SCORED + " SELECT count(*) AS n, count(*) FILTER (WHERE b.correct <> a.strict) AS changed, round(avg(b.correct::INT), 4) AS accuracy FROM sc a JOIN sc b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def rescore(s, d):
    rows = _outputs(s, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return evaluate.rescore(rows.select("id", F.col("strict").alias("correct")), rows.select("id", "correct"), "id")


@query(
    """WITH o AS (SELECT l_orderkey % 4 AS k, l_linenumber % 2 = 0 AS yes, l_linenumber % 3 <> 0 AS fine FROM lineitem), x AS (SELECT k, fine, CASE k WHEN 1 THEN 0 WHEN 3 THEN yes::INT ELSE 1 END AS c, CASE k WHEN 0 THEN 1 WHEN 3 THEN yes::INT ELSE 0 END AS s, CASE k WHEN 3 THEN yes::INT ELSE 1 END AS l FROM o)
SELECT count(*) AS n, round(avg(c), 4) AS accuracy, round(avg(s), 4) AS accuracy_strict_sign, round(avg(l), 4) AS accuracy_lenient, round(avg(c) FILTER (WHERE k = 3), 4) AS accuracy_yes_no, round(avg(c) FILTER (WHERE fine), 4) AS accuracy_label_consistent FROM x"""
)
def accuracy_report(s, d):
    k = F.col("l_orderkey") % 4
    rows = table(s, d, "lineitem", heavy=True).select(
        F.when(k == 0, "Answer: 12").when(k == 1, "Answer: 1004").when(k == 2, "it declined 5").otherwise("Answer: Yes").alias("output"),
        F.when(k == 0, 12.0).when(k == 1, 1000.0).when(k == 2, -5.0).alias("gold_num"),
        F.when(k == 3, F.when(F.col("l_linenumber") % 2 == 0, "yes").otherwise("no")).alias("gold_word"),
        F.lit("how much?").alias("question"),
        (F.col("l_linenumber") % 3 != 0).alias("label_consistent"),
    )
    return evaluate.accuracy_report(rows)


@query("SELECT coalesce(lang, '-') AS bucket, count(*) AS n, round(avg((quality = 1)::INT), 4) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def accuracy_by_type(s, d):
    rows = table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("correct")).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.accuracy_by(rows, F.coalesce("lang", F.lit("-")))


@query("SELECT conv_id, array_to_string(list_sort(list_filter([CASE WHEN mx > 2 THEN 'max_tokens' END, CASE WHEN lst <> 'user' THEN 'last_turn_not_user' END], lambda x: x IS NOT NULL)), ',') AS issues FROM (SELECT conv_id, conv_id % 4 AS mx, arg_max(role, turn) AS lst FROM conversations GROUP BY conv_id)")
def request_issues(s, d):
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    issues = request_checks(F.when(F.col("conv_id") % 4 > 2, 2000).otherwise(256), F.col("turns"))
    return turns.select("conv_id", F.array_join(F.array_sort(issues), ",").alias("issues"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE l_linenumber % 2 = 0 END AS correct FROM lineitem"""
)
def score_spans(s, d):
    k, q = F.col("l_orderkey") % 3, F.floor("l_quantity")
    scale = F.when(k == 0, "million").otherwise("")
    items = F.when(k == 0, F.array(q.cast("string"))).when(k == 1, F.array(F.lit("The Net-Income"), F.lit("$1,200"))).otherwise(F.array(F.lit("cash flow")))
    output = F.when(k == 0, F.concat(F.lit("Answer: $ "), (q * 1_000_000).cast("string"))).when(k == 1, F.lit("answer: net-income, and 1200.0!")).otherwise(F.when(F.col("l_linenumber") % 2 == 0, "Cash, flow").otherwise("cash book"))
    return table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", S.is_correct_spans(output, items, scale)["correct"].alias("correct"))


@query(
    """WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c FROM labels)
SELECT b AS a_only, c AS b_only, round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(0, 1000000) t(i) WHERE i <= least(b, c))), 4) AS p FROM c"""
)
def paired_mcnemar(s, d):
    rows = table(s, d, "labels")
    return evaluate.paired_test(rows.select("doc_id", (F.col("quality") == 1).alias("correct")), rows.select("doc_id", (F.col("toxic") == 1).alias("correct")), "doc_id")


# --- similarity

_UNIT = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, vec_id % 10 = 0 AS is_test FROM embeddings), s AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) AS sim FROM e x JOIN e y ON x.vec_id <> y.vec_id), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5), p AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM k), n AS (SELECT p.a, p.b, list_dot_product(x.v, y.v) AS sim, x.label = y.label AS same, x.is_test AS ta, y.is_test AS tb FROM p JOIN e x ON x.vec_id = a JOIN e y ON y.vec_id = b WHERE NOT (x.is_test AND y.is_test))"


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 10 == 0).alias("is_test"))


def _pairs(s, d):
    v = _vectors(s, d)
    labels = v.select("id", "label")
    pairs = similar.neighbour_pairs(v)
    return pairs.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").withColumn("same", F.col("la") == F.col("lb"))


@query(_UNIT + " SELECT a, b, round(sim, 6) AS sim FROM n")
def knn_pairs_top5(s, d):
    return _pairs(s, d).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_UNIT + " SELECT a, b FROM n WHERE sim >= 0.3 AND same")
def knn_rule_edges(s, d):
    fires = similar.rule_fires(F.lit(similar.RULES[1]), F.col("sim"), F.lit(0.3), F.col("same"), F.col("same"))
    return _pairs(s, d).filter(fires).select("a", "b")


_GRID = "(VALUES (0, 'similarity'), (1, 'similarity+same_answer'), (2, 'similarity+same_answer+same_args')) AS g(rule_index, rule), (VALUES (0.2), (0.3), (0.4)) AS t(threshold)"
_DETECT = f"""{_UNIT}, c AS (SELECT rule_index, rule, threshold::DOUBLE AS threshold, sim >= threshold AND (rule_index = 0 OR (a + b) % 3 = 0) AND (rule_index < 2 OR (a + b) % 2 = 0) AS hit, same AS dup, (1 + a % 3)::DOUBLE AS w FROM n, {_GRID}),
m AS (SELECT rule_index, rule, threshold, sum(CASE WHEN hit AND dup THEN w ELSE 0 END) AS tp, sum(CASE WHEN hit AND NOT dup THEN w ELSE 0 END) AS fp, sum(CASE WHEN NOT hit AND dup THEN w ELSE 0 END) AS fn FROM c GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM m),
d AS (SELECT rule_index, rule, threshold, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM pr)"""


def _grid(s, d):
    n = F.col("a") + F.col("b")
    labelled = _pairs(s, d).select("sim", (n % 3 == 0).alias("same_answer"), (n % 2 == 0).alias("same_args"), (1 + F.col("a") % 3).cast("double").alias("weight"), F.col("same").alias("duplicate"))
    return similar.detector_grid(labelled, [0.2, 0.3, 0.4])


@query(_DETECT + " SELECT rule, threshold, precision, recall, f1 FROM d")
def similarity_detector_pr(s, d):
    return _grid(s, d).select("rule", "threshold", "precision", "recall", "f1")


@query(_DETECT + " SELECT rule, threshold, precision, recall, f1 FROM d ORDER BY f1 DESC, rule_index DESC, threshold DESC LIMIT 1")
def best_detector(s, d):
    return similar.best_detector(_grid(s, d))


@query(
    _UNIT.replace("WITH e", "WITH RECURSIVE e")
    + """, g AS (SELECT * FROM n WHERE sim >= 0.33), pe AS (SELECT a, b FROM g WHERE NOT ta AND NOT tb), u AS (SELECT a AS x, b AS y FROM pe UNION SELECT b, a FROM pe),
r AS (SELECT vec_id AS x, vec_id AS y FROM e WHERE NOT is_test UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x), comp AS (SELECT x AS id, min(y) AS component FROM r GROUP BY x),
bad AS (SELECT DISTINCT CASE WHEN ta THEN b ELSE a END AS id FROM g WHERE ta <> tb), st AS (SELECT comp.id, component, bad.id IS NOT NULL AS bad FROM comp LEFT JOIN bad USING (id))
SELECT id, component, CASE WHEN bad THEN 'contaminated' WHEN id = min(CASE WHEN NOT bad THEN id END) OVER (PARTITION BY component) THEN 'kept' ELSE 'duplicate' END AS status FROM st"""
)
def components_keep_one(s, d):
    edges = _pairs(s, d).filter("sim >= 0.33").select("a", "b")
    return similar.apply_edges(_vectors(s, d).select("id", "is_test"), edges).select("id", "component", "status")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def contamination_anti(s, d):
    """Documents that hold no benchmark text whole."""
    docs, items = table(s, d, "documents", heavy=True).select("doc_id", "text"), table(s, d, "benchmark").select(F.col("text").alias("item")).distinct()
    return docs.select("doc_id").join(similar.holding(docs, items), "doc_id", "left_anti")


@query()
def encoded_documents(s, d):
    def letters(texts):
        import numpy as np

        out = np.zeros((len(texts), 64))
        for i, t in enumerate(texts):
            codes, n = np.unique(np.frombuffer(t.encode(), np.uint8) % 64, return_counts=True)
            out[i, codes] = n
        return out

    return similar.embed(table(s, d, "documents", heavy=True).select(F.col("doc_id").alias("id"), "text"), letters).select("id", F.size("embedding").alias("dim"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def stale_vectors(s, d):
    return similar.stale(table(s, d, "documents").select(F.col("doc_id").alias("id")), _vectors(s, d))


# --- splits and samples

_SHUFFLE = "md5({0}::VARCHAR || '#11')"
_SPLIT = f"""WITH g AS (SELECT o_custkey || '/' || year(o_orderdate) AS g, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT g, n, coalesce(sum(n) OVER (ORDER BY {_SHUFFLE.format('g')}, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
v AS (SELECT coalesce(sum(n), 0) AS s FROM p WHERE before < 300), sp AS (SELECT g, n, CASE WHEN before < 300 THEN 'val' WHEN before - s < 1200 THEN 'pref' ELSE 'train' END AS split FROM p, v)"""


def _orders(s, d):
    return table(s, d, "orders").withColumn("g", split.group_key(F.col("o_custkey"), F.year("o_orderdate")))


@query(_SPLIT + " SELECT g, n, split FROM sp")
def group_split_fill(s, d):
    return split.greedy_split(_orders(s, d), "g", [("val", 300), ("pref", 1200)], "train", SEED)


@query("WITH o AS (SELECT DISTINCT o_orderpriority AS p, o_custkey AS c, year(o_orderdate) AS y FROM orders) SELECT a.p AS a, b.p AS b, count(*) AS n FROM o a JOIN o b ON a.c = b.c AND a.y = b.y AND a.p < b.p GROUP BY ALL")
def split_overlap(s, d):
    return split.split_overlap(table(s, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y")), "p", ["c", "y"])


@query(f"SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS population FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_SHUFFLE.format('event_id')}, event_id) <= 20")
def stratified_sample(s, d):
    return split.stratified(table(s, d, "events").select("event_type", "event_id"), "event_type", F.col("event_id"), 20, SEED).select("event_type", "event_id", "population")


@query(
    f"""WITH c AS (SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS p, count(*) OVER () AS t, row_number() OVER (PARTITION BY event_type ORDER BY {_SHUFFLE.format('event_id')}, event_id) AS place FROM events)
SELECT event_type, event_id FROM c WHERE place <= round_even(500.0 * p / t, 0) ORDER BY event_type, place LIMIT 500"""
)
def proportional_sample(s, d):
    return split.proportional(table(s, d, "events").select("event_type", "event_id"), "event_type", "event_id", 500, SEED).select("event_type", "event_id")


@query(f"WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY {_SHUFFLE.format('user_id')}, user_id) AS place, count(*) OVER () AS n FROM u) SELECT event_id, CASE WHEN place <= greatest(1, floor(n * 0.05)) THEN 'val' ELSE 'train' END AS side FROM events JOIN r USING (user_id)")
def source_split(s, d):
    return split.source_split(table(s, d, "events").select("event_id", "user_id"), "user_id", 0.05, SEED).select("event_id", "side")


@query()
def batch_seeds(s, d):
    t = table(s, d, "events").select("event_id", F.floor(F.col("event_id") / 32).alias("batch"))
    return t.groupBy("batch").agg(split.batch_seed(SEED, F.col("event_id")).alias("seed"))


# --- logs and reports

@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_pred_per_id(s, d):
    return evaluate.latest(table(s, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def resume_todo(s, d):
    done = table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return evaluate.todo(table(s, d, "customer").select("c_custkey"), done, "c_custkey")


def _place(q: float) -> str:
    return f"list_sort(list(value))[least(count(*) - 1, floor({q} * count(*)))::BIGINT + 1]"


@query(f"SELECT event_type, {_place(0.1)} AS p10, {_place(0.5)} AS p50, {_place(0.95)} AS p95 FROM events GROUP BY event_type")
def percentile_pct(s, d):
    return evaluate.ranked_values(table(s, d, "events"), "value", ["event_type"], {"p10": evaluate.pct_place(0.1), "p50": evaluate.pct_place(0.5), "p95": evaluate.pct_place(0.95)})


@query("SELECT source, list_sort(list(n_chars))[floor(count(*) / 2)::BIGINT + 1] AS median, max(n_chars) AS largest FROM documents GROUP BY source")
def upper_median(s, d):
    t = table(s, d, "documents").select("source", "n_chars")
    return evaluate.ranked_values(t, "n_chars", ["source"], {"median": F.floor(F.col("n") / 2)}).join(t.groupBy("source").agg(F.max("n_chars").alias("largest")), "source")


@query("SELECT b.range * 128 AS bin, count(d.n_chars) AS n FROM range(16) b LEFT JOIN documents d ON floor(d.n_chars / 128) = b.range GROUP BY 1")
def histogram_128(s, d):
    return evaluate.histogram(table(s, d, "documents"), "n_chars", 128, 16)


@query("SELECT event_type AS run, sum(user_id) / sum(value) AS tok_s, median(value) AS median_s FROM events WHERE event_id % 100 >= 3 GROUP BY 1".replace("sum(user_id) / sum(value)", "round(sum(user_id) / sum(value), 6)"))
def training_throughput(s, d):
    steps = table(s, d, "events").select(F.col("event_type").alias("run"), (F.col("event_id") % 100).alias("step"), F.col("user_id").alias("tokens"), F.col("value").alias("seconds"))
    return evaluate.throughput(steps, 3).select("run", F.round("tok_s", 6).alias("tok_s"), "median_s")


@query("WITH r AS (SELECT avg(value) FILTER (WHERE event_id % 2 = 0) AS ta, avg(value) FILTER (WHERE event_id % 2 <> 0) AS tb, max(value) FILTER (WHERE event_id % 2 = 0) AS ma, max(value) FILTER (WHERE event_id % 2 <> 0) AS mb FROM events) SELECT true AS comparable, round(tb / ta, 2) AS speed_up, round(100 * (1 - mb / ma), 1) AS memory_reduction FROM r")
def backend_comparison(s, d):
    steps = table(s, d, "events").groupBy(F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("run")).agg(F.avg("value").alias("tok_s"), F.max("value").alias("memory"))
    return evaluate.compare_runs(steps.withColumns({"gpu": F.lit("t4"), "dtype": F.lit("fp16")}), "a", "b")


_PLACE = "[least(len({0}) - 1, floor({1}::DOUBLE * len({0})))::BIGINT + 1]"


@query(
    "WITH l AS (SELECT count(*) AS n, median(value) AS m, list_sort(list(value) FILTER (WHERE event_id % 7 <> 0 AND value > 0)) AS g, list_sort(list(value * 3)) AS w FROM events) SELECT n, m AS ttft_p50, round(n / 10.0::DOUBLE, 1) AS per_minute, "
    + ", ".join(f"{c}{_PLACE.format(c, q)} AS {name}" for c, q, name in (("g", 0.1, "tok_s_p10"), ("g", 0.5, "tok_s_p50"), ("w", 0.5, "wall_p50"), ("w", 0.95, "wall_p95")))
    + " FROM l"
)
def serving_report(s, d):
    rows = table(s, d, "events").select(F.col("value").alias("ttft_ms"), (F.col("value") * 3).alias("wall_ms"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("gen_tok_s"))
    return evaluate.serving(rows, 10.0)


@query("SELECT 'documents' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'companies', count(DISTINCT source)::DOUBLE FROM documents UNION ALL SELECT 'over_length', count(*) FILTER (WHERE n_chars > 4000)::DOUBLE FROM documents UNION ALL SELECT 'labelled', count(*)::DOUBLE FROM labels UNION ALL SELECT 'good', count(*) FILTER (WHERE quality = 1)::DOUBLE FROM labels")
def dataset_report(s, d):
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    a = docs.agg(F.count("*").cast("double").alias("documents"), F.count_distinct("source").cast("double").alias("companies"), F.count_if(F.col("n_chars") > 4000).cast("double").alias("over_length"))
    b = labels.agg(F.count("*").cast("double").alias("labelled"), F.count_if(F.col("quality") == 1).cast("double").alias("good"))
    return a.unpivot([], a.columns, "metric", "value").unionByName(b.unpivot([], b.columns, "metric", "value"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(s, d):
    w = log.event_windows(table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def source_manifest(s, d):
    """Every file of the folder."""
    return files.manifest(s, d).select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


@query("SELECT (SELECT count(*) FROM conversations WHERE role = 'user') AS nested, (SELECT count(*) FROM documents) AS plain")
def record_counts(s, d):
    nested = files.count_records(table(s, d, "conversations").withColumn("questions", F.when(F.col("role") == "user", F.array("turn"))), "questions")
    plain = files.count_records(table(s, d, "documents"))
    sums = nested.select(F.col("records").alias("nested"), F.lit(0).cast("long").alias("plain")).unionByName(plain.select(F.lit(0).cast("long").alias("nested"), F.col("records").alias("plain")))
    return sums.agg(F.sum("nested").alias("nested"), F.sum("plain").alias("plain"))


@query(
    "SELECT 'program_records' AS name, 'json array' AS format, 2::INT AS n_licenses, 'https://example.org/program' AS homepage, 'r1' AS revision, count(DISTINCT o_orderkey) AS records FROM orders"
    " UNION ALL SELECT 'span_records', 'json array', 1, 'https://example.org/span', 'r2', count(*) FILTER (WHERE role = 'user') FROM conversations"
)
def source_registry(s, d):
    """The registry with the user's addresses and revisions, and how many records each source has."""
    told = {"program_records": ("https://example.org/program", "r1", "cite a"), "span_records": ("https://example.org/span", "r2", "cite b")}
    counts = table(s, d, "orders").agg(F.count_distinct("o_orderkey").alias("records")).withColumn("name", F.lit("program_records"))
    counts = counts.unionByName(table(s, d, "conversations").agg(F.count_if(F.col("role") == "user").alias("records")).withColumn("name", F.lit("span_records")))
    return files.registry(s, told).join(counts, "name").select("name", "format", F.size("licenses").alias("n_licenses"), "homepage", "revision", "records")


@query(
    "SELECT 'tile' AS section, 'documents' AS name, '' AS key, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'tile', 'labels', '', count(*)::DOUBLE FROM labels"
    " UNION ALL SELECT 'funnel', 'labels', step, n::DOUBLE FROM (SELECT 'in' AS step, count(*) AS n FROM labels UNION ALL SELECT 'dropped_low_quality', count(*) FILTER (WHERE quality = 0) FROM labels UNION ALL SELECT 'out', count(*) FILTER (WHERE coalesce(quality, 1) <> 0) FROM labels)"
    " UNION ALL SELECT 'series', source, '0.5', round(avg(n_chars), 3) FROM documents GROUP BY source"
    " UNION ALL SELECT 'split', split, k, v FROM (SELECT o_orderstatus AS split, count(*)::DOUBLE AS examples, max(floor(o_totalprice / 100))::DOUBLE AS largest FROM orders GROUP BY 1) UNPIVOT (v FOR k IN (examples, largest))"
)
def report_roll_up(s, d):
    docs, told = table(s, d, "documents"), table(s, d, "labels")
    tiles = {"documents": docs.agg(F.count("*").alias("n")), "labels": told.agg(F.count("*").alias("n"))}
    checked = curate.funnel(told, {"low_quality": F.coalesce(F.col("quality") == 0, F.lit(False))})
    series = docs.groupBy(F.col("source").alias("rule")).agg(F.round(F.avg("n_chars"), 3).alias("f1")).withColumn("threshold", F.lit(0.5))
    splits = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.count("*").alias("examples"), F.max(F.floor(F.col("o_totalprice") / 100)).alias("largest"))
    return evaluate.roll_up(tiles, {"labels": curate.funnel_report(checked, ["low_quality"])}, series, splits)


# --- chats, tables and tokens

_HEAD = "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)"


@query(
    f"""SELECT conv_id, md5(string_agg({_HEAD} || CASE WHEN role = 'system' THEN 'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 26 Jul 2024' || chr(10) || chr(10) ELSE '' END || trim(text) || '<|eot_id|>', '' ORDER BY turn)) AS chat_md5 FROM conversations GROUP BY conv_id"""
)
def chat_render(s, d):
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", F.md5(R.chat(F.col("m"))).alias("chat_md5"))


@query(
    """WITH n AS (SELECT r_name, list(n_name ORDER BY n_name) AS l, list(n_nationkey::VARCHAR ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT r_name, '| region/nation | ' || array_to_string(l, ' | ') || ' |' || chr(10) || '|' || repeat(' --- |', len(l) + 1) || chr(10) || '| key |' || repeat('  |', len(l)) || chr(10) || chr(10) || 'Question: which ' || r_name || '?' AS prompt FROM n"""
)
def table_prompt(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    grid = F.array(F.concat(F.array(F.lit("region|nation")), "l"), F.array(F.lit("key")))
    none = F.array().cast("array<string>")
    return n.select("r_name", R.prompt(none, grid, none, F.concat(F.lit("which "), "r_name", F.lit("?"))).alias("prompt"))


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity)::BIGINT || ', x' || CASE l_linenumber % 4 WHEN 0 THEN '%' WHEN 1 THEN ' thousand' WHEN 2 THEN ' million' ELSE '' END AS shown FROM lineitem")
def displayed_answers(s, d):
    k = F.col("l_linenumber") % 4
    scale = F.when(k == 0, "percent").when(k == 1, "thousand").when(k == 2, "million").otherwise("")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", R.display_answer(F.array(F.floor("l_quantity").cast("string"), F.lit("x")), scale).alias("shown"))


_IDS = "WITH a AS (SELECT l_orderkey, list(floor(l_quantity)::INT % 5 ORDER BY l_linenumber, floor(l_quantity)::INT % 5) AS ids FROM lineitem GROUP BY 1), b AS (SELECT *, ids[(len(ids) + 1) // 2] AS h FROM a)"


def _ids(s, d):
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.floor("l_quantity") % 5).cast("int").alias("q"))
    return lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))), lambda x: x["q"]).alias("ids"))


@query(_IDS + ", c AS (SELECT *, len(ids) - list_position(list_reverse(ids), h) + 1 AS cut FROM b) SELECT l_orderkey, array_to_string(list_concat(list_transform(range(cut), lambda x: -100), ids[cut + 1 :]), ',') AS labels FROM c")
def label_mask(s, d):
    header = F.array(F.get("ids", F.floor((F.size("ids") + 1) / 2).cast("int") - 1))
    return _ids(s, d).select("l_orderkey", F.array_join(K.response_labels(F.col("ids"), header), ",").alias("labels"))


@query(
    _IDS + """, o AS (SELECT l_orderkey AS ordinal, ids, l_orderkey // 8 AS batch FROM a), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM o)
SELECT batch, side, ordinal, array_to_string(list_concat(CASE side WHEN 0 THEN ids ELSE list_reverse(ids) END, list_transform(range(width - len(ids)), lambda x: 0)), ',') AS ids FROM w, (VALUES (0), (1)) t(side)"""
)
def collated_pairs(s, d):
    pairs = _ids(s, d).select(F.col("l_orderkey").alias("ordinal"), F.col("ids").alias("chosen_input_ids"), F.col("ids").alias("chosen_labels"), F.reverse("ids").alias("rejected_input_ids"), F.reverse("ids").alias("rejected_labels"))
    return K.collate_pairs(pairs, 8, 0).select("batch", "side", "ordinal", F.array_join("input_ids", ",").alias("ids"))


@query(
    "WITH p AS (SELECT -0.1 - l_discount AS c, -0.2 - l_tax AS r FROM lineitem), o AS (SELECT c, -ln(1 + exp(-((c - r) - (ln(-(exp(c) - 1)) - ln(-(exp(r) - 1)))))) AS ratio FROM p) SELECT round(-avg(c) - 0.1 * avg(ratio), 6) AS loss, round(-avg(c), 6) AS nll, round(avg(ratio), 6) AS ratio FROM o"
)
def preference_loss(s, d):
    loss, nll, ratio = K.orpo_loss(-0.1 - F.col("l_discount"), -0.2 - F.col("l_tax"), 0.1)
    return table(s, d, "lineitem").agg(F.round(loss, 6).alias("loss"), F.round(nll, 6).alias("nll"), F.round(ratio, 6).alias("ratio"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[vec_id % 64 + 1] - ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) AS mean, 1::INT AS count FROM e")
def response_logprobs(s, d):
    v = F.col("embedding").cast("array<double>")
    labels = F.array(F.lit(0), (F.col("vec_id") % 64).cast("int"), F.lit(K.IGNORE))
    p = K.mean_logprob(F.array(v, v, v), labels)
    return table(s, d, "embeddings").select("vec_id", F.round(p["mean"], 6).alias("mean"), p["count"].alias("count"))


# --- preference pairs

_SAMPLES = "SELECT l_orderkey AS id, l_linenumber - 1 AS pos, CASE WHEN l_linenumber % 3 = 0 THEN 'so ' ELSE ' Answer: ' END || floor(l_quantity)::BIGINT % 4 AS output, floor(l_quantity)::BIGINT % 4 = 1 AS correct FROM lineitem"


def _samples(s, d):
    q = F.floor("l_quantity") % 4
    one = F.struct("l_linenumber", F.concat(F.when(F.col("l_linenumber") % 3 == 0, "so ").otherwise(" Answer: "), q.cast("string")).alias("output"), (q == 1).alias("correct"), q.cast("string").alias("extracted"))
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    return lines.select("id", F.transform("x", lambda v: F.struct(v["output"].alias("output"), v["correct"].alias("correct"), v["extracted"].alias("extracted"))).alias("samples"))


@query(f"SELECT 'correct_' || c || '_of_' || k AS label, count(*) AS n FROM (SELECT id, count(*) FILTER (WHERE correct) AS c, count(*) AS k FROM ({_SAMPLES}) GROUP BY id) GROUP BY 1")
def sample_outcomes(s, d):
    return preference.outcomes(_samples(s, d))


_UNIQUE = f"u AS (SELECT id, min(pos) AS pos, trim(output) AS t, correct FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos, output, correct) - 1 AS pos, output, correct FROM ({_SAMPLES})) GROUP BY id, trim(output), correct)"


@query(f"WITH {_UNIQUE} SELECT id, pos::INT AS pos, t AS output, correct FROM u")
def distinct_outputs(s, d):
    return preference.distinct_outputs(_samples(s, d)).select("id", "pos", F.trim("output").alias("output"), "correct")


@query(
    f"""WITH {_UNIQUE}, wr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT contains(lower(t), 'answer:'), md5(id || '#' || pos || '#11'), pos) - 1 AS i FROM u WHERE NOT correct QUALIFY i < 2),
ri AS (SELECT id, list(t ORDER BY md5(id || '#' || pos || '#11'), pos) AS pool FROM u WHERE correct GROUP BY id)
SELECT wr.id || '#' || i AS id, t AS rejected, coalesce(pool[i % len(pool) + 1], 'reference') AS chosen, CASE WHEN pool IS NULL THEN 'reference' ELSE 'sampled' END AS chosen_source FROM wr LEFT JOIN ri ON wr.id = ri.id"""
)
def preference_pairs(s, d):
    samples = _samples(s, d)
    prompts = samples.select("id", F.lit("reference").alias("reference"), F.lit("1").alias("answer"))
    return preference.build_pairs(samples, prompts, 10**9, SEED).select("id", F.trim("rejected").alias("rejected"), F.trim("chosen").alias("chosen"), "chosen_source")


_CAPPED = (
    f"WITH {_UNIQUE}, wr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT contains(lower(t), 'answer:'), md5(id || '#' || pos || '#11'), pos) - 1 AS i FROM u WHERE NOT correct QUALIFY i < 2),"
    " room AS (SELECT greatest(0, (SELECT count(DISTINCT l_orderkey) FROM lineitem) - count(*) FILTER (WHERE i = 0)) AS n FROM wr),"
    " pr AS (SELECT id, i, t, id IN (SELECT id FROM u WHERE correct) AS sampled FROM wr QUALIFY i = 0 OR row_number() OVER (PARTITION BY i ORDER BY id) <= (SELECT n FROM room))"
)


def _capped(s, d):
    samples = _samples(s, d)
    prompts = samples.select("id", F.lit("reference").alias("reference"), F.lit("1").alias("answer"))
    return preference.build_pairs(samples, prompts, samples.count(), SEED)


@query(_CAPPED + " SELECT id || '#' || i AS id, t AS rejected FROM pr")
def preference_pairs_capped(s, d):
    """A target that second pairs fill only in part."""
    return _capped(s, d).select("id", F.trim("rejected").alias("rejected"))


@query(_CAPPED + " SELECT count(*) AS pairs, count(DISTINCT id) AS prompts_with_pairs, count(*) FILTER (WHERE i > 0) AS second_pairs_used, count(*) FILTER (WHERE sampled) AS chosen_sampled, count(*) FILTER (WHERE NOT sampled) AS chosen_reference, count(*) FILTER (WHERE contains(lower(t), 'answer:')) AS rejected_has_answer_line, (SELECT count(DISTINCT l_orderkey) FROM lineitem) - (SELECT count(DISTINCT id) FROM wr) AS no_pair_all_correct FROM pr")
def pair_report(s, d):
    pairs = _capped(s, d)
    report, none = preference.pair_report(pairs), preference.unpaired(_samples(s, d), pairs)
    return report.withColumn("k", F.lit(1)).join(none.withColumn("k", F.lit(1)), "k").drop("k")  # one row each


_CODES = "list_transform(string_split({0}, ''), lambda x: ord(x))"
_HEADER = "'<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"


def _letters(texts: list[str]) -> list[list[int]]:
    return [[ord(c) for c in t] for t in texts]


_MARK = [ord(c) for c in "<|start_header_id|>assistant<|end_header_id|>\n\n"]


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_HEADER} || 'first' || {_HEADER} AS h, 'Answer: ' || floor(l_quantity)::BIGINT AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, (length(h) + length(a))::INT AS n, array_to_string(list_concat(list_transform(range(length(h)), lambda x: -100), {_CODES.format('a')}), ',') AS labels FROM x"""
)
def tokenized_examples(s, d):
    head = "<|start_header_id|>assistant<|end_header_id|>\n\n"
    text = F.concat(F.lit(head + "first" + head), F.lit("Answer: "), F.floor("l_quantity").cast("string"))
    out = K.tokenize_examples(table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", text.alias("text")), "text", K.encoder(_letters), _MARK)
    return out.select("l_orderkey", "l_linenumber", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n"), F.array_join("labels", ",").alias("labels"))


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || 'why?<|eot_id|>' || {_HEADER} AS h, 'Answer: ' || floor(l_quantity)::BIGINT || '<|eot_id|>' AS c, 'no<|eot_id|>' AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, (length(h) + length(c))::INT AS n_chosen, array_to_string({_CODES.format('c')}, ',') AS chosen, (length(h) + length(r))::INT AS n_rejected FROM x"""
)
def tokenized_pairs(s, d):
    turn = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    pairs = table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", turn("user", F.lit("why?")).alias("prompt"), turn("assistant", F.concat(F.lit("Answer: "), F.floor("l_quantity").cast("string"))).alias("chosen"), turn("assistant", F.lit("no ")).alias("rejected"))
    out = K.tokenize_pairs(pairs, K.encoder(_letters), _MARK)
    own = F.filter("chosen_labels", lambda x: x != K.IGNORE)
    return out.select("l_orderkey", "l_linenumber", F.size("chosen_input_ids").alias("n_chosen"), F.array_join(own, ",").alias("chosen"), F.size("rejected_labels").alias("n_rejected"))


# --- label sheets, split reports, hooks

_DRAWN = (
    _UNIT
    + """, b AS (SELECT a, b, sim, CASE WHEN sim >= 0.4 THEN '0.40-1.00' WHEN sim >= 0.3 THEN '0.30-0.40' ELSE '0.20-0.30' END || CASE WHEN same THEN '|same' ELSE '|diff' END AS stratum, CASE WHEN sim >= 0.4 THEN 4 WHEN sim >= 0.3 THEN CASE WHEN same THEN 7 ELSE 3 END ELSE 5 END AS wanted, a || '-' || b AS k FROM n WHERE sim >= 0.2 AND sim < 1.0001),
dr AS (SELECT a, b, sim, stratum, population, least(population, wanted) AS sampled, k FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS population, row_number() OVER (PARTITION BY stratum ORDER BY md5(k || '#11'), k) AS place FROM b) WHERE place <= wanted),
nd AS (SELECT row_number() OVER (ORDER BY md5(k || '#12'), a, b) AS pair_id, * FROM dr)"""
)
_PLAN = [(0.2, 0.3, 5, 5), (0.3, 0.4, 7, 3), (0.4, 1.0001, 4, 4)]


def _drawn(s, d):
    return labels.draw(_pairs(s, d).withColumnRenamed("same", "same_answer"), SEED, _PLAN)


@query(_DRAWN + " SELECT pair_id, a, b, stratum, population, sampled, round(population / sampled, 6) AS weight FROM nd")
def label_draw(s, d):
    return _drawn(s, d).select("pair_id", "a", "b", "stratum", "population", "sampled", F.round("weight", 6).alias("weight"))


@query(_DRAWN + " SELECT pair_id, round(sim, 6) AS sim, (a % 4) = (b % 4) AS same_args, pair_id % 3 = 0 AS duplicate, round(population / sampled, 6) AS weight FROM nd WHERE a % 5 <> 0 AND b % 5 <> 0")
def labelled_pairs(s, d):
    drawn, v = _drawn(s, d), _vectors(s, d)
    told = drawn.select("pair_id", (F.col("pair_id") % 3 == 0).alias("duplicate"))
    records = v.filter("id % 5 <> 0").select("id", F.array((F.col("id") % 4).cast("double")).alias("args"))
    return labels.labelled(told, drawn, records, v).select("pair_id", F.round("sim", 6).alias("sim"), "same_args", "duplicate", F.round("weight", 6).alias("weight"))


def _examples(s, d):
    return table(s, d, "orders").select(
        F.col("o_orderstatus").alias("split"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("company"),
        F.year("o_orderdate").alias("year"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("seq_tokens"),
        F.when(F.col("o_orderkey") % 9 == 0, "yes").alias("word"),
        F.concat(F.lit("add(1, 2)"), F.expr("repeat(', add(#0, 1)', cast(o_orderkey % 4 as int))")).alias("program"),
    )


@query(
    """WITH e AS (SELECT o_orderstatus AS split, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS c, year(o_orderdate) AS y, floor(o_totalprice / 100)::BIGINT AS t, o_orderkey % 9 = 0 AS yes FROM orders)
SELECT split, count(*) AS examples, count(DISTINCT coalesce(c::VARCHAR, '-') || '/' || y) AS filings, count(DISTINCT coalesce(c::VARCHAR, '-')) AS companies, max(t) AS seq_tokens_max, count(*) FILTER (WHERE t > 2048) AS over_max_seq_len, count(*) FILTER (WHERE yes) AS yes_no, list_sort(list(t))[floor(count(*) / 2)::BIGINT + 1] AS seq_tokens_median FROM e GROUP BY split"""
)
def split_report(s, d):
    return evaluate.split_report(_examples(s, d), 2048)


@query("SELECT o_orderstatus AS split, (1 + o_orderkey % 4)::INT AS steps, count(*) AS n FROM orders GROUP BY ALL")
def step_histogram(s, d):
    return evaluate.step_histogram(_examples(s, d))


@query("SELECT floor(event_id / 1000)::BIGINT AS interval, round(avg(value), 6) AS value FROM events GROUP BY 1")
def interval_means(s, d):
    return evaluate.interval_means(table(s, d, "events").select("event_id", "value"), "event_id", 1000).select("interval", F.round("value", 6).alias("value"))


@query("WITH b AS (SELECT floor(doc_id / 16)::BIGINT AS batch, count(*) AS c, count(*) FILTER (WHERE quality = 1) AS r FROM labels GROUP BY 1) SELECT batch, (sum(c) OVER w)::BIGINT AS n, round((sum(r) OVER w) / (sum(c) OVER w), 4) AS accuracy FROM b WINDOW w AS (ORDER BY batch)")
def running_accuracy(s, d):
    rows = table(s, d, "labels").select(F.floor(F.col("doc_id") / 16).alias("batch"), (F.col("quality") == 1).alias("correct"))
    return evaluate.running_accuracy(rows, "batch")


@query(f"SELECT count(*) AS prompts, round(avg((c > 0 AND c < k)::INT), 4) AS mixed FROM (SELECT id, count(*) FILTER (WHERE correct) AS c, count(*) AS k FROM ({_SAMPLES}) GROUP BY id)")
def mixed_share(s, d):
    return evaluate.mixed_share(_samples(s, d))


@query("SELECT count(*) AS rows, sum(c)::BIGINT AS tokens, max(c)::INT AS longest FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey)")
def token_totals(s, d):
    return evaluate.token_totals(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("ids")), "ids")


@query("SELECT conv_id || '-' || turn AS id, 'Answer: ' || length(text) AS output FROM conversations WHERE role = 'user'")
def generated_outputs(s, d):
    asked = table(s, d, "conversations").filter("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("prompt"))
    return generate(asked, lambda prompts: [f"Answer: {len(p)}" for p in prompts])


# the further queries register themselves
from lumenspark import catalog_io  # noqa: E402, F401
