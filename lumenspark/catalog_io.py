"""Further queries of the catalogue: indexes, sweeps, vectors in files, streams, run logs, rules over tables, and their SQL."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark import catalog as C
from lumenspark.catalog import ORACLES, query, table
from lumenspark.functions import program as P
from lumenspark.functions import scoring as S
from lumenspark.functions import text as X
from lumenspark.operators import curate, evaluate, graph, labels, levels, matrix, nearest, preference, similar
from lumenspark.operators.generate import generate
from lumenspark.plans import scratch
from lumenspark.sources import files, npz
from lumenspark.streaming import log, state

# --- similarity


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 12) AS sim FROM e x JOIN e y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0)
SELECT a, b, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS INT) AS rank FROM s QUALIFY rank <= 5"""
)
def knn_indexed(s, d):
    """The five nearest rows of every row whose id 100 divides, from the index of all rows."""
    rows = C._vectors(s, d).select("id", "embedding")
    found = nearest.search(nearest.build(rows), rows.filter("id % 100 = 0"), 5)
    return found.select("a", "b", F.round("sim", 6).alias("sim"), "rank")


@query(ORACLES["knn_pairs_top5"].replace("list_dot_product", "list_cosine_similarity"))
def knn_pairs_indexed(s, d):
    """The top-k self-join through the index."""
    return similar.neighbour_pairs(C._vectors(s, d), indexed=True).select("a", "b", F.round("sim", 6).alias("sim"))


_SWEEP = f"""{C._UNIT}, c AS (SELECT round(sim, 6) AS threshold, same AS dup, (1 + a % 3)::DOUBLE AS w, (a + b) % 3 = 0 AS sa, (a + b) % 2 = 0 AS sg FROM n),
g AS (SELECT rule_index, rule, threshold, sum(CASE WHEN dup AND (rule_index = 0 OR sa) AND (rule_index < 2 OR sg) THEN w ELSE 0 END) AS tp, sum(CASE WHEN NOT dup AND (rule_index = 0 OR sa) AND (rule_index < 2 OR sg) THEN w ELSE 0 END) AS fp
  FROM c, (VALUES (0, 'similarity'), (1, 'similarity+same_answer'), (2, 'similarity+same_answer+same_args')) AS r(rule_index, rule) GROUP BY ALL),
t AS (SELECT rule_index, rule, threshold, sum(tp) OVER o AS tp, sum(fp) OVER o AS fp, (SELECT sum(w) FROM c WHERE dup) AS positives FROM g WINDOW o AS (PARTITION BY rule_index ORDER BY threshold DESC)),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN positives > 0 THEN tp / positives ELSE 0 END AS r FROM t),
sw AS (SELECT rule_index, rule, threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr)"""


def _sweep(s, d):
    n = F.col("a") + F.col("b")
    told = C._pairs(s, d).select(F.round("sim", 6).alias("sim"), (n % 3 == 0).alias("same_answer"), (n % 2 == 0).alias("same_args"), (1 + F.col("a") % 3).cast("double").alias("weight"), F.col("same").alias("duplicate"))
    return similar.threshold_sweep(told)


@query(_SWEEP + " SELECT rule, threshold, precision, recall, f1 FROM sw")
def threshold_sweep(s, d):
    """Precision and recall of each rule at every similarity that occurs."""
    return _sweep(s, d).select("rule", "threshold", "precision", "recall", "f1")


@query(_SWEEP + " SELECT rule, threshold, precision, recall, f1 FROM sw ORDER BY f1 DESC, rule_index DESC, threshold DESC LIMIT 1")
def best_threshold(s, d):
    return similar.best_detector(_sweep(s, d))


@query(
    C._UNIT.replace("WITH e", "WITH RECURSIVE e")
    + ", u AS (SELECT a AS x, b AS y FROM n WHERE sim >= 0.33 UNION SELECT b, a FROM n WHERE sim >= 0.33), r AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x) SELECT x AS node, least(x, min(y)) AS component FROM r GROUP BY x"
)
def components_in_batches(s, d):
    """Components after three batches of edges, each added to what is known of those before it."""
    edges = scratch.materialize(C._pairs(s, d).filter("sim >= 0.33").select("a", "b"), "edges")
    known = graph.connected_components(edges.filter("(a + b) % 3 = 0"))
    for k in (1, 2):
        known = scratch.materialize(graph.update_components(known, edges.filter(f"(a + b) % 3 = {k}")), "components")
    return known


# --- vectors in files


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, vec_id AS id, len(embedding)::INT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vectors_in_archives(s, d):
    """All vectors written to archives in the order of their ids, and read back in the order in which they stand there."""
    npz.register(s)
    path = scratch.new_path(s, "vectors")
    rows = C._vectors(s, d).select("id", "embedding")
    rows.repartitionByRange(8, "id").sortWithinPartitions("id").write.format("npz").mode("append").save(path)
    back = s.read.format("npz").load(path)
    if not npz.same_order(rows, back, ["id"]):
        raise ValueError("the archives hold other ids than the table, or in another order")
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    return npz.with_position(back, ["file", "row"], parts, "place").select("place", "id", F.size("embedding").alias("dim"), total.alias("total"))


@query("WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings), b AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS place FROM embeddings) SELECT place, a.vec_id AS record_id, b.vec_id AS vector_id FROM a JOIN b USING (place) WHERE a.vec_id <> b.vec_id")
def misplaced_vectors(s, d):
    """Where the vectors, in the order of labels, don't stand at the place of their record."""
    rows = C._vectors(s, d)
    return npz.misplaced(rows, rows, ["id"], ["label", "id"])


# --- streams


#: A pattern for the table's file or folder: a stream takes a single file by a pattern only.
_FILES = "events.parque[t]"


def _events(s, d) -> DataFrame:
    return table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query(ORACLES["latest_pred_per_id"])
def latest_by_stream(s, d):
    """The newest event of each user, from a stream over the table with a state per user."""
    schema, path = "event_id long, user_id long, event_type string, value double", scratch.new_path(s, "stream")
    state.keep_latest(s, f"{d}/{_FILES}", schema, f"{path}/sink", f"{path}/checkpoint", "user_id", "event_id", fmt="parquet")
    return evaluate.latest(state.read_committed(s, f"{path}/sink", schema), "user_id", "event_id")


_SESSIONS = """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
q AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, k)"""


def _shown(sessions: DataFrame) -> DataFrame:
    return sessions.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n", F.round("total", 4).alias("total"))


@query(_SESSIONS + " SELECT * FROM q")
def event_sessions(s, d):
    return _shown(state.sessions(_events(s, d)))


@query(_SESSIONS + """ SELECT * FROM q WHERE "end" <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def sessions_by_stream(s, d):
    """The sessions that are over when the stream has read the table: their end is behind the watermark."""
    path = scratch.new_path(s, "stream")
    stream = s.readStream.schema("ts timestamp_ntz, user_id long, value double").parquet(f"{d}/{_FILES}").withColumn("ts", F.col("ts").cast("timestamp"))
    query = state.once(state.sessions(stream), f"{path}/sink", f"{path}/checkpoint")
    query.awaitTermination()
    return _shown(state.read_committed(s, f"{path}/sink", "user_id long, start timestamp, end timestamp, n long, total double"))


@query("SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, ts) AS event_id FROM events GROUP BY ALL")
def first_events(s, d):
    return state.distinct_within(_events(s, d), ["user_id", "event_type"]).select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


# --- run logs


@query("SELECT event_type || '-' || event_id AS run_id, (props->>'$.k')::DOUBLE AS found FROM events WHERE (props->>'$.k')::DOUBLE >= 50 AND event_type = 'click'")
def runs_by_metric(s, d):
    """Runs of a phase whose nested metric reaches a bound, without a schema of the metrics."""
    e = table(s, d, "events")
    config = F.to_json(F.struct(F.struct("user_id").alias("data")))
    runs = e.select(F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("run_id"), F.col("event_type").alias("phase"), config.alias("config"), F.concat(F.lit('{"eval": '), "props", F.lit("}")).alias("metrics"))
    return files.runs_where(runs.filter("phase = 'click'"), "metrics", "$.eval.k", low=50).select("run_id", "found")


@query("SELECT event_type AS phase, count(*) AS runs, round(avg((props->>'$.k')::DOUBLE), 6) AS mean, 'OBJECT<data: OBJECT<user_id: BIGINT>>' AS config_schema FROM events GROUP BY 1")
def run_shapes(s, d):
    """What the configurations of each phase hold, and the mean of one metric."""
    e = table(s, d, "events")
    config = F.to_json(F.struct(F.struct("user_id").alias("data")))
    runs = files.typed_runs(e.select(F.col("event_type").alias("phase"), config.alias("config"), F.col("props").alias("metrics")))
    return runs.groupBy("phase").agg(F.count("*").alias("runs"), F.round(F.avg(F.try_variant_get("metrics", "$.k", "double")), 6).alias("mean"), F.schema_of_variant_agg("config").alias("config_schema"))


# --- rules over tables

#: Texts with a number, what the rules make of them, and which rules: each rule once at least, and one text beyond ASCII.
RULE_TEXTS = [
    ("he said 201chello {n}", 'he said "hello {n}', ["decode_curly_double_quote"]),
    ("so 2018 2018word {n}", 'so "word {n}', ["decode_double_open_quote"]),
    ("word 2019 2019 and {n}", 'word" and {n}', ["decode_double_close_quote"]),
    ("company 2019s plan {n}", "company's plan {n}", ["decode_possessive"]),
    ("say 2018word {n}", "say 'word {n}", ["decode_open_quote"]),
    ("word2019 and {n}", "word' and {n}", ["decode_close_quote"]),
    ("f0b7 item {n}", "- item {n}", ["decode_bullet"]),
    ("{n} % ( {n} % )", "{n}%", ["dup_percent"]),
    ("-{n} ( {n} )", "-{n}", ["dup_negative"]),
    ("{n} % ( % )", "{n}%", ["empty_percent_annotation", "percent_space"]),
    ("cost $ {n}", "cost ${n}", ["dollar_space"]),
    ("{n} % more", "{n}% more", ["percent_space"]),
    ("about {n} , more", "about {n}, more", ["space_before_punct"]),
    ("( {n} )", "({n})", ["paren_inner_space"]),
    ("end {n} ..", "end {n} .", ["double_terminal_punct"]),
    ("it 's {n}", "it's {n}", ["possessive_space"]),
    ("do n't {n}", "don't {n}", ["negation_space"]),
    ("a   {n}", "a {n}", ["multi_space"]),
    ("ﬁn {n} ％", "fin {n}%", ["percent_space"]),
]


def _ruled(s, d):
    k, n = F.col("o_orderkey") % len(RULE_TEXTS), F.col("o_orderkey").cast("string")
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in RULE_TEXTS]), (k + 1).cast("int"))
    return table(s, d, "orders", heavy=True).select("o_orderkey", F.replace(text, F.lit("{n}"), n).alias("text"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"SELECT o_orderkey, replace([{', '.join(_sql(t) for _, t, _ in RULE_TEXTS)}][o_orderkey % {len(RULE_TEXTS)} + 1], '{{n}}', o_orderkey::VARCHAR) AS cleaned FROM orders")
def cleaned_by_rule(s, d):
    return _ruled(s, d).select("o_orderkey", X.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT rule, count(*) AS n FROM orders JOIN (VALUES {', '.join(f'({i}, {_sql(r)})' for i, (_, _, rules) in enumerate(RULE_TEXTS) for r in rules)}) AS t(k, rule) ON k = o_orderkey % {len(RULE_TEXTS)} GROUP BY rule")
def rule_totals_all(s, d):
    return curate.rule_totals(_ruled(s, d), "text")


# --- records


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(s, d):
    """Ids that the soundness check of a record table names."""
    return curate.duplicate_ids(table(s, d, "orders").select("o_custkey"), "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def broken_pairs(s, d):
    """Pairs that the last check names: the chosen answer is scored wrong, or the rejected one right."""
    k = F.col("o_orderkey")
    # a wrong answer is off by more than the key itself: a fixed distance would be within the relative tolerance of large keys
    answer = lambda wrong: F.concat(F.lit("Answer: "), F.when(wrong, 2 * k + 1000).otherwise(k).cast("string"))
    pairs = table(s, d, "orders", heavy=True).select("o_orderkey", answer(k % 5 == 0).alias("chosen"), answer(k % 7 != 0).alias("rejected"), k.cast("double").alias("gold"))
    right = lambda c: S.is_correct(F.col(c), F.col("gold"), F.lit(None).cast("string"), F.lit("how much?"))["correct"]
    return preference.broken_pairs(pairs, right("chosen"), right("rejected")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey % 3 <> 0 ELSE l_orderkey % 4 <> 0 END AS correct FROM lineitem")
def scored_by_dataset(s, d):
    """Each record by the scorer of its dataset: spans for one, a number for the other."""
    k, q = F.col("l_orderkey"), F.floor("l_quantity")
    spans = F.col("l_linenumber") % 2 == 0
    output = F.when(spans, F.when(k % 3 == 0, "Answer: cash book").otherwise(F.concat(F.lit("Answer: cash flow and "), q.cast("string")))).otherwise(F.concat(F.lit("Answer: "), F.when(k % 4 == 0, q + 77).otherwise(q).cast("string")))
    items = F.when(spans, F.array(F.lit("cash flow"), q.cast("string")))
    scored = S.score(F.when(spans, "tatqa").otherwise("finqa"), output, F.when(~spans, q.cast("double")), F.lit(None).cast("string"), items, F.lit(""), F.lit("how much?"))
    return table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", scored["correct"].alias("correct"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 3 THEN round(exp(l_discount * ln(2.0::DOUBLE)) + floor(l_quantity), 8) END AS num, CASE WHEN l_linenumber % 4 = 3 THEN 'yes' END AS txt FROM lineitem WHERE l_linenumber % 4 <> 2")
def executed_programs(s, d):
    """The last result of whole programs: powers, sums and comparisons; programs that can't be executed give nothing."""
    k, q = F.col("l_linenumber") % 4, F.floor("l_quantity").cast("string")
    power = F.concat(F.lit("exp(2, "), F.col("l_discount").cast("decimal(18,2)").cast("string"), F.lit("), add(#0, "), q, F.lit(")"))
    text = F.when(k == 3, F.concat(F.lit("greater("), q, F.lit(", -1)"))).when(k == 2, "divide(1, 0)").otherwise(power)
    res = P.execute(F.col("program"), F.array().cast("array<array<string>>"))
    run = table(s, d, "lineitem", heavy=True).select("l_orderkey", "l_linenumber", text.alias("program"))
    # a filter on res would run all programs a second time, before they are dealt out
    run = run.select("l_orderkey", "l_linenumber", F.inline(F.array_compact(F.array(res))))
    return run.select("l_orderkey", "l_linenumber", F.round("num", 8).alias("num"), "txt")


# --- reports and matrices


@query(
    """WITH x AS (SELECT CASE WHEN GROUPING(source) = 0 THEN 0 WHEN GROUPING(lang) = 0 THEN 1 ELSE 2 END AS level, lang, source, count(*) AS n, sum(n_chars)::DOUBLE AS total FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ()))
SELECT *, true AS median_close, true AS distinct_close FROM x"""
)
def multi_level_report(s, d):
    """Sizes by source and language, by language and in all, from stored states; are the sketches as close as promised?"""
    rows, wanted = table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), [["lang", "source"], ["lang"], []]
    held = scratch.materialize(levels.states(rows, ["lang", "source"], "n_chars", "doc_id"), "states")
    told = levels.roll_up(held, wanted, {"median": 0.5})
    for k, level in enumerate(wanted):
        own = told.filter(F.col("level") == k).select("level", *[F.col(c).alias(f"own_{c}") for c in level], "median", "n", "total", "distinct")
        same = [rows[c].eqNullSafe(own[f"own_{c}"]) for c in level]  # a null is a group, too
        exact = rows.join(own, reduce(and_, same, F.lit(True))).groupBy("level", *level).agg(
            F.first("n").alias("n"),
            F.first("total").alias("total"),
            (F.count_if(F.col("n_chars") < F.col("median")) <= 0.53 * F.first("n") + 1).alias("low"),
            (F.count_if(F.col("n_chars") <= F.col("median")) >= 0.47 * F.first("n") - 1).alias("high"),
            (F.abs(F.count_distinct("doc_id") - F.first("distinct")) <= 0.05 * F.count_distinct("doc_id") + 1).alias("distinct_close"),
        )
        keys = [F.col(c) if c in level else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
        part = exact.select("level", *keys, "n", "total", (F.col("low") & F.col("high")).alias("median_close"), "distinct_close")
        out = part if not k else out.unionByName(part)
    return out


@query(
    """WITH w AS (SELECT vec_id AS r, unnest(range(1, 65)) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings), a AS (SELECT vec_id % 10 + 1 AS k, c, sum(v) AS v FROM (SELECT r AS vec_id, c, v FROM w) GROUP BY ALL),
p AS (SELECT w.r, a.c, sum(w.v * a.v) AS v FROM w JOIN a ON a.k = w.c WHERE w.c <= 10 GROUP BY ALL), m AS (SELECT w.r, w.c, w.v + 1.6 * p.v AS v FROM w JOIN p ON p.r = w.r AND p.c = w.c)
SELECT r AS "row", round(sum(v * c), 4) AS weighted, round(max(v), 5) AS largest FROM m GROUP BY r"""
)
def merged_update(s, d):
    """All vectors as a weight matrix, with a low-rank update merged in: W + (16 / 10) B A, B the first ten columns of W."""
    v = C._vectors(s, d).select(F.col("id").alias("row"), F.col("embedding").cast("array<double>").alias("values"))
    cells = v.select((F.col("row") % 10).alias("k"), F.posexplode("values").alias("c", "x")).groupBy("k", "c").agg(F.sum("x").alias("x"))
    a = cells.groupBy(F.col("k").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda z: z["x"]).alias("values"))  # 64 columns
    b = v.select("row", F.slice("values", 1, 10).alias("values"))
    out = matrix.to_rows(matrix.merge_update(*[matrix.to_blocks(x) for x in (v, b, a)], alpha=16, rank=10)).join(v.select("row"), "row", "left_semi")
    weighted = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return out.select("row", F.round(weighted, 4).alias("weighted"), F.round(F.array_max("values"), 5).alias("largest"))


# --- files out and in


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def lines_round_trip(s, d):
    """The table as JSON lines, read with its schema; the first thousand by their ordinal."""
    path = scratch.new_path(s, "lines")
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    files.write_lines(rows, path)
    return files.head(files.read_lines(s, path, rows.schema), "o_orderkey", 1000)


def _arrays(s, d, split: str, k: int, path: str) -> str:
    """Customers as files that each hold one JSON array of at most 500 raw records; a pattern of their names."""
    nothing = F.lit(None).cast("string")
    qa = F.struct(F.concat(F.lit("how much is "), "c_name", F.lit(" ?")).alias("question"), F.col("c_acctbal").cast("string").alias("answer"), F.lit("add(1, 2)").alias("program"), nothing.alias("program_re"), F.col("c_custkey").cast("string").alias("exe_ans"), F.create_map(F.lit("text_1"), F.col("c_mktsegment")).alias("gold_inds"))
    record = F.struct(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("CO/"), (2000 + F.col("c_nationkey")).cast("string"), F.lit("/page_1.pdf")).alias("filename"), F.array(F.lit("pre")).alias("pre_text"), F.array(F.lit("post")).alias("post_text"), F.array(F.array("c_mktsegment")).alias("table"), qa.alias("qa"))
    some = table(s, d, "customer").filter(F.col("c_custkey") % 2 == k).select(F.floor(F.col("c_custkey") / 1000).alias("bucket"), record.alias("r"))
    some.groupBy("bucket").agg(F.to_json(F.collect_list("r")).alias("text")).write.partitionBy("bucket").text(f"{path}/{split}")
    return f"{path}/{split}/*"


@query("SELECT 'r' || c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'train' ELSE 'dev' END AS split, 'CO' AS company, (2000 + c_nationkey)::INT AS year, 'how much is ' || c_name || ' ?' AS question, c_custkey::DOUBLE AS exe_num FROM customer")
def arrays_round_trip(s, d):
    """Raw records from JSON arrays of two splits, standardised and united."""
    path = scratch.new_path(s, "arrays")
    rows = files.read_arrays(s, {split: _arrays(s, d, split, k, path) for k, split in enumerate(("train", "dev"))}, files.PROGRAM_RECORD, curate.standardize_program_records)
    return rows.select("id", F.col("original_split").alias("split"), "company", "year", "question", "exe_num")


@query(ORACLES["labelled_pairs"])
def sheet_round_trip(s, d):
    """The label loop: drawn pairs, their sheet as a file, labels filled in, read, and joined with the pairs."""
    path = scratch.new_path(s, "sheets")
    drawn, v = scratch.materialize(C._drawn(s, d), "drawn"), C._vectors(s, d)
    text = lambda c: F.concat(F.lit(f'a "{c}", '), F.col("id").cast("string"))
    told = v.select("id", text("q").alias("question"), text("a").alias("answer_text"), F.array(F.struct(text("e").alias("value"))).alias("gold_evidence"), text("r").alias("report_id"))
    blank = labels.sheet(drawn, told)
    files.write_sheet(blank.withColumn(files.SHEET[1], (F.col("pair_id") % 3 == 0).cast("int").cast("string")), path)
    records = v.filter("id % 5 <> 0").select("id", F.array((F.col("id") % 4).cast("double")).alias("args"))
    out = labels.labelled(files.read_labels(s, path), drawn, records, v)
    return out.select("pair_id", F.round("sim", 6).alias("sim"), "same_args", "duplicate", F.round("weight", 6).alias("weight"))


@query("SELECT event_type AS phase, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def run_log_round_trip(s, d):
    """One run record per phase appended to the log, each with an id of its own, and read back."""
    path = scratch.new_path(s, "runs")
    sums = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    names = {files.log_run(s, r["event_type"], "{}", files.report_json(sums.filter(F.col("event_type") == r["event_type"])).first()["json"], path) for r in sums.select("event_type").collect()}
    runs = files.typed_runs(files.load_runs(s, path))
    if {r["run_id"] for r in runs.select("run_id").collect()} != names:
        raise ValueError("the log lacks a run")
    value = lambda c: F.try_variant_get("metrics", f"$.{c}", "double")
    return runs.select("phase", value("n").alias("n"), F.round(value("mean"), 6).alias("mean"))


@query("SELECT count(*) AS documents, max(n_chars) AS largest, 'é' AS mark FROM documents")
def report_round_trip(s, d):
    """A report of one row as pretty-printed JSON, read back."""
    path = scratch.new_path(s, "report")
    files.write_report(table(s, d, "documents").agg(F.count("*").alias("documents"), F.max("n_chars").alias("largest"), F.lit("é").alias("mark")), path)
    return s.read.schema("documents long, largest long, mark string").option("multiLine", True).json(path)


@query("SELECT sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_sha256 FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 200)")
def calibration_text(s, d):
    return files.calibration_text(table(s, d, "documents"), "text", "doc_id").select(F.sha2("text", 256).alias("text_sha256"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def appended_log(s, d):
    """The table through a log that goes on where it stopped: a second call adds nothing."""
    path, schema = scratch.new_path(s, "log"), "event_id long, event_type string, value double"
    for _ in range(2):
        log.append_log(s, f"{d}/{_FILES}", schema, f"{path}/sink", f"{path}/checkpoint", fmt="parquet")
    rows = log.resume(s, f"{path}/sink", "event_id", "event_id")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT o_orderstatus AS run, max(o_orderkey) AS step, arg_max(o_totalprice, o_orderkey) AS loss FROM orders GROUP BY 1")
def newest_checkpoints(s, d):
    """The newest checkpoint of each run, as a watcher finds it."""
    rows = table(s, d, "orders").select(F.col("o_orderstatus").alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"))
    found = [log.newest_checkpoint(rows.filter(F.col("run") == r)) for r in ("F", "O", "P")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS place, md5(text) AS output FROM documents")
def generated_longest_first(s, d):
    """Outputs of a model hook, whose batches get the longest prompts first: the place in which each prompt was served."""
    import hashlib

    prompts = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    out = generate(prompts, lambda texts: [f"{len(t):012d} {hashlib.md5(t.encode()).hexdigest()}" for t in texts])
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    served = out.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    placed = npz.with_position(scratch.materialize(served, "served"), ["part", "row"], parts, "place")
    return placed.select("id", "place", F.substr("output", F.lit(14)).alias("output"))


@query("SELECT o_orderkey, floor(o_orderkey / 16)::BIGINT AS batch FROM orders")
def batches_of_rows(s, d):
    return evaluate.chunks(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 16)


@query(
    r"""WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s%.-]', ' ', 'g'), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]'), lambda x: CASE WHEN x IN ('a', 'an', 'the') THEN ' ' ELSE x END) AS w FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(replace(array_to_string(w, ''), ',', ''), '\s+', ' ', 'g')) AS text FROM t"""
)
def comparable_texts(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.comparable(F.col("text")).alias("text"))


@query("SELECT o_orderkey, 'question: ' || o_orderpriority || chr(10) || 'evidence: ' || o_orderstatus || ' ' || o_orderdate::DATE AS text FROM orders")
def dedup_texts(s, d):
    evidence = F.array(*[F.struct(F.lit("k").alias("key"), F.col(c).cast(kind).cast("string").alias("value")) for c, kind in (("o_orderstatus", "string"), ("o_orderdate", "date"))])
    return table(s, d, "orders").select("o_orderkey", X.dedup_text(F.col("o_orderpriority"), evidence).alias("text"))


# --- SQL of queries that are registered elsewhere

_CALC = "CASE WHEN number % 19 = 0 THEN 'Calculation:\\n1. 99999 + 1 = 100000\\n2. 100000 - 100000 = 0' ELSE 'Calculation:\\n1. sum of the ''quantity'' row (' || array_to_string(q, ', ') || ') = ' || t || '\\n2. ' || t || ' + 0 = ' || t END"
ORACLES["final_examples"] = f"""WITH r AS (SELECT l_orderkey AS number, list(floor(l_quantity)::BIGINT::VARCHAR ORDER BY l_linenumber, floor(l_quantity)::BIGINT::VARCHAR) AS q, sum(floor(l_quantity))::BIGINT AS t FROM lineitem GROUP BY 1),
x AS (SELECT *, CASE WHEN number % 7 = 0 THEN t + 5 WHEN number % 19 = 0 THEN 0 ELSE t END AS result FROM r)
SELECT 'r' || number AS id, 'train' AS split, result::VARCHAR AS answer, sha256('[{{"role":"system","content":"Answer from the report."}},{{"role":"user","content":"order of goods,\\n\\n| item | ' || array_to_string(range(1, len(q) + 1), ' | ') || ' |\\n|' || repeat(' --- |', len(q) + 1) || '\\n| quantity | $' || array_to_string(q, ' | $') || ' |\\n\\nend.\\n\\nQuestion: ' || CASE WHEN number % 17 = 0 THEN '' ELSE 'what is the total of quantity?' END
 || '"}},{{"role":"assistant","content":"' || {_CALC} || '\\n\\nAnswer: ' || result || '"}}]') AS messages_sha256 FROM x"""
ORACLES["quality_report"] = "WITH r AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) SELECT 'in' AS step, n FROM r UNION ALL SELECT 'dropped_truncated_question', 0 UNION ALL SELECT 'dropped_question_year_mismatch', 0 UNION ALL SELECT 'out', n FROM r"
#: CRC-32 of each id by a table made from its generator.
ORACLES["batch_seeds"] = """WITH g AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) x(i))),
h AS (SELECT event_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(event_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM events, g)
SELECT floor(event_id / 32)::BIGINT AS batch, (11 + sum(crc) % 2147483648)::BIGINT AS seed FROM h GROUP BY 1"""
ORACLES["encoded_documents"] = "SELECT doc_id AS id, 64::INT AS dim FROM documents"
