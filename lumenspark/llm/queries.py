"""The queries of this package, over the whole tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm import op1_quality, op2_arrow_ids, op3_line_dedup, op4_token_counts, op5_pii, op6_decontaminate, op7_bpe, op8_licenses, op9_embeddings, op10_simhash, op11_divergence, op12_language, op13_merkle


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


QUERIES = {
    "op1_quality": lambda s, d: op1_quality.classify(_docs(s, d), _table(s, d, "labels")),
    "op2_arrow_ids": lambda s, d: op2_arrow_ids.round_trip(s, _docs(s, d), tokenizer("byte_bpe_50k.json")),
    "op3_line_dedup": lambda s, d: op3_line_dedup.report(_docs(s, d)),
    "op4_token_counts": lambda s, d: op4_token_counts.count_tokens(_docs(s, d), tokenizer("piece_bpe_32k.model"), whole=True),
    "op5_pii": lambda s, d: op5_pii.report(_docs(s, d)),
    "op6_decontaminate": lambda s, d: op6_decontaminate.report(_docs(s, d), _table(s, d, "benchmark")),
    "op7_bpe": lambda s, d: op7_bpe.digest(_docs(s, d), tokenizer("word_bpe_49k.json")),
    "op8_licenses": lambda s, d: op8_licenses.report(_docs(s, d)),
    "op9_embeddings": lambda s, d: op9_embeddings.near_duplicates(_table(s, d, "embeddings")),
    "op10_simhash": lambda s, d: op10_simhash.components(_docs(s, d)),
    "op11_divergence": lambda s, d: op11_divergence.divergence(_docs(s, d)),
    "op12_language": lambda s, d: op12_language.report(_docs(s, d)),
    "op13_merkle": lambda s, d: op13_merkle.audit(_docs(s, d)),
}

#: One row, t: the table of CRC-32 by its generator, and the CRC-32 of a doc_id's decimal text by that table.
_CRC_TABLE = """(
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) x(i))
)"""
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql(levels: int = 6) -> str:
    """Six levels, enough for 16 million rows a source and as many sources; a level that a tree hasn't joins with nothing."""

    def field(column: str) -> str:
        return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars')))} || {field(text)})"

    def grow(name: str) -> str:
        return ", ".join(
            f"{name}{k} AS (SELECT tree, i // 16 AS i, (size + 15) // 16 AS size, list(digest ORDER BY i) AS run, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM {name}{k - 1} WHERE size > 1 GROUP BY ALL)"
            for k in range(1, levels + 1)
        )

    def climb(name: str, place: str, f: str) -> str:
        steps = []
        for k in range(1, levels + 1):
            at = f"(f.{place} // {16 ** (k - 1)} % 16)"
            left, right = f"coalesce(array_to_string(run[1:{at}], ''), '')", f"coalesce(array_to_string(run[{at} + 2:], ''), '')"
            tree = "f.tree" if name == "n" else "0"
            steps.append(
                f"{f}{k} AS (SELECT f.* REPLACE (proof || CASE WHEN r.i IS NULL THEN '' ELSE {left} || {right} END AS proof, CASE WHEN r.i IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded) "
                f"FROM {f}{k - 1} f LEFT JOIN {name}{k} r ON r.tree = {tree} AND r.i = f.{place} // {16**k})"
            )
        return ", ".join(steps)

    roots = " UNION ALL ".join(f"SELECT tree, digest FROM n{k} WHERE size = 1" for k in range(levels + 1))
    top = " UNION ALL ".join(f"SELECT digest FROM u{k} WHERE size = 1" for k in range(levels + 1))
    return f"""
WITH leaves AS (
  SELECT doc_id, source, {leaf('text')} AS digest, CASE WHEN {_CRC} % 5 = 0 THEN {leaf(_LOWER.format('text'))} END AS changed FROM documents, {_CRC_TABLE}
), n0 AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY source) AS size FROM leaves
), {grow('n')}, u0 AS (
  SELECT 0 AS tree, tree AS own, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS size, digest FROM ({roots})
), {grow('u')},
f0 AS (SELECT doc_id, n0.digest AS leaf, n0.tree, n0.i, u0.i AS j, u0.digest AS subroot, '' AS proof, coalesce(changed, n0.digest) AS folded FROM n0 JOIN u0 ON u0.own = n0.tree),
{climb('n', 'i', 'f')}, g0 AS (SELECT * FROM f{levels}), {climb('u', 'j', 'g')}, top AS ({top})
SELECT doc_id, leaf, subroot, top.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = top.digest AS verified FROM g{levels}, top
"""

ORACLES = {
    "op13_merkle": _merkle_sql(),
    "op12_language": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text, CASE WHEN doc_id IS NULL THEN true ELSE {_CRC} % 5 = 0 END AS held_out FROM documents, {_CRC_TABLE}
), words AS (
  SELECT r, w, ' ' || w || ' ' AS p FROM (SELECT r, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS w FROM d)
), grams AS (
  SELECT r, w[k] AS gram FROM (SELECT r, w, unnest(range(1, length(w) + 1)) AS k FROM words)
  UNION ALL SELECT r, p[k : k + 1] FROM (SELECT r, p, unnest(range(1, length(p))) AS k FROM words)
  UNION ALL SELECT r, p[k : k + 2] FROM (SELECT r, p, unnest(range(1, length(p) - 1)) AS k FROM words)
), counts AS (SELECT r, gram, count(*) AS n FROM grams GROUP BY ALL
), profiles AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) AS rank
  FROM counts JOIN d USING (r) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, gram QUALIFY rank <= 1000
), own AS (
  SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) AS rank FROM counts QUALIFY rank <= 1000
), near AS (
  SELECT r, langs.lang, 1 - sum(coalesce(abs(own.rank - profiles.rank), 1000)) / (count(*) * 1000) AS near
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM profiles) langs LEFT JOIN profiles ON profiles.lang = langs.lang AND profiles.gram = own.gram GROUP BY ALL
), best AS (
  SELECT r, first(lang ORDER BY near DESC, lang) AS lang, max(near) AS near, sum(near) AS total FROM near GROUP BY r
)
SELECT doc_id, held_out, CASE WHEN regexp_matches(text, '\\p{{L}}') THEN coalesce(best.lang, 'und') ELSE 'und' END AS lang_pred,
       CASE WHEN regexp_matches(text, '\\p{{L}}') AND total > 0 THEN round(near / total, 6) ELSE 0.0 END AS score
FROM d LEFT JOIN best USING (r)
""",
    "op11_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 10
), groups AS (SELECT DISTINCT lang, source FROM d
), cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, total, sum(coalesce(n, 0)) OVER g + 2 * count(*) OVER g AS whole, sum(total) OVER g + 2 * count(*) OVER g AS lang_whole
  FROM groups JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term) WINDOW g AS (PARTITION BY lang, source)
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)::HUGEINT) // whole::HUGEINT AS p, 1 + (1000000000 * (total + 2)::HUGEINT) // lang_whole::HUGEINT AS q FROM cells
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM ranked
QUALIFY part = 'pair' OR rank <= 10
""",
    "op6_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, w[p : p + least(13, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), places AS (
  SELECT doc_id, n, p, w[p : p + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, places.n, p, item_id FROM places JOIN win ON places.n = win.n AND places.g = win.g),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.x = vec_id LEFT JOIN n ON n.x = vec_id
""",
}
