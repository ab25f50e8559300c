"""Source divergence, language profiles and the Merkle manifest against plain Python, on odd rows and on the small tables."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_operators import ODD, check, docs_of, odd_docs

from lumenspark.llm import op11_divergence, op12_language, op13_merkle
from lumenspark.llm.queries import ORACLES, QUERIES

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def rows_of(docs):
    return [tuple(r) for r in docs.select(*op13_merkle.FIELDS).collect()]


def many(spark, n=400, seed=0):
    """Sources of different sizes, one without a name, one with a single row; repeated doc_ids and rows; three langs and none."""
    rng = np.random.default_rng(seed)
    words = ["Aa", "bb", "ÉÉ", "x1y", "漢字", "zz-zz", "I'm", "1 2", "Qq"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 9)) if rng.random() > 0.3 else 0
        text = " ".join(rng.choice(words[: 12 + k], rng.integers(0, 30)))
        rows.append((int(i - (i % 50 == 3)), None if k == 8 else f"s{k}" if k != 7 else "é", ["a", "b", None][int(rng.integers(0, 3))], len(text), None if i % 41 == 0 else text))
    rows += rows[:3] + [(None, "s1", "a", None, "No id"), (n + 5, "solo", "solo lang", 3, "abc"), (n + 6, "", "", 0, "")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return frame.selectExpr("*", "1 as place", "'x' as term", "2 as n", "3 as size", "4 as docs", "text as digest").repartition(5)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_language", "op13_merkle"])
def test_same_as_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(ORACLES[name])
    order = [df.columns.index(c[0]) for c in want.description]
    check([tuple(r[i] for i in order) for r in df.collect()], want.fetchall())


# --- 11


def brute_divergence(rows, least, top):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, source, lang, _, text in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        counts[g].update(terms)
        seen[g[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def p(c, kept=kept):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        own = {s: p(counts[lang, s]) for s in sources}
        q = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            for part, items in (
                ("pair", [(sum(f(own[s][t], own[x][t]) for t in kept), x) for x in sources if x != s]),
                ("term", [(f(own[s][t], q[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]),
            ):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(ordered) if part == "pair" or i < top]
    return out


def test_divergence_brute_force(spark):
    for docs in (many(spark), odd_docs(spark), many(spark, 60, 3)):
        rows = rows_of(docs)
        for least, top, block in ((10, 10, 2048), (1, 3, 2048), (2, 10, 3)):
            check(op11_divergence.divergence(docs, least, top, block).collect(), brute_divergence(rows, least, top))


def test_divergence_edges(spark):
    assert op11_divergence.divergence(many(spark).limit(0)).count() == 0
    big = np.array([9 * 10**15 - 2, 0, 12345], np.int64)
    whole = np.array([9 * 10**15, 9 * 10**15, 12347], np.int64)
    assert op11_divergence.shares(big, whole).tolist() == [1 + 10**9 * (int(c) + 2) // int(w) for c, w in zip(big, whole)]
    frame = spark.createDataFrame([(int(c), int(w)) for c, w in zip(big, whole)], "c long, w long")
    assert [r[0] for r in frame.select(op11_divergence.share(frame["c"], frame["w"])).collect()] == op11_divergence.shares(big, whole).tolist()


# --- 12


def brute_grams(text):
    word = lambda c: unicodedata.category(c)[0] in "LM"
    plain = "".join((c.lower() if len(c.lower()) == 1 else c) if word(c) else " " for c in text)
    out = Counter()
    for w in plain.split(" "):
        if w:
            p = f" {w} "
            out.update(w)
            out.update(p[i : i + 2] for i in range(len(p) - 1))
            out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def brute_languages(rows, size):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    totals = defaultdict(Counter)
    for i, _, lang, _, text in rows:
        if lang is not None and text is not None and not held(i):
            totals[lang].update(brute_grams(text))
    first = lambda c: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])}
    learned = {lang: first(c) for lang, c in totals.items() if c}
    out = []
    for i, _, _, _, text in rows:
        if not learned or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append((i, held(i), "und", 0.0))
            continue
        own = first(brute_grams(text))
        near = {x: 1 - sum(abs(r - p[g]) if g in p else size for g, r in own.items()) / (len(own) * size) for x, p in learned.items()}
        best = min(near, key=lambda x: (-near[x], x.encode()))
        total = sum(near[x] for x in sorted(near))
        out.append((i, held(i), best, round(near[best] / total, 6) if total > 0 else 0.0))
    return out


def test_languages_brute_force(spark):
    for docs in (many(spark), odd_docs(spark).selectExpr("* except(lang)", "source as lang")):
        rows = rows_of(docs)
        for size in (5, 1000):
            check(op12_language.report(docs, size).collect(), brute_languages(rows, size))


def test_language_grams_in_pieces():
    rng = np.random.default_rng(1)
    letters = ["a", "B", "é", "漢", " ", " ", "\n", "ा", "İ", "😀", "σ", "Σ", "-"]
    texts = ["".join(rng.choice(letters, n)) for n in (0, 1, 2, 3, 50, 200, 7, 5000, 1, 30)] + ["abc" * 700, ""]
    for size in (4, 7, 64, 1 << 20):
        owner, gram, n = op12_language.count_grams(texts, size)
        got = defaultdict(Counter)
        for o, g, k in zip(owner.tolist(), gram.tolist(), n.tolist()):
            got[o][op12_language.gram_text(g)] += k
        assert {o: dict(c) for o, c in got.items()} == {i: dict(c) for i, t in enumerate(texts) if (c := brute_grams(t))}, size
        assert len(set(zip(owner.tolist(), gram.tolist()))) == len(owner)


def test_language_grams_of_many_scripts():
    """So many letters and texts that text and gram together exceed 64 bits."""
    texts = ["".join(map(chr, range(0x4E00 + 40 * i, 0x4E00 + 40 * i + 40))) for i in range(500)] + ["".join(map(chr, range(0x20000, 0x2A6D0)))] + ["a"] * 4000
    owner, gram, n = op12_language.count_grams(texts, 1 << 20)
    for i in (0, 250, 499, 500, 501, 4500):
        own = {op12_language.gram_text(g): k for g, k in zip(gram[owner == i].tolist(), n[owner == i].tolist())}
        assert own == dict(brute_grams(texts[i]))


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = op12_language.report(docs).collect()
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    none = docs.selectExpr("* except(lang)", "cast(null as string) as lang")
    assert {tuple(r)[2:] for r in op12_language.report(none).collect()} == {("und", 0.0)}
    assert op12_language.report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than 3"):
        op12_language.learn(docs, 50, 3)


# --- 13


def digest(*x):
    return hashlib.sha256("".join(x).encode("utf-8", "surrogatepass")).hexdigest()


def brute_tree(nodes):
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, whose = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i : i + 16]
            for k in range(len(run)):
                for o in owners[i + k]:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(digest(*run))
            whose.append([o for x in owners[i : i + 16] for o in x])
        nodes, owners = up, whose
    return nodes[0], paths


def brute_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: digest(*map(field, (r[0], r[1], r[2], r[3], text)))
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees.append(brute_tree([x[2] for x in by[s]]))
    root, tops = brute_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(names, trees, tops):
        for (_, _, own, r), path in zip(by[s], paths):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, r[4].translate(UPPER)) if hit else own
            for a, b in path + top:
                node = digest(a, node, b)
            out.append((r[0], own, subroot, root, digest(*[a + b for a, b in path + top]), node, node == root))
    return out


def test_merkle_brute_force(spark, sf):
    solo = docs_of(spark, sf).filter("source = 'src1'")
    assert solo.count() > 0
    for docs in (many(spark), odd_docs(spark), solo, many(spark).filter("source = 'solo'"), many(spark, 900, 2).filter("source = 's0' or source is null")):
        check(op13_merkle.audit(docs).collect(), brute_manifest(rows_of(docs)))


def test_merkle_store(spark, tmp_path):
    """Levels as partitions of the store; a changed row changes the root; an empty table has none."""
    docs, store = many(spark), f"file://{tmp_path}/nodes"
    m = op13_merkle.build(op13_merkle.leaves(docs), store)
    sizes = Counter(r[1] for r in rows_of(docs))
    want = [len(rows_of(docs))]
    nodes = list(sizes.values())
    while max(nodes) > 1:
        nodes = [-(-n // 16) for n in nodes if n > 1]
        want.append(sum(nodes))
    levels = spark.read.option("recursiveFileLookup", False).option("pathGlobFilter", "*.parquet")
    assert [levels.parquet(f"{store}/level={k}").count() for k in range(len(want))] == want
    other = op13_merkle.build(op13_merkle.leaves(docs.withColumn("n_chars", docs["n_chars"] + (docs["doc_id"] == 77).cast("int"))))
    assert m.root != other.root and len(m.root) == 64
    empty = op13_merkle.audit(docs.limit(0))
    assert empty.count() == 0 and len(empty.columns) == 7 and op13_merkle.build(op13_merkle.leaves(docs.limit(0))).root is None
