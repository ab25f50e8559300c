"""Each operator against a brute-force version, on odd rows and on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenspark.llm import op1_quality, op2_arrow_ids, op3_line_dedup, op4_token_counts, op5_pii, op6_decontaminate, op7_bpe, op8_licenses, op9_embeddings, op10_simhash
from lumenspark.llm.queries import QUERIES, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, score double, spans string, words int"
ODD = [
    None, "", " ", "\n", "\n\n a \n", "One", "One two", "one two three", "a.b@c.d a@b.co.uk x@y @z. a@@b.c", "1.2.3.4.5 999.1.1.1 0001.2.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (784) 555-8120 + 1 +12345678 5", "Straße Σίσυφος İstanbul ﬁn café\u0085x\x1cy <|endoftext|> don't",
    "MIT License. the GNU Lesser General Public License mit license", "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND foo",
    "word " * 3000, "x" * 20000, "9" * 5000 + " " + "1." * 2000, "漢字かな交じり文 " * 5, "tab\tand  two spaces ", "😀 smile".encode("utf-16", "surrogatepass").decode("utf-16"),
]


def odd_docs(spark, texts=None):
    texts = ODD if texts is None else texts
    rows = [(i if i != 5 else None, t, None, "s", None, 1, 2, 0.5, "x", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:12], SCHEMA).repartition(3)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def check(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# --- 1


def test_quality_held_out_accuracy(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r["doc_id"]], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and all(g["held_out"] for g, _ in held)
    assert np.mean([g["predicted"] == q for g, q in held]) >= 0.95
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.3) for g in got.values())


def test_quality_edges(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in op1_quality.classify(docs, none).collect()} == {1.0}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert op1_quality.classify(docs, labels).count() == docs.count()
    kept = op1_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert op1_quality.classify(docs.limit(0), labels).count() == 0


def test_quality_coordinate_descent():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 20)) if k else np.unique(rng.integers(40, 90, 20)) for k in (0, 1) * 40]
    m = op1_quality.fit(rows, [0, 1] * 40)
    assert np.mean([(m.score(m.margin(r)) >= 0.5) == bool(k) for r, k in zip(rows, [0, 1] * 40)]) > 0.95


# --- 2


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("odd", [True, False])
def test_arrow_round_trip(spark, sf, odd):
    docs = odd_docs(spark) if odd else docs_of(spark, sf)
    t, start, want = library("byte_bpe_50k.json"), 0, []
    for i, x in sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    check(op2_arrow_ids.round_trip(spark, docs, tokenizer("byte_bpe_50k.json"), length=128).collect(), want)


def test_arrow_random_access(spark, sf, tmp_path):
    docs, folder = docs_of(spark, sf), f"file://{tmp_path}/tokens"
    shards = op2_arrow_ids.write(docs, folder, tokenizer("byte_bpe_50k.json"), 64, 1).collect()
    t = library("byte_bpe_50k.json")
    ids = [y for _, x in sorted(texts(docs)) for y in [*t.encode(x, add_special_tokens=False).ids, 0]]
    assert shards[0]["tokens"] == len(ids)
    assert len(ids) // 64 > 200  # several batches
    for i in (0, 63, 64, 70, 128, 191, len(ids) // 64 - 1, (len(ids) - 1) // 64):
        got, mask = op2_arrow_ids.sequence(folder, 0, i)
        own = ids[i * 64 : i * 64 + 64]
        assert got.to_pylist() == own + [0] * (64 - len(own)) and mask.to_pylist() == [True] * len(own) + [False] * (64 - len(own))
    for i in ((len(ids) - 1) // 64 + 1, 10**6, -1):
        with pytest.raises(IndexError):
            op2_arrow_ids.sequence(folder, 0, i)


def test_arrow_shards_by_size(spark, sf, monkeypatch):
    """Large tables get more shards than shuffle partitions; the ids are the same."""
    docs = docs_of(spark, sf)
    want = sorted(map(tuple, op2_arrow_ids.round_trip(spark, docs, tokenizer("byte_bpe_50k.json")).collect()))
    assert op2_arrow_ids.shard_count(docs) == 4
    monkeypatch.setattr(op2_arrow_ids, "SHARD_BYTES", 20_000)
    assert op2_arrow_ids.shard_count(docs) > 8
    assert sorted(map(tuple, op2_arrow_ids.round_trip(spark, docs, tokenizer("byte_bpe_50k.json")).collect())) == want


def test_arrow_empty(spark):
    assert op2_arrow_ids.round_trip(spark, odd_docs(spark).limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


# --- 3


def brute_lines(rows, min_words):
    """rows in order; all shortest runs of min_words words by their lines. A line in a later copy goes, but for lines in a first one."""
    cut = [[x.strip() for x in t.split("\n")] for t in rows]
    places, later, kept = defaultdict(list), [set() for _ in cut], [set() for _ in cut]
    for d, c in enumerate(cut):
        words = [max(1, len(x.split())) for x in c]
        found = set()
        for i in range(len(c)):
            found |= {next(((i, j) for j in range(i + 1, len(c) + 1) if sum(words[i:j]) >= min_words), None), next(((j, i + 1) for j in range(i, -1, -1) if sum(words[j : i + 1]) >= min_words), None)}
        for i, j in sorted(found - {None}):
            places[tuple(c[i:j])].append((d, i, j))
    for at in places.values():
        for k, (d, i, j) in enumerate(sorted(at) if len(at) > 1 else []):
            (later if k else kept)[d].update(range(i, j))
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in later[d] - kept[d]) for d, t in enumerate(rows)]


def test_first_copies_stay(spark):
    """Equal lines shrink to one run; a passage whose copies overlap another's stands whole once."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(10)) for x in "abcde")
    rows = ["x y\n" * 39 + "x y", "\n".join([c, d, e]), "\n".join([a, b, c, d, e]), "\n".join([a, b, c])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = [r["text"] for r in op3_line_dedup.dedup(docs).orderBy("doc_id").collect()]
    assert got == ["x y\n" * 9 + "x y", rows[1], rows[3], ""] and got == brute_lines(rows, 20)


def test_every_passage_stays(spark):
    """Over small alphabets, with overlaps of all kinds: each shortest run that stood in several places stands in one still."""
    rng = np.random.default_rng(8)
    rows = ["\n".join(rng.choice(["a", "b b", "c c c"], rng.integers(0, 25))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for m in (2, 4, 7):
        left = [r["text"] for r in op3_line_dedup.dedup(docs, m).orderBy("doc_id").collect()]
        assert left == brute_lines(rows, m) and sum(map(len, left)) < 0.8 * sum(map(len, rows))

        seen = Counter()
        for t in rows:
            c = t.split("\n")
            for i in range(len(c)):
                n = next((j for j in range(i + 1, len(c) + 1) if sum(max(1, len(x.split())) for x in c[i:j]) >= m), None)
                seen.update(["\n".join(c[i:n])] if n else [])
        assert all(any(f"\n{x}\n" in f"\n{t}\n" for t in left) for x, n in seen.items() if n > 1)


def test_maximal_runs_name_their_kept_copies(spark):
    """Each run repeats what stands at its kept copy, before it, and together they cover what dedup() deletes."""
    rng = np.random.default_rng(12)
    rows = ["\n".join(rng.choice(["a", "b b", "c c c", "d"], rng.integers(0, 30))) for _ in range(30)]
    cut = [t.split("\n") for t in rows]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    m = 5
    got = [tuple(r) for r in op3_line_dedup.repeated_runs(docs, m).collect()]
    later = [set() for _ in cut]
    for d, line, n, k_doc, k_line in got:
        assert cut[d][line : line + n] == cut[k_doc][k_line : k_line + n] and (k_doc, k_line) < (d, line)
        assert sum(max(1, len(x.split())) for x in cut[d][line : line + n]) >= m
        later[d].update(range(line, line + n))
    assert len(got) == len(set(got)) and len(got) > 50
    for c, own, t in zip(cut, later, brute_lines(rows, m)):  # what goes is part of a run
        left = t.split("\n")
        assert len(left) >= len(c) - len(own)
    page = "\n".join(f"line {i} of a passage of many words" for i in range(12))
    docs = spark.createDataFrame([(1, f"x\n{page}\ny"), (2, f"{page}\nz"), (3, "u\n" + page.split("\n", 3)[3])], "doc_id long, text string")
    assert sorted(map(tuple, op3_line_dedup.repeated_runs(docs).collect())) == [(2, 0, 12, 1, 1), (3, 1, 9, 1, 4)]


def test_lines_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"w{k}" for k in rng.integers(0, 9, n)) for n in rng.integers(0, 8, 12)]
    rows = ["\n".join(pool[k] for k in rng.integers(0, 12, rng.integers(0, 14))) for _ in range(60)] + ["a\n" * 40, "a\n" * 9, "", "a b c d e f g"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5)
    for m in (1, 5, 12):
        got = [r["text"] for r in op3_line_dedup.dedup(docs, m).orderBy("doc_id").collect()]
        assert got == brute_lines(rows, m)


def test_lines_small_table(spark, sf):
    docs = docs_of(spark, sf)
    rows = sorted(texts(docs))
    want = brute_lines([t for _, t in rows], op3_line_dedup.MIN_WORDS)
    got = {r["doc_id"]: r["text_sha256"] for r in op3_line_dedup.report(docs).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for (i, _), t in zip(rows, want)}


def test_lines_edges(spark):
    docs = odd_docs(spark)
    out = op3_line_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["text"] for r in out.collect()} <= {*ODD, ""}
    assert op3_line_dedup.dedup(docs.limit(0)).count() == 0
    assert sum(r["n_deleted"] for r in op3_line_dedup.report(docs).collect()) >= 0


# --- 4


def greedy(word, begin, rest):
    n, at = 0, 0
    while at < len(word):
        pieces = rest if at else begin
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


def test_token_counts(spark, sf):
    pieces = op4_token_counts.vocabulary(tokenizer("piece_bpe_32k.model"))
    begin, rest = {p[1:] for p in pieces if p[0] == "▁" and len(p) > 1}, {p for p in pieces if p[0] != "▁"}
    for docs in (odd_docs(spark), docs_of(spark, sf)):
        want = []
        for i, x in texts(docs):
            n = [greedy(w, begin, rest) if len(w) < 5000 else None for w in (x or "").split()]
            if None not in n:
                want.append((i, len(n), sum(max(1, k) for k in n), n.count(0)))
        long = [i for i, x in texts(docs) if any(len(w) >= 5000 for w in (x or "").split())]
        got = op4_token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")).collect()
        check([r for r in got if r["doc_id"] not in long], want)
        assert len(got) == docs.count()


def test_longest_match_small_alphabet():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pieces = {"".join(rng.choice(list("ab"), rng.integers(1, 5))) for _ in range(6)}
        first = {"".join(rng.choice(list("ab"), rng.integers(1, 5))) for _ in range(4)}
        m = op4_token_counts.LongestMatch(["▁" + p for p in first] + sorted(pieces))
        for _ in range(60):
            w = "".join(rng.choice(list("abc"), rng.integers(1, 10), p=[0.49, 0.49, 0.02]))
            assert m.word(w) == greedy(w, first, pieces), (w, first, pieces)


def greedy_whole(word, begin, rest):
    """The bare BEGIN piece where no piece begins the word, bytes for characters that no piece continues with."""
    n, at = 1, next((k for k in range(min(len(word), 20), 0, -1) if word[:k] in begin), 0)
    while at < len(word):
        size = next((k for k in range(min(len(word) - at, 20), 0, -1) if word[at : at + k] in rest), 0)
        n += 1 if size else len(word[at].encode("utf-8", "replace"))
        at += size or 1
    return n


def test_token_counts_whole_vocabulary(spark, sf):
    path = tokenizer("piece_bpe_32k.model")
    pieces = op4_token_counts.vocabulary(path)
    begin, rest = {p[1:] for p in pieces if p[0] == "▁" and len(p) > 1}, {p for p in pieces if p[0] != "▁"}
    assert max(map(len, pieces)) <= 20 and "▁" in pieces
    m = op4_token_counts.matcher(path, whole=True)
    assert [m.word(w) for w in ("2024", "漢字", "x2", "𓀀")] == [5, 5, 2, 5]  # as sentencepiece splits them
    rows = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    docs = texts(docs_of(spark, sf))
    for i, x in docs:
        n = [greedy_whole(w, begin, rest) for w in (x or "").split()]
        assert rows[i] == (len(n), sum(n), 0)
    assert len(rows) == len(docs)


def test_longest_match_bare_and_bytes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pieces = {"".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(6)}
        first = {"".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(4)}
        m = op4_token_counts.LongestMatch(["▁", *("▁" + p for p in first), *sorted(pieces)], bare=True, with_bytes=True)
        for _ in range(60):
            w = "".join(rng.choice(list("abé漢"), rng.integers(1, 10), p=[0.4, 0.3, 0.2, 0.1]))
            assert m.word(w) == greedy_whole(w, first, pieces), (w, first, pieces)


# --- 5

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            odd = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(odd) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_random():
    rng = np.random.default_rng(5)
    parts = ["a", "b.c", "@", "1", "23", "255", "256", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "é", "d-e.f", "%"]
    for _ in range(6000):
        t = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert op5_pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("odd", [True, False])
def test_pii_query(spark, sf, odd):
    docs = odd_docs(spark) if odd else docs_of(spark, "/root/testdata/sf0.01")
    want = []
    for i, x in texts(docs):
        s = plain_spans(x or "")
        joined = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in s)
        want.append((i, *[sum(k == n for _, k, _ in s) for n in range(4)], hashlib.sha256(joined.encode()).hexdigest(), joined))
    got = op5_pii.report(docs).collect()
    base = lambda v: ",".join(x for x in v.split(",") if not x.startswith("term"))
    check([(*r[:6], base(r["spans"])) for r in got], want)
    assert op5_pii.report(docs.limit(0)).count() == 0


def test_pii_terms(spark):
    """`zebulon` stands only near one address, in different surroundings; `common` is everywhere."""
    rows = [f"common {'abcdef'[i] * 5} words zebulon {'xyz'[i % 3]} me@my.org common {'ghijkl'[i] * 5}" for i in range(6)] + [f"common words of text number {i}" for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in op5_pii.report(docs).collect()}
    for i in range(6):
        terms = [rows[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].split(",")) if k == "term"]
        assert terms == ["zebulon"]
        assert op5_pii.sanitise(rows[i], got[i]) == rows[i].replace("zebulon", "").replace("me@my.org", "[email]")
    assert not any(got[i] for i in range(6, 206))


def pii_terms(spark, rows):
    """The term spans of each text, and common texts around them."""
    rows = rows + [f"common regards words of text number {i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in op5_pii.report(docs).collect()}
    return [[rows[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].split(",") if x) if k == "term"] for i in range(len(rows))]


def test_pii_rare_values_and_signatures(spark):
    """A name in the same signature line of all documents, and one beside a value that stands in one document."""
    got = pii_terms(spark, ["regards quentin me@my.org common words"] * 4 + ["regards ottoline you@my.org common words"])
    assert got[:5] == [["quentin"]] * 4 + [["ottoline"]] and not any(got[5:])


def test_pii_terms_of_whole_documents(spark):
    """Names of any length and with digits, far from the value and repeated: marked wherever they stand in its documents."""
    far = "common words of text " * 100
    got = pii_terms(spark, [f"Quentin Ng kx42 {far} me@my.org {far} quentin"] * 5 + [f"common {far} you@my.org"])
    assert got[:5] == [["Quentin", "Ng", "kx42", "quentin"]] * 5 and not any(got[5:])


# --- 6


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(k)
    sizes, out = {len(x) for x in windows}, []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if x := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= x
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(900, None), (901, ""), (902, "one"), (903, "Two three"), (10, "two, THREE"), (905, "word " * 15)], "item_id long, text string")
    both = items.union(more)
    for docs in (odd_docs(spark), docs_of(spark, sf)):
        want = brute_hits(texts(docs), [tuple(r) for r in both.collect()])
        check(op6_decontaminate.report(docs, both).collect(), want)
        check(op6_decontaminate.report(docs, both, max_bytes=2000).collect(), want)  # by blocks
        for most in (64_000_000, 2000):
            kept = op6_decontaminate.clean_documents(docs, both, most)
            assert kept.columns == docs.columns
            check([(r[0],) for r in kept.select("doc_id").collect()], [(w[0],) for w in want if not w[5]])
    assert op6_decontaminate.report(docs, both.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert op6_decontaminate.report(docs.limit(0), both).count() == 0


# --- 7


def test_bpe_against_library(spark, sf):
    t = library("word_bpe_49k.json")
    for docs in (odd_docs(spark), docs_of(spark, sf)):
        want = []
        for i, x in texts(docs):
            ids = t.encode(x or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        check(op7_bpe.digest(docs, tokenizer("word_bpe_49k.json")).collect(), want)
    assert op7_bpe.digest(docs.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_bpe_byte_level():
    t, m = library("byte_bpe_50k.json"), op7_bpe.Bpe(tokenizer("byte_bpe_50k.json"))
    for x in ODD:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert m.chunk(x or "") == ids and m.decode(ids) == t.decode(ids, skip_special_tokens=False)


# --- 8


def test_licenses(spark, sf):
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for docs in (odd_docs(spark), docs_of(spark, "/root/testdata/sf0.01")):
        want = []
        for i, x in texts(docs):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
            at = [(p, label) for p in range(len(w)) for phrase, label in base.items() if w[p : p + len(phrase.split())] == phrase.split()]
            where = [p for p, _ in at]
            want.append((i, len(w), len(at), min(where, default=None), max(where, default=None), ",".join(sorted({k for _, k in at}))))
        got = op8_licenses.report(docs).collect()
        check([tuple(r)[:6] for r in got], want)
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert op8_licenses.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT", (["mit"], 1.0)),
        ("MIT OR GPL-3.0-only", (["mit", "gpl-3.0-only"], 1.0)),
        ("MIT AND GPL-3.0-only", (["mit", "gpl-3.0-only"], 0.3)),
        ("MIT OR GPL-2.0 AND LGPL-2.1", (["mit", "gpl-2.0", "lgpl-2.1"], 1.0)),
        ("(MIT OR GPL-2.0) AND LGPL-2.1", (["mit", "gpl-2.0", "lgpl-2.1"], 0.6)),
        ("GPL-2.0 WITH Classpath-exception-2.0", (["gpl-2.0 with classpath-exception-2.0"], 0.6)),
        ("(Apache-2.0 and", (["apache-2.0"], 1.0)),
        (") MIT", None),
        ("", None),
    ],
)
def test_expressions(text, want):
    assert op8_licenses.evaluate(text) == want


def test_long_expressions():
    """A part behind the first 500 characters counts, and the identifier there stays whole."""
    ids = [f"mit-variant-{i}" for i in range(60)] + ["proprietary-1.0"]
    got = op8_licenses.scan("SPDX-License-Identifier: " + " AND ".join(ids) + "\nMIT License")
    assert set(got[5].split(",")) == {"mit", *(f"spdx:{x}" for x in ids)} and got[6] == 0.1
    many = " OR (".join(f"GPL-{i} WITH e-{i}" for i in range(20_000)) + ")" * 19_999
    assert op8_licenses.evaluate(many) == ([f"gpl-{i} with e-{i}" for i in range(20_000)], 0.6)


# --- 9


def brute_vectors(rows):
    n = len(rows)
    fine = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]
    unit = [np.array(r[2], float) / np.linalg.norm(np.array(r[2], float)) if f else None for r, f in zip(rows, fine)]
    near = [[j for j in range(n) if i != j and fine[i] and fine[j] and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(n)]
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((25, 16))
    rows = [(i, int(k % 3), [float(np.float32(x)) for x in centres[k] + 0.22 * rng.standard_normal(16)]) for i, k in enumerate(rng.integers(0, 25, 300))]
    rows += [(300, 1, rows[5][2]), (301, rows[5][1], rows[5][2]), (302, rows[5][1], rows[5][2]), (302, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2])]
    rows += [(310, 1, None), (311, 1, []), (312, 1, [0.0] * 16), (313, 1, [None] + [1.0] * 15), (314, 1, [float("nan")] * 16), (315, None, rows[0][2]), (316, 1, [1.0, 2.0]), (317, 1, [2.0, 4.0]), (318, 1, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("cid", F.lit(1))
    got = op9_embeddings.near_duplicates(df).collect()
    check(got, brute_vectors(rows))
    assert op9_embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall_with_small_windows(spark):
    """Windows far smaller than a label: every link found is right, and at least 0.9 of them are found."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((600, 64))
    rows = [(i, 1, [float(x) for x in centres[i % 600] + 0.2 * rng.standard_normal(64)]) for i in range(1800)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in op9_embeddings.near_duplicates(df, window=100).collect()}
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(1800)) and sum(got.values()) >= 0.9 * want.sum() > 500


@pytest.mark.parametrize("noise", [1e-4, 0.2])
def test_embeddings_dense_group(spark, noise):
    """One group of near copies in a label that is larger than many windows, against brute force: every link is found."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(64)
    x = np.concatenate([centre + noise * rng.standard_normal((3000, 64)), rng.standard_normal((500, 64)), -centre + 0.27 * rng.standard_normal((500, 64))])
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r for r in op9_embeddings.near_duplicates(df, window=100).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    want = near.sum(axis=1) - 1
    assert want[:3000].min() > 2000 and [got[i]["n_links"] for i in range(4000)] == want.tolist()
    least = np.arange(4000)
    while (new := np.where(near, least[None, :], 4000).min(axis=1)).tolist() != least.tolist():
        least = new
    assert [got[i]["component_id"] for i in range(4000)] == least.tolist()


@pytest.mark.parametrize("noise", [1e-6, 0.2])
def test_embeddings_many_windows(spark, noise):
    """A label of many windows in several passes, with a dense group longer than a window: no link is counted twice or
    wrongly, at least 0.9 of all links are found, and all of a group so narrow that blocks settle its links.
    """
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((500, 32))
    x = np.concatenate([centres[rng.integers(0, 500, 2500)] + 0.25 * rng.standard_normal((2500, 32)), rng.standard_normal(32) + noise * rng.standard_normal((1500, 32))])
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r for r in op9_embeddings.near_duplicates(df, window=64, span=128).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    n = np.array([got[i]["n_links"] for i in range(4000)])
    assert (n <= want).all() and n[:2500].sum() >= 0.9 * want[:2500].sum() > 2000 and n[2500:].sum() >= 0.95 * want[2500:].sum()
    if noise < 0.1:
        assert (n[2500:] == want[2500:]).all() and len({got[i]["component_id"] for i in range(2500, 4000)}) == 1


# --- 10


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    n, label = len(prints), list(range(len(prints)))
    for _ in range(n):
        before = list(label)
        for i in range(n):
            for j in range(n):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def test_gray_index_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 8, 9, 64, 65, 700):
        base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        codes = np.unique(np.array([b ^ (np.uint64(1) << np.uint64(x)) ^ (np.uint64(1) << np.uint64(y)) for b, x, y in zip(rng.choice(base, n), rng.integers(0, 12, n), rng.integers(0, 64, n))]))
        index = op10_simhash.GrayIndex(codes)
        got = {(int(a), int(b)) for x, y in index.pairs(chunk=50) for a, b in zip(x, y)}
        c = index.codes
        assert got == {(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if int(c[i] ^ c[j]).bit_count() <= 2}


@pytest.mark.parametrize("split", [100_000, 3])
def test_simhash_links(spark, split):
    rng = np.random.default_rng(9)
    codes = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 12)]
    codes = sorted({c ^ (1 << int(a)) ^ (1 << int(b)) for c in codes for a, b in rng.integers(0, 62, (12, 2))})
    got = {r["fp"]: r["first"] for r in op10_simhash.class_components(spark.createDataFrame([(c, c) for c in codes], "fp long, doc_id long"), F.min("doc_id"), split).collect()}
    label = brute_components([c & (1 << 64) - 1 for c in codes])
    assert got == {c: min(d for d, m in zip(codes, label) if m == k) for c, k in zip(codes, label)}


def test_simhash_query(spark, sf):
    docs = docs_of(spark, sf)
    rows = sorted(texts(docs))
    prints = [plain_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    check(op10_simhash.components(docs).collect(), [(i, f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, label)])


def test_simhash_edges(spark):
    docs = odd_docs(spark)
    got = op10_simhash.components(docs).collect()
    prints = {i: plain_fingerprint(t) for i, t in texts(docs)}
    assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] for r in got) and len(got) == docs.count()
    kept = op10_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["component_id"] for r in got})
    assert op10_simhash.keep_one(docs.limit(0)).count() == 0
