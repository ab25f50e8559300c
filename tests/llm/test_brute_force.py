"""Further brute-force versions: disclosure, licence expressions, deletion counts, blocks of a benchmark, recent values."""

import gc
import math
import re
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, brute_hits, brute_lines, check, docs_of, library, odd_docs, plain_spans, texts

from lumenspark.llm import op2_arrow_ids, op3_line_dedup, op5_pii, op6_decontaminate, op8_licenses
from lumenspark.llm.batches import Recent, distinct_pieces, gather
from lumenspark.llm.queries import tokenizer

# --- recent values


def test_recent_is_bounded():
    recent, made = Recent(200_000), []
    rng = np.random.default_rng(0)
    for _ in range(60):
        keys = list({f"k{i}" * int(1 + i % 30) for i in rng.integers(0, 3000, 400)})
        got = recent.find(keys, lambda some: made.append(len(some)) or [k.encode() for k in some])
        assert got == [k.encode() for k in keys]
        entries = {**recent.old, **recent.young}
        assert sum(2 * len(k) for k in entries) < 400_000 and all(len(k) <= Recent.LONG for k in entries)
    assert 0 < sum(made) < 60 * 400 and recent.find([], lambda some: 1 / 0) == []


def test_pieces_and_gather():
    import pyarrow.compute as pc

    words, places, ends = distinct_pieces(pc.split_pattern(pa.array(["a b a", "", "é a"]), " "))
    assert [words[i] for i in places] == ["a", "b", "a", "", "é", "a"] and ends.tolist() == [3, 4, 6]
    data, upto = gather([b"xy", b"", b"z"], np.array([0, 1, 2, 0]))
    assert bytes(data) == b"xyzxy" and upto.tolist() == [2, 2, 3, 5]


def test_arrow_encoder_on_odd_cuts():
    """Texts whose spaces, breaks and special tokens stand where the encoder must not cut."""
    more = [" lead", "trail ", "a\n\nb c\nd", "a\nb\nc d's it's we'll", "x<|endoftext|>y z", "a\r\nb c\r\n", "a\x00b c\x00 d", "\x00", "　a  b", "a  ", "\nx y", "x\n y", "x \ny"]
    rng = np.random.default_rng(1)
    parts = ["a", "B c", " ", "\n", "'s", "1.2", "é", "漢", "\t", "!?", "<|", "|>", "endoftext", " "]
    rows = [*ODD, *more, *["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)]]
    e, t = op2_arrow_ids.encoder(tokenizer("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in rows]
    for _ in range(2):  # the second time from recent pieces
        ids, sizes = e.encode(pa.array(rows, pa.string()))
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


# --- line dedup


def test_line_counts(spark):
    rng = np.random.default_rng(11)
    pool = [" ".join(f"w{k}" for k in rng.integers(0, 9, n)) for n in rng.integers(0, 8, 12)]
    rows = ["\n".join(pool[k] for k in rng.integers(0, 12, rng.integers(0, 14))) for _ in range(60)] + ["a\n" * 40, "x"]
    # the last row has no id, so it comes last; the one before it is a copy of the first
    ids = [*range(len(rows)), len(rows), None]
    rows += [rows[0], rows[3]]
    docs = spark.createDataFrame(list(zip(ids, rows)), "doc_id long, text string").repartition(4)
    kept = brute_lines(rows, 5)
    want = []
    for i, t, k in zip(ids, rows, kept):
        left = k.count("\n") + 1 if k or t == "" else 0
        want.append((i, t.count("\n") + 1, t.count("\n") + 1 - left if k != t else 0))
    got = {(r["doc_id"]): (r["n_lines"], r["n_deleted"]) for r in op3_line_dedup.report(docs, 5).collect()}
    for (i, n, gone), t, k in zip(want, rows, kept):
        assert got[i][0] == n
        if k:  # what is left of a text without content can't tell an empty line from none
            assert got[i][1] == gone
    assert sum(g for _, g in got.values()) > 100


# --- PII


def brute_terms(rows):
    """All spans of each text by counting documents with plain sets."""
    term = lambda t: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]{2,}", t)]
    base = [plain_spans(t) for t in rows]
    outside = [[x for x in term(t) if not any(a < x[2] and x[1] < b for a, _, b in s)] for t, s in zip(rows, base)]
    values = [{(k, t[a:b].lower()) for a, k, b in s} for t, s in zip(rows, base)]
    n, everywhere = len(rows), [{x[0] for x in term(t)} for t in rows]
    out = []
    for t, s, o, v in zip(rows, base, outside, values):
        gone = set()
        for e in v:
            holders = [i for i in range(n) if e in values[i]]
            p = len(holders) / n
            for w in {x[0] for x in o}:
                both = sum(any(x[0] == w for x in outside[i]) for i in holders)
                given = (both + p) / (sum(w in x for x in everywhere) + 1)
                if p < 1 and 1 + math.log2(given) / -math.log2(p) >= op5_pii.THRESHOLD:
                    gone.add(w)
        spans = [(a, k, b) for a, k, b in s] + [(x[1], 9, x[2]) for x in o if x[0] in gone]
        out.append(",".join(f"{'term' if k == 9 else op5_pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)))
    return out


def private_rows():
    rng = np.random.default_rng(3)
    names = ["anna", "bert", "carla", "dora7", "émile"]
    rows = []
    for _ in range(400):
        who = int(rng.integers(0, 5))
        words = list(rng.choice(["the", "of", "report", "team", "plan", "with"], 6))
        if rng.random() < 0.3:
            words += [f"{'abcde'[who]}@mail.org", names[who] if rng.random() < 0.9 else "team"]
        if rng.random() < 0.1:
            words += ["+1 784 555 8120", "hotline"]
        rows.append(" ".join(rng.permutation(words)))
    return rows


def test_pii_disclosure_brute_force(spark):
    rows = private_rows()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in op5_pii.report(docs).collect()}
    want = brute_terms(rows)
    assert got == dict(enumerate(want)) and sum("term" in w for w in want) > 30


def test_pii_secrets_and_sanitised(spark):
    rows = ['token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" rest', "API_KEY: AbCdEf0123456789xyz", "tokens of a text", "password = short", "mail me@my.org now", None, ""]
    docs = spark.createDataFrame([(i, t, "r", 5, "s") for i, t in enumerate(rows)], "doc_id long, text string, row string, spans int, lang string")
    got = {r["doc_id"]: r for r in op5_pii.report(docs).collect()}
    assert [got[i]["n_secret"] for i in range(7)] == [1, 1, 0, 0, 0, 0, 0] and [got[i]["n_found"] for i in range(7)] == [1, 1, 0, 0, 1, 0, 0]
    assert got[0]["spans"] == "term:9:49" and rows[0][9:49].startswith("b44e") and got[1]["spans"] == "term:9:28"
    clean = op5_pii.sanitised(docs)
    assert clean.columns == docs.columns
    out = {r["doc_id"]: r for r in clean.collect()}
    assert out[0]["text"] == 'token = "" rest' and "[email]" in out[4]["text"] and out[2]["text"] == rows[2] and out[5]["text"] is None and out[6]["text"] == ""
    assert all((r["row"], r["spans"], r["lang"]) == ("r", 5, "s") for r in out.values())
    assert op5_pii.sanitised(docs.limit(0)).count() == 0


def test_a_page_of_many_values(spark):
    """Addresses that only one page holds make a candidate per term; those of other pages, too, stay apart."""
    page = " ".join(f"name{i}x a{i}@b.com" for i in range(200))
    rows = [page, "name7x a7@b.com", "name9x wrote", "other words a3@b.com a5@b.com", "more words a3@b.com a5@b.com"] + [f"plain{k} text" for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    stored = op5_pii.detect(docs.selectExpr("doc_id as row", "doc_id", "text")).filter("row is not null")
    firsts, valued = op5_pii.alike(stored.selectExpr("row", "explode(values) as e"))
    assert sorted((r["row"], r["n_e"]) for r in valued.collect()) == [(0, 1), (0, 2), (0, 3), (1, 2), (3, 3), (4, 3)] and firsts.count() == 3
    got = {r["doc_id"]: r["spans"] for r in op5_pii.report(docs).collect()}
    assert got == dict(enumerate(brute_terms(rows)))


# --- decontamination


def test_blocks_live_one_at_a_time(spark, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    alive, most, blocks = weakref.WeakSet(), [0], []
    of = op6_decontaminate.Index.of.__func__ if hasattr(op6_decontaminate.Index.of, "__func__") else op6_decontaminate.Index.of

    def counted(rows):
        gc.collect()
        made = of(rows)
        alive.add(made)
        blocks.append(len(rows))
        most[0] = max(most[0], len(alive))
        return made

    monkeypatch.setattr(op6_decontaminate.Index, "__hash__", object.__hash__, raising=False)
    monkeypatch.setattr(op6_decontaminate.Index, "of", staticmethod(counted))
    docs = docs_of(spark, sf)
    got = op6_decontaminate.report(docs, items, max_bytes=size // 10 + 1).collect()
    assert len(blocks) == 10 and most[0] <= 2  # one that is made while the last one's scan has ended
    check(got, brute_hits(texts(docs), [tuple(r) for r in items.collect()]))


def test_index_memory():
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"word{k}" for k in rng.integers(0, 100_000, 300))) for i in range(2000)]
    index = op6_decontaminate.Index.of(rows)
    assert index.nbytes < 8 * sum(len(t) for _, t in rows)


# --- licences


def value(expression):
    """A licence expression's value by recursive descent; None if it has an odd token."""
    tokens = re.findall(r"\(|\)|[A-Za-z0-9.+:-]+", expression)
    at = 0

    def primary():
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            v = either()
            at += 1
            return v
        v = op8_licenses.value_of(t)
        if at < len(tokens) and tokens[at] == "WITH":
            at += 2
            v = max(v, 0.6) if v >= 0.3 else v
        return v

    def both():
        nonlocal at
        v = primary()
        while at < len(tokens) and tokens[at] == "AND":
            at += 1
            v = min(v, primary())
        return v

    def either():
        nonlocal at
        v = both()
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            v = max(v, both())
        return v

    return either()


def expression(rng, depth=0):
    ids = ["MIT", "GPL-3.0-only", "LGPL-2.1", "Apache-2.0", "CC-BY-NC-4.0", "foo", "MPL-2.0"]
    kind = rng.integers(0, 5) if depth < 4 else 0
    if kind < 2:
        return str(rng.choice(ids)) + (" WITH some-exception" if rng.random() < 0.2 else "")
    if kind == 2:
        return f"({expression(rng, depth + 1)})"
    return f"{expression(rng, depth + 1)} {'AND' if kind == 3 else 'OR'} {expression(rng, depth + 1)}"


def test_license_labels_and_score(spark):
    """labels and score of whole texts by plain searches and a recursive descent."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        lines = list(rng.choice([*op8_licenses.BASE, *op8_licenses.NOTICES, "plain words", "MIT", ""], rng.integers(0, 4)))
        lines += [f"SPDX-License-Identifier: {expression(rng)}" for _ in range(rng.integers(0, 3))]
        rows.append("\n".join(map(str, rng.permutation(lines))) if lines else "")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for r in op8_licenses.report(docs).collect():
        text = rows[r["doc_id"]]
        flat = " " + " ".join(re.findall(r"[a-z0-9]+", text.lower())) + " "
        labels = {label for phrase, label in {**op8_licenses.BASE, **op8_licenses.NOTICES}.items() if f" {phrase} " in flat}
        values = [op8_licenses.VALUES[x] for x in labels]
        for m in re.finditer("SPDX-License-Identifier: (.*)", text):
            values.append(value(m[1]))
            labels |= {"spdx:" + x.lower() for x in re.findall(r"[A-Za-z0-9.-]+(?: WITH [A-Za-z0-9.-]+)?", re.sub(r"\b(AND|OR)\b|[()]", "|", m[1])) if x}
        assert (r["labels"], r["score"]) == (",".join(sorted(labels)), min(values, default=0.5)), text


@pytest.mark.parametrize("rows", [[], [None, None]])
def test_pii_without_texts(spark, rows):
    docs = odd_docs(spark, rows) if rows else odd_docs(spark).limit(0)
    assert [r["spans"] for r in op5_pii.report(docs).collect()] == [""] * docs.count()


def test_license_classes():
    """Identifiers by the longest family that they begin with; unknown ones aren't held against a document."""
    want = {"EUPL-1.2": 0.3, "MS-PL": 0.6, "BSL-1.0": 1.0, "BUSL-1.1": 0.1, "Artistic-2.0": 0.6, "CDDL-1.0": 0.6, "PSF-2.0": 1.0, "CC-BY-4.0": 1.0, "CC-BY-NC-SA-4.0": 0.1, "CC-BY-SA-3.0": 0.6, "GPL-2.0+": 0.3, "MIT": 1.0, "MITx": 0.5, "LicenseRef-own": 0.5}
    assert {x: op8_licenses.value_of(x) for x in want} == want
    assert "cc-by" not in op8_licenses.scan("sent cc by mail")[5] and op8_licenses.scan("under CC BY 4.0 terms")[5] == "cc-by"
