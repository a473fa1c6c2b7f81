"""The corpus operators against brute force, and on hostile tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keyfold.llm import components, exact, hashing, minhash, mixing, packing, phrases, pii, redirects, tokens, topk, toxicity
from keyfold.llm.queries import BYTE_TOKENIZER, ORACLE, QUERIES, WORD_TOKENIZER
from keyfold.llm.tokenizing import Encoder, read_tokenizer
from keyfold.session import new_stage_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slice int, rep string, hash string"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty, blank, very long and repeated texts, ties, repeated rows, clashing column names."""
    base = " ".join(f"w{i % 97}x{i % 13}" for i in range(300))
    near = " ".join(f"w{i % 97}x{i % 13}" if i % 60 else f"new{i}" for i in range(300))
    phrase = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, base), (7, near), (8, base),
        (9, f"before {phrase} after {base[:500]}"), (10, f"other words {phrase}\n\n  end"), (11, "la " * 400),
        (12, "x" * 100_000), (13, "word " * 20_000 + "end"), (14, "é 　 \U0001f600 qİ É"),
        (15, "a\r\nb\x0bc\x0cd  <|endoftext|> it's"), (16, None), (17, "scum idiot words here"),
    ]
    table = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 4}", len(t or ""), i, "r", "h") for i, t in rows]
    return spark.createDataFrame(table + table[5:6], SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def few(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert sorted(df.columns) == sorted(columns) and repr(got) == repr(sorted(result.fetchall()))


# --- words, tokenizers, components ---------------------------------------------------------------
def test_words_are_those_of_the_pattern():
    texts = ["a b", None, "", "  x y \x0b\x0c z\n", "　q"]
    found = hashing.words_of(texts)
    split = [found.data[a:b].decode() for a, b in zip(found.starts, found.ends)]
    assert split == [w for t in texts for w in words(t)]
    assert found.counts().tolist() == [len(words(t)) for t in texts]
    again = hashing.words_of(["z a", "b"])
    assert again.hashes[1] == found.hashes[0] and again.hashes[2] == found.hashes[1]


@pytest.mark.parametrize("path", [BYTE_TOKENIZER, WORD_TOKENIZER])
def test_encoder_equals_the_library(docs, few, path):
    encoder, plain = Encoder(read_tokenizer(path)), Tokenizer.from_file(path)
    odd = ["a  b", " a", "a ", "a \n b", "  x  ", "a​ b", "ÉCOLE É ²½ Ⅷ１", "a\x1c b\x85 c",
           "don't DON'T 'S x's", "a <|endoftext|> b<|startoftext|>c", "한국어 123 a_b", "x\r\n  y\t\tz", "1" * 50]
    for text in odd + [r["text"] for t in (docs, few) for r in t.select("text").collect()]:
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, (text or "")[:60]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 150), (None, 3), (3, None)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    found = dict(rows_of(components.connected_components(spark.createDataFrame(edges + hub, "a long, b long"))))
    want = {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150} | {1000 + i: 1000 for i in range(300)}
    assert found == want
    assert rows_of(components.connected_components(spark.createDataFrame([], "a long, b long"))) == []


# --- 1 ------------------------------------------------------------------------------------------------
def brute_top_k(rows, is_query, k):
    points = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            points.append((i, [int(np.floor(64 * float(x))) for x in v]))
    out = []
    for q, a in {i: v for i, v in points if is_query(i)}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in points if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("pivots,block,piece", [(4, 3, 7), (16, 64, 1000), (1, 2, 2)])
def test_top_k_with_ties_and_bad_vectors(spark, pivots, block, piece):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(1).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.0, 0.0]) for i in range(40)]  # one vector holds a quarter of the rows
    rows += [(300, None), (305, [None, 1.0]), (310, [float("nan"), 1.0]), (315, [float("inf")]), (320, []), (325, [9.0]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, cell int")
    found = topk.top_k(df, F.col("vec_id") % 5 == 0, 6, pivots=pivots, query_block=block, point_piece=piece)
    assert sorted(rows_of(found)) == brute_top_k(rows, lambda i: i % 5 == 0, 6)
    assert rows_of(topk.top_k(df.filter("vec_id > 999"), F.col("vec_id") % 5 == 0, 6)) == []


def test_bounds_leave_far_cells_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * 0.05).tolist()) for i in range(800)]
    v = np.array([r[1] for r in rows])
    cells = topk._Cells(v[:8] * 64, float(np.sqrt(((v * 64) ** 2).sum(1).max())))
    at, far = cells.of_points(v * 64)
    cells.summarised(np.bincount(at, minlength=8), np.array([far[at == c].max() for c in range(8)]))
    distances = cells.of_queries(v[:40] * 64)
    needed = cells.needed(distances, cells.reach(distances, 10))
    assert needed.sum() < 0.7 * needed.size
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(rows_of(topk.top_k(df, F.col("vec_id") % 20 == 0, 10, pivots=8))) == brute_top_k(rows, lambda i: i % 20 == 0, 10)


# --- 2 ------------------------------------------------------------------------------------------------
def brute_phrases(rows, size):
    starts = Counter()
    for _, text in rows:
        w = words(text)
        starts.update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for doc_id, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - size + 1):
            if starts[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("size,slice_bytes,owner_bytes", [(35, 1 << 21, 1 << 22), (35, 20_000, 50_000), (7, 3_000, 3_000), (2, 50_000, 9_000)])
def test_recurring_passages(docs, few, size, slice_bytes, owner_bytes):
    table = few.select("doc_id", "text") if size > 5 else docs
    found = phrases.remove_recurring(table, size, slice_bytes, owner_bytes)
    assert sorted(rows_of(found)) == brute_phrases([(r["doc_id"], r["text"]) for r in table.collect()], size)


def test_recurring_passages_on_hostile_table(docs):
    found = sorted(rows_of(phrases.remove_recurring(docs)))
    assert found == brute_phrases([(r["doc_id"], r["text"]) for r in docs.collect()], 35)
    assert rows_of(phrases.remove_recurring(docs.filter("doc_id < 0"))) == []


def test_personal_data_in_texts_of_many_spans(spark):
    """Positions over many blocks of matches and pieces of text, in code points, with and without context."""
    texts, wanted = [], {}
    for number, spans in enumerate([0, 1, 2, 3, 16, 17, 2500]):
        text, at = "\U0001F600" * 1000, []
        for i in range(spans):
            text += " server " if i % 3 == 0 else "\U0001F600 " * 60
            found = f"10.0.{i % 256}.7"
            at.append(("ip", len(text), len(text) + len(found), 1.0 if i % 3 == 0 else 0.7))
            text += found + "\U0001F600 " * 60
        texts.append((number, text))
        wanted[number] = at
    rows = pii.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: [(*s[:3], round(s["score"], 6)) for s in r["base"]] for r in rows} == wanted


@pytest.mark.parametrize("key_bits", [1, 6, 12])
def test_windows_that_only_share_a_key_stay(docs, key_bits):
    found = phrases.remove_recurring(docs, 7, 4096, 4096, key_bits=key_bits)
    assert sorted(rows_of(found)) == brute_phrases([(r["doc_id"], r["text"]) for r in docs.collect()], 7)


# --- 3 ------------------------------------------------------------------------------------------------
def test_redirects_and_canonical_links(spark):
    rows = [
        (1, "https://WWW.Example.com/en/a", None), (2, "http://x.net/es/1", "<p>"), (3, None, None), (4, "no scheme", ""),
        (5, "http://plain.org/a", '<LINK rel="canonical" href="http://x.net/es/1">'),
        (6, "http://other.org/b?q=1", "<meta content='0; url=//plain.org/a' http-equiv='Refresh'>"),
        (7, "http://third.org/c", '<link href="/d" rel=canonical>'), (8, "https://third.org/d#top", "<p>x"),
        (9, "http://mix.org/e", '<link rel="canonical" href="http://x.net/es/2"><link rel="canonical" href="https://a.com/z">'),
        (10, "http://example.com/en/", ""), (11, "http://sub.example.com/en/x", ""), (12, "http://notexample.com", ""),
        (12, "http://notexample.com", ""), (13, "ftp://x.net?/es/", ""), (14, "http://moved.org/", "<link" * 2000),
    ]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, host string, node string")
    moved = spark.createDataFrame([("http://moved.org", "http://x.net/fr/9"), (None, "x")], "source_url string, target_url string")
    found = {r["page_id"]: tuple(r)[1:] for r in redirects.judge_urls(df, redirects=moved).collect()}
    assert found == {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("x.net", "/es/1", "net/es/", "block"),
        3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("plain.org", "/a", None, "block"),
        6: ("other.org", "/b", None, "block"), 7: ("third.org", "/c", None, "allow"), 8: ("third.org", "/d", None, "allow"),
        9: ("mix.org", "/e", None, "allow"), 10: ("example.com", "/en/", "example.com/en/", "block"),
        11: ("sub.example.com", "/en/x", "example.com/en/", "block"), 12: ("notexample.com", "", None, "allow"),
        13: ("x.net", "", None, "allow"), 14: ("moved.org", "/", None, "block"),
    }
    assert redirects.judge_urls(df).count() == len(rows)
    assert rows_of(redirects.judge_urls(df.filter("page_id < 0"))) == []


# --- 4 ------------------------------------------------------------------------------------------------
def test_exact_duplicates(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    want = sorted((i, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    for size in (1 << 20, 64):
        found = exact.exact_duplicates(docs, size).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
        kept = [r["doc_id"] for r in found if r["kept"]]
        assert sorted(kept) == sorted(max(ids) for ids in groups.values())
    assert sorted(r["doc_id"] for r in exact.drop_duplicates(docs).collect()) == sorted(kept)
    assert exact.drop_duplicates(docs).columns == docs.columns
    assert rows_of(exact.exact_duplicates(docs.filter("doc_id < 0"))) == []


def test_directory_splits_overfull_buckets():
    weights = {i: 10 for i in range(0, 64, 2)} | {5: 1000}
    d = exact.grow_directory(weights, 40, 6)
    loads = Counter()
    for lead, n in weights.items():
        loads[d.slots[lead >> 6 - d.depth]] += n
    assert d.depth == 6 and len(d.slots) == 64 and loads[d.slots[5]] >= 1000
    assert all(n <= 40 for b, n in loads.items() if b != d.slots[5])
    for bucket, bits in d.local.items():
        assert sum(s == bucket for s in d.slots) == 1 << d.depth - bits
    assert exact.grow_directory({}, 10, 6).slots == [0]


def test_chain_compares_texts_of_one_hash():
    import pandas as pd

    rows = [(7, "a", "da", 1, 1), (7, "b", "db", 2, 1), (7, "a", "da", 5, 2), (9, "c", "dc", 3, 1)]
    frames = [pd.DataFrame(rows[:2], columns=["hash", "text", "digest", "keep_id", "n"]),
              pd.DataFrame(rows[2:], columns=["hash", "text", "digest", "keep_id", "n"])]
    out = pd.concat(exact._chained(iter(frames))).values.tolist()
    assert out == [[7, "da", 5, 3], [7, "db", 2, 1], [9, "dc", 3, 1]]


# --- 5 ------------------------------------------------------------------------------------------------
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def brute_spans(text):
    def good(kind, found):
        d = re.sub("[^0-9]", "", found)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
                "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, text or "") if good(k, m.group())]


def test_personal_data(spark, few):
    odd = ["a@b.c%d@e.f", "\U0001f600 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1234.5.6.7", "+1 (555) 123-4567 +1((((", "a@b.ca@b.c.d@e.f @b.c a@@b.c a@b..c",
           "4111 1111 1111 1111 x 4111-1111-1111-1112", None, "", "+" * 500 + "1" * 9, "1.2.3", "0" * 30 + ".1.2.3 a@b.c.", "9" * 300,
           "visa 378282246310005 iban DE89 3704 0044 0532 0130 00 tel 030 1234 5678", "378282246310005 DE88 3704 0044 0532 0130 00 030 1234 5678"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(1000 + r["doc_id"], r["text"]) for r in few.collect()]
    df = spark.createDataFrame([(*r, "e") for r in rows + rows[:1]], "doc_id long, text string, email string")
    found = pii.personal_data_digest(df).collect()
    assert len(found) == len(rows) + 1
    texts = dict(rows)
    for r in found:
        spans = brute_spans(texts[r["doc_id"]])
        counts = Counter(s.split(":")[0] for s in spans)
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in BASE] == [counts[k] for k, _ in BASE]
        assert r["spans"].startswith(",".join(spans))
    added = {r["doc_id"]: r["spans"] for r in found}
    assert added[11] == "iban:26:53,card_short:5:20,phone_local:58:71" and added[12] == ""
    assert pii.personal_data_digest(df.filter("doc_id < 0")).count() == 0


def test_long_runs_do_not_stall_the_patterns(spark):
    df = spark.createDataFrame([(1, "x" * 300_000), (2, "1 " * 100_000), (3, "1" * 200_000), (4, "(" * 100_000), (5, "+1" + "(" * 100_000)],
                               "doc_id long, text string")
    assert [r["spans"] for r in pii.personal_data_digest(df).collect()] == [""] * 5


# --- 6 ------------------------------------------------------------------------------------------------
def test_mix_meets_targets(docs, few, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    for table in (docs, few):
        sizes = {r["doc_id"]: len(words(r["text"])) for r in table.collect()}
        sources = {r["doc_id"]: r["source"] for r in table.collect()}
        found = mixing.mix(table).collect()
        assert len(found) == table.count() and all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in found)
        taken, target, full = defaultdict(int), {}, {}
        for r in found:
            s = sources[r["doc_id"]]
            taken[s] += r["taken"]
            target[s], full[s] = r["target"], r["source_size"]
        assert all(target[s] - 1 < taken[s] <= target[s] for s in target)
        assert abs(sum(target.values()) - 1.5 * sum(full.values())) < 1e-6 * sum(full.values()) + 1e-9
        order = sorted(target, key=lambda s: (s is None, s))
        levels = {s: target[s] / (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        free = [v for s, v in levels.items() if target[s] < 2 * full[s] - 1e-6]
        assert max(free) - min(free) < 1e-6 and all(v <= max(free) + 1e-6 for v in levels.values())
        assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(table.repartition(5)).collect()))
    assert mixing.mix(docs.filter("doc_id < 0")).count() == 0


def test_take_gives_the_words_of_the_mix(few):
    shares = {r["doc_id"]: r["taken"] for r in mixing.mix(few).collect()}
    got = defaultdict(int)
    for r in mixing.take(few).collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == {i: n for i, n in shares.items() if n}


# --- 7 ------------------------------------------------------------------------------------------------
def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)


def test_near_duplicates(spark, docs, few):
    base = [f"t{i}" for i in range(200)]
    copies = []
    for c in range(90):  # a group larger than a block, linked through edits of varied size
        w = list(base)
        for k in range(c % 7):
            w[(c * 13 + k * 29) % 200] = f"edit{c}_{k}"
        copies.append((5000 + c, " ".join(w)))
    group = spark.createDataFrame(copies, "doc_id long, text string")
    for table in (docs, few, group):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert sorted(rows_of(minhash.near_duplicates(table))) == brute_near(rows)
    stays = {i for i, _, _, kept in brute_near([(r["doc_id"], r["text"]) for r in few.collect()]) if kept}
    assert {r["doc_id"] for r in minhash.keep_one_of_each(few).collect()} == stays
    assert rows_of(minhash.near_duplicates(docs.filter("doc_id < 0"))) == []


def test_table_keys_reach_similar_sets(few):
    """Pairs at the threshold share a pair of collections with the stated probability."""
    rng = np.random.default_rng(3)
    a, b = minhash._coefficients(minhash.COLLECTIONS * minhash.ROWS, minhash.SEED)
    hits = 0
    for _ in range(400):
        both, left, right = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 50, 50))
        halves = []
        for s in (np.concatenate([both, left]), np.concatenate([both, right])):
            least = (s[None, :] * a[:, None] + b[:, None] >> np.uint64(32)).min(1)
            halves.append(least.reshape(minhash.COLLECTIONS, minhash.ROWS))
        hits += (halves[0] == halves[1]).all(1).sum() >= 2
    assert hits >= 395


# --- 8 ------------------------------------------------------------------------------------------------
def test_toxicity_on_held_out_labels(spark):
    wide = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{wide}/{t}.parquet") for t in ("documents", "labels"))
    graded = labels.select("doc_id", toxicity.severity_grade(F.col("toxic"), F.col("quality")).alias("grade"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    model = toxicity.fit(docs, graded.filter(~held))
    found = toxicity.grade_documents(docs, model).drop("grade").join(graded.filter(held), "doc_id")
    pairs = Counter((r["toxic"], r["grade"] > 0) for r in found.collect())
    assert pairs[True, True] >= 0.75 * (pairs[True, True] + pairs[False, True])
    assert pairs[True, False] <= 0.02 * (pairs[True, False] + pairs[False, False])


def test_ordinal_fit_shares_weights():
    rng = np.random.default_rng(4)
    truth = np.array([2.0, -2.0, 1.0, 0.0, 0.0])
    x = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(3000)]
    noise = rng.logistic(size=3000)
    latent = np.array([truth[f].sum() for f in x]) + noise
    grades = (latent > 0).astype(int) + (latent > 2)
    weights, cuts = toxicity.fit_ordinal(x, grades, 5, steps=400)
    assert np.allclose(weights, truth, atol=0.35) and abs(cuts[0]) < 0.3 and abs(cuts[1] - 2) < 0.4


def test_toxicity_cases(spark, docs):
    labels = spark.createDataFrame([(17, 1), (6, 0), (7, 0), (None, 1), (9, None), (17, 2)], "doc_id long, grade int")
    model = toxicity.fit(docs, labels)
    assert toxicity.grade_documents(docs, model).count() == docs.count()
    none = toxicity.fit(docs, labels.filter("doc_id < 0"))
    assert {r["kept"] for r in toxicity.grade_documents(docs, none).collect()} == {True}
    assert toxicity.drop_toxic(docs, none).columns == docs.columns and toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.grade_documents(docs.filter("doc_id < 0"), model).count() == 0


# --- 9, 10 ----------------------------------------------------------------------------------------------
def encoded(table, path):
    plain = Tokenizer.from_file(path)
    return [(r["doc_id"], np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in table.collect()]


def test_token_files_round_trip(spark, docs, few):
    for table in (few, docs.dropDuplicates(["doc_id"])):
        path = new_stage_path(spark, "tokens")
        tokens.write_token_files(table, path, BYTE_TOKENIZER)
        files = tokens.read_token_files(spark, path)
        want, at = [], 0
        for doc_id, ids in sorted(encoded(table, BYTE_TOKENIZER)):
            want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
            at += len(ids) // 4
        assert sorted(rows_of(tokens.token_digest(files))) == want
        assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in \
            files.filter("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    path = new_stage_path(spark, "tokens")
    tokens.write_token_files(docs, path, BYTE_TOKENIZER)
    assert tokens.token_digest(tokens.read_token_files(spark, path)).count() == docs.count()
    path = new_stage_path(spark, "tokens")
    tokens.write_token_files(docs.filter("doc_id < 0"), path, BYTE_TOKENIZER)
    assert rows_of(tokens.token_digest(tokens.read_token_files(spark, path))) == []


@pytest.mark.parametrize("window,pool", [(4096, 4096), (64, 40)])
def test_packing(docs, few, window, pool):
    for table in (few, docs):
        ids = defaultdict(list)
        for doc_id, data in encoded(table, WORD_TOKENIZER):
            ids[doc_id].append(data)
        rows = packing.pack_documents(table, WORD_TOKENIZER, window, pool=pool, pool_low=pool // 4).collect()
        cover, fill = defaultdict(list), defaultdict(list)
        for r in rows:
            data = ids[r["doc_id"]][0]
            assert zlib.crc32(data[4 * r["start"]:4 * (r["start"] + r["length"])]) == r["ids_crc32"] and r["doc_tokens"] == len(data) // 4
            cover[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
            fill[r["sequence_id"]].append((r["offset"], r["length"]))
        for doc_id, data in ids.items():
            assert sorted(cover[doc_id]) == sorted(list(range(len(data[0]) // 4)) * len(data))
        totals = []
        for pieces in fill.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= window
            totals.append(at)
        short = sum(t < window for t in totals)
        assert short <= table.rdd.getNumPartitions()
    assert packing.pack_documents(docs.filter("doc_id < 0"), WORD_TOKENIZER).count() == 0


def test_fill_is_closest_to_capacity():
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6))}
        chosen = packing.fill(counts, 60)
        assert all(counts[n] >= k for n, k in chosen)
        totals = {0}
        pieces = [n for n, c in counts.items() for _ in range(c)]
        pieces.remove(max(counts))
        for n in pieces:
            totals |= {t + n for t in totals if t + n <= 60 - max(counts)}
        assert sum(n * k for n, k in chosen) == max(counts) + max(totals)


# --- pipeline ---------------------------------------------------------------------------------------------
def test_pipeline_stages_against_brute_force(spark, few):
    docs = few
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = new_stage_path(spark, name)
        out = stage(spark, docs, SF)
        assert out.columns == few.columns, name
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    tox, unique, near, mix = kept
    graded = QUERIES["op8_ordinal_toxicity"](spark, SF)
    assert {r["doc_id"] for r in tox.collect()} == {r["doc_id"] for r in graded.filter("kept").collect()}
    texts = defaultdict(int)
    for r in tox.collect():
        texts[r["text"]] = max(texts[r["text"]], r["doc_id"])
    assert {r["doc_id"] for r in unique.collect()} == set(texts.values())
    stays = {i for i, _, _, k in brute_near([(r["doc_id"], r["text"]) for r in unique.collect()]) if k}
    assert {r["doc_id"] for r in near.collect()} == stays
    total, taken = (sum(len(words(r["text"])) for r in t.collect()) for t in (near, mix))
    assert abs(taken - 1.5 * total) <= 30
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == sum(len(d) // 4 for _, d in encoded(mix, WORD_TOKENIZER))


# --- null and large ids, clashing names, empty tables ---------------------------------------------------
BIG = 1 << 60


@pytest.fixture(scope="module")
def odd_ids(spark):
    """Ids that a float cannot hold beside null ids and repeated ids, in one batch."""
    text = " ".join(f"p{i}" for i in range(50))
    rows = [(BIG + 1, text + " one"), (None, text + " two"), (BIG + 3, "idiot scum a b c d"), (None, None), (7, "a b c d"),
            (7, "e f g h i j k l"), (8, "q r s t"), (None, "m n o")]
    return spark.createDataFrame([(i, t, "s", n, n, n, n) for n, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, source string, _row int, _size int, _taken int, _all int").coalesce(1)


def by_id(ids):
    return sorted(ids, key=lambda i: (i is not None, i))


def test_ids_stay_as_they_are(spark, odd_ids):
    ids = by_id(r["doc_id"] for r in odd_ids.collect())
    model = toxicity.fit(odd_ids, spark.createDataFrame([(BIG + 3, 1), (7, 0)], "doc_id long, grade int"))
    path = new_stage_path(spark, "tokens")
    tokens.write_token_files(odd_ids, path, BYTE_TOKENIZER)
    for found in (packing.pack_documents(odd_ids, WORD_TOKENIZER), phrases.remove_recurring(odd_ids),
                  toxicity.grade_documents(odd_ids, model), mixing.mix(odd_ids), minhash.near_duplicates(odd_ids),
                  tokens.token_digest(tokens.read_token_files(spark, path)), exact.exact_duplicates(odd_ids),
                  pii.personal_data_digest(odd_ids)):
        assert by_id(r["doc_id"] for r in found.collect()) == ids
    assert sorted(r["n_removed"] for r in phrases.remove_recurring(odd_ids).collect())[-2:] == [50, 50]


def test_take_by_row(odd_ids):
    wanted = sum(r["taken"] for r in mixing.mix(odd_ids).collect())
    got = mixing.take(odd_ids)
    assert got.columns == odd_ids.columns
    rows = got.collect()
    assert sum(len(words(r["text"])) for r in rows) == wanted
    assert {r["_row"] for r in rows} == {0, 1, 2, 4, 5, 6, 7}
    assert mixing.take(odd_ids.filter("_row < 0")).count() == 0


def test_empty_tables_pass_the_stages(docs):
    empty = docs.filter("doc_id < 0")
    for out in (minhash.keep_one_of_each(empty), exact.drop_duplicates(empty), mixing.take(empty)):
        assert out.columns == docs.columns and out.count() == 0


# --- encoder ----------------------------------------------------------------------------------------------
ODD_PARTS = [*"aAbzZIiİıSsŞşßẞΣσςÉé çÇñÑ'.,;:!?)(-_09 1²½Ⅷ１한글漢字ǅǰŉΐᾷﬁΩÅ", "\u0307", "\u0301", "\u0345", "\u200b", "\n", "\t", "\r", "  ",
             "\u00a0", "\u3000", "'s", "'LL", "<|endoftext|>", "<", "|>", "\U0001f600", "DERSİ", "BELEDİYESİ,", "\x1c", "\x85", "\ufeff"]


@pytest.mark.parametrize("path", [BYTE_TOKENIZER, WORD_TOKENIZER])
def test_encoder_equals_the_library_on_random_texts(path):
    rng = random.Random(7)
    encoder, plain = Encoder(read_tokenizer(path)), Tokenizer.from_file(path)
    texts = ["".join(rng.choices(ODD_PARTS, k=rng.randint(1, 14))) for _ in range(50_000)]
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids, text


@pytest.mark.parametrize("path", [BYTE_TOKENIZER, WORD_TOKENIZER])
def test_encoder_equals_the_library_around_line_feeds_and_marks(path):
    rng = random.Random(11)
    encoder, plain = Encoder(read_tokenizer(path)), Tokenizer.from_file(path)
    parts = ["\n", "\n", "\n", "\r\n", " ", " ", "\0", "\t", "one", "Été", "x.", "y!!", "z'", "'s", "$%=", "<|endoftext|>", "<", "|>", "3", "\u0338"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(30_000)]
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids, text


def test_encoder_remembers_words_on_both_sides_of_a_line_feed():
    """Not each pair of a line's last and the next one's first word, of which there are many more."""
    encoder, plain = Encoder(read_tokenizer(BYTE_TOKENIZER)), Tokenizer.from_file(BYTE_TOKENIZER)
    names = [f"{a}{b}e" for a in "bdfgklm" for b in "aiou"]
    text = "All of " + " and ".join(f"{a}.{feed}{b}" for a in names for b in names for feed in ("\n", "\n\n"))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(encoder.quick) < 5 * len(names) and not encoder.whole


def test_encoder_of_an_unknown_rule_is_the_library(few):
    stated = json.loads(read_tokenizer(WORD_TOKENIZER))
    stated["normalizer"]["normalizers"] = stated["normalizer"]["normalizers"][:2]  # keeps capitals
    encoder, plain = Encoder(json.dumps(stated)), Tokenizer.from_str(json.dumps(stated))
    assert not encoder.known
    for r in few.limit(20).collect():
        assert np.frombuffer(encoder.encode(r["text"]), "<u4").tolist() == plain.encode(r["text"] or "", add_special_tokens=False).ids


# --- rules and links against brute force ---------------------------------------------------------------------
def test_many_rules_as_a_table(spark, monkeypatch):
    hosts = ["a.com", "b.a.com", "com", "x.org", "org", "", "no.such"]
    paths = ["/", "/a", "/a/b", "/ab", ""]
    rules = [redirects.Rule(h, p, "block" if (i + j) % 2 else "allow") for i, h in enumerate(hosts[:5]) for j, p in enumerate(paths) if (i, j) != (2, 4)]
    pages = [(i, f"http://{h}{p}{q}", None) for i, (h, p, q) in enumerate((h, p, q) for h in [*hosts, "c.b.a.com", "xa.com"] for p in paths for q in ("", "c?x"))]
    df = spark.createDataFrame([*pages, pages[0], (99, None, None)], "page_id long, url string, html string")
    as_expression = sorted(rows_of(redirects.judge_urls(df, rules[:8])), key=repr)
    monkeypatch.setattr(redirects, "EXPRESSION_RULES", 0)
    assert sorted(rows_of(redirects.judge_urls(df, rules[:8])), key=repr) == as_expression
    want = []
    for i, u, _ in [*pages, pages[0], (99, None, None)]:
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups() if u else ("", "")
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.text), default=None)
        want.append((i, host, path, rule and rule.text, rule.verdict if rule else "allow"))
    more = [redirects.Rule(f"h{i}.net", "/", "block") for i in range(2000)]
    for listed in (rules, [*rules, *more]):
        assert sorted(rows_of(redirects.judge_urls(df, listed)), key=repr) == sorted(want, key=repr)


def test_links_of_a_whole_table_against_union_find(spark):
    """Every given page links to a page drawn by a hash; verdicts follow from a plain union-find."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r["page_id"]: r["url"] for r in pages.collect() if r["url"] and "://" in r["url"]}
    ids = sorted(rows)
    target = {i: rows[ids[zlib.crc32(str(i).encode()) % len(ids)]] for i in ids if i % 3}
    linked = spark.createDataFrame([(i, u, f'<link rel="canonical" href="{target[i]}">' if i in target else None)
                                    for i, u in rows.items()], "page_id long, url string, html string")
    rules = [*redirects.RULES, redirects.Rule("org", "/de/", "block")]

    def parts(url):
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        return m[1].lower(), m[2]

    def node(url):
        host, rest = re.match(r"([^/?#]*)([^#]*)", url.split("://", 1)[1]).groups()
        return host.lower() + (rest or "/")

    def own(host, path):
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.text)) if fit else None
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n
    for i, t in target.items():
        root[find(node(rows[i]))] = find(node(t))
    shared = defaultdict(set)
    for n in list(root):
        rule = own(*parts("x://" + n))
        shared[find(n)] |= {rule.verdict} if rule else set()
    want = []
    for i, u in rows.items():
        rule, found = own(*parts(u)), shared[find(node(u))] if node(u) in root else set()
        want.append((i, *parts(u), rule and rule.text, rule.verdict if rule else min(found, default="allow")))
    got = rows_of(redirects.judge_urls(linked, rules))
    assert sorted(got) == sorted(want)
    assert sum(r[3] is None and r[4] == "block" for r in got) > 5
