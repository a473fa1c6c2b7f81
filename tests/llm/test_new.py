"""Alignment, periodic runs and page text against brute force, and on hostile tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyfold.llm import alignment, html_text, periods
from keyfold.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, QUERIES, repeat_tail
from keyfold.llm.tokenizing import byte_letters, read_tokenizer

SF = "/root/testdata/sf0.001"
BIG = 1 << 60


@pytest.fixture(scope="module")
def hostile(spark):
    texts = [None, "", " \t\n", "a  b", " x", "a\u2581b", "x\n y", "\ud55c\uad6d\uc5b4 \U0001f600", "<|endoftext|> <s> </s> <0x41>", "a ", "\u00c9",
             "la " * 3000, "x" * 20_000, "word " * 20_000 + "end", "one two three " * 9 + "four", "la " * 3000]
    rows = [(BIG + 1 + i if i % 4 else None, t, i, "r", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[1:2] + rows[14:15], "doc_id long, text string, n_a int, runs string, links int").repartition(2)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- 11 ------------------------------------------------------------------------------------------------
class Plain:
    """Alignment of one text, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTE_TOKENIZER)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
        self.byte = {c: b for b, c in enumerate(byte_letters())}

    def tokens(self, text):
        """(id, bytes) of both sides; none if a side does not give the text back."""
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else
              self.b.id_to_piece(i).replace("\u2581", " ").encode()) for i in self.b.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if all(b"".join(t for _, t in side) == whole for side in (a, b)) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (a, b)]
        out, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [ends[0].index(cut) + 1, ends[1].index(cut) + 1]
            out.append(([i for i, _ in a[at[0]:to[0]]], [i for i, _ in b[at[1]:to[1]]]))
            at = to
        return len(a), len(b), out


def brute_alignment(rows):
    plain = Plain()
    found = [(i, *plain.groups(t)) for i, t in rows]
    count = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, n_a, n_b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(QUERIES["op11_tokenizer_alignment"](spark, SF)) == want


def test_alignment_of_a_hostile_table(hostile):
    found = alignment.alignment_digest(hostile, BYTE_TOKENIZER, PIECE_MODEL)
    assert rows_of(found) == brute_alignment([(r["doc_id"], r["text"]) for r in hostile.collect()])
    assert alignment.alignment_digest(hostile.filter("n_a < 0"), BYTE_TOKENIZER, PIECE_MODEL).count() == 0
    spelled = alignment.align(hostile, BYTE_TOKENIZER, PIECE_MODEL).collect()
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in spelled)


def test_byte_tokens_equal_the_library():
    side, plain, rng = alignment.ByteTokens(read_tokenizer(BYTE_TOKENIZER)), Plain(), random.Random(3)
    assert side.run.__name__ == "encode_ordinary"
    parts = [*"aAbzIiİıß'.,;:!?)(-_09 1²Ⅷ漢字ǅ", "\u0307", "\u200b", "\n", "\t", "\r", "  ", "\u00a0", "\u3000", "'s", "'LL", "<|endoftext|>",
             "\x1c", "\x85", "\ufeff", "\u180e", "\U0001e900", "\u0378", "\U0001f600"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert side.encode([text])[0].tolist() == plain.a.encode(" " + text, add_special_tokens=False).ids, text


def test_products_of_incidence_matrices(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(3).collect()] + ["", "\ud55c\uad6d\uc5b4 x"]
    sides = alignment.tokenizers_of(read_tokenizer(BYTE_TOKENIZER), open(PIECE_MODEL, "rb").read())
    found = alignment.align_batch(texts, sides)
    (sa, sb), (ea, eb) = found.starts, found.ends
    shared = {(i, j): min(ea[i], eb[j]) - max(sa[i], sb[j]) for i in range(len(ea)) for j in range(len(eb)) if min(ea[i], eb[j]) > max(sa[i], sb[j])}
    assert {(i, j): v for i, j, v in zip(*map(np.ndarray.tolist, found.overlap_links()))} == shared
    assert set(zip(*map(np.ndarray.tolist, found.end_links()))) == {(i, j) for i, j in shared if ea[i] == eb[j]}
    ga, gb = found.groups()
    assert set(zip(*map(np.ndarray.tolist, found.group_links()))) == {(i, j) for i in range(len(ga)) for j in range(len(gb)) if ga[i] == gb[j]}
    rng = np.random.default_rng(1)
    dense = [rng.random((7, 9)) < 0.3, rng.random((9, 5)) < 0.3]
    a, b = (alignment.Rows(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], d.shape[1]) for d in dense)
    out = np.zeros((7, 5), int)
    for i, j, v in zip(*alignment.row_products(a, b)):
        out[i, j] = v
    assert (out == dense[0].astype(int) @ dense[1].astype(int)).all()
    assert (b.transposed().columns == np.nonzero(dense[1].T)[1]).all()


# --- 12 ------------------------------------------------------------------------------------------------
def brute_runs(words, least=12):
    """For every period, the longest stretches that keep it; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        same = np.append(words[:-q] == words[q:], False)
        edges = np.flatnonzero(np.diff(np.append(False, same).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if end - start >= max(least, 2 * q):
                found.setdefault((start, end), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def coded(words):
    codes = {}
    return np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)


def hard_sequences(rng):
    """Sequences in which factors of a run recur at smaller distances than its period."""
    kind, n = rng.random(), rng.randint(0, 90)
    if kind < 0.3:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind < 0.45:
        a, b = [0], [0, 1]
        while len(b) < 150:
            a, b = b, b + a
        return b[rng.randint(0, 30):rng.randint(30, 150)]
    base = [rng.randint(0, rng.choice([0, 1, 2])) for _ in range(rng.randint(1, 9))]
    inner = (base * 12)[:rng.randint(2, 40)] + [rng.randint(0, 2) for _ in range(rng.randint(0, 3))]
    return [rng.randint(0, 1)] * rng.randint(0, 2) + (inner * 4)[rng.randint(0, 3):rng.randint(5, 160)]


def test_runs_against_brute_force():
    rng, total = random.Random(5), 0
    for _ in range(2500):
        words, least = hard_sequences(rng), rng.choice([2, 4, 12])
        found = periods.find_runs(np.array([*words, 99], np.int64), least)
        got = [(s, e - s, q) for s, e, q in zip(*(c.tolist() for c in found))]
        total += len(got)
        assert got == brute_runs(np.array(words, np.int64), least), words
    assert total > 10_000


def test_periodic_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rewritten = 0
    for r in QUERIES["op12_periodic_runs"](spark, SF).collect():
        original = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]] or "")]
        words = list(original)
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else original[a + (i - a) % p] for i, w in enumerate(original)]
            rewritten += words != original
        assert repeat_tail(r["doc_id"], original) == words
        runs = brute_runs(coded(words))
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        collapsed = brute_collapsed([w.decode() for w in words], runs)
        assert tuple(r) == (r["doc_id"], len(runs), *top, top[1] and 1000 * top[1] // top[2],
                            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())
    assert rewritten > 5


def test_runs_of_a_hostile_table(hostile):
    found = periods.collapse_runs(hostile).collect()
    want = []
    for r in hostile.collect():
        words = (r["text"] or "").encode().split()
        runs = brute_runs(coded(words)) if len(words) < 5000 else [(0, 20_000, 1)]
        want.append((r["doc_id"], len(words), runs, brute_collapsed([w.decode() for w in words], runs)))
    got = [(r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periods.collapse_runs(hostile.filter("n_a < 0")).count() == 0


# --- 13 ------------------------------------------------------------------------------------------------
def plain_text(page):
    """The article of the given pages, which is stated in the open."""
    import html

    article = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", article[1]) if article else []
    lines = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_page_text_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = QUERIES["op13_html_text"](spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        page = pages[r["page_id"]]
        assert tuple(r) == (page["page_id"], page["url"], plain_text(page["html"]), len(plain_text(page["html"])))


PAGES = [
    ("<html><body><div class='site-header'><h1>Site</h1></div><div id=main-content><h2>T &amp; x</h2><p>One, two&nbsp; three.<p>Four<br>"
     "five <a href=x>six</a>.<ul><li>item one<li>item</ul></div><div class='comments-list'><p>I think, that this is good. Really, yes! "
     "very long comment, with marks.</p></div><footer>c</footer></body></html>", "T & x\nOne, two three.\nFour five six.\nitem one\nitem"),
    ("<article><header><h1>Head</h1><span>by me</span></header><p>Short.</p><aside>no</aside><form>f<p>x</p></form><section id='comments'>"
     "<p>c</p></section><div class=ad>Buy</div><table><tr><td>a<td>b</table></article><p>outside long text, yes. It is, very. long</p>",
     "Head\nShort.\na\nb"),
    ("<body><div class=top><a href=1>Home</a> <a href=2>News</a></div><div><p>The text, in two parts.</p><p>It goes on, and ends.</p></div>"
     "<div class='cookie-notice'>We use cookies, as all do. Do you accept?</div></body>", "The text, in two parts.\nIt goes on, and ends."),
    ("<main><div>One block of text, not in a paragraph.</div><div hidden>never</div><ul><li><a href=x>link</a></ul></main>",
     "One block of text, not in a paragraph."),
    ("plain text  only\n x", "plain text only x"), ("", ""), (None, ""), ("<nav>x</nav><footer>y</footer>", ""),
    ("<p>unclosed <b>bold <p>two <!-- c", "unclosed bold\ntwo"), ("<p>a < b and c > d, ok.</p><noscript>no</noscript>", "a < b and c > d, ok."),
    ("<script>var a='<p>x</p>'</script><style>p{}</style><p>ok a &lt; b</p><SCRIPT>", "ok a < b"),
]


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_page_text_of_odd_pages(number):
    assert html_text.main_text(PAGES[number][0]) == PAGES[number][1]


def test_page_text_of_a_table(spark):
    rows = [(BIG + i if i % 3 else None, f"u{i}" if i % 2 else None, page, "t", i) for i, (page, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string, path int")
    want = [(r[0], r[1], t) for r, (_, t) in zip(rows, PAGES)]
    assert rows_of(html_text.extract_text(df)) == sorted(want + want[:1], key=repr)
    assert html_text.extract_text(df.filter("path < 0")).count() == 0


def test_hostile_pages_take_linear_time():
    n = 40_000
    pages = ["<a " * n, '<a "' * n, "<a b='" * n, "<" * n, "<div>" * n + "x" + "</q></x>" * n, "<x>" * n + "y", "<!--" * n, "&#x41;&" * n,
             "<script>" * n, "<p><b>" * n, "<ul><li>" * n + "x", "".join(f"<div class='k{i}'>Text, number {i}.</div>" for i in range(n // 2))]
    begin = time.process_time()
    texts = [html_text.main_text(p) for p in pages]
    assert time.process_time() - begin < 60
    assert texts[-1].count("\n") == n // 2 - 1
