import re
from collections import Counter
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.functions import text as T
from keyfold.operators import tokens as K
from keyfold.operators import vocabulary as V
from keyfold.operators.ranking import largest
from keyfold.registry import text_queries
from keyfold.registry.base import staged
from keyfold.session import write_stage

TEXTS = [
    (1, "Red  Car, red wheels!"), (2, "blue car\x1c«new»"), (3, ""), (4, None), (5, "!@#$"),
    (6, "  The THE the-car  №5 £10 "), (7, "Продам велосипед, новый велосипед"), (8, "car " * 400),
]


def python_clean(text):
    if text is None:
        return T.BAD_TEXT
    return " ".join(re.sub(T.SYMBOLS, "", text.lower()).split())


def python_tokens(text):
    spaced = text.lower().translate({ord(c): " " for c in T.VOCABULARY_FILTER})
    return [w for w in spaced.split(" ") if w]


@pytest.fixture(scope="module")
def cleaned(spark):
    return spark.createDataFrame(TEXTS, "id int, text string").select("id", T.clean("text").alias("text"))


def test_clean_matches_python(cleaned):
    assert {r["id"]: r["text"] for r in cleaned.collect()} == {i: python_clean(t) for i, t in TEXTS}


def test_title_description(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), ("", "")], "title string, description string")
    assert [r[0] for r in df.select(T.title_description()).collect()] == [
        "a b", T.NO_DESCRIPTION, T.NO_DESCRIPTION, " "]


def test_stopwords(spark):
    df = spark.createDataFrame([("the red car of the day",), ("the",), ("",)], "t string")
    assert [r[0] for r in df.select(T.remove_stopwords("t", ["the", "of"])).collect()] == ["red car day", "", ""]


def test_word_counts(cleaned):
    expected = Counter(w for _, t in TEXTS for w in python_clean(t).split())
    assert {r["word"]: r["n"] for r in V.word_counts(cleaned, "text").collect()} == expected


def expected_vocabulary(cap):
    counts = Counter()
    for _, t in TEXTS:
        counts.update(python_tokens(python_clean(t)))
    limit = min(cap, len({w for _, t in TEXTS for w in python_clean(t).split()}))
    # Counter keeps the order of first occurrence and sorted() is stable.
    ranked = sorted(counts, key=lambda w: -counts[w])
    return {w: i for i, w in enumerate(ranked, 1) if i < limit}


@pytest.mark.parametrize("cap", [1, 5, 100_000])
def test_vocabulary_order_ties_and_limit(cleaned, cap):
    got = {r["word"]: r["idx"] for r in V.vocabulary(cleaned, "text", "id", cap).collect()}
    assert got == expected_vocabulary(cap)


def test_sequences_and_padding(cleaned):
    vocab = expected_vocabulary(6)
    seq = V.text_to_sequence(cleaned, "text", "id", V.vocabulary(cleaned, "text", "id", 6))
    got = {r["id"]: list(r["sequence"]) for r in seq.collect()}
    want = {i: [vocab[w] for w in python_tokens(python_clean(t)) if w in vocab] for i, t in TEXTS}
    assert got == want
    for r in seq.select("id", T.pad_front("sequence", 300).alias("p")).collect():
        full = [0] * 300 + want[r["id"]]
        assert list(r["p"]) == full[-300:]


def test_new_words_and_rate(spark, cleaned):
    vocab = V.vocabulary(cleaned, "text", "id", 100_000)
    known = [spark.createDataFrame([(w,) for w in ws], "word string")
             for ws in (["car", "red", "the"], ["car", "red"], ["car"])]
    new = V.new_words(vocab, known)
    expected = set(expected_vocabulary(100_000)) - {"car"}
    assert {r["word"] for r in new.collect()} == expected
    rates = {r["id"]: r["uq_rate"] for r in V.new_word_rate(cleaned, "text", "id", new).collect()}
    for i, t in TEXTS:
        words = python_clean(t).split()
        want = sum(w in expected for w in words) / len(words) if words else 1.0
        assert rates[i] == pytest.approx(want)


def test_vectors(spark):
    vocab = spark.createDataFrame([("a", 1, 5), ("b", 2, 4), ("c", 3, 1)], "word string, idx int, n int")
    vectors = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [4.0])], "word string, vector array<float>")
    stats = V.vector_stats(vectors, 3).first()
    values = [1, 2, 3, 0, 0, 4]
    mean = sum(values) / 6
    assert stats["mean"] == pytest.approx(mean)
    assert stats["std"] == pytest.approx((sum((v - mean) ** 2 for v in values) / 6) ** 0.5)
    rows = [{r["word"]: r for r in V.attach_vectors(vocab, vectors, 3, 0.5, 0.1).collect()} for _ in range(2)]
    assert rows[0]["a"]["vector"] == [1.0, 2.0, 3.0] and rows[0]["b"]["vector"] == [0.0, 0.0, 4.0]
    assert rows[0]["c"]["is_new"] and rows[0]["c"]["vector"] == rows[1]["c"]["vector"]


def test_random_vectors_are_normal(spark):
    vocab = spark.range(300).selectExpr("cast(id as string) word", "cast(id as int) idx")
    none = spark.createDataFrame([], "word string, vector array<float>")
    drawn = V.attach_vectors(vocab, none, 20, 2.0, 0.5)
    s = V.vector_stats(drawn, 20).first()
    assert s["mean"] == pytest.approx(2.0, abs=0.05) and s["std"] == pytest.approx(0.5, abs=0.05)


@pytest.mark.parametrize("cap", [4, 100])
def test_coded_tokens_equal_the_plain_path(spark, cleaned, cap):
    """Words with several, repeated, foreign and no vocabulary words inside; a repeated id; no text."""
    extra = spark.createDataFrame(
        [(20, "car-car,red a-b-a -- !!"), (20, "wheels"), (21, "red's reds red"), (None, "car the")], "id int, text string")
    texts = cleaned.unionByName(extra.select("id", T.clean("text").alias("text")))
    split = write_stage(K.split_texts(texts, "text", "id"), "split")
    dictionary = write_stage(K.word_dictionary(split, "id"), "dictionary")
    assert {r["word"]: r["n"] for r in dictionary.collect()} == {
        r["word"]: r["n"] for r in V.word_counts(texts, "text").collect()}
    vocab = write_stage(K.vocabulary_of(dictionary, cap), "vocabulary")
    assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, V.vocabulary(texts, "text", "id", cap).collect()))

    once = texts.filter("id <> 20 OR text <> 'wheels'")
    split = K.split_texts(once, "text", "id")
    coded = write_stage(K.coded_tokens(split, vocab, "id"), "coded")
    plain = V.text_to_sequence(once, "text", "id", vocab)
    assert {r["id"]: r["sequence"] for r in coded.collect()} == {r["id"]: r["sequence"] for r in plain.collect()}
    new = vocab.filter("idx % 2 = 1")
    plain = V.new_word_rate(once, "text", "id", new)
    marked = K.marked_rate(coded, "id", new.select("idx"))
    assert {r["id"]: r["uq_rate"] for r in marked.collect()} == {r["id"]: r["uq_rate"] for r in plain.collect()}


def test_coded_tokens_of_no_texts(spark):
    none = spark.createDataFrame([], "id int, text string")
    split = K.split_texts(none, "text", "id")
    dictionary = K.word_dictionary(split, "id")
    vocab = K.vocabulary_of(dictionary, 10)
    coded = K.coded_tokens(split, vocab, "id")
    assert coded.count() == vocab.count() == K.marked_rate(coded, "id", vocab).count() == 0


def test_sequences_and_rates_need_no_word(spark, cleaned):
    """Only the coding joins on words; what reads the coded table has no strings in its plan's output."""
    split = write_stage(K.split_texts(cleaned, "text", "id"), "split")
    dictionary = write_stage(K.word_dictionary(split, "id"), "dictionary")
    vocab = write_stage(K.vocabulary_of(dictionary, 100), "vocabulary")
    coded = write_stage(K.coded_tokens(split, vocab, "id"), "coded")
    plan = coded.select("id", "sequence")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "words" not in plan
    assert "string" not in {f.dataType.simpleString() for f in coded.schema}


@pytest.mark.parametrize("repeated", [False, True])
def test_texts_are_coded_where_they_lie(spark, repeated):
    """The same rows as by the join of all tokens; no token is shuffled, but for those of repeated ids."""
    rows = [(1, ["a-b", "c", "a", "--", "zz"]), (2, []), (3, None), (4, ["b", "a,", "c.a"]), (5, ["zz"])]
    rows += [(None, ["a"]), (4, ["c", "a-b"]), (None, ["b", "zz"])] if repeated else [(None, ["a"])]
    split = write_stage(spark.createDataFrame(rows, "doc_id long, words array<string>"), "split")
    vocab = write_stage(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, idx int"), "vocab")
    got = K.coded_tokens(split, vocab, "doc_id")
    assert sorted(got.collect(), key=str) == sorted(K.joined_tokens(split, vocab, "doc_id").collect(), key=str)
    assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == repeated
    texts = split.select("doc_id", F.array_join("words", " ").alias("text"))
    got = V.text_to_sequence(texts, "text", "doc_id", vocab)
    assert sorted(got.collect(), key=str) == sorted(V.joined_sequences(texts, "text", "doc_id", vocab).collect(), key=str)
    assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == repeated


def test_a_vocabulary_too_large_for_a_task_is_joined(spark, monkeypatch):
    monkeypatch.setattr(K.T, "VOCABULARY_CAP", 2)
    split = spark.createDataFrame([(1, ["a", "c"])], "doc_id long, words array<string>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, idx int")
    got = K.coded_tokens(split, vocab, "doc_id")
    assert "Exchange" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1, [1, 3], [1, 3])]


def plain_dictionary(rows):
    """``{word: (n, least begin + place)}`` of rows ``(begin, words)``."""
    found = {}
    for begin, words in rows:
        for at, w in enumerate(words or []):
            n, first = found.get(w, (0, begin + at))
            found[w] = (n + 1, min(first, begin + at))
    return found


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_words_are_counted_in_bounded_parts(monkeypatch, most):
    """Repeated begins, begins that fall, texts without words, an empty batch."""
    monkeypatch.setattr(K, "COUNTED_WORDS", most)
    rows = [(50, ["b", "a", "b"]), (50, ["a"]), (10, ["c", "b"]), (-10 ** 29, ["z"] * 4 + ["a"]), (7, []), (10 ** 28, ["b", "y"]), (3, ["d", "e", "f"])]
    kind = pa.schema([("begin", pa.decimal128(31, 0)), ("words", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([{"begin": Decimal(b), "words": w} for b, w in part], kind)
               for part in (rows[:3], [], rows[3:5], rows[4:5], rows[5:])]
    found = {}
    for batch in K._counted(iter(batches)):
        for r in batch.to_pylist():
            n, first = found.get(r["word"], (0, r["first"]))
            found[r["word"]] = (n + r["n"], min(first, int(r["first"])))
    assert found == plain_dictionary([*rows[:5], rows[4], *rows[5:]])


def test_dictionary_of_null_and_repeated_ids(spark):
    rows = [(5, ["b", "a"]), (5, ["a"]), (None, ["a", "c"]), (2, None), (3, []), (1, ["c", "b"])]
    split = spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    got = {r["word"]: (r["n"], int(r["first"])) for r in K.word_dictionary(split, "id").collect()}
    assert got == plain_dictionary([((-10 ** 19 if i is None else i) * 10 ** 10, w) for i, w in rows])


def test_largest_keeps_ties_and_no_more(spark):
    df = spark.createDataFrame([(w, n) for w, n in zip("abcdefg", [9, 5, 5, 5, 2, 1, 1], strict=True)], "word string, n long")
    for limit, want in ((1, "a"), (2, "abcd"), (4, "abcd"), (5, "abcde"), (6, "abcdefg"), (100, "abcdefg")):
        assert "".join(sorted(r["word"] for r in largest(df, "n", limit).collect())) == want
    assert largest(df.filter("n > 9"), "n", 3).count() == 0


def test_vocabulary_writes_no_texts(spark, tmp_path):
    """A query on the vocabulary alone writes neither cleaned nor split texts."""
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert text_queries.embedding_stats(spark, str(tmp_path)).count() == 1
    assert staged("dictionary", str(tmp_path), spark) is not None
    assert staged("cleaned", str(tmp_path), spark) is None and staged("split", str(tmp_path), spark) is None
