"""Queries on text: cleaning, vocabulary, sequences, new words, word vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.functions import text as T
from keyfold.operators import tokens as K
from keyfold.operators import vocabulary as V
from keyfold.registry.base import query, r6, staged, staged_once
from keyfold.session import new_stage_path, spread, write_stage
from keyfold.sources.files import read_vectors, write_vectors
from keyfold.sources.items import read_table

_SPACE = r"[\s\x0b\x1c-\x1f\x85\pZ]+"
_CLEAN = (f"trim(regexp_replace(regexp_replace(lower(text), '{T.SYMBOLS}', '', 'g'), '{_SPACE}', ' ', 'g'))")


def _words(text):
    return (f"list_filter(string_split(trim(regexp_replace({text}, '{_SPACE}', ' ', 'g')), ' '), "
            "lambda w: w <> '')")


_PUNCTUATION = "'" + T.VOCABULARY_FILTER.rstrip("\t\n") + "' || chr(9) || chr(10)"
_VOCABULARY_WORDS = (f"list_filter(string_split(translate(lower(clean), {_PUNCTUATION}, "
                     f"'{' ' * len(T.VOCABULARY_FILTER)}'), ' '), lambda w: w <> '')")
_CLEANED = f"cleaned AS (SELECT doc_id, lang, coalesce({_CLEAN}, '{T.BAD_TEXT}') AS clean FROM documents)"
_RAW = f"raw AS (SELECT doc_id, lang, {_words('clean')} AS ws FROM cleaned)"
_TOKENS = (f"lists AS (SELECT doc_id, lang, {_VOCABULARY_WORDS} AS ws FROM cleaned),\n"
           "tokens AS (SELECT doc_id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM lists)")
_VOCABULARY = (
    "num AS (SELECT least(100000, count(DISTINCT word)) AS n FROM (SELECT unnest(ws) AS word FROM raw)),\n"
    "counted AS (SELECT word, count(*) AS n, min(doc_id * 10000000 + place) AS first_met FROM tokens GROUP BY word),\n"
    "ranked AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, first_met) AS INTEGER) AS idx, n FROM counted),\n"
    "vocab AS (SELECT * FROM ranked WHERE idx < (SELECT n FROM num))")
_TEXT_CTES = f"WITH {_CLEANED},\n{_RAW},\n{_TOKENS},\n{_VOCABULARY}"
# Word-vector tables: each has the words of all documents but a fiftieth, by a hash of the word.
_TABLES = [0, 1, 2]
_NEW_WORDS = "fresh AS (" + " UNION ".join(
    "SELECT word FROM vocab WHERE word NOT IN (SELECT word FROM tokens WHERE "
    f"CAST('0x' || substr(md5(word), 1, 6) AS INTEGER) % 50 <> {x})" for x in _TABLES) + ")"
_SEQUENCES = (
    "seqs AS (SELECT d.doc_id, coalesce(s.sequence, []::INTEGER[]) AS sequence FROM documents d LEFT JOIN "
    "(SELECT t.doc_id, list(v.idx ORDER BY t.place) AS sequence FROM tokens t JOIN vocab v USING (word) "
    "GROUP BY t.doc_id) s ON d.doc_id = s.doc_id)")


def cleaned(spark, sf_dir):
    """Documents with cleaned text, written once."""
    return staged_once("cleaned", sf_dir, spark, lambda: _cleaned_view(spark, sf_dir))


def _cleaned_view(spark, sf_dir):
    """Texts are cleaned where they lie; only those of fewer files than cores are dealt out first."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    if len(documents.inputFiles()) < spark.sparkContext.defaultParallelism:
        documents = spread(documents, "doc_id")
    return documents.select("doc_id", "lang", T.clean("text").alias("clean"))


def _split_view(spark, sf_dir):
    found = staged("cleaned", sf_dir, spark)
    return K.split_texts(_cleaned_view(spark, sf_dir) if found is None else found, "clean", "doc_id")


def split(spark, sf_dir):
    """The words of all documents, split once: dictionary and coded tokens read them."""
    return staged_once("split", sf_dir, spark, lambda: _split_view(spark, sf_dir))


def dictionary(spark, sf_dir):
    """Of the split texts, if they are written; a query that needs nothing else of them does not write them."""
    def build():
        found = staged("split", sf_dir, spark)
        return K.word_dictionary(_split_view(spark, sf_dir) if found is None else found, "doc_id")
    return staged_once("dictionary", sf_dir, spark, build)


def vocabulary(spark, sf_dir):
    """Saved once, and read by all that need word numbers."""
    return staged_once("vocabulary", sf_dir, spark, lambda: K.vocabulary_of(
        dictionary(spark, sf_dir), T.VOCABULARY_CAP))


def coded(spark, sf_dir):
    """Documents as word numbers: sequences and rates are read off them."""
    return staged_once("coded", sf_dir, spark, lambda: K.coded_tokens(
        split(spark, sf_dir), vocabulary(spark, sf_dir), "doc_id"))


def sequences(spark, sf_dir):
    return coded(spark, sf_dir).select("doc_id", "sequence")


def document_words(spark, sf_dir):
    return staged_once("words", sf_dir, spark, lambda: dictionary(spark, sf_dir).select(
        F.explode(T.vocabulary_words("word")).alias("word")).distinct())


def vector_words(spark, sf_dir, table):
    number = F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("bigint")
    return document_words(spark, sf_dir).filter(number % 50 != table)


def fresh_words(spark, sf_dir):
    return V.new_words(vocabulary(spark, sf_dir), [vector_words(spark, sf_dir, x) for x in _TABLES])


@query("text_clean", f"WITH {_CLEANED} SELECT doc_id, clean FROM cleaned")
def text_clean(spark, sf_dir):
    return cleaned(spark, sf_dir).select("doc_id", "clean")


# A stop-word list is the caller's to give; this one serves the query.
STOPWORDS = ["a", "and", "de", "der", "die", "el", "in", "la", "le", "of", "the", "to", "und", "y"]


@query("stopword_remove", f"WITH {_CLEANED}, {_RAW} SELECT doc_id, array_to_string(list_filter(ws, lambda w: w NOT IN "
       f"({', '.join(repr(w) for w in STOPWORDS)})), ' ') AS kept FROM raw")
def stopword_remove(spark, sf_dir):
    return cleaned(spark, sf_dir).select("doc_id", T.remove_stopwords("clean", STOPWORDS).alias("kept"))


@query("word_count", f"WITH {_CLEANED}, {_RAW} SELECT word, count(*) AS n FROM "
                     "(SELECT unnest(ws) AS word FROM raw) GROUP BY word")
def word_count(spark, sf_dir):
    return dictionary(spark, sf_dir).select("word", "n")


@query("vocab_topn", f"{_TEXT_CTES} SELECT word, idx, n FROM vocab")
def vocab_topn(spark, sf_dir):
    return vocabulary(spark, sf_dir)


@query("text_to_sequence", f"{_TEXT_CTES},\n{_SEQUENCES} SELECT doc_id, sequence FROM seqs")
def text_to_sequence(spark, sf_dir):
    return sequences(spark, sf_dir)


@query("pad_sequence", f"{_TEXT_CTES},\n{_SEQUENCES} SELECT doc_id, CASE WHEN len(sequence) >= 300 "
       "THEN list_slice(sequence, len(sequence) - 299, len(sequence)) ELSE "
       "list_concat(list_transform(range(300 - len(sequence)), lambda x: 0::INTEGER), sequence) END AS padded FROM seqs")
def pad_sequence(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", T.pad_front("sequence", T.SEQUENCE_LENGTH).alias("padded"))


@query("new_words", f"{_TEXT_CTES},\n{_NEW_WORDS} SELECT word FROM fresh")
def new_words(spark, sf_dir):
    return fresh_words(spark, sf_dir)


@query("oov_rate", f"{_TEXT_CTES},\n{_NEW_WORDS}\nSELECT r.doc_id, CASE WHEN len(r.ws) = 0 THEN 1.0::DOUBLE ELSE "
       "round(coalesce(c.n, 0) / len(r.ws), 6) END AS uq_rate FROM raw r LEFT JOIN (SELECT doc_id, count(*) AS n FROM "
       "(SELECT doc_id, unnest(ws) AS word FROM raw) WHERE word IN (SELECT word FROM fresh) GROUP BY doc_id) c "
       "ON r.doc_id = c.doc_id")
def oov_rate(spark, sf_dir):
    fresh = vocabulary(spark, sf_dir).join(fresh_words(spark, sf_dir), "word").select("idx")
    rates = K.marked_rate(coded(spark, sf_dir), "doc_id", write_stage(fresh, "new_words"))
    return rates.select("doc_id", F.round("uq_rate", 6).alias("uq_rate"))


@query("vocab_reload", f"{_TEXT_CTES},\n{_SEQUENCES} SELECT doc_id, list_reverse(sequence) AS sequence FROM seqs")
def vocab_reload(spark, sf_dir):
    """Sequences of other texts, here the same words backwards, under a vocabulary saved and read again."""
    path = new_stage_path(spark, "saved_vocabulary")
    V.save_vocabulary(vocabulary(spark, sf_dir), path)
    backwards = cleaned(spark, sf_dir).select("doc_id", F.array_join(
        F.reverse(T.vocabulary_words("clean")), " ").alias("clean"))
    return V.text_to_sequence(backwards, "clean", "doc_id", V.load_vocabulary(spark, path))


# --- word vectors ---------------------------------------------------------------------------------
# The given vectors, under the words of the same number.
_VECTORS = "vectors AS (SELECT v.word, e.embedding AS vector FROM embeddings e JOIN vocab v ON v.idx = e.vec_id + 1)"
# Fixed value: length of the given vectors.
VECTOR_SIZE = 64


def vector_file(spark, sf_dir):
    """The given vectors, written as text lines of word and values and read from there."""
    words = vocabulary(spark, sf_dir).join(
        read_table(spark, sf_dir, "embeddings"), F.col("idx") == F.col("vec_id") + 1)
    path = new_stage_path(spark, "vectors")
    write_vectors(words.select("word", F.col("embedding").alias("vector")), path)
    return read_vectors(spark, path)


@query("embedding_load", f"{_TEXT_CTES},\n{_VECTORS} SELECT word, vector FROM vectors")
def embedding_load(spark, sf_dir):
    return vector_file(spark, sf_dir)


@query("embedding_stats", f"{_TEXT_CTES},\n{_VECTORS} SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std "
       "FROM (SELECT CAST(unnest(vector) AS DOUBLE) AS v FROM vectors)")
def embedding_stats(spark, sf_dir):
    return V.vector_stats(vector_file(spark, sf_dir), VECTOR_SIZE).select(r6("mean"), r6("std"))


@query("embedding_lookup", f"{_TEXT_CTES},\n{_VECTORS} SELECT v.word, v.idx, x.vector IS NULL AS is_new, "
       f"coalesce(len(x.vector), {VECTOR_SIZE}) AS size, x.vector FROM vocab v LEFT JOIN vectors x USING (word)")
def embedding_lookup(spark, sf_dir):
    """A word without a vector has random values, which are left out here; a test looks at them."""
    vectors = write_stage(vector_file(spark, sf_dir), "vectors")
    stats = V.vector_stats(vectors, VECTOR_SIZE).first()
    found = V.attach_vectors(vocabulary(spark, sf_dir), vectors, VECTOR_SIZE, stats["mean"], stats["std"])
    return found.select("word", "idx", "is_new", F.size("vector").cast("bigint").alias("size"),
                        F.when(~F.col("is_new"), F.col("vector")).alias("vector"))
