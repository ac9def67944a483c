"""Spelling variants of words, found with PartEnum signatures.

Words are the maximal runs of Latin letters of whole texts. Their multisets of
letters, seen as binary vectors over (letter, how many-th), differ in at most two
places when one inserted, deleted or replaced letter makes one word of the other.
PartEnum finds all pairs of vectors at a Hamming distance of at most two by equality
alone: the letters are dealt into ``PARTS`` partitions, and vectors that differ in
two places at most agree on all partitions but one or two. A word has a signature,
made of its letters in all the others, for every one and every two partitions left
out, together with how many letters it has in those. One side of the join gives the
numbers of its own, the other those of a word one edit away:

- one partition left out and the same number: a letter replaced by one of its partition
  (met from both sides, so taken once, the smaller word first);
- one left out and one letter more: a letter inserted;
- two left out, one letter more in the first and one less in the second: a letter
  replaced by one of another partition.

So a near pair meets in exactly one signature. The join's own condition verifies the
edit distance, so pairs that are not near never leave it.

The letters are dealt by how often the vocabulary holds them, so that each partition
tells words apart about equally well. Everything is DataFrame functions: runs are
exploded in the tasks that read the texts and counted before the shuffle; the
vocabulary and the pairs are written to the shared folder. A signature that very many
words share is a skewed key of an inner join, which adaptive execution splits.

A word's form is its most frequent near word that occurs at least twice as often
(ties: the smallest in code-point order). Counts double at least from a word to its
form, so the chains that are followed to the root are short and have no circles; they
are followed by pointer doubling.

Null and empty texts hold no words, and a null id counts as an empty text where the
id is hashed. Repeated rows each count. An empty table gives no rows. Texts and
words of any length are read whole. Other columns are not read.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_dir

# Fixed values of the task.
RUN = "[A-Za-zÀ-ÿ]+"
TYPO_EVERY = 97
MIN_LETTERS, MIN_COUNT, FORM_RATIO = 5, 3, 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = 5


def occurrences(docs: DataFrame, typo_every: int | None = TYPO_EVERY) -> DataFrame:
    """One row (word) for every run of letters; one in ``typo_every`` of the pairs of id and run loses a letter."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), 0)).alias("run"))
    # Where all letters are ASCII, lower() folds A-Z alone, and is the faster.
    ascii_only = F.octet_length("run") == F.length("run")
    runs = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    if typo_every is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(
        F.when(F.col("h") % typo_every == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of the words that are long and frequent enough."""
    return (words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def letter_parts(vocab: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of each partition; the collected table has a row for each letter of the alphabet."""
    letters = (vocab.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter")
               .agg(F.count("*").alias("n")).collect())
    dealt = [(0, p, "") for p in range(parts)]
    for row in sorted(letters, key=lambda r: (-r.n, r.letter)):
        total, p, held = min(dealt)
        dealt[p] = (total + row.n, p, held + row.letter)
    return [held for _, _, held in dealt]


def signatures(vocab: DataFrame, letters: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join: (key, word, n) and (key, ordered, word, n); ``ordered`` keys meet from both sides."""
    held = [F.translate("word", "".join(x for j, x in enumerate(letters) if j != i), "") for i in range(len(letters))]
    hashed = vocab.select(
        "word", "n", *(F.length(x).alias(f"size{i}") for i, x in enumerate(held)),
        *(F.xxhash64(F.array_sort(F.split(x, ""))).alias(f"h{i}") for i, x in enumerate(held)))

    def key(out: tuple[int, ...], *sizes: Column) -> Column:
        return F.xxhash64(*map(F.lit, out), *(f"h{i}" for i in range(len(letters)) if i not in out), *sizes)

    left, right = [], []
    for p in range(len(letters)):
        size = F.col(f"size{p}")
        left.append(F.struct(key((p,), size).alias("key")))
        right += [F.struct(key((p,), size).alias("key"), F.lit(True).alias("ordered")),
                  F.struct(key((p,), size - 1).alias("key"), F.lit(False).alias("ordered"))]
    for p, q in combinations(range(len(letters)), 2):
        sizes = F.col(f"size{p}"), F.col(f"size{q}")
        left.append(F.struct(key((p, q), *sizes).alias("key")))
        right.append(F.struct(key((p, q), sizes[0] + 1, sizes[1] - 1).alias("key"), F.lit(False).alias("ordered")))
    return tuple(hashed.select("word", "n", F.explode(F.array(*side)).alias("s")).select("s.*", "word", "n")
                 for side in (left, right))


def near_pairs(vocab: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, b (with na, nb) of the words one edit apart, each pair once."""
    left, right = signatures(vocab, letter_parts(vocab, parts))
    left = left.select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    right = right.select("key", "ordered", F.col("word").alias("b"), F.col("n").alias("nb"))
    on = ((F.col("l.key") == F.col("r.key")) & (~F.col("ordered") | (F.col("a") < F.col("b")))
          & (F.levenshtein("a", "b", 1) == 1))
    return left.alias("l").join(right.alias("r"), on).select("a", "na", "b", "nb")


def forms(pairs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, n_near, and form and form_n (null where no near word is frequent enough) of the words with near ones."""
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m"))
    both = both.union(pairs.select("b", "nb", "a", "na"))
    # The least of (-m, other) is a partial aggregate: a word near very many others is combined before the shuffle.
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"),
                                         F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    held = -F.col("best.m") >= ratio * F.col("n")
    return best.select("word", "n_near", F.when(held, F.col("best.other")).alias("form"),
                       F.when(held, -F.col("best.m")).alias("form_n"))


def roots(linked: DataFrame, folder: str) -> DataFrame:
    """word and root of the words of ``linked`` (word, form), by pointer doubling."""
    steps = linked.select("word", F.col("form").alias("root"))
    for step in range(64):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        ).write.parquet(f"{folder}/roots-{step}")
        written = linked.sparkSession.read.parquet(f"{folder}/roots-{step}")
        steps = written.select("word", "root")
        if written.where("moved").isEmpty():
            return steps
    raise RuntimeError("a chain of forms has no end")


def spelling_variants(docs: DataFrame, typo_every: int | None = TYPO_EVERY, min_letters: int = MIN_LETTERS,
                      min_count: int = MIN_COUNT, ratio: int = FORM_RATIO, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/spelling-{uuid.uuid4().hex}"
    vocabulary(occurrences(docs, typo_every), min_letters, min_count).write.parquet(f"{folder}/words")
    vocab = spark.read.parquet(f"{folder}/words")
    forms(near_pairs(vocab, parts), ratio).write.parquet(f"{folder}/forms")
    found = spark.read.parquet(f"{folder}/forms")
    ends = roots(found.where("form IS NOT NULL"), folder)
    return vocab.join(found, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


# The unsigned crc32 of a text, by a table that SQL makes of the polynomial; words one edit apart agree when the
# same place is struck out of both, or one place out of the longer.
CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(9), lambda c, k:
    CASE WHEN k = 0 THEN i WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i)) AS t)"""


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned crc32 of the SQL expression ``text``; needs CRC_TABLE in scope as ``crc_table``."""
    return f"""xor(list_reduce(
      list_transform(range(strlen({text})), lambda j: ('0x' || substr(hex(encode({text})), (2 * j + 1)::INT, 2))::BIGINT),
      lambda c, b: xor(t[xor(c % 256, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"""


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run
    FROM documents)
  GROUP BY id, run),
hashed AS (
  SELECT run, times, {crc32_sql("(id || ':' || run)")} AS h FROM runs, crc_table),
changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
         ELSE run END AS word, times FROM hashed),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
struck AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM struck a JOIN struck b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM struck a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM struck a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form,
         CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
steps AS (
  SELECT word, word AS at_word, form AS next FROM formed
  UNION ALL
  SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON f.word = s.next)
SELECT f.word, f.form, s.at_word AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN steps s ON s.word = f.word AND s.next IS NULL
"""
