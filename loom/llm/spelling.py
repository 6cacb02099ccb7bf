"""Spelling variants: words one edit apart, found by a rare-first q-gram prefix filter.

One edit touches at most two of a word's bigrams. So of the three bigrams of a word that are rarest in the vocabulary (bigrams
are ordered once, by frequency), at least one is also among the three of any word one edit away, at the same place or, if that word
is longer by one code point, one place further. Words are joined by such a bigram, its place and their length, and candidates are verified.

A bigram, place and length that more than CROWD rows share is split further, exactly, before anything is joined: first by half
words (an edit leaves the first half or the rest as it is), then, where these are crowded too, by the whole word but for each
one code point in turn. A group of the last kind holds words that differ in one place only, so it is no larger than the alphabet,
and its pairs are links; no key's square of candidates is ever made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loom.llm.common import named, table, text_of, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]+"
RARE = 3  # one more than the bigrams that one edit touches
CROWD = 256


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_chars: int = 6, least_n: int = 5) -> DataFrame:
    """word, n (long): runs of letters with A-Z lower-cased, of which those whose crc32 of `<id>:<run>` is divisible by `every` lose
    the code point at that crc32 modulo their length; with at least `least_chars` code points and `least_n` occurrences.

    Defined cases: a null or empty text has no words; a null id counts as an empty string; repeated rows count each."""
    run = F.col("run")
    # all of a run is ASCII if it has as many bytes as code points: then lower() is the same and faster
    lowered = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    runs = docs.select(F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(text_col), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_chars).select("id", lowered.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(h % every == 0, cut).otherwise(run).alias("word"))
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def rare_bigrams(words: DataFrame) -> DataFrame:
    """words with g and at: a row for each of the RARE bigrams of the word that come first in the order by frequency, and their places."""
    # letters once, as a place in a string is found by counting from its beginning
    pairs = F.transform(F.slice("letters", F.lit(1), F.size("letters") - 1), lambda x, i: F.struct(F.concat(x, F.get("letters", i + 1)).alias("g"), (i + 1).alias("at")))
    grams = words.filter(F.length("word") >= 2).withColumn("letters", F.split("word", "")).select(*words.columns, F.inline(pairs))
    order = grams.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    # as many rows as pairs of letters there are: 90 by 90 in this alphabet
    ranked = grams.join(F.broadcast(order), "g").groupBy("word", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "g", "at"))), 1, RARE).alias("rare"))
    return ranked.select("word", "n", F.inline("rare")).drop("often")


def sides(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, word, n, longer, short) of the words as the shorter or equal one of a pair, and as the longer or equal one; `short` is
    the length of the pair's shorter word."""
    size = F.length("word")
    key = lambda at, short: F.struct(F.col("g"), at.alias("at"), short.alias("short"))
    left = grams.select(key(F.col("at"), size).alias("key"), "word", "n", F.lit(False).alias("longer"), size.alias("short"))
    as_long = F.array(
        F.struct(F.col("at").alias("at"), size.alias("short"), F.lit(False).alias("longer")),
        F.struct(F.col("at").alias("at"), (size - 1).alias("short"), F.lit(True).alias("longer")),
        F.struct((F.col("at") - 1).alias("at"), (size - 1).alias("short"), F.lit(True).alias("longer")),
    )
    right = grams.select("word", "n", "g", F.inline(as_long)).filter("at > 0")
    return left, right.select(key(F.col("at"), F.col("short")).alias("key"), "word", "n", "longer", "short")


def halves(rows: DataFrame) -> DataFrame:
    """The rows, twice, by their key and the first half or the rest of the word, as the pair's shorter word has them."""
    half = F.floor(F.col("short") / 2).cast("int")
    both = F.array(F.struct(F.lit("a").alias("side"), F.substr("word", F.lit(1), half).alias("of")), F.struct(F.lit("z").alias("side"), F.right("word", F.col("short") - half).alias("of")))
    return rows.select("key", "word", "n", "longer", "short", F.inline(both)).select(F.struct("key", "side", "of").alias("key"), "word", "n", "longer", "short")


def masked(rows: DataFrame, right: bool) -> DataFrame:
    """The words, by what is left of them without each one code point: for words of one length with its place, for a longer word
    without. The shorter word of two lengths is whole."""
    size = F.length("word")
    without = lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1))
    rows = rows.select("word", "n", "longer", "short").distinct()
    equal = rows.filter(~F.col("longer")).select("*", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    equal = equal.select(F.struct(F.col("at"), without(F.col("at")).alias("of")).alias("key"), "word", "n", "longer", "short")
    if right:
        other = rows.filter("longer").select("*", F.explode(F.sequence(F.lit(1), size)).alias("at")).select(without(F.col("at")).alias("of"), "word", "n", "longer", "short").distinct()
    else:
        other = rows.select(F.col("word").alias("of"), "word", "n", "longer", "short")
    return equal.unionByName(other.select(F.struct(F.lit(0).alias("at"), "of").alias("key"), "word", "n", "longer", "short"))


def joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Verified pairs of words: a, a_n, b, b_n."""
    a = left.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = right.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    near = F.expr("levenshtein(a, b, 1)") == 1
    return a.join(b, "key").filter((F.col("longer") | (F.col("a") < F.col("b"))) & near).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs of words (of at least 6 code points, with n) exactly one edit apart, each once: a, a_n, b, b_n."""
    left, right = sides(written(rare_bigrams(words), "spelling-grams"))
    found = []
    for finer in (lambda rows, _: halves(rows), masked, None):
        if finer is None:  # groups of at most an alphabet
            found.append(joined(left, right))
            break
        counts = left.select("key").unionByName(right.select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        hot = written(counts.filter(F.col("rows") > crowd).select("key"), "spelling-crowds")
        if hot.isEmpty():
            found.append(joined(left, right))
            break
        found.append(joined(left.join(hot, "key", "left_anti"), right.join(hot, "key", "left_anti")))
        left, right = (written(finer(rows.join(hot, "key", "left_semi"), i), "spelling-finer") for i, rows in enumerate((left, right)))
    return reduce(DataFrame.unionByName, found).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows (word, form): forms followed to their end by doubling. No form leads back to its word."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 5, crowd: int = CROWD, **counted) -> DataFrame:
    """One row a word: word, n, form (its near word of largest n, ties to the smallest in code-point order, if that n is at least
    `ratio` times its own), root (forms followed to the end; the word itself if it has none), n_near, form_n.

    Words are those of `word_counts`, near ones exactly one inserted, deleted or replaced code point apart.

    Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count each; a text that is
    one very long word is a word like others; an empty table gives an empty one; other columns play no part.
    """
    words = written(word_counts(docs, id_col, text_col, **counted), "spelling-words")
    pairs = written(near_pairs(words, crowd), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    has_form = -F.col("best.m") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.other")).alias("form"), F.when(has_form, -F.col("best.m")).alias("form_n"),
    )
    rows = written(rows, "spelling-forms")
    ends = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: DuckDB has no crc32: its table comes from its rule, its state runs over the UTF-8 bytes.
ORACLE = r"""
WITH RECURSIVE
bits(i, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
t AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT doc_id, translate(u.run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM documents, LATERAL (SELECT unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run) u WHERE length(u.run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM runs),
crc AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(b, lambda x: CAST(x AS BIGINT)),
    lambda c, x: xor(c // 256, t[CAST(xor(c, x) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM bytes, t),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM crc)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS c, i FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i) p),
pairs AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM cuts a JOIN cuts b ON a.c = b.c AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.c = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.c = b.word),
near AS (SELECT x, count(*) AS n_near, arg_min(y, (-m, y)) AS y, max(m) AS m FROM pairs GROUP BY x),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN y END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN near ON word = x),
chain(word, last, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.form, c.last AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
