"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words that are one inserted, deleted or replaced code point apart share one of the three rarest bigrams of
each, since an edit touches two bigrams at most.  Bigrams are put in one order for all words, rarest first,
with their places; of a word the first three take part, and with the third all its other places, so that no
order among equal bigrams can part two words.  A shared bigram stands before or behind the edit.  Hence the
join: two words meet on all that one of these bigrams ends (their equal beginnings) or begins (their equal
endings), if their lengths differ by one at most, which limits its places to one apart.  Candidates are then
verified by their edit distance.  All steps are built-in expressions.

Counting is a map-side aggregation; no word, bigram or form gathers its rows in one task.  Bigrams are
broadcast: the alphabet has 90 characters after lower-casing, so there are 8,100 of them at most.  A form is
at least five times as frequent as its word, so chains of forms have fewer than 28 links for counts of 64
bits; they are followed by doubling.

Rows: null texts hold no words; a null doc_id counts as the empty string in what errs; repeated rows count
again; an empty table gives an empty table; other columns are not read.  Texts and words may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ERRS = 199  # one of so many runs loses a code point
LEAST, OFTEN = 6, 5  # code points and occurrences of a word
TIMES = 5  # a form is so many times as frequent
RARE = 3  # bigrams of a word that take part: two for an edit, and one


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts (word) and how often they occur (n), with one of ERRS runs misspelled."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    size = F.length("run")
    hashed = runs.filter(size >= LEAST).withColumn("h", F.crc32(F.concat_ws(":", "k", "run").cast("binary")))
    at = (F.col("h") % size).cast("int")
    errs = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    spelled = hashed.select(F.when(F.col("h") % ERRS == 0, errs).otherwise(F.col("run")).alias("word"))
    return spelled.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)


def near(known: DataFrame) -> DataFrame:
    """Pairs (word, n, other, other_n) of the words of a table (word, n) that one edit parts, each pair both ways."""
    grams = known.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")).withColumn("gram", F.substring(F.col("word"), F.col("at"), F.lit(2)))
    common = grams.groupBy("gram").agg(F.count("*").alias("f"))
    ranked = grams.join(F.broadcast(common), "gram").withColumn("r", F.rank().over(Window.partitionBy("word").orderBy("f", "gram")))
    begins = F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), F.col("at") + 1))
    ends = F.concat(F.lit(">"), F.substring(F.col("word"), F.col("at"), F.length("word")))
    keys = ranked.filter(F.col("r") <= RARE).select("word", "n", F.explode(F.array(begins, ends)).alias("key"))
    keys = keys.withColumn("size", F.length("word"))
    a, b = keys.alias("a"), keys.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.abs(F.col("a.size") - F.col("b.size")) <= 1) & (F.col("a.word") < F.col("b.word")))
    one = met.filter(F.levenshtein("a.word", "b.word", 1) == 1)
    pairs = one.select(F.struct("a.word", "a.n").alias("x"), F.struct("b.word", "b.n").alias("y")).distinct()
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return both.select("p.x.word", "p.x.n", F.col("p.y.word").alias("other"), F.col("p.y.n").alias("other_n"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """The last form reached from each word of (word, form); ``longest``: links of the longest chain at most."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    done = 1
    while done < longest:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        done *= 2
    return at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word with its form, the root of its forms, n, the number of near words, and n of its form."""
    known = materialize(words(docs, key, text), "spelling-words")
    best = F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))
    found = materialize(near(known).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(best).alias("best")), "spelling-near")
    enough = -F.col("best.n") >= TIMES * F.col("n")
    forms = found.filter(enough).select("word", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))
    top = known.agg(F.max("n")).first()[0] or 0
    longest, n = 0, OFTEN
    while n * TIMES <= top:
        longest, n = longest + 1, n * TIMES
    ended = roots(forms, longest)
    out = known.join(found.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(ended, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Near words by the texts they leave when a code point is taken out, which is another way than the operator's.
SQL = rf"""
WITH RECURSIVE crc_bits AS (
  SELECT i AS b, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(octet_length(encode(k))), lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT *, concat(doc_id, ':', run) AS k FROM runs), crc),
known AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % {ERRS} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OFTEN}),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM known, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN known b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN known b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT k.word, k.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {TIMES} * k.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * k.n THEN other_n END AS form_n
  FROM known k LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON w.next = f.word)
SELECT f.word, form, w.at AS root, n, n_near, form_n FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""
