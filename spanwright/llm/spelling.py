"""Spelling variants: frequent words within one edit of each other, by a positional q-gram index with a count filter.

1. Runs of letters are counted over all documents by built-in functions; rare forms go before words meet.
2. Words meet by what one edit leaves alone. Cut a word in two, and one of the halves stays as it is, in its place: words
   that share a half, its position and the length meet in a group, as do words one letter longer whose other half
   holds the further letter. A group of more than `GROUP` words is cut again inside the half that is still open, for the same
   reason without loss, down to one open letter, where the alphabet bounds it. A frequent half so costs a few rows a word, not pairs.
3. In a group, the q-grams that touch the open part are postings by gram and position. A word's lists, those of its grams at
   the same place or, for a longer word, one place before, are merged by a heap; the words met as often as one edit must leave
   grams in common are verified letter by letter.
4. The near word of largest count is a word's form if it is frequent enough; roots follow forms by pointer doubling.

Defined results: a null text has no words; a null id reads as an empty one where runs are altered; repeated rows count each;
an empty table gives an empty result; other columns are ignored. Ties go to the smaller word in code-point order.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import merge
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import checkpointed, no_text, table

LETTERS, UPPER = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Least code points and occurrences of a word, and how many times its own count a form has.
LEAST, OFTEN, RATIO = 6, 5, 5
Q, GROUP = 2, 256
#: Pairs that a task hands on at once.
ROWS = 20_000


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, run): each maximal run of letters, only A to Z lower-cased."""
    each = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(no_text(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    plain = F.when(F.col("run") == F.lower("run"), F.col("run")).otherwise(F.translate("run", UPPER, UPPER.lower()))
    return each.filter(F.length("run") >= LEAST).select("id", plain.alias("run"))


def altered(every: int) -> Column:
    """The run, without one of its code points where the checksum of id and run says so."""
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))


def word_counts(words: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)


def _halved(rows: DataFrame) -> DataFrame:
    """Rows with an open part [lo, hi) of `size` letters, cut in two; a longer word has one more letter in it."""
    half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.col("lo").alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("hi").alias("hi"))))
    cut = rows.withColumn("part", parts).select("word", "n", "longer", "size", "part.lo", "part.hi")
    tail = F.col("hi") + F.when(F.col("longer"), 2).otherwise(1)
    kept = F.xxhash64("size", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), tail, F.length("word")))
    return cut.withColumn("key", kept)


def groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(key, word, n, longer, lo, hi): two words within one edit share a key; a key has at most `most` words or one open letter."""
    role = F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")
    size = (F.length("word") - F.col("longer").cast("int")).alias("size")
    rows = words.select("word", "n", role).select("*", size, F.lit(0).alias("lo"), size.alias("hi")).filter(F.col("size") >= LEAST)
    done = None
    while True:
        keyed = _halved(rows)
        met = keyed.groupBy("key").agg(F.count("*").alias("all")).filter("all > 1")
        placed = checkpointed(keyed.join(met, "key"))
        closed = (F.col("all") <= most) | (F.col("hi") - F.col("lo") <= 1)
        some = placed.filter(closed).select("key", "word", "n", "longer", "lo", "hi")
        done = some if done is None else done.unionByName(some)
        rows = placed.filter(~closed)
        if rows.isEmpty():
            return done


def one_edit(a: str, b: str) -> bool:
    """Exactly one letter replaced, or further in `b`."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and a[i + 1 if len(a) == len(b) else i :] == b[i + 1 :]


def near_pairs(group: list[tuple]):
    """Pairs (a, b, n of a, n of b) within one edit of a group's rows (key, word, n, longer, lo, hi)."""
    lo, hi = group[0][4:6]
    index = [(w, n) for _, w, n, longer, *_ in group if not longer]
    postings = defaultdict(list)
    for i, (w, _) in enumerate(index):
        for p in range(max(0, lo - Q + 1), min(hi, len(w) - Q + 1)):
            postings[w[p : p + Q], p].append(i)
    for at, (_, w, n, longer, *_) in enumerate(group):
        places = range(max(0, lo - Q + 1), min(hi + longer, len(w) - Q + 1))
        # grams of the shared parts are common anyway, and one edit changes at most Q of the others
        bound = len(places) - Q
        if bound > 0:
            lists = [found for p in places for back in range(1 + longer) if (found := postings.get((w[p : p + Q], p - back)))]
            met = [i for i, same in groupby(merge(*lists)) if sum(1 for _ in same) >= bound] if len(lists) >= bound else []
        else:
            met = range(len(index))
        for i in met:
            other, m = index[i]
            if (longer or other < w) and one_edit(other, w):
                yield other, w, m, n


def _near(batches):
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6))))
    found: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["a", "b", "na", "nb"])
    for _, group in groupby(rows, key=itemgetter(0, 4, 5)):
        found += near_pairs(list(group))
        if len(found) >= ROWS:
            yield batch()
            found = []
    yield batch()


def near_words(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(a, b, na, nb) of words (word, n) that differ by one edit, each pair once."""
    dealt = groups(words, most).repartition("key").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(_near, "a string, b string, na long, nb long").dropDuplicates(["a", "b"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last word that forms lead to. Counts grow along forms, so they end."""
    known = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = checkpointed(known.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        known = new.drop("moved")
        if new.filter("moved").isEmpty():
            return known


def variants(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each once."""
    words = checkpointed(words)
    pairs = checkpointed(near_words(words, most))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "near")).alias("best"))
    enough = -F.col("best.minus") >= RATIO * F.col("n")
    seen = checkpointed(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    last = roots(seen.filter("form IS NOT NULL"))
    return seen.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    every = runs(table(spark, sf_dir, "documents"))
    return variants(word_counts(every.select(altered(199).alias("word"))))


#: The checksum byte by byte: its table follows from the polynomial 0xEDB88320.
SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s, hex(encode(s)) AS x FROM runs),
sums AS (SELECT doc_id, run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, (2 * k + 1)::INT, 2))::BIGINT)),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM sums)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM gaps a JOIN gaps b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
         UNION SELECT DISTINCT a.word, b.word, b.n FROM gaps a JOIN words b ON a.less = b.word
         UNION SELECT DISTINCT b.word, a.word, a.n FROM gaps a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM near GROUP BY word),
seen AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN near END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS last, 0 AS depth FROM seen UNION ALL SELECT c.word, s.form, depth + 1 FROM c JOIN seen s ON c.last = s.word WHERE s.form IS NOT NULL) SELECT word, arg_max(last, depth) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM seen JOIN chain USING (word)
"""
