"""Cross-site boilerplate lines, found by the spread of a line over distinct sites; SQL functions only.

A scan gives every line that holds a word a 128-bit key of its lower-cased, blank-folded form, beside the site
and a key of the whole text. Keys of fewer lines than the threshold go first, by their exact counts. For
each of the others HyperLogLog sketches of its sites and of its texts are built in the tasks and merged by the
aggregation, so a line that stands in a third of all documents arrives as two sketches from each task. Keys
with an estimate near the threshold get both counted exactly; the rest are decided by the sketches. Lines that
spread over `min_sites` sites or more, in as many different texts, are removed from all documents. Counting
texts too keeps a page that was copied as a whole to many sites from passing for boilerplate: its copies are one
text, whatever their sites, and are left to near-duplicate removal.

Defined results: a null text stays null and has no lines; a null site counts for no line; a line without a
word is never removed; a document of widespread lines alone keeps an empty text; repeated rows are handled
alike; rows with the same or a null doc_id are handled each by its own text; an empty table gives an empty
result; further columns are kept by `remove_boilerplate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import as_row, checkpointed, no_text, table

MIN_SITES = 8
#: Estimates within this share of the threshold are settled by an exact count. Sketches of 2^12 registers
#: have a standard error of 1.6 %.
NEAR = 0.25
REGISTERS_LOG2 = 12
BLANKS = " \t\r\x0b\f"
#: Keys (of 16 bytes) that are broadcast; more of them are joined by shuffle, with each key dealt to `SALTS` tasks.
BROADCAST_KEYS, SALTS = 500_000, 16


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), r"[ \t\r\x0B\f]+", " "))))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _with_keys(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The `lines` of some distinct keys. Neither way brings all lines of a frequent key to one task."""
    if keys.count() <= BROADCAST_KEYS:
        return lines.join(F.broadcast(keys), "key", "left_semi")
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("id", "tk"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left_semi").drop("salt")


def widespread(lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """The keys of (key, site, tk) rows that stand on at least `min_sites` sites in as many texts."""
    frequent = checkpointed(lines.groupBy("key").count().filter(F.col("count") >= min_sites).select("key"))
    candidates = _with_keys(lines, frequent)
    sketched = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(REGISTERS_LOG2)))
    spread = candidates.groupBy("key").agg(F.least(sketched("site"), sketched("tk")).alias("least"))
    spread = checkpointed(spread.filter(F.col("least") >= min_sites * (1 - near)))
    sure = spread.filter(F.col("least") > min_sites * (1 + near)).select("key")
    close = spread.filter(F.col("least") <= min_sites * (1 + near)).select("key")
    counted = _with_keys(lines, close).groupBy("key").agg(F.countDistinct("site").alias("sites"), F.countDistinct("tk").alias("texts"))
    return sure.unionByName(counted.filter((F.col("sites") >= min_sites) & (F.col("texts") >= min_sites)).select("key"))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source", n_removed: str | None = None) -> DataFrame:
    """`docs` with its text rid of widespread lines; `n_removed` names a column for the number of lines that went."""
    keys = F.array_distinct(F.transform(F.filter(_lines(no_text(text)), _has_word), line_key))
    lines = checkpointed(docs.select(F.col(doc_id).alias("id"), F.col(site).alias("site"), _text_key(no_text(text)).alias("tk"), F.explode(keys).alias("key")))
    hits = _with_keys(lines, checkpointed(widespread(lines, min_sites))).groupBy("id", "tk").agg(F.collect_set("key").alias("__hit_lines"))
    hits = hits.select(F.col("id").alias("__hit_id"), F.col("tk").alias("__hit_tk"), "__hit_lines")
    body = F.col(f"__row.`{text}`")
    placed = docs.select(as_row(docs), F.col(doc_id).alias("__id"), _text_key(no_text(text)).alias("__tk"))
    joined = placed.join(hits, F.col("__id").eqNullSafe(F.col("__hit_id")) & (F.col("__tk") == F.col("__hit_tk")), "left")
    kept = F.filter(_lines(body), lambda x: ~(_has_word(x) & F.array_contains(F.col("__hit_lines"), line_key(x))))
    done = joined.withColumn("__kept", F.when(F.col("__hit_lines").isNotNull() & body.isNotNull(), kept))
    columns = [F.coalesce(F.array_join("__kept", "\n"), body).alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    removed = F.when(F.col("__kept").isNotNull(), F.size(_lines(body)) - F.size("__kept")).otherwise(0).cast("long")
    return done.select(*columns, *([removed.alias(n_removed)] if n_removed else []))


def op5_line_dedup(spark, sf_dir):
    return remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), n_removed="n_removed").select("doc_id", "text", "n_removed")


def sql(docs: str = "documents", columns: str = "doc_id, new_text AS text, n_removed::BIGINT AS n_removed") -> str:
    key = r"lower(regexp_replace(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), '[ \t\r\x0B\f]+', ' ', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
x AS (SELECT rid, source, md5(text) AS tk, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
k AS (SELECT rid, source, tk, pos, line, {key} AS key FROM x),
wide AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES} AND count(DISTINCT tk) >= {MIN_SITES}),
t AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM wide)) AS kept,
        count(*) FILTER (WHERE key IN (SELECT key FROM wide)) AS n FROM k GROUP BY rid),
r AS (SELECT d.*, CASE WHEN n > 0 THEN coalesce(kept, '') ELSE text END AS new_text, coalesce(n, 0) AS n_removed FROM d LEFT JOIN t USING (rid))
SELECT {columns} FROM r
"""
