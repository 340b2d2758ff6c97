"""Name search and text filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog.query import Query
from spanwright.functions import text as T
from spanwright.operators.search import reranked, search
from spanwright.sources.tables import table


def _names(spark, d):
    p = table(spark, d, "part")
    return p.select(F.format_string("p%06d", "p_partkey").alias("pid"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("alt_names"), "p_retailprice")


def _found(query, limit=25):
    return lambda spark, d: search(_names(spark, d), query, limit, F.col("p_retailprice"))


def search_rerank(spark, d):
    found = search(_names(spark, d), "ring", 40, F.col("p_retailprice")).withColumn("prior", F.col("pid"))
    sized = found.join(table(spark, d, "part").select(F.format_string("p%06d", "p_partkey").alias("pid"), "p_size"), "pid")
    return reranked(sized, "red ring", F.col("p_size") > 25).select("pid", "name", "tier")


def filter_words_or_year(spark, d):
    p = table(spark, d, "part")
    return p.filter(T.all_words_or_year(F.col("p_name"), F.col("p_size"), F.col("p_size") + 10, "r 30")).select("p_partkey", "p_name")


def text_contains(spark, d):
    """Rows that hold a key in a folded text, hits in the title first."""
    p, key = table(spark, d, "part"), "red"
    title, body = T.normalize_text(F.col("p_name")), T.normalize_text(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return p.filter(F.contains(body, F.lit(key))).select("p_partkey", F.contains(title, F.lit(key)).alias("in_title"), T.slug(F.col("p_name")).alias("slug"))


def term_inverted_index(spark, d):
    terms = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b(?:Apache|MIT|GNU|CC|License|licensed)\b"), F.lit(0)))
    docs = table(spark, d, "documents").select("doc_id", F.explode(terms).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def unique_match(spark, d):
    """Suppliers that exactly one customer of their nation can stand for: same sign and size class of the balance."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    bucket = lambda x: F.floor(x / 500)
    pairs = s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (bucket(F.col("s_acctbal")) == bucket(F.col("c_acctbal"))))
    return pairs.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("c_custkey")).filter("n = 1").select("s_suppkey", "c_custkey")


FOLDED = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
STOP = ", ".join(f"'{w}'" for w in T.DESIGNATORS)


def search_sql(query: str, limit: int) -> str:
    """Strict ranks in SQL; near matches by a pattern for each place of the one edit."""
    tokens = query.split(" ")
    words = " AND ".join(f"len(list_filter(string_split(key, ' '), lambda w: starts_with(w, '{t}'))) > 0" for t in tokens)
    loose = " AND ".join("len(list_filter(string_split(key, ' '), lambda w: " + " OR ".join(f"w LIKE '{p}'" for p in (T.near_variants(t) if T.typo_tolerant(t) else [t + "%"])) + ")) > 0" for t in tokens)
    return f"""WITH n AS (SELECT printf('p%06d', p_partkey) AS pid, p_name AS name, p_retailprice AS extent, [p_name, p_type, p_brand] AS raws FROM part),
      k AS (SELECT pid, pos, raw, {FOLDED.format("raw")} AS key FROM (SELECT pid, unnest(raws) AS raw, unnest([0, 1, 2]) AS pos FROM n)),
      u AS (SELECT pid, key, min(pos) AS pos, arg_min(raw, pos) AS raw FROM k WHERE key <> '' GROUP BY pid, key),
      c AS (SELECT *, array_to_string(list_filter(string_split(key, ' '), lambda w: w NOT IN ({STOP})), ' ') AS core FROM u),
      r AS (SELECT *, CASE WHEN key = '{query}' THEN 0 WHEN core = '{query}' AND core <> '' THEN 1 WHEN starts_with(key, '{query}') THEN 2 WHEN {words} THEN 3 WHEN contains(key, '{query}') THEN 4 END AS rank,
        ({loose}) AS near FROM c),
      s AS (SELECT pid, min(2 * rank + CASE WHEN pos = 0 THEN 0 ELSE 1 END) AS score, arg_min(CASE WHEN pos > 0 THEN raw ELSE '' END, (2 * rank + CASE WHEN pos = 0 THEN 0 ELSE 1 END, pos)) AS matched FROM r WHERE rank IS NOT NULL GROUP BY pid),
      l AS (SELECT pid, arg_min(10 + CASE WHEN pos = 0 THEN 0 ELSE 1 END, pos) AS score, arg_min(CASE WHEN pos > 0 THEN raw ELSE '' END, pos) AS matched FROM r WHERE near AND pid NOT IN (SELECT pid FROM s) AND (SELECT count(*) FROM s) < {limit} GROUP BY pid)
      SELECT pid, name, score::INT AS score, nullif(matched, '') AS matched FROM (SELECT * FROM s UNION ALL SELECT * FROM l) JOIN n USING (pid) ORDER BY score, extent DESC, length(name), name, pid LIMIT {limit}"""


Q = [
    Query("search_rank", "I7 I9 I10 I37 K28 G1 J5", _found("red widget"), search_sql("red widget", 25)),
    Query("search_near", "I11 K28 G1 D25", _found("wigdet blu", 60), search_sql("wigdet blu", 60)),
    Query("search_rerank", "G2", search_rerank, f"""WITH f AS ({search_sql("ring", 40)}) SELECT pid, name, tier FROM (SELECT pid, name, CASE WHEN lower(name) = 'red ring' THEN 0 WHEN p_size > 25 THEN 1 ELSE 2 END AS tier FROM f JOIN part ON pid = printf('p%06d', p_partkey)) ORDER BY tier, pid LIMIT 20"""),
    Query("filter_words_or_year", "C10 C11 C13 C14", filter_words_or_year, "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'r') AND (contains(lower(p_name), '30') OR 30 BETWEEN p_size AND p_size + 10)"),
    Query("text_contains", "C9 C12 I8", text_contains, f"""SELECT p_partkey, contains({FOLDED.format("p_name")}, 'red') AS in_title, replace({FOLDED.format("p_name")}, ' ', '-') AS slug FROM part WHERE contains({FOLDED.format("p_name || ' ' || p_type || ' ' || p_brand")}, 'red')"""),
    Query("term_inverted_index", "D21 I36", term_inverted_index, r"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '\b(?:Apache|MIT|GNU|CC|License|licensed)\b'))) AS term FROM documents)
        SELECT term, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM t GROUP BY term"""),
    Query("candidate_unique_match", "D24 D26 K24", unique_match, """SELECT s_suppkey, min(c_custkey) AS c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 500) = floor(c_acctbal / 500) GROUP BY s_suppkey HAVING count(*) = 1"""),
]
