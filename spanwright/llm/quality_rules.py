"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in Spark expression over the whole text, so the plan has neither a shuffle nor a
user function, and a row never leaves its task.

Defined results: a null text counts as empty (no words, rejected as too short); a repeated row gives a
repeated result; an empty table gives an empty one; further columns of the input are passed on by
`apply_rules` and left out by `quality_report`. A column of the input that has the name of a measure is
replaced in `quality_report` and untouched by `apply_rules`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import as_row, let, no_text

#: What separates words, as characters and as a class.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Frequent function words of the languages covered.
STOP_WORDS = {
    "en": "the be to of and that have with is it in a for on was as at by this are from or an not".split(),
    "de": "der die das und ist in den von zu mit sich auf für nicht ein eine als auch es im dem des".split(),
    "fr": "le la les de des du et est un une en que qui dans pour pas sur au avec ce il se ne par".split(),
    "es": "el la los las de del y que en un una es se no por con para su al lo como más o le".split(),
}

#: (measure, least, most): a document is kept if every measure lies between its bounds, which may be None.
THRESHOLDS = (
    ("n_words", 20, None),
    ("mean_word_chars", 1.5, 16.0),
    ("symbols_per_word", None, 0.15),
    ("stop_word_ratio", 0.02, None),
    ("shout_ratio", None, 0.3),
    ("echo_ratio", None, 0.3),
    ("dup_line_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.5),
)


def _repeated_words(words: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the text, each word once."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def repeated(ordered: Column) -> Column:
        """Starts of the windows whose neighbour in hash order has the same hash."""
        same = lambda x, j: F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, same), lambda x: x["i"]))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        found = lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: covered(repeated(s))),
        ).otherwise(F.lit(0).cast("long"))
        return F.when(F.size(w) > WINDOW, let(hashes, found)).otherwise(F.lit(0).cast("long"))

    return let(words, of)


def measures(text: Column) -> dict[str, Column]:
    """Counts of one text, by name. `text` has no nulls."""
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN, -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    return {
        "words": words,
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_ellipsis_lines": F.regexp_count(text, F.lit(r"(?:\.\.\.|…)[ \t]*(?:\n|\z)")).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long"),
        "n_echoes": let(words, lambda ws: F.size(F.filter(ws, lambda w, i: w == F.get(ws, i - 1)))).cast("long"),
        "n_shouts": F.regexp_count(text, F.lit(r"!!")).cast("long"),
        "n_repeat_words": _repeated_words(words),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of `keep` and every measure."""
    m, p = measures(no_text(text)), F.col
    counted = docs.select(*keep, *[c.alias(n) for n, c in m.items() if n != "words"])
    per_word, per_line = F.greatest(p("n_words"), F.lit(1)), F.greatest(p("n_lines"), F.lit(1))
    ratios = {
        "mean_word_chars": p("word_chars") / per_word,
        "symbols_per_word": p("n_symbols") / per_word,
        "stop_word_ratio": p("n_stop_words") / per_word,
        "shout_ratio": p("n_shouts") / per_word,
        "echo_ratio": p("n_echoes") / per_word,
        "dup_line_ratio": p("n_dup_lines") / per_line,
        "ellipsis_line_ratio": p("n_ellipsis_lines") / per_line,
    }
    return counted.select("*", *[c.alias(n) for n, c in ratios.items()])


def verdict(thresholds=THRESHOLDS) -> tuple[Column, Column]:
    """(base_failed, kept) over the columns of `measured`."""
    p = F.col
    failed = (p("n_words") < 20) | (100 * p("n_repeat_words") > 30 * p("n_words"))
    fine = ~failed
    for name, least, most in thresholds:
        fine = fine & (p(name) >= least) if least is not None else fine
        fine = fine & (p(name) <= most) if most is not None else fine
    return failed, fine


def quality_report(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """doc_id, the counts, the ratios, base_failed and kept for each row."""
    failed, kept = verdict(thresholds=thresholds)
    out = measured(docs, ["doc_id"], text)
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), kept.alias("kept"), *[n for n, _, _ in thresholds if n not in COUNTS])


def apply_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows that the rules keep, with the columns they came with."""
    _, kept = verdict(thresholds=thresholds)
    return measured(docs.select(as_row(docs), F.col(text).alias("text")), keep=["__row"]).filter(kept).select("__row.*")


def op9_quality_rules(spark, sf_dir):
    from spanwright.llm.common import table

    failed, kept = verdict()
    return measured(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *COUNTS, failed.alias("base_failed"), kept.alias("kept"))


def _words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def sql(docs: str = "documents") -> str:
    """The same counts and verdict for DuckDB: windows become rows that are grouped by their words."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    tests = " AND ".join(f"{n} {op} {v}" for n, least, most in THRESHOLDS for op, v in ((">=", least), ("<=", most)) if v is not None)
    return rf"""
WITH base AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS body FROM {docs}),
w AS (SELECT rid, doc_id, body, {_words_sql("body")} AS words,
        list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least({WINDOW}, i - before)) AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - {WINDOW}) AS before FROM dup) GROUP BY rid),
c AS (SELECT rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(regexp_extract_all(body, '(?:\.\.\.|…)[ \t]*(?:\n|\z)'))::BIGINT AS n_ellipsis_lines,
        len(list_filter(words, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
        len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_echoes,
        len(regexp_extract_all(body, '!!'))::BIGINT AS n_shouts FROM w),
m AS (SELECT c.*, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
        n_stop_words / greatest(n_words, 1) AS stop_word_ratio, n_shouts / greatest(n_words, 1) AS shout_ratio, n_echoes / greatest(n_words, 1) AS echo_ratio,
        n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_ellipsis_lines / greatest(n_lines, 1) AS ellipsis_line_ratio
      FROM c LEFT JOIN cov USING (rid)),
v AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, (NOT base_failed AND {tests}) AS kept FROM v
"""
