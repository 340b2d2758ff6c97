"""Mixing sources to target weights by iterative proportional fitting; SQL functions only.

Tokens are summed by source, language and topic. The target marginals are the shares of tokens raised to a power
below one, so that large parts give way to small ones, but none asks for more than `CEILING` of the tokens that
a part has: with a budget of three quarters, a topic of 1 % can't become one of 5 %. Raking then looks for
factors of sources, languages and topics such that the expected tokens of all cells,

    tokens * least(1, source factor * language factor * topic factor),

meet the three marginals within the budget; the cap at 1 is part of the fit, so nothing is cut off behind it. A
round solves every source's factor exactly for the factors of languages and topics (the left side is concave
and piecewise linear, so a few steps of Newton's method do), one aggregation, and scales the latter by what
their sums lack. Source factors are a column; what comes back to the driver are sums by pair of language
and topic, at most `MOST_PAIRS` of them. Documents are kept with the probability of their cell; the draw is
a hash of the document's id, so it can be repeated.

Topics are read off the text: `TOPICS` lists conditions, the first that holds counts.

Defined results: a null text has no words and counts as `MIN_TOKENS` tokens, as any shorter text does; a null
source, language or topic is a value of its own; a null doc_id is drawn by its text, without a text by the
empty one; rows with the same id are kept or dropped together if they share a cell; an empty table gives an
empty result; more pairs of languages and topics than `MOST_PAIRS` raise an error; further columns are kept
by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import as_row, checkpointed, let, no_text, table

#: Powers of the shares that become target marginals, and the share of all tokens that is drawn.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET, CEILING, SEED, MIN_TOKENS = 0.75, 0.9, "mix-1", 1
#: Rounds of raking, Newton steps in each, and steps that fit the targets under their ceilings.
ROUNDS, NEWTON, LEVELS = 8, 4, 6
#: Source factors are broadcast up to this many sources and joined by shuffle beyond.
BROADCAST_SOURCES, MOST_PAIRS = 100_000, 10_000
TOPICS = (("legal", "%icensed under%"), ("contact", "%@%.%"), ("tabular", "% | % | %"))
NONE = "\x01none"


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.like(pattern), name).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    return F.greatest(F.lit(MIN_TOKENS), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the id (on the text where there is none) and the seed."""
    key = F.concat(F.lit(SEED), F.lit(":"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / 2.0**48


def _targets(totals: dict, power: float, budget: float) -> dict:
    """Tempered shares under their ceilings."""
    whole = sum(totals.values())
    raised, most = {k: (v / whole) ** power for k, v in totals.items()}, {k: CEILING * v / whole / budget for k, v in totals.items()}
    level = 1 / sum(raised.values())
    for _ in range(LEVELS):
        full = {k for k in totals if level * raised[k] >= most[k]}
        rest = sum(v for k, v in raised.items() if k not in full)
        level = (1 - sum(most[k] for k in full)) / rest if rest else level
    return {k: min(most[k], level * v) for k, v in raised.items()}


def _with_targets(sources: DataFrame, whole: float, power: float, budget: float) -> DataFrame:
    """`sources` (x: tokens) with their targets in `want`, fitted in the same steps by aggregations."""
    raised, most = F.pow(F.col("x") / whole, F.lit(power)), F.col("x") * (CEILING / whole / budget)
    level = 1 / sources.agg(F.sum(raised)).first()[0]
    for _ in range(LEVELS):
        full = F.lit(level) * raised >= most
        above, rest = sources.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, raised))).first()
        level = (1 - (above or 0)) / rest if rest else level
    return sources.withColumn("want", F.least(most, F.lit(level) * raised))


def _lookup(factors: dict, column: Column) -> Column:
    """The factor of each value, from a map literal."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in factors.items() for x in kv]), column)


def _source_factor(need: Column, b: dict, c: dict) -> Column:
    """The factor at which a source's cells (lang, topic, x), each capped at its tokens, sum to `need`."""
    items = F.transform("cells", lambda z: F.struct(z["x"].alias("x"), (_lookup(b, z["lang"]) * _lookup(c, z["topic"])).alias("w")))
    total = lambda it, of: F.aggregate(it, F.lit(0.0), lambda acc, z: acc + of(z))

    def solved(it: Column) -> Column:
        def step(a: Column) -> Column:
            full = total(it, lambda z: F.when(a * z["w"] >= 1, z["x"]).otherwise(0.0))
            rest = total(it, lambda z: F.when(a * z["w"] >= 1, 0.0).otherwise(z["x"] * z["w"]))
            return let(F.struct(full.alias("full"), rest.alias("rest")), lambda r: F.when(r["rest"] > 0, (need - r["full"]) / r["rest"]).otherwise(a))

        start = need / total(it, lambda z: z["x"] * z["w"])
        return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), start, lambda a, _: step(a))

    return let(items, solved)


def rake(cells: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS, temper: dict = TEMPER) -> tuple[DataFrame, dict, dict]:
    """(source, a), language factors and topic factors from cells (source, lang, topic, x)."""
    pairs = cells.groupBy("lang", "topic").agg(F.sum("x").alias("x")).limit(MOST_PAIRS + 1).collect()
    if len(pairs) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of language and topic")
    langs, topics = {}, {}
    for r in pairs:
        langs[r["lang"]] = langs.get(r["lang"], 0) + r["x"]
        topics[r["topic"]] = topics.get(r["topic"], 0) + r["x"]
    whole = float(sum(langs.values()))
    want_lang, want_topic = _targets(langs, temper["lang"], budget), _targets(topics, temper["topic"], budget)
    # a source has at most one cell for each pair
    sources = cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", F.col("x").cast("double").alias("x"))).alias("cells"), F.sum("x").alias("x"))
    sources = checkpointed(_with_targets(checkpointed(sources), whole, temper["source"], budget))
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def with_a(b: dict, c: dict) -> DataFrame:
        return sources.withColumn("a", _source_factor(F.col("want") * (budget * whole), b, c))

    for _ in range(rounds):
        each = with_a(b, c).select("a", F.explode("cells").alias("z")).select("z.*", F.least(F.lit(1.0), F.col("a") * _lookup(b, F.col("z.lang")) * _lookup(c, F.col("z.topic"))).alias("p"))
        y = {(r["lang"], r["topic"]): r["y"] for r in each.groupBy("lang", "topic").agg(F.sum(F.col("x") * F.col("p")).alias("y")).collect()}
        scale = {k: budget * whole * want_lang[k] / sum(v for (l, _), v in sorted(y.items()) if l == k) for k in langs}
        b = {k: b[k] * scale[k] for k in langs}
        c = {k: c[k] * budget * whole * want_topic[k] / sum(v * scale[l] for (l, t), v in sorted(y.items()) if t == k) for k in topics}
    return with_a(b, c).select("source", "a"), b, c


def mix(docs: DataFrame, budget: float = BUDGET, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", details: bool = False) -> DataFrame:
    """The drawn rows of `docs`; with `details` also __topic, __tokens and __probability."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    tagged = docs.select(as_row(docs), F.col(doc_id).alias("__id"), F.col(text).alias("__text"), value(source).alias("__source"), value(lang).alias("__lang"), topic_of(no_text(text)).alias("__topic"), n_tokens(no_text(text)).alias("__tokens"))
    cells = checkpointed(tagged.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("x")))
    extra = ["__topic", "__tokens", "__probability"] if details else []
    if cells.isEmpty():
        return tagged.withColumn("__probability", F.lit(1.0)).select("__row.*", *extra)
    a, b, c = rake(cells, budget)
    a = checkpointed(a)
    few = a.count() <= BROADCAST_SOURCES
    factors = a.select(F.col("source").alias("__source"), "a")
    drawn = tagged.join(F.broadcast(factors) if few else factors, "__source").withColumn("__probability", F.least(F.lit(1.0), F.col("a") * _lookup(b, F.col("__lang")) * _lookup(c, F.col("__topic"))))
    return drawn.filter(draw(F.col("__id"), F.col("__text")) < F.col("__probability")).select("__row.*", *extra)


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs, details=True).select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("__probability", 6).alias("probability"))


def sql(docs: str = "documents", columns: str = "doc_id, source, lang, topic, x AS n_tokens, round(p, 6) AS probability") -> str:
    """The same steps, written out one after the other."""
    topic = "CASE " + " ".join(f"WHEN body LIKE '{p}' THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    steps = ["n AS MATERIALIZED (SELECT sum(x) AS whole FROM cells)"]
    for k, name in (("s", "source"), ("l", "lang"), ("t", "topic")):
        steps.append(f"r{k} AS MATERIALIZED (SELECT {k}, pow(sum(x) / any_value(whole), {TEMPER[name]}) AS r, {CEILING} * sum(x) / any_value(whole) / {BUDGET} AS most FROM cells, n GROUP BY {k})")
        steps.append(f"v{k}0 AS MATERIALIZED (SELECT 1 / sum(r) AS v FROM r{k})")
        for i in range(LEVELS):
            steps.append(f"v{k}{i + 1} AS MATERIALIZED (SELECT coalesce((1 - coalesce(sum(most) FILTER (WHERE v * r >= most), 0)) / nullif(coalesce(sum(r) FILTER (WHERE v * r < most), 0), 0), any_value(v)) AS v FROM r{k}, v{k}{i})")
        steps.append(f"w{k} AS MATERIALIZED (SELECT {k}, {BUDGET} * whole * least(most, v * r) AS want FROM r{k}, v{k}{LEVELS}, n)")
    b, c = "(SELECT DISTINCT l, 1.0::DOUBLE AS f FROM cells)", "(SELECT DISTINCT t, 1.0::DOUBLE AS f FROM cells)"
    for i in range(ROUNDS + 1):
        steps.append(f"o{i} AS MATERIALIZED (SELECT s, l, t, x, b.f * c.f AS w FROM cells JOIN {b} b USING (l) JOIN {c} c USING (t))")
        steps.append(f"a{i}n0 AS MATERIALIZED (SELECT s, any_value(want) / sum(x * w) AS f FROM o{i} JOIN ws USING (s) GROUP BY s)")
        for j in range(NEWTON):
            steps.append(
                f"a{i}n{j + 1} AS MATERIALIZED (SELECT s, coalesce((any_value(want) - coalesce(sum(x) FILTER (WHERE f * w >= 1), 0)) / nullif(coalesce(sum(x * w) FILTER (WHERE f * w < 1), 0), 0), any_value(f)) AS f "
                f"FROM o{i} JOIN a{i}n{j} USING (s) JOIN ws USING (s) GROUP BY s)"
            )
        steps.append(f"y{i} AS MATERIALIZED (SELECT s, l, t, x, least(1.0, f * w) AS p FROM o{i} JOIN a{i}n{NEWTON} USING (s))")
        if i < ROUNDS:
            steps.append(f"q{i} AS MATERIALIZED (SELECT l, any_value(want) / sum(x * p) AS f FROM y{i} JOIN wl USING (l) GROUP BY l)")
            steps.append(f"b{i} AS MATERIALIZED (SELECT l, b.f * q.f AS f FROM {b} b JOIN q{i} q USING (l))")
            steps.append(f"c{i} AS MATERIALIZED (SELECT t, any_value(c.f) * any_value(want) / sum(x * p * q.f) AS f FROM y{i} JOIN q{i} q USING (l) JOIN {c} c USING (t) JOIN wt USING (t) GROUP BY t)")
            b, c = f"b{i}", f"c{i}"
    return rf"""
WITH d AS (SELECT *, coalesce(text, '') AS body, coalesce(source::VARCHAR, '{NONE}') AS s, coalesce(lang::VARCHAR, '{NONE}') AS l FROM {docs}),
e AS (SELECT *, {topic} AS topic, greatest({MIN_TOKENS}, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')))::BIGINT AS x FROM d),
cells AS MATERIALIZED (SELECT s, l, topic AS t, sum(x)::DOUBLE AS x FROM e GROUP BY ALL),
{", ".join(steps)},
p AS (SELECT e.*, y.p FROM e JOIN y{ROUNDS} y ON y.s = e.s AND y.l = e.l AND y.t = e.topic)
SELECT {columns} FROM p
WHERE ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT / pow(2, 48) < p
"""
