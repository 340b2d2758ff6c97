"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans come from four patterns with their checks (`BASE`). Wider patterns propose candidate spans
(`PROPOSALS`); labelers of three kinds vote on each proposal and on each base match, for (1), against (-1)
or not at all (0):

- regex: the strict shape of the kind holds;
- gazetteer: its words are on (or off) a list of cue names;
- context: cue words stand right before the span; the span has digits and letters mixed; it stands alone.

One scan finds all spans and writes them, with their votes and features, to the checkpoint folder; texts are
not written. The vote patterns are counted over all documents: at most 68 for each mixture of features, and
216 mixtures of features, whatever the input. Expectation-maximisation on the votes estimates every labeler's
reliability without labels. Its posteriors train the final span classifier, a logistic regression over the
votes, the kind and features of the span itself (length, share of digits, capitals, what stands before and
behind it), which decides on the proposals.

Positions count code points and come from the matches themselves: a text split by a pattern gives the pieces
between its matches, so the running lengths of pieces and matches are the positions. Patterns read a text
once (a run of letters is tried from its start alone), and arrays are folded in blocks, so a text takes time
in proportion to its length.

Defined results: a null or empty text has no spans; a repeated row gives a repeated result; a null doc_id is
passed on; an empty table gives an empty result and leaves the prior weights; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import checkpointed, folded, let, no_text, table

SPAN = "struct<start:int,kind:int,end:int,s:string,before:string,after:string>"
SPANS = f"array<{SPAN}>"
#: kind -> pattern. Quantifiers that need no backtracking are possessive. An address begins where a run of its
#: characters begins or where the match before it ended: from inside a run no other start would get further.
#: A card is looked for in whole runs of digits that have 14 to 19 of them; all other runs fail its check.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSALS = {
    "secret": r"\b(?:AKIA[0-9A-Z]{16}\b|(?:password|passwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}\"?[0-9A-Za-z_-]{8,}+\"?)",
    "local_phone": r"(?<![0-9+.)-])(?<!\+[0-9]{1,3} )\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Señor|Señora|Sra)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?",
}
KINDS = [*BASE, *PROPOSALS]
#: What a document must hold before the pattern is tried.
NEEDS = {"email": "@", "phone": "+"}
#: Shapes that a labeler accepts, given names of the gazetteer, and cues before a span.
STRICT = {
    "secret": r"AKIA[0-9A-Z]{16}|\w+\s{0,2}[=:]\s{0,2}(?:[0-9a-f]{16,64}|\"[0-9a-f]{16,64}\")",
    "local_phone": r"\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}",
    "name": r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Señora?|Sra)\.? \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+",
}
GIVEN_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Anna Peter Hans Klaus Ursula Petra Jürgen Stefan Sabine Monika Jean Pierre Marie Michel Claire Luc Sophie Nicolas Camille Chloé "
    "José Juan Carlos Carmen Ana Luis Miguel Pedro Lucía Elena"
).split()
CUES = {
    "email": r"(?i)\b(?:e-?mail|contact|mail|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|from|address)\b",
    "card": r"(?i)\b(?:card|visa|credit|account|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone)\b",
    "secret": r"(?i)\b(?:key|secret|password|token|login|aws)\b",
    "local_phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone)\b",
    "name": r"(?i)\b(?:by|with|from|dear|sincerely|von|por|par)\b",
}
#: Code points before a span in which a cue counts.
CONTEXT = 24
LABELERS = ("shape", "gazetteer", "cue", "mixed", "alone")
#: Features of a span and their numbers of classes.
FEATURES = {"length": 4, "digits": 3, "capitals": 2, "before": 3, "after": 3}
VOTE = "struct<kind:int," + ",".join(f"{n}:int" for n in (*LABELERS, "anchor", *FEATURES)) + ">"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a pattern in order, as spans with their surroundings."""
    none = F.array().cast(SPANS)

    def place(pieces: Column, matches: Column) -> Column:
        sizes = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        ends = folded(sizes, F.lit(0), lambda total, n: (total + n, F.array(total + n)), "array<int>")

        def span(m: Column, i: Column, ends: Column) -> Column:
            before = F.right(F.concat(F.when(i > 0, F.get(matches, i - 1)).otherwise(""), F.get(pieces, i)), F.lit(CONTEXT))
            after = F.left(F.concat(F.left(F.get(pieces, i + 1), F.lit(1)), F.coalesce(F.left(F.get(matches, i + 1), F.lit(1)), F.lit(""))), F.lit(1))
            return F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(ends, i).alias("end"), m.alias("s"), before.alias("before"), after.alias("after"))

        return let(ends, lambda e: F.transform(matches, lambda m, i: span(m, i, e)))

    extracted = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(F.split(text, pattern, -1), lambda pieces: F.when(F.size(pieces) > 1, let(extracted, lambda matches: place(pieces, matches))).otherwise(none))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if kind in NEEDS else found


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)
        twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        digit = lambda i: F.call_function("substring", d, i, F.lit(1)).cast("int")
        add = lambda acc, i: acc + F.when((n - i) % 2 == 1, twice(digit(i))).otherwise(digit(i))
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return let(_digits(s), lambda d: F.length(d).between(14, 19) & (total(d) % 10 == 0))


def _checked(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: F.regexp_like(x, F.lit(r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?$")))
    if kind == "card":
        return _luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _by_kind(x: Column, of) -> Column:
    out = F.lit(0)
    for i, kind in enumerate(KINDS):
        out = F.when(x["kind"] == i, of(kind)).otherwise(out)
    return out


def _vote(x: Column, passed: bool | None) -> Column:
    """The votes of all labelers on the span `x` and its features. `passed`: what the check of a base kind said."""
    sign = lambda c: F.when(c, 1).otherwise(-1)
    letters = F.lit(r"[\p{L}\p{N}]")
    side = lambda c: F.when(F.regexp_like(c, letters), 1).when(c.isin("", " ", "\n", "\t"), 0).otherwise(2)
    last, checked = F.right(x["before"], F.lit(1)), F.lit(0 if passed is None else 1 if passed else -1)
    shape = _by_kind(x, lambda k: sign(F.regexp_like(x["s"], F.lit(f"^(?:{STRICT[k]})$"))) if k in STRICT else checked)
    listed = F.exists(F.split(x["s"], r"[^\p{L}]+"), lambda w: w.isin(GIVEN_NAMES))
    n, digits = F.length(x["s"]), F.length(_digits(x["s"]))
    values = [
        x["kind"],
        shape,
        _by_kind(x, lambda k: F.when(listed, 1).otherwise(-1) if k == "name" else F.lit(0)),
        _by_kind(x, lambda k: F.when(F.regexp_like(x["before"], F.lit(CUES[k])), 1).otherwise(0)),
        _by_kind(x, lambda k: sign(F.regexp_like(x["s"], F.lit(r"[0-9]")) & F.regexp_like(x["s"], F.lit(r"[A-Za-z]"))) if k == "secret" else F.lit(0)),
        F.when(F.regexp_like(last, letters) | F.regexp_like(x["after"], letters), -1).otherwise(1),
        checked,
        F.when(n < 8, 0).when(n < 16, 1).when(n < 32, 2).otherwise(3),
        F.when(digits == 0, 0).when(2 * digits < n, 1).otherwise(2),
        F.when(F.regexp_like(x["s"], F.lit(r"\p{Lu}")), 1).otherwise(0),
        side(last),
        side(x["after"]),
    ]
    return F.struct(*[v.alias(c) for v, c in zip(values, ("kind", *LABELERS, "anchor", *FEATURES))]).cast(VOTE)


def _apart(spans: Column, base: Column) -> Column:
    """The `spans` that touch no base span: one pass over all of them in order for the base spans that begin
    before, one in reverse for those that begin behind."""
    tag = lambda xs, own: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x.alias("x"), F.lit(True).alias("free")))
    kind = f"array<struct<start:int,own:int,x:{SPAN},free:boolean>>"
    row = lambda y, free: F.array(F.struct(y["start"].alias("start"), y["own"].alias("own"), y["x"].alias("x"), free.alias("free")))
    ahead = lambda reach, y: (F.when(y["own"] == 0, F.greatest(reach, y["x"]["end"])).otherwise(reach), row(y, y["start"] >= reach))
    behind = lambda reach, y: (F.when(y["own"] == 0, F.least(reach, y["start"])).otherwise(reach), row(y, y["free"] & (y["x"]["end"] <= reach)))
    every = F.sort_array(F.concat(tag(base, 0), tag(spans, 1)))
    marked = let(folded(every, F.lit(0), ahead, kind), lambda some: folded(F.reverse(some), F.lit(2**31 - 1), behind, kind))
    left = F.reverse(F.transform(F.filter(marked, lambda y: y["free"] & (y["own"] == 1)), lambda y: y["x"]))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), F.sort_array(spans)).otherwise(left)


def with_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base spans that pass, the proposals that touch none of them with their votes in `p`, and the
    votes on base matches in `votes`."""
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), no_text(text).alias("text"))
    out = out.select("doc_id", *[_found(F.col("text"), k, p).alias(f"all_{k}") for k, p in BASE.items()], F.concat(*[_found(F.col("text"), k, p) for k, p in PROPOSALS.items()]).alias("wide"))
    passing = lambda kind, yes: F.filter(f"all_{kind}", lambda x: _checked(kind, x["s"]) if yes else ~_checked(kind, x["s"]))
    out = out.select("doc_id", "wide", F.sort_array(F.concat(*[passing(k, True) for k in BASE])).alias("passed"), F.concat(*[passing(k, False) for k in BASE if k != "email"]).alias("failed"))
    proposed = F.transform(_apart(F.col("wide"), F.col("passed")), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["s"].alias("s"), _vote(x, None).alias("p")))
    bare = F.transform("passed", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["s"].alias("s")))
    return out.select("doc_id", bare.alias("base"), proposed.alias("proposed"), F.concat(F.transform("passed", lambda x: _vote(x, True)), F.transform("failed", lambda x: _vote(x, False))).alias("votes"))


def vote_counts(spans: DataFrame) -> list[tuple[tuple, int]]:
    """((kind, votes..., anchor, features...), count) over all documents; see the module for the bound."""
    every = F.concat("votes", F.transform("proposed", lambda x: x["p"]))
    rows = spans.select(F.explode(every).alias("v")).groupBy("v").count().collect()
    return sorted((tuple(r["v"]), r["count"]) for r in rows)


VOTES = slice(1, 1 + len(LABELERS))
ANCHOR = 1 + len(LABELERS)


def expectation_maximisation(counts, rounds: int = 30, prior: float = 8.0) -> dict[tuple, float]:
    """Posterior of being personal data for each (kind, votes..., anchor).

    Every labeler has, for each kind, a rate of voting right; `prior` pseudo-votes hold it at 0.8 until the
    counts say otherwise. Patterns with an anchor (a base match and what its check said) keep it.
    """
    merged: dict[tuple, int] = {}
    for v, n in counts:
        merged[v[: ANCHOR + 1]] = merged.get(v[: ANCHOR + 1], 0) + n
    counts = sorted(merged.items())
    kinds = {v[0] for v, _ in counts}
    share, right = {k: 0.5 for k in kinds}, {(k, j): 0.8 for k in kinds for j in range(len(LABELERS))}
    belief: dict[tuple, float] = {}
    for _ in range(rounds):
        for v, _ in counts:
            yes, no = math.log(share[v[0]]), math.log(1 - share[v[0]])
            for j, vote in enumerate(v[VOTES]):
                if vote:
                    r = right[v[0], j]
                    yes, no = yes + math.log(r if vote > 0 else 1 - r), no + math.log(1 - r if vote > 0 else r)
            anchor = v[ANCHOR]
            belief[v] = (1.0 if anchor > 0 else 0.0) if anchor else 1 / (1 + math.exp(max(-500, min(500, no - yes))))
        for k in kinds:
            own = [(v, n) for v, n in counts if v[0] == k]
            share[k] = (sum(n * belief[v] for v, n in own) + prior / 2) / (sum(n for _, n in own) + prior)
            for j in range(len(LABELERS)):
                cast = [(v, n) for v, n in own if v[1 + j]]
                agreed = sum(n * (belief[v] if v[1 + j] > 0 else 1 - belief[v]) for v, n in cast)
                right[k, j] = min(0.99, max(0.5, (agreed + 0.8 * prior) / (sum(n for _, n in cast) + prior)))
    return belief


def _inputs(v: tuple) -> list[float]:
    """What the classifier sees of a span: its kind, its votes and its features."""
    return [float(v[0] == i) for i in range(len(KINDS))] + [float(x) for x in v[VOTES]] + [float(v[ANCHOR + 1 + i] == c) for i, n in enumerate(FEATURES.values()) for c in range(n)]


#: Weights before any training: the votes decide alone.
PRIOR = np.array([0.0] * len(KINDS) + [1.0] * len(LABELERS) + [0.0] * sum(FEATURES.values()))


def classifier(counts, belief: dict[tuple, float], rounds: int = 25, shrink: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression on the posteriors by Newton's method, held towards `PRIOR`.

    Every kind weighs the same, and every span of a kind.
    """
    weights = PRIOR.copy()
    if not counts:
        return weights
    x, wanted = np.array([_inputs(v) for v, _ in counts]), np.array([belief[v[: ANCHOR + 1]] for v, _ in counts])
    n, kind = np.array([c for _, c in counts], float), np.array([v[0] for v, _ in counts])
    n /= np.bincount(kind, n, len(KINDS))[kind] * len(set(kind))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (p - wanted)) + shrink * (weights - PRIOR)
        bend = (x * (n * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + shrink * np.eye(len(weights))
        weights -= np.linalg.solve(bend, slope)
    return weights


def _accepted(weights: np.ndarray) -> Column:
    """The proposals that the classifier takes for personal data, the first of any that overlap."""
    w = [float(round(x, 9)) for x in weights]

    def score(v: Column) -> Column:
        parts = [_by_kind(v, lambda k: F.lit(w[KINDS.index(k)]))] + [F.lit(w[len(KINDS) + j]) * v[name] for j, name in enumerate(LABELERS)]
        at = len(KINDS) + len(LABELERS)
        for name, n in FEATURES.items():
            parts.append(F.get(F.array(*[F.lit(c) for c in w[at : at + n]]), v[name]))
            at += n
        return sum(parts[1:], parts[0])

    kind = "array<struct<start:int,kind:int,end:int,s:string>>"
    taken = F.transform(F.filter("proposed", lambda x: score(x["p"]) > 0), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["s"].alias("s")))
    first = lambda reach, x: (F.when(x["start"] >= reach, x["end"]).otherwise(reach), F.when(x["start"] >= reach, F.array(x)).otherwise(F.array().cast(kind)))
    return folded(F.sort_array(taken), F.lit(0), first, kind)


def _digest(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (checked spans) and found (base and added spans in order), as arrays of (start, kind, end, s)."""
    spans = checkpointed(with_spans(docs, doc_id, text))
    counts = vote_counts(spans)
    weights = classifier(counts, expectation_maximisation(counts))
    return spans.select("doc_id", "base", F.sort_array(F.concat("base", _accepted(weights))).alias("found"))


def op4_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    of_kind = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    counts = [of_kind("base", k).alias(f"n_{k}") for k in BASE]
    added = [of_kind("found", k).alias(f"n_{k}") for k in PROPOSALS]
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"), *added, F.size("found").cast("long").alias("n_spans"))
