"""Text folding, name keys and match ranks on columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that decomposition does not split, and what they fold to.
FOLD = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "n", "ŧ": "t", "ĸ": "k", "ſ": "s"}
# Apostrophes and glottal-stop letters, which join words.
APOSTROPHES = "'`´‘’ʹʻʼʽʾʿˈ"
# Generic words of polity names.
DESIGNATORS = (
    "the of and de del du la le kingdom empire republic dynasty sultanate emirate caliphate khanate khaganate "
    "duchy grand archduchy principality county electorate margraviate landgraviate bishopric prince "
    "confederation confederacy federation union league state states commonwealth dominion realm "
    "protectorate colony mandate territory viceroyalty shogunate chiefdom imamate sheikhdom beylik regency "
    "nation city"
).split()
EXACT, CORE, PREFIX, WORD_PREFIX, SUBSTRING, NEAR = range(6)


def _decomposed() -> tuple[str, str]:
    """Letters below U+2000 whose compatibility decomposition is one base letter with marks, and these letters."""
    pairs = []
    for i in range(0xC0, 0x2000):
        parts = [c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.category(c).startswith("M")]
        if len(parts) == 1 and parts[0] != chr(i):
            pairs.append((chr(i), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize_text(s: Column) -> Column:
    """Marks dropped, lower case, special letters folded, apostrophes dropped, other runs one blank."""
    accented, plain = _decomposed()
    out = F.lower(F.regexp_replace(F.translate(s, accented, plain), r"\p{M}+", ""))
    for letter, folded in FOLD.items():
        out = F.replace(out, F.lit(letter), F.lit(folded))
    out = F.translate(out, APOSTROPHES, "")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def slug(s: Column) -> Column:
    words = F.regexp_replace(normalize_text(F.regexp_replace(s, "&", " and ")), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(words, "^-|-$", "")), F.lit("")), F.lit("unnamed"))


def core(key: Column) -> Column:
    """The key without designators; null where that is empty or nothing new."""
    rest = F.array_join(F.filter(F.split(key, " "), lambda w: ~w.isin(DESIGNATORS)), " ")
    return F.when((rest != "") & (rest != key), rest)


def rank(key: Column, query: str) -> Column:
    """The best of the strict ranks of a normalised key for a normalised query, null if none."""
    words, tokens = F.split(key, " "), query.split(" ")
    every = F.lit(True)
    for t in tokens:
        every = every & F.exists(words, _starts(t))
    return (
        F.when(key == query, EXACT)
        .when(core(key) == query, CORE)
        .when(key.startswith(query), PREFIX)
        .when(every, WORD_PREFIX)
        .when(F.contains(key, F.lit(query)), SUBSTRING)
    )


def _starts(token: str):
    return lambda w: w.startswith(token)


def typo_tolerant(token: str) -> bool:
    return len(token) >= 4 and not any(c.isdigit() for c in token)


def near_variants(token: str) -> list[str]:
    """LIKE patterns of the words that start with `token` but for one edit after the first letter."""
    first, out = token[0], {token + "%"}
    for i in range(1, len(token)):
        out.add(token[:i] + "_" + token[i + 1 :] + "%")  # substituted
        out.add(token[:i] + token[i + 1 :] + "%")  # extra
        out.add(token[:i] + "_" + token[i:] + "%")  # missing
        if i + 1 < len(token):
            out.add(token[:i] + token[i + 1] + token[i] + token[i + 2 :] + "%")  # swapped
    return sorted(p for p in out if p[0] == first)


def near(key: Column, query: str) -> Column:
    """Every word of the query starts a word of the key, exactly or with one typo where the word allows it."""
    words, out = F.split(key, " "), F.lit(True)
    for t in query.split(" "):
        patterns = near_variants(t) if typo_tolerant(t) else [t + "%"]
        out = out & F.exists(words, _like_any(patterns))
    return out


def _like_any(patterns: list[str]):
    def test(w: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | w.like(p)
        return out

    return test


def all_words_or_year(text: Column, lo: Column, hi: Column, query: str) -> Column:
    """Every word of the query is in the text or is a year inside [lo, hi]."""
    out = F.lit(True)
    for w in query.lower().split():
        hit = F.contains(F.lower(text), F.lit(w))
        out = out & ((hit | F.lit(int(w)).between(lo, hi)) if w.lstrip("-").isdigit() else hit)
    return out


def unordered_key(*items: Column) -> Column:
    return F.array_join(F.array_sort(F.array(*items)), "|")


def fnv1a(s: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(s)), lambda i: F.conv(F.substr(F.hex(F.encode(s, "UTF-8")), (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("bigint"))
    # the product of a 32-bit value and the prime stays below 2^63 when its halves are multiplied apart
    step = lambda h, b: ((h.bitwiseXOR(b) % 65536) * 16777619 + F.shiftleft((F.shiftright(h.bitwiseXOR(b), 16) * 16777619) % 65536, 16)) % 4294967296
    return F.when(s == "", F.lit(2166136261)).otherwise(F.aggregate(codes, F.lit(2166136261).cast("bigint"), step))
