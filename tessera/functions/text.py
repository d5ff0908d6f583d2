"""Text and symbol functions as columns; all stay in the JVM.

An expression that a lambda's body names is evaluated for every element, so values
that lambdas use are bound first (see ``let``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".md": "markdown", ".mdx": "markdown", ".json": "json", ".css": "css", ".html": "html",
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once for a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def camel_split(s: Column) -> Column:
    return F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2")


def tokenize(s: Column) -> Column:
    """Lower-case identifiers of two characters or more, and runs of digits; camel case is split."""
    return F.regexp_extract_all(F.lower(camel_split(F.coalesce(s, F.lit("")))), F.lit("[a-z_][a-z0-9_]+|[0-9]+"), F.lit(0))


def index_terms(s: Column) -> Column:
    """Lower-case runs of letters and digits: the terms of the full-text index."""
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def normalize_symbol(s: Column) -> Column:
    plain = F.regexp_replace(F.lower(camel_split(F.coalesce(s, F.lit("")))), "[^a-z0-9]+", " ")
    return F.trim(plain)


def without_kind(s: Column) -> Column:
    return F.regexp_replace(s, "^[A-Za-z]+:", "")


def simple_name(s: Column) -> Column:
    """The part after the last dot of a symbol without its kind."""
    return let(without_kind(s), lambda n: let(F.element_at(F.split(n, "\\."), -1), lambda last: F.when(last == "", n).otherwise(last)))


def search_names(s: Column) -> Column:
    """The names under which a symbol may be sought."""
    return F.array_distinct(F.filter(F.array(F.trim(s), without_kind(F.trim(s)), simple_name(F.trim(s))), lambda n: n != ""))


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, "\\.[^.]+$", 0))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, extension), F.lit("text"))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0))))


def fnv1a(s: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, as a long; one pass over the characters."""

    def units(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        over = code - 65536
        return F.when(code > 65535, F.array(F.shiftright(over, 10) + 55296, over.bitwiseAND(F.lit(1023).cast("long")) + 56320)).otherwise(F.array(code))

    step = lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    every = F.flatten(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), units))
    return F.aggregate(every, F.lit(2166136261).cast("long"), step)


def match_label(vector: Column, lexical: Column, symbol: Column, relation: Column) -> Column:
    """Why a hit was found."""
    return (
        F.when(symbol > 0.8, "exact symbol match")
        .when((symbol > 0.55) & (lexical > 0.33), "symbol and lexical match")
        .when(symbol > 0.55, "symbol match")
        .when((relation > 0.5) & (lexical > 0.33), "relationship and lexical match")
        .when((lexical > 0.66) & (vector > 0.2), "lexical and vector match")
        .when(lexical > 0.66, "lexical match")
        .when(vector > 0.2, "vector similarity")
        .otherwise("weak combined match")
    )


def relation_intent(text: Column, hints: tuple[str, ...] = ("import", "reference", "test", "neighbor")) -> Column:
    """How far a text speaks of the relations that a query hints at; words end at ASCII letters, digits and _."""
    word = lambda names: F.lower(F.coalesce(text, F.lit(""))).rlike(f"(?<![A-Za-z0-9_])(?:{names})(?![A-Za-z0-9_])")
    rules = {"import": ("import|export|resolveimport|target", 0.3), "reference": ("reference|references|target_symbol|symbol_references", 0.3), "test": ("test|spec|__tests__", 0.2), "neighbor": ("neighbor|same-file|file_path", 0.2)}
    total = F.lit(0.0)
    for h in hints:
        names, score = rules[h]
        total = total + F.when(word(names), score).otherwise(0.0)
    return clamp01(total)
