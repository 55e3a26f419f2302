"""Column functions on text: identifiers, normal forms, tokens, truncation, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip() sees it; token patterns; the separator of word pairs; stop words.
SPACES = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[\p{L}\p{N}_'-]+"
TERM = r"[A-Za-z][A-Za-z0-9'-]{3,}"
BIGRAM = "::"
STOP_WORDS = "about after again also been before being between could first from have into more other over such than that their there these they this those through under were which while with would".split()
TRIPLET = r"(?s)<triplet>\s*(.*?)\s*<subj>\s*(.*?)\s*<obj>\s*(.*?)(?=\s*<triplet>|$)"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def paragraph_id(title: Column, text: Column) -> Column:
    """SHA-1 of stripped title, line feed, stripped text; a null part counts as empty."""
    return F.sha1(F.concat(strip(F.coalesce(title, F.lit(""))), F.lit("\n"), strip(F.coalesce(text, F.lit("")))))


def normalize_entity(c: Column) -> Column:
    """Case folded (``lower``, and ss for a sharp s), each run of white space one blank, stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "ß", "ss"), f"{SPACES}+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def bigrams(words: Column) -> Column:
    """Each token joined to the next; none for fewer than two tokens."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(BIGRAM), b))


def terms(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lexical terms: ASCII words of four letters or more, without stop words, repeats kept."""
    stop = F.array(*(F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words))) if stop_words != [] else None
    found = F.transform(F.regexp_extract_all(c, F.lit(TERM), F.lit(0)), F.lower)
    return found if stop is None else F.filter(found, lambda x: ~F.array_contains(stop, x))


def joined(*parts: Column) -> Column:
    """Non-blank parts, stripped, one a line."""
    return F.concat_ws("\n", *(F.nullif(strip(p), F.lit("")) for p in parts))


def first_text(*parts: Column) -> Column:
    """The first part that isn't blank."""
    return F.coalesce(*(F.nullif(strip(p), F.lit("")) for p in parts))


def with_prefix(kind: str, c: Column) -> Column:
    """Node id ``kind::c``; a value that has the prefix keeps it."""
    return F.when(F.startswith(c, F.lit(f"{kind}::")), c).otherwise(F.concat(F.lit(f"{kind}::"), c))


def without_prefix(kind: str, c: Column) -> Column:
    return F.when(F.startswith(c, F.lit(f"{kind}::")), F.substring(c, len(kind) + 3, 2**31 - 1)).otherwise(c)


def identifier(v: Column, keys: list[str]) -> Column:
    """Id from a JSON value (variant): the text itself, or the first key of an object with a non-empty value."""
    text = F.try_variant_get(v, "$", "string")
    found = [F.nullif(F.trim(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")) for k in keys]
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.coalesce(*found)).otherwise(F.nullif(F.trim(text), F.lit("")))


def label(v: Column, keys: list[str]) -> Column:
    """Name of a JSON value: ``name``, else ``label``, else its identifier."""
    return F.coalesce(*(F.nullif(F.trim(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")) for k in ("name", "label")), identifier(v, keys))


def as_list(v: Column) -> Column:
    """A JSON value as a list: a list is itself, null is empty, anything else a list of one."""
    return F.when(v.isNull() | F.is_variant_null(v), F.array().cast("array<variant>")).otherwise(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))


def context(c: Column, start: Column, end: Column, around: int = 80) -> Column:
    """The text from ``around`` letters before ``start`` to as many after ``end`` (0-based, exclusive)."""
    lo = F.greatest(start - around, F.lit(0))
    return F.substring(c, lo + 1, end + around - lo)


def triplets(c: Column) -> Column:
    """Relations of a generated text: structs of subject, relation and object, none of them blank."""
    parts = [F.regexp_extract_all(c, F.lit(TRIPLET), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("s", "r", "o"))))
    every = F.transform(zipped, lambda t: F.struct(F.trim(t["s"]).alias("subject"), F.trim(t["r"]).alias("relation"), F.trim(t["o"]).alias("object")))
    return F.filter(every, lambda t: (t["subject"] != "") & (t["relation"] != "") & (t["object"] != ""))


def parse_reply(c: Column, schema: str) -> Column:
    """A JSON object from a reply that may be fenced as code; null where there is none."""
    plain = F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(F.when(F.try_parse_json(plain).isNotNull(), plain), schema)


def canonical_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON object with sorted names."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"k{i:02d}") for i, p in enumerate(parts)))), 256)
