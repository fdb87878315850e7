"""Text scalars: search normalisation, tokens, variants, snippets, comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACE = r"\p{IsWhite_Space}"
# The same characters, spelled out for ``btrim``.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(text: Column) -> Column:
    """Strip white space at both ends (``trim`` alone strips blanks only)."""
    return F.btrim(text, F.lit(SPACES))


def trim_field(name: str) -> Column:
    """:func:`trim_space` of a plain column that may be long: most texts have
    no white space at their ends, and looking at two characters is cheap."""
    edges = F.concat(F.left(name, F.lit(1)), F.right(name, F.lit(1)))
    return F.when(edges.rlike(SPACE), trim_space(F.col(name))).otherwise(F.col(name))


def normalize_text(text: Column) -> Column:
    """Lower case; each run that is no letter or digit becomes one blank."""
    # 'İ' and a final 'Σ' lower to one letter each, as they do rune by rune.
    special = text.contains("İ") | text.contains("Σ")
    lowered = F.lower(F.when(special, F.translate(text, "İΣ", "iσ")).otherwise(text))
    # Naming a-z and 0-9 first spares most characters the property lookup.
    return F.trim(F.regexp_replace(lowered, r"[^a-z0-9\p{L}\p{Nd}]++", " "))


def query_tokens(text: Column) -> Column:
    """Distinct search tokens in first-seen order; empty array for no token."""
    tokens = F.array_distinct(F.split(normalize_text(text), " "))
    return F.filter(tokens, lambda token: token != "")


def singularize(token: Column) -> Column:
    size = F.octet_length(token)
    chars = F.char_length(token)
    return (
        F.when(token.endswith("ies") & (size > 3), F.concat(F.substring(token, F.lit(1), chars - 3), F.lit("y")))
        .when(token.endswith("es") & (size > 2), F.substring(token, F.lit(1), chars - 2))
        .when(token.endswith("s") & (size > 1), F.substring(token, F.lit(1), chars - 1))
        .otherwise(token)
    )


def pluralize(token: Column) -> Column:
    chars = F.char_length(token)
    return (
        F.when(token.endswith("y") & (F.octet_length(token) > 1),
               F.concat(F.substring(token, F.lit(1), chars - 1), F.lit("ies")))
        .when(token.endswith("s"), token)
        .otherwise(F.concat(token, F.lit("s")))
    )


def _synonyms(token: Column) -> Column:
    table = F.create_map(*[
        part
        for key, values in fixed.SYNONYMS.items()
        for part in (F.lit(key), F.array(*[F.lit(value) for value in values]))
    ])
    return F.coalesce(F.try_element_at(table, token), F.array().cast("array<string>"))


def token_variants(token: Column, singular: Column, plural: Column) -> Column:
    """``array<struct<variant, weight>>`` of a token; the first weight wins.

    The forms come in as columns, so that each is worked out once per token.
    """
    def weighted(value: Column, weight: float) -> Column:
        return F.struct(value.alias("variant"), F.lit(weight).alias("weight"))

    forms = F.array_compact(F.array(
        weighted(token, fixed.EXACT_WEIGHT),
        F.when(singular != token, weighted(singular, fixed.SINGULAR_WEIGHT)),
        F.when((plural != token) & (plural != singular), weighted(plural, fixed.PLURAL_WEIGHT)),
    ))
    words = F.array_except(_synonyms(token), F.array(token, singular, plural))
    related = F.transform(words, lambda word: weighted(word, fixed.SYNONYM_WEIGHT))
    return F.when(token.isin(list(fixed.SYNONYMS)), F.concat(forms, related)).otherwise(forms)


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws("\n", *[F.nullif(part, F.lit("")) for part in parts])


def join_parts(*parts: Column) -> Column:
    """The non-empty trimmed parts, one per line."""
    return _joined([trim_space(part) for part in parts])


def result_text() -> Column:
    """Flat text of a search result."""
    return _joined([trim_field(name) for name in (
        "kind", "name", "container", "qualified_name", "signature", "documentation", "body")])


def symbol_search_text() -> Column:
    """Flat text of an extracted symbol."""
    return _joined([trim_field(name) for name in (
        "kind", "name", "container", "qualified_name", "signature", "documentation", "file_context", "body")])


def unix_lines(text: Column) -> Column:
    return trim_space(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def first_lines(text: Column, count: int) -> Column:
    """The first ``count`` lines of the trimmed text."""
    return trim_space(F.array_join(F.slice(F.split(unix_lines(text), "\n"), 1, count), "\n"))


def compact(text: Column, max_chars: int) -> Column:
    """White space collapsed, then cut to ``max_chars`` with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))
    if max_chars <= 0:
        return flat
    cut = F.left(flat, F.lit(max_chars)) if max_chars <= 3 else F.concat(F.left(flat, F.lit(max_chars - 3)), F.lit("..."))
    return F.when(F.char_length(flat) <= max_chars, flat).otherwise(cut)


MARKERS = r"//|/\*|\*|#|--|;"


LEADING_MARKERS, TWO_MARKERS = rf"^(?:(?:{MARKERS})\s*)+", rf"^(?:{MARKERS})\s*(?:{MARKERS})"


def directive_start(candidate: Column, prefixes: list[str]) -> Column:
    """``struct<which, length>`` of the first prefix a normalised line starts
    with, its form without the colon included; null for none."""
    out = F
    for which, prefix in enumerate(prefixes):
        for start in dict.fromkeys([prefix, prefix.strip().removesuffix(":")]):
            if start:
                out = out.when(candidate.startswith(start), F.struct(
                    F.lit(which).alias("which"), F.lit(len(start)).alias("length")))
    return out


COMMENT_PREFIXES = ["///", "/*!", "/**", "//!", "//", "#", "/*", "*/", "*"]


def clean_comment(text: Column) -> Column:
    """Comment text without markers, line by line."""
    def one(line: Column) -> Column:
        out = trim_space(line)
        for marker in COMMENT_PREFIXES:
            out = F.regexp_replace(out, "^" + "".join(f"\\{c}" for c in marker), "")
        return trim_space(F.regexp_replace(out, r"\*/\z", ""))

    return trim_space(F.array_join(F.transform(F.split(unix_lines(text), "\n"), one), "\n"))


def clean_docstring(text: Column) -> Column:
    """A string literal without its quotes, each line trimmed."""
    raw = unix_lines(text)
    bare = F.when(
        raw.rlike(r'(?s)^""".*"""\z') & (F.char_length(raw) >= 6), F.regexp_replace(raw, r'^"""|"""\z', "")
    ).when(
        raw.rlike(r"(?s)^'''.*'''\z") & (F.char_length(raw) >= 6), F.regexp_replace(raw, r"^'''|'''\z", "")
    ).when(
        raw.rlike(r'(?s)^".*"\z') & (F.char_length(raw) >= 2), F.regexp_replace(raw, r'^"|"\z', "")
    ).when(
        raw.rlike(r"(?s)^'.*'\z") & (F.char_length(raw) >= 2), F.regexp_replace(raw, r"^'|'\z", "")
    ).otherwise(raw)
    return trim_space(F.array_join(F.transform(F.split(bare, "\n"), trim_space), "\n"))


def is_constant_name(name: Column) -> Column:
    return name.rlike(r"^[^a-z]+\z")


def go_receiver(text: Column) -> Column:
    """Type name of a Go receiver such as ``(s *Store)``."""
    bare = trim_space(F.replace(F.regexp_replace(trim_space(text), r"^\(|\)\z", ""), F.lit("*"), F.lit("")))
    return F.element_at(F.split(bare, r"\s+"), -1)


def rust_impl_type(text: Column) -> Column:
    bare = trim_space(F.regexp_replace(trim_space(text), "^&", ""))
    return trim_space(F.regexp_replace(bare, "^mut ", ""))


def prefers_lexical(query: Column) -> Column:
    """The router: code-like single words and very short tokens go lexical."""
    text = trim_space(query)
    tokens = query_tokens(text)
    code_like = (
        text.rlike(r"[\p{Nd}/._\-:()\[\]{}]") | (text.rlike(r"\p{Lu}") & text.rlike(r"\p{Ll}"))
    )
    one_word = ~text.rlike(SPACE)
    short = (F.size(tokens) == 1) & (F.char_length(F.get(tokens, F.lit(0))) <= 3)
    return (F.size(tokens) > 0) & ((one_word & code_like) | short)
