"""Retrieval documents, query texts, model profiles, identity keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .paths import base_name
from .text import trim_space


def normalize_embedding_text(text: Column) -> Column:
    """Valid text without NUL, trimmed, with Unix line ends.

    Single characters are replaced as they are: of a text without them a
    search of its bytes is all that is done, where a pattern would first decode it.
    """
    out = F.make_valid_utf8(text)
    for old in ("\ufffd", "\x00"):
        out = F.replace(out, F.lit(old), F.lit(""))
    out = trim_space(out)
    for old in ("\r\n", "\r"):
        out = F.replace(out, F.lit(old), F.lit("\n"))
    return out


def build_documents(symbols: DataFrame, profile: Column) -> DataFrame:
    """Symbols with their retrieval ``document``: a title and a labelled block.

    The fields are cleaned in a projection of their own, so that each text is
    gone through once however often the document mentions it.
    """
    fields = ["kind", "name", "qualified_name", "signature", "documentation", "file_context", "body"]
    clean = symbols.select("*", profile.alias("profile_"), *[
        normalize_embedding_text(F.col(name)).alias(f"{name}_") for name in [*fields, "path"]],
        normalize_embedding_text(base_name(F.col("path"))).alias("base_"))

    def labelled(label: str, name: str, keep: Column | None = None) -> Column:
        value = F.col(f"{name}_")
        shown = value != "" if keep is None else (value != "") & keep
        return F.when(shown, F.concat(F.lit(label), value)).otherwise(F.lit(""))

    body = F.concat(
        F.lit("Path: "), F.col("path_"),
        labelled("\nKind: ", "kind"),
        labelled("\nName: ", "name"),
        labelled("\nQualified name: ", "qualified_name", F.col("qualified_name_") != F.col("name_")),
        labelled("\nSignature:\n", "signature"),
        labelled("\nDocumentation:\n", "documentation"),
        labelled("\nFile context:\n", "file_context"),
        labelled("\nBody snippet:\n", "body"),
    )
    base = F.when(F.col("base_") == "", F.lit("none")).otherwise(F.col("base_"))
    title = F.replace(
        F.when(F.col("qualified_name_") != "", F.concat_ws(" ", base, "qualified_name_")).otherwise(base), F.lit("|"), F.lit("/"))
    title = F.when(title.isin(".", "/"), F.lit("symbol")).otherwise(title)
    gemma = F.col("profile_") == "gemma"
    document = F.concat(
        F.when(gemma, F.lit("title: ")).otherwise(F.lit("Title: ")), title,
        F.when(gemma, F.lit(" | text: ")).otherwise(F.lit("\n")), body)
    return clean.select(*symbols.columns, document.alias("document"))


def format_query(profile: Column, text: Column) -> Column:
    clean = normalize_embedding_text(text)
    return (
        F.when(profile == "gemma", F.concat(F.lit(fixed.GEMMA_QUERY_PREFIX), clean))
        .when(profile == "qwen", F.concat(F.lit(f"Instruct: {fixed.QWEN_INSTRUCTION}\nQuery: "), clean))
        .otherwise(clean)
    )


def profile_revision(profile: Column) -> Column:
    out = F
    for name, revision in fixed.PROFILE_REVISIONS.items():
        out = out.when(profile == name, F.lit(revision))
    return out


def resolve_profile(model: Column) -> Column:
    """Profile of a model name or path: alias, then path, then substring."""
    full = F.lower(trim_space(model))
    token = F.regexp_replace(full, "[-_ ]", "")
    name = base_name(full)

    def known(profile: str) -> Column:
        return token.isin([alias.replace("-", "") for alias in fixed.MODEL_ALIASES[profile]])

    qwen_embed = full.contains("qwen3") & full.contains("embed")
    return (
        F.when(known("gemma"), "gemma")
        .when(known("qwen"), "qwen")
        .when(full.contains("embeddinggemma"), "gemma")
        .when(name.contains("qwen3-embedding") | name.contains("qwen3embedding") | qwen_embed, "qwen")
        .when(full.contains("gemma"), "gemma")
        .otherwise("generic")
    )


def resolve_model_id(model: Column) -> Column:
    """Catalogue id of a known model, null for any other."""
    full = F.lower(trim_space(model))
    token = F.regexp_replace(full, "[-_ ]", "")
    out = F
    for profile, aliases in fixed.MODEL_ALIASES.items():
        out = out.when(token.isin([alias.replace("-", "") for alias in aliases]), F.lit(fixed.MODEL_IDS[profile]))
    return out


def normalize_mode(mode: Column) -> Column:
    """auto, semantic or lexical; null for anything else."""
    clean = F.lower(trim_space(mode))
    return F.when(clean.isin("", "auto"), "auto").when(clean.isin("semantic", "lexical"), clean)


def normalize_provider(provider: Column) -> Column:
    clean = F.lower(trim_space(provider))
    out = F
    for alias, name in fixed.PROVIDER_ALIASES.items():
        out = out.when(clean == alias, F.lit(name))
    return out


def stable_symbol_id() -> Column:
    """Identity of a symbol in its file, independent of its line."""
    payload = F.concat_ws(
        "\n", trim_space(F.lower(F.col("kind"))), trim_space(F.col("qualified_name")), trim_space(F.col("signature"))
    )
    fallback = F.concat_ws("\n", trim_space(F.col("name")), F.col("line").cast("string"))
    return F.md5(F.when(payload == "\n\n", fallback).otherwise(payload))


def embedding_hash(profile: Column, document: Column) -> Column:
    header = F.concat(F.lit(fixed.DOCUMENT_HASH_HEADER), profile_revision(profile), F.lit("\n"))
    return F.md5(normalize_embedding_text(F.concat(header, document)))


def embedding_key() -> Column:
    return F.concat_ws("|", F.col("provider"), F.col("model_id"), F.col("embedding_hash"))


def scanner_fingerprint(search_prefix: Column, context_prefix: Column, excludes: Column) -> Column:
    """Digest of the scanner's settings; the order of ``excludes`` is moot."""
    payload = F.concat_ws(
        "\x1f", F.lit(fixed.FINGERPRINT_VERSION), trim_space(search_prefix), trim_space(context_prefix),
        F.array_join(F.array_sort(excludes), "\x00"),
    )
    return F.concat(F.lit(fixed.FINGERPRINT_VERSION + ":"), F.md5(payload))


def fingerprint_of(search_prefix: str, context_prefix: str, excludes: Iterable[str]) -> Column:
    values = F.array(*[F.lit(value) for value in excludes]).cast("array<string>")
    return scanner_fingerprint(F.lit(search_prefix), F.lit(context_prefix), values)
