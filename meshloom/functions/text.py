"""Text expressions for names, labels and API replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a label is marked in a material's name, at its end or in brackets.
LABEL_COMMENT = r"(?i)#\s*label:\s*(.+)$"
LABEL_BRACKET = r"(?i)\[LABEL:([^\]]+)\]"

# Fixed value: what counts as white space in names and labels.
SPACE = r"[\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Marks that have a meaning in a regular expression.
_MARKS = re.compile(r"([\\.^$|?*+()\[\]{}])")


def trimmed(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse_ws(text: Column) -> Column:
    """Runs of white space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def norm_name(name: Column) -> Column:
    """A node's name with ``_``, ``-`` and ``>`` read as blanks; null for a null name."""
    return collapse_ws(F.regexp_replace(name, r"[_\->]", " "))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole name if it has none."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def label_from_material(name: Column) -> Column:
    """The label in a material's name, written as a comment at its end or in brackets; else null."""
    found = [F.nullif(trimmed(F.regexp_extract(name, p, 1)), F.lit("")) for p in (LABEL_COMMENT, LABEL_BRACKET)]
    return F.coalesce(*found)


def keyword_pattern(keywords: list[str], literal: bool = False) -> str | None:
    """One pattern for all keywords: any case, any white space where a keyword has some; None without keywords.

    Keywords are regular expressions, unless ``literal``.
    """
    kept = [k.strip() for k in keywords if k and k.strip()]
    if literal:
        kept = [_MARKS.sub(r"\\\1", k) for k in kept]
    return "(?iU)(?:" + "|".join(re.sub(r"\s+", r"\\s+", k) for k in kept) + ")" if kept else None


def has_keyword(text: Column, keywords: list[str], literal: bool = False) -> Column:
    """Does the text hold one of the keywords? False for a null text."""
    pattern = keyword_pattern(keywords, literal)
    return F.coalesce(text.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def keyword_rule(keywords: DataFrame, literal: bool = False) -> Column:
    """The pattern of ``keyword_pattern`` for a table ``(keyword)``, as a value that Spark computes once and sends to all tasks.

    Null without keywords. The table is one of settings: its texts become one pattern.
    """
    word = trimmed(F.col("keyword"))
    part = F.regexp_replace(word, r"([\\.^$|?*+()\[\]{}])", r"\\$1") if literal else word
    parts = keywords.where(word != "").select(F.regexp_replace(part, rf"{SPACE}+", r"\\s+").alias("part")).distinct()
    return parts.agg(F.concat(F.lit("(?iU)(?:"), F.nullif(F.array_join(F.array_sort(F.collect_list("part")), "|"), F.lit("")), F.lit(")"))).scalar()


def has_keyword_of(text: Column, keywords: DataFrame, literal: bool = False) -> Column:
    """Does the text hold one of the keywords of a table? False for a null text, or without keywords."""
    return F.coalesce(F.rlike(text, keyword_rule(keywords, literal)), F.lit(False))


def describe_error(code: Column, *messages: Column, default: str = "unknown error") -> Column:
    """The first message that isn't blank, else ``default``; behind the code in brackets, where there is one."""
    said = F.coalesce(*(F.nullif(trimmed(m), F.lit("")) for m in messages), F.lit(default))
    return F.when(code.isNotNull(), F.concat(F.lit("["), code.cast("string"), F.lit("] "), said)).otherwise(said)


def label_status(has_labels: Column, status: Column) -> Column:
    """labeled, processing, failed or unlabeled; labels win over a status."""
    return (
        F.when(F.coalesce(has_labels, F.lit(False)), "labeled")
        .when(status.isin("processing", "uploading"), "processing")
        .when(status.isin("error", "failed"), "failed")
        .otherwise("unlabeled")
    )


def parse_response(body: Column) -> Column:
    """An API reply as struct(text, prompt_tokens, completion_tokens, total_tokens, error).

    The content of the first choice is a string, or an array whose text parts are
    joined. Without choices, or if the body isn't JSON, ``error`` says so and the
    text is empty.
    """
    reply = F.try_parse_json(body)
    content = F.try_variant_get(reply, "$.choices[0].message.content", "variant")
    parts = F.try_variant_get(content, "$", "array<struct<type string, text string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "")
    text = trimmed(F.coalesce(F.when(parts.isNotNull(), joined), F.try_variant_get(content, "$", "string"), F.lit("")))
    tokens = lambda name: F.coalesce(F.try_variant_get(reply, f"$.usage.{name}", "long"), F.lit(0).cast("long"))
    error = F.when(reply.isNull(), "no JSON").when(F.try_variant_get(reply, "$.choices[0]", "variant").isNull(), "no choices")
    return F.struct(
        F.when(error.isNull(), text).otherwise("").alias("text"),
        tokens("prompt_tokens").alias("prompt_tokens"),
        tokens("completion_tokens").alias("completion_tokens"),
        tokens("total_tokens").alias("total_tokens"),
        error.alias("error"),
    )
