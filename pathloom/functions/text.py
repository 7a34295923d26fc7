"""String, list-literal and entity-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- fixed values: spellings that stand for an absent value, and blanks to strip ---
MISSING_TEXT = ("", "nan", "none", "null")
MISSING_SMILES = ("", "NOT_FOUND", "ERROR")
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# --- end of fixed values ---


def strip(col: Column | str) -> Column:
    """Text without blanks of any kind at its ends."""
    return F.trim(_c(col), F.lit(BLANKS))


def collapse_spaces(col: Column | str) -> Column:
    return strip(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def normalize_text(col: Column | str, collapse: bool = False) -> Column:
    """Lookup form of a string: trimmed, lower case, null as empty."""
    text = collapse_spaces(col) if collapse else strip(col)
    return F.coalesce(F.lower(text), F.lit(""))


def is_missing_text(col: Column | str) -> Column:
    text = _c(col).cast("string")
    return text.isNull() | F.lower(strip(text)).isin(*MISSING_TEXT)


def safe_text(col: Column | str, default: str | Column | None = "") -> Column:
    """Trimmed text, or ``default`` for every spelling of an absent value."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(is_missing_text(col), fallback).otherwise(strip(_c(col).cast("string")))


def is_missing_smiles(col: Column | str) -> Column:
    text = _c(col)
    return text.isNull() | strip(text).isin(*MISSING_SMILES)


def id_suffix(col: Column | str) -> Column:
    """Text after the first ``::``; the whole id when there is none."""
    return F.regexp_replace(_c(col), r"(?s)^.*?::", "")


def numeric_suffix(col: Column | str) -> Column:
    """Trailing digits, or null."""
    return F.nullif(F.regexp_extract(_c(col), r"(\d+)$", 1), F.lit(""))


def text_preview(col: Column | str, n: int = 300) -> Column:
    return F.left(_c(col), F.lit(n))


def tokens(col: Column | str) -> Column:
    """Lower-case alphanumeric runs."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit("([a-z0-9]+)"), F.lit(1))


def token_text(col: Column | str) -> Column:
    return F.array_join(tokens(col), " ")


def segments(col: Column | str) -> Column:
    """Sentence pieces between full stops, blanks dropped."""
    pieces = F.split(strip(col), r"\s*[.]\s*")
    return F.filter(pieces, lambda p: p != "")


def join_segments(col: Column) -> Column:
    """Pieces as sentences; an empty list stays empty text."""
    return F.when(F.size(col) > 0, F.concat(F.array_join(col, ". "), F.lit("."))).otherwise(F.lit(""))


def chunks(col: Column | str) -> Column:
    """Ordered distinct entries of a loosely delimited list cell."""
    raw = strip(_c(col).cast("string"))
    flat = F.regexp_replace(F.regexp_replace(raw, "\n", " "), r"^[\[\]]+|[\[\]]+$", "")
    pieces = F.split(flat, r";|\||,(?=\s*[A-Za-z0-9])")
    pieces = F.when(F.size(pieces) == 1, F.split(flat, r"'\s+'|\"\s+\"")).otherwise(pieces)
    cleaned = F.transform(
        pieces, lambda p: collapse_spaces(F.regexp_replace(strip(p), "^['\"]+|['\"]+$", ""))
    )
    kept = F.filter(cleaned, lambda p: ~F.lower(p).isin("", "nan", "none"))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


# --- fixed values: an item of a list literal, and a whole literal ---
LIST_ITEM = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|[^\s,'"\[\](){}]++"""
LIST_LITERAL = rf"(?s)^[\[({{]\s*+(?:(?:{LIST_ITEM})\s*+(?:,\s*+|(?=[\])}}])))*+[\])}}]$"
# --- end of fixed values ---


def list_literal(col: Column | str) -> Column:
    """Ordered distinct items of a list, tuple or set literal such as ``['a', "b's"]``.

    Items may be quoted either way, with escapes, or bare. A cell that is no
    literal is cut at commas, quotes and wide gaps instead.
    """
    raw = safe_text(col)

    def bare(item: Column) -> Column:
        quoted = item.startswith("'") | item.startswith('"')
        inside = F.regexp_replace(F.substr(item, F.lit(2), F.length(item) - 2), r"\\(['\"\\])", "$1")
        return F.when(quoted, inside).otherwise(item)

    items = F.transform(F.regexp_extract_all(raw, F.lit(f"(?s){LIST_ITEM}"), F.lit(0)), bare)
    loose = F.split(F.translate(raw, "[]\n", "   "), r"[,'\"]+|\s{2,}")
    trimmed = F.transform(F.when(raw.rlike(LIST_LITERAL), items).otherwise(loose), strip)
    kept = F.filter(trimmed, lambda p: ~is_missing_text(p))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def comma_items(col: Column | str) -> Column:
    """Trimmed non-empty items of a comma separated cell."""
    items = F.transform(F.split(_c(col).cast("string"), ","), strip)
    return F.filter(items, lambda p: p != "")


def base_text(name: Column | str, node_type: Column | str, type_prefix: bool = True) -> Column:
    clean = strip(name)
    return F.concat(_c(node_type), F.lit(": "), clean) if type_prefix else clean


def compose_text(strategy: str, base: Column, rich: Column, graph: Column) -> tuple[Column, Column]:
    """(text, source tag) under one of the four text strategies."""
    if strategy == "name_only":
        return base, F.lit("name_only")
    if strategy in ("graph_context_only", "rich_text_only"):
        extra, tag = (graph, "name+graph_context") if strategy == "graph_context_only" else (rich, "name+rich_text")
        has = F.coalesce(extra, F.lit("")) != ""
        return (
            F.when(has, F.concat(base, F.lit(". "), extra)).otherwise(base),
            F.when(has, F.lit(tag)).otherwise(F.lit("name_only_fallback")),
        )
    if strategy != "hybrid":
        raise ValueError(f"unknown text strategy: {strategy}")
    has_rich = F.coalesce(rich, F.lit("")) != ""
    has_graph = F.coalesce(graph, F.lit("")) != ""
    parts = F.transform(F.array(base, F.coalesce(rich, F.lit("")), F.coalesce(graph, F.lit(""))), strip)
    text = F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " ")
    tag = F.concat_ws(
        "+", F.lit("name"), F.when(has_rich, F.lit("rich_text")), F.when(has_graph, F.lit("graph_context"))
    )
    return text, tag


def disease_text(name: Column, ancestors: Column, definition: Column, label: str = "Ancestors") -> Column:
    """``Disease: n. Ancestors: a. Definition: d.`` with absent parts left out."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("Disease: "), name, F.lit(".")),
        F.when(~is_missing_text(ancestors), F.concat(F.lit(f"{label}: "), ancestors, F.lit("."))),
        F.when(~is_missing_text(definition), F.concat(F.lit("Definition: "), definition, F.lit("."))),
    )


# --- fixed values: wording of the fallback sentences ---
FALLBACK_SENTENCES = {
    "disease": ("This disease", "is a medical condition."),
    "drug": ("This drug", "is a pharmacological agent."),
}
# --- end of fixed values ---


def text_to_encode(name: Column, mechanism: Column, kind: str = "disease") -> Column:
    """Mechanism text when there is one, else a sentence saying what the entity is."""
    subject, predicate = FALLBACK_SENTENCES[kind]
    sentence = F.concat(safe_text(name, subject), F.lit(f" {predicate}"))
    return F.when(is_missing_text(mechanism), sentence).otherwise(strip(mechanism))


GO_SCHEMA = "struct<MF:string,BP:string>"


def go_terms(branch: Column) -> Column:
    """Ordered distinct ``term`` fields of a JSON object or list of objects."""
    items = F.coalesce(
        F.when(F.trim(branch).startswith("["), F.from_json(branch, "array<struct<term:string>>")),
        F.when(F.trim(branch).startswith("{"), F.array(F.from_json(branch, "struct<term:string>"))),
    )
    terms = F.transform(items, lambda i: safe_text(i["term"]))
    return F.coalesce(
        F.array_distinct(F.filter(terms, lambda t: t != "")), F.array().cast("array<string>")
    )


def gene_text(symbol: Column, name: Column, summary: Column, mf: Column, bp: Column, fallback: Column) -> Column:
    """One line per gene: names, summary, then the two lists of annotation terms."""
    none = F.lit(None).cast("string")
    names = F.concat_ws(" ", safe_text(symbol, none), safe_text(name, none))
    primary = F.when(names == "", safe_text(fallback, "Unknown")).otherwise(names)
    extras = [safe_text(F.array_join(terms, ", "), none) for terms in (mf, bp)]
    return collapse_spaces(F.concat_ws(". ", primary, safe_text(summary, none), *extras))
