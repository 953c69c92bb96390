"""Column expressions: the scalar rules of the unit and search model, all inside code generation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, LANGUAGES, SKIP_DIRS, SKIP_FRAGMENTS, SKIP_NAMES, WATCH_SKIP_DIRS, Settings

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def falsy(value: Column, other: Column) -> Column:
    """``value``, or ``other`` where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), other)


def slashes(path: Column) -> Column:
    """Path with forward slashes."""
    return F.translate(path, "\\", "/")


def ascii_fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def contains_like(text: Column, word: Column) -> Column:
    """Substring LIKE that folds A-Z only; ``%`` and ``_`` of the word act as wildcards (F8, Q20)."""
    pattern = F.concat(F.lit("%"), F.replace(ascii_fold(word), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.call_function("like", ascii_fold(text), pattern)


def file_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def language_of(path: Column) -> Column:
    """Language by lower-cased suffix, else null (F3, SC17)."""
    suffix = F.regexp_extract(F.lower(file_name(path)), r"[^/](\.[^./]*)$", 1)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, suffix)


def in_skipped_folder(path: Column, folders: tuple[str, ...] = SKIP_DIRS) -> Column:
    """Whether any part of the path is one of the folders (F1; F12 with its own list)."""
    return F.arrays_overlap(F.split(F.lower(slashes(path)), "/"), F.array(*map(F.lit, folders)))


def third_party(path: Column, language: Column, size: Column, settings: Settings = DEFAULT) -> Column:
    """Library files by name, by place and by size (F2). Fragments with capitals never match a lower-cased path (Q13)."""
    name, low = F.lower(file_name(path)), F.lower(slashes(path))
    # plain comparisons are compiled, and find the lower-cased path once; a lambda over a list would find it for every entry
    by_name = reduce(or_, [F.contains(name, F.lit(k)) for k in SKIP_NAMES])
    by_place = reduce(or_, [F.contains(low, F.lit(k)) for k in SKIP_FRAGMENTS])
    by_size = (language.isin("javascript", "jsp") & (size > settings.max_script_bytes)) | ((language == "java") & (size > settings.max_java_bytes))
    return by_name | by_place | F.coalesce(by_size, F.lit(False))


def watched(path: Column) -> Column:
    """Source file outside tool folders (F12); the suffix is always lower-cased (Q15)."""
    return language_of(path).isNotNull() & ~in_skipped_folder(path, WATCH_SKIP_DIRS)


def filled_lines(body: Column) -> Column:
    """Number of lines that hold more than white space."""
    return F.size(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")).cast("int")


def embeddable(unit_type: Column, name: Column, body: Column, calls: Column, settings: Settings = DEFAULT) -> Column:
    """Whether a unit is worth a vector (F5). ``calls``: number of calls it makes."""
    lines, low = filled_lines(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    accessor = F.lit(False)
    for prefix in settings.accessor_prefixes:
        accessor = accessor | low.startswith(prefix)
    return (
        (F.coalesce(unit_type, F.lit("")) != "el_expression")
        & (lines > 0)
        & ~((lines <= 1) & (calls == 0))
        & ~(accessor & (lines <= settings.min_body_lines) & (calls == 0))
    )


def trivial_name(name: Column) -> Column:
    """Setter or getter with more than the prefix."""
    return F.coalesce((name.startswith("set") | name.startswith("get")) & (F.char_length(name) > 3), F.lit(False))


def language_of_query(text: Column) -> Column:
    """ja if the text has kana, zh if it has Han characters, else en."""
    return F.when(text.rlike("[\\u3040-\\u30ff\\u31f0-\\u31ff]"), "ja").when(text.rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en")


def signature_text(signature: Column, name: Column) -> Column:
    return falsy(signature, F.coalesce(name, F.lit("")))


def context_text(signature: Column, name: Column, comment: Column, params: Column, body: Column) -> Column:
    """Signature, 200 characters of comment, parameters and 300 of body, those that aren't empty (F16)."""
    parts = [signature_text(signature, name), F.substring(comment, 1, 200), F.array_join(params, " "), F.substring(body, 1, 300)]
    return F.trim(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def rerank_text(signature: Column, qualified_name: Column, summary: Column, body: Column) -> Column:
    """Signature or qualified name, summary and 1500 characters of body, a line each."""
    text = F.concat_ws("\n", falsy(signature, qualified_name), F.coalesce(summary, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 1500))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def camel_words(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "([A-Z])", " $1"))


def short_name(qualified_name: Column) -> Column:
    """What follows the last ``#``."""
    return F.substring_index(qualified_name, "#", -1)


def callee_patterns(qualified_name: Column, settings: Settings = DEFAULT) -> Column:
    """Names an edge may call a node by: its own, and the short one if it is long and special enough (G1, Q1)."""
    short = short_name(qualified_name)
    special = (F.char_length(short) > settings.short_name_length) & ~short.isin(*settings.general_names) & (short != qualified_name)
    return F.when(special, F.array(qualified_name, short)).otherwise(F.array(qualified_name))


def display_name(qualified_name: Column) -> Column:
    """Last class segment with ``#method``, else the last two dotted segments."""
    with_method = F.concat(F.substring_index(F.substring_index(qualified_name, "#", 1), ".", -1), F.lit("#"), short_name(qualified_name))
    return F.when(F.contains(qualified_name, F.lit("#")), with_method).otherwise(F.substring_index(qualified_name, ".", -2))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, 100 at most, 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.round(100.0 * done / total).cast("int"))).otherwise(0).cast("int")


def fingerprint(signature: Column, body: Column) -> Column:
    """MD5 of signature and body with white space collapsed (ST4)."""
    joined = F.concat(F.coalesce(signature, F.lit("")), F.coalesce(body, F.lit("")))
    return F.md5(F.trim(F.regexp_replace(joined, r"[ \t\n\x0B\f\r]+", " ")))


def point_id(repo_id: Column, qualified_name: Column) -> Column:
    """Vector id of a unit (K4)."""
    return F.md5(F.concat_ws("::", repo_id.cast("string"), qualified_name))


def hunk_ranges(diff: Column) -> Column:
    """Line ranges of a diff's new side, from its headers: (start, start + count), count 1 if it isn't given (EX26, Q17)."""
    header = F.lit(r"@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@")
    starts, counts = F.regexp_extract_all(diff, header, F.lit(1)), F.regexp_extract_all(diff, header, F.lit(2))
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(1))
    return F.zip_with(starts, counts, lambda s, n: F.struct(s.cast("int").alias("r_start"), (s.cast("int") + number(n)).alias("r_end")))


def inner_product(a: Column, b: Column) -> Column:
    """In double precision; null if lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
