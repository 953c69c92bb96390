"""Fill-in-middle transformation: texts cut into units, rearranged around three sentinels, and put back.

A unit grammar is translated to a regular expression of zero width: a boundary lies between
two characters of neighbouring classes, told by a lookbehind and a lookahead. Spark's
``split`` at these boundaries returns the pieces, which joined are the text. Everything is
a Column expression over one row: no shuffle, no Python worker, and a lost task is redone
from its own rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_names

#: Unit grammars: pairs of the classes on the two sides of a boundary.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "line": [(r"\n", r"\s\S")],
    "word": [(r"\x20\x09-\x0D", r"^\x20\x09-\x0D")],
    "token": [(r"\w", r"^\w"), (r"^\w", r"\w")],
    "character": [(r"\s\S", r"\s\S")],
}


def boundary(unit: str) -> str:
    """The zero-width expression of a unit grammar: a boundary is where a pair of its classes meets."""
    return "|".join(f"(?<=[{before}])(?=[{after}])" for before, after in GRAMMARS[unit])


@dataclass(frozen=True)
class Sentinels:
    """The marks of the three parts. No mark may hold the beginning of another or of itself behind its first place, so that the first mark found is the one written."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        own = [self.prefix, self.suffix, self.middle]
        if not all(own) or len(set(own)) < 3:
            raise ValueError("three different marks that aren't empty are needed")
        for a in own:
            for b in own:
                if any(a[k:].startswith(b[: len(a) - k]) for k in range(1, len(a))) or (a != b and a in b):
                    raise ValueError(f"{a!r} and {b!r} can overlap")


def _draw(digest: Column, k: int) -> Column:
    """The ``k``-th (from 1) group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, sentinels: Sentinels = Sentinels(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (``id, n, form, prefix, suffix, middle, output``), one for each, in which a part of the text is moved behind the rest.

    The text is cut into ``n`` units. Two draws set where prefix and middle end, a third
    whether the text is moved at all (``rate`` of a hundred), a fourth the order (``spm`` of
    a hundred suffix first). Draws are groups of the SHA-256 of seed and id, so reruns agree
    and repeated rows get equal outputs. A null id draws as an empty one. Null texts are
    empty ones. An empty text, and one that holds a mark, stays as it is: form ``plain``, null
    parts. Texts of any length are one row's work; columns other than id and text are left out.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("text"), digest.alias("digest"))
    # the empty text has no units, where split would give one
    pieces = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", boundary(unit)))
    rows = rows.withColumn("pieces", pieces).withColumn("n", F.size("pieces").cast("bigint"))
    first, second = _draw(F.col("digest"), 1) % (F.col("n") + 1), _draw(F.col("digest"), 2) % (F.col("n") + 1)
    marked = F.lit(False)
    for mark in (sentinels.prefix, sentinels.suffix, sentinels.middle):
        marked = marked | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | marked | (_draw(F.col("digest"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 4) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select(id_col, "text", "pieces", "n", form.alias("form"), F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("pieces", start, length), ""))

    one, n = F.lit(1), F.col("n").cast("int")
    rows = rows.select(
        id_col, "text", "n", "form", part(one, F.col("a")).alias("prefix"), part(F.col("b") + 1, n - F.col("b")).alias("suffix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle")
    )
    p, s, m = (F.lit(x) for x in (sentinels.prefix, sentinels.suffix, sentinels.middle))
    psm, spm_ = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    return rows.select(id_col, "n", "form", "prefix", "suffix", "middle", output.alias("output"))


def restore(rows: DataFrame, sentinels: Sentinels = Sentinels(), output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """``rows`` with the original text, rebuilt from output and form alone, as column ``to``. A null output or form gives null."""
    x, form = F.col(f"`{output_col}`"), F.col(f"`{form_col}`")
    p, s, m = sentinels.prefix, sentinels.suffix, sentinels.middle

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(x, right, 1), left, -1)

    middle = F.substring_index(x, m, -1)
    text = (
        F.when(form == "plain", x)
        .when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
    )
    return rows.withColumn(to, text)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: Sentinels = Sentinels(), **options) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of each row (see :func:`transform`)."""
    moved = transform(docs, id_col=id_col, text_col=text_col, sentinels=sentinels, **options)
    (to,) = new_names(moved, 1)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    chars = lambda c: F.char_length(c).cast("bigint")
    return restore(moved, sentinels, to=to).select(
        F.col(f"`{id_col}`"), "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), sha("output").alias("output_sha256"), sha(to).alias("restored_sha256")
    )


#: The rows of ``digests(documents)`` in DuckDB.
SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS pieces,
  [CAST(concat('0x', substr(x, 1, 8)) AS BIGINT), CAST(concat('0x', substr(x, 9, 8)) AS BIGINT), CAST(concat('0x', substr(x, 17, 8)) AS BIGINT), CAST(concat('0x', substr(x, 25, 8)) AS BIGINT)] AS h FROM t),
v AS (SELECT *, len(pieces) AS n, least(h[1] % (len(pieces) + 1), h[2] % (len(pieces) + 1)) AS a, greatest(h[1] % (len(pieces) + 1), h[2] % (len(pieces) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, array_to_string(pieces[1:a], '') AS p, array_to_string(pieces[a + 1:b], '') AS m, array_to_string(pieces[b + 1:n], '') AS s FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM w"""
