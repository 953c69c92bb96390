"""Unified diffs as tables of changed files and ranges (SC10, EX26, S1, Q15, Q16, Q18)."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.columns import hunk_ranges, language_of, slashes
from ..operators.rows import first_by


def changed_files(diffs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``file_path, language, change_type, diff_text, line_ranges`` from rows of ``ordinal, diff``.

    A diff is the output of ``git diff`` with its patch; rows are its sources in order
    (staged before unstaged), and of a path the first occurrence counts. Only known source
    files stay. Ranges come from the whole diff; ``diff_text`` is cut.
    """
    parts = diffs.select("ordinal", F.posexplode(F.split("diff", r"(?m)^diff --git ")).alias("pos", "part")).where("pos > 0")
    new, old = F.regexp_extract("part", r"(?m)^\+\+\+ b/(.*?)\s*$", 1), F.regexp_extract("part", r"(?m)^--- a/(.*?)\s*$", 1)
    header = F.regexp_extract("part", r"^a/\S+ b/(\S+)", 1)
    path = slashes(F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")), header))
    kind = F.when(F.col("part").rlike(r"(?m)^new file mode"), "added").when(F.col("part").rlike(r"(?m)^deleted file mode"), "deleted").when(F.col("part").rlike(r"(?m)^rename to"), "renamed").otherwise("modified")
    rows = parts.select("ordinal", "pos", path.alias("file_path"), kind.alias("change_type"), F.substring("part", 1, settings.diff_chars).alias("diff_text"), hunk_ranges(F.col("part")).alias("line_ranges"))
    known = rows.withColumn("language", language_of(F.col("file_path"))).where("language is not null")
    return first_by(known, ["file_path"], "ordinal", "pos").select("file_path", "language", "change_type", "diff_text", "line_ranges")


def hunks(changed: DataFrame) -> DataFrame:
    """``file_path, r_start, r_end``; a file without ranges has one row with nulls."""
    return changed.select("file_path", F.explode_outer("line_ranges").alias("r")).select("file_path", "r.r_start", "r.r_end")


def git_diffs(spark: SparkSession, repo: str, mode: str = "head", base: str = "HEAD", compare: str | None = None) -> DataFrame:
    """``ordinal, diff`` of a working copy (SC10): staged then unstaged changes (``head``), two commits (``between``), or the last commit (``recent``).

    git runs where the driver is, on a working copy that somebody works in; its output is
    a handful of rows.
    """
    check_mode(mode, compare)
    commands = {"head": [["--cached"], []], "between": [[base, str(compare)]], "recent": [[f"{base}~1", base]], "methods": [["--cached"], []]}[mode]
    run = lambda args: subprocess.run(["git", "-C", repo, "diff", "--no-color", "--no-ext-diff", *args, "--"], capture_output=True, check=True)
    return spark.createDataFrame([(i, run(args).stdout.decode("utf-8", "replace")) for i, args in enumerate(commands)], "ordinal int, diff string")


def check_mode(mode: str, compare: str | None) -> str:
    """The analysis mode; ``between`` without a second commit is an error (Q18)."""
    if mode not in ("head", "between", "methods", "recent"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "between" and not compare:
        raise ValueError("between needs a commit to compare with")
    return mode
