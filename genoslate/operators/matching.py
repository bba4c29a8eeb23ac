"""Many patterns against many texts: a pattern is tried only where a literal that it needs stands in the text.

From each regular expression the literals are read of which any match holds one. Texts become postings of letter trigrams; each literal is looked up by
its rarest trigram, then as a whole, and only then is the expression tried. Expressions without a literal of three letters are tried on all texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .shared import written

GRAM = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _class_end(pattern: str, at: int) -> int:
    """The place after the character class that begins at ``at``; -1 if it doesn't end."""
    at += 1
    if pattern[at : at + 1] == "^":
        at += 1
    first = True
    while at < len(pattern) and (first or pattern[at] != "]"):
        if pattern[at] == "[":
            at = _class_end(pattern, at)
            if at < 0:
                return -1
        else:
            at += 2 if pattern[at] == "\\" else 1
        first = False
    return at + 1 if at < len(pattern) else -1


def _group_end(pattern: str, at: int) -> int:
    """The place after the group that begins at ``at``; -1 if it doesn't end."""
    depth = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
        elif c == "[":
            at = _class_end(pattern, at)
            if at < 0:
                return -1
        else:
            depth += (c == "(") - (c == ")")
            at += 1
            if not depth:
                return at
    return -1


def literals(pattern: str | None) -> list[str] | None:
    """Texts of which every match of ``pattern`` holds one, lowered (A-Z); None where none of three letters can be told.

    Each alternative gives its longest run of plain characters. What stands in groups or classes is passed over, and so is anything unusual.
    """
    if pattern is None or "\\Q" in pattern or "(?x" in pattern:
        return None
    best: list[str] = [""]
    run = ""
    at = 0

    def close() -> None:
        nonlocal run
        if len(run) > len(best[-1]):
            best[-1] = run
        run = ""

    while at < len(pattern):
        c = pattern[at]
        if c == "|":
            close()
            best.append("")
            at += 1
            continue
        if c in "([":
            close()
            at = (_group_end if c == "(" else _class_end)(pattern, at)
            if at < 0:
                return None
            atom = None
        elif c == "\\":
            after = pattern[at + 1 : at + 2]
            if not after:
                return None
            atom = None if after.isalnum() else after
            if atom is None:
                close()
                if after in "pPxukcN0123456789":  # escapes that go on
                    return None
            at += 2
        elif c in ".^$":
            close()
            atom = None
            at += 1
        else:
            atom = c
            at += 1
        after = pattern[at : at + 1]
        if after and after in "*?{":
            close()  # the atom may be missing
            end = pattern.find("}", at) if after == "{" else at
            if end < 0:
                return None
            at = end + 1
            while pattern[at : at + 1] in ("?", "+"):
                at += 1
        elif after == "+":
            run += atom or ""
            close()
            at += 1
            while pattern[at : at + 1] in ("?", "+"):
                at += 1
        elif atom is not None:
            run += atom
    close()
    lowered = [x.translate(str.maketrans(UPPER, LOWER)) for x in best]
    return lowered if all(len(x) >= GRAM for x in lowered) else None


@F.pandas_udf(ArrayType(StringType()))
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(literals)


def lowered(text: Column) -> Column:
    """``text`` with A-Z lowered, as expressions that ignore case see it."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def candidates(texts: DataFrame, patterns: DataFrame, group: str, text: str, key: str, pattern: str, number: str) -> DataFrame:
    """(key, number): the texts (``group``, ``key``, ``text``) on which the patterns (``group``, ``number``, ``pattern``) have to be tried.

    Each pair comes once. Rows of different groups never meet; a null group meets none.
    """
    rules = written(patterns.select(F.col(group).alias("__g"), F.col(number).alias("__n"), _literals(F.col(pattern)).alias("__all")), "literals")
    low = texts.select(F.col(group).alias("__g"), F.col(key).alias("__k"), lowered(F.col(text)).alias("__low"))
    postings = written(low.select("__g", "__k", "__low", F.explode(grams(F.col("__low"))).alias("__gram")).join(
        rules.select("__g", F.explode("__all").alias("__lit")).select("__g", F.explode(grams(F.col("__lit"))).alias("__gram")).distinct(), ["__g", "__gram"], "left_semi"
    ), "postings")
    often = postings.groupBy("__g", "__gram").agg(F.count("*").alias("__often"))
    single = rules.select("__g", "__n", F.explode("__all").alias("__lit"))
    asked = single.withColumn("__gram", F.explode(grams(F.col("__lit")))).join(often, ["__g", "__gram"], "left")
    # a trigram that no text holds is the rarest: its literal stands nowhere
    rarest = asked.groupBy("__g", "__n", "__lit").agg(F.min_by("__gram", F.struct(F.coalesce("__often", F.lit(0)), "__gram")).alias("__gram"))
    met = postings.join(rarest, ["__g", "__gram"]).filter(F.contains(F.col("__low"), F.col("__lit")))
    free = rules.filter(F.col("__all").isNull()).select("__g", "__n")
    every = low.select("__g", "__k").join(free, "__g")
    return met.select("__k", "__n").distinct().unionByName(every.select("__k", "__n")).withColumnsRenamed({"__k": key, "__n": number})
