"""Lines as words. "Name N stands in a line as a whole word" is "N is one of the line's maximal runs of word characters", so any number of names is looked for by one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_trace.functions.text import SPACE, WORD

_TOKEN = rf"\$?{WORD}+(?:{SPACE}*\()?"
_SHELL = r"\$\{?([A-Za-z0-9_]+)"
#: Characters by which texts and names are brought together before they are compared.
GRAM = 3


def tokens(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """filepath, lineno, tok, sigil (follows "$"), paren (is followed by "("), one row per occurrence; keep: more columns of lines."""
    found = F.posexplode(F.regexp_extract_all("line", F.lit(_TOKEN), 0)).alias("pos", "m")
    rows = lines.select("filepath", "lineno", *(keep or []), found)
    return rows.select("filepath", "lineno", *(keep or []), "pos", F.regexp_extract("m", rf"{WORD}+", 0).alias("tok"), F.startswith("m", F.lit("$")).alias("sigil"), F.endswith("m", F.lit("(")).alias("paren"))


def line_words(lines: DataFrame, ignore_case: bool = False, variables: bool = False, keep: list[str] | None = None) -> DataFrame:
    """filepath, lineno, tok: each word of a line once, or each name of $NAME and ${NAME (variables; ASCII)."""
    found = F.regexp_extract_all("line", F.lit(_SHELL), 1) if variables else F.regexp_extract_all("line", F.lit(f"{WORD}+"), 0)
    found = F.transform(found, F.lower) if ignore_case else found
    return lines.select("filepath", "lineno", *(keep or []), F.explode(F.array_distinct(found)).alias("tok"))


def shell_variables(lines: DataFrame) -> DataFrame:
    """filepath, lineno, tok for each $NAME and ${NAME; NAME is ASCII."""
    return lines.select("filepath", "lineno", F.explode(F.regexp_extract_all("line", F.lit(_SHELL), 1)).alias("tok"))


def occurrences(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of tokens whose tok is in names (name)."""
    return tokens(lines).join(names.select(F.col("name").alias("tok")).distinct(), "tok", "left_semi")


def _holding(texts: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Rows of texts (their column text) with a name in them, once for each name: joined by a gram of the name, then compared."""
    found = None
    for k in range(1, GRAM + 1):
        own = names.where(F.length("name") >= k if k == GRAM else F.length("name") == k).select("name", F.substring("name", 1, k).alias("__ut_gram"))
        starts = F.sequence(F.lit(1), F.length(text) - (k - 1))
        grams: Column = F.when(F.length(text) >= k, F.array_distinct(F.transform(starts, lambda i: F.col(text).substr(i, F.lit(k)))))  # noqa: B023
        met = texts.select("*", F.explode(grams).alias("__ut_gram")).join(own, "__ut_gram").where(F.contains(text, "name")).drop("__ut_gram", "name")
        found = met if found is None else found.unionByName(met)
    return found


def prefilter(lines: DataFrame, names: DataFrame, ascii_only: bool = True) -> DataFrame:
    """filepath of files in which one of the names stands as a part of a line, whatever is around it.

    With ascii_only, names beyond ASCII aren't looked for, and if none is left every file stays. A name of word characters is in a
    line exactly if it is in one of the line's words, so such names are compared to the tree's distinct words, and others to
    lines. Whole-word traces need no filter, as their join drops the rest.
    """
    wanted = names.select("name").where("name <> ''").distinct()
    plain = wanted.where(~F.col("name").rlike(r"[^\x00-\x7F]")) if ascii_only else wanted
    if plain.isEmpty():
        return lines.select("filepath").distinct()
    is_word = F.col("name").rlike(f"^{WORD}+$")
    words = line_words(lines).select("filepath", "tok").distinct()
    held = _holding(words.select("tok").distinct(), plain.where(is_word), "tok").distinct()
    by_word = words.join(held, "tok", "left_semi").select("filepath")
    odd = plain.where(~is_word)
    if odd.isEmpty():
        return by_word.distinct()
    return by_word.unionByName(_holding(lines.select("filepath", "line"), odd, "line").select("filepath")).distinct()
