"""How a line uses what it names: ordered rules per language, compiled to one CASE expression.

The first rule that matches gives the label; a line that none matches is OTHER.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_trace.functions.text import matches, strip
from usage_trace.schema import OTHER

# Patterns and labels, in the order in which they apply. Those of IGNORE_CASE ignore case.
RULES: dict[str, list[tuple[str, str]]] = {
    "java": [
        (r"@\w+\s*\(", "アノテーション"),
        (r"\bstatic\s+final\b", "定数定義"),
        (r"\bif\s*\(|\bwhile\s*\(|\.equals\s*\(|[!=]=", "条件判定"),
        (r"\breturn\b", "return文"),
        (r"\b\w[\w<>\[\]]*\s+\w+\s*=", "変数代入"),
        (r"\w+\s*\(", "メソッド引数"),
    ],
    "kotlin": [
        (r"\bconst\s+val\s+\w+\s*=", "const定数定義"),
        (r"\b(?:val|var)\s+\w+\s*=", "変数代入"),
        (r"\bif\s*\(|\bwhen\s*\(", "条件判定"),
        (r"\breturn\b", "return文"),
        (r"@\w+", "アノテーション"),
        (r"\w+\s*\(", "関数引数"),
    ],
    "c": [
        (r"#\s*define\b", "#define定数定義"),
        (r"\bif\s*\(|strcmp\s*\(|strncmp\s*\(|switch\s*\(", "条件判定"),
        (r"\breturn\b", "return文"),
        (r"\b\w+\s*(?:\[[^\]]*\])?\s*=([^=]|$)", "変数代入"),
        (r"\w+\s*\(", "関数引数"),
    ],
    "proc": [
        (r"(?i)\bEXEC\s+SQL\b", "EXEC SQL文"),
        (r"#\s*define\b", "#define定数定義"),
        (r"\bif\s*\(|strcmp\s*\(|strncmp\s*\(", "条件判定"),
        (r"\breturn\b", "return文"),
        (r"\b\w+\s*(?:\[[^\]]*\])?\s*=([^=]|$)", "変数代入"),
        (r"\w+\s*\(", "関数引数"),
    ],
    "sql": [
        (r"\bRAISE_APPLICATION_ERROR\b|\bEXCEPTION\b", "例外・エラー処理"),
        (r":=|\bCONSTANT\b", "定数・変数定義"),
        (r"\bWHERE\b|\bAND\b.*=|\bOR\b.*=", "WHERE条件"),
        (r"\bDECODE\s*\(|\bCASE\b.*\bWHEN\b", "比較・DECODE"),
        (r"\bINSERT\b|\bUPDATE\b.*\bSET\b|\bVALUES\s*\(", "INSERT/UPDATE値"),
        (r"\bSELECT\b|\bINTO\b", "SELECT/INTO"),
    ],
    "sh": [
        (r"\bexport\b|\bsetenv\b", "環境変数エクスポート"),
        (r"^\s*(?:set\s+)?\w+\s*=([^=]|$)", "変数代入"),
        (r"\bif\s*\[|\bcase\b|[!=]=|\b-eq\b|\b-ne\b|\b-lt\b|\b-gt\b|\b-le\b|\b-ge\b", "条件判定"),
        (r"\becho\b|\bprint\b|\bprintf\b", "echo/print出力"),
        (r"^\s*\w+\s+\S", "コマンド引数"),
    ],
    "ts": [
        (r"\bconst\s+\w+\s*=", "const定数定義"),
        (r"\b(?:let|var)\s+\w+\s*=", "変数代入(let/var)"),
        (r"\bif\s*\(|\bswitch\s*\(|==|!=", "条件判定"),
        (r"\breturn\b", "return文"),
        (r"@\w+", "デコレータ"),
        (r"\w+\s*\(", "関数引数"),
    ],
    "python": [
        (r"^\s*\w+\s*=", "変数代入"),
        (r"\bif\b|\belif\b|==|!=|\bin\b", "条件判定"),
        (r"\breturn\b", "return文"),
        (r"@\w+", "デコレータ"),
        (r"\w+\s*\(", "関数引数"),
    ],
    "perl": [
        (r"\buse\s+constant\b", "use constant定義"),
        (r"\buse\s+\w+\b", OTHER),
        (r"\bif\s*\(|\bunless\s*\(|==|\bne\b|\beq\b", "条件判定"),
        (r"\$\w+\s*=|\bmy\b.*=|\bour\b.*=", "変数代入"),
        (r"\bprint\b|\bsay\b|\bprintf\b", "print/say出力"),
        (r"\w+\s*\(", "関数引数"),
    ],
    "dotnet": [
        (r"\bconst\b|\bConst\b|\breadonly\b", "定数定義(Const/readonly)"),
        (r"\b(?:var|string|int|String)\s+\w+\s*=|\bDim\b.*=", "変数代入"),
        (r"\bif\s*\(|\bIf\b|==|!=|<>|\.Equals\s*\(", "条件判定"),
        (r"\breturn\b|\bReturn\b", "return文"),
        (r"^\s*\[\w+|^\s*<\w+", "属性(Attribute)"),
        (r"\w+\s*\(", "メソッド引数"),
    ],
    "groovy": [
        (r"\bstatic\s+final\b", "static final定数定義"),
        (r"\bdef\s+\w+\s*=|[\w<>\[\]]+\s+\w+\s*=", "変数代入"),
        (r"\bif\s*\(|\bswitch\s*\(|==|!=|\.equals\s*\(", "条件判定"),
        (r"\breturn\b", "return文"),
        (r"@\w+", "アノテーション"),
        (r"\w+\s*\(", "メソッド引数"),
    ],
    "plsql": [
        (r"\bCONSTANT\b|:=", "定数/変数宣言"),
        (r"\bWHEN\b.*\bTHEN\b|\bRAISE\b", "EXCEPTION処理"),
        (r"\bIF\b.*\bTHEN\b|\bCASE\s+WHEN\b", "条件判定"),
        (r"\bCURSOR\b.*\bIS\b", "カーソル定義"),
        (r"\bINSERT\b|\bUPDATE\b.*\bSET\b", "INSERT/UPDATE値"),
        (r"\bWHERE\b", "WHERE条件"),
    ],
    "none": [],
}
IGNORE_CASE = {"sql", "plsql"}


def usage(code: Column, lang: str) -> Column:
    """The label of a line by the rules of one language."""
    line = strip(code)
    chain = None
    for pattern, label in RULES[lang]:
        ignore = lang in IGNORE_CASE or pattern.startswith("(?i)")
        test = matches(line, pattern.removeprefix("(?i)"), ignore)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return F.lit(OTHER) if chain is None else chain.otherwise(F.lit(OTHER))


def usage_by(code: Column, lang: Column, langs: list[str] | None = None) -> Column:
    """The label by the rules of the language that each row names."""
    own = [x for x in langs or RULES if RULES[x]]
    chain = F.when(lang == own[0], usage(code, own[0]))
    return reduce(lambda c, x: c.when(lang == x, usage(code, x)), own[1:], chain).otherwise(F.lit(OTHER))


def rules_table(spark: SparkSession) -> DataFrame:
    """lang, priority, regex, label."""
    rows = [(lang, i, p, label) for lang, rules in RULES.items() for i, (p, label) in enumerate(rules)]
    return spark.createDataFrame(rows, "lang string, priority int, regex string, label string")


def labels(lang: str) -> list[str]:
    """The closed vocabulary of a language."""
    return list(dict.fromkeys([label for _, label in RULES[lang] if label != OTHER] + [OTHER]))
