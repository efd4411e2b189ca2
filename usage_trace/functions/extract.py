"""Names that a line of code defines. Every function gives a string Column, null where nothing is defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usage_trace.functions.text import WORD, capitalised, first, is_constant_case, matches, regex, strip

_C_TYPES = "char|int|short|long|float|double|unsigned|signed|struct|void"
_NOT_EQ = r"(?:[^=]|$)"


def java_name(code: Column) -> Column:
    """Last word left of the first "=", of two at least, without brackets around it."""
    left = strip(F.split(F.regexp_replace(strip(code), ";+$", ""), "=", 2)[0])
    words = F.split(left, regex(r"\s+"))
    name = F.regexp_replace(F.element_at(words, -1), r"^[\[\];(){}<>]+|[\[\];(){}<>]+$", "")
    return F.when((F.size(words) >= 2) & name.rlike(f"^(?!\\p{{N}}){WORD}+$"), name)


def java_is_field(code: Column) -> Column:
    """Looks like a field with modifiers; the scope of a line where no structural index knows better."""
    return matches(strip(code), r"^(?:private|protected|public|static|final|\s)*\s+\w[\w<>\[\]]*\s+\w+\s*[=;]")


def c_variable(code: Column) -> Column:
    return first(code, rf"\b(?:{_C_TYPES})\b\s*\**\s*(\w+)")


def c_define(code: Column) -> Column:
    return first(strip(code), r"^#\s*define\s+(\w+)\s+")


def proc_variable(code: Column) -> Column:
    return first(code, rf"\b(?:{_C_TYPES}|SQLCHAR|SQLINT|VARCHAR)\b\s*\**\s*(\w+)")


def proc_host_variable(code: Column) -> Column:
    return F.coalesce(first(code, r"^\s*strn?cpy\s*\(\s*(\w+)"), first(code, r"^\s*sprintf\s*\(\s*(\w+)"), first(code, r"\bINTO\s*:(\w+)", ignore_case=True), first(code, r'^\s*(\w+)\s*=\s*"'))


def kotlin_const(code: Column) -> Column:
    return first(code, r"\bconst\s+val\s+(\w+)\s*=")


def ts_const(code: Column) -> Column:
    return first(code, rf"\b(?:export\s+)?const\s+(\w+)\s*(?::\s*[^=]+?)?\s*={_NOT_EQ}")


def python_const(code: Column) -> Column:
    name = first(code, rf"^\s*(\w+)\s*(?::\s*[^=]+?)?\s*={_NOT_EQ}")
    return F.when(is_constant_case(name), name)


def perl_const(code: Column) -> Column:
    return first(code, r"\buse\s+constant\s+(\w+)\s*=>")


def perl_const_names(code: Column) -> Column:
    """An array: the keys of a block of constants."""
    body = F.regexp_extract(code, regex(r"\buse\s+constant\s*\{([^}]*)\}"), 1)
    return F.regexp_extract_all(body, F.lit(regex(r"(\w+)\s*=>")), 1)


def perl_our(code: Column) -> Column:
    return first(code, r"\bour\s+\$(\w+)\s*=")


def dotnet_const(code: Column) -> Column:
    patterns = (r"\bconst\s+\w[\w<>]*\s+(\w+)\s*=", r"\bpublic\s+static\s+readonly\s+\w[\w<>]*\s+(\w+)\s*=", r"\bprivate\s+static\s+readonly\s+\w[\w<>]*\s+(\w+)\s*=", r"\bConst\s+(\w+)\s+As\b")
    return F.coalesce(*[first(code, p) for p in patterns])


def groovy_const(code: Column) -> Column:
    return first(code, r"\bstatic\s+final\s+\w[\w<>]*\s+(\w+)\s*=")


def groovy_is_field(code: Column) -> Column:
    return matches(strip(code), r"^(?:(?:private|protected|public)\s+\w[\w<>]*\s+\w+\s*[=;]|def\s+\w+\s*[=;])") & ~code.rlike("^[ \\t]")


def groovy_field(code: Column) -> Column:
    return F.when(groovy_is_field(code), first(strip(code), r"(\w+)\s*[=;]"))


def plsql_const(code: Column) -> Column:
    return first(code, r"^\s*(\w+)\s+CONSTANT\b", ignore_case=True)


def sql_variable(code: Column) -> Column:
    return first(strip(code), r"^\s*(\w+)(?:\s+\w[\w\s\(\),]*?)?\s*:=", ignore_case=True)


def sh_variable(code: Column) -> Column:
    return F.coalesce(first(code, r"^\s*(?:export\s+)?(\w+)\s*="), first(code, r"^\s*set\s+(\w+)\s*="), first(code, r"^\s*setenv\s+(\w+)\s+"))


def getter_of(field: Column) -> Column:
    return capitalised("get", field)


def setter_of(field: Column) -> Column:
    return capitalised("set", field)
