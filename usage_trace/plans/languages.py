"""What the engine knows of each language, as data.

A Seed says which direct uses start a trace (by label and extractor) and where their names are looked for. A new
language is one more LanguageSpec passed to trace(..., specs=...), with its rules in functions.classify.RULES and, where
seeds aren't enough, a function that makes its tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_trace.functions import extract as x


@dataclass(frozen=True)
class Seed:
    """kind: const, field, local or alias-following const ("define"); names: Column -> Column of a name or an array."""

    labels: tuple[str, ...]
    names: Callable[[Column], Column]
    scope: str = "project"  # or "file"
    kind: str = "const"
    probe: tuple[str, ...] = ()  # suffixes of the files looked at
    ignore_case: bool = False
    sigil: bool = False  # the name must follow "$"
    variable: bool = False  # shell: $NAME, ${NAME
    aliases: bool = False
    only: Callable[[Column], Column] | None = None
    rules: Callable[[Column], Column] | None = None  # language of the rules by the probed file's suffix


@dataclass(frozen=True)
class LanguageSpec:
    name: str
    extensions: tuple[str, ...]
    shebangs: tuple[str, ...] = ()
    seeds: tuple[Seed, ...] = field(default=())
    seek: Callable[[DataFrame, DataFrame], DataFrame] | None = None  # (direct uses, lines) to tasks of its own, as columns of track.TASK


def _c_or_proc(suffix: Column) -> Column:
    return F.when(suffix.isin(".c", ".h"), F.lit("c")).otherwise(F.lit("proc"))


# Suffixes, interpreters and labels of the languages.
_KT, _TS, _PL, _NET, _GR = (".kt", ".kts"), (".ts", ".tsx", ".js", ".jsx"), (".pl", ".pm"), (".cs", ".vb"), (".groovy", ".gvy")
_PLSQL = (".pls", ".pck", ".prc", ".pkb", ".pks", ".fnc", ".trg")
_C = (".c", ".h", ".pc")

SPECS: tuple[LanguageSpec, ...] = (
    LanguageSpec("java", (".java",)),  # its seeds depend on structure; see operators.java
    LanguageSpec("kotlin", _KT, seeds=(Seed(("const定数定義",), x.kotlin_const, probe=_KT),)),
    LanguageSpec(
        "c",
        (".c", ".h"),
        seeds=(
            Seed(("#define定数定義",), x.c_define, probe=_C, aliases=True),
            Seed(("変数代入",), x.c_variable, scope="file", kind="field"),
        ),
    ),
    LanguageSpec(
        "proc",
        (".pc", ".pcc"),
        seeds=(
            Seed(("#define定数定義",), x.c_define, probe=_C, aliases=True, rules=_c_or_proc),
            Seed(("変数代入",), lambda c: F.coalesce(x.proc_variable(c), x.proc_host_variable(c)), scope="file", kind="field"),
        ),
    ),
    LanguageSpec("sql", (".sql",), seeds=(Seed(("定数・変数定義",), x.sql_variable, scope="file", kind="field", ignore_case=True),)),
    LanguageSpec("sh", (".sh", ".bash"), ("sh", "bash", "csh", "tcsh", "ksh", "ksh93"), (Seed(("変数代入", "環境変数エクスポート"), x.sh_variable, scope="file", kind="field", variable=True),)),
    LanguageSpec("ts", _TS, seeds=(Seed(("const定数定義",), x.ts_const, probe=_TS),)),
    LanguageSpec("python", (".py",), seeds=(Seed(("変数代入",), x.python_const, probe=(".py",)),)),
    LanguageSpec(
        "perl",
        _PL,
        ("perl",),
        (
            Seed(("use constant定義",), lambda c: F.array_compact(F.array_distinct(F.concat(F.array(x.perl_const(c)), x.perl_const_names(c)))), probe=_PL),
            Seed(("変数代入",), x.perl_our, probe=_PL, sigil=True),
        ),
    ),
    LanguageSpec("dotnet", _NET, seeds=(Seed(("定数定義(Const/readonly)",), x.dotnet_const, probe=_NET),)),
    LanguageSpec(
        "groovy",
        _GR,
        seeds=(
            Seed(("static final定数定義",), x.groovy_const, probe=_GR),
            Seed(("変数代入",), x.groovy_field, scope="file", kind="field"),
        ),
    ),
    LanguageSpec("plsql", _PLSQL, seeds=(Seed(("定数/変数宣言",), x.plsql_const, probe=_PLSQL, ignore_case=True, only=lambda c: c.rlike(r"(?iu)(?<![\p{L}\p{N}_])CONSTANT(?![\p{L}\p{N}_])")),)),
)


def by_suffix(specs: tuple[LanguageSpec, ...] = SPECS) -> dict[str, str]:
    return {e: s.name for s in specs for e in s.extensions}


def by_shebang(specs: tuple[LanguageSpec, ...] = SPECS) -> dict[str, str]:
    return {b: s.name for s in specs for b in s.shebangs}


def families(specs: tuple[LanguageSpec, ...] = SPECS) -> list[tuple[tuple[LanguageSpec, ...], set[str]]]:
    """Languages with the suffixes of the files that they look at: no two families have a suffix in common.

    A language that looks at all files, or seeks by itself, makes all of them one family, with no suffixes.
    """
    if any(spec.seek or any(not seed.probe and seed.scope != "file" for seed in spec.seeds) for spec in specs):
        return [(specs, set())]
    found: list[tuple[tuple[LanguageSpec, ...], set[str]]] = []
    for spec in specs:
        ends = {*spec.extensions, *(e for seed in spec.seeds for e in seed.probe)}
        met = [f for f in found if f[1] & ends]
        found = [f for f in found if not f[1] & ends]
        found.append(((*(s for f in met for s in f[0]), spec), ends.union(*(f[1] for f in met))))
    return found
