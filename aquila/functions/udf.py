"""Functions that users declare: name(p1 type, ...) -> type."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

# Spellings of types in signatures.
NUMERIC = "smallint int2 integer int int4 bigint long int8 real float float4 double float8 double_precision binary varbinary blob bytea raw bool boolean short smallserial serial2 serial serial4 number bigserial bigserial8 numeric bit byte unsignedbyte bit_varying varbit".split()
STRING = "char character string varchar text unicodechar clob timestamp date varchar2 character_varying time timetz timestamptz".split()
GEOMETRIC = "point region circle box polygon position".split()
_SIGNATURE = re.compile(r"\s*([a-zA-Z]+[a-zA-Z0-9_]*)\s*\(([^)]*)\)\s*(?:->\s*(\S.*?))?\s*\Z")


def kind_of_type(name: str) -> str:
    """N, S, G; U for an unknown type, which matches any."""
    word = re.sub(r"\s+", "_", re.sub(r"\(.*\)", "", name).strip().lower())
    return "N" if word in NUMERIC else "S" if word in STRING else "G" if word in GEOMETRIC else "U"


@dataclass(frozen=True)
class Function:
    """One signature. translation: SQL with $1 ... for the arguments and $$ for a dollar, or a callable from the arguments'
    SQL to SQL; None: a function of the same name that the session knows."""

    name: str
    params: tuple[tuple[str, str], ...]
    returns: str
    translation: str | Callable[[list[str]], str] | None = None

    @property
    def kinds(self) -> str:
        return "".join(kind_of_type(t) for _, t in self.params)

    @property
    def kind(self) -> str:
        return kind_of_type(self.returns)

    def signature(self) -> str:
        return f"{self.name}({', '.join(f'{n} {t}'.strip() for n, t in self.params)}){f' -> {self.returns}' if self.returns else ''}"

    def accepts(self, name: str, kinds: str) -> bool:
        return self.name.lower() == name.lower() and len(kinds) == len(self.params) and all(a == b or "U" in (a, b) for a, b in zip(self.kinds, kinds))

    def sql(self, args: list[str]) -> str:
        if callable(self.translation):
            return self.translation(args)
        if self.translation is None:
            return f"{self.name}({', '.join(args)})"
        return re.sub(r"\$(\$|\d+)", lambda m: "$" if m[1] == "$" else args[int(m[1]) - 1], self.translation)


def declare(signature: str, translation: str | Callable[[list[str]], str] | None = None) -> Function:
    m = _SIGNATURE.match(signature)
    if not m:
        raise ValueError(f"{signature!r} declares no function; it should read like: name(p1 type, p2 type) -> type")
    params = []
    for part in filter(None, (p.strip() for p in m[2].split(","))):
        name, _, kind = part.partition(" ")
        if not kind:
            raise ValueError(f"{part!r} declares no parameter; it needs a name and a type")
        params.append((name, kind.strip()))
    if isinstance(translation, str):
        for ref in re.findall(r"\$(\$|\d+)", translation):
            if ref != "$" and not 1 <= int(ref) <= len(params):
                raise ValueError(f"${ref} refers to no parameter of {signature!r}")
    return Function(m[1], tuple(params), (m[3] or "").strip(), translation)
