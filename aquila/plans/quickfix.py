"""Repairs for queries that don't parse: look-alike characters, and names that need double quotes."""

from __future__ import annotations

import re

from aquila.plans.lexer import FUNCTIONS, REGULAR, RESERVED, tokenize

# Characters that look like one of ASCII.
LOOKALIKES = {
    "-": "-˗۔‐‑‒–⁃−➖Ⲻ﹘—―⁻₋\u0096֊﹣－",
    "_": "_ߺ﹍﹎﹏",
    "'": "'`´ʹʻʼʽʾˈˊˋ˴ʹ΄՚՝י׳ߴߵᑊᛌ᾽᾿`´῾‘’‛′‵ꞌ＇｀",
    '"': "ʺ˝ˮ˶ײ״᳓“”‟″‶〃＂",
    ".": ".٠۰܁܂․ꓸ꘎",
    "+": "+᛭➕",
    " ": "                ",
    "<": "<˂ᐸᚲ‹❮",
    ">": ">˃ᐳ›❯",
    "=": "=᐀⹀゠꓿",
}
_TABLE = str.maketrans({c: ascii_ for ascii_, cs in LOOKALIKES.items() for c in cs})


def quick_fix(query: str) -> str:
    """The query with look-alikes replaced, tabs as four spaces, line ends as \\n, and double quotes around words that are
    no regular identifiers, reserved words of SQL, and function names that no parenthesis follows."""
    query = re.sub(r"\r\n|\r", "\n", query.translate(_TABLE)).replace("\t", "    ")
    out, at = [], 0
    tokens = tokenize(query)
    for t, following in zip(tokens, tokens[1:]):
        if t.kind != "word":
            continue
        if t.word in RESERVED or t.word in FUNCTIONS and following.word != "(" or not REGULAR.match(t.text):
            out += [query[at : t.start], f'"{t.text}"']
            at = t.end
    return "".join(out) + query[at:]
