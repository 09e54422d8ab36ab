"""Quality rules: how much of a text is repetition.

Words become numbers, windows of several lengths rolling hashes, all in numpy over many texts at once. A text is kept if
the characters inside n-grams that occur twice or more, and inside lines that repeat an earlier line, are few enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from aquila.llm.batches import map_chunks
from aquila.llm.shingles import GOLD, mixed
from aquila.llm.tables import load

#: Largest share of a text's word characters inside n-grams that occur twice or more, by n; and inside repeated lines. What
#: lies in longer n-grams lies in shorter ones too, so the limits fall.
MOST_REPEATED = {3: 0.35, 5: 0.32, 8: 0.28, 12: 0.20}
MOST_IN_LINES = 0.16
#: Shorter texts fail.
LEAST_WORDS = 50
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def covered(codes: np.ndarray, starts: np.ndarray, counts: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each n a boolean for each word: it lies in an n-gram that its text holds twice or more. codes: words of all
    texts in turn, equal for equal words; starts and counts: of each text's words."""
    h = mixed(codes.astype(np.uint64) * GOLD + np.uint64(1))
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(starts + counts, counts) - np.arange(len(codes))  # words from here to the text's end
    rolled, out = h.copy(), {}
    for n in range(2, max(lengths) + 1):
        rolled = rolled[:-1] * GOLD + h[n - 1 :] if len(rolled) else rolled
        if n not in lengths:
            continue
        at = np.flatnonzero(left[: len(rolled)] >= n)
        keys = mixed(rolled[at] ^ mixed(text[at].astype(np.uint64) + np.uint64(7)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        edge = np.zeros(len(codes) + 1, np.int32)
        hits = at[again]
        edge[hits] += 1
        np.subtract.at(edge, hits + n, 1)
        out[n] = np.cumsum(edge[:-1]) > 0
    return out


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    texts = [t or "" for t in texts]
    raws = [t.encode() for t in texts]
    words = [r.split() for r in raws]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(counts) - counts
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.utf8_length(coded.dictionary.cast(pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    per_text = lambda values: np.bincount(text, values, len(texts))
    inside = covered(codes, starts, counts, tuple(MOST_REPEATED))
    out = {
        "n_words": counts,
        "word_chars": per_text(chars).astype(np.int64),
        "n_symbols": np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raws], np.int64),
        "n_repeat_words": per_text(inside[3]).astype(np.int64),
    }
    for n, mask in inside.items():
        out[f"chars_{n}"] = per_text(mask * chars).astype(np.int64)
    dup, dup_chars = [], []
    for t in texts:
        lines = t.split("\n") if "\n" in t else ()
        seen, n, size = set(), 0, 0
        for line in lines:
            if line in seen:
                n += 1
                size += len(line.translate(_NO_WHITE))
            elif line.encode().strip(WHITE):
                seen.add(line)
        dup.append(n)
        dup_chars.append(size)
    return out | {"n_dup_lines": np.array(dup, np.int64), "dup_line_chars": np.array(dup_chars, np.int64)}


_NO_WHITE = {c: None for c in WHITE}


def rule_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and what the verdict rests on: chars_<n> (word characters inside n-grams that occur twice or more, case kept) and
    dup_line_chars (word characters of lines equal to an earlier line).

    Null and empty texts have 0 everywhere, fail the base and are not kept. Repeated rows each get their row, a null id
    stays null, an empty table gives an empty table, other columns are ignored. Texts are measured whole.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"chars_{n}" for n in MOST_REPEATED), "dup_line_chars"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column(1).to_pylist())
        m["base_failed"] = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        good = m["dup_line_chars"] <= MOST_IN_LINES * m["word_chars"]
        for n, most in MOST_REPEATED.items():
            good &= m[f"chars_{n}"] <= most * m["word_chars"]
        m["kept"] = good & ~m["base_failed"]
        return pa.record_batch([batch.column(0), *(pa.array(m[k]) for k in names)], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{k} {'boolean' if k in ('base_failed', 'kept') else 'bigint'}" for k in names)])
    return map_chunks(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "text", schema, lambda: step)


def _sql() -> str:
    """The same in DuckDB's SQL."""
    white, lengths = "\\x20\\x09-\\x0D", list(MOST_REPEATED)
    grams = ", ".join(" || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))]) + f" AS g{n}" for n in lengths)
    again = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 AS a{n}" for n in lengths)
    inside = ", ".join(f"max(a{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS a{n}" for n in lengths)
    sums = ", ".join(f"sum(c) FILTER (a{n}) AS chars_{n}" for n in lengths)
    measured = ", ".join(f"coalesce({k}, 0)::BIGINT AS {k}" for k in ("word_chars", "n_dup_lines", "n_repeat_words", *(f"chars_{n}" for n in lengths), "dup_line_chars"))
    good = " AND ".join([f"dup_line_chars <= {MOST_IN_LINES}::DOUBLE * word_chars", *(f"chars_{n} <= {most}::DOUBLE * word_chars" for n, most in MOST_REPEATED.items())])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^{white}]+') AS ws FROM d),
t AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT r, i, length(w) AS c, {grams} FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
a AS (SELECT r, i, c, {again} FROM g),
b AS (SELECT r, i, c, {inside} FROM a),
s AS (SELECT r, sum(c) AS word_chars, count(*) FILTER (a{lengths[0]}) AS n_repeat_words, {sums} FROM b GROUP BY r),
l AS (SELECT r, line, count(*) - 1 AS more FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{white}]') GROUP BY r, line),
e AS (SELECT r, sum(more) AS n_dup_lines, sum(more * length(regexp_replace(line, '[{white}]', '', 'g'))) AS dup_line_chars FROM l GROUP BY r),
x AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, {measured} FROM d JOIN w USING (r) LEFT JOIN s USING (r) LEFT JOIN e USING (r)),
y AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND {good} AS kept FROM y
"""


SQL = _sql()


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_quality(load(spark, sf_dir, "documents"))
