"""Quality rules: every rule is evaluated once into a bit ledger; policies and ablations read the bits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import frugal, name_words, row_and_text, split_words, sql_type, text_groups, texts_of, window_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
    "n_marks",
    "n_stutters",
)


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; the rule's position gives its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("upper_case", "n_letters > 0 AND 100 * n_upper > 60 * n_letters"),
    Rule("few_letters", "100 * n_letters < 50 * word_chars"),
    Rule("many_marks", "2 * n_marks > n_words"),
    Rule("stutter", "100 * n_stutters > 30 * n_words"),
)
BIT = {rule.name: 1 << position for position, rule in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Versioned policies: the rules that reject a document.
POLICIES = {
    1: BASE,
    2: BASE | BIT["many_symbols"] | BIT["repeated_lines"],
    3: sum(BIT.values()),
}
CURRENT = 3


def _repeated_words(names: np.ndarray) -> int:
    """Words in windows that occur twice or more in the text."""
    windows = window_hashes(names, WINDOW)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edges = np.zeros(len(names) + 1, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[0xC0:] = 2  # first byte of a code point beyond ASCII counts as a letter
_KIND[0x80:0xC0] = 3  # the bytes after it
_KIND[list(b"!?")] = 4


def measure_text(text: bytes | None, names: np.ndarray) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text and its words' names; a null text has no words and no lines."""
    words = split_words(text)
    if not words:
        return (0,) * len(MEASURES)
    joined = b"".join(words)
    kinds = np.bincount(_KIND[np.frombuffer(joined, np.uint8)], minlength=5)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(joined) - int(kinds[3]),
        len(joined) - len(joined.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated_words(names),
        len(lines),
        int(kinds[1]),
        int(kinds[1] + kinds[2]),
        int(kinds[4]),
        int((names[1:] == names[:-1]).sum()),
    )


def _measure(batches):
    for batch in batches:
        measured = []
        for _, group in text_groups(batch.column("text")):
            names, ends = name_words(group)
            measured += map(measure_text, texts_of(group), np.split(names, ends[:-1]))
        columns = [pa.array(values, pa.int64()) for values in zip(*measured, strict=True)] if measured else [
            pa.array([], pa.int64()) for _ in MEASURES
        ]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *MEASURES])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the document's columns), the measurements, and ``fail_bits``: one bit for each failed rule.

    One pass over whole texts, no shuffle. Null and empty texts fail ``few_words``; repeated rows
    are judged each for itself; an empty table gives an empty ledger.
    """
    rows = row_and_text(docs, F.col(text).cast("string").alias("text"))
    schema = f"row {sql_type(rows, 'row')}, " + ", ".join(f"{name} long" for name in MEASURES)
    bits = sum((F.expr(rule.fails).cast("long") * F.lit(BIT[rule.name]) for rule in RULES), F.lit(0))
    return rows.mapInArrow(frugal(_measure), schema).withColumn("fail_bits", bits.cast("long"))


def kept(policy: int = CURRENT):
    """Column: no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(docs: DataFrame, policy: int = CURRENT, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    return ledger(docs, text).where(kept(policy)).select("row.*")


def ablations(marked: DataFrame, policy: int = CURRENT) -> DataFrame:
    """``rule, failed, only, kept_without`` for each rule of the policy, from a ledger.

    ``only`` counts documents that no other rule of the policy rejects. Rows are first counted by
    their bits (at most two to the number of rules, combined before the shuffle).
    """
    mask = POLICIES[policy]
    by_bits = marked.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("docs"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask])
    each = by_bits.select("bits", "docs", F.explode(rules).alias("r")).select("bits", "docs", "r.*")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("docs"))), F.lit(0))
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        total(failed).alias("failed"),
        total(F.col("bits") == F.col("bit")).alias("only"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )
