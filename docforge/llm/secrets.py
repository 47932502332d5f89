"""Secret scans: all rules in one minimal automaton, each text read in one byte pass."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.automata import Automaton, compile_rules
from docforge.llm.common import frugal, row_and_text, sql_type, texts_of


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds leftmost, longest, non-overlapping matches; a match counts if ``group`` has ``least`` bytes.

    Patterns must be such that the longest match from a start is the one that the re module finds.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: Fixed values of the base rules.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=20),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    SecretRule("forge_token", r"gh[opsu]_[A-Za-z0-9]+", least=40),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("url_login", r"://[A-Za-z0-9._-]+:[^\x00-\x20/@:\x7f-\xff]+@"),
)
RULES = BASE_RULES + MORE_RULES
BASE_KINDS = tuple(rule.kind for rule in BASE_RULES)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[SecretRule, ...]
    starts: Automaton
    longest: tuple[Automaton, ...]
    groups: tuple[re.Pattern, ...]

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """``(start, end, rule)`` in bytes, by start and then rule.

        The pass goes from the last byte to the first: a state that accepts says at which byte a
        match of which rules starts. From these starts alone the rule's own automaton reads the match.
        """
        machine = self.starts
        table, first, state = machine.table, machine.first_accepting, machine.start
        hits = []
        position = len(text)
        for kind in text.translate(machine.class_of)[::-1]:
            position -= 1
            state = table[state + kind]
            if state >= first:
                hits.append((position, machine.accepts[state]))
        found, free = [], [0] * len(self.rules)
        for start, mask in reversed(hits):
            for number in range(len(self.rules)):
                if mask >> number & 1 and start >= free[number]:
                    free[number] = end = self._end(text, start, number)
                    rule = self.rules[number]
                    if not rule.least or self._length(text[start:end], number) >= rule.least:
                        found.append((start, end, number))
        return found

    def _end(self, text: bytes, start: int, number: int) -> int:
        machine = self.longest[number]
        table, kinds, state, end = machine.table, machine.class_of, machine.start, start
        for position in range(start, len(text)):
            state = table[state + kinds[text[position]]]
            if state == machine.dead:
                break
            if state >= machine.first_accepting:
                end = position + 1
        return end

    def _length(self, match: bytes, number: int) -> int:
        group = self.rules[number].group
        return len(self.groups[number].fullmatch(match)[group]) if group else len(match)


@lru_cache(maxsize=8)
def scanner(rules: tuple[SecretRule, ...] = RULES) -> Scanner:
    patterns = [rule.pattern for rule in rules]
    return Scanner(
        rules,
        compile_rules(patterns, backwards=True, anywhere=True),
        tuple(compile_rules([pattern]) for pattern in patterns),
        tuple(re.compile(pattern.encode()) for pattern in patterns),
    )


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points, each byte counted once."""
    if not spans or text.isascii():
        return spans
    wanted = sorted({offset for span in spans for offset in span[:2]})
    at, points, place = 0, 0, {}
    for offset in wanted:
        points += len(text[at:offset].decode("utf-8", "replace"))
        at, place[offset] = offset, points
    return [(place[start], place[end], number) for start, end, number in spans]


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``row`` (the document's columns) and ``found``: an array of ``kind, start, end`` in code points, end exclusive.

    Whole texts, no shuffle. Null and empty texts have no spans; repeated rows are scanned each for
    itself; an empty table gives an empty result. Spans go by start, then by the order of the rules.
    """

    def scan(batches):
        machine = scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [
                [{"kind": rules[number].kind, "start": start, "end": end} for start, end, number in in_code_points(value, machine.spans(value))]
                if value
                else []
                for value in texts_of(batch.column("text"))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(kind))], ["row", "found"])

    rows = row_and_text(docs, F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(frugal(scan), f"row {sql_type(rows, 'row')}, found array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The documents with every span replaced by ``mask``; overlapping spans are replaced as one."""
    found = find_secrets(docs, text, rules)
    merged = F.aggregate(
        "found",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda done, span: F.when(span["end"] <= done["at"], done).otherwise(
            F.struct(
                F.when(span["start"] < done["at"], done["out"])
                .otherwise(
                    F.concat(done["out"], F.substring(F.col(f"row.{text}"), (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.lit(mask))
                )
                .alias("out"),
                span["end"].alias("at"),
            )
        ),
        lambda done: F.concat(done["out"], F.substring(F.col(f"row.{text}"), (done["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return found.select(F.col("row").withField(text, merged).alias("row")).select("row.*")


def digest(kinds: tuple[str, ...] | None = None):
    """Column: ``kind:start:end`` of the spans of ``kinds`` (all if None), joined by commas."""
    spans = F.col("found") if kinds is None else F.filter("found", lambda span: span["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])), ",")


def count_of(kind: str):
    return F.size(F.filter("found", lambda span: span["kind"] == kind)).cast("long")


def base_sha256():
    return F.sha2(digest(BASE_KINDS), 256)


__all__ = ["BASE_RULES", "MORE_RULES", "RULES", "SecretRule", "base_sha256", "count_of", "digest", "find_secrets", "redact", "scanner"]
