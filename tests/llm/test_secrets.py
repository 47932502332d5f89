import random
import re

import duckdb

from docforge.llm import secrets
from docforge.llm.automata import compile_rules
from docforge.llm.oracles import ORACLES

PARTS = ["password", "PassWD", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abc", "deadbeef", "0123456789abcdef01234567", "AKIA", "AKIA" + "A" * 16, "é", "-", "xyz_1", "ghp_" + "a1" * 20, "://u:p@", "\n", "K"]


def plain(text):
    """All spans by the re module, in bytes."""
    found = []
    for number, rule in enumerate(secrets.RULES):
        for match in re.finditer(rule.pattern.encode(), text):
            if len(match[rule.group]) >= rule.least:
                found.append((match.start(), match.end(), number))
    return sorted(found, key=lambda span: (span[0], span[2]))


def test_one_pass_finds_what_each_pattern_finds():
    rng, machine = random.Random(5), secrets.scanner()
    for _ in range(8000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14))).encode()
        assert machine.spans(text) == plain(text), text


def test_automata_are_minimal_and_deterministic():
    machine = compile_rules(["(ab|ac|ad)x", "a[b-d]x"])
    assert len(machine.table) // machine.classes == 5  # start, a, b-d, x, dead
    assert set(machine.accepts.values()) == {3}


def test_base_rules_on_documents(documents, document_rows):
    got = {row["row"]["doc_id"]: row for row in secrets.find_secrets(documents).collect()}
    for key, text in document_rows:
        chars = [(len(text.encode()[:a].decode()), len(text.encode()[:b].decode()), n) for a, b, n in plain(text.encode())]
        assert [(s.start, s.end, s.kind) for s in got[key].found] == [(a, b, secrets.RULES[n].kind) for a, b, n in chars]


def test_dropped_matches_are_consumed_and_offsets_are_code_points(make_docs):
    rows = secrets.find_secrets(make_docs(["é secret=token:abcdefgh", "ü token=ABCDEF1", None, ""])).withColumn("d", secrets.digest()).collect()
    assert [row.d for row in rows] == ["", "assign:2:15", "", ""]


def test_redact_and_odd_tables(spark, make_docs):
    texts = ["a password=0123456789abcdef0123456789 b", "clean é", None]
    assert [row.text for row in secrets.redact(make_docs(texts)).collect()] == ["a [SECRET] b", "clean é", None]
    assert secrets.find_secrets(make_docs([])).collect() == []
    odd = spark.createDataFrame([("token=abcdef", 1)] * 2, "text string, found int")
    assert [(row["row"]["found"], len(row.found)) for row in secrets.find_secrets(odd).collect()] == [(1, 1)] * 2


def test_long_text(make_docs):
    row = secrets.find_secrets(make_docs(["word " * 100_000 + "AKIA" + "Z" * 5000])).first()
    assert [(s.kind, s.start, s.end) for s in row.found] == [("access", 500_000, 505_004)]


def test_sql_equals_the_scan_on_tricky_texts(spark):
    rng = random.Random(9)
    parts = ["token", "API_KEY", "apikey", "paſſword", "password", '"', "'", " ", "=", ":", "abc", "AKIA", "Z" * 18, "0f" * 13, "é", "\n", "ghp_", "a1" * 20]
    parts += ["://user:", "pw@", "xoxb-", "eyJa.", "eyJb.", "c" * 40, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "://", "user", "@", "\U0001f511", "/", "."]
    rows = [(n, None if n % 50 == 0 else "".join(rng.choices(parts, k=rng.randint(0, 25)))) for n in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {row.doc_id: row.spans for row in secrets.find_secrets(docs).select("row.doc_id", secrets.digest().alias("spans")).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = {doc_id: spans for doc_id, *_, spans in db.execute(ORACLES["op6_secret_scans"]).fetchall()}
    assert got == want and sum(map(bool, want.values())) > 300
    assert {span.split(":")[0] for spans in want.values() for span in spans.split(",") if span} == {rule.kind for rule in secrets.RULES}
