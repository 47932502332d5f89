import pytest
from llm import brute
from llm.brute import copies

from docforge.llm import quality


def values(marked):
    return {row["row"]["doc_id"]: row for row in marked.collect()}


def test_measures_equal_brute_force(make_docs):
    texts = [*copies(1), "one two three four five six seven eight " * 3, "same\nsame\n\nsame\n | # *"]
    got = values(quality.ledger(make_docs(texts)))
    for key, text in enumerate(texts):
        row = got[key]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute.quality(text)


def test_base_rules_and_policies(make_docs):
    fine = " ".join(f"word{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(40))
    junk = " ".join(["LOUD!!"] + [f"WORD{chr(65 + n)}!!" for n in range(25)])
    got = values(quality.ledger(make_docs([fine, "too few", fine + " " + fine, junk, None])))
    assert got[0].fail_bits == 0
    assert got[1].fail_bits & quality.BIT["few_words"] and got[4].fail_bits & quality.BIT["few_words"]
    assert got[2].fail_bits == quality.BIT["repeated_words"]
    assert not got[3].fail_bits & quality.BASE and got[3].fail_bits & quality.BIT["upper_case"]
    kept = quality.apply_policy(make_docs([fine, "too few", junk]))
    assert [row.doc_id for row in kept.collect()] == [0]
    assert kept.columns == make_docs([]).columns
    assert {row.doc_id for row in quality.apply_policy(make_docs([fine, junk]), policy=1).collect()} == {0, 1}


def test_ablations_count_what_a_rule_alone_rejects(make_docs):
    fine = " ".join(f"word{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(40))
    marked = quality.ledger(make_docs([fine, "few", "# #", fine + " " + fine]))
    rows = {row.rule: row for row in quality.ablations(marked).collect()}
    assert (rows["few_words"].failed, rows["few_words"].only) == (2, 1)
    assert (rows["repeated_words"].failed, rows["repeated_words"].only, rows["repeated_words"].kept_without) == (1, 1, 2)


def test_rows_of_any_shape(spark, make_docs):
    assert quality.ledger(make_docs([])).collect() == []
    odd = spark.createDataFrame([(1, "a b", 7, True)] * 3, "doc_id long, text string, n_words int, row boolean")
    marked = quality.ledger(odd).collect()
    assert [(row["row"]["n_words"], row["row"]["row"], row.n_words) for row in marked] == [(7, True, 2)] * 3


@pytest.mark.parametrize("length", [200_000])
def test_long_text(make_docs, length):
    row = quality.ledger(make_docs(["ab cd " * length])).first()
    assert (row.n_words, row.n_repeat_words) == (2 * length, 2 * length)
