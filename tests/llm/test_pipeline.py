import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from llm import brute

from docforge.llm import latent, quality
from docforge.llm.common import barrier


@pytest.fixture(scope="module")
def steps(spark, small):
    """What each stage returns, each on the one before it."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = barrier(stage(spark, docs, small), name)
        out.append(docs)
    return out


def rows(frame):
    return {row.doc_id: row.text for row in frame.collect()}


def test_stages_keep_the_columns_of_documents(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixture", "token_output"]
    assert all(frame.columns == steps[0].columns for frame in steps[1:-1])


def test_quality_stage_drops_what_the_rules_reject(steps):
    marked = {row["row"]["doc_id"]: row.fail_bits for row in quality.ledger(steps[0]).collect()}
    assert rows(steps[1]).keys() == {key for key, bits in marked.items() if not bits & quality.POLICIES[quality.CURRENT]}
    for key in rows(steps[0]).keys() - rows(steps[1]).keys():
        n_words, _, _, _, repeated = brute.quality(rows(steps[0])[key])
        assert marked[key] & quality.BASE == quality.BIT["few_words"] * (n_words < 20) + quality.BIT["repeated_words"] * (100 * repeated > 30 * n_words)


def test_one_document_of_each_group_stays(steps):
    groups = brute.groups(list(rows(steps[1]).items()))
    assert rows(steps[2]).keys() == {key for key, (_, component) in groups.items() if component == key}


def test_benchmark_passages_go_and_others_stay(spark, small, steps):
    items = [latent.plain_words(row.text.encode()) for row in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before = rows(steps[2])
    leaks = {key for key, text in before.items() if any(b" ".join(item) in b" ".join(latent.plain_words(text.encode())) for item in items)}
    gone = before.keys() - rows(steps[3]).keys()
    assert leaks and leaks <= gone
    for key in gone - leaks:  # edited copies, e.g. with a word put in: an item stands there in order, nearly whole
        words = latent.names_of(latent.plain_words(before[key].encode()))
        edited = [latent.Item(0, latent.names_of(item), []) for item in items]
        assert any(
            latent.common_subsequence(words[at : at + 2 * len(item.words)], item.places, len(item.words)) >= 0.8 * len(item.words)
            for item in edited
            for at in range(0, len(words), 8)
        )


def test_mixture_takes_its_share(steps):
    size = lambda frame: sum(len(brute.words_of(text)) for text in rows(frame).values())
    assert corpus_pipeline.SHARE * size(steps[3]) - 2 <= size(steps[4]) <= size(steps[3])
    assert rows(steps[4]).keys() < rows(steps[3]).keys()


def test_tokens_of_the_last_stage(steps):
    plain, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {row.doc_id: row for row in steps[5].collect()}
    for key, text in sorted(rows(steps[4]).items()):
        ids = plain.encode(text, add_special_tokens=False).ids + [1]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == steps[4].count()


def test_run_equals_its_stages(spark, small, steps):
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select(columns).collect())) == sorted(map(tuple, steps[5].select(columns).collect()))
