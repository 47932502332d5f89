import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docforge.llm import tokens
from docforge.llm.codes import Codes, encode
from docforge.llm.queries import op5_token_output

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["é", "é", "́", " ", " ", "Σ", "ΑΣ", "'s", "'", "1", "२", "​", "<|endoftext|>", "<|end", " ", "a", "B", "İ", "!", ".", "...", ",", "\x1c", "\x85", "ß", "ﬁ", "漢", "\n", "̈́", "J", "̌", "K", "word", "Word,", "x.y", "ª", "ǅ", "̸", "="]


@pytest.mark.parametrize("high", [1, 200, 60_000, 2**32])
@pytest.mark.parametrize("count", [0, 1, 7, 511, 512, 513, 3000])
def test_any_number_is_read_in_place(count, high):
    rng = np.random.default_rng(count)
    ids = rng.integers(0, high, count, dtype=np.uint64).astype(np.uint32)
    codes = Codes(encode(ids))
    assert codes.read(0, count).tolist() == ids.tolist() == [codes[at] for at in range(count)]
    for _ in range(20):
        low, top = sorted(rng.integers(0, count + 1, 2).tolist())
        assert codes.read(low, top).tolist() == ids[low:top].tolist()
    with pytest.raises(IndexError):
        codes[count]


def test_word_encoder_equals_the_tokenizer():
    plain, rng, own = Tokenizer.from_file(PATH), random.Random(1), tokens.WordEncoder(PATH)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 9))) for _ in range(20_000)]
    for text, ids in zip(texts, own.encode([text.encode() for text in texts]), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_spellings_of_a_word_are_read_once():
    plain, own, read = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH), []

    class Noted:
        model = property(lambda self: self)

        def tokenize(self, letters):
            read.append(letters)
            return plain.model.tokenize(letters)

        def encode_batch_fast(self, parts, add_special_tokens):
            read.extend(parts)
            return plain.encode_batch_fast(parts, add_special_tokens=add_special_tokens)

    own.tokenizer = Noted()
    texts = ["Éohaes ofonhe", "ofonhe, OFONHE*** éohaes.", " \x0bOfonhe&%$#\n\tofonhe!? ", "", "\t", "Ofonhe&&& ÉOHAES***"]
    for text, ids in zip(texts, own.encode([text.encode() for text in texts]), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert sum("ofonhe" in each.lower() for each in read) == 1 and len(read) <= 3 + len({",", "***", ".", "&%$#", "!?", "&&&"})


def test_files_with_other_steps_are_read_text_by_text(spark, tmp_path):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.by_words(PATH) and isinstance(tokens.encoder(PATH), tokens.WordEncoder)
    assert not tokens.by_words(other)
    plain, rng = Tokenizer.from_file(other), random.Random(2)
    texts = ["Hello  World", "a b\nc", "", "x " * 1000] + ["".join(rng.choices(ODD, k=rng.randint(0, 9))) for _ in range(500)]
    for text, ids in zip(texts, tokens.encoder(other).encode([text.encode() for text in texts]), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    docs = spark.createDataFrame(list(enumerate(texts[:4])) + [(4, None)], "doc_id long, text string")
    read = {row.doc_id: row.n_tokens for row in tokens.tokenize_to_files(docs, other).collect()}
    assert read == {key: len(plain.encode(text, add_special_tokens=False).ids) + 1 for key, text in [*enumerate(texts[:4]), (4, "")]}
    held = json.load(open(PATH, encoding="utf-8"))
    for change in ({"truncation": {"max_length": 5}}, {"normalizer": None}, {"added_tokens": [{"content": "word.", "lstrip": False, "rstrip": False}]}):
        path = tmp_path / "changed.json"
        path.write_text(json.dumps(held | change))
        assert not tokens.by_words(str(path))


def test_memory_that_is_emptied_changes_nothing(monkeypatch):
    texts = [f"w{n} x{n % 7}, Y{n}".encode() for n in range(500)]
    whole = [ids.tolist() for ids in tokens.WordEncoder(PATH).encode(texts)]
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    monkeypatch.setattr(tokens, "_BLOCK", 5)
    assert [ids.tolist() for ids in tokens.WordEncoder(PATH).encode(texts)] == whole


def test_query_against_the_tokenizer(spark, small, document_rows):
    plain, at = Tokenizer.from_file(PATH), 0
    got = {row.doc_id: row for row in op5_token_output(spark, small).collect()}
    assert len(got) == len(document_rows)
    for key, text in sorted(document_rows):
        ids = plain.encode(text, add_special_tokens=False).ids + [1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (at, len(ids), crc)
        at += len(ids)


def test_small_shards_odd_rows_and_random_access(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_DOCS", 2)
    rows = [(5, "b c"), (None, "a"), (2, None), (2, None), (7, ""), (5, "a"), (9, "long " * 30_000)]
    docs = spark.createDataFrame([(key, text, 1) for key, text in rows], "doc_id long, text string, part int").repartition(3)
    shards = tokens.write_shards(docs, str(tmp_path / "out"), PATH)
    read = tokens.read_shards(shards).orderBy("start").collect()
    assert [row.doc_id for row in read] == [None, 2, 2, 5, 5, 7, 9]
    assert [row.n_tokens for row in read][1:3] == [1, 1] and read[5].n_tokens == 1 and read[6].n_tokens == 30_001
    assert [row.start for row in read] == np.cumsum([0] + [row.n_tokens for row in read])[:-1].tolist()
    shard = tokens.Shard(open(read[6].path, "rb").read())
    assert shard.codes[shard.codes.size - 1] == 1 and shard.codes[5] == shard.codes[7]
    empty = tokens.tokenize_to_files(docs.limit(0), PATH)
    assert empty.collect() == []
