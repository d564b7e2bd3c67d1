import random
import sys

import numpy as np
import pytest

from tessera.llm.bpe import codec, default_path, encode


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_path())


def ids_of(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("chunk_bytes,block_bytes", [(64, 3000), (1024, 10**6), (4, 2000)])
def test_same_as_the_library(docs, rows, library, chunk_bytes, block_bytes):
    got = {r.doc_id: r for r in encode(docs, chunk_bytes=chunk_bytes, block_bytes=block_bytes).collect()}
    assert len(got) == len(rows)
    for (d, t), ids in zip(rows, ids_of(library, [t for _, t in rows])):
        assert np.frombuffer(bytes(got[d].ids), "<u4").tolist() == ids
        assert got[d].n_tokens == len(ids)
        assert got[d].decoded == library.decode(ids, skip_special_tokens=False) == t


def test_codec_agrees_on_every_kind_of_character(library):
    tool, rnd = codec(default_path()), random.Random(3)
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["a".join(chars[i:i + 400]) for i in range(0, 70000, 400)]
    texts += ["".join(rnd.choice(" \n\t\r'sx1.é 　 \x85\x1c<|endoftext|>") for _ in range(60)) for _ in range(3000)]
    texts += ["a<|endoftext|>  b", "  <|endoftext|><|endoftext|>", "x  <|endoftext|> y  ", "<|endoftext|", " " * 3000 + "x",
              " " * 700_000 + "x", "!" * 700_000, "\u00a0" * 300_000, "a" * 700_000, "1" * 300_000]
    for t, ids in zip(texts, ids_of(library, texts)):
        assert tool.encode(t.encode()).tolist() == ids, repr(t[:80])


def test_cuts_do_not_depend_on_the_neighbours():
    import pyarrow as pa
    from tessera.llm.bpe import Chunked
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab é") for _ in range(rnd.randrange(200))) for _ in range(60)]
    keys = [Chunked(pa.table({"doc": range(60), "text": x}), 7).keys.tolist() for x in (texts, texts[::-1])]
    assert keys[0] == keys[1] and len(keys[0]) > 300


def test_empty(no_docs):
    assert encode(no_docs).count() == 0
