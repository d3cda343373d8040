from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plurality.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_are_those_of_the_file():
    with open(PATH) as file:
        assert {t["content"]: t["id"] for t in json.load(file)["added_tokens"]} == packing.ADDED


def test_added_tokens_in_texts_have_their_ids(docs_of):
    reference = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>  b\n", "<|endoftext|", "<|ENDOFTEXT|> it's", "<|endoftext|>", "word <|endoftext|> " * 900]
    want = {i: [*reference.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 2]
    encode = packing.encoder(queries.vocabulary())
    assert {i: encode(t).tolist() for i, t in enumerate(texts)} == want
    rows = packing.pack(docs_of(list(enumerate(texts))), queries.vocabulary()).collect()
    assert {(r.doc_id, r.start, r.length): r.ids_crc32 for r in rows} == {
        (i, s, n): zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) for i, ids in want.items() for s, n in packing.cut(len(ids))
    }
