import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from slidelake.llm import tokenfiles

JSON = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = ["plain text, here.", f"a {END} b", END, f"x  {END}y", f"\n \n {END} \n  z.", f"{END}{END}. w, {END}", "a <|endof text|> b", f"\x01 {END}  "]


def test_encoder_is_the_library():
    tok, e = Tokenizer.from_file(JSON), tokenfiles.Encoder(JSON)
    assert tok.encode(TEXTS[1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode_batch(TEXTS)] == [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_token_files_with_added_tokens(spark):
    tok, start, want = Tokenizer.from_file(JSON), 0, []
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = tokenfiles.read_token_files(tokenfiles.write_token_files(docs, JSON)).collect()
    assert sorted(map(tuple, rows)) == want
