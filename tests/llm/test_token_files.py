import glob
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from reviewloom.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, start string"


WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


def expected(rows):
    out, at = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(text)
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_encoder_equals_the_whole_tokenizer():
    encode = tf.Encoder(PATH)
    for text in [
        "", " ", "  ", "a  b", " x", "x ", "\n x", "a\n b", "a \nb", "<|endoftext|> hi", "a  b", "\x1c x",
        "it's  a 'll", "a\t b 12 3", "中文 א x", "déjà vu. ª² x½", "one " * 50,
    ]:
        got = np.frombuffer(encode(text), encode.dtype).tolist()
        assert got == ids_of(text)[:-1], text


def test_round_trip(spark, make, tmp_path):
    rows = [(7, "some words here", "x"), (3, None, "x"), (5, "", "x"), (5, "", "x"), (1, "long text " * 9000, "x"),
            (None, "no id", "x"), (2, "# # #", "x")]
    manifest = tf.write_tokens(make(rows, SCHEMA), str(tmp_path), PATH, length=64, shards=3)
    got = tf.read_documents(spark, str(tmp_path), manifest).drop("shard", "doc_at").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    total = 0
    for path in glob.glob(f"{tmp_path}/tokens-*.arrow"):
        for ids, mask in tf.open_shard(path):
            assert ids.shape == (len(mask), 64) and not ids.flags.owndata
            total += mask.flatten().true_count
    assert total == sum(len(ids_of(r[1])) for r in rows)


def test_a_file_that_is_there_stays(tmp_path):
    class Kept:
        """A file system whose rename does not replace."""

        def __init__(self):
            self.local = fs.LocalFileSystem()
            self.get_file_info, self.delete_file = self.local.get_file_info, self.local.delete_file

        def move(self, part, name):
            if os.path.exists(name) or not os.path.exists(part):
                raise OSError("not renamed")
            self.local.move(part, name)

    part, name = f"{tmp_path}/x.tmp", f"{tmp_path}/x"
    for _ in range(2):
        open(part, "w").close()
        tf._rename(Kept(), part, name)
        assert os.listdir(tmp_path) == ["x"]
    with pytest.raises(OSError):
        tf._rename(Kept(), f"{tmp_path}/lost.tmp", f"{tmp_path}/y")


def test_empty_table(spark, make, tmp_path):
    manifest = tf.write_tokens(make([], SCHEMA), str(tmp_path), PATH)
    assert tf.read_documents(spark, str(tmp_path), manifest).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = tf.op7_token_files(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
