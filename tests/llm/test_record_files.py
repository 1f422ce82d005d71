import zlib

import numpy as np
import pytest

from helixframe.llm.queries import tokenizer_file
from helixframe.llm.record_files import WordEncoder, frame, masked, read_records, unframe, write_records


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


TEXTS = ["The quick  brown\n\nfox", "a b\nc d\n", " lead", "tail ", "it's 3 o'clock\tnow", "<|endoftext|> x", "nul\0l", "Ünïcödé \U0001f600 ok", "x \n y", "line\r\nend", "non break", "", "two  spaces", "é  wide"]


def test_words_give_the_library_s_ids(library):
    e = WordEncoder(tokenizer_file())
    for t in TEXTS:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_frames():
    data = frame(b"abc") + frame(b"")
    assert unframe(data) == b"abc" and unframe(data, 19) == b""
    assert masked(b"abc") != zlib.crc32(b"abc")
    with pytest.raises(ValueError):
        unframe(data.replace(b"abc", b"abd"))


def test_round_trip(spark, make, library, text_of):
    docs = [(i * 7 % 50, text_of(i, 5 + i * 3)) for i in range(50)] + [(None, None), (60, "")]
    folder, index = write_records(make(docs), tokenizer_file())
    got = sorted(read_records(spark, folder, index).collect(), key=lambda r: r.start)
    want = [(None, None), *sorted((d for d in docs if d[0] is not None))]
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = index.where("start % 3 = 0")
    assert read_records(spark, folder, some, chunk_bytes=200).count() == some.count()


def test_odd_rows(spark, odd, empty):
    folder, index = write_records(odd, tokenizer_file())
    assert read_records(spark, folder, index).count() == odd.count()
    folder, index = write_records(empty, tokenizer_file())
    assert read_records(spark, folder, index).count() == 0
