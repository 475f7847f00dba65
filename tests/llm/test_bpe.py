import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import bpe, packed
from granary.llm.common import documents

PATH = bpe.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.Encoder(PATH)
THEIRS = bpe.Encoder(PATH, backtrack=False)

ODD = [
    "", " ", "a <|endoftext|>b", "<|startoftext|><|endoftext|> x<|endoftext|", "don't we'll I'M 'tis _x__y 12½²", "!!'s ''' 'S",
    "É x İstanbul ΣΑΣ σ 日本語テキスト 😀👍🏽", "e\u0301 A\u030a", "\x1c\x1f x\x85y\xa0z", "ŉ ĳ ǅ ß ſ K Å", "\xadsoft", "a\u200bb", "१२ ٣ ª º µ ⅷ",
    "x" * 3000, "aaaa" * 500 + "b", "the" * 700, "\ufeff\u0000\u0001",
]


def wanted(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    ids = wanted(text)
    for tool in (OURS, THEIRS):
        assert np.frombuffer(tool.encode([text])[0], "<u4").tolist() == ids
    assert OURS.vocabulary.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefghinorstuéß'!._- 01\n"), max_size=60))
def test_latin_texts(text):
    assert np.frombuffer(OURS.encode([text])[0], "<u4").tolist() == wanted(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert np.frombuffer(OURS.encode([text])[0], "<u4").tolist() == wanted(text)


SCRIPTS = [
    "“Curly quotes” — and dashes… it’s", "Съешь ещё этих мягких французских булок, да выпей чаю.", "日本語のテキスト 漢字 かな交じり", "עברית ועוד",
    "e\u0301 H\u0331 h\u0331 A\u030a \u212b", "a\u2003b\u3000c\u2028d\u0085e\x1cf", "क्षत्रिय हिन्दी में", "ΣΑΣ ΟΔΟΣ",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_scripts_and_vocabularies(name):
    """Any script, and a vocabulary with another normalizer, pre-tokenizer and decoder."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    for tool in (bpe.Encoder(path), bpe.Encoder(path, backtrack=False)):
        for text in [*ODD, *SCRIPTS, " ".join(SCRIPTS * 3), "  two  spaces\n\nlines \t"]:
            ids = library.encode(text, add_special_tokens=False).ids
            for _ in range(2):  # cold and cached
                assert np.frombuffer(tool.encode([text])[0], "<u4").tolist() == ids
            assert tool.vocabulary.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAhHİıΣσ\u0301\u030a\u0331\u0085\xa0\u2003 \x1c\x1f\u200bжЖ漢’“1٣²."), max_size=25))
def test_marks_and_spaces(text):
    assert np.frombuffer(OURS.encode([text])[0], "<u4").tolist() == wanted(text)


def test_other_scripts_keep_pace():
    """Texts with curly quotes or of another script take no more than a few times as long as plain ones."""
    r = random.Random(3)
    made = lambda letters: [" ".join("".join(r.choices(letters, k=r.randint(2, 5))) for _ in range(400)) for _ in range(60)]
    plain = made("etaoinsh")

    def seconds(texts):
        tool = bpe.Encoder(PATH)
        tool.encode(texts)
        began = time.perf_counter()
        for _ in range(5):
            tool.encode(texts)
        return time.perf_counter() - began

    base = seconds(plain)
    assert seconds([t + " it’s “so”" for t in plain]) < 4 * base
    assert seconds(made("етаоинсх")) < 4 * base


def test_cache_turns_over():
    tool = bpe.Encoder(PATH, cache=50)
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abcdetn", k=r.randint(1, 5))) for _ in range(40)) for _ in range(40)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tool.encode(texts)] == [wanted(t) for t in texts]
    assert len(tool.words) < 200 and tool.words.size <= tool.words.most + 10_000


def test_digest_and_encode(spark, frame, by_id):
    rows = list(enumerate(ODD + SCRIPTS)) + [(900, None), (None, "null id"), (3, "again")]
    got = bpe.digest(frame(rows))
    assert got.count() == len(rows) and bpe.digest(frame([])).collect() == []
    seen = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect())

    def row(doc_id, text):
        ids = wanted(text or "")
        one = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return str(doc_id), len(ids), one(" ".join(map(str, ids))), one(LIBRARY.decode(ids, skip_special_tokens=False))

    assert seen == sorted(row(*r) for r in rows)
    full = by_id(bpe.encode(frame([(1, "Hello, hello!"), (2, None)]), columns=("doc_id", "size")))
    assert full[1]["ids"] == wanted("Hello, hello!") and full[1]["size"] == "x" and full[2]["ids"] == []
    assert full[1]["decoded_chars"] == len(LIBRARY.decode(full[1]["ids"])) and full[2]["decoded_chars"] == 0


# ---------------------------------------------------------------- packed ids


@pytest.mark.parametrize("width", [1, 3, 7, 8, 11, 15, 16, 17, 24, 31, 32])
def test_pack_round_trip(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 7, 100, 4097):
        ids = r.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        data = packed.pack(ids, width)
        assert len(data) == (n * width + 7) // 8
        assert packed.unpack(data, width, n).tolist() == ids.tolist()
        if n > 5:
            assert packed.unpack(data, width, 3, n - 4).tolist() == ids[n - 4 : n - 1].tolist()


def test_width():
    assert [packed.width_of(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("width", [5, 16])
def test_random_access(width):
    r = np.random.default_rng(0)
    ids = r.integers(0, 1 << width, 1000).astype(np.uint32)
    ends = np.array([0, 10, 10, 500, 1000])
    reader = packed.Reader(packed.container(ids, np.arange(5), ends, width, block=64))
    assert reader.all().tolist() == ids.tolist()
    for a, b in ((0, 1), (63, 65), (64, 128), (100, 999), (5, 5)):
        assert reader.unpack_range(a, b).tolist() == ids[a:b].tolist()
    assert [reader.document(k).tolist() for k in range(5)] == [ids[a:b].tolist() for a, b in zip([0, 0, 10, 10, 500], ends, strict=True)]
    with pytest.raises(ValueError, match="container"):
        packed.Reader(b"XXXX" + bytes(60))


def ids_of(text):
    return wanted(text or "") + [1]


def check_packed(rows, got):
    start = 0
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = ids_of(text)
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_packed_files(spark, frame):
    r = random.Random(2)
    rows = [(r.randrange(10**9), " ".join(r.choices(["the", "Wörter", "x1!"], k=r.randint(0, 50)))) for _ in range(300)]
    rows += [(-5, None), (-5, "twice"), (10**10, ""), (10**10 + 1, "long " * 70_000)]
    got = packed.digest(frame(rows)).orderBy("start").collect()
    same = [r["t"] for r in spark.createDataFrame([(None,), ("twice",)], "t string").orderBy(F.xxhash64("t")).collect()]
    check_packed(sorted(rows, key=lambda x: (x[0], same.index(x[1]) if x[0] == -5 else 0)), got)
    assert packed.digest(frame([])).collect() == []
    got = packed.digest(frame([(None, "no id"), (1, "one")])).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1]


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    check_packed(rows, packed.digest(docs).orderBy("start").collect())
