import hashlib
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docspark.llm import bpe_encode, packing
from tests.llm.data import ROWS, awkward, empty

WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "It's <|endoftext|> we'll ΣΑΣ<|startoftext|>x  <|foo|> 123 4½ é a\x1cb 　q\x85z ​ İI ﬁ 🙂 !!??", "a\n b", "a \nb", "a   b", "a\xa0 b", " a", "a  ", "\n", "नमस्ते 漢字  x", "x" * 90 + " 'tis"]


def test_encode_equals_library(spark):
    library = Tokenizer.from_file(WORDS)
    texts = [t or "" for _, t, *_ in ROWS] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in bpe_encode.encode_texts(df, WORDS, lexicon_words=50, full=True).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        want = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded, r.ids_sha256, r.decoded_sha256) == (len(ids), *want, *map(sha, want))
    assert bpe_encode.encode_texts(awkward(spark), WORDS).count() == len(ROWS)
    assert bpe_encode.encode_texts(empty(spark), WORDS).count() == 0


def test_lexicon_is_minimal_and_exact():
    words = {"walking": [1, 2], "talking": [3], "walk": [4, 5, 6], "talk": [], "é": [7]}
    found = bpe_encode.Lexicon(bpe_encode.compile_lexicon(words))
    assert {w: found.find(w) for w in words} == words
    assert all(found.find(w) is None for w in ("", "wal", "walks", "x"))
    assert len(found.final) < 1 + sum(len(w.encode()) for w in words)  # suffixes are shared


def test_byte_ids_equal_library():
    library, own = Tokenizer.from_file(BYTES), packing.ByteBpe(BYTES)
    for t in [x[1] or "" for x in ROWS] + ODD:
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("shares", [None, {"a": 0.6, "b": 0.3}])
def test_pack(spark, shares):
    library = Tokenizer.from_file(BYTES)
    df = awkward(spark).repartition(3)
    rows = packing.pack(df, BYTES, seq_len=64, window_sequences=2, shares=shares, with_ids=True).collect()
    texts, at = defaultdict(list), defaultdict(int)
    for i, t, *_ in ROWS:
        texts[i].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    total = sum(len(x) for v in texts.values() for x in v)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at[r.sequence_id] == r.offset and r.length > 0  # gapless
        at[r.sequence_id] += r.length
        assert any(len(x) == r.doc_tokens and x[r.start : r.start + r.length] == r.ids for x in texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
    assert sum(at.values()) == total and sorted(at) == list(range(-(-total // 64))) and sorted(at.values())[1:] == [64] * (len(at) - 1)
    for i, v in texts.items():  # every id in one piece
        assert sum(r.length for r in rows if r.doc_id == i) == sum(map(len, v))
    assert packing.pack(empty(spark), BYTES).count() == 0


def test_schedule_is_deficit_round_robin(spark):
    import random
    random.seed(3)
    chunks = [(p, n, random.choice("aabc"), random.randint(1, 20)) for p in range(4) for n in range(60)]
    sent = defaultdict(int)
    df = []
    for p, n, s, k in chunks:
        df.append((p, n, s, k, sent[p, s]))
        sent[p, s] += k
    got = packing.schedule(spark.createDataFrame(df, "part int, n long, source string, length int, before long"), 64, {"a": 0.5, "b": 0.25, "c": 0.25}).collect()
    queues = {s: [(p, n, k) for p, n, t, k in chunks if t == s] for s in "abc"}
    deficit, at, want = defaultdict(float), 0, {}
    while any(queues.values()):
        for s, q in (("a", 32.0), ("b", 16.0), ("c", 16.0)):
            deficit[s] += q
            while queues[s] and queues[s][0][2] <= deficit[s]:
                p, n, k = queues[s].pop(0)
                deficit[s] -= k
                want[p, n] = at
                at += k
    assert {(r.part, r.n): r["at"] for r in got} == want
