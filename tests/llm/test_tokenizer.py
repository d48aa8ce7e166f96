import os
import random

import pytest

from tracewright.llm.tokenizer import LEXICON_BYTES, RANK_FILE, TOKENIZER_DIR, Encoder, Lexicon, encode_corpus, merge_word, ranks_of

PATH = f"{TOKENIZER_DIR}/{RANK_FILE}"
TEXTS = ["", None, " ", "Hello world", "<|endoftext|> is text", "a" * 4000, "ab" * 900, "été naïve ß ﬁ 👩‍👩‍👧 計画", "\r\n\t  x  \n", "1234567 ½ ١٢", "don't they'll", "z" * 33]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="needs the public vocabulary files")


def test_column_equals_library_and_round_trips(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "", "x")], "k int, text string, ids string")
    rows = encode_corpus(df, "text", count="n").collect()
    assert len(rows) == len(TEXTS) + 1
    back = {i: b for b, i in ranks_of(PATH).items()}
    for r in rows:
        assert r.ids == reference(r.text or "")
        assert r.n == len(r.ids)
        assert b"".join(back[i] for i in r.ids) == (r.text or "").encode()
    assert encode_corpus(df.limit(0), "text").count() == 0
    assert [r.n for r in encode_corpus(df, "text", ids=None, count="n").orderBy("k").collect()][0] == 0


def test_lexicon_is_minimal_exact_and_mappable(tmp_path):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode() for _ in range(400)} | {b"x" * LEXICON_BYTES}
    held = {w: [len(w), i] for i, w in enumerate(sorted(words))}
    lexicon = Lexicon.build(held)
    lexicon.save(str(tmp_path / "l"))
    lexicon = Lexicon.load(str(tmp_path / "l"))
    probe = sorted(words) + [b"", b"d", b"ab" * 40, b"abcabcabcabc", b"x" * (LEXICON_BYTES - 1)]
    place = lexicon.find(probe)
    for w, p in zip(probe, place, strict=True):
        if w in held:
            assert lexicon.ids[lexicon.offsets[p] : lexicon.offsets[p + 1]].tolist() == held[w]
        else:
            assert p == -1
    # minimal: no two states with the same right language
    moves = [(int(lexicon.final[s]), tuple(zip(lexicon.byte[a:b].tolist(), lexicon.target[a:b].tolist(), strict=True))) for s, (a, b) in enumerate(zip(lexicon.first[:-1], lexicon.first[1:], strict=True))]
    assert len(set(moves)) == len(moves)
    assert Lexicon.build({}).find([b"a"]).tolist() == [-1]


def test_ids_do_not_depend_on_the_lexicon():
    ranks = ranks_of(PATH)
    e1 = Encoder(PATH, None)
    e2 = Encoder(PATH, Lexicon.build({w.encode(): merge_word(w.encode(), ranks) for w in ("Hello", " world", "a")}))
    for e in (e1, e2):
        assert e.batch(TEXTS)[1].tolist() == e1.batch(TEXTS)[1].tolist()
