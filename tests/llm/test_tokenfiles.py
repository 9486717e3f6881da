import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import tokenfiles
from tests.llm.data import frame, rows

TRICKY = ["it's <|endoftext|> here", "a<|startoftext|>b <|startoftext|>", "Σίσυφος ΟΔΟΣ x́y é z w", "1234 don't, 'll", "\x1c a\x85b", "中文 字 🙂"]


def reference(texts):
    t = Tokenizer.from_file(tokenfiles.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_files_give_the_ids_back(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", block)
    monkeypatch.setattr(tokenfiles, "RANGE_BYTES", 20_000)
    data = rows() + [(500 + i, x, None, None, None) for i, x in enumerate(TRICKY)] + [(None, "no id", None, None, None)]
    tokenfiles.write(spark, frame(spark, data), f"file://{tmp_path}/t")
    got = tokenfiles.read(spark, f"file://{tmp_path}/t").collect()
    data.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r, ids in zip(data, reference([r[1] for r in data]), strict=True):
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted((r.doc_id or -1, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got) == sorted((w[0] or -1, *w[1:]) for w in want)


def test_blocks_round_trip_and_damage_shows():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (7, 300), (5000, 49000), (400_000, 100_000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        blob = tokenfiles.write_block([7, None], np.array([n, 0]), ids)
        docs, counts, back = tokenfiles.read_block(blob)
        assert docs == [7, None] and counts.tolist() == [n, 0] and back.tolist() == ids.tolist()
    with pytest.raises(ValueError):
        tokenfiles.read_block(blob[:-1] + bytes([blob[-1] ^ 1]))


def test_chunks_share_letters_but_keep_their_ids():
    texts = ["Ab ab. AB, ab., ab.. ..ab a.b Straße. STRASSE İx x.! !! | a| é. É, …. z…. Dz't don't. DON'T ''s", "<|endoftext|> <|ENDOFTEXT|> A<|b", "ends.\n", "ends.", "a.\u00a0b ﬁ. ǅ ª. ²a"]
    coder = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    got = [ids.tolist() for t in texts for ids, _ in coder.encode([t.encode()])]
    assert got == reference(texts)


@pytest.mark.parametrize("before", ["", 'foo) word) end" x] done” <|endoftext|> য়'])
def test_ids_do_not_depend_on_the_texts_before(before):
    texts = ["foo).", "word), x];", 'end",', "done”.", "<|ENDOFTEXT|>.", "য়, aয়.", "foo) foo). foo"]
    coder = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    list(coder.encode([before.encode()]))
    got = [ids.tolist() for t in texts for ids, _ in coder.encode([t.encode()])]
    assert got == reference(texts)


def test_one_long_lived_encoder_agrees_with_the_library_in_any_order():
    rng = random.Random(5)
    words = ["foo", "Bar", "x", "23", "don't", "it's", "http://a.b/", "end)", "(see", "[4]", "“q”", "é", "Straße", "ǅ", "ﬁ", "\u0301x", "\u0338", "=", "<|", "<|endoftext|>", "|>", "য়", "İ", "中文", "🙂", "a_b", "50%", "\u00a0", "\x1c", "ª", "²"]
    tails = ["", ".", ",", "!", ";", ":", "#", "*", "&", "|", ")", '"', "”", "...", ").", '",', "/.", "—", "\u0338"]
    one = lambda: rng.choice(["", "", "(", '"', "["]) + rng.choice(words) + (rng.choice(words) if rng.random() < 0.3 else "") + rng.choice(tails) + rng.choice(tails)
    texts = [rng.choice([" ", "  ", "\n"]).join(one() for _ in range(rng.randint(0, 7))) for _ in range(25_000)]
    tokenizer = Tokenizer.from_file(tokenfiles.default_tokenizer())
    want = [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    coder = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
        got = []
        for lo in range(0, len(order), 500):
            for ids, counts in coder.encode([texts[i].encode() for i in order[lo : lo + 500]]):
                got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert all(g == want[i] for i, g in zip(order, got, strict=True))


def test_another_tokenizer_gets_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = tokenfiles.Encoder(path)
    assert not coder.cut and tokenfiles.Encoder(tokenfiles.default_tokenizer()).cut
    texts = ["Two  words, and\n more.", "", "x"]
    ids, counts = next(coder.encode([t.encode() for t in texts]))
    t = Tokenizer.from_file(path)
    assert ids.tolist() == [i for x in texts for i in t.encode(x, add_special_tokens=False).ids + [2]] and counts.tolist()[1] == 1


@pytest.mark.parametrize("ranges", [400, 20_000])
def test_ids_do_not_depend_on_partitions(spark, monkeypatch, tmp_path, ranges):
    monkeypatch.setattr(tokenfiles, "RANGE_BYTES", ranges)
    data = [(None, f"lost {i}). done”", None, None, None) for i in range(40)] + [(5, f"{i} (copy {i}).", None, None, None) for i in range(40)] + rows(20)
    tokenfiles.write(spark, frame(spark, data), f"file://{tmp_path}/t")
    got = tokenfiles.read(spark, f"file://{tmp_path}/t").collect()
    order = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in order] == sorted((r[0] is not None, r[0] or 0) for r in data)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]
    assert sorted(tuple(r.ids) for r in got) == sorted(map(tuple, reference([r[1] for r in data])))


def test_no_documents(spark):
    assert tokenfiles.encoded(spark, frame(spark, [])).count() == 0
