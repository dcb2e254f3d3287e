import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelry.llm import pack as P
from voxelry.llm import words as W
from voxelry.llm.store import written

ODD = ["a'street's !'s 5's 12'll don't", "x<|endoftext|>y <|startoftext|>", "…—. a…b é! K'K İstanbul a b c ≠ a̸ !́ ſ 'ſ", "\x1c\x00\x85 a\x1cb", "ÀÉ 'RE 'VE're", "日本語テキスト １２３ ٣٤ x²½", "'s", "''s'", "qui éa"]


def whole(text):
    return P.encoder(P.default_vocabulary()).full.encode(text or "", add_special_tokens=False).ids


def ours(texts):
    out = []
    for c in W.chunks(pa.array(texts, pa.string()), 64):
        ids, n = P.encoder(P.default_vocabulary()).ids(c)
        at = np.concatenate(([0], np.cumsum(n)))
        out += [ids[at[k] : at[k + 1]].tolist() for k in range(len(n))]
    return out


def test_ids_are_the_tokenizers(texts):
    some = [t for _, t in texts] + ODD
    assert ours(some) == [whole(t) for t in some]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'sré1.! \n ́K<|>", max_size=12), min_size=1, max_size=4))
def test_any_text(some):
    assert ours(some) == [whole(t) for t in some]


def check(pieces, rows, length):
    known = {}
    for d, t in rows:
        known.setdefault(d, []).append([*whole(t), 2])
    sequences, total, covered = {}, 0, {}
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in known[p.doc_id])
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
        total += p.length
    assert total == sum(len(x) for own in known.values() for x in own)
    assert {d: sum(n for _, n in c) for d, c in covered.items()} == {d: sum(map(len, own)) for d, own in known.items()}
    for s, own in sequences.items():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at == length or s == max(sequences)


def test_round_trip(docs, texts):
    for length in (4096, 64, 1):
        check(P.pack(docs.filter("doc_id < 140") if length == 1 else docs, length=length).collect(), [x for x in texts if length > 1 or x[0] < 140], length)


def test_sequences(docs):
    tokens = written(P.tokenised(docs.filter("doc_id < 150")), "tokens")
    pieces = P.packed(tokens, 512)
    got = {r.sequence_id: len(r.ids) for r in P.sequences(pieces, tokens).collect()}
    assert all(n == 4 * 512 for s, n in got.items() if s < max(got))


def test_empty_table(none):
    assert P.pack(none).count() == 0
