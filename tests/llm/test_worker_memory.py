"""Memory of an encoder's worker."""

import numpy as np

from strataweave.llm import bpe, queries


def test_a_worker_remembers_a_bounded_number_of_words():
    v = bpe.Vocabulary(queries.TOKENIZER)
    for k in range(3):
        data = " ".join(f"x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}{'abc'[k]}" for i in range(150_000)).encode()
        v.encode_plain(data, np.array([0, len(data)]))
    assert v._used <= 400_000


def test_unknown_words_are_encoded_side_by_side(monkeypatch):
    """Of 20,000 words that a worker doesn't know few are encoded one by one, and all as if they were."""
    v, rng = bpe.Vocabulary(queries.TOKENIZER), np.random.default_rng(4)
    letters = np.frombuffer("etaonishrdlu'xq09.é ".encode("latin-1"), np.uint8)
    words = [bytes(rng.choice(letters, n)).decode("latin-1") for n in rng.integers(1, 30, 20_000)] + ["=" * 40, "ab" * 300, "a"]
    pieces = [w.encode() for w in dict.fromkeys(words)]
    ends = np.cumsum([len(p) for p in pieces])
    got, counts = v.encode_pieces(b"".join(pieces), ends - [len(p) for p in pieces], ends)
    want = [v.encode_piece(p.decode("latin-1")) for p in pieces]
    assert counts.tolist() == [len(w) for w in want] and got.tolist() == [t for w in want for t in w]
    calls, one = [], bpe.Vocabulary.encode_piece
    monkeypatch.setattr(bpe.Vocabulary, "encode_piece", lambda self, piece: calls.append(1) or one(self, piece))
    text = " ".join(words).encode()
    ids, cuts = v.encode_plain(text, np.array([0, len(text)]))
    starts, stops = bpe.pre_tokens(text, np.array([0, len(text)]))
    assert ids.tolist() == [int(v.ids[t]) for a, b in zip(starts, stops) for t in one(v, text[a:b].decode("latin-1"))] and cuts[-1] == len(ids)
    assert len(calls) < 500
