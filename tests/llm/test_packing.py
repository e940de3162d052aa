import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from odd_documents import ODD
from tallyloom.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def plain(text):
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def whole(pieces, window):
    """Sequences are gapless, and full but for those of a power of two."""
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


@pytest.mark.parametrize("window", [2048, 64, 3])
def test_odd_documents(odd, window):
    rows = packing.packed(odd, FILE, window=window).collect()
    whole(rows, window)
    # Documents may share an id: their pieces are told apart by taking them in any order that fits.
    pieces = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows))
    want = []
    for i, t in ODD:
        ids = plain(t)
        cuts = sorted({(r["start"], r["length"]) for r in rows if r["doc_id"] == i and r["doc_tokens"] == len(ids)})
        want.append((i, sum(n for _, n in cuts), ids))
    assert sum(len(ids) for _, _, ids in want) == sum(len(p[4]) for p in pieces)
    for i, t in ODD:
        ids = plain(t)
        covered = np.zeros(len(ids), int)
        for none, doc, tokens, start, part in pieces:
            if (None if none else doc) == i and tokens == len(ids) and list(part) == ids[start:start + len(part)]:
                covered[start:start + len(part)] += 1
        same = sum(1 for j, u in ODD if j == i and plain(u) == ids)
        assert (covered == same).all()


def test_word_ids_equal_the_tokenizer():
    known = packing.WordIds(FILE)
    random.seed(6)
    texts = ["Hello, World!", "don't stop's 'tis", "naïve Élan ÀÉÎõü", "a\x01b \x01 c", "12ab34", "İstanbul ΣΑΣ straße", "é́", "日本語テキスト", "🙂‍↔️", "...", "x" * 5000, "‘quoted’ — dash…", "a.b.c", "µ ª º ß÷×"]
    texts += ["".join(random.choices("abcXYZ.,!'é 1ÿ", k=20)) for _ in range(300)]
    for text in texts:
        words = text.encode().split()
        known.learn(set(words))
        assert b"".join(known[w] for w in words) == np.array(plain(text)[:-1], known.kind).tobytes(), text


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece_once(seed):
    random.seed(seed)
    window = random.choice([8, 64, 100, 257])
    histogram = [0] + [random.choice([0, 0, 1, 2, random.randint(0, 500)]) for _ in range(window - 1)]
    plan = packing.Plan(histogram, window)
    places, filled = plan.places(), {}
    for rest, count in enumerate(histogram):
        for rank in range(count):
            cuts, found = places[rest]
            pieces = found[packing.bisect_right(cuts, rank) - 1]
            at = 0
            for start, length, sequence, offset in pieces:
                assert start == at
                at += length
                filled.setdefault(sequence + rank, []).append({"sequence_id": sequence + rank, "offset": offset, "length": length})
            assert at == rest
    assert len(whole([p for ps in filled.values() for p in ps], window)) == plan.sequences
    assert len(plan.rows) < 40 * window


def test_least_squares_is_solved():
    columns = packing.combinations(16, grid=4)
    assert all(sum(c) == 16 and len(set(c)) == len(c) for c in columns)
    times = packing.solve([0] * 4 + [30, 0, 20, 0, 0, 0, 20, 0, 30, 0, 0, 0], columns, sweeps=200)
    used = {c: round(t) for c, t in zip(columns, times) if t > 0.5}
    assert used == {(4, 12): 30, (6, 10): 20}


def test_empty(empty):
    assert packing.packed(empty, FILE).count() == 0


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_ids_of_parts_have_the_kind_of_the_vocabulary(kind, monkeypatch):
    known = packing.WordIds(FILE)
    known.kind = kind
    monkeypatch.setattr(packing.np, "array", None)  # a part's ids are put together without an array of their own
    words = [b"Running,", b"running", b"\xc3\x89t\xc3\xa9s...", b"x\xc3\xa9"]
    known.learn(set(words))
    monkeypatch.undo()
    assert [np.frombuffer(known[w], kind).tolist() for w in words] == [plain(w.decode())[:-1] for w in words]


def test_texts_are_joined_without_a_pass_to_find_their_words():
    """Plain words are learned at their first look-up; texts with other words are read again once these are known."""
    known = packing.WordIds(FILE)
    plain_pattern, asked = known.plain, []
    known.plain = lambda word: asked.append(word) or plain_pattern(word)
    texts = ["Hello, World! hello (again) <tag>", "don't 12ab don't Élan!? naïve,", "", "It's a\x01b \x01 A.B c...d .,! x--- X- 日本語テキスト", "don't World!", "<|endoftext|> É́ a‘ ÀÉÎ—"]
    texts += [text.lower() for text in texts]
    words = [text.encode().split() for text in texts]
    want = [np.array(plain(text)[:-1], known.kind).tobytes() for text in texts]
    assert known.joined(words) == want and known.joined(words[::-1]) == want[::-1]
    assert not known.odd and not {"Hello,", "World!", "hello", "x---", "X-", "a"} & {*asked}


def test_the_vocabulary_is_forgotten_between_steps(monkeypatch):
    monkeypatch.setattr(packing, "_VOCABULARY", 3)
    monkeypatch.setattr(packing, "_PARTS", 2)
    known = packing.WordIds(FILE)
    for text in ["one two three four 5 6a", "one two 5 seven's", "eight", "one 6a"]:
        assert known.joined([text.encode().split()]) == [np.array(plain(text)[:-1], known.kind).tobytes()]
    assert len(known) <= 5 and len(known.parts) <= 4
