import random

import pytest
import sentencepiece

from isobar.llm import pieces

PATH = f"{pieces.TOKENIZERS}/{pieces.MODEL}"


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(PATH)


def texts(spark, sf):
    found = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rng = random.Random(1)
    odd = ["", " ", "  ", " a", "a ", "a\n\n  b\t", " ▁ x ▁▁y", "日本語テスト😀 é́ \x00 \r\n", "x" * 500, " " * 77, "hello▁world", "ﬁ Å", "aaaa 0000 1234567"]
    return found + odd + ["".join(rng.choice("ab th in e  ▁\n#é日😀0") for _ in range(150)) for _ in range(100)]


def test_ids_are_the_librarys(spark, sf, model):
    own = texts(spark, sf)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in own:
        ids = list(model.encode(t))
        assert ids == library.encode(t)
        assert model.decode(ids) == t.replace("▁", " ")
    # Every segment has an open way: none was merged outright.
    assert model.outright == 0


def test_unigram_takes_the_best_sum(model):
    rng = random.Random(5)
    names = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    scores = [-rng.random() * 5 for _ in names]
    own = pieces.Pieces(names, scores, [], frozenset(), 0, False)
    low = min(scores) - 10

    def best(text):
        top = {0: 0.0}
        for end in range(1, len(text) + 1):
            ways = [top[end - len(n)] + s for n, s in zip(names, scores, strict=True) if len(n) <= end and text[end - len(n) : end] == n]
            ways += [top[end - 1] + low] if text[end - 1] not in names else []
            top[end] = max(ways)
        return top[len(text)]

    for _ in range(200):
        text = pieces.BLANK + "".join(rng.choice("abcz") for _ in range(12))
        ids = own.segment(text)
        assert abs(sum(scores[i] for i in ids if text) - best(text) - sum(scores[0] - low for c in text if c == "z")) < 1e-9


def test_words_are_encoded_once_whatever_follows_them(model, monkeypatch):
    made = []
    own = pieces.Pieces(model.pieces, model.scores, model.byte_ids, model.control, model.unknown, True)
    monkeypatch.setattr(pieces.Pieces, "segment", lambda self, x, f=pieces.Pieces.segment: made.append(x) or f(self, x))
    words = [f"{a}ing{b}" for a in "bcdfgh" for b in "aeiou"]
    text = " ".join(w + mark for w in words for mark in ",.;:!?")
    assert list(own.encode(text)) == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)
    assert len(made) == len(set(made)) == len(words) + 6


def test_a_position_with_an_open_way_has_no_second_one(model):
    # One pair test fewer for every link after the open one: of those made, one a position at most says yes.
    asked = []
    own = pieces.Pieces(model.pieces, model.scores, model.byte_ids, model.control, model.unknown, True)
    own._automaton()
    test = own._made["pairs"].make
    own._made["pairs"].make = lambda pair: asked.append(test(pair)) or asked[-1]
    for word in ("internationalisation", "athawhonthe", "éréauxtion"):
        asked.clear()
        own._made["pairs"].clear()
        own.segment(pieces.BLANK + word)
        assert sum(asked) <= len(word) + 1


def test_small_models_with_mixed_pieces_are_merged(spark):
    rng = random.Random(3)
    for _ in range(30):
        letters = [pieces.BLANK, *"ab1,_²é"]
        names = list(letters)
        while len(names) < 30:  # each piece is made of two before it; U+2581 stands at starts only
            a, b = rng.choice(names), rng.choice(names)
            if pieces.BLANK not in b.lstrip(pieces.BLANK) and (pieces.BLANK not in b or not a.strip(pieces.BLANK)) and a + b not in names:
                names.append(a + b)
        own = pieces.Pieces(names, [0.0] * len(letters) + [-float(k) for k in range(len(names) - len(letters))], [], frozenset(), 0, True)
        for _ in range(40):
            text = "".join(rng.choice("aabb11,,_²é  ▁\nz") for _ in range(rng.randrange(1, 40)))
            found = own.encode(text)
            whole = f" {text}".replace(" ", pieces.BLANK)
            assert "".join(own._made["cut"].findall(f" {text}")).replace(" ", pieces.BLANK) == whole
            assert list(found) == own._ids_of(own.merged(whole))


def test_kept_answers_are_bounded_and_right():
    kept = pieces._Kept(lambda x: x * 2, 10, 5)
    for k in [*range(40), 3, 3, 39]:
        assert kept["x" * (k % 9)] == "x" * (k % 9) * 2
        assert len(kept) + len(kept.older) <= 10 and all(len(x) <= 5 for x in kept)
    numbers = pieces._Kept(lambda x: -x, 10)
    for k in [*range(100), *range(100), 99, 98]:
        assert numbers[k] == -k and len(numbers) + len(numbers.older) <= 10


def test_round_trip_in_spark(docs, none, rows):
    encoded = pieces.encode(docs)
    found = encoded.collect()
    assert len(found) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in found)
    back = sorted((str(r.doc_id), r.text) for r in pieces.decode(encoded).collect())
    assert back == sorted((str(i), (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.encode(none).count() == 0
