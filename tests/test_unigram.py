"""The compiled character map and the unigram lattice: against plain rules and all segmentations; ids of texts put together from distinct words."""

import random
from itertools import combinations

import pytest

from lectern.operators import unigram

RULES = {"é": "e", "ﬁ": "fi", "é": "e", "½": "1⁄2", "\t": " ", "　": " ", "가": "ga", "가나": "never", "ab": "X", "​": "", "🏳️‍🌈": "flag"}


def test_a_map_is_read_from_its_bytes_shortest_match_first():
    rules = unigram.CharacterMap(unigram.compiled(RULES))
    for key, value in RULES.items():
        want = "ga" if key == "가나" else value
        assert rules.value(key.encode()) == want
    assert rules.value("é?".encode()) == "e" and rules.value(b"") is None and rules.value(b"a") is None and rules.value("z".encode()) is None
    assert rules.normalise("café café\tﬁn ½ 가나 x​y") == "cafe cafe fin 1⁄2 ga나 xy"
    assert rules.normalise("ab") == "ab"  # two graphemes, each looked up alone
    assert rules.normalise("🏳️‍🌈") == "🏳️‍🌈"  # longer than a whole look-up: code point by code point


def test_maps_of_random_rules():
    rng = random.Random(1)
    for _ in range(20):
        keys = {"".join(rng.choices("aáŕ가😀b", k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 40))}
        rules = {k: "".join(rng.choices("xyz ", k=rng.randrange(0, 3))) for k in keys}
        found = unigram.CharacterMap(unigram.compiled(rules))
        for probe in [*keys, *("".join(rng.choices("aáŕ가😀bq", k=3)) for _ in range(50))]:
            data = probe.encode()
            want = next((rules[data[:n].decode(errors="ignore")] for n in range(1, len(data) + 1) if data[:n] in {k.encode() for k in rules}), None)
            assert found.value(data) == want


def all_ways(word, pieces, unknown, unknown_score):
    best = None
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            bounds = [0, *cuts, len(word)]
            parts = [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            if all(p in pieces or len(p) == 1 for p in parts):
                score = sum(pieces[p][1] if p in pieces else unknown_score for p in parts)
                ids = [pieces[p][0] if p in pieces else unknown for p in parts]
                best = max(best or (score, []), (score, [i for k, i in enumerate(ids) if not (i == unknown and k and ids[k - 1] == unknown)]), key=lambda x: x[0])
                if best[0] == score and not best[1]:
                    best = (score, ids)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_the_lattice_finds_the_best_of_all_ways(seed):
    rng = random.Random(seed)
    pieces = {}
    for k in range(30):
        pieces.setdefault("".join(rng.choices("▁abc", k=rng.randrange(1, 4))), (k + 1, -float(2 ** (k % 7) + k / 64)))
    ways = unigram.Lattice(pieces, 0)
    for _ in range(150):
        word = "▁" + "".join(rng.choices("abcd", k=rng.randrange(0, 8)))
        ids = ways.ids(word)
        score, _ = all_ways(word, pieces, 0, ways.unknown_score)
        back = {i: (p, s) for p, (i, s) in pieces.items()}
        told = sum(back[i][1] for i in ids if i)
        unknown = len(word) - sum(len(back[i][0]) for i in ids if i)
        assert told + unknown * ways.unknown_score == pytest.approx(score)
        assert not any(a == b == 0 for a, b in zip(ids, ids[1:], strict=False))


def test_ties_go_to_the_longest_last_piece():
    pieces = {"▁": (1, -1.0), "a": (2, -1.0), "b": (3, -1.0), "ab": (4, -2.0), "▁a": (5, -2.0)}
    assert unigram.Lattice(pieces, 0).ids("▁ab") == [1, 4]


def test_marked_words():
    assert unigram.words_of("a  b") == ["▁a", "▁b"] and unigram.words_of("a ") == ["▁a", "▁"] and unigram.words_of(" ") == ["▁"] and unigram.words_of("") == []
    assert unigram.words_of("▁x▁▁y") == ["▁x", "▁", "▁y"]


def test_texts_are_put_together_from_distinct_words(spark, tmp_path):
    rng = random.Random(4)
    words = ["casa", "café", "ﬁn", "x" * 40, "niño", "a", "<s>", "b<mask>c"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(60)] + [None, "", "  ", "casa " * 3000]
    vocabulary = [(k + 3, p, -float(k + 1)) for k, p in enumerate(["▁", "▁ca", "sa", "casa", "fe", "f", "i", "n", "x", "xx", "a", "o", "b", "c"])]
    special = {"<s>": 1, "<mask>": 2}
    docs = spark.createDataFrame([(i % 50, t, "z") for i, t in enumerate(texts)], "id long, text string, word string")
    table = spark.createDataFrame(vocabulary, "id int, piece string, score double")
    blob = unigram.compiled(RULES)
    got = sorted((r.id, r.ids) for r in unigram.encoded(docs, table, f"{tmp_path}/t", blob, 0, special).collect())
    rules, ways = unigram.CharacterMap(blob), unigram.Lattice({p: (i, s) for i, p, s in vocabulary}, 0)

    def direct(text):
        out, rest = [], text or ""
        while rest:
            at = min((rest.find(s) for s in special if s in rest), default=len(rest))
            for w in unigram.words_of(rules.normalise(rest[:at])):
                out += ways.ids(w)
            rest = rest[at:]
            for s, i in special.items():
                if rest.startswith(s):
                    out.append(i)
                    rest = rest[len(s) :]
                    break
        return out

    assert got == sorted((i % 50, direct(t)) for i, t in enumerate(texts))


def test_a_public_vocabulary_as_a_table(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    rows = [(i, model.id_to_piece(i), model.get_score(i)) for i in range(3, model.get_piece_size()) if not model.is_byte(i)]
    table = spark.createDataFrame(rows, "id int, piece string, score double")
    docs = spark.createDataFrame([(1, "the house is on the hill")], "id long, text string")
    ids = unigram.encoded(docs, table, f"{tmp_path}/t").first().ids
    assert "".join(model.id_to_piece(i) for i in ids) == "▁the▁house▁is▁on▁the▁hill" and len(rows) > 30_000


def test_texts_are_encoded_without_a_shuffle(spark, tmp_path):
    table = spark.createDataFrame([(1, "▁a", -1.0), (2, "b", -2.0)], "id int, piece string, score double")
    docs = spark.createDataFrame([(1, "a ab"), (1, None), (None, "b")], "id long, text string")
    found = unigram.encoded(docs, table, f"{tmp_path}/t")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.id, r.ids) for r in found.collect()), key=repr) == [(1, [1, 1, 2]), (1, []), (None, [0, 2])]


def test_words_forgotten_are_found_again(monkeypatch):
    monkeypatch.setattr(unigram, "WORDS_REMEMBERED", 4)
    ways = unigram.Lattice({c: (k + 1, -float(k)) for k, c in enumerate("▁abc")}, 0)
    known, rng = unigram.WordIds(ways), random.Random(3)
    for _ in range(300):
        word = "▁" + "".join(rng.choices("abcd", k=2))
        assert known[word].tolist() == ways.ids(word) and len(known) <= 2 and len(known.older) <= 2
