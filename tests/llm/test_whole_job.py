"""Tests of what the review of round 1 found: misspelt words, pairs of conversations, near copies by their texts."""

import random
import zlib

import numpy as np

from quarry.llm import preferences, simhash, toxicity


def test_misspelt_forms_of_every_learned_word_are_found(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("bcdfglmnprstvz", k=10)) for _ in range(70)]
    ids = [i for i in range(3_000) if zlib.crc32(str(i).encode()) % 5]
    bad, good = ids[:300], ids[300:1800]
    # each name is in every toxic row; the rare word is in 8 of 300, under 3 %
    text = {i: " ".join(names) + (" bomentero" if n < 8 else "") for n, i in enumerate(bad)} | {i: "fair words here" for i in good}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i in set(bad))) for i in text], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, labels).lexicon
    assert set(names) | {"bomentero"} <= set(lexicon.words)
    # an error in the first letter: no learned beginning helps
    for word in [*names, "bomentero"]:
        assert lexicon["x" + word[1:]][1:] == (word, 1)


def test_piece_test_lets_every_near_word_through():
    rng = random.Random(4)
    terms = ["".join(rng.choices("abcdefgh", k=rng.randint(5, 14))) for _ in range(300)]
    trie = toxicity.Trie(terms)
    for term in terms:
        word = list(term)
        for _ in range(toxicity._errors(term)):
            i = rng.randrange(len(word))
            word[i] = rng.choice(["", "q", "q" + word[i]])  # one letter less, changed or more
        assert trie.maybe("".join(word))


def test_conversations_that_open_alike_meet(spark):
    # in order of their digests, so that an odd group comes before the even ones
    opens = ["b"] + ["d"] * 2 + ["c"] * 5 + ["e"] * 4 + ["a"]
    turns = [(i if i else None, 0, "user", o) for i, o in enumerate(opens)] + [(i if i else None, 1, "assistant", f"answer {i}") for i in range(len(opens))]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = preferences.pair_conversations(t)
    got: dict = {}
    for r in pairs.collect():
        got.setdefault(r.pair_id, {})[r.side] = r.conv_id
    alike = [p for p in got.values() if p["chosen"] != p.get("rejected")]
    assert len(alike) == 1 + 2 + 2 and all(opens[p["chosen"] or 0] == opens[p["rejected"] or 0] and (p["chosen"] or -1) < p["rejected"] for p in alike)
    assert sorted(got) == list(range(5 + 3)) and len({c for p in got.values() for c in p.values()}) == len(opens)
    prompts = {r.pair_id for r in preferences.segments(t, pairs).where("prompt_turns = 1").collect()}
    assert len(prompts) == 5 + 3


def test_near_copies_are_the_components_of_five_word_links(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(600)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(60, 160))
        texts.append(base)
        for _ in range(rng.randint(0, 12)):  # copies of the original, most of them less alike among themselves
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["short one", "Short  ONE", None, " \n"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict = {}
    for r in simhash.near_copies(docs).collect():
        got.setdefault(r.root, set()).add(r["__q_id"])
    want = {frozenset(i for i, r in enumerate(root) if r == x) for x in root}
    assert 25 < len(want) < len(texts) and set(map(frozenset, got.values())) == want
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(map(min, want))


def test_pairs_of_a_trie_are_those_of_brute_force():
    rng = random.Random(2)
    fps = sorted(rng.choice([0, 7, 1 << 9]) ^ (1 << rng.randrange(12)) for _ in range(60))
    label = np.array([rng.randrange(4) for _ in fps])
    tries = np.array(fps, np.uint64) << np.uint64(52)
    got = [(int(i), int(k)) for a, b in simhash.trie_pairs(tries, np.array([0, 60]), label, 2, 12, most=50) for i, k in zip(a, b)]
    want = {(i, k) for i in range(60) for k in range(i + 1, 60) if label[i] != label[k] and bin(fps[i] ^ fps[k]).count("1") <= 2}
    assert len(got) == len(want) and {tuple(sorted(x)) for x in got} == want
