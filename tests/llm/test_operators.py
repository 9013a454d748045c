import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import ann, exact_topk, mixing, packing, preferences, simhash, token_files, toxicity, unit_dedup, url_filters
from quarry.llm.chunks import encoder
from quarry.llm.common import components, global_row_number, scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 0.5) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    return docs_of(spark, [(1, "a b c d e f\nsame line of five words", "s"), (2, "same line of five words\nx", "t"), (3, None, None), (4, "", "s"), (None, "lost one", None), (5, long, "s"), (6, "a b c d e f\nsame line of five words", "u"), (6, "a b c d e f\nsame line of five words", "u"), (7, " \n\t ", "s")])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, []) if False else spark.createDataFrame([], DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ------------------------------------------------------------------ shared pieces
def test_components_and_numbers(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    n = global_row_number(spark.createDataFrame([(rng.randrange(50),) for _ in range(500)], "x int"), ["x"], "n").orderBy("n").collect()
    assert [r.n for r in n] == list(range(500)) and [r.x for r in n] == sorted(r.x for r in n)


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa

    rng = random.Random(2)
    letters = "a b'sté1 2\n\t\r  \x85\x1c\x1f<|endoftext|>́É中😀.,!_-  \x0b'll"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", " ", "a  b\n\nc ", "x" * 5000]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        e = encoder(name, kind)
        for _ in range(2):
            offsets, ids = e.encode(pa.array(texts))
            assert [list(ids[a:b]) for a, b in zip(offsets, offsets[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# ------------------------------------------------------------------ op1
def test_urls_by_rule_and_by_links(spark):
    link = '<a href="https://{}/x">'
    pages = [(1, "HTTP://A.Org/p?q", ""), (2, "http://example.org/en/12", ""), (3, "http://x.com/de/1", ""), (4, "http://y.net/", link.format("X.com")), (5, "http://a.org#f", link.format("z.net")), (6, "http://z.net/a", None), (7, None, None), (8, "nothing", ""), (8, "nothing", "")]
    got = {r.page_id: r for r in url_filters.filter_urls(spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, verdict string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.org", "/p", "org/", "allow")
    assert (got[2].rule, got[3].rule) == ("example.org/en/1", "com/de/")
    assert got[4].rule is None and got[4].verdict == "block" and got[4].distrust > 0  # it names a blocked host
    assert got[6].verdict == "allow" and got[6].trust > 0  # a trusted host names it
    assert (got[5].host, got[5].path, got[7].host, got[8].path, got[7].verdict) == ("a.org", "", "", "", "allow")
    tied = [(1, "http://good.org/a", '<a href="/menu/x">'), (2, "http://one.net/a", "<A HREF=/menu/x?y>"), (3, "http://bad.com/de/", "<a href='/shop'>"), (4, "http://two.net/a", '<form action="/shop#top">'), (5, "http://alone.net/", '<a href="/own"><a href="mailto:x@y"><a href="#z">' * 2000), (6, "http://10.0.0.1:80/", '<a href="HTTP://Two.net/">')]
    judged = url_filters.judged(spark.createDataFrame(tied, "page_id long, url string, html string"))
    edges = url_filters.host_edges(judged).collect()
    assert {(e.host, e.target) for e in edges} == {("good.org", "/menu/x"), ("one.net", "/menu/x"), ("bad.com", "/shop"), ("two.net", "/shop"), ("10.0.0.1:80", "//two.net"), ("two.net", "//two.net")}
    by = {r.page_id: r for r in url_filters.filter_urls(judged).collect()}
    assert by[2].trust > 0 == by[2].distrust and by[4].distrust > 0 and by[6].verdict == "block" and by[5].verdict == "allow"
    # a host as near to trusted as to blocked ones is blocked by no margin that asks for more distrust than trust
    even = [(1, "http://good.org/a", '<a href="/menu/x">'), (2, "http://bad.com/de/", "<a href='/shop'>"), (3, "http://both.net/", '<a href="/menu/x"><a href="/shop">')]
    even = url_filters.judged(spark.createDataFrame(even, "page_id long, url string, html string"))
    verdicts = [{r.page_id: r for r in url_filters.filter_urls(even, margin=m).collect()}[3] for m in (url_filters.MARGIN, -0.5)]
    assert abs(verdicts[0].trust - verdicts[0].distrust) * 10**6 < verdicts[0].trust
    assert [v.verdict for v in verdicts] == ["allow", "block"]
    assert url_filters.host_edges(url_filters.judged(spark.read.parquet(f"{SF}/pages.parquet"))).count() > 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.filter_urls(empty).count() == 0


# ------------------------------------------------------------------ op2
def test_mix_comes_near_targets(spark, odd, none):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("abcde")) for i in range(400)] + [(1000 + i, "v " * 3, "f") for i in range(3)]
    got = mixing.mix(docs_of(spark, rows)).toPandas()
    by = got.join(got.doc_id.map({i: s for i, _, s in rows}).rename("s")).groupby("s").agg(t=("taken", "sum"), target=("target", "first"))
    assert (got.taken <= 3 * got["size"]).all() and got.taken.sum() == got["size"].sum()
    assert ((by.t - by.target).abs() <= 60).all()
    again = mixing.mix(docs_of(spark, rows).repartition(3)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.mix(odd).count() == 9 and mixing.mix(none).count() == 0
    made = mixing.mixed(odd)
    assert made.columns == odd.columns
    assert sum(len(r.text.split()) for r in made.collect()) == mixing.mix(odd).agg(F.sum("taken")).first()[0]


# ------------------------------------------------------------------ op3
def test_threshold_algorithm_is_exact(spark):
    rng = np.random.default_rng(4)
    m = np.concatenate([np.floor(1024 * rng.normal(0, 0.1, (300, 8))), np.zeros((5, 8)), np.full((12, 8), 3.0)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(None, [1.0] * 8), (900, None), (800, [1.0, 2.0]), (7, [float(x) for x in m[7]])]
    got = collections.defaultdict(list)
    for r in exact_topk.exact_topk(spark.createDataFrame(rows, "id long, vector array<double>"), F.col("id") % 20 == 0, 10, block_rows=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, int(r.score)))
    for q in range(0, len(m), 20):
        s = m @ m[q]
        want = sorted(((-int(s[i]), i) for i in range(len(m)) if i != q))[:10]
        assert got[q] == [(i, -x) for x, i in want]
    assert 800 not in got  # it meets no vector of its length
    assert exact_topk.exact_topk(spark.createDataFrame([], "id long, vector array<double>"), F.col("id") % 2 == 0).count() == 0


# ------------------------------------------------------------------ op4
def test_automaton_finds_what_brute_force_finds():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["moron", "pathetic", "worthless", "disgusting"]
    trie, rng = toxicity.Trie(terms), random.Random(5)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "e", "o"])
        w = "".join(w) or "x"
        near = sorted((distance(w, t), t) for t in terms if distance(w, t) <= toxicity._errors(t))
        want = (near[0][1], near[0][0]) if near else None
        assert trie.near(w) == want
        assert want is None or trie.maybe(w)


def test_quotation_weighs_less_and_misspelling_is_found(spark, odd):
    lex = toxicity.Lexicon({"moron": 5.0}, {}, ("moron",))
    spoken = toxicity.found("you are a morron", lex)[1]
    assert spoken[0][2:4] == ("moron", 1) and spoken[0][5] == "addressed"
    assert [toxicity.found(t, lex)[1][0][5] for t in ('they wrote "moron" there', 'he wrote moron there', 'a moron there')] == ["quoted", "reported", "plain"]
    rng = random.Random(6)
    words = ["tree", "house", "river", "stone", "cloud"]
    rows = [(i, " ".join([rng.choice(words) for _ in range(30)] + (["scumbag", "idiotic"] if i % 4 == 0 else [])), "s") for i in range(400)]
    docs = docs_of(spark, rows + [(None, None, None), (9999, "", "s")])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400)) and got[9999] == got[None] < 0.5
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 302
    assert toxicity.learn(docs, labels.limit(0)).score("x")[0] == 0
    assert toxicity.toxicity(odd, model).count() == 9


# ------------------------------------------------------------------ op5, op7
def test_stripes_and_row_groups_are_pruned(spark, tmp_path):
    """One stripe can be read alone, and statistics and the Bloom filter skip what cannot hold a doc_id."""
    import glob

    from pyarrow import orc

    docs = docs_of(spark, [(2 * i, f"word{i} " * 40, "s") for i in range(6000)])
    token_files.write_token_files(docs, str(tmp_path / "t"), stripe_bytes=1 << 16, index_stride=1000, files=2)
    parts = sorted(glob.glob(str(tmp_path / "t" / "*.orc")))
    ends = []
    for p in parts:
        f = orc.ORCFile(p)
        assert f.nrows and f.nstripes >= 1
        ids = [x for i in range(f.nstripes) for x in f.read_stripe(i, ["doc_id"]).column("doc_id").to_pylist()]
        assert ids == sorted(ids) and len(ids) == f.nrows
        ends.append((ids[0], ids[-1]))
    assert ends == sorted(ends)  # file numbers follow doc_id

    def scanned(where):
        got = token_files.read_token_files(spark, str(tmp_path / "t")).where(where)
        assert got.collect() is not None
        metrics = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
        return metrics.apply("numOutputRows").value()

    whole, some, absent = scanned("doc_id >= 0"), scanned("doc_id = 10"), scanned("doc_id = 4001")
    assert whole == 6000 and some <= 2048 and absent < whole  # an odd doc_id is within the ranges: the Bloom filter tells


def test_token_files_come_back(spark, odd, none):
    path = scratch(spark, "t")
    token_files.write_token_files(odd, path)
    rows = token_files.digests(token_files.read_token_files(spark, path)).orderBy("start").collect()
    texts = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    tok, at, rows_by = encoder("word_bpe_49k.json", "word").tokenizer, 0, {r.doc_id: r for r in rows}
    for r, t in zip(rows, texts, strict=True):
        ids = np.array(tok.encode(t.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (t.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    one = token_files.read_token_files(spark, path).where("doc_id = 2")
    assert "EqualTo(doc_id,2)" in one._jdf.queryExecution().executedPlan().toString()  # reaches the ORC reader
    assert [len(r.ids) for r in one.collect()] == [rows_by[2].n_tokens]
    path = scratch(spark, "t")
    token_files.write_token_files(none, path)
    assert token_files.digests(token_files.read_token_files(spark, path)).count() == 0


packing_columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]


def test_packing_places_each_id_once(spark, odd, none):
    tok = encoder("byte_bpe_50k.json", "byte").tokenizer
    many = odd.unionByName(docs_of(spark, [(100 + i, "word " * (i * 13 % 700), "s") for i in range(120)]))
    got = packing.pack(many).withColumn('ids_crc32', F.crc32('ids')).toPandas()
    same = packing.pack(many, digest=True).toPandas()
    assert same[[*packing_columns]].equals(got[[*packing_columns]])
    seqs = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in seqs:
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
        assert s.length.sum() & (s.length.sum() - 1) == 0  # a power of two: no padding
    for r in odd.where("doc_id in (1, 5)").collect():
        ids = np.array(tok.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == r.doc_id].sort_values("start")
        assert own.length.sum() == len(ids) and (own.start == own.length.cumsum() - own.length).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("most, least", [(900, 1), (1024, 600), (6000, 1), (3, 1)])
def test_harmonic_bins_hold_whole_documents(most, least):
    rng = np.random.default_rng(most)
    packer, seen, numbers = packing.Packer(1024), collections.defaultdict(list), {}
    for w in range(5):
        lengths = rng.integers(least, most + 1, 1500)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        ids = rng.integers(0, 50_000, offsets[-1]).astype("<u4")
        numbers |= {(w, i): ids[offsets[i] : offsets[i + 1]] for i in range(1500)}
        for piece in packer.window([(w, i) for i in range(1500)], offsets, ids):
            seen[piece[0]].append(piece)
    for piece in packer.window([], np.zeros(1, np.int64), np.zeros(0, "<u4"), last=True):
        seen[piece[0]].append(piece)
    bins = collections.defaultdict(list)
    for d, ids in numbers.items():
        own = sorted(seen[d], key=lambda p: p[2])
        assert b"".join(p[5] for p in own) == ids.tobytes() and all(p[1] == len(ids) for p in own)
        assert [p[2] for p in own] == [0, *np.cumsum([len(p[5]) // 4 for p in own])[:-1]]
        for p in own:
            bins[p[3]].append((p[4], len(p[5]) // 4))
    totals = []
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        totals.append(int(ends[-1]))
    assert sorted(bins) == list(range(len(bins))) and all(t & (t - 1) == 0 and t <= 1024 for t in totals)
    assert sum(t < 1024 for t in totals) <= 10  # the last ones only
    short = [d for d, ids in numbers.items() if len(ids) <= 1024]
    whole = sum(len(seen[d]) == 1 for d in short) / len(short)
    assert whole >= {900: 0.6, 1024: 0.6, 6000: 0.97, 3: 0.99}[most], whole


# ------------------------------------------------------------------ op6
def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("hot", [200_000, 40])
def test_trie_join_links_as_brute_force(spark, hot):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (25, 3), dtype=np.uint64), axis=1) for b in base]]))
    want = brute_components(fps)
    assert list(simhash.trie_links(fps, np.array([0, len(fps)]))) == want
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 3, hot)).collect()}
    groups = lambda label: sorted(sorted(g) for g in label.values())
    a, b = collections.defaultdict(list), collections.defaultdict(list)
    for i, x in enumerate(fps.view(np.int64)):
        a[want[i]].append(int(x))
        b[got.get(int(x), int(x))].append(int(x))
    assert groups(a) == groups(b)


def test_simhash_of_odd_texts(spark, odd, none):
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("Aa B") == simhash.fingerprint("aA\t b") != 0
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == 9 and set(got[got.doc_id.isin([3, 4, 7])].component_id) == {3} and set(got[got.doc_id.isin([1, 6])].component_id) == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "None"]
    assert simhash.keep_one(none).count() == 0


# ------------------------------------------------------------------ op8
def test_common_turns_are_the_prompt(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "bad"), (2, 2, "user", None), (2, 2, "user", None), (3, 0, "user", "only"), (4, None, None, "x")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(0, 1, "chosen"), (0, 2, "rejected"), (1, 3, "chosen")], "pair_id long, conv_id long, side string")
    got = [(r.pair_id, r.segment, r.turn, r.text[r.mask_start : r.mask_start + r.mask_length], r.prompt_turns) for r in preferences.segments(t, pairs).orderBy("pair_id", "turn", "segment").collect()]
    assert got == [(0, "prompt", 0, "", 1), (0, "chosen", 1, "good<|im_end|>", 1), (0, "rejected", 1, "bad<|im_end|>", 1), (0, "rejected", 2, "", 1), (1, "chosen", 0, "", 0)]
    whole = {r.pair_id: r for r in preferences.records(preferences.segments(t, pairs)).collect()}
    one = whole[0]
    assert one.prompt == "<|im_start|>user\nq<|im_end|>\n" and one.usable and not whole[1].usable
    cut = lambda text, starts, sizes: [text[a : a + n] for a, n in zip(starts, sizes)]
    assert cut(one.chosen, one.chosen_starts, one.chosen_lengths) == ["good<|im_end|>"]
    assert cut(one.rejected, one.rejected_starts, one.rejected_lengths) == ["bad<|im_end|>"]
    assert preferences.pair_conversations(t.limit(0)).count() == 0
    empty = preferences.records(preferences.segments(t.limit(0), pairs.limit(0)))
    assert empty.count() == 0
    clash = t.withColumn("side", F.lit("x")).withColumn("pair_id", F.lit(1)).withColumn("segment", F.lit("y"))
    assert preferences.segments(clash, pairs).count() == 5


def test_conversations_left_over_get_anothers_answer(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 2, "user", "c"), (1, 3, "assistant", "y"), (2, 0, "user", "b"), (2, 1, "assistant", "z"), (3, 0, "user", "no answer"), (4, 0, "system", "s"), (4, 1, "assistant", "z"), (4, 1, "assistant", "z")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = preferences.pair_conversations(t).collect()
    assert sorted((r.conv_id, r.side) for r in pairs) == [(1, "chosen"), (1, "rejected"), (2, "chosen"), (2, "rejected"), (3, "chosen"), (4, "chosen"), (4, "rejected")]
    by_conv = {r.conv_id: r.pair_id for r in pairs}
    got = {r.pair_id: r for r in preferences.records(preferences.segments(t, preferences.pair_conversations(t))).collect()}
    first = got[by_conv[1]]
    assert first.prompt_turns == 3 and first.usable and first.chosen == "<|im_start|>assistant\ny<|im_end|>\n" and first.rejected == "<|im_start|>assistant\nz<|im_end|>\n"
    assert not got[by_conv[3]].usable
    said = {c: {r.answer for r in pairs if r.conv_id == c and r.side == "rejected"} for c in (2, 4)}
    assert {None} in said.values()  # 2 and 4 say the same: where one follows the other, its rejected side has no answer
    data = spark.read.parquet(f"{SF}/conversations.parquet")
    real = preferences.records(preferences.segments(data, preferences.pair_conversations(data))).collect()
    answered = {r.conv_id for r in data.where("role = 'assistant'").collect()}
    assert sum(r.usable for r in real) == len(answered) and all(r.prompt for r in real if r.usable)


# ------------------------------------------------------------------ op9
def test_lines_stay_where_they_come_first(spark, odd, none):
    own = unit_dedup.deduplicated(docs_of(spark, [(1, "one\n\ntwo words\none", "s"), (2, "Two  WORDS\nx", "s")])).collect()
    assert {r.doc_id: r.text for r in own} == {1: "one\n\ntwo words\n", 2: "x"}  # every line with a word is a unit
    got = {r.doc_id: r for r in unit_dedup.deduplicated(odd, **unit_dedup.PRODUCTION).collect()}
    assert got[1].text == "a b c d e f\nsame line of five words" and got[1].spans == []
    assert got[2].text == "x" and [(s.start, s.end, s.kept_id, s.kept_start) for s in got[2].spans] == [(0, 24, 1, 12)]
    assert got[6].text == "" and got[3].text is None and got[4].text == "" and got[None].text == "lost one"
    assert unit_dedup.deduplicated(odd, min_words=5).count() == 9 and unit_dedup.deduplicated(none).count() == 0
    two = docs_of(spark, [(1, "One two three\nfour five\n\nother", "s"), (2, "head\n\none  two three four FIVE\n \ntail", "s")])
    assert {r.doc_id: r.text for r in unit_dedup.deduplicated(two, by="paragraph", min_words=5).collect()}[2] == "head\n\ntail"


def test_passages_within_lines_go_and_lone_sentences_stay(spark):
    sentence = lambda n, k: " ".join(f"w{n}x{i}" for i in range(k)) + "."
    passage = " ".join([sentence(1, 3), sentence(2, 14), sentence(3, 20), sentence(4, 2), sentence(5, 16)])
    docs = docs_of(spark, [
        (4, f"Own words of four stand here. {passage} And so it ends with more.\nlast", "s"),
        (2, f"{sentence(6, 8)} {passage} {sentence(7, 9)}", "s"), (9, passage, "s"),
        (5, f"{sentence(8, 20)} {sentence(2, 14)} {sentence(9, 12)}", "s"),
        (7, f"{sentence(10, 30)} {sentence(3, 20)} Short. {sentence(5, 16)}", "s"), (8, f"x\n{sentence(3, 20)}\ny", "s"),
    ])
    got = {r.doc_id: r for r in unit_dedup.deduplicated(docs, **unit_dedup.PRODUCTION).collect()}
    assert got[2].spans == [] and got[5].spans == [] and got[7].spans == []
    assert got[4].text == "Own words of four stand here. And so it ends with more.\nlast" and {s.kept_id for s in got[4].spans} == {2}
    assert got[9].text == "" and got[8].text == "x\ny"


def test_units_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in unit_dedup.deduplicated(docs, **unit_dedup.PRODUCTION).collect()}
    first, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        spans, line, run = [], None, []
        for u in sorted(unit_dedup.units(r.text or "", "line", 5, 25), key=lambda u: (u[0], not u[4], u[1])):
            if u[4] or u[0] != line[0]:
                spans += [x for one in run if sum(x[3] for x in one) >= 25 for x in one]
                line, run = (u[0], u[4] and u[5] in first), []
                spans += [u] if line[1] else []
            elif not line[1] and u[5] in first:
                if run and run[-1][-1][2] == u[1]:
                    run[-1].append(u)
                else:
                    run.append([u])
            first.add(u[5])
        spans += [x for one in run if sum(x[3] for x in one) >= 25 for x in one]
        want[r.doc_id] = sorted((x[1], x[2]) for x in spans)
        out, at = "", 0
        for a, b in want[r.doc_id]:
            out, at = out + r.text[at:a], b
        assert got[r.doc_id].text == (None if r.text is None else out + r.text[at:])
    assert {i: [(s.start, s.end) for s in r.spans] for i, r in got.items()} == want and any(want.values())


# ------------------------------------------------------------------ op10
def test_recall_of_learned_partitions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    got = ann.search(rows, F.col("id") % 20 == 0).toPandas()
    table = rows.orderBy("id").toPandas()
    x, ids = np.stack(table.vector.to_numpy()), table.id.to_numpy()
    right = 0
    queries = ids[ids % 20 == 0]
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        right += len(set(got[got.query_id == q].vec_id) & set(np.argsort(-s)[:20]))
    assert right / (20 * len(queries)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (3, None), (40, [1.0])], "id long, vector array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.search(few, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()] == [(0, 1), (0, 2), (0, 20), (20, 0), (20, 1), (20, 2)]
    assert ann.search(few.limit(0), F.col("id") % 20 == 0).count() == 0


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, name)
        stage(spark, at, SF).write.parquet(path)
        at = spark.read.parquet(path)
        counts.append(at.count())
        assert name == "harmonic_packing" or at.columns == docs.columns
    assert 200 >= counts[0] > counts[1] == counts[2]
