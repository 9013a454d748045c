"""Toxicity: a learned lexicon whose trie meets Levenshtein automata, and scores by the context of what they find."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_of, settle, table

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
OPENING, CLOSING, PLAIN = "“„«‹", "”»›", "\""
#: Fixed word lists: who is spoken to, and who is reported.
YOU = frozenset("you your yours youre du dich dir dein deine ihr euch tu te toi vous votre vos usted ustedes tus vosotros".split())
SAID = frozenset("said says wrote writes quoted quote called calls word words term sagte schrieb nannte wort dit écrit appelé mot dijo escribió llamó palabra".split())
WINDOW = 6
#: Contexts in which a term is named rather than said.
ASIDE = ("quoted", "reported")
#: Longer terms are told from others by their pieces, as the ways to leave two letters out grow with the square.
LONG = 24


class Trie:
    """Terms as nested dicts; a node's term stands under the empty string."""

    def __init__(self, terms):
        self.root: dict = {}
        self.heads, self.middles, self.tails = set(), set(), set()
        self.cuts, self.lengths = (set(), set(), set()), (set(), set(), set())
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            e, n = _errors(term), len(term)
            if n <= LONG:
                # what is within e errors has a string in common with the term after e or fewer letters are left out of each
                self.cuts[e].update(_cuts(term, e))
                self.lengths[e].update(range(n - e, n + e + 1))
                continue
            # e errors leave one of e + 1 pieces of a term whole
            k = e + 1
            pieces = [term[n * i // k : n * (i + 1) // k] for i in range(k)]
            self.heads.add(pieces[0])
            self.middles.update(pieces[1:-1])
            self.tails.add(pieces[-1])
        self.sizes = [sorted({len(x) for x in p}) for p in (self.heads, self.tails, self.middles)]

    def near(self, word: str) -> tuple[str, int] | None:
        """The term of fewest errors within its budget, ties to the smaller term; None if there is none.

        The automaton of the word is kept as one bit set for each number of errors (bit i: i letters of the word
        are matched). It walks the trie; a branch ends where no bit is left.
        """
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        best = None
        stack = [(self.root, tuple((1 << (e + 1)) - 1 for e in range(3)))]
        while stack:
            node, sets = stack.pop()
            for c, child in node.items():
                if c == "":
                    for e in range(_errors(child) + 1):
                        if sets[e] >> n & 1:
                            if best is None or (e, child) < best:
                                best = (e, child)
                            break
                    continue
                mask = masks.get(c, 0)
                a = (sets[0] & mask) << 1
                b = (sets[1] & mask) << 1 | sets[0] | sets[0] << 1 | a << 1
                d = (sets[2] & mask) << 1 | sets[1] | sets[1] << 1 | b << 1
                if a | b | d:
                    stack.append((child, (a, b, d)))
        return (best[1], best[0]) if best else None

    def maybe(self, word: str) -> bool:
        """False only if no term can be near."""
        n = len(word)
        for e in range(3):
            if n in self.lengths[e] and not self.cuts[e].isdisjoint(_cuts(word, e)):
                return True
        for k in self.sizes[0]:
            if word[:k] in self.heads:
                return True
        for k in self.sizes[1]:
            if word[-k:] in self.tails:
                return True
        for k in self.sizes[2]:
            for i in range(len(word) - k + 1):
                if word[i : i + k] in self.middles:
                    return True
        return False


def _cuts(word: str, errors: int) -> list[str]:
    """The word with at most so many letters left out."""
    one = [word[:i] + word[i + 1 :] for i in range(len(word))] if errors else []
    return [word, *one, *[x[:i] + x[i + 1 :] for j, x in enumerate(one if errors > 1 else []) for i in range(j, len(x))]]


def _errors(term: str) -> int:
    """Errors that a term allows: short words have too many neighbours."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon(dict):
    """word -> (weight, term, errors) or None; answers are kept for words seen before, up to a bound."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], inexact: tuple[str, ...] = (), fine: frozenset[str] = frozenset(), room: int = 400_000):
        self.words, self.stems, self.inexact, self.fine, self.room = words, stems, inexact, fine, room
        self.trie = Trie(w for w in inexact if _errors(w))

    def __reduce__(self):
        return Lexicon, (self.words, self.stems, self.inexact, self.fine, self.room)

    def __missing__(self, word: str):
        if len(self) >= self.room:
            self.clear()
        self[word] = out = self.look(word)
        return out

    def look(self, word: str):
        if word in self.words:
            return self.words[word], word, 0
        if self.stems:
            for k in STEMS:
                if len(word) >= k and (stem := word[:k]) in self.stems:
                    return self.stems[stem], f"{stem}*", 0
        if len(word) >= 4 and word not in self.fine and self.trie.maybe(word) and (hit := self.trie.near(word)):
            return self.words[hit[0]], *hit
        return None


def found(text: str, lexicon: Lexicon) -> tuple[int, list[tuple[int, int, str, int, float, str]]]:
    """(words, hits); a hit is (start, end, term, errors, weight, context).

    Its context is `quoted` within quotation marks of its line, `reported` with a word of reporting within WINDOW
    words, `addressed` with a word that speaks to somebody there, else `plain`. What each is worth is learned.
    """
    words = WORD.findall(text.lower())
    marked = {w: got for w in set(words) if (got := lexicon[w])}
    if not marked:
        return len(words), []
    spans = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
    hits = []
    for i, (start, end, word) in enumerate(spans):
        if got := marked.get(word):
            near = {w for _, _, w in spans[max(0, i - WINDOW) : i] + spans[i + 1 : i + 1 + WINDOW]}
            line = text[text.rfind("\n", 0, start) + 1 : start]
            quoted = line.count(PLAIN) % 2 == 1 or sum(map(line.count, OPENING)) > sum(map(line.count, CLOSING))
            context = "quoted" if quoted else "reported" if near & SAID else "addressed" if near & YOU else "plain"
            hits.append((start, end, got[1], got[2], got[0], context))
    return len(words), hits


def features(n_words: int, hits: list) -> list[float]:
    """What the classifier sees: weights by context, exact and misspelt ones apart, so that it learns each one's worth."""
    direct = [h for h in hits if h[5] not in ASIDE]
    total = lambda some: math.log1p(sum(h[4] for h in some))
    by_context = [total(h for h in hits if h[5] == c) for c in ("quoted", "reported", "addressed")]
    dense = math.log1p(100 * sum(h[4] for h in direct) / max(n_words, 20))
    return [total(h for h in direct if not h[3]), total(h for h in direct if h[3]), *by_context, math.log1p(len({h[2] for h in direct if not h[3]})), dense, max([h[4] for h in direct], default=0.0)]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, means, scales) by Newton steps with an L2 penalty."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(a.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


class Model:
    def __init__(self, lexicon: Lexicon, weights, base: float):
        self.lexicon, self.weights, self.base = lexicon, weights, base

    def score(self, text: str) -> tuple[float, list]:
        n, hits = found(text, self.lexicon)
        if self.weights is None:
            return self.base, hits
        w, mean, scale = self.weights
        z = float(((np.array(features(n, hits)) - mean) / scale) @ w[:-1] + w[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits


def held_out():
    """Rows kept from learning: unsigned crc32 of doc_id as text divides by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Fit on at most max_rows labelled documents that are not held out, the smallest hashes of doc_id.

    Terms are words and word beginnings that toxic rows hold far more often than others: the log ratio, less one
    standard error, is at least 2.5, in three rows and 1 % of the toxic ones at least. So there are at most 100 times
    as many as a toxic row has of them on average; none is cut off. Misspelt forms are looked for of every such word
    that is long enough to allow an error. The classifier is fitted crosswise: each half of the rows is scored with
    the other half's lexicon. Several labels of one doc_id count as toxic if one is, of several texts of one doc_id
    the smallest teaches; null labels and null doc_ids teach nothing. Without both classes every score is the toxic
    share.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # max_rows rows of two numbers: the broadcast's size is bounded
    rows = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.select("text", "toxic", (F.xxhash64("doc_id") % 2 != 0).cast("int").alias("half"))
    rows = settle(rows)

    def count(batches):
        for batch in batches:
            seen: dict = {}
            for text, toxic, half in zip(batch.column("text"), batch.column("toxic").to_pylist(), batch.column("half").to_pylist()):
                words = set(WORD.findall(text.as_py().lower()))
                for term in words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}:
                    seen.setdefault((half, term), [0, 0])[toxic > 0] += 1
            if seen:
                keys, n = list(zip(*seen)), np.array(list(seen.values()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), pa.array(keys[1]), pa.array(n[:, 1]), pa.array(n[:, 0])], ["half", "term", "bad", "good"])

    per_half = rows.mapInArrow(count, "half int, term string, bad long, good long").groupBy("half", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    terms = settle(per_half.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("half") == h, F.col(c))), F.lit(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("bad", "good")]))
    totals = {(r.half, r.toxic > 0): r.n for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    size = {h: (totals.get((h, True), 0), totals.get((h, False), 0)) for h in (0, 1)}
    bad, good = size[0][0] + size[1][0], size[0][1] + size[1][1]
    if not bad or not good:
        return Model(Lexicon({}, {}), None, bad / max(1, bad + good))

    def lexicon(b, g, toxic: int, other: int) -> Lexicon:
        ratio = F.log((b + 0.5) / (toxic + 1)) - F.log((g + 0.5) / (other + 1))
        sure = ratio - F.sqrt(1 / (b + 0.5) + 1 / (g + 0.5))
        kept = terms.where((b >= max(3, 0.01 * toxic)) & (sure >= 2.5)).select("term", sure.alias("sure"))
        pick = lambda is_stem: kept.where(F.col("term").endswith("*") == is_stem).orderBy(F.desc("sure"), "term").collect()
        words, stems = {r.term: r.sure for r in pick(False)}, {r.term.rstrip("*"): r.sure for r in pick(True)}
        # a beginning makes up for longer ones under it only if it is about as sure as they are
        stems = {s: v for s, v in stems.items() if not any(s[:k] in stems and stems[s[:k]] >= v - 0.5 for k in STEMS if k < len(s))}
        first = Lexicon(words, stems, tuple(words))

        def near(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([t for t in batch.column("term").to_pylist() if (x := first.look(t)) and x[2]], pa.string())], ["term"])

        # words of clean rows that lie near a term mean themselves
        fine = terms.where((g > 0) & ~F.col("term").endswith("*")).select("term").mapInArrow(near, "term string").collect()
        return Lexicon(words, stems, tuple(words), frozenset(r.term for r in fine))

    c = F.col
    halves = {h: lexicon(c(f"bad{h}"), c(f"good{h}"), *size[h]) for h in (0, 1)} if all(min(size[h]) for h in (0, 1)) else None
    whole = lexicon(c("bad0") + c("bad1"), c("good0") + c("good1"), bad, good)

    def describe(batches):
        for batch in batches:
            out = []
            for text, half in zip(batch.column("text"), batch.column("half").to_pylist()):
                out.append(features(*found(text.as_py(), halves[1 - half] if halves else whole)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    fitted = rows.mapInArrow(describe, "x array<double>, toxic int").collect()  # max_rows short rows
    x, y = np.array([r.x for r in fitted]), np.array([float(r.toxic > 0) for r in fitted])
    order = np.lexsort((*x.T, y))  # sums of the fit do not depend on the order of rows
    return Model(whole, logistic(x[order], y[order]), bad / (bad + good))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs' rows as doc_id, __q_id, __q_text, score, hits of the whole texts.

    hits: array of struct<start, end, term, errors, weight, context>. A null or empty text has no hits and the
    score of a text without any; null doc_ids and repeated rows are scored like others; other columns are left
    out; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("errors", pa.int32()), ("weight", pa.float64()), ("context", pa.string())]))

    def run(batches):
        for batch in batches:
            got = [model.score(t.as_py() or "") for t in batch.column("text")]
            hits = [[dict(zip(("start", "end", "term", "errors", "weight", "context"), h)) for h in x] for _, x in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__q_id"), batch.column("__q_text"), pa.array([s for s, _ in got], pa.float64()), pa.array(hits, kind)], ["doc_id", "__q_id", "__q_text", "score", "hits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, __q_id long, __q_text long, score double, hits array<struct<start:int,end:int,term:string,errors:int,weight:double,context:string>>"
    return rows.select("doc_id", "text", *key_of()).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; columns are those of docs, texts are read once.

    Null and empty texts score as texts without hits; null doc_ids and repeated rows are judged like others; an empty
    table gives no rows.
    """

    def run(batches):
        for batch in batches:
            keep = [model.score(t.as_py() or "")[0] < threshold for t in batch.column("text")]
            yield batch.filter(pa.array(keep))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document, learned from those that are not held out; nulls and repeats as in toxicity()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    count = lambda test: F.size(F.filter("hits", test)).cast("long")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), count(lambda h: ~h["context"].isin(*ASIDE)).alias("direct_hits"), count(lambda h: h["context"].isin(*ASIDE)).alias("quoted_hits"), count(lambda h: h["errors"] > 0).alias("misspelt_hits"))
