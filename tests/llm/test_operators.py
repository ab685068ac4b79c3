"""Operators against brute force, on whole small tables and on awkward rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import ann, decontaminate, language, licenses, lines, mixing, quality_pu, queries, simhash, sstable, suffix

DATA = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog and runs far away from it all\n"
AWKWARD = [(1, None), (2, ""), (3, " \n "), (4, LONG * 3), (5, LONG * 3), (5, LONG), (None, LONG), (7, "ab"), (8, "a " * 3000), (9, "x" * 9000), (10, LONG + "é ß 中文 end"), (11, "How many miles, Anna, are 12 km from Rome? " * 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, i) for i, t in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, h long")


def test_simhash(spark, docs, odd):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for df in (docs.select("doc_id", "text"), odd):
        rows = [(r.doc_id, fp(r.text)) for r in df.collect()]
        for cap in (32, 1):
            got = sorted(simhash.near_duplicates(df, cap).collect(), key=str)
            assert sorted((r.doc_id, r.fp % 2**64) for r in got if r.doc_id is not None) == sorted(x for x in rows if x[0] is not None)
            group = {f: f for _, f in rows}
            changed = True
            low = {f: min((i for i, g in rows if g == f and i is not None), default=None) for f in group}
            while changed:
                changed = False
                for a in low:
                    for b in low:
                        if (a ^ b).bit_count() <= 2 and low[b] is not None and (low[a] is None or low[b] < low[a]):
                            low[a], changed = low[b], True
            assert all(r.component_id == low[r.fp % 2**64] for r in got)


def test_suffix(spark, docs, odd):
    for df in (docs.select("doc_id", "text"), odd):
        rows = [(2**63 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in df.collect()]
        first = defaultdict(lambda: 2**64)
        for i, b in rows:
            for j in range(len(b) - 49):
                first[b[j : j + 50]] = min(first[b[j : j + 50]], i)
        want = []
        for i, b in rows:
            g = bytearray(len(b))
            for j in range(len(b) - 49):
                if first[b[j : j + 50]] < i:
                    g[j : j + 50] = b"\1" * 50
            kept = bytes(x for x, y in zip(b, g) if not y)
            want.append((i, len(b), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest()))
        for most in (64, 1):
            got = suffix.remove_repeats(df, True, chunk_bytes=1 << 16, most_texts=most).collect()
            assert sorted((2**63 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in got) == sorted(want)


def test_suffix_order():
    rng = np.random.default_rng(0)
    buf = np.frombuffer(b"".join(rng.choice([b"ab", b"ba", b"abcabc" * 12], 300).tolist()), np.uint8)
    at = np.arange(len(buf) - 50)
    order, parts = suffix.suffix_order(buf, at)
    words = [buf[i : i + 50].tobytes() for i in order]
    assert words == sorted(words)
    assert parts.tolist() == [True] + [a != b for a, b in zip(words, words[1:])]


def test_suffix_classes():
    rng = np.random.default_rng(3)
    some = [bytes(rng.choice([97, 98], n).tolist()) for n in rng.integers(50, 82, 40)]
    some += [x[:50] for x in some] + [x[:-1] + b"c" for x in some if len(x) > 50]
    texts = [some[i] for i in rng.integers(0, len(some), 500)]
    of, one = suffix._equal(texts)
    assert all(texts[one[k]] == x for k, x in zip(of, texts)) and len(one) == len(set(texts))


def test_sstable(spark, docs, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(90, "a  b   c <|endoftext|> d\n\n e, f. Übung,"), (91, " lead"), (92, "tab\t x "), (93, "a <|endoftext|> b<|endoftext|>\n \n  y \r z\n "), (94, "<|endoftext|> x\u00a0 y\u180e z \u3000 end. \n a\x1c b")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text").unionAll(extra)):
        start = 0
        got = sstable.token_table(df, path).orderBy("start").collect()
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
        for r, (known, i, text) in zip(got, rows, strict=True):
            ids = np.array(whole.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes()
            assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i if known else None, start, len(ids) // 4, ids)
            start += len(ids) // 4


def test_sstable_encoder(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole, asked = Tokenizer.from_file(path), []

    class Library:
        def __getattr__(self, name):
            asked.append(name)
            return getattr(whole, name)

    def check(e, texts):
        want = [np.array(whole.encode(x, add_special_tokens=False).ids, "<u2").tobytes() + b"end" for x in texts]
        assert list(e.encode(texts, b"end")) == want

    e = sstable.Encoder(path, held=3000)
    e.of = Library()
    check(e, [r.text or "" for r in docs.select("text").collect()])
    assert len(asked) < 100  # piece by piece it was 25,438
    some = ["a", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2028", "\u180e", "\u3000", "'s", "'S", "'ll", "'", "12", "\u00b2", "\u2167", "\xe9", "e\u0301", "\u4e2d\u6587", "\ud55c", "\u043f\u0440", "\U0001f600", "\U00020000", "\u0378", "\uffff", "<|endoftext|>", "<|", "|>", "...", "###", "_", "x" * 40, "ab" * 16, "ab" * 17, "\0", "\u200d", "\ufeff"]
    rng = np.random.default_rng(4)
    texts = [by.join(rng.choice(some, rng.integers(0, 30)).tolist()) for by in ("", " ") for _ in range(1000)]
    check(e, texts)
    e.GROUP, e.LONG = 300, 1000  # cut texts, a table that is emptied often
    check(e, [*texts, " ".join(texts[:200]), "y" * 2000, "a b" * 900, "\n" * 2000, "ab \n " * 500, "<|endoftext|> " * 90])
    every = map(chr, (*range(0xD800), *range(0xE000, 0x12000)))
    check(sstable.Encoder(path), [f"a{c}1{c}{c} {c}#{c} \n{c}" for c in every])


def test_sstable_lookup(tmp_path):
    class Sink(list):
        def write(self, b):
            self.append(b)

    sink = Sink()
    w = sstable.Writer(sink, 2)
    for i in range(0, 20_000, 2):
        w.add(sstable.key_of(i), i.to_bytes(4, "little") * 5)
    w.close()
    (tmp_path / "s").write_bytes(b"".join(sink))
    import pyarrow as pa

    r = sstable.Reader(pa.memory_map(str(tmp_path / "s")))
    assert len(r.index) > 1 and r.docs == 10_000
    assert r.get(sstable.key_of(778)) == (778).to_bytes(4, "little") * 5
    assert r.get(sstable.key_of(777)) is None and r.get(sstable.key_of(10**6)) is None
    assert sum(r.get(sstable.key_of(i)) is not None for i in range(0, 2000)) == 1000


def test_language(spark, docs, odd):
    out = queries.op5_language(spark, DATA).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    got = {r.doc_id: r for r in language.identify(odd, language.learn(docs)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[7].lang_pred != "und"
    assert language.identify(odd, {}).where("lang_pred <> 'und'").count() == 0


def test_language_by_brute_force(spark):
    """Cosines of whole texts' bundles give the same languages and scores, whatever the pieces."""
    texts = {"a": "der Hund läuft über die Straße", "b": "the dog runs over the street", "c": "собака бежит через улицу", "d": "ο σκύλος τρέχει στον δρόμο", "e": "狗跑过街道 \U00030000\U00030001"}
    learned = language.learn(spark.createDataFrame([(t, k) for k, t in texts.items()] + [(None, "a"), ("x", None)], "text string, lang string"))

    def vector(t):
        low = "".join(c.lower()[0] if c.isalpha() else " " for c in t)
        s = re.sub(" +", " ", f" {low} ")
        v = np.zeros(language.DIM)
        for i in range(len(s) - 2):
            parts = [language.letter_vectors(np.array([0 if c == " " else ord(c)]))[0].astype(float) for c in s[i : i + 3]]
            v += np.roll(parts[0], 2) * np.roll(parts[1], 1) * parts[2]
        return v

    assert all((learned[k] == vector(t)).all() for k, t in texts.items())
    asked = ["die Hunde", "a dog", "улица", "δρόμος", "街道", "\U00030000", "x", "12 3", "", "Straße, streets"] + ["the street, " * 40]
    got = [r for r in language.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), learned).orderBy("doc_id").collect()]
    for t, r in zip(asked, got):
        v = vector(t)
        cos = np.array([v @ learned[k] / np.linalg.norm(learned[k]) for k in texts])
        want = sorted(texts)[cos.argmax()] if any(c.isalpha() for c in t) else "und"
        assert r.lang_pred == want and (want == "und" or abs(r.score - cos.max() / np.maximum(cos, 0).sum()) < 1e-3)
    fold = language.folds()
    for t in asked:
        whole = np.concatenate(list(language.trigrams(t, fold)) or [np.zeros(0)])
        for piece in (1, 2, 3, 7):
            assert (np.concatenate(list(language.trigrams(t, fold, piece)) or [np.zeros(0)]) == whole).all()


def test_quality(spark, docs, odd):
    out = queries.op6_quality(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.95
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert quality_pu.quality_scores(odd, labels).count() == len(AWKWARD)
    assert {r.score for r in quality_pu.quality_scores(odd, labels.where("false")).collect()} == {0.0}


@pytest.mark.parametrize("ids", [[4], [1], [4, 5, 8], [1, 2, 3, 4, 5, 7, 8, 9, 10, 11]])
def test_quality_of_few_positives(spark, odd, ids):
    """Whichever halves the positives fall into, every row has a score from 0 to 1."""
    labels = spark.createDataFrame([(i, 1) for i in ids for _ in range(2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scores = [r.score for r in quality_pu.quality_scores(odd, labels).collect()]
    assert len(scores) == len(AWKWARD) and all(0 <= x <= 1 for x in scores)


def test_quality_risk(spark):
    """The step is the Newton step of the penalised unbiased risk, taken from numbers alone."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, quality_pu.N_FEATURES))
    x[:60, 0] += 2
    part = np.where(np.arange(200) < 30, 1, 0)
    rows = spark.createDataFrame([(r.tolist(), int(p)) for r, p in zip(x, part)], "x array<float>, part int")
    model = quality_pu.Model(np.zeros(quality_pu.N_FEATURES), np.ones(quality_pu.N_FEATURES), 0.3)
    quality_pu._fit(rows, model, 1, (1,))
    a = np.column_stack([np.clip(x.astype(np.float32).astype(float), -6, 6), np.ones(200)])
    ridge = np.append(np.full(quality_pu.N_FEATURES, 1e-3), 0)

    def risk(w):
        z = a @ w
        neg = np.logaddexp(0, z).mean() - 0.3 * np.logaddexp(0, z[part == 1]).mean()
        return 0.3 * np.logaddexp(0, -z[part == 1]).mean() + max(neg, 0) + (ridge * w * w).sum() / 2

    zero, eps = np.zeros(a.shape[1]), 1e-5
    grad = np.array([(risk(zero + eps * e) - risk(zero - eps * e)) / (2 * eps) for e in np.eye(len(zero))])
    curve = a.T @ a / 4 / 200 + np.diag(ridge + 1e-6)
    want = -np.linalg.solve(curve, grad)
    want *= min(1, 4 / np.abs(want).max())
    assert np.allclose(model.w, want, atol=1e-4) and risk(model.w) < risk(zero)


def test_decontaminate(spark):
    items = spark.createDataFrame([(1, "If Anna drives 12 km in 3 hours then how far does Anna drive in 12 hours with the same speed"), (2, "a wholly different question about nothing in particular at all here"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Intro. If Anna drives 12 km in 3 hours then how far does Anna drive in 12 hours with the same speed. End."), (2, "Intro. If Peter drives 45 km in 7 hours then how far does Peter drive in 45 hours with the same speed"), (3, "If Peter drives 45 km in 7 hours then how far does Maria drive in 99 hours with the same speed"), (4, "clean text of no interest whatever"), (5, None), (6, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()) == [(1, 1), (2, 1)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, broadcast_rows=0).collect()) == [(1, 1), (2, 1)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(docs.where("false"), items).count() == 0


def leaks(spark, item, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert all(r.n_matched <= r.n_windows for r in found)
    return sorted(r.doc_id for r in found)


def test_decontaminate_short_items(spark):
    """An item of fewer than five tokens is found within a longer text."""
    assert leaks(spark, "Solve 3x = 12", "Now please solve 3x = 12 and go on with the rest", "Solve 5x = 20", "please solve it for x in 12 steps or so") == [0, 1]


def test_decontaminate_dense_templates(spark):
    """Windows that are mostly placeholders match as templates."""
    texts = "First compute 99 + 8 * 6 - 5 and then rest for a while", "compute 12 + 7 * 3 - 4", "there are 12 and 7 and 3 or 4 of these"
    assert leaks(spark, "Compute 12 + 7 * 3 - 4", *texts) == [0, 1]
    texts = "x y z runs 45 km in 7 hours, 9 km in 2 hours, 8 km in 4 hours in total then", "runs 45 km in 7 hours, 9 km in 2 hours"
    assert leaks(spark, "runs 12 km in 3 hours, 5 km in 1 hours, 6 km in 2 hours in total", *texts) == [0]


def test_decontaminate_leading_names(spark):
    """Names that start a sentence are placeholders too, if they are exchanged consistently."""
    text = "{a} has 12 apples. {a} gives 5 apples to {b}. How many apples does {c} have now"
    texts = text.format(a="Peter", b="Maria", c="Peter"), "So " + text.format(a="Anna", b="Tom", c="Anna"), text.format(a="Peter", b="Maria", c="Ruth"), "Peter has gone. How many apples are left now"
    assert leaks(spark, text.format(a="Anna", b="Tom", c="Anna"), *texts) == [0, 1]


def test_decontaminate_finds_whole_passages(spark):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for i, t in bench.items() if t in r.text}
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, DATA).collect()}
    assert want <= got


def test_mixing(spark, docs, odd):
    out = mixing.mix(docs).toPandas()
    by = out.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (out.taken <= 3 * out["size"]).all() and abs(by.target.sum() - by["size"].sum()) < 1e-6
    assert ((by.taken - by.target).abs() <= 4 * 32).all() and (by.target <= 3 * by["size"] + 1e-9).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(map(tuple, out.astype(str).to_numpy())) == sorted(map(tuple, again.astype(str).to_numpy()))
    sources = odd.withColumn("source", F.when(F.col("doc_id") < 5, "a").when(F.col("doc_id") < 8, "b"))
    assert mixing.mix(sources).count() == len(AWKWARD) and mixing.mix(odd.where("false")).count() == 0


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 90), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights 5, 2, 1 and 5: a and c are full at 30 and 0, the rest is shared 2 to 5, but null is full at 270
    assert got == {"a": 30.0, "b": 800.0, "c": 0.0, None: 270.0}


def test_licenses(spark, odd):
    docs = spark.createDataFrame([(1, "x y z " * 50 + "Licensed under the Apache License, Version 2.0. " + "q r " * 40), (2, "nothing"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.license_id, r.containment) for r in licenses.scan(docs).collect()] == [(1, "Apache-2.0", 1.0)]
    assert licenses.scan(odd).count() == 0


def test_licenses_recall_of_every_template(spark):
    """Each notice, whole or with a fifth of its shingles lost, is retrieved at any place of a text; what
    is found is what exact containment finds in all windows."""
    rng = np.random.default_rng(6)
    texts, want = [], set()
    tokens = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    own = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    for k, t in licenses.TEMPLATES.items():
        words = tokens(t)
        for i in range(40):
            kept = words if i % 2 or len(words) < 15 else [*words[: len(words) // 5 - 2], *words[len(words) // 5 :]] if len(words) > 20 else words
            fill = [f"w{x}" for x in rng.integers(0, 10**6, 140)]
            at = int(rng.integers(0, 140))
            texts.append(fill[:at] + kept + fill[at:])
    for d, t in enumerate(texts):
        for k, x in licenses.TEMPLATES.items():
            n = min(5, len(tokens(x)))
            a, b = own(tokens(x), n), own(t, n)
            if len(a & b) / len(a) >= 0.8:
                want.add((d, k))
    got = licenses.scan(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {(r.doc_id, r.license_id) for r in got.collect()}
    assert got <= want and len(got) >= 0.995 * len(want)
    lost = {k: sum(x == k for _, x in want - got) for k in licenses.TEMPLATES}
    assert all(n <= 0.05 * 40 for n in lost.values())


def test_licenses_of_one_shingle(spark):
    """An exact MIT line within a text is found wherever it stands."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    docs = spark.createDataFrame([(i, f"{words(20 + i % 16)} Released under the MIT License {words(60)}") for i in range(400)], "doc_id long, text string")
    assert {r.doc_id for r in licenses.scan(docs).collect() if r.license_id == "MIT"} == set(range(400))


def test_licenses_of_few_words(spark):
    """A template of fewer than five words is found within, at the end of, and as a text."""
    texts = ["Some words before it.\nAll rights reserved.\nAnd words after it " * 2, "All rights, reserved", "x All rights reserved", "nothing of the sort is said here by anyone", "rights reserved all over the place, reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.license_id) for r in licenses.scan(docs).collect()} == {(i, "All-rights-short") for i in range(3)}
    got = licenses.scan(docs, {"a": "nothing", "b": "x all", "c": "Over the place."}).collect()
    assert sorted((r.doc_id, r.license_id, r.n_windows, r.containment) for r in got) == [(2, "b", 1, 1.0), (3, "a", 1, 1.0), (4, "c", 1, 1.0)]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:160] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    hit = 0
    for q in range(0, 600, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, s[mine.vec_id])
        hit += len(set(best) & set(mine.vec_id))
    assert hit >= 0.9 * 600
    few = ann.nearest(spark.createDataFrame(rows[:3] + rows[-2:], "vec_id long, embedding array<float>"))
    assert few.count() == 2


def test_nearest_of_repeated_ids_and_lengths(spark, monkeypatch):
    """Rows of one vec_id are each a query and a candidate; lengths are searched apart; shares of queries."""
    monkeypatch.setattr(ann, "ASKED", 3)
    rng = np.random.default_rng(9)
    rows = [(i % 40, rng.standard_normal(6).tolist()) for i in range(80)] + [(i, rng.standard_normal(4).tolist()) for i in range(5)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, recall=1.0).collect()
    want = []
    for n, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-float(np.dot(v, w)), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v))[:3]
            want += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_nearest_in_small_lists(spark):
    """Queries in lists of few vectors have k rows as well, however few lists are probed."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 8)) * np.exp(2 * rng.standard_normal((3000, 1)))
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id % 5 = 0", recall=0.0).groupBy("query_id").count().collect()
    assert len(got) == 600 and {r["count"] for r in got} == {20}


def lines_by_hand(rows, min_words):
    """Every run of lines with an earlier copy, one by one; rows in order of their id."""
    texts = [(i, None if t is None else t.split("\n")) for i, t in rows]
    seen, out = set(), []
    for i, lines in texts:
        gone = set()
        for a in range(len(lines or ())):
            for b in range(len(lines), a, -1):
                if tuple(lines[a:b]) in seen and len(re.findall(r"[^\x20\x09-\x0D]+", " ".join(lines[a:b]))) >= min_words:
                    gone.update(range(a, b))
                    break
            seen.update(tuple(lines[a:b]) for b in range(a + 1, len(lines) + 1))
        out.append((i, len(lines or ()), len(gone), sum(p - 1 not in gone for p in gone), None if lines is None else "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return out


def test_lines(spark, odd):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, "a\nb\nc\nd"), (5, None), (6, ""), (7, "q\nq\nq\nq\nq"), (8, "a b c\n\n d e f")]
    for words in (1, 3):
        got = [tuple(r) for r in lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), words).orderBy("doc_id").collect()]
        assert got == lines_by_hand(rows, words)
    assert got[1][3:] == (1, "x\ny") and got[2][4] == "a\nb" and got[6][4] == "q" and got[5][1] == 1
    assert lines.remove_repeated_lines(odd).count() == len(AWKWARD)


def test_lines_by_brute_force(spark):
    """Runs of every length, some within themselves, some that only several sources make up."""
    rng = np.random.default_rng(8)
    passage = [["one two", "", "three", "four five six", "x"], ["seven"] * 7, ["a b", "c", "", "", "d e f g"], [f"line {i}" for i in range(21)]]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.integers(0, 4)):
            p = passage[rng.integers(4)]
            a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist())
            text += p[a:b] + ["own %d" % rng.integers(6)] * int(rng.integers(0, 2))
        rows.append((i, "\n".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (5, 8):
        got = [tuple(r) for r in lines.remove_repeated_lines(docs, words).orderBy("doc_id").collect()]
        assert got == lines_by_hand(rows, words)


def test_lines_of_documents_by_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got = [tuple(r) for r in lines.remove_repeated_lines(docs).orderBy("doc_id").collect()]
    assert got == lines_by_hand(rows, lines.MIN_WORDS)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


NAMES = "row nth seg size source_size target taken fp component_id first_id root bad_id mixed_id times copy doc h i j t at n low part x score lang_pred point rank pos line chunk bucket kept shard ids start item_id quality vec_id centroid list block".split()


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("*", *(F.lit(1).alias(n) for n in NAMES if n not in odd.columns))


TABLE_OPS = {
    "decontaminate": lambda s, d: decontaminate.contaminated(d, s.read.parquet(f"{DATA}/benchmark.parquet")),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "suffix": lambda s, d: suffix.remove_repeats(d, True),
    "sstable": lambda s, d: sstable.token_table(d, queries.tokenizer_path()),
    "language": lambda s, d: language.identify(d, language.learn(d)),
    "quality": lambda s, d: quality_pu.quality_scores(d, s.read.parquet(f"{DATA}/labels.parquet")),
    "mixing": lambda s, d: mixing.mix(d),
    "licenses": lambda s, d: licenses.scan(d),
    "lines": lambda s, d: lines.remove_repeated_lines(d),
}


@pytest.mark.parametrize("name", TABLE_OPS)
def test_clashing_and_empty(spark, odd, clashing, name):
    """Columns of other names change nothing, an empty table gives no row."""
    op = TABLE_OPS[name]
    plain, extra = (sorted(map(str, op(spark, d).collect())) for d in (odd, clashing))
    assert plain == extra
    assert op(spark, clashing.where("false")).count() == 0


def test_nearest_clashing_and_empty(spark):
    x = spark.read.parquet(f"{DATA}/embeddings.parquet")
    wide = x.select("*", *(F.lit(1).alias(n) for n in NAMES if n not in x.columns))
    assert sorted(map(str, ann.nearest(x).collect())) == sorted(map(str, ann.nearest(wide).collect()))
    assert ann.nearest(wide.where("false")).count() == 0


def test_pipeline_stages_on_awkward_rows(spark, clashing):
    import corpus_pipeline

    for docs in (clashing, clashing.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, DATA)
            assert name == corpus_pipeline.STAGES[-1][0] or got.columns == docs.columns
            rows = got.collect()
            assert bool(rows) or docs is not clashing or name == corpus_pipeline.STAGES[0][0]


def test_decontaminate_roles_of_numbers(spark):
    """One number in two roles, two numbers that become one, many slots in a window, a stray hit."""
    two = "Sam buys {} apples at the market and later finds {} more in the old basket of his aunt"
    assert leaks(spark, two.format(2, 2), two.format(7, 9), "Sam buys no apples at the market") == [0]
    goats = "There are {} goats and {} sheep on the farm and all of them want to eat grass today"
    assert leaks(spark, goats.format(3, 5), goats.format(4, 4)) == [0]
    sums = "Compute the value of {} + {} - {} + {} = {} and write down what is left of it in words"
    assert leaks(spark, sums.format(3, 4, 5, 6, 8), sums.format(1, 1, 9, 7, 2)) == [0]
    names = "Before noon {a} walks to the shop with {b} and then {a} pays for bread while {b} waits outside of the shop door in the rain"
    copy = names.format(a="Peter", b="Maria")
    assert leaks(spark, names.format(a="Anna", b="Tom"), copy, copy + ". Then Ruth walks to the shop with Karl", copy.replace("then Peter", "then Ruth").replace("while Maria", "while Karl")) == [0, 1]


def templates_by_hand(docs, items, cover=0.8):
    """The rule of the operator over whole texts, one document and item at a time."""
    import regex

    number, word = r"[0-9]+(?:[.,:/][0-9]+)*", r"[\p{L}\p{M}]+"

    def tokens(text):
        text, out, before = text.replace("#", " "), [], ""
        for m in regex.finditer(rf"{word}|{number}", text):
            t, a = m[0], m.start()
            kind = "number" if t[0].isdigit() else "unit" if out and out[-1][1] == "number" and regex.fullmatch(r"[\s]*", text[before:a]) and t.lower() in decontaminate.UNITS and " " * (a - before) == text[before:a] and a > before else "word"
            if kind == "word" and regex.match(r"\p{Lu}\p{Ll}", t):
                kind = "name" if a > 1 and text[a - 1] == " " and regex.match(r"[\p{L}\p{N},;]", text[a - 2]) else "lead"
            out.append((t.lower(), kind))
            before = m.end()
        return out

    def canon(toks, form):
        return ["#" + k.replace("lead", "name") if k in ("number", "unit") or k == "name" and form in ("names", "wide") or k == "lead" and form == "wide" else t for t, k in toks]

    def windows(toks, form):
        c, out = canon(toks, form), []
        words = [k for k, x in enumerate(c) if x[0] != "#"]
        for j in range(max(len(c) - 4, 1)) if words else ():
            rest = [k for k in words if k >= j]
            a, b = (j, max(min(j + 5, len(c)), rest[1] + 1)) if len(rest) > 1 else (min(j, words[-2] if len(words) > 1 else 0), len(c))
            out.append((j, a, tuple(c[a:b])))
        return out

    found = {}
    for item, asked in items.items():
        it = tokens(asked)
        for doc, text in docs.items():
            dt, matched = tokens(text), {True: set(), False: set()}
            if not it or not dt:
                continue
            aligned = defaultdict(set)
            for form in ("plain", "names", "wide"):
                c = canon(dt, form)
                for j, a, w in windows(it, form):
                    for i in range(len(c) - len(w) + 1):
                        if tuple(c[i : i + len(w)]) == w:
                            at = tuple(k for k, x in enumerate(w) if x == "#name")
                            if not at:
                                matched[True].add(j)
                                matched[False].add(j)
                            for every in (True,) if form == "wide" else (True, False):
                                aligned[i - a, every].add((j, a, i, at))
            for (_, every), hits in aligned.items():
                votes = defaultdict(lambda: defaultdict(set))
                for j, a, i, at in hits:
                    for k in at:
                        votes[it[a + k][0]][dt[i + k][0]].add(a + k)
                stands = {n: min(v, key=lambda x: (-len(v[x]), x)) for n, v in votes.items()}
                agree = sum(len(v[stands[n]]) for n, v in votes.items()) >= 0.8 * sum(len(set().union(*v.values())) for v in votes.values()) - 1e-9
                matched[every] |= {j for j, a, i, at in hits if at and agree and all(stands[it[a + k][0]] == dt[i + k][0] for k in at)}
            n = max(len(it) - 4, 1)
            if max(map(len, matched.values())) / n >= cover:
                found[doc, item] = (n, max(map(len, matched.values())))
    return found


def test_decontaminate_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vocabulary = "Anna Peter Tom walks runs to with 12 7 3.5 km hours and the shop 40 Maria, buys apples; then. Has how many? 2 percent of ÉlanVital now".split()
    items = {i: " ".join(rng.choice(vocabulary, rng.integers(1, 16))) for i in range(40)}
    swap = {"Anna": "Ruth", "Peter": "Karl", "12": "99", "7": "7", "km": "miles", "Tom": "Anna"}
    docs = {}
    for d in range(120):
        item = items[int(rng.integers(40))].split()
        kept = [swap.get(w, w) if d % 3 == 0 else rng.choice(vocabulary) if d % 3 == 1 and rng.random() < 0.06 else w for w in item]
        docs[d] = " ".join([*rng.choice(vocabulary, rng.integers(0, 9)), *kept, *rng.choice(vocabulary, rng.integers(0, 9))])
    args = (spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    want = templates_by_hand(docs, {i: t for i, t in items.items() if any(k[0] not in "0123456789" for k in re.findall(r"\w+", t))})
    assert len(want) > 80
    rows = lambda out: {(r.doc_id, r.item_id): (r.n_windows, r.n_matched) for r in out.collect()}
    got = rows(decontaminate.contaminated(*args))
    assert got == want
    monkeypatch.setattr(decontaminate, "_pieces", lambda r, k, real=decontaminate._pieces: real(r, k, 40, 400))
    assert set(rows(decontaminate.contaminated(*args, broadcast_rows=0))) >= set(want)  # a cut passage counts by its parts too


def test_decontaminate_forms_of_few_documents(spark, monkeypatch):
    """Forms and windows are only made of documents that hold words of an item in a row."""
    seen, real = set(), decontaminate._all_windows

    def watched(docs, *args):
        seen.update(r.doc_id for r in docs.select("doc_id").collect())
        return real(docs, *args)

    monkeypatch.setattr(decontaminate, "_all_windows", watched)
    item = "Before noon {a} walks {n} miles to the shop and {a} buys {m} apples. Then {a} walks home in the rain"
    mixed = "Home, Anna buys rain. Tom to the 12 Miles of shop; Apples walks and Then before Noon in {n} hours"
    texts = "So: " + item.format(a="Peter", n=7, m=9), mixed.format(n=3), "clean text of Anna", mixed.format(n=4) * 50, "", None
    assert leaks(spark, item.format(a="Anna", n=12, m=3), *texts) == [0]
    assert seen == {0}


def test_decontaminate_runs_of_words(spark):
    """What is looked for first: numbers alone, a single word, words on both sides of numbers, capitals
    that change the letter before them."""
    assert leaks(spark, "3 5 7.5 9 11", "count 3 and 5", "count 3, 5, 7.5, 9, 11 and on", "3 5 7.5 9 12") == [1]
    assert leaks(spark, "12 + 7 is 3 - 4", "so 99 + 8 is 6 - 5", "so 99 and 8 is 6", "is it") == [0]
    assert leaks(spark, "Tom has 12 apples", "now Ruth has 7 apples", "Ruth has apples", "apples has 7") == [0]
    assert leaks(spark, "\u039b\u039f\u0393\u039f\u03a3'Ena \u039b\u039f\u0393\u039f\u03a3'Ena", "duo \u039b\u039f\u0393\u039f\u03a3'Ena \u039b\u039f\u0393\u039f\u03a3'Ena tria", "duo tria") == [0]
