import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from issq.llm import hmm, registry
from issq.llm import op01_decontamination as op1
from issq.llm import op02_jaccard_join as op2
from issq.llm import op03_exact_dedup as op3
from issq.llm import op04_token_counts as op4
from issq.llm import op05_toxicity as op5
from issq.llm import op06_url_filter as op6
from issq.llm import op07_secret_scan as op7
from issq.llm import op08_lm_scoring as op8
from issq.llm import op09_quality as op9
from issq.llm import op10_packing as op10

from . import helpers as H


def table(spark, rows, schema=H.DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)


def clashing(df, *names):
    """Extra columns that have the names of results."""
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def texts_of(spark, sf, n=200):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# --- 1 decontamination ------------------------------------------------------

def test_leaks_equal_brute_force(spark, sf):
    docs = texts_of(spark, sf) + H.HARD
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "x"), (903, "tie tie tie tie tie")]
    rnd = random.Random(1)
    for k in range(20):  # copies of an item with a few words changed
        w = items[k][1].split()
        for _ in range(k % 4):
            w[rnd.randrange(len(w))] = "changed"
        docs.append((10_000 + k, "before it " * k + " ".join(w) + " and after it"))
    docs = [(i, t) for i, (_, t) in enumerate(docs) if t is None or len(t) < 40_000]
    got = op1.leaks(table(spark, docs), table(spark, items, "item_id long, text string")).collect()
    want = H.leaks(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    by_id, item = dict(docs), dict(items)
    for r in got:
        if r.similarity == 1:
            assert H.words(by_id[r.doc_id][r.start : r.stop]) == H.words(item[r.item_id])
    kept = {r.doc_id for r in op1.without_leaks(clashing(table(spark, docs), "item_id"), table(spark, items, "item_id long, text string")).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_of_repeated_shingles(spark):
    docs, items = [], []
    for k, (size, common, times) in enumerate([(70, 62, 8), (80, 72, 10), (90, 82, 10), (60, 54, 7)] * 3):
        w = [f"w{k}x{j}" for j in range(size + 4)]
        copy = w[: common + 4] + ["x"] * (times + 4)  # one shingle many times
        items += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(copy))]
        docs += [(2 * k, f"before it {k} " + " ".join(copy) + " and after"), (2 * k + 1, "before it " + " ".join(w) + f" {k} and after")]
    got = op1.leaks(table(spark, docs), table(spark, items, "item_id long, text string")).collect()
    want = H.leaks(docs, items)
    assert len(want) > len(docs)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def edited(rnd, words_, share, repeats):
    """A passage in which a run, single words or (repeats) runs of one word
    take the place of some."""
    w = list(words_)
    n = max(1, int(len(w) * share * rnd.random()))
    if rnd.random() < 0.5:
        at = rnd.randrange(len(w) - n + 1)
        w[at : at + n] = [f"n{rnd.random()}"] * (n + rnd.randrange(3)) if repeats else [f"n{rnd.random()}" for _ in range(n)]
    else:
        for _ in range(max(1, n // 5)):
            w[rnd.randrange(len(w))] = w[0] if repeats else f"n{rnd.random()}"
    return w


def leak_recall(n, repeats, seed=11):
    """(pairs with exact similarity >= 0.75, those found, unrelated windows that
    pass the block index) of random items and edited copies."""
    rnd, want, got, passed = random.Random(seed), 0, 0, []
    others = op1.Items(list(range(40)), [" ".join(f"o{k}x{j}" for j in range(60)) for k in range(40)])
    for k in range(n):
        size = rnd.choice([1, 3, 5, 6, 8, 9, 11, 12, 16, 20, 30, 45, 64, 100, 108, 200])
        few = rnd.choice([6, 20]) if repeats and rnd.random() < 0.5 else 0
        item = [f"v{rnd.randrange(few)}" for _ in range(size)] if few else [f"i{k}x{j}" for j in range(size)]
        text = ["a"] * rnd.randrange(3) + edited(rnd, item, 0.18, repeats) + ["b"] * rnd.randrange(3)
        index = op1.Items([k], [" ".join(item)])
        sh = np.array([x for x in _shingle_hashes(" ".join(text))], dtype=np.uint64)
        exact = H.leaks([(0, " ".join(text))], [(k, " ".join(item))])
        want += len(exact)
        found = index.leaks(sh)
        got += len(found)
        assert {round(s, 9) for _, s, *_ in found} <= {round(v, 9) for v in exact.values()}
        if len(sh) >= 56:
            blocks = op1.in_blocks(op1.window_sums(sh, 56)[:1] > 0)
            passed += [bool(others.near(blocks, i)[0]) for i in range(40)]
    return want, got, float(np.mean(passed))


def _shingle_hashes(text):
    from issq.llm import textkernel as tk

    _, _, _, at, words = tk.words_of(pa.array([text]))
    return tk.shingles(words, at)[0]


@pytest.mark.parametrize("repeats", [False, True])
def test_leaks_are_not_lost_and_the_index_prunes(repeats):
    want, got, passed = leak_recall(600, repeats)
    assert want > 120 and got == want
    assert passed < 0.05


def test_runs_of_one_word_in_long_items():
    """A window of an item's first words and then one word repeated."""
    for first in range(86, 93):
        for run in (5, 9, 13, 17):
            item = [f"w{j}" for j in range(104)]
            text = item[:first] + ["x"] * run
            exact = H.leaks([(0, " ".join(text))], [(1, " ".join(item))])
            found = op1.Items([1], [" ".join(item)]).leaks(_shingle_hashes(" ".join(text)))
            assert [round(s, 9) for _, s, *_ in found] == [round(v, 9) for v in exact.values()]


def test_leaks_of_items_in_several_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = op1.leaks(docs, items).collect()
    kept = sorted(r.doc_id for r in op1.without_leaks(docs, items).select("doc_id").collect())
    monkeypatch.setattr(op1, "ITEM_BYTES", 3000)
    assert len(op1.item_blocks(items, "item_id", "text")) > 2
    assert sorted(op1.leaks(docs, items).collect()) == sorted(whole) and whole
    assert sorted(r.doc_id for r in op1.without_leaks(docs, items).select("doc_id").collect()) == kept


def test_window_sums_equal_sums_of_each_window():
    rng = np.random.default_rng(4)
    for n, width in ((1, 1), (30, 1), (30, 7), (30, 30), (200, 50)):
        sh = rng.integers(0, 9, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        got = op1.window_sums(sh, width)
        assert got.shape == (n - width + 1, op1.BITS)
        for s in range(len(got)):
            rank = np.array([(sh[s:p] == sh[p]).sum() for p in range(s, s + width)])
            assert (got[s] == op1.bit_signs(op1.ranked(sh[s : s + width], rank)).sum(axis=0)).all()


def test_leaks_of_empty_tables(spark):
    items = table(spark, [(1, "one two three four five six")], "item_id long, text string")
    assert op1.leaks(table(spark, []), items).count() == 0
    assert op1.leaks(table(spark, H.HARD), table(spark, [], "item_id long, text string")).count() == 0


# --- 2 near duplicates ------------------------------------------------------

def families(seed, n=12):
    """Texts with copies at all distances around the threshold."""
    rnd, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [rnd.choice(vocabulary) for _ in range(40)]
    for f in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 5, 7, 9, 12, 30, 33, 64, 120, 300]))]
        if f % 3 == 0:
            base = shared + base
        for c in range(rnd.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[at] = rnd.choice(vocabulary)
                else:
                    del w[at]
                    w = w or ["w"]
            rows.append((len(rows), " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(op2, "SAMPLE_TEXTS", 10**6 if seed == 1 else 1)  # with and without common features left out
    rows = families(seed)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op2.near_duplicates(table(spark, rows)).collect())
    assert got == sorted(H.components(rows))


def test_components_of_hard_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op2.near_duplicates(clashing(table(spark, H.HARD), "n_shingles", "component_id", "node")).collect()), key=str)
    assert got == sorted(H.components(H.HARD), key=str)
    assert op2.near_duplicates(table(spark, [])).count() == 0
    kept = [r.doc_id for r in op2.one_per_group(table(spark, H.HARD)).collect()]
    assert sorted(d or 0 for d in kept) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_similar_sets_always_share_a_signature():
    rnd = np.random.default_rng(4)
    for size in [1, 3, 4, 7, 30, 33, 60, 64, 65, 100, 129, 400]:
        for _ in range(15):
            a = np.unique(rnd.integers(0, 2**64, size, dtype=np.uint64))
            both = a[rnd.permutation(len(a))[: rnd.integers(max(1, int(0.7 * len(a))), len(a) + 1)]]
            b = np.unique(np.concatenate([both, rnd.integers(0, 2**64, rnd.integers(0, max(2, len(a) // 3)), dtype=np.uint64)]))
            common, union = op2.jaccard_parts(a, b)
            if 4 * common < 3 * union:
                continue
            hot = np.sort(a[rnd.random(len(a)) < rnd.choice([0, 0.3, 0.7, 1.0])])
            off = np.array([0, len(a), len(a) + len(b)])
            sig, owner = op2.signatures(np.concatenate([a, b]), off, hot)
            plain, met = sig & ~op2.MET, (sig & op2.MET) > 0
            one = {s: m for s, m, o in zip(plain.tolist(), met.tolist(), owner.tolist()) if o == 0}
            two = {s: m for s, m, o in zip(plain.tolist(), met.tolist(), owner.tolist()) if o == 1}
            assert any(not (one[s] and two[s]) for s in one.keys() & two.keys())
            x, y = op2.histogram(a, len(a)), op2.histogram(b, len(b))
            assert op2.least_distance(x, y, len(a), len(b)) <= 1 - common / union + 1e-12


# --- 3 exact dedup ----------------------------------------------------------

def test_exact_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = H.HARD + [(100 + k, rnd.choice(["a b", "ab", " a  b", "c", "", None, "hot"])) for k in range(300)]
    df = clashing(table(spark, rows, parts=5), "kept", "keep_id")
    got = op3.exact_dedup(df, carry=["doc_id", "text", "kept"])
    assert got.columns == ["doc_id", "text", "kept", "keep_id", "group_size", "kept_", "text_sha256"]
    got = got.collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append((-len(t or ""), d is None, d))
    assert len(got) == len(rows)
    for r in got:
        g = sorted(groups[norm(r.text)], key=lambda x: (x[0], x[1], x[2] or 0))
        assert (r.keep_id, r.group_size, r.text_sha256) == (g[0][2], len(g), hashlib.sha256(norm(r.text).encode()).hexdigest())
    assert sum(r.kept_ for r in got) == len(groups)
    assert op3.exact_dedup(table(spark, [])).count() == 0


def test_exact_dedup_query(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duck.sql(registry.oracle_sql()["op3_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    got = registry.queries()["op3_exact_dedup"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[sorted(got)] == want[sorted(want)]).all().all()


# --- 4 and 10 tokens --------------------------------------------------------

def test_token_counts_and_prefix_tables(spark, sf):
    rows = H.HARD + texts_of(spark, sf)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    model = Tokenizer.from_file(H.TOKENIZER)
    encode = lambda t: model.encode(t, add_special_tokens=False).ids
    got = op4.token_counts(clashing(table(spark, rows), "n_tokens"), H.TOKENIZER)
    budget = F.lit(9)
    got = got.withColumn("cut", op4.cut_at(budget, F.col("prefix_bytes"), F.col("prefix_tokens")))
    got = got.withColumn("at", op4.tokens_at(F.col("cut"), F.col("prefix_bytes"), F.col("prefix_tokens")))
    for r in got.collect():
        text = dict(rows)[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(encode(text)))
        head = text.encode()[: r.cut].decode()
        assert len(encode(head)) == r["at"] <= 9
    assert op4.token_counts(table(spark, []), H.TOKENIZER).count() == 0
    named = table(spark, [(1, "two words")]).withColumnRenamed("doc_id", "N_tokens")
    assert op4.token_counts(named, H.TOKENIZER, id_col="N_tokens").first().asDict() == {"N_tokens": 1, "n_bytes": 9, "n_tokens_": 2, "prefix_bytes": [3, 9], "prefix_tokens": [1, 2]}


def test_token_counts_at_every_byte(spark, sf):
    """Each entry against the library on that prefix; cuts against all of them."""
    model = Tokenizer.from_file(H.TOKENIZER)
    texts = [t if t is None else t[:700] for _, t in H.HARD] + [(t or "")[:300] for _, t in texts_of(spark, sf)[:12]]
    texts += ["e\u0301te\u0301 A\u030angstrom", "don't U.S.A... <|endoftext|>x <|ENDoftext|>", "x" * 400, " lead and trail \n", "\U0001f469\u200d\U0001f680 \u6f22\u5b57"]
    got = op4.token_counts(table(spark, list(enumerate(texts))), H.TOKENIZER, every_byte=True).withColumn("cut", op4.longest_within(F.lit(7), F.col("tokens_upto")))
    got = got.withColumn("whole", op4.tokens_upto(F.lit(1 << 20), F.col("tokens_upto"))).withColumn("five", op4.tokens_upto(F.lit(5), F.col("tokens_upto")))
    for r in got.collect():
        raw, want = (texts[r.doc_id] or "").encode(), []
        for p in range(1, len(raw) + 1):
            try:
                want.append(len(model.encode(raw[:p].decode(), add_special_tokens=False).ids))
            except UnicodeDecodeError:
                want.append(None)
        assert r.tokens_upto == want
        assert r.whole == r.n_tokens
        assert r.five == next((v for v in reversed(want[:5]) if v is not None), 0)
        assert r.cut == max((p for p, v in enumerate(want, 1) if v is not None and v <= 7), default=0)


def test_packing_round_trip(spark, sf):
    rows = [(i, t) for i, (_, t) in enumerate(H.HARD + texts_of(spark, sf))]
    model = Tokenizer.from_file(H.TOKENIZER)
    want = {d: np.array(model.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for d, t in rows}
    pieces = op10.pack(clashing(table(spark, rows), "start", "length"), H.TOKENIZER).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start : p.start + p.length].tobytes())
    assert set(by_doc) == set(want)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(want[d])
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * sum(map(len, want.values()))
    assert op10.pack(table(spark, []), H.TOKENIZER).count() == 0


def test_classes_cut_exactly():
    c = op10.Classes()
    for n in range(1, 9000):
        got = c.cut(n)
        assert sum(x for x, _ in got) == n
        assert all(x <= s and s in c.count for x, s in got)


# --- 5 and 9 classifiers ----------------------------------------------------

@pytest.mark.parametrize("name,label,modulus,rest", [("op5_toxicity", "toxic", 5, 0), ("op9_quality", "quality", 3, 1)])
def test_held_out_accuracy(spark, name, label, modulus, rest):
    sf = "/root/testdata/sf0.1"
    got = registry.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % modulus == rest for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out]
    assert (held.predicted == held[label]).mean() >= 0.98


def test_classifiers_on_hard_rows(spark):
    df = clashing(table(spark, H.HARD), "score", "held_out")
    none = table(spark, [], "doc_id long, quality int, toxic int")
    for out in (op5.toxicity(df, op5.fit(df, none)), op9.quality(df, op9.fit(df, none))):
        rows = out.collect()
        assert len(rows) == len(H.HARD)
        assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
    assert op5.without_toxic(df, op5.fit(df, none)).count() == len(H.HARD)
    some = table(spark, [(k, k % 2, k % 2) for k in range(10)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert op9.quality(df, op9.fit(df, some)).count() == op5.toxicity(df, op5.fit(df, some)).count() == len(H.HARD)
    empty = table(spark, [])
    assert op9.quality(empty, op9.fit(empty, none)).count() == op5.toxicity(empty, op5.fit(empty, none)).count() == 0


def test_toxicity_is_trained_on_posteriors_only(monkeypatch):
    """What the classifier is fitted to is the label model's posterior, and no
    voter is the given label."""
    rnd = random.Random(5)
    words_ = [f"word{k}" for k in range(200)]
    y = [int(rnd.random() < 0.3) for _ in range(400)]
    texts = [" ".join(rnd.choices(words_, k=40) + (rnd.choices(["idiot", "badword", "worseword", "nastyword"], k=8) if t else [])) for t in y]
    seen = {}
    model_, fit_ = op5.label_model, op5.fit_sparse
    monkeypatch.setattr(op5, "label_model", lambda votes, prior: seen.update(votes=votes, out=model_(votes, prior)) or seen["out"])
    monkeypatch.setattr(op5, "fit_sparse", lambda d, c, v, n, target, start: seen.update(target=target) or fit_(d, c, v, n, target, start))
    flipped = list(y)
    wrong = [k for k in range(400) if y[k]][:2]
    for k in wrong:
        flipped[k] = 0  # labels that the texts contradict
    model = op5.train(pa.table({"text": texts, "y": flipped}))
    assert (seen["target"] == seen["out"][0]).all()
    assert not any((seen["votes"][:, k] == flipped).all() for k in range(seen["votes"].shape[1]))
    assert (seen["target"][wrong] > 0.5).all()
    assert ((model.score(pa.array(texts)) >= 0.5) == (np.array(y) == 1)).mean() > 0.95


def test_long_and_null_texts_are_fitted_too(spark):
    docs = table(spark, [(1, "a " * 30_000), (2, None), (2, "b"), (3, "c"), (4, "d")])
    labels = table(spark, [(k, 1, 1) for k in range(1, 5)], "doc_id long, quality int, toxic int")
    from issq.llm.labelled import labelled_sample

    got = labelled_sample(docs, labels, "toxic", 10**6, 10**6 - 1)
    assert sorted((r["doc_id"], len(r["text"])) for r in got.to_pylist()) == [(1, 60_000), (2, 0), (2, 1), (3, 1), (4, 1)]
    few = labelled_sample(docs, labels, "toxic", 10**6, 10**6 - 1, max_bytes=2)
    assert [(r["doc_id"], r["text"]) for r in few.to_pylist()] == [(r["doc_id"], r["text"]) for r in got.to_pylist()][: few.num_rows]
    assert labelled_sample(docs, labels, "toxic", 10**6, 10**6 - 1, max_rows=3).num_rows == 3


def test_label_model_finds_better_voters():
    rnd = np.random.default_rng(0)
    y = rnd.random(4000) < 0.3
    vote = lambda right: np.where(rnd.random(4000) < right, y, ~y).astype(int)
    noisy = vote(0.6)
    votes = np.stack([vote(0.9), vote(0.85), vote(0.8), noisy, noisy], axis=1)
    q, accuracy, discount = op5.label_model(votes, 0.3)
    assert ((q > 0.5) == y).mean() > 0.93
    assert discount[3] < discount[0] and accuracy[0, 1, 2] > accuracy[3, 1, 2]


def test_forward_backward_against_enumeration():
    rnd = np.random.default_rng(1)
    node, move = rnd.normal(size=5), rnd.normal(size=(2, 2))
    weights = {}
    for code in range(32):
        s = [(code >> k) & 1 for k in range(5)]
        weights[tuple(s)] = math.exp(sum(node[k] * s[k] for k in range(5)) + sum(move[s[k], s[k + 1]] for k in range(4)))
    z = sum(weights.values())
    got, _, log_z = op9.forward_backward(node, np.array([0, 5]), move)
    assert got == pytest.approx([sum(w for s, w in weights.items() if s[k]) / z for k in range(5)])
    assert log_z == pytest.approx(math.log(z))


# --- 6 urls -----------------------------------------------------------------

URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/7x?q=/de/"), (5, "https://com/en/"), (6, "https://www.casino.org/a"), (7, "ftp://x.net/de/8"), (8, "http://x.example.net/de/81#f"),
    (9, "http://notexample.com/en/7"), (10, "http://a.org"), (11, "http://a.org?x=://b.com/en/"), (12, "http://B.ORG/es/"), (13, "https://com.evil/en/1"), (None, "http://x.com/EN/"), (14, "http://é.com/en/7"), (14, "http://é.com/en/7"),
    (15, "http://a.fr/x/ads/1"), (16, "http://a.fr/ads"), (17, "http://a.fr/img/banner_300x250.png"), (18, "http://a.fr/banner300x250"), (19, "http://payday-loans"),
    (20, "http://payday-loanshark.fr/"), (21, "http://my-online-pharmacy.biz"), (22, "http://paypal-safe.fr/x"), (23, "http://paypal.fr/paypal-x"), (24, "http://a.fr/blog/wp-login.php?x"),
    (25, "http://a.fr/awp-login.php"), (26, "http://a.fr/setup.exe#x"), (27, "http://a.fr/setup.exe\n"), (28, "http://192.168.0.1:80/x"), (29, "http://192.168.0.1.fr/"),
    (30, "http://a-b-c-d-e.fr"), (31, "http://a-b-c-d.fr/a-b-c-d-e"), (32, "http://a.fr/x\n/ads/"), (33, "http://www.example.com/en/7/ads/"), (34, "http://AdServer.net/de/1"),
]


def test_urls_against_duckdb(spark):
    duck = duckdb.connect()
    duck.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?)", URLS)
    want = sorted(map(str, duck.sql(f"SELECT page_id, host, path, rule, verdict FROM ({registry.oracle_sql()['op6_url_filter']})").fetchall()))
    df = table(spark, URLS, "page_id long, url string")
    assert sorted(str(tuple(r)) for r in op6.url_filter(df).drop("url").collect()) == want
    many = op6.default_rules() + [op6.path_rule("block", f"host{k}.zz", "/") for k in range(300)]
    assert sorted(str(tuple(r)) for r in op6.url_filter(df, many).drop("url").collect()) == want
    assert op6.url_filter(clashing(df, "host", "rule")).columns == ["page_id", "url", "host", "rule", "host_", "path", "rule_", "verdict"]
    assert op6.url_filter(table(spark, [], "page_id long, url string")).count() == 0
    assert op6.url_filter(df, []).where("verdict = 'allow'").count() == len(URLS)


def test_urls_listed_rules_of_the_contract(spark):
    """Verdicts written out from the contract's list, beside the SQL."""
    rows = [
        (1, "http://a.com/en/1", "com/en/", "block"), (2, "http://www.example.com/en/7x", "example.com/en/7", "allow"), (3, "http://a.net/de/1", "net/de/", "allow"),
        (4, "http://example.net/de/81", "example.net/de/8", "block"), (5, "http://a.org/es/1", "org/es/", "block"), (6, "http://ads.net/de/8", "net/de/", "allow"),
    ]
    got = op6.url_filter(table(spark, [r[:2] for r in rows], "page_id long, url string")).collect()
    assert sorted((r.page_id, r.url, r.rule, r.verdict) for r in got) == rows


def test_urls_fetch_by_token(spark):
    """Only rules filed under a token of the URL run, and each rule's tokens
    are held by every match, so the index loses none."""
    rules = op6.default_rules()
    df = table(spark, URLS, "page_id long, url string")
    plan = op6.url_filter(df)._jdf.queryExecution().executedPlan().toString()
    assert "element_at" in plan
    assert "hashpartitioning" not in plan and "Python" not in plan
    host, path = op6.host_and_path(F.col("url"))
    base = df.select(F.concat(host, path).alias("target")).withColumn("tokens", op6.tokens_of(F.col("target")))
    for r in rules:
        lost = base.where(F.rlike("target", F.lit(r.pattern)) & (F.size(F.array_except(F.lit(list(r.tokens)).cast("array<string>"), "tokens")) > 0))
        assert lost.count() == 0, r


# --- 7 secrets --------------------------------------------------------------

def base_spans(text):
    out = []
    for k, (p, g, least, flags) in enumerate([
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A), ("AKIA[A-Z0-9]+", 0, 18, 0), ("[0-9a-f]+", 0, 16, 0),
    ]):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "", flags) if len(m[g]) >= least]
    return sorted(out)


def test_secrets_against_regex(spark, sf):
    key, token = "AKIA" + "Q" * 16, "aB3" + "xY7z" * 8
    made = [
        f"token=secret:abcdefghijklmnopq PassWord : '{token}'", f"é {key}\nthen {token} near", f"{token} alone", f"{key}" + " pad" * 100 + token, "user: bob pwd=hunter2", "pwd=hunter2", f"https://host/x {token}",
        "api_key = \"" + "0123456789abcdef" * 3 + "\"", key * 300, "a" * 15 + " " + "b" * 16,
    ]
    rows = [(i, t) for i, t in enumerate(made + [t for _, t in H.HARD] + [t for _, t in texts_of(spark, sf)])]
    got = {r.doc_id: r for r in op7.secret_scan(clashing(table(spark, rows), "base")).collect()}
    for d, t in rows:
        assert sorted((s.start, s.kind, s.stop) for s in got[d].base) == base_spans(t)
    linked = {d: [rows[d][1][s.start : s.stop] for s in got[d].linked] for d, _ in rows[: len(made)]}
    assert linked[1] == [token] and linked[6] == [token] and linked[4] == ["pwd=hunter2"]
    assert not linked[2] and not linked[3] and not linked[5]
    assert op7.secret_scan(table(spark, [])).count() == 0


# --- 8 language model -------------------------------------------------------

def test_language_model_base_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = texts_of(spark, sf)
    got = registry.queries()["op8_lm_scoring"](spark, sf).toPandas().set_index("doc_id")
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    tokens = {d: H.words(t) + [""] for d, t in rows}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in tokens.items():
        r = got.loc[d]
        assert (bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    train = got[~got.held_out]
    assert train.score.sum() > train.base_score.sum()
    plain = op8.lm_scores(spark.read.parquet(f"{sf}/documents.parquet"), states=1).toPandas().set_index("doc_id")
    for out in (False, True):  # the latent states gain on rows that were not learnt from, too
        mine, one = (t[t.held_out == out].score.sum() / t[t.held_out == out].n_tokens.sum() for t in (got, plain))
        assert mine > one + 0.2, out


def test_language_model_on_hard_rows(spark):
    got = op8.lm_scores(clashing(table(spark, H.HARD), "score")).collect()
    assert len(got) == len(H.HARD)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert op8.lm_scores(table(spark, [])).count() == 0
    assert op8.lm_scores(table(spark, [(None, None)])).count() == 1


def test_likelihood_against_enumeration():
    rnd = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    p = hmm.Params(norm(rnd.random(2), 0), norm(rnd.random(2), 0), norm(rnd.random((2, 2)), 1), norm(rnd.random((3, 2)), 0))
    ids = np.array([0, 2, 1, 1])
    total = 0.0
    for code in range(16):
        s = [(code >> k) & 1 for k in range(4)]
        total += p.start[s[0]] * p.emit[0, s[0]] * np.prod([p.move[s[k - 1], s[k]] * p.emit[ids[k], s[k]] for k in range(1, 4)])
    off = np.array([0, 4])
    assert hmm.log10_likelihood(ids, off, p)[0] == pytest.approx(math.log10(total))
    long_ids = rnd.integers(0, 3, 5000)
    assert hmm._long(long_ids, p) == pytest.approx(_step_by_step(long_ids, p))


def _step_by_step(ids, p):
    x, total = p.start * p.emit[ids[0]], 0.0
    for k, w in enumerate(ids):
        if k:
            x = (x @ p.move) * p.emit[w]
        total += math.log10(x.sum())
        x = x / x.sum()
    return total


def test_baum_welch_raises_likelihood():
    rnd = np.random.default_rng(3)
    ids, off = rnd.integers(0, 6, 3000), np.arange(0, 3001, 100)
    ids[1500:] = ids[1500:] % 3
    floor = np.full(6, 1 / 6)
    p, last = hmm.first_guess(ids, off, 2, 6, floor), -np.inf
    for _ in range(4):
        counts = hmm.Counts(2, 6)
        now = hmm.expect(ids, off, p, counts)
        assert counts.emit.sum() == pytest.approx(len(ids))
        assert now >= last - 1
        last, p = now, counts.params(floor)


def test_no_nulls_kernel_bounds():
    from issq.llm import textkernel as tk

    texts = pa.array(["a" * 10, "", "b c", "d" * 3_000_000])
    assert [b for _, b in tk.pieces(texts, 12)] == [2, 3, 4]


def test_start_blocks_come_from_the_whole_table(spark):
    ids = table(spark, [((p << 32) + k,) for p in range(32) for k in range(16)], "block long")
    got = op8.start_blocks(ids)
    assert len(set(got)) == op8.SAMPLE_BLOCKS
    assert len({b >> 32 for b in got}) > 1 and max(got) >> 32 > 7
    assert got == op8.start_blocks(ids.repartition(7))
