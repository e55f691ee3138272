"""Exact duplicates, the Merkle manifest and whitening against brute-force versions."""

import hashlib
import random
import re
import time
import weakref
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mediaframe.llm import components, exact_dedup, jaccard_join, merkle, pii, shingles, toxicity, whitening
from mediaframe.llm.common import kept_by
from mediaframe.llm.tokens import words

LOW = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    pool = [None, "", "A b", "a B", "É", "é", "İ x", "i̇ x", "ẞß", "K" * 200, "k" * 199 + "K", "k" * 199 + "l", "\0", "x" * 300_000, "x" * 299_999 + "y", " a b"]
    texts = [rng.choice(pool) for _ in range(150)] + ["Same Text"] * 90 + ["same text"] * 60
    ids = [rng.choice([None, *range(40)]) for _ in texts]
    docs = spark.createDataFrame([(i, t, 1.0, 2.0) for i, t in zip(ids, texts)], "doc_id long, text string, row double, `group` double").repartition(7)
    got = exact_dedup.duplicates(docs, digests=True).collect()
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[(t or "").translate(LOW)].append(i)
    by_digest = {H(t): sorted(g, key=lambda i: (i is not None, i or 0)) for t, g in groups.items()}
    assert len(got) == len(texts)
    for d, g in by_digest.items():
        mine = [r for r in got if r["text_sha256"].hex() == d]
        assert sorted((r["doc_id"] for r in mine), key=lambda i: (i is not None, i or 0)) == g
        assert {r["keep_id"] for r in mine} == {g[-1]} and {r["group_size"] for r in mine} == {len(g)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [g[-1]]
    lazy = exact_dedup.duplicates(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in lazy))) == sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got)))
    assert all(r["text_sha256"] is not None for r in lazy if r["group_size"] > 1)
    assert exact_dedup.distinct_texts(docs).count() == len(by_digest)
    assert exact_dedup.duplicates(docs.where("false")).count() == 0


def test_dedup_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")
    assert "Python" not in exact_dedup.duplicates(docs)._jdf.queryExecution().toString()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        lo = at // 8 * 8
        out.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + 8])))
        at //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 513, 700, 4096])
def test_traversal_gives_every_path(n):
    leaves = [H(str(k)) for k in range(n)]
    levels = levels_of(leaves)
    height = merkle.height(n)
    assert height == len(levels) - 1 and merkle.block_root(leaves, height) == levels[-1][0]
    assert list(merkle.traverse(leaves, height)) == [siblings(levels, k) for k in range(n)]


def test_traversal_keeps_little():
    level = merkle.Treehash(3)
    for k in range(4096):
        level.push(str(k))
        assert sum(map(len, level.stack[:-1])) <= 7 * 3
        level.stack[-1].clear()


def test_manifest_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(k if k % 11 else None, f"Text {k % 60}" if k % 7 else None, rng.choice(["en"] * 40 + ["de", "é", "z", None, ""]), None if k % 5 == 0 else "s", k if k % 3 else None) for k in range(4500)] + [(5, "Same", "en", "s", 4)] * 120
    docs = spark.createDataFrame([(*r, 1.0, 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, part double, `key` double").repartition(5)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    proven = merkle.proofs(merkle.document_leaves(docs, tampered))
    got = [(r["key"], r["leaf"], r["subroot"], r["root"], r["p"], r["f"]) for r in proven.select("*", merkle.path_digest(F.col("path")).alias("p"), merkle.fold(F.col("probe"), F.col("path")).alias("f")).collect()]
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(*map(value, (r[0], r[3], r[2], r[4], t)))
    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        parts[lang].sort(key=lambda x: x[:3])
        trees[lang] = levels_of([x[2] for x in parts[lang]])
    top, want = levels_of([trees[x][-1][0] for x in langs]), []
    for place, lang in enumerate(langs):
        for at, (_, _, d, r) in enumerate(parts[lang]):
            path = siblings(trees[lang], at) + siblings(top, place)
            node = leaf(r, r[1] and r[1].translate(LOW)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else d
            for a, b in path:
                node = H(a, node, b)
            want.append((r[0], d, trees[lang][-1][0], top[-1][0], H(*(a + b for a, b in path)), node))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(x[5] != x[3] for x in got)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    made = (rng.normal(size=(700, 70)) @ rng.normal(size=(70, 70)) * 3 + 50).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(made)] + [(None, made[3].tolist()), (3, made[3].tolist()), (900, None), (901, [float("nan")] + made[0].tolist()[1:]), (902, [None] + made[0].tolist()[1:]), (903, []), (904, [float("inf")] * 70)]
    table = spark.createDataFrame([(*r, 1.0, 2.0) for r in rows], "vec_id long, embedding array<float>, size double, `at` double").repartition(5)
    got = whitening.components(table).collect()
    kept = [r for r in rows if r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    x = np.floor(64 * np.array([r[1] for r in kept])).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    away = n * x - total
    covariance = np.array((away.T.astype(object) @ away.astype(object)) / n**3, float)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:32]
    want = away / n @ vectors[:, order] / np.sqrt(values[order])
    assert len(got) == 32 * n and {r["n"] for r in got} == {n}
    by_row = defaultdict(list)
    for r in got:
        by_row[(r["vec_id"], r["deviation"])].append(r)
    for (i, _), w, d in zip(kept, want, (away.astype(object) ** 2).sum(axis=1), strict=True):
        mine = by_row[(i, int(d))]
        for k in range(32):
            assert any(abs(abs(r["whitened"]) - abs(w[k])) < 1e-8 for r in mine if r["component"] == k + 1)
    assert max(r["identity_error"] for r in got) < 1e-9
    share = {r["component"]: r["explained"] for r in got}
    assert np.allclose([share[k + 1] for k in range(32)], values[order] / np.trace(covariance), rtol=1e-9)


def test_tiles_are_exact_for_large_entries(spark):
    rows = [(k, [float(3**k % 10_000_000_000 if j == k % 3 else j), -0.5 * k, 1e8 * k]) for k in range(40) for j in (0, 1)]
    models = whitening.fit(whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)))
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64).astype(object) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    assert models[3].total == total.tolist()
    exact = (x - total // n).T @ (x - total // n)
    rest = total - n * (total // n)
    assert models[3].trace == pytest.approx(float(sum((exact[k][k] * n - rest[k] * rest[k]) / (n * n) for k in range(3))), rel=1e-14)


def test_degenerate_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found = whitening.components(one).collect()
    assert len(found) == 2 and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in found)
    equal = one.union(one).union(spark.createDataFrame([(2, [1.0, 9.0])], one.schema))
    found = whitening.components(equal).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in found) and len(found) == 6
    assert whitening.components(one.where("false")).count() == 0
    with pytest.raises(ValueError):
        whitening.fit(whitening.usable(spark.createDataFrame([(1, [0.5] * 3000)], "vec_id long, embedding array<float>")))


def test_words_that_equal_hashes_modulo_powers_of_two(spark):
    word = [0]
    while len(word) < 4096:
        word += [1 - k for k in word]
    rows = [(2 * n + c, "".join("ab"[k ^ c] for k in word[: 512 << n])) for n in range(4) for c in (0, 1)]
    found = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 1 for r in found)


def test_card_windows_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        run = "".join(rng.choice(["", "", " ", "-"]) + rng.choice("0123456789") for _ in range(rng.randrange(13, 60))).strip(" -")
        m = re.fullmatch(r"(?s).*", run)
        groups = [g.span() for g in re.finditer(r"[0-9]+", run)]
        brute = []
        for k in range(len(groups)):
            for e in range(k, len(groups)):
                text = run[groups[k][0] : groups[e][1]]
                digits = re.sub(r"[^0-9]", "", text)
                if 13 <= len(digits) <= 19 and digits[0] != "0" and pii.luhn(digits[:-1]) == int(digits[-1]):
                    sizes = tuple(b - a for a, b in groups[k : e + 1])
                    usual = (sizes in pii.CARD_GROUPS or len(sizes) == 1) and pii.ISSUED.fullmatch(digits)
                    brute.append((not usual, groups[k][0], -groups[e][1]))
        kept = []
        for _, lo, hi in sorted(brute):
            if all(-hi <= a or b <= lo for a, b in kept):
                kept.append((lo, -hi))
        assert [c[:2] for c in pii._cards(m, b"k")] == sorted(kept)


def test_long_runs_of_digits_take_time_in_proportion():
    for text in ("1 " * 250_000, "+1 11 11 " * 50_000, "4111 1111 1111 1111 " * 20_000):
        began = time.time()
        changed, spans = pii.pseudonymize_text(text, b"k")
        assert time.time() - began < 60 and len(changed) == len(text)
    assert len(spans) == 20_000


def test_more_forms_of_dates_and_phones():
    found = lambda t: pii.pseudonymize_text(t, b"k")
    for text in ("on 1/2/2024.", "am 1.2.2024 um", "12/1/2024"):
        changed, spans = found(text)
        assert [k for k, _, _ in spans] == ["date"] and changed != text and not re.search(r"(?<![0-9])0", changed)
    (a, _), (b, _) = found("1/2/2024"), found("01/02/2024")
    assert [int(x) for x in a.split("/")] == [int(x) for x in b.split("/")]
    (a, one), (b, _) = found("call 1-800-555-1234 now"), found("call 800-555-1234 now")
    assert one == [("phone", 5, 19)] and a.replace("1-", "", 1) == b


def test_a_worker_keeps_what_one_operator_needs():
    """Workers serve the stages of all operators of a pipeline: what an operator keeps from task to task goes when another one runs."""
    model = toxicity.Model({"some": 1.0})
    model.score("some words")
    assert kept_by("toxicity")[model.name]
    tokenizer = weakref.ref(words(public_tokenizers.path("word_bpe_49k.json")))
    assert tokenizer() is words(public_tokenizers.path("word_bpe_49k.json"))
    shingles.sets(["some words of a text that has shingles"])
    assert tokenizer() is None
    held = kept_by("shingles")
    assert len(held) == 4 and all(x.itemsize == 4 for x in held.values())
    model.score("some words")
    assert not held


def test_components_settle_in_few_rounds(spark, monkeypatch):
    """A chain whose nodes' order is mixed, links in both directions, some of them repeated; a task's links are made stars in parts."""
    names, rng = [], random.Random(5)
    plain = components.saved
    monkeypatch.setattr(components, "saved", lambda df, name, **more: (names.append(name), plain(df, name, **more))[1])
    monkeypatch.setattr(components, "CHUNK", 20, raising=False)
    nodes = rng.sample(range(-500, 500), 300)
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(nodes, nodes[1:])] * 2 + [(1000, 1000), (2001, 2000), (2000, 2002)]
    got = components.connected_components(spark.createDataFrame(rng.sample(links, len(links)), "a long, b long").repartition(4)).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted([(n, min(nodes)) for n in nodes] + [(k, 2000) for k in (2000, 2001, 2002)])
    assert names.count("links") <= 4


def test_a_round_of_components_needs_few_shuffles(spark, monkeypatch):
    plans = []
    plain = components.saved
    monkeypatch.setattr(components, "saved", lambda df, name, **more: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), plain(df, name, **more))[1])
    components.connected_components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"))
    for name, plan in plans:
        if name == "links":
            assert plan.count("Aggregate") <= 1, plan
