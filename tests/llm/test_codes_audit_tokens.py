"""Product codes, the filter audit and token counts against brute force, and odd rows."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from tessera.llm import filter_audit, product_codes, token_counts

ODD = "doc_id long, text string, source string, mask int, part string, n int, quality int, words int, digest string, n_tokens string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "Word w1 w2 " * 30_000
    rows = [(1, "a b c"), (2, None), (3, ""), (4, long), (5, "a b c"), (5, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (9, "<|endoftext|>x $"), (10, "É ﬁ 中文 \n\n 's")]
    return spark.createDataFrame([(i, t, None if i in (2, 9) else f"s{(i or 0) % 2}", *[None] * 7) for i, t in rows], ODD)


# --- 11 product codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    x = np.array([r[1] for r in rows], np.int64)
    width = x.shape[1] // parts
    entry, error, books = [], np.zeros(len(x), np.int64), []
    for p in range(parts):
        q = x[:, p * width : (p + 1) * width]
        book = q[:entries].copy()
        for turn in range(rounds + 1):
            d = ((q[:, None] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if turn < rounds:
                for j in range(len(book)):
                    if (near == j).any():
                        book[j] = [int(v) // int((near == j).sum()) for v in q[near == j].sum(0)]
        entry.append(near)
        error += d.min(1)
        books.append(book)
    return ["".join(f"{e[i]:02x}" for e in entry) for i in range(len(x))], error, product_codes.books_digest(np.array(books))


def vectors(spark, n, d, seed=3, near=False):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1 if near else 6).astype(np.float32)
    if near:  # many equal parts, so many ties
        x = np.round(x)
    rows = [(i, [float(y) for y in v], i % 3 if i % 5 else None, "x", 1.5) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error double")


@pytest.mark.parametrize(("n", "near", "entries"), [(700, False, 256), (900, True, 256), (300, False, 16), (40, False, 256), (1, False, 256)])
def test_codes_equal_brute_force(spark, n, near, entries, monkeypatch):
    monkeypatch.setattr(product_codes, "BLOCK_NUMBERS", 16 * 150)  # several blocks a task
    df = vectors(spark, n, 16, near=near)
    got = product_codes.compress(df, entries=entries).orderBy("vec_id").collect()
    rows = [(r["vec_id"], [math.floor(1024 * x) for x in r["embedding"]]) for r in df.orderBy("vec_id").collect()]
    code, error, digest = brute_codes(rows, entries=entries)
    assert [r["code"] for r in got] == code
    assert [r["error"] for r in got] == error.tolist()
    assert {r["codebooks_sha256"] for r in got} == {digest}
    label = {r["vec_id"]: r["label"] for r in df.collect()}
    sums = {x: sum(e for r, e in zip(got, error, strict=True) if label[r["vec_id"]] == x) for x in set(label.values())}
    assert all(r["label_error"] == sums[label[r["vec_id"]]] for r in got)


def test_only_violated_parts_are_measured_again(monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4000, 8)) * 1000 + rng.integers(0, 20, 4000)[:, None] * 9000).astype(np.int64)
    book = x[:64].copy()
    entry, slack = product_codes.nearest(x, book)
    heaps = product_codes.Heaps.of(entry, product_codes.key_of(slack, 0.0), 64)
    measured, drift = [], np.zeros((1, 64))
    plain = product_codes.nearest
    monkeypatch.setattr(product_codes, "nearest", lambda a, b: measured.append(len(a)) or plain(a, b))
    for _ in range(6):
        now = heaps.entries()
        after = np.array([x[now == j].sum(0) // max(1, (now == j).sum()) if (now == j).any() else book[j] for j in range(64)])
        drift += product_codes.drifted(book[None], after[None])
        book = after
        heaps.round(x, book, drift[0])
        assert (heaps.entries() == product_codes.distances(x, book).argmin(1)).all()
        assert sorted(heaps.rows.tolist()) == list(range(4000))
    assert sum(measured[-3:]) < 3 * 4000 * 0.8


def test_distances_of_large_numbers_are_exact():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-(1 << 27), 1 << 27, (50, 6)), rng.integers(-(1 << 27), 1 << 27, (7, 6))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in book] for u in x]
    assert product_codes.distances(x, book).tolist() == want


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1] * 4, 7), (1, [0.1] * 4, 7), (2, None, 7), (3, [nan, 0.0, 0.0, 0.0], 7), (4, [0.0, inf, 0.0, 0.0], None), (5, [None, 0.0, 0.0, 0.0], 7), (None, [-0.0001, 5.0, 1e-30, -1e-30], None), (9, [3.0, 2.0, 1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = product_codes.compress(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == [(False, 1), (False, 1), (False, 9), (True, 0)]
    assert {r["error"] for r in got} == {0}
    assert [r["code"] for r in got if r["vec_id"] == 1] == ["00000000"] * 2
    assert product_codes.compress(df.limit(0)).count() == 0
    assert product_codes.compress(df.where("vec_id = 2")).count() == 0
    with pytest.raises(Exception, match="lengths"):
        product_codes.compress(df.unionByName(spark.createDataFrame([(0, [1.0] * 8, 1)], df.schema))).count()


def test_negative_numbers_are_floored(spark):
    df = spark.createDataFrame([(0, [-0.0001] * 4, 1), (1, [0.0] * 4, 1)], "vec_id long, embedding array<double>, label int")
    assert [r["v"] for r in product_codes.kept_vectors(df).orderBy("vec_id").collect()] == [[-1] * 4, [0] * 4]


# --- 12 filter audit


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        docs.append((s or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                failing = [d for d in mine if f in d[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def as_dict(df):
    return {tuple(r[:3]): list(r[3:]) for r in df.collect()}


def test_audit_of_odd_rows_equals_brute_force(spark, odd):
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (5, 1, None), (77, 1, 1)]
    got = filter_audit.audit_filters(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert as_dict(got) == brute_audit([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], labels)
    assert filter_audit.audit_filters(odd.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_documents_equals_brute_force(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = as_dict(filter_audit.op12_filter_audit(spark, data))
    assert got == brute_audit([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_polynomial_counts_what_any_set_of_filters_removes():
    rng = random.Random(2)
    for _ in range(20):
        counts = {m: rng.randrange(9) for m in range(32)}
        p = filter_audit.removal_polynomial(counts)
        for s in range(32):
            assert filter_audit.corner(p, s) == sum(n for m, n in counts.items() if m & s)
        assert sum(filter_audit.shapley(p, i) for i in range(5)) == sum(n for m, n in counts.items() if m)


# --- 13 token counts


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def test_counts_equal_the_library(spark, data):
    t = library()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in token_counts.op13_token_counts(spark, data).collect():
        text = texts.pop(r["doc_id"])
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 2048)
    assert not texts


def test_counts_of_odd_texts_equal_the_library():
    import public_tokenizers

    t, of, rng = library(), token_counts.WordCounts(public_tokenizers.path(token_counts.VOCABULARY)).of, random.Random(4)
    chars = ["a", "B", "'S", "'ll", " ", "\n", "\x1c", "\x85", " ", " ", "<|endoftext|>", "<|", "|>", "<|StartOfText|>", "é", "é", "İ", "Σ", "ß", "中", "😀", "‍", "1", "²", "٣", "#", "..", "\x00", "가", "ǅ"]
    for _ in range(4000):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(15)))
        assert of(text) == len(t.encode(text, add_special_tokens=False).ids), text
    long = "ab" * 40_000 + "x" * 20_000 + "é" * 5000
    assert of(long) == len(t.encode(long, add_special_tokens=False).ids)


def test_token_counts_of_odd_rows(odd):
    got = token_counts.count_tokens(odd).collect()
    t = library()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()]
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=key) == sorted(want, key=key)
    assert [r["over_limit"] for r in got if r["doc_id"] == 4] == [True]
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


# --- 9 the fit of the discriminant


def test_discriminant_is_fitted_as_numpy_fits_it():
    """Means, shrunk covariances and the choice of shrinkage, all worked out anew from the rows."""
    from tessera.llm import quality

    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 600)
    x = rng.normal(size=(600, 5)) @ np.diag([1, 2, 3, 1, 1]) + y[:, None] * np.array([0.5, -1, 0, 0.7, 0])
    x[y == 1] *= 1.3
    fold = rng.integers(0, 4, 600)
    got = quality.fit(x, y, fold)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)

    def log_ratio(shrink, sphere, rows):
        out = []
        covs = [np.cov(z[(fold > 0) & (y == k)].T, bias=True) for k in (0, 1)]
        n = [((fold > 0) & (y == k)).sum() for k in (0, 1)]
        pooled = (covs[0] * n[0] + covs[1] * n[1]) / sum(n)
        for k in (0, 1):
            c = (1 - shrink) * covs[k] + shrink * pooled
            c = (1 - sphere) * c + sphere * np.trace(c) / 5 * np.eye(5) + 1e-6 * np.eye(5)
            d = rows - z[(fold > 0) & (y == k)].mean(0)
            out.append(-0.5 * (d * np.linalg.solve(c, d.T).T).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
        return out[1] - out[0]

    def loss(shrink, sphere):
        t, truth = np.arcsinh(log_ratio(shrink, sphere, z[fold == 0])), y[fold == 0]
        a, b = 0.0, 0.0
        for _ in range(4000):  # plain descent on the same ridge
            p = 1 / (1 + np.exp(-(a * t + b)))
            a, b = a - 0.5 * (((p - truth) * t).mean() + 1e-2 * a), b - 0.5 * (p - truth).mean()
        p = 1 / (1 + np.exp(-(a * t + b)))
        return -np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p)), a, b

    tried = {(s, r): loss(s, r) for s in (0.02, 0.1, 0.3, 0.6, 1.0) for r in (0.01, 0.05, 0.2)}
    best = min(tried, key=lambda k: tried[k][0])
    assert np.allclose(got.difference(x), log_ratio(*best, z), atol=1e-6)
    assert np.allclose(got.scale, tried[best][1:], atol=1e-3)
