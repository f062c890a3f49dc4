"""Whitening, packing and vector codes against brute force on odd rows."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cinderbook.llm import packing, queries, vectorcodes, whitening

PATH = public_tokenizers.path("word_bpe_49k.json")
EXTRA = "component INT, N INT, code STRING, error INT, `start` INT, ids INT, __rank INT, offset INT"


# --- vectors --------------------------------------------------------------------------------
def vectors(dims=8, n=400):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, dims)) * np.linspace(1, 3, dims)
    rows = [(i, x[i].tolist(), i % 5 if i % 7 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * (dims - 1), 1), (n + 2, [None] + [1.0] * (dims - 1), 2), (n + 3, [float("nan")] * dims, 2)]
    rows += [(n + 4, [float("inf")] + [0.0] * (dims - 1), 2), (n + 5, [], 2)]
    rows += [(3, rows[3][1], 3), (None, rows[4][1], None)]  # repeated vectors, a repeated and a missing id
    return [(*r, *[9] * 2, "c", *[9] * 5) for r in rows]


SCHEMA = f"vec_id LONG, embedding ARRAY<DOUBLE>, label INT, {EXTRA}"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3)


def sound(rows, dims=8):
    return [r for r in rows if r[1] and len(r[1]) == dims and all(c is not None and np.isfinite(c) for c in r[1])]


def test_whitening_is_that_of_the_full_covariance(table):
    rows = sound(vectors())
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    fitted = np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    c = fitted - sums / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1], turn[:, ::-1]
    got = whitening.whitened(table, "embedding").toPandas()
    assert len(got) == 4 * len(rows) and list(got.columns)[:3] == ["vec_id", "label", "component"]
    assert (got["component"] == 9).all() and (got["n_"] == n).all() and got["identity_error"].max() < 1e-9
    for k in range(4):
        part = got[got["component_"] == k + 1]
        found = {(i, d): w for i, d, w in zip(part["vec_id"].fillna(-1), part["deviation"], part["whitened"], strict=True)}
        wanted = (x - sums / n) @ turn[:, k] / np.sqrt(values[k])
        deviation = ((n * x - sums) ** 2).sum(axis=1)
        keys = [(-1 if r[0] is None else r[0], d) for r, d in zip(rows, deviation.tolist(), strict=True)]
        pairs = np.array([(found[key], w) for key, w in zip(keys, wanted, strict=True)])
        assert min(np.abs(pairs[:, 0] - pairs[:, 1]).max(), np.abs(pairs[:, 0] + pairs[:, 1]).max()) < 1e-9
        assert part["explained"].iloc[0] == pytest.approx(values[k] / values.sum(), rel=1e-9)


def test_whitening_certifies_close_eigenvalues_and_flat_spectra():
    """The subspace iteration by itself, with a plain matrix in place of the distributed products."""

    class Plain:
        def __init__(self, matrix):
            self.matrix, self.dims = matrix, len(matrix)

        def __matmul__(self, q):
            return self.matrix @ q

    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    for spectrum in (np.linspace(1000, 1100, 64), np.geomspace(1e-3, 1e6, 64), np.r_[np.ones(60), 1.001, 1.002, 5, 6], np.ones(64)):
        values, vectors_, residual = whitening.leading(Plain(turn * spectrum @ turn.T))
        assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-12) and residual < 1e-12
        assert np.allclose(vectors_.T @ vectors_, np.eye(4), atol=1e-13)


def test_whitening_of_nothing_and_of_one_vector(spark, table):
    none = whitening.whitened(table.limit(0), "embedding")
    assert none.count() == 0 and none.columns == whitening.whitened(table, "embedding").columns
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    assert whitening.whitened(same, "embedding").count() == 0
    far = spark.createDataFrame([(i, [1e300 * i, float(i)]) for i in range(3)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = whitening.whitened(far, "embedding").toPandas()
    assert set(got["component"]) <= {1, 2} and got["deviation"].isna().any()


def coded(rows, dims, parts=4):
    rows = sorted(sound(rows, dims), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(1024 * c)) for c in r[1]] for r in rows]
    cuts = vectorcodes._cuts(dims)
    books, codes, errors = [], [""] * len(x), [0] * len(x)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        pieces = [v[a:b] for v in x]
        book = [list(p) for p in pieces[:256]]
        near = lambda p: min((sum((u - w) ** 2 for u, w in zip(p, e, strict=True)), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(4):
            found = [near(p)[1] for p in pieces]
            for k in range(len(book)):
                own = [p for p, f in zip(pieces, found, strict=True) if f == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        for i, (e, k) in enumerate(map(near, pieces)):
            codes[i] += f"{k:02x}"
            errors[i] += e
        books.append(book)
    return rows, codes, errors, ",".join(str(c) for book in books for e in book for c in e)


@pytest.mark.parametrize(("dims", "n"), [(8, 400), (6, 40)])
def test_vector_codes_equal_plain_ones(spark, dims, n):
    given = vectors(dims, n)
    rows, codes, errors, listed = coded(given, dims)
    found, books = vectorcodes.coded(spark.createDataFrame(given, SCHEMA).repartition(3), "embedding", "vec_id")
    assert vectorcodes.listed(books) == listed
    got = [(r["vec_id"], tuple(r["embedding"]), r["code_"], r["error_"]) for r in found.collect()]
    wanted = [(r[0], tuple(r[1]), c, e) for r, c, e in zip(rows, codes, errors, strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(wanted, key=order)
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    summed = vectorcodes.with_label_errors(found, "label", "error_").collect()
    assert len(summed) == len(rows) and all(r["label_error"] == by_label[r["label"]] for r in summed)


def test_vector_codes_of_nothing_and_of_huge_components(spark):
    none, books = vectorcodes.coded(spark.createDataFrame([], SCHEMA), "embedding", "vec_id")
    assert none.count() == 0 and vectorcodes.listed(books) == ""
    far = [(i, [1e300 if i else -1e300, 0.0, 1.0, float(i)], 0, *[9] * 2, "c", *[9] * 5) for i in range(3)]
    found, _ = vectorcodes.coded(spark.createDataFrame(far, SCHEMA), "embedding", "vec_id")
    assert [r["error_"] for r in found.orderBy("vec_id").collect()] == [0, 0, 0]


# --- packing --------------------------------------------------------------------------------
def documents():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdéß"), rng.integers(1, 9)))
    texts = [" ".join(word() for _ in range(int(n))) for n in rng.geometric(1 / 150, 300)]
    texts += [None, "", "  \n", "x" * 9000, "ab cd " * 3000, "<|endoftext|> it's <|startoftext|>we'LL 12 ½²", "a\x1cb\x00c\x85d\xa0e　f ΣΑΣ İ 日本 👍"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, "another of the id"), (None, texts[6])]
    return [(*r, *[9] * 2, "c", *[9] * 5) for r in rows]


def test_packing_is_whole_exact_and_nearly_full(spark):
    given = documents()
    tokenizer = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(given, f"doc_id LONG, text STRING, {EXTRA}").repartition(4)
    out = packing.packed(df, "text", PATH)
    assert out.columns == ["doc_id", *[c.split()[0].strip("`") for c in EXTRA.split(", ")], "start_", "length", "ids_", "doc_tokens", "sequence_id", "offset_"]
    got = out.collect()
    wanted = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, *_ in given)
    sequences, starts = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids_"], "<u4")
        assert len(ids) == r["length"] and r["offset"] == 9
        sequences.setdefault(r["sequence_id"], []).append((r["offset_"], r["length"]))
        starts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start_"], tuple(ids)))
    for places in sequences.values():
        places.sort()
        assert all(at == sum(n for _, n in places[:i]) for i, (at, _) in enumerate(places)) and sum(n for _, n in places) <= 2048
    padding = sum(2048 - n for n in (sum(n for _, n in p) for p in sequences.values()) if n & (n - 1))
    assert padding < 0.01 * sum(map(len, wanted))
    # Documents of one id and length (the repeated row) have their pieces side by side.
    rebuilt = []
    for (_, tokens), pieces in starts.items():
        pieces.sort()
        copies = sum(1 for a, _ in pieces if a == 0)
        for k in range(copies):
            rebuilt.append(tuple(i for _, ids in pieces[k::copies] for i in ids))
            assert len(rebuilt[-1]) == tokens
    assert sorted(rebuilt) == wanted


def test_packing_of_equal_lengths_and_of_nothing(spark):
    """Lengths that leave room in every pattern go to the line, which is cut; a third of the rows may be alike."""
    given = [(i, "ab " * 1499) for i in range(50)]
    out = packing.packed(spark.createDataFrame(given, "doc_id LONG, text STRING"), "text", PATH).collect()
    total = sum(r["length"] for r in out)
    filled = {}
    for r in out:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert all(n & (n - 1) == 0 for n in filled.values()) and total == sum(filled.values()) and len(filled) <= -(-total // 2048) + 11
    assert packing.packed(spark.createDataFrame([], "doc_id LONG, text STRING"), "text", PATH).count() == 0


def test_words_by_rank_equal_the_library():
    definition = packing.definition_of(PATH)
    ranks = packing.ranks_of(definition)
    assert len(ranks) == 49_406
    assert packing.ranks_of(packing.definition_of(public_tokenizers.path("byte_bpe_50k.json"))) is None
    tokenizer = Tokenizer.from_file(PATH)
    import pyarrow as pa

    texts = [t for _, t, *_ in documents()] + [f"{chr(c)}a {chr(c)} b{chr(c)}" for c in range(1, 0x260)]
    slow, fast = packing.Encoder(definition, None), packing.Encoder(definition, ranks)
    for encoder in (slow, fast):
        flat, sizes = encoder.texts(pa.array(texts, pa.string()))
        for t, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
            assert ids.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_patterns_meet_the_histogram_at_the_bound():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 512, 4000), rng.integers(200, 300, 1000), rng.choice([375, 100], 500), np.array([375] * 9)):
        sizes, counts = np.unique(lengths, return_counts=True)
        patterns, use = packing.patterns_of(sizes, counts, 512)
        assert np.allclose(use @ patterns, counts) and (use >= 0).all() and (patterns @ sizes <= 512).all()
        # The price of every pattern is at most one at the optimum: no cheaper cover exists beyond GAP.
        inverse = np.linalg.inv(patterns.T.astype(float))
        best = packing.knapsack(sizes, inverse.sum(axis=0), 512)[0][-1]
        bound = max(use.sum() / max(best, 1), (sizes * counts).sum() / 512)
        assert use.sum() <= bound * (1 + 2 * packing.GAP)
        full, times = packing.rounded(sizes, counts, 512)
        assert (times @ full <= counts).all() if len(times) else True


def test_queries_have_the_columns_asked_for(spark, small):
    names = {
        "op11_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        "op12_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op13_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    }
    for name, columns in names.items():
        got = queries.QUERIES[name](spark, small)
        assert got.columns == columns and got.count() > 0
    assert len(hashlib.sha256().hexdigest()) == len(got.first()["codebooks_sha256"])


def test_bpe_round_trip_equals_encoding_and_decoding(spark):
    from cinderbook.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([r[:2] for r in documents()], "doc_id LONG, text STRING").repartition(3)
    both = sorted(bpe.round_trip(df, "text", path).collect(), key=str)
    apart = sorted(bpe.decode(bpe.encode(df, "text", path), "ids", path).collect(), key=str)
    assert [tuple(r) for r in both] == [tuple(r) for r in apart]
    tokenizer = Tokenizer.from_file(path)
    assert all(r["ids"] == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in both)
    assert all(r["decoded"] == (r["text"] or "") for r in both)


def test_packing_holds_one_python_worker_a_task(spark):
    """A stage with two Python functions one behind another keeps two workers, each with the encoder's tables once it is reused."""
    df = spark.createDataFrame(documents(), f"doc_id LONG, text STRING, {EXTRA}").repartition(4)
    plan = packing.packed(df, "text", PATH)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "MapInArrow" in line or "ArrowEvalPython" in line:
            for below in lines[k + 1 :]:
                if depth(below) <= depth(line) or "Exchange" in below:
                    break
                assert "MapInArrow" not in below and "ArrowEvalPython" not in below, plan
