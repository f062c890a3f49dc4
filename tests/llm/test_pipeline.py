"""The stages on the small tables, and the registered queries."""

import collections
import itertools
import math
import re
import struct

import pytest
import xxhash

import corpus_pipeline
from checks.compare import plain, rows_of  # noqa: F401
from cinderbook.llm import quality
from cinderbook.llm.common import saved
from cinderbook.llm.queries import QUERIES, SQL
from tests.llm.test_operators import sets


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, before, small), f"test-{name}")
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "bpe_tokens":
            assert after.columns == columns
        if name == "source_mixing":
            assert ids == {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    assert before.where("NOT round_trip").count() == 0
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def chain(n, steps, tag):
    """A text of n words and copies of it, each with some more of its last words changed."""
    words = [f"{tag}{i}" for i in range(n)]
    return [" ".join(words[: n - k] + [f"{tag}{k}x{i}" for i in range(k)]) for k in steps]


def test_near_dedup_links_from_four_fifths(spark, small):
    # 104 words are 100 shingles: with k words changed the similarity to the first text is (100 - k) / (100 + k).
    texts = [t for g in range(12) for t in chain(104, (0, 8, 9, 11), f"g{g}w")] + chain(50, (0, 0), "short")
    texts += [None, "", "one two", "one two"]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()}
    assert kept == brute_first(rows, 80) and kept != brute_first(rows, 85)


def brute_first(rows, percent):
    """Ids of the first document of each group."""
    parts = [(r[0], sets(r[1])) for r in rows]
    root = {k: k for k, _ in parts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(parts, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k for k in root if find(k) == k}


def test_line_dedup_takes_long_lines_alone(spark, small):
    words = [f"w{i}" for i in range(60)]
    just, short, longer = " ".join(words[:50]), " ".join(words[:49]), "\t".join(words)
    # Neighbours differ everywhere, so no two lines repeat together.
    texts = [f"head {i}\n{x}\ntail {i}" for i, x in enumerate([just, just, short, short, longer, longer, "hi", "hi"])]
    texts += [longer, just + " ", "own line\n\n" + just, None, "", f"{short}\n{just}\n{short}\n{just}", "x " * 30 + "y" * 60, "x " * 30 + "y" * 60]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    found = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs.repartition(3), small).collect()}
    assert found == brute_lines(rows, 50)
    assert found[1] == "head 1\ntail 1" and found[3] == texts[3] and 8 not in found and found[9] == texts[9] and found[15] == texts[15]


def brute_lines(rows, long_words):
    """Text by id after deleting later pairs of lines and later long lines, without documents that this leaves empty."""
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        worded = [k for k, x in enumerate(lines) if x.split()]
        runs = [(k,) for k in worded if len(lines[k].split()) >= long_words] + list(zip(worded, worded[1:], strict=False))
        gone = set()
        for run in sorted(runs):
            name = tuple(lines[k] for k in run)
            gone.update(run if name in seen else ())
            seen.add(name)
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or left:
            out[i] = left if text is not None else None
    return out


def test_quality_keeps_unseen_clean_documents_and_drops_junk(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    half = trusted.where("pmod(xxhash64(doc_id, 'half'), 2) = 0")
    kept = {r.doc_id: r.kept for r in quality.judged(docs, "text", "doc_id", half).collect() if not r.base_failed}
    clean = [kept[r.doc_id] for r in trusted.join(half, "doc_id", "left_anti").collect() if r.doc_id in kept]
    junk = [kept[r.doc_id] for r in labels.where("quality = 0").collect() if r.doc_id in kept]
    assert len(clean) > 100 and sum(clean) > 0.85 * len(clean) and len(junk) > 20 and sum(junk) < 0.05 * len(junk), (sum(clean), len(clean), sum(junk), len(junk))


def test_quality_ratios_are_in_no_plan_and_no_row(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = corpus_pipeline.quality_rules(spark, docs, small)._jdf.queryExecution().toString()
    assert len(plan) < 200_000
    # The arrays are read by the project that adds up, so no project below hands them on.
    projects = [x for x in plan.split("== Physical Plan ==")[1].split("\n") if "Project [" in x]
    assert sum("ubquery" in x and "aggregate(" in x for x in projects) >= 1 and not any("AS __unigrams" in x or "AS __bigrams" in x for x in projects)


def test_quality_ratios_take_few_jobs(spark, small):
    docs, ids = spark.read.parquet(f"{small}/documents.parquet"), spark.range(50).withColumnRenamed("id", "__id")
    counts = quality.saved(quality.counted(docs, "text", "doc_id", ids, quality.PART), "counts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("ratios", "")
    try:
        table = quality.ratios(counts, quality.PART)
    finally:
        spark.sparkContext.setJobGroup("", "")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ratios")) < 8
    row = table.first()
    assert len(row.unigrams) == len(row.bigrams) == quality.PART and any(row.unigrams) and any(row.bigrams)


def test_the_cut_takes_words_of_the_asked_documents_alone(spark, small):
    docs, ids = spark.read.parquet(f"{small}/documents.parquet"), spark.range(50).withColumnRenamed("id", "__id")
    table = quality.ratios(quality.counted(docs, "text", "doc_id", ids, quality.PART), quality.PART)
    means = quality.asked_means(docs, "text", "doc_id", ids, table, quality.PART)
    plan = means.agg({"mean": "max"})._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "split(" not in plan[plan.index("Join Inner") :]
    brief = {r.doc_id for r in docs.where("doc_id < 50").collect() if len((r.text or "").encode().split()) < quality.MIN_WORDS}
    assert brief and means.where("mean IS NULL").count() == len(brief) and means.count() == 50


def test_quality_scores_by_brute_force(spark, small):
    """Counts, ratios, held-out cut and verdict computed anew, in buckets so few that n-grams share them."""
    buckets = quality.PART
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "w " * 60), (0, "only twice said " * 40)], docs.schema))
    texts = [(r.doc_id, (r.text or "")) for r in docs.collect()]
    ids = {i for i, _ in texts if i is not None and i % 2 == 0}
    mask = buckets - 1
    eight = lambda h: struct.pack("<Q", h & (2**64 - 1))

    def grams(text):
        one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        seeds = [xxhash.xxh64_intdigest(eight(h), 42) for h in one]
        two = [xxhash.xxh64_intdigest(eight(n), s) for s, n in zip(seeds, one[1:], strict=False)] + seeds[-1:]
        return [h & mask for h in one] + [buckets + (h & mask) for h in two]

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    held = {i for i in ids if signed(xxhash.xxh64_intdigest(b"held out", xxhash.xxh64_intdigest(eight(i), 42))) % quality.HELD_OUT == 0}
    found = [(i, grams(t)) for i, t in texts]
    raw, target = collections.Counter(), collections.Counter()
    for i, g in found:
        raw.update(g)
        target.update(g if i in ids - held else ())
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + 1) / (raw[b] * share + 1)) * 1000 for b in raw}
    ratio = {b: int(math.copysign(math.floor(abs(x) + 0.5), x)) for b, x in ratio.items()}
    means = [(i, len(g) // 2, sum(ratio[b] for b in g) / len(g) / 1000 if g else 0.0) for i, g in found]
    low = sorted(m for i, n, m in means if i in held and n >= quality.MIN_WORDS)
    assert len(low) > 3
    cut = low[max(0, math.ceil(quality.LOST * len(low)) - 1)]
    expected = sorted((n, round(m - cut, 9)) for _, n, m in means)
    trusted = spark.createDataFrame([(i,) for i in ids], "doc_id LONG")
    rows = quality.judged(docs, "text", "doc_id", trusted, buckets=buckets).collect()
    assert sorted((r.n_words, round(r.llr_score, 9)) for r in rows) == expected
    assert all(r.kept == (not r.base_failed and r.llr_score >= 0) for r in rows) and {r.kept for r in rows} == {True, False}
