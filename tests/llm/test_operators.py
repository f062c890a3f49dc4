"""Every text operator against brute force on odd rows: nulls, blanks, long texts, ties, repeats, clashing columns, no rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinderbook.llm import bpe, cws, langid, linededup, mixing, neardup, pii, quality, sharding, wordpiece

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "ab1 " * 20_000
EXTRA = "kept INT, N_WORDS INT, node INT, id INT, ids INT, score INT, epoch INT, hash INT, `place` INT"
SCHEMA = f"doc_id LONG, text STRING, lang STRING, source STRING, {EXTRA}"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Eps", "été", "naïve", "x", "the", "of"]
    prose = [" ".join(rng.choices(words, k=n)) for n in (60, 80, 120, 200)]
    shared = "line one of a passage\nline two of a passage\nline three"
    near = prose[3].split()
    near[10] = "changed"
    texts = [
        None, "", " \n\t ", LONG, "x" * 50_000, prose[0], prose[0], prose[1] + "\n" + shared, shared + "\n" + prose[2],
        prose[3], " ".join(near), "one two three", "one two three", "a\na\na\na\nb", "mail a.b@c.de now +1 (377) 555-0271, 1.2.3.4 4111 1111 1111 1111",
        "emoji 👍 日本語 <|endoftext|> it's odd   end  ",
    ]
    out = [(i, t, "en" if i % 2 else "fr", None if i == 3 else f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(5, prose[0], "en", "s0"), (None, prose[1], None, "s1"), (5, "another text of the same id", "en", "s1")]
    return [(*r, *range(9)) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


# --- token counts ---------------------------------------------------------------------------
def greedy(word, starts, inside):
    n, at = 0, 0
    while at < len(word):
        table = inside if at else starts
        size = next((s for s in range(min(len(word) - at, 12), 0, -1) if word[at : at + s] in table), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


def test_automaton_counts_as_greedy_matching():
    rng = random.Random(1)
    for _ in range(40):
        starts = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(8)}
        inside = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(8)}
        automaton = wordpiece.Automaton(starts, inside)
        for n in range(7):
            for word in map("".join, itertools.product("abcd"[: 3 + (n < 4)], repeat=n)):
                assert automaton.count(word) == greedy(word, starts, inside)


def test_token_counts(spark, docs, none):
    starts, inside = wordpiece.vocabulary(PATH)
    found = wordpiece.token_counts(docs, "text", starts, inside)
    assert found.columns == [*docs.columns, "n_words_", "n_tokens", "n_unknown"]
    first, rest = set(starts), set(inside)
    for r in found.where("length(text) < 10000 OR text IS NULL").collect():
        words = regex.findall(wordpiece.WORD, r.text or "")
        counts = [greedy(w, first, rest) for w in words]
        assert (r.n_words_, r.n_unknown) == (len(words), counts.count(-1))
        assert r.n_tokens == sum(abs(c) for c in counts)
    assert wordpiece.token_counts(none, "text", starts, inside).count() == 0


# --- personal data --------------------------------------------------------------------------
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, hit):
    digits = [int(c) for c in hit if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return True


def base(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans(spark, docs, none):
    rng = random.Random(5)
    odd = ["".join(rng.choices("a1.@+-( )é0", k=60)) for _ in range(300)]
    odd += ["a@b.c_d@e.fg", "1.2.3.4.5.6.7.8", "a@b.c" * 3000, "1 " * 20_000, "999.1.1.1 001.002.003.004", "+" + "1" * 3000]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id LONG, text STRING")
    for frame in (docs.select("doc_id", "text"), made):
        texts = collections.Counter((r.doc_id, base(r.text)) for r in frame.collect())
        found = pii.spans_of(frame, "text", "doc_id").select("id", pii.as_text(F.col("base")).alias("base"))
        assert collections.Counter((r.id, r.base) for r in found.collect()) == texts
    assert pii.spans_of(none, "text", "doc_id").count() == 0


def test_bootstrapping_finds_identifiers_by_their_context(spark):
    texts = [f"please phone: +1 (377) 555-0{i:03d} today" for i in range(6)]
    texts += [f"or phone: 0049/{i}12345 soon" for i in range(3)] + ["in 0049/112345 words", "plain 123456 number", "page 777777 of"] * 2
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    found = {r.id: r.s for r in pii.spans_of(made, "text", "doc_id").select("id", pii.as_text(F.col("spans")).alias("s")).collect()}
    assert [found[i] for i in (6, 7, 8, 9, 10, 11)] == ["phone:10:21"] * 3 + ["phone:3:14", "", ""]
    assert found[0] == "phone:14:31"


# --- line dedup -----------------------------------------------------------------------------
def cut_lines(rows, window):
    seen, gone = {}, collections.defaultdict(set)
    for key, text in rows:
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if WORD.search(x)]
        for j in range(len(lines) - window + 1):
            run = tuple(x for _, x in lines[j : j + window])
            if seen.setdefault(run, (key, j)) != (key, j):
                gone[key].update(i for i, _ in lines[j : j + window])
    return {k: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]), len(gone[k])) for k, t in rows}


@pytest.mark.parametrize("window", [2, 3])
def test_line_dedup(spark, window):
    rng = random.Random(window)
    made = [(i, "\n".join(rng.choices(["a", "b", "c", "", " ", "d e"], k=rng.randint(0, 9)))) for i in range(60)]
    found = linededup.without_repeats(spark.createDataFrame(made, "doc_id LONG, text STRING"), "text", "doc_id", window)
    assert {r.doc_id: (r.text, r.n_removed) for r in found.collect()} == cut_lines(made, window)


def test_line_dedup_of_odd_rows(docs, none):
    found = linededup.without_repeats(docs, "text", "doc_id")
    assert found.columns == [*docs.columns, "n_removed"] and found.count() == docs.count()
    by = {r.doc_id: r.text for r in found.where("doc_id NOT IN (5)").collect()}
    assert by[0] is None and by[1] == "" and by[8].startswith("line three") is False and "line one" in by[7] and "line one" not in by[8]
    assert {r.text for r in found.where("doc_id = 5").collect()} >= {"another text of the same id"}
    assert linededup.without_repeats(none, "text", "doc_id").count() == 0


# --- mixing ---------------------------------------------------------------------------------
def test_mixing(spark, docs, none):
    made = [(i, "w " * (1 + i % 7), "big" if i % 10 < 7 else f"s{i % 10}") for i in range(3000)]
    frame = spark.createDataFrame(made, "doc_id LONG, text STRING, source STRING")
    tokens = collections.Counter()
    for i, t, s in made:
        tokens[s] += len(t.split())
    total = sum(tokens.values())

    found = mixing.mixed(frame, "text", "doc_id", "source", entropy=0.95, whole_corpus=True).collect()
    dealt = collections.Counter()
    for r in found:
        dealt[r.source] += len(r.text.split())
    share = [n / sum(dealt.values()) for n in dealt.values()]
    assert abs(sum(dealt.values()) - total) < 40 and abs(-sum(p * math.log(p) for p in share) / math.log(4) - 0.95) < 0.01
    copies = collections.Counter((r.doc_id, r.epoch) for r in found)
    assert max(copies.values()) == 1 and max(r["at"] for r in found) < 1

    found = mixing.mixed(frame, "text", "doc_id", "source", max_repeats=2.0).collect()
    times = collections.Counter(r.doc_id for r in found)
    assert set(times) == set(range(3000)) and set(times.values()) == {1, 2}
    assert all(times[i] == 1 for i in range(3000) if i % 10 < 7)
    assert mixing.mixed(docs, "text", "doc_id", "source", max_repeats=3.0).columns == [*docs.columns, "epoch_", "block", "at"]
    assert mixing.mixed(none, "text", "doc_id", "source", max_repeats=3.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(frame, "text", "doc_id", "source")


def test_mixing_without_a_budget_sums_up_once(spark, monkeypatch):
    asked, sums = [], mixing._sums
    monkeypatch.setattr(mixing, "_sums", lambda shares, *a: (shares is not None and asked.append(a)) or sums(shares, *a))
    made = [(i, "w " * (1 + i % 7), "big" if i % 10 < 7 else f"s{i % 10}") for i in range(300)]
    found = mixing.mixed(spark.createDataFrame(made, "doc_id LONG, text STRING, source STRING"), "text", "doc_id", "source", max_repeats=2.0)
    assert found.select("doc_id").distinct().count() == 300 and len(asked) == 1


# --- language -------------------------------------------------------------------------------
def test_language(docs, none):
    langs, logs = langid.learn(langid.training_rows(docs, "text", "lang"))
    assert langs == ["en", "fr"] and logs.shape == (langid.BUCKETS, 2)
    assert np.allclose(np.exp(logs.astype(float)).sum(axis=0), 1, atol=1e-3)
    found = langid.predict(docs, "text", langs, logs).collect()
    assert all((r.lang_pred == "und") == (not r.text or not regex.search(r"\p{L}", r.text)) for r in found)
    assert all(0 <= r.score_ <= 1 for r in found)
    assert langid.learn(langid.training_rows(none, "text", "lang"))[0] == []
    assert {r.lang_pred for r in langid.predict(docs, "text", *langid.learn(langid.training_rows(none, "text", "lang"))).collect()} == {"und"}


# --- quality --------------------------------------------------------------------------------
def measures(text):
    w = words_of(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs, none):
    trusted = docs.select("doc_id").where("doc_id IN (5, 7)")
    found = quality.judged(docs, "text", "doc_id", trusted).collect()
    for r in found:
        n, *rest = expected = measures(r.text)
        assert (r.n_words_, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert r.kept_ == (not r.base_failed and r.llr_score >= quality.THRESHOLD)
    assert quality.passing(docs, "text", "doc_id", trusted).columns == docs.columns
    assert quality.judged(none, "text", "doc_id", trusted).count() == 0
    assert {r.llr_score for r in quality.judged(docs, "text", "doc_id", none.select("doc_id")).collect()} == {0.0}
# --- BPE ------------------------------------------------------------------------------------
def test_the_driver_reads_the_vocabulary_without_the_library():
    bpe._tokenizer.cache_clear(), bpe._pieces.cache_clear()
    library = Tokenizer.from_file(PATH)
    library.no_truncation(), library.no_padding()
    definition = bpe._load(PATH)
    assert len(bpe.ranks_of(definition)) > 50_000 and bpe._tokenizer.cache_info().currsize == 0
    assert Tokenizer.from_str(definition).to_str() == library.to_str()
    assert all(library.decode([i], skip_special_tokens=False) == p.decode("utf-8", "replace") for i, p in enumerate(bpe._pieces(definition)))


def test_words_split_as_the_library_splits_every_character():
    split, library = bpe._splitter(bpe._load(PATH)), Tokenizer.from_file(PATH).pre_tokenizer
    same = re.compile(f"[{bpe.SAME}]").match
    for start in range(0, 0x110000, 4096):
        chars = [chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000]
        for part in ([c for c in chars if same(c)], [c for c in chars if not same(c)]):
            text = "".join(f"a{c}1{c} " for c in part)
            assert split(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]


@pytest.mark.parametrize("head", [bpe.HEAD, 3, 0])
def test_bpe(docs, none, head):
    library = Tokenizer.from_file(PATH)
    encoded = bpe.encode(docs, "text", PATH, head=head)
    assert encoded.columns == [*docs.columns, "ids_"]
    for r in bpe.decode(encoded, "ids_", PATH).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids_ == ids and r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(none, "text", PATH).count() == 0


# --- near-duplicates ------------------------------------------------------------------------
def sets(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    parts = [(k, sets(t)) for k, t in rows]
    for (a, s), (b, t) in itertools.combinations(parts, 2):
        if s and t and 100 * len(s & t) >= 85 * len(s | t) or a == b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def test_near_duplicates(spark, docs, none):
    rng = random.Random(9)
    made = []
    for group in range(6):
        text = [f"{group}w{rng.randint(0, 500)}" for _ in range(150)]
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(150)] = f"edit{rng.random()}"
            made.append((1000 - len(made), " ".join(copy)))
    odd = [(r[0], r[1]) for r in rows() if r[0] is not None and r[0] != 5]
    for frame, plain in ((spark.createDataFrame(made, "doc_id LONG, text STRING"), made), (docs.where("doc_id <> 5"), odd)):
        found = neardup.linked(frame, "text", "doc_id").collect()
        expected, sizes = groups(plain), {k: len(sets(t)) for k, t in plain}
        assert {r.id: r.component_id for r in found} == expected
        assert all(r.n_shingles == sizes[r.id] and r.kept == (r.id == r.component_id) for r in found)
    assert neardup.linked(docs, "text", "doc_id").count() == docs.count()
    assert neardup.linked(none, "text", "doc_id").count() == 0


def copies(rng, words, many, most):
    """Copies of a text, each with up to `most` words changed, in places and to words of its own."""
    made = []
    for _ in range(many):
        copy = list(words)
        for at in rng.sample(range(len(words)), rng.randint(0, most)):
            copy[at] = f"own{rng.random()}"
        made.append(copy)
    return made


def test_a_large_group_of_near_copies_is_not_expanded_into_pairs(spark, monkeypatch):
    rng, compared, sketches_agree = random.Random(5), [], neardup._agreeing
    text = [f"w{rng.randint(0, 900)}" for _ in range(150)]
    made = [(i, " ".join(t)) for i, t in enumerate(copies(rng, text, 600, 9))]
    monkeypatch.setattr(neardup, "_agreeing", lambda pairs, *more: compared.append(pairs.count()) or sketches_agree(pairs, *more))
    found = neardup.linked(spark.createDataFrame(made, "doc_id LONG, text STRING"), "text", "doc_id").collect()
    assert {r.id: r.component_id for r in found} == groups(made) and len({r.component_id for r in found}) > 100
    assert sum(compared) < 20 * len(made)


def test_near_duplicates_write_few_tables(spark, monkeypatch):
    rng, written, save = random.Random(6), [], neardup.saved
    monkeypatch.setattr(neardup, "saved", lambda df, label: written.append(label) or save(df, label))
    order = rng.sample(range(200), 200)
    chain = spark.createDataFrame(list(itertools.pairwise(order)), "a LONG, b LONG")
    assert {(r.node, r.root) for r in neardup.components(chain).collect()} == {(k, 0) for k in range(200)}
    # Three tables a round and the edges; none for putting rounds together.
    rounds = (len(written) - 1) // 3
    assert rounds > 1 and written == ["edges", *["pointers", "pointers", "edges"] * rounds]
    assert neardup.components(chain.where("a = b")) is None
    # The pairs of bucket members are no more than the members: they are confirmed in one go.
    written.clear()
    text = [f"w{rng.randint(0, 900)}" for _ in range(150)]
    made = [(i, " ".join(t)) for i, t in enumerate(copies(rng, text, 100, 9))]
    found = neardup.linked(spark.createDataFrame(made, "doc_id LONG, text STRING"), "text", "doc_id").collect()
    assert {r.id: r.component_id for r in found} == groups(made)
    assert written.index("judged") < written.index("differences") and written[: written.index("differences")].count("judged") == 1


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_links_between_members_far_from_the_centre(spark, percent):
    rng = random.Random(percent)
    text = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    made = copies(rng, text, 60, 8)
    for k in range(3):  # centres beside the first one, with copies, longer and shorter texts around them
        other = copies(rng, text, 1, 12)[0] + [f"tail{k}x{i}" for i in range(10 * k)]
        made += copies(rng, other, 30, 6) + [t + [f"end{rng.random()}"] * rng.randint(1, 20) for t in copies(rng, other, 10, 3)]
        made += [t[rng.randint(1, 12) :] for t in copies(rng, other, 10, 3)]
    for base in list(made[50:60]):
        made += copies(rng, base, 4, 3)
    rng.shuffle(made)
    made = [(i, " ".join(t)) for i, t in enumerate(made)]
    found = neardup.linked(spark.createDataFrame(made, "doc_id LONG, text STRING"), "text", "doc_id", percent).collect()
    parts, component = [sets(t) for _, t in made], list(range(len(made)))
    for a, b in itertools.combinations(range(len(made)), 2):
        if 100 * len(parts[a] & parts[b]) >= percent * len(parts[a] | parts[b]):
            x, y = sorted((component[a], component[b]))
            component = [x if c == y else c for c in component]
    assert {r.id: r.component_id for r in found} == dict(enumerate(component))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for size in (3, 50, 3000):
        union = rng.integers(0, 2**63, size * 2, dtype=np.uint64)
        a, b = union[: size + size // 2], union[size // 2 :]
        both = neardup.sketch(a, 4000) == neardup.sketch(b, 4000)
        assert abs(both.mean() - (size - (size // 2 - size // 2)) / (2 * size)) < 0.05 or size == 3


# --- sharding -------------------------------------------------------------------------------
def test_sharding(spark, docs, none):
    keys = spark.range(4000).withColumn("text", F.lit("x"))
    eight, nine = sharding.shard_of(F.col("id"), (1.0,) * 8), sharding.shard_of(F.col("id"), (1.0,) * 9)
    moved = keys.select(eight.alias("a"), nine.alias("b")).where("a <> b").collect()
    assert {r.b for r in moved} == {8} and 300 < len(moved) < 600
    heavy = sharding.with_shards(keys, "id", (3.0, 1.0)).where("shard = 0").count()
    assert 2850 < heavy < 3150
    placed = sharding.with_shards(docs, "doc_id", (1.0, 1.0, 1.0)).withColumn("order", F.md5(F.coalesce("text", F.lit(""))))
    slots = collections.defaultdict(list)
    for r in sharding.with_slots(placed, "shard", "order").collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == docs.count()
    assert sharding.with_slots(none.withColumn("order", F.md5("text")).withColumn("shard", F.lit(0)), "shard", "order").count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), ())


# --- fingerprints ---------------------------------------------------------------------------
def test_fingerprints(spark, docs, none):
    rng = random.Random(4)
    made = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(0, 120)))) for i in range(1100) if i % 3]
    found = {r.id: r for r in cws.fingerprints(spark.createDataFrame(made, "doc_id LONG, text STRING"), "text", "doc_id").collect()}
    errors = []
    for (i, text), (_, following) in zip(made, made[1:] + made[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.next_signature == found[made[(made.index((i, text)) + 1) % len(made)][0]].signature
        a, b = collections.Counter(text.split()), collections.Counter(edited.split())
        if a and b:
            errors.append(np.mean([x == y for x, y in zip(r.signature, r.edited_signature)]) - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.11
    odd = cws.fingerprints(docs, "text", "doc_id").collect()
    assert len(odd) == docs.count() and len({tuple(r.signature) for r in odd if r.n_chars == 0}) == 1
    assert cws.fingerprints(none, "text", "doc_id").count() == 0
