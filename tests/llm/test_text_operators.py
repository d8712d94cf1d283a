"""Language ID, exact and near duplicates, personal data, packing: brute force and edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from caudal.llm import exact_dedup, graph, language_id, minhash_dedup, packing, pii
from caudal.llm.catalog import queries
from caudal.llm.common import stored
from caudal.llm.exact_dedup import exact_duplicates
from caudal.llm.graph import components
from caudal.llm.minhash_dedup import near_duplicates
from caudal.llm.packing import pack
from tests.llm import brute

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that clash with names the operators use inside.
CLASHING = (
    "doc_id long, text string, lang string, score double, digest string, node long, value long, "
    "part int, row long, ids binary, added string, lang_pred string, n_email long, kept boolean"
)


def docs_of(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


def edge_texts() -> list[tuple]:
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "one two three"),
        (7, "a b c d e f g h i j"), (8, "a b c d e f g h i j"), (9, "A  b\tc d e\nf g h i j"),
        (10, "x" * 300_000), (11, "word " * 400_000), (12, "123 456 ... !!"),
        (13, "é ü ñ 漢字     😀 😀"), (14, "a\x1cb \x85 ć İ Σ ς"),
    ]


def frame(spark, texts):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in texts], DOCS)


def tuples(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


# ---------------------------------------------------------------- exact duplicates

EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_matches_brute_force(spark):
    found = tuples(queries()["op4_exact_dedup"](spark, MIDDLE), *EXACT)
    assert found == sorted(brute.exact_rows(docs_of(spark, MIDDLE)), key=repr)


def test_exact_edges(spark):
    texts = edge_texts()
    assert tuples(exact_duplicates(frame(spark, texts)), *EXACT) == sorted(brute.exact_rows(texts), key=repr)


def test_state_grows_over_many_batches(spark):
    """One file a batch: what an earlier batch saw still counts."""
    texts = [(i, f"text {i % 9}" + " " * (i % 4)) for i in range(80)]
    sha = lambda c: F.sha2(c, 256)
    prints = stored(exact_dedup.fingerprints(frame(spark, texts).repartition(6), "doc_id", "text", sha), "prints")
    names = ("digest", "keep_id", "keep_points", "group_size")
    many = exact_dedup.keyed_state(prints, batch_bytes=1)
    assert tuples(many, *names) == tuples(exact_dedup._groups(prints, "digest"), *names)
    assert many.filter("keep_locator IS NULL").count() == 0


def test_exact_when_digests_clash(spark):
    texts = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)]
    weak = exact_duplicates(frame(spark, texts), digest=lambda c: F.substring(F.sha2(c, 256), 1, 0))
    assert tuples(weak, *EXACT) == sorted(brute.exact_rows(texts), key=repr)


def test_exact_repeats_and_missing_ids(spark):
    texts = [(1, "a b"), (1, "a b"), (None, "a b"), (None, "ab"), (2, "ab"), (None, "z"), (None, "z")]
    rows = exact_duplicates(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    stays = [(r["doc_id"], r["group_size"]) for r in rows if r["kept"]]
    assert sorted(stays, key=repr) == sorted([(1, 5), (None, 2)], key=repr)


@pytest.mark.parametrize("operator", [
    exact_duplicates, near_duplicates, pii.find_personal_data,
    lambda d: pack(d, public_tokenizers.path(packing.WORD_BPE)),
    lambda d: language_id.identify(d, language_id.train(d)),
])
def test_empty_tables_and_clashing_columns(spark, operator):
    assert operator(spark.createDataFrame([], CLASHING)).count() == 0
    row = (1, "some words here", "en", 0.5, "d", 2, 3, 4, 5, b"x", "a", "xx", 9, True)
    assert operator(spark.createDataFrame([row], CLASHING)).count() == 1
    none = tuple(None for _ in row)
    assert operator(spark.createDataFrame([row, none, none], CLASHING)).count() == 3


# ---------------------------------------------------------------- near duplicates

NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_matches_brute_force(spark):
    found = tuples(queries()["op6_minhash_dedup"](spark, MIDDLE), *NEAR)
    assert found == sorted(brute.near_duplicate_rows(docs_of(spark, MIDDLE), 4, 80), key=repr)


def test_near_edges(spark):
    texts = [t for t in edge_texts() if t[0] != 11] + [(11, "word " * 50)]
    found = tuples(near_duplicates(frame(spark, texts), words=4), *NEAR)
    assert found == sorted(brute.near_duplicate_rows(texts, 4, 80), key=repr)


def test_near_chains_and_shared_passages(spark, monkeypatch):
    """Groups whose members drift apart, and a passage that unlike documents share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 40, 150, 400]))]
        for _ in range(15):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                base[rng.randrange(len(base))] = word()
    texts += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]) for _ in range(60)]
    rng.shuffle(texts)
    numbered = list(enumerate(texts))
    expected = sorted(brute.near_duplicate_rows(numbered, 4, 80), key=repr)
    # Lists of one task, and lists cut into slices.
    for slice_ in (minhash_dedup.SLICE, 3):
        monkeypatch.setattr(minhash_dedup, "SLICE", slice_)
        assert tuples(near_duplicates(frame(spark, numbered), words=4), *NEAR) == expected


def test_no_list_is_one_task(spark, monkeypatch):
    """300 near copies of a text, in slices of 20: the pivot's pairs lie in many slices."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"x{i}"
        texts.append((i, " ".join(copy)))
    monkeypatch.setattr(minhash_dedup, "SLICE", 20)
    kept = []
    plain = minhash_dedup.confirmed
    monkeypatch.setattr(minhash_dedup, "confirmed", lambda pairs, *a: kept.append(pairs) or plain(pairs, *a))
    found = tuples(near_duplicates(frame(spark, texts), words=4), *NEAR)
    assert {r[2] for r in found} == {0}
    largest = kept[0].groupBy("pivot", "slice").count().agg(F.max("count"), F.sum("count")).first()
    assert largest[1] >= 150 and largest[0] <= 60


def test_near_missing_and_repeated_ids(spark):
    one, two = "a b c d e f g h i j k", "l m n o p q r s t u v"
    rows = [(None, one), (None, one), (5, one), (5, two), (3, two), (9, one), (9, one)]
    found = near_duplicates(frame(spark, rows), words=4).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in found), key=repr) == sorted([
        (None, None, True), (None, None, True), (5, 3, False), (5, 3, False), (3, 3, True),
        (9, 3, False), (9, 3, False),
    ], key=repr)


def test_needed_values_hold_for_all_small_sets():
    """Complete sketches: sets of n with similarity 0.8 share at least this much."""
    for n in range(1, 60):
        least = min(
            common for m in range(1, 90) for common in range(1, min(n, m) + 1)
            if 100 * common >= 80 * (n + m - common)
        )
        assert least >= -(-n * 80 // 100)


@pytest.mark.parametrize("split_hubs", [False, True])
def test_components(spark, split_hubs, monkeypatch):
    monkeypatch.setattr(graph, "SLICE", 10)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    edges += [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 80)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), split_hubs=split_hubs).collect()}
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# ---------------------------------------------------------------- language

@pytest.mark.parametrize("slice_", [4, 512])
def test_merged_equals_components_of_all_links(spark, slice_, monkeypatch):
    monkeypatch.setattr(graph, "SLICE", slice_)
    rng = random.Random(4)
    edges = lambda n: [tuple(sorted(rng.sample(range(200), 2))) for _ in range(n)]
    early = spark.createDataFrame(edges(60) + [(300, 300 + i) for i in range(1, 30)], "a long, b long")
    # A hub, a bridge between components, and nodes that had no link yet.
    late = spark.createDataFrame(edges(40) + [(1, 300 + i) for i in range(20)] + [(500, 501), (501, 502)], "a long, b long")
    found = minhash_dedup.merged(components(early, split_hubs=True), late)
    assert sorted(found.collect()) == sorted(components(early.unionByName(late)).collect())


def test_a_small_graph_takes_few_tables(spark, monkeypatch):
    """Nothing to deal, and no link left after the pivots: the driver plans one run of components."""
    made = []
    for module in (graph, minhash_dedup):
        monkeypatch.setattr(module, "stored", lambda df, name: made.append(name) or stored(df, name))
    text = " ".join(f"w{i}" for i in range(50))
    found = near_duplicates(frame(spark, [(1, text), (2, text + " x"), (3, "other words only here")]), words=4)
    assert tuples(found, "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]
    assert made.count("edges") == 1 and "labels-taken" not in made


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    found = queries()["op3_language_id"](spark, MIDDLE).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_language_never_reads_ids_or_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs)
    plain = language_id.identify(docs.select("doc_id", "text"), model)
    moved = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"))
    other = language_id.identify(moved, model)
    assert tuples(plain, "text", "lang_pred", "score") == tuples(other, "text", "lang_pred", "score")


def test_language_edges(spark):
    docs = frame(spark, edge_texts())
    model = language_id.fit(["the cat and the dog", "le chat et le chien"] * 3, ["en", "fr"] * 3)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert {d for d, (lang, _) in got.items() if lang == "und"} == {1, 2, 3, 12}
    assert all(0 <= s <= 1 for _, s in got.values())
    nobody = language_id.identify(docs, language_id.fit([], []))
    assert {r["lang_pred"] for r in nobody.collect()} == {"und"}


def plain_kernel_scores(train, texts, landmarks):
    """Blended-spectrum presence kernel over sets of n-grams, Nystrom, weighted ridge regression."""
    def grams(text):
        clean = "".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in text.lower())
        clean = re.sub(" +", " ", clean)
        return {clean[i:i + n] for n in (1, 2, 3, 4) for i in range(len(clean) - n + 1)}

    kernel = lambda xs, ys: np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in ys] for x in xs])
    labels = [lang for lang, _ in train]
    languages = sorted(set(labels))
    sets = [grams(text) for _, text in train]
    marks = [sets[i] for name in languages for i in [j for j, x in enumerate(labels) if x == name][:landmarks]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel(sets, marks) @ root
    target = np.array([[1.0 if x == name else -1.0 for name in languages] for x in labels])
    weight = np.array([len(labels) / len(languages) / labels.count(x) for x in labels])[:, None]
    left = features.T @ (features * weight) + language_id.RIDGE * len(labels) * np.eye(features.shape[1])
    solved = np.linalg.solve(left, features.T @ (target * weight))
    return languages, kernel([grams(t) for t in texts], marks) @ root @ solved


def test_language_equals_a_plain_kernel(spark):
    """The operator's hashed n-grams against sets of the n-grams themselves."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held_out = language_id.held_out_fold(F.col("doc_id"))
    train = language_id.training_sample(
        docs, held_out, id_col="doc_id", text_col="text", lang_col="lang", per_language=30
    )
    texts = [r[0] for r in docs.filter(held_out & F.col("text").rlike("[a-z]")).select("text").limit(40).collect()]
    texts = [t for t in texts if len(t) <= language_id.BLOCK]
    languages, expected = plain_kernel_scores(train, texts, language_id.LANDMARKS_PER_LANGUAGE)
    model = language_id.fit([text for _, text in train], [lang for lang, _ in train])
    found = model.scores(texts)
    assert model.languages == languages
    assert np.abs(found - expected).max() < 0.1
    clear = np.sort(expected, 1)[:, -1] - np.sort(expected, 1)[:, -2] > 0.2
    assert clear.mean() > 0.8
    assert (found.argmax(1) == expected.argmax(1))[clear].all()


def test_language_of_texts_of_many_blocks(spark):
    """Two megabytes of one language among a few lines of another; and a bounded sample."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs)
    of = {r["lang"]: r["text"] for r in docs.filter("lang IS NOT NULL AND length(text) > 300").select("lang", "text").collect()}
    languages = sorted(of)
    long = [(i, of[languages[i + 1]] + of[languages[i]] * (2_000_000 // len(of[languages[i]]))) for i in range(2)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame(spark, long), model).collect()}
    assert got == {i: languages[i] for i in range(2)}
    rows = [(1, "a" * 100_000, "x"), (1, "b c", "y"), (2, "d e", "x"), (3, "f", "z")]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(
        few, F.lit(False), id_col="doc_id", text_col="text", lang_col="lang", per_language=5, languages=2
    )
    assert sorted((lang, len(text)) for lang, text in sample) in (
        [("x", 3), ("x", language_id.BLOCK), ("y", 3)], [("x", 3), ("x", 100_000 % language_id.BLOCK), ("y", 3)]
    )


# ---------------------------------------------------------------- personal data

def test_pii_base_matches_brute_force(spark):
    texts = docs_of(spark, MIDDLE)
    expected = []
    for d, t in texts:
        spans = brute.base_spans(t)
        key = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = collections.Counter(k for k, _, _ in spans)
        expected.append((d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(key.encode()).hexdigest()))
    names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert tuples(queries()["op7_pii"](spark, MIDDLE), *names) == sorted(expected, key=repr)


def test_pii_base_on_nasty_texts():
    rng = random.Random(11)
    alphabet = "ab.%+-@@..  01234567890123()é\n"
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert pii.base_spans(text) == brute.base_spans(text), repr(text)
    for text in ("a@b.c@d.e", "1.2.3.4.5", "256.1.1.1", "+1 (171) 555-2028", "4491 3826 4108 8554", "٣@x.y", "0001.2.3.4"):
        assert pii.base_spans(text) == brute.base_spans(text), text


def test_pii_patterns_discover_identifiers(spark):
    seeds = [(i, f"please call phone number +1 (171) 555-{2000 + i} now thanks") for i in range(20)]
    unseen = [(100, "please call phone number 0171-5559999 now thanks"), (101, "build 20240101-77 of release")]
    found = {r["doc_id"]: r["all_spans"] for r in pii.find_personal_data(frame(spark, seeds + unseen)).collect()}
    text = dict(unseen)[100]
    assert [(s["kind"], text[s["start"]:s["end"]]) for s in found[100]] == [("phone", "0171-5559999")]
    assert found[101] == []


@pytest.mark.parametrize("kind, seed, unseen", [
    ("email", lambda i: f"user{i}@mail.example.org", ["max@intranet", "mueller@exämple.de"]),
    ("ip", lambda i: f"10.0.7.{i}", ["2001:db8::1", "::1", "fe80::a:b"]),
    ("card", lambda i: ("4111 1111 1111 1111", "5500 0000 0000 0004", "4012888888881881", "5105-1051-0510-5100", "6011 1111 1111 1117", "4222222222222220")[i % 6],
     ["4111 1111 1111 1112"]),
    ("phone", lambda i: f"+1 171 555-{2000 + i}", ["030 123 45 67", "555 123 4567", "(555) 123-4567", "555.123.4567", "tel:0171-5559999"]),
])
def test_pii_discovers_unseen_forms_of_each_kind(spark, kind, seed, unseen):
    rows = [(i, f"please note contact entry {seed(i)} kept here today") for i in range(40)]
    rows += [(100 + i, f"please note contact entry {x} kept here today") for i, x in enumerate(unseen)]
    found = {r["doc_id"]: r["all_spans"] for r in pii.find_personal_data(frame(spark, rows)).collect()}
    for i, x in enumerate(unseen):
        text = rows[40 + i][1]
        assert [(s["kind"], text[s["start"]:s["end"]]) for s in found[100 + i]] == [(kind, x.removeprefix("tel:"))]


def test_pii_redaction(spark):
    rows = [(1, "a x@y.zz b +1 (171) 555-2028"), (2, None), (3, "nothing"), (4, "é 1.2.3.4")]
    found = pii.find_personal_data(frame(spark, rows)).withColumn("out", pii.redacted(F.col("text"), F.col("all_spans")))
    assert {r["doc_id"]: r["out"] for r in found.collect()} == {
        1: "a [EMAIL] b [PHONE]", 2: None, 3: "nothing", 4: "é [IP]"}


# ---------------------------------------------------------------- packing

def check_packing(spark, texts, rows, window=packing.WINDOW_TOKENS):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.WORD_BPE))
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[doc_id], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids)
        at = 0
        for r in own:
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == brute.ids_crc(ids[at:at + r["length"]])
            at += r["length"]
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    last = max(filled)
    for sequence, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (sequence == last and at <= window)


def test_packing_sample(spark):
    check_packing(spark, docs_of(spark, SMALL), queries()["op10_packing"](spark, SMALL).collect())


def test_packing_edges(spark):
    texts = [t for t in edge_texts() if t[0] != 10] + [(20, "<|endoftext|>x <|startoftext|>"), (21, "don't won't 12 3a")]
    rows = pack(frame(spark, texts).repartition(3), public_tokenizers.path(packing.WORD_BPE), window=64).collect()
    check_packing(spark, texts, rows, window=64)
