"""Periodic runs, the Merkle manifest and near duplicates among embeddings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.llm.catalog import queries
from caudal.llm.embedding_dedup import codes_of, near_embeddings
from caudal.llm.merkle import leaf_digest, manifest
from caudal.llm.periodic_runs import COVER, PERIOD, STEPS, CoveredSuffixes, periodic_runs, runs_of
from tests.llm.brute import WORD

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- periodic runs

def plain_runs(words):
    """[(start, length, period)] by trying every period on every place."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                length = i - start + q
                if length >= max(6, 4 * q):
                    found.setdefault((start, length), q)
                start = i + 1
    return sorted(((s, n_, q) for (s, n_), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_the_cover_meets_every_difference():
    assert {(int(a) - int(b)) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    covered = set(COVER.tolist())
    for i in range(PERIOD):
        for d in range(PERIOD):
            step = int(STEPS[i, d])
            assert (i + step) % PERIOD in covered and (i + d + step) % PERIOD in covered


def test_common_prefixes_of_covered_places():
    rng = random.Random(3)
    for size, letters in ((93, 1), (310, 2), (620, 3)):
        words = np.array([rng.randrange(letters) for _ in range(size)])
        words[-rng.randrange(1, 20):] = -5
        ends = words == -5
        words[ends] = -5 - np.arange(ends.sum())
        index = CoveredSuffixes(words)
        places = [p for p in range(size) if p % PERIOD in set(COVER.tolist())]
        pairs = [(a, b) for a in places for b in places if a != b]
        for (a, b), got in zip(pairs, index.common(*np.array(pairs).T), strict=True):
            want = 0
            while max(a, b) + want < size and words[a + want] == words[b + want]:
                want += 1
            assert got == want


def test_runs_of_random_texts():
    rng = random.Random(11)
    texts = [[]]
    for _ in range(400):
        letters = rng.choice((1, 2, 2, 3, 6))
        text = [rng.randrange(letters) for _ in range(rng.choice((1, 5, 6, 7, 30, 90, 200)))]
        for _ in range(rng.randrange(3)):
            unit = [rng.randrange(letters + 1) for _ in range(rng.choice((1, 2, 3, 7, 31, 40)))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = (unit * rng.randrange(3, 9))[:rng.randrange(1, 300)]
        texts.append(text)
    got = defaultdict(list)
    sizes = np.array([len(t) for t in texts])
    for text, *run in runs_of(sizes, np.array([w for t in texts for w in t])).tolist():
        got[text].append(tuple(run))
    for i, text in enumerate(texts):
        assert got[i] == plain_runs(text), text


def tailed(doc_id, text):
    """The query's words of a text."""
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def run_row(doc_id, text):
    words = tailed(doc_id, text)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return (
        doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(collapsed(words, runs)),
    )


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_run_query_matches_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries()["op11_periodic_runs"](spark, SMALL)
    assert got.columns == list(RUN_COLUMNS)
    short = {d: t for d, t in docs if len(t or "") < 30_000}
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(rows) == len(docs)
    assert {d: rows[d] for d in short} == {d: run_row(d, t) for d, t in short.items()}
    assert any(r[1] for r in rows.values())


def test_run_edges(spark):
    texts = [None, "", " \n\t ", "a", "a a a a a", "a  a\ta\na a a", "b " + "x y " * 4, "    " * 9, "é e " * 3,
             "x " * 60_000, "p q r s " * 9_000 + "end", " ".join(str(i) for i in range(70_000))]
    rows = [(i, t, "left out") for i, t in enumerate(texts)] + [(3, "a", "again"), (None, "c " * 8, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = defaultdict(list)
    for r in periodic_runs(docs).collect():
        got[r["doc_id"]].append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert len(got[3]) == 2
    want = {
        4: ([], "a a a a a"), 5: ([(0, 6, 1)], "a"), 6: ([(1, 8, 2)], "b x y"), 7: ([(0, 18, 1)], " "), 8: ([], "é e é e é e"),
        9: ([(0, 60_000, 1)], "x"), 10: ([(0, 36_000, 4)], "p q r s end"), None: ([(0, 8, 1)], "c"),
    }
    for i, answer in want.items():
        assert got[i] == [answer], i
    for i in (0, 1, 2):
        assert got[i] == [([], "")]
    assert got[11] == [([], texts[11])]
    assert periodic_runs(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- Merkle manifest

def plain_manifest(rows):
    """{(id, leaf): [(subroot, root, proof, folded)]} of rows (id, group, leaf, changed)."""
    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def siblings(levels, i):
        steps = []
        for level in levels[:-1]:
            lo = i // 8 * 8
            steps.append((level[lo:i], level[i + 1:lo + 8]))
            i //= 8
        return steps

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = up([r[2] for r in groups[g]])
    top = up([trees[g][-1][0] for g in order])
    out = defaultdict(list)
    for at, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            steps = siblings(trees[g], i) + siblings(top, at)
            node = row[3] or row[2]
            for left, right in steps:
                node = sha("".join(left) + node + "".join(right))
            proof = sha("".join("".join(x + y) for x, y in steps))
            out[row[0], row[2]].append((trees[g][-1][0], top[-1][0], proof, node))
    return out


def folded(made):
    out = defaultdict(list)
    for r in made.collect():
        out[r["key"], r["leaf"]].append((r["subroot"], r["root"], r["proof_sha256"], r["path"][-1]))
    return out


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_of_many_shapes(spark, height):
    """Lower blocks make the same trees in more stages."""
    sizes = {None: 3, "": 1, "a": 8, "B": 9, "é": 65, "z": 700, "zz": 64, "ab": 1, "y": 17}
    rows, key = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            key += 7
            rows.append((key * 37 % 10_007, g, sha(f"{key}"), sha(f"{key}!") if key % 3 == 0 else None))
    rows += [(5, "a", sha("t"), None), (5, "a", sha("t"), sha("u")), (5, "a", sha("s"), sha("s")), (None, "a", sha("n"), sha("m"))]
    data = spark.createDataFrame(
        [(k, g, n, c, "x") for k, g, n, c in rows], "key long, grp string, lf string, ch string, place string"
    )
    made = manifest(data, id_col="key", group_col="grp", leaf=F.col("lf"), changed=F.col("ch"), height=height)
    got, want = folded(made), plain_manifest(rows)
    # Equal rows differ in what became of them only; which of them comes first is open.
    twins = (5, sha("t"))
    assert {k: v for k, v in got.items() if k != twins} == {k: v for k, v in want.items() if k != twins}
    assert len(got[twins]) == 2


def test_versions_copy_their_path_only(spark):
    rows = [(i, "a", sha(str(i)), sha(f"{i}!") if i in (4, 90) else None) for i in range(100)]
    data = spark.createDataFrame(rows, "key long, grp string, lf string, ch string")
    made = manifest(data, id_col="key", group_col="grp", leaf=F.col("lf"), changed=F.col("ch")).collect()
    # 100 leaves, 13 and 2 nodes, the root.
    assert {r["key"]: len(r["path"]) for r in made if len(r["path"]) > 1} == {4: 4, 90: 4}
    assert len({r["root"] for r in made}) == 1
    changed = {r["key"]: r["path"] for r in made if r["key"] in (4, 90)}
    assert not set(changed[4]) & set(changed[90])


def test_manifest_edges(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf string"
    one = spark.createDataFrame([(7, None, None, None, "", "x")], schema)
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    made = manifest(one, id_col="doc_id", group_col="lang", leaf=leaf_digest(*cols), changed=F.lit(None).cast("string"))
    leaf = sha("1:7---0:")
    assert [tuple(r) for r in made.collect()] == [(7, leaf, leaf, leaf, sha(""), [leaf])]
    none = manifest(one.limit(0), id_col="doc_id", group_col="lang", leaf=leaf_digest(*cols), changed=F.lit(None).cast("string"))
    assert none.count() == 0
    accents = one.select(leaf_digest(F.lit("é"), F.lit(None).cast("string"), F.lit("x" * 300_000)).alias("d")).first()["d"]
    assert accents == sha("2:é-300000:" + "x" * 300_000)


# ---------------------------------------------------------------- embeddings

def plain_links(rows, cosine):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root = {i: i for i, _ in rows}
    counts = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(good)
    for at, a in enumerate(ids):
        for b in ids[at + 1:]:
            u, v = good[a], good[b]
            if len(u) == len(v) and float(u @ v) / float(np.linalg.norm(u) * np.linalg.norm(v)) >= cosine:
                counts[a] += 1
                counts[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (counts[i], find(i), find(i) == i) for i in root}


def clustered(rng, groups, each, length=64, noise=0.3):
    rows = []
    for _ in range(groups):
        centre = rng.standard_normal(length)
        rows += [centre + noise * rng.standard_normal(length) * rng.random() for _ in range(each)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def test_pairs_at_the_threshold_share_a_code():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    def shared(cosine):
        x, y = codes_of(a), codes_of(cosine * a + np.sqrt(1 - cosine * cosine) * b)
        return (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean()
    assert shared(0.9) >= 0.999
    assert shared(0.0) <= 0.02
    # A vector's codes do not depend on the others in its batch.
    assert (codes_of(a)[5:9] == codes_of(a[5:9])).all()


@pytest.mark.parametrize("slice_size", [2048, 16])
def test_near_embeddings_match_all_pairs(spark, slice_size):
    rows = clustered(np.random.default_rng(2), 30, 25)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_embeddings(df, slice_size=slice_size).collect()}
    want = plain_links(rows, 0.9)
    wrong = [i for i in want if got[i] != want[i]]
    assert sum(w[0] for w in want.values()) > 1000
    assert len(wrong) <= 2 and all(got[i][0] <= want[i][0] for i in want)


def test_near_embeddings_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0])]
    rows += [(i, [1.0, 2.0]) for i in range(10, 400)] + [(9, [2.0, 4.0]), (8, [-1.0, -2.0]), (7, [1.0, 2.0, 0.0]), (400, [5.0])]
    # 0.9 exactly, and just below.
    rows += [(500, [0.0, 10.0, 0.0, 0.0]), (501, [0.0, 9.0, 19.0 ** 0.5, 0.0]), (502, [0.0, 8.99, 19.2 ** 0.5, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[-5:]], "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_embeddings(df).collect()}
    want = plain_links(rows, 0.9)
    assert got[10] == (390, 9, False) and got[9] == (390, 9, True) and got[1] == (0, 1, True)
    assert got == want
    assert near_embeddings(df.limit(0)).count() == 0
    # Several vectors of one id are rows of one node.
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (None, [1.0, 0.0])], df.schema[:2])
    rows = sorted((tuple(r) for r in near_embeddings(odd).collect()), key=lambda r: (r[0] or 0, r))
    assert rows == [(None, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
