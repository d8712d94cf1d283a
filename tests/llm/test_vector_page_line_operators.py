"""Neighbours, URL filters, main text, SentencePiece, lines and the pipeline."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caudal.llm import sentencepieces
from caudal.llm.catalog import URL_RULES, oracle_sql, queries
from caudal.llm.html_text import (
    _number, extract_main_text, main_text, node_features, parse, parsed_pages, same_article, style_tree,
)
from caudal.llm import line_dedup
from caudal.llm.line_dedup import STEPS, near_equal_lines, within_edits
from caudal.llm.nearest import nearest_neighbours
from caudal.llm.url_filter import judge_urls, personalised_rank
from tests.llm import brute

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---------------------------------------------------------------- neighbours

def exact_neighbours(rows, asks, k):
    """{query id: [(distance, id), ...]} over usable rows of one length."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if asks(q):
            near = sorted((float(np.sqrt(((u - v) ** 2).sum())), i) for i, u in good if i != q and len(u) == len(v))
            out[q] = near[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").select("vec_id", "embedding").collect()]
    expected = exact_neighbours(rows, lambda i: i % 100 == 0, 10)
    vectors = {i: np.array(v, float) for i, v in rows}
    found = collections.defaultdict(list)
    for r in queries()["op1_nearest"](spark, MIDDLE).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        gap = vectors[r["vec_id"]] - vectors[r["query_id"]]
        assert r["score"] == pytest.approx(float(np.sqrt((gap * gap).sum())), abs=1e-12)
    assert set(found) == set(expected)
    for q, got in found.items():
        assert [rank for rank, _, _ in sorted(got)] == list(range(1, 11))
    hits = sum(len({i for _, i in expected[q]} & {i for _, i, _ in found[q]}) for q in expected)
    assert hits / sum(map(len, expected.values())) >= 0.9


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 300, 10)]
    rows += [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(7, [1.0, 2.5]), (8, [5.0, 5.0]), (8, [5.0, 5.0]), (9, [1.0, 2.0, 3.0]), (100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected = exact_neighbours([r for r in set((i, tuple(v) if v else None) for i, v in rows) if r[0] is not None], lambda i: i % 100 == 0, 10)
    for sizes in ({}, {"segment": 7, "block": 1}):
        found = collections.defaultdict(list)
        for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0, **sizes).collect():
            found[r["query_id"]].append((r["rank"], r["vec_id"]))
        got = {q: [i for _, i in sorted(x)] for q, x in found.items()}
        assert got == {q: [i for _, i in x] for q, x in expected.items()}
    few = nearest_neighbours(df.filter("vec_id IN (0, 7)"), F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 7)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


# ---------------------------------------------------------------- URLs

def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def rule_of(host, path):
    fits = []
    for rule, verdict in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_urls_match_the_rules(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    rows = queries()["op2_url_filter"](spark, MIDDLE).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = split_url(pages[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_urls_match_sql_where_hosts_link(spark):
    """Verdicts of the ranks against the SQL check, on a web with cycles and both kinds of seeds."""
    import duckdb

    rng = random.Random(12)
    hosts = [f"h{i}.net" for i in range(40)] + [f"g{i}.org" for i in range(3)] + [f"b{i}.com" for i in range(3)]
    rows = []
    for i, host in enumerate(hosts * 2):
        to = "".join(f'<a href="//{rng.choice(hosts)}/">' for _ in range(rng.randrange(4)))
        rows.append((i, f"http://{host}/{'de/' if host.startswith('b') else ''}p{i}", to))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    found = judge_urls(pages, rules).drop("trust", "distrust")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    answer = con.execute(oracle_sql()["op2_url_filter"])
    names = [d[0] for d in answer.description]
    expected = sorted(answer.fetchall())
    assert sorted(tuple(r) for r in found.select(names).collect()) == expected
    assert {r[names.index("verdict")] for r in expected if r[names.index("method")] == "links"} == {"allow", "block"}


def test_urls_edges_and_links(spark):
    to = lambda *hosts: " ".join(f'<a HREF="https://{h}/x">' for h in hosts) + '<a href="/own">'
    rows = [
        (1, "https://good.org/a?b#c", to("friend.net", "FRIEND.net")), (2, "http://bad.com/de/1", None),
        (3, "http://farm.net/", to("bad.com", "bad.com")), (4, "x://friend.net#f", to("other.net")),
        (5, "http://other.net?q", ""), (6, None, "<p>"), (7, "no scheme", ""), (8, "", ""), (None, "http://alone.net/y", ""),
        (9, "HTTP://WWW.Example.ORG/es/x", ""), (9, "HTTP://WWW.Example.ORG/es/x", ""), (10, "http://example.org/en/12", ""),
        (11, "http://notexample.org/es/", ""), (12, "http://example.org", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    got = {r["page_id"]: r for r in judge_urls(pages, rules).collect()}
    verdicts = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()}
    assert verdicts == {
        1: ("good.org", "/a", "org/", "allow"), 2: ("bad.com", "/de/1", "com/de/", "block"),
        3: ("farm.net", "/", None, "block"), 4: ("friend.net", "", None, "allow"), 5: ("other.net", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), None: ("alone.net", "/y", None, "allow"),
        9: ("www.example.org", "/es/x", "example.org/es/", "block"), 10: ("example.org", "/en/12", "example.org/en/1", "block"),
        11: ("notexample.org", "/es/", "org/", "allow"), 12: ("example.org", "", None, "block"),
    }
    assert got[4]["trust"] > got[5]["trust"] > 0
    assert judge_urls(pages, rules).count() == len(rows)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert judge_urls(pages, rules.limit(0)).filter("verdict <> 'allow'").count() == 0


def test_rank_matches_power_iteration(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(12), rng.randrange(12)): rng.randint(1, 4) for _ in range(30)}
    edges = {(a, b): w for (a, b), w in edges.items() if a != b}
    seeds = {0: 3.0, 5: 1.0}
    matrix = np.zeros((12, 12))
    for (a, b), w in edges.items():
        matrix[b, a] = w
    out = matrix.sum(0)
    matrix[:, out > 0] /= out[out > 0]
    start = np.array([seeds.get(i, 0.0) for i in range(12)])
    rank = start.copy()
    for _ in range(400):
        moved = 0.85 * matrix @ rank
        rank = moved + (start.sum() - moved.sum()) * start / start.sum()
    e = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, weight long")
    s = spark.createDataFrame([(f"h{i}", x) for i, x in seeds.items()], "host string, seed double")
    found = {r["host"]: r["rank"] for r in personalised_rank(e, s).collect()}
    for i in range(12):
        assert found.get(f"h{i}", 0.0) == pytest.approx(rank[i], rel=2e-2)


def test_rank_reaches_the_end_of_a_long_path(spark):
    """One step a link: a host 34 links from the seed has a rank, too."""
    e = spark.createDataFrame([(f"h{i:02}", f"h{i + 1:02}", 1) for i in range(34)], "src string, dst string, weight long")
    s = spark.createDataFrame([("h00", 1.0)], "host string, seed double")
    found = {r["host"]: r["rank"] for r in personalised_rank(e, s).collect()}
    assert found["h34"] / found["h33"] == pytest.approx(0.85, rel=2e-2)
    assert sum(found.values()) == pytest.approx(1, rel=2e-2)


# ---------------------------------------------------------------- main text

def article_blocks(source):
    """The blocks of the test tables' articles, by splitting at their few tags."""
    import html

    body = re.search(r"<article>(.*?)(?:</article>|\Z)", source or "", re.S)
    if not body:
        return ""
    parts = re.split(r"</?(?:p|h1|h2|ul|li)[^>]*>", body[1])
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_main_text_of_the_sample(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    rows = queries()["op5_html_text"](spark, MIDDLE).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article_blocks(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("source, text", [
    ("<header><h1>Site</h1></header><div id=c><h2>T</h2>a<p>b <i>c</i>d<p>e</div><div class='user-comments'><p>x</div><form>z</form>", "T\n\na\n\nb cd\n\ne"),
    ("<div class=notice>hi</div><main><header><h1>T</h1></header><p>x&nbsp;&amp; y</p><article class=comment>c</article></main>", "T\n\nx & y"),
    ("plain &lt;text&gt; <b>bold</b><script>if (a<b) x('</p>')</script><style>p{}</style><!-- <p>no</p> -->", "plain <text> bold"),
    ("<p>a < b<br>c &#233;&unknown; &am", "a < b c é&unknown; &am"),
    ("<article><p>one<nav>menu</nav>two<aside>side</aside></article>tail", "one\n\ntwo"),
    ("", ""), ("<nav>only</nav>", ""), ("<p>" + "x " * 50_000 + "</p>", " ".join("x" * 50_000)),
])
def test_main_text_of_pages(source, text):
    assert main_text(source) == text


def test_style_tree_removes_what_every_page_repeats(spark):
    page = lambda i: f"<div class=top>Welcome to the site</div><div class=body><p>Story {i} of many {i * 7}</p><p>More {i}</p></div><div class=end>Made by us</div>"
    rows = [(i, f"http://a.net/{i}", page(i)) for i in range(12)] + [(50, "http://b.net/", page(50)), (51, None, None), (52, "http://a.net/", "")]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 of many 21\n\nMore 3"
    # One page of a host says nothing about what is repeated there.
    assert got[50] == "Welcome to the site\n\nStory 50 of many 350\n\nMore 50\n\nMade by us"
    assert got[51] == got[52] == ""
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string, path long, host string")).count() == 0


@pytest.mark.parametrize("source, text", [
    ('<body class="single-post has-sidebar no-comments"><p>story<div class=sidebar>x</div></body>', "story"),
    ('<div id=page class="no-comments"><p>a long story</div><p>tail', "a long story\n\ntail"),
    ('<p>around</p><article class="legal-news"><p>news</p></article>', "news"),
    ('<main class="social-policy"><p>policy</p></main>', "policy"),
])
def test_class_words_do_not_silence_a_page(source, text):
    assert main_text(source) == text


def test_style_tree_judges_inside_the_article(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><p>Story {i * 7} <b>Note</b></p><div>Terms apply <i>to all</i></div></article><p>Coda {i}</p><section>Made <b>by us</b></section>"
    rows = [(i, f"http://a.net/{i}", page(i)) for i in range(12)] + [(50, "http://b.net/", page(50))]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # What lies outside an article is none of it, on hosts of any size.
    assert got[3] == "Title 3\n\nStory 21 Note"
    assert got[50] == "Title 50\n\nStory 350 Note\n\nTerms apply to all"


def test_style_tree_judges_every_template_of_a_host(spark):
    page = lambda i: f"<div class=t{i % 3}>Welcome to section {i % 3}</div><p>Story {i}</p>"
    rows = [(i, f"http://a.net/{i}", page(i)) for i in range(18)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}" for i in range(18)}


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}


def test_copies_of_a_page_are_one_page_of_the_tree(spark):
    page = lambda i, path: f"<div class=top>Welcome</div><article><h1>Title {i}</h1><p>Story {i * 7}</p></article><div>Weather {path} degrees</div>"
    rows = [(i, f"http://five.net/?utm={i}", page(1, i)) for i in range(5)]
    rows += [(10 + i, f"http://two.net/{i}", page(i % 2, i)) for i in range(8)]
    rows += [(30 + i, f"http://many.net/{i}", page(i // 6, i)) for i in range(48)]
    rows += [(99, "http://five.net/?utm=0", page(1, 0))] * 2
    got = texts_of(spark, rows)
    text = lambda i: f"Title {i}\n\nStory {i * 7}"
    assert got == {
        **{i: text(1) for i in range(5)}, **{10 + i: text(i % 2) for i in range(8)},
        **{30 + i: text(i // 6) for i in range(48)}, 99: text(1),
    }


def test_the_tree_never_empties_an_article(spark):
    # Different by what surrounds a text that all have: all of the article is low.
    page = lambda i: f"<article><h2>Part</h2><p>Same words</p><div class=n>{i}</div></article>"
    rows = [(i, f"http://a.net/{i}", page(i)) for i in range(6)]
    rows += [(6, "http://a.net/x", "<article><h2>Part</h2><p>Same words</p></article>")]
    got = texts_of(spark, rows)
    assert got[6] == "Part\n\nSame words"
    assert got[2] == "2"


def test_importance_equals_the_plain_formula(spark):
    """Entropies computed page by page, from the definition."""
    rng = random.Random(5)
    sources = []
    for i in range(30):
        extra = "".join(f"<p>{rng.choice('abc')} {rng.randrange(4)}</p>" for _ in range(rng.randrange(4)))
        sources.append((f"h{i % 3}", f"<div class=m>Menu <b>x</b></div><div>{extra}<ul><li>Text {i // 2}</ul></div>"))
    sources += sources[:7]
    pages = spark.createDataFrame(sources, "host string, html string")
    got = {(r["host"], r["path"]): (r["on"], r["importance"]) for r in style_tree(parsed_pages(pages)).collect()}
    want = {}
    for host in {h for h, _ in sources}:
        once = {}
        for h, source in sources:
            if h == host:
                page = parse(source)
                once.setdefault(same_article(page), min(
                    (_number(x), x) for y, x in sources if y == host and same_article(parse(x)) == same_article(page)
                )[1])
        seen = collections.defaultdict(collections.Counter)
        for source in once.values():
            for path, content, feature in node_features(parse(source)):
                seen[path][content, feature] += 1
        for path, counts in seen.items():
            on = sum(n for (content, _), n in counts.items() if not content)
            shares = [n / on for (content, _), n in counts.items() if not content]
            entropy = -sum(p * math.log(p) for p in shares) / math.log(on) if on > 1 else 1.0
            logs = [math.log(n) / math.log(on) for (content, _), n in counts.items() if content] if on > 1 else []
            content = 1 - (sum(logs) / len(logs) if logs else 0)
            want[host, path] = (on, 0.1 * entropy + 0.9 * content if on > 1 else 1.0)
    assert set(got) == set(want)
    for node, (on, importance) in want.items():
        assert got[node] == (on, pytest.approx(importance, abs=1e-9))


# ---------------------------------------------------------------- SentencePiece

def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path(sentencepieces.PIECE_BPE)
    library = SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeinorst .,'-TH  éñß漢😀\n\t▁09", k=rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", " ", "   ", "a" * 5000, "word " * 3000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sentencepieces.decode(sentencepieces.encode(docs, path), path)
    for r in found.collect():
        text = texts[r["doc_id"]]
        if text is None:
            assert r["piece_ids"] is None and r["decoded"] is None
            continue
        assert r["piece_ids"] == library.encode(text)
        assert r["decoded"] == library.decode(r["piece_ids"])
    one_pass = sentencepieces.encode_and_decode(docs, path)
    assert one_pass.columns == found.columns and one_pass.exceptAll(found).count() == 0
    assert sentencepieces.encode(docs.limit(0), path).count() == 0


def test_pieces_round_trip(spark):
    assert queries()["op8_sentencepiece"](spark, SMALL).filter("NOT round_trip").count() == 0


# ---------------------------------------------------------------- lines

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, line, n):
    line = list(line)
    for _ in range(n):
        at = rng.randrange(len(line) + 1)
        kind = rng.random()
        if kind < 0.3 or at == len(line):
            line.insert(at, rng.choice("abcdé"))
        elif kind < 0.6:
            del line[at]
        else:
            line[at] = rng.choice("abcdé")
    return "".join(line)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("", "ab"), ("a", ""), ("abc", "abc")]
    for _ in range(400):
        a = "".join(rng.choices("abc dé", k=rng.randint(0, 30)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5))))
    df = spark.createDataFrame(pairs, "l string, r string").select("l", "r", within_edits(F.col("l"), F.col("r"), edits).alias("w"))
    for r in df.collect():
        assert r["w"] == (edit_distance(r["l"], r["r"]) <= edits), (r["l"], r["r"])


def line_rows(docs, edits, min_chars):
    """Expected rows of near_equal_lines."""
    places = collections.defaultdict(list)
    for d, text in docs:
        for n, raw in enumerate((text or "").split("\n") if text is not None else ()):
            line = raw.strip(" \t\x0b\x0c\r")
            if line:
                places[line].append((d is None, d or 0, n))
    first = {line: min(p) for line, p in places.items()}
    links = collections.defaultdict(set)
    lines = [x for x in first if len(x) >= min_chars]
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            if abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits:
                links[a].add(b)
                links[b].add(a)
    out = []
    for line in first:
        seen, todo = {line}, [line]
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        head = min(first[x] for x in seen)
        out.append((*first[line], len(line), len(places[line]), len(links[line]), *head[1:], head == first[line]))
    return sorted(out)


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_match_brute_force(spark, edits):
    rng = random.Random(40 + edits)
    lines = ["", "  ", "short", "shorx", "a" * 40, "a" * 41, "a" * 43]
    for _ in range(25):
        base = "".join(rng.choices("abcd e", k=rng.randint(20, 60)))
        lines += [edited(rng, base, rng.randint(0, 3)) for _ in range(5)]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 4:i * 4 + 4])) for i in range(len(lines) // 4)]
    docs += [(900, None), (901, ""), (None, lines[3] + "\nown line of a document without id"), (902, "\t" + lines[9] + "  \r\n" + lines[9])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["line_no"], r["n_chars"], r["n_rows"], r["n_links"], r["class_doc_id"] or 0, r["class_line_no"], r["kept"])
        for r in near_equal_lines(df, steps=((24, edits),)).collect()
    )
    assert got == line_rows(docs, edits, 24)


WIDE = ((10, 1), (24, 2), (80, 3), (160, 4))


def linked_lines(lines, steps):
    allowed = lambda n: max((k for at, k in steps if n >= at), default=0)
    links = collections.defaultdict(set)
    for i, a in enumerate(lines):
        for j in range(i):
            most = allowed(min(len(a), len(lines[j])))
            if most and abs(len(a) - len(lines[j])) <= most and edit_distance(a, lines[j]) <= most:
                links[i].add(j)
                links[j].add(i)
    return links


@pytest.mark.parametrize("steps", [STEPS, WIDE])
def test_segments_that_many_lines_hold(spark, steps):
    """Lines with a common beginning, end or both, of which few are near each other."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    lines = [f"Subscribe to the newsletter of {word(12)}" for _ in range(150)]
    lines += [f"{word(9)} by the same author" for _ in range(120)]
    lines += [f"All rights reserved by the {word(30)} company and all others that take part in it" for _ in range(90)]
    lines += [edited(rng, x, rng.randint(1, 4)) for x in lines[::9]]
    # What is left is shorter than the number of its segments, or nothing.
    lines += [f"This line only differs in its number: {i}" for i in range(80)]
    lines = sorted(set(lines))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in near_equal_lines(df, steps=steps).collect()}
    links = linked_lines(lines, steps)
    assert got == {i: len(links[i]) for i in range(len(lines))}


def test_near_copies_make_no_more_pairs_than_links(spark, monkeypatch):
    """Copies of a line that share most segments but are rarely near each other."""
    rng = random.Random(12)
    base = "".join(rng.choices("abcdefgh ", k=58)) + "zz"
    lines = sorted({base} | {edited(rng, base, rng.randint(1, 5)).strip() for _ in range(150)})
    links = linked_lines(lines, STEPS)
    pairs = []

    def stored(df, name, *more):
        made = line_dedup_stored(df, name, *more)
        if set(made.columns) == {"a", "b"}:
            pairs.append(made.count())
        return made

    line_dedup_stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", stored)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in near_equal_lines(df).collect()}
    assert got == {i: len(links[i]) for i in range(len(lines))}
    assert pairs == [sum(got.values()) // 2]


@pytest.mark.parametrize("steps", [STEPS, WIDE])
def test_near_lines_meet_under_few_keys(spark, steps):
    rng = random.Random(31)
    allowed = lambda n: max((k for at, k in steps if n >= at), default=0)
    pairs = []
    for n in [*range(10, 100), *range(156, 176), *range(285, 300)]:
        base = "".join(rng.choices("abcdefghij", k=n))
        k = allowed(n)
        cuts = sorted(rng.sample(range(n + 1), k))
        spread = "#".join(base[i:j] for i, j in zip([0, *cuts], [*cuts, n]))
        pairs += [(base, spread), (base, "#" * k + base), (base, base + "#" * k), (base, edited(rng, base, k)), (spread[:n], base)]
    pairs = [(a, b) for a, b in pairs if edit_distance(a, b) <= allowed(min(len(a), len(b)))]
    rows = [(i, side, line, len(line)) for i, p in enumerate(pairs) for side, line in enumerate(p)]
    df = spark.createDataFrame(rows, "pair int, side int, line string, n_chars int")
    entries = line_dedup._cut(df, line_dedup.Limit(steps)).select("pair", "side", "own", "key").collect()
    keys, owned = collections.defaultdict(set), collections.defaultdict(set)
    for r in entries:
        keys[r["pair"], r["side"]].add(r["key"])
        if r["own"]:
            owned[r["pair"], r["side"]].add(r["key"])
    for i, p in enumerate(pairs):
        assert owned[i, 0] & keys[i, 1] or keys[i, 0] & owned[i, 1], p
    # Up to 26 keys a line of three edits were shuffled, a third of that is enough.
    assert len(entries) < 9 * len(rows)


def test_distance_of_texts_far_apart(spark):
    rng = random.Random(32)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choices("abc", k=rng.randint(20, 50)))
        pairs += [(a, "".join(rng.choices("abc", k=len(a)))), (a, "x" * rng.randint(1, 4) + a), (a, a[::-1]), (a, a[rng.randint(1, 4):] + "x")]
    df = spark.createDataFrame(pairs, "l string, r string")
    df = df.select("l", "r", *[within_edits(F.col("l"), F.col("r"), k).alias(f"w{k}") for k in (1, 3, 4)])
    for r in df.collect():
        assert [r["w1"], r["w3"], r["w4"]] == [edit_distance(r["l"], r["r"]) <= k for k in (1, 3, 4)], (r["l"], r["r"])


def test_very_long_lines(spark):
    base = "word and some more of it " * 4_000
    rows = [(1, base), (2, base[:50_000] + "#" + base[50_000:]), (3, "xyz" + base), (4, "wxyz" + base), (5, base[:-2_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # 1 and 3 are three apart, 1 and 2 one, 2 and 3 four, 1 and 4 four, 3 and 4 one, 2 and 4 five.
    got = lambda **steps: {r["doc_id"]: (r["n_links"], r["class_doc_id"]) for r in near_equal_lines(df, **steps).collect()}
    assert got() == {1: (2, 1), 2: (1, 1), 3: (2, 1), 4: (1, 1), 5: (0, 5)}
    assert got(steps=WIDE) == {1: (3, 1), 2: (2, 1), 3: (3, 1), 4: (2, 1), 5: (0, 5)}


@pytest.mark.parametrize("steps", [STEPS, WIDE])
def test_line_limit_grows_with_the_length(spark, steps):
    rng = random.Random(77)
    allowed = lambda n: max((k for at, k in steps if n >= at), default=0)
    lines = ["(c) 2023 Example Ltd", "(c) 2024 Example Ltd", "short one", "short two"]
    for n in (10, 11, 14, 23, 24, 25, 39, 79, 80, 82, 159, 160, 163, 290):
        for letters in ("abcdefghij     ", "漢字ab😀 "):
            base = "".join(rng.choices(letters, k=n)).strip()
            # Spread evenly, so that no piece is longer than it must be.
            for k in (allowed(n), allowed(n) + 1):
                other = list(base)
                for i in range(k):
                    other[(i + 1) * len(base) // (k + 1) - (i + 1 > k // 2)] = "#"
                lines += [base, "".join(other), edited(rng, base, k)]
    lines = sorted({x.strip() for x in lines if x.strip()})
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_links"], r["class_doc_id"]) for r in near_equal_lines(df, steps=steps).collect()}
    links = linked_lines(lines, steps)
    assert {i: n for i, (n, _) in got.items()} == {i: len(links[i]) for i in range(len(lines))}
    by_line = {x: got[i] for i, x in enumerate(lines)}
    assert by_line["(c) 2023 Example Ltd"][1] == by_line["(c) 2024 Example Ltd"][1]


def test_lines_of_nothing(spark):
    assert near_equal_lines(spark.createDataFrame([], "doc_id long, text string, line string, key long")).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(10_001, None, "en", "s", None), (10_002, "123 ...", "en", "s", 7), (10_003, "", None, None, 0)]
    twice = docs.limit(3)
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(twice)
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    known = stages["language_id"](spark, docs, SMALL)
    expected = sorted((d, t) for d, t in rows if t and any(c.isalpha() for c in t))
    assert sorted((r["doc_id"], r["text"]) for r in known.collect()) == expected

    unique = stages["exact_dedup"](spark, known, SMALL)
    keep = {k for _, k, _, stays, _ in brute.exact_rows(sorted(set(expected))) if stays}
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(keep)

    texts = dict(expected)
    near = stages["near_dedup"](spark, unique, SMALL)
    stay = {d for d, _, _, kept in brute.near_duplicate_rows([(d, texts[d]) for d in sorted(keep)], 5, 80) if kept}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(stay)

    clean = stages["pii"](spark, near, SMALL).collect()
    assert sorted(r["doc_id"] for r in clean) == sorted(stay)
    for r in clean:
        assert r["n_chars"] == len(r["text"]) and not brute.base_spans(r["text"])
        if not brute.base_spans(texts[r["doc_id"]]):
            assert len(r["text"]) <= len(texts[r["doc_id"]])

    packed = stages["packing"](spark, stages["pii"](spark, near, SMALL), SMALL).collect()
    assert {r["doc_id"] for r in packed} == stay
    assert all(f.columns == list(corpus_pipeline.COLUMNS) for f in (known, unique, near))
