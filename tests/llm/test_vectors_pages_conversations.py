"""Centroids, main text and the prefix trie against brute force, and on odd inputs."""

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from footfall.llm import conversation_trie
from footfall.llm.centroids import LARGEST, cluster, integers, nearest, spread_out, squared
from footfall.llm.conversation_trie import prefix_trie, running
from footfall.llm.html_text import extract_text, main_text
from footfall.llm.queries import QUERIES

CLASHING = ("cluster", "distance", "parts", "depth", "one", "two", "text_", "n_chars", "held", "conv", "weight", "j", "h")


# --- centroids ----------------------------------------------------------------


def clustered(rows, clusters=16, rounds=3, size=64):
    """The clustering as its definition says, in Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    raw = {(i, tuple(math.floor(64 * x) for x in v)): v for i, v in rows if v is not None and None not in v and i is not None
           and all(map(math.isfinite, v))}
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), raw[r[0], tuple(r[1])]))
    centroids = [list(v) for _, v in first[:clusters]]

    def assign():
        return [min(((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = [sum(d for d, c in at if c == k) for k in range(len(centroids))]
    return sorted((i, c, d, inertia[c], sum(inertia), names[c]) for (i, _), (d, c) in zip(kept, at))


def test_clusters_by_brute_force(spark):
    rng = random.Random(3)
    centre = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centre)]) for i in range(300)]
    rows += [(1_000 + i, rows[0][1]) for i in range(150)]  # one very common vector
    rows += [(7, rows[9][1]), (8, rows[8][1]), (-5, rows[8][1])]  # repeated ids and rows
    odd = [(2_000, None), (2_001, []), (2_002, [1.0] * 63), (2_003, [1.0] * 65), (2_004, [None] + [1.0] * 63),
           (2_005, [math.nan] * 64), (2_006, [math.inf] + [0.0] * 63), (None, [1.0] * 64)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    table = table.withColumns({c: F.lit(1) for c in CLASHING})
    assert sorted(map(tuple, cluster(table).collect())) == clustered(rows + odd)


@pytest.mark.parametrize("rows", [[], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(40)], [(1, None), (None, [0.0] * 64)]],
                         ids=["empty", "one", "equal", "none fit"])
def test_few_vectors(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, cluster(table).collect())) == clustered(rows)


def test_very_large_components_are_held(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    found = {r.vec_id: r for r in cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), clusters=2).collect()}
    assert len(found) == 3 and all(0 <= r.distance < 1 << 63 for r in found.values())


def test_pivots_prune_and_never_change_the_nearest():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-60, 60, (16, 64))
    vectors = centroids[rng.integers(0, 16, 2_000)] + rng.integers(-3, 4, (2_000, 64))
    vectors[:50] = centroids[rng.integers(0, 16, 50)]
    centroids[3] = centroids[9]  # a tie for every vector of the two
    pivots = spread_out(centroids, 8)
    stored = np.stack([squared(vectors, p) for p in pivots], axis=1)
    number, best, measured = nearest(vectors, stored, centroids, pivots)
    every = np.stack([squared(vectors, c) for c in centroids], axis=1)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all() and not (number == 9).any()
    assert measured < 0.25 * every.size
    assert (integers(np.array([-0.001, 0.999, 1e30]), 64) == [-1, 63, LARGEST]).all()


# --- main text ------------------------------------------------------------------

MENU = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>About us</a></ul></nav>"
SIDE = "<div id=side class='sidebar'><h3>Popular</h3><p>Another story that many people read this week, says the site.</p></div>"
NOTE = "<div class='cookieNotice'><p>We use cookies to give you the best of all possible pages on this site, as ever.</p></div>"
VOICES = ("<section id='comments'><h2>2 comments</h2><article class='comment'><p>I read this twice and liked it far more than I can "
          "say in a line of text, which is why I wrote several.</p></article><p class='comment'>Me too, and more so.</p></section>")
FORM = "<form action='/x'><label>Mail <input name=m></label><select><option>One<option>Two</select><button>Send it</button></form>"
PARAS = "<p>The first paragraph is of some length &amp; ends here.<p>The second, <a href='/x'>with a link</a>,\n has   more words to it.</p>"
ITEMS = "<ul><li>item one<li>item two</ul><table><tr><td>cell</td><td>next</td></tr><tr><td>under</td></tr></table>"
TEXT = ("The first paragraph is of some length & ends here.\nThe second, with a link, has more words to it.\n"
        "item one\nitem two\ncell next\nunder")

PAGES = {
    "article": (f"<body>{MENU}<article><h1>Title</h1>{PARAS}{ITEMS}</article>{SIDE}{NOTE}<footer>c</footer></body>", f"Title\n{TEXT}"),
    "no article tag": (f"<html class='has-sidebar'><body>{MENU}<div class=wrap><div class='post-body'><h1>Title</h1>{PARAS}{ITEMS}{FORM}"
                       f"</div>{SIDE}</div>{NOTE}{VOICES}<div class=footer>All rights reserved</div>", f"Title\n{TEXT}"),
    "comments as articles": (f"<main><article><h1>Title</h1>{PARAS}{ITEMS}{VOICES}</article></main>", f"Title\n{TEXT}"),
    "sections": (f"<body><header><a href='/'>Site</a></header><div><h1>Title</h1><section><h2>One</h2>{PARAS}</section><section><h2>Two</h2>"
                 f"{PARAS}{PARAS}</section></div></body>", "\n".join(["Title", "One", *TEXT.split("\n")[:2], "Two", *TEXT.split("\n")[:2] * 2])),
    "own header": (f"<article><header class='entry-header'><h1>Title</h1></header>{PARAS}<footer>by me</footer></article>",
                   "Title\n" + "\n".join(TEXT.split("\n")[:2])),
    "form around all": (f"<form id=aspnet><div>{MENU}</div><article>{PARAS}<input value=x><button>Go</button></article></form>",
                        "\n".join(TEXT.split("\n")[:2])),
    "script and style": ("<head><title>T</title><style>p{}</style></head><p>seen<script>if (a<b) document.write('</p><p>no')</script> too"
                         "<!-- <p>hidden --> and <b>on</b><svg><text>x</text></svg>", "seen too and on"),
    "breaks off": ("<article><p>One &lt;two&gt; &#233;&nbsp;&hellip;<p>cut <a href='/unfin", "One <two> é …\ncut"),
    "break and blanks": ("<p> a<br>b \t\n c&#160;d </p><p> </p>", "a b c d"),
    "no tags": ("just < text & more &am", "just < text & more &am"),
    "menus only": (f"{MENU}<footer>c</footer>", ""),
    "unclosed menu item": ("<ul><li><a href=1>x</a><li><a href=2>y</a></ul><p>Some text stands below the links, enough of it to be it.",
                           "Some text stands below the links, enough of it to be it."),
    "empty": ("", ""), "null": (None, ""), "blank": (" \n ", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    source, expected = PAGES[name]
    assert main_text(source) == expected


def test_pages_as_rows(spark):
    rows = [(i, name, source) for i, (name, (source, _)) in enumerate(PAGES.items())] + [(0, None, None), (None, "x", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "tag")})
    found = sorted(map(tuple, extract_text(pages).collect()), key=str)
    texts = [(i, name, text, len(text)) for i, (name, (_, text)) in enumerate(PAGES.items())] + [(0, None, "", 0), (None, "x", "y", 1)]
    assert found == sorted(texts, key=str)
    assert extract_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize("source", ["<div>" * 50_000 + "deep", "<b><p>" * 20_000 + "x", "<div " * 50_000, "<a '" * 50_000, "<!--" * 50_000,
                                    "<p>" + "long " * 400_000, "&" * 200_000, "</p>" * 50_000, "<ul><li>" * 20_000, "x" * 3_000_000],
                         ids=range(10))
def test_very_long_or_broken_pages_end(source):
    assert isinstance(main_text(source), str)


def test_sample_pages(spark):
    """The sample's articles, read off their markup."""
    table = ds.dataset("/root/testdata/sf0.001/pages.parquet").to_table()
    expected = {}
    for number, source in zip(table["page_id"].to_pylist(), table["html"].to_pylist()):
        inside = re.search("<article>(.*?)(</article>|$)", source, re.S)[1]
        blocks = (html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))) for b in re.split("</?(?:p|h1)>", inside))
        expected[number] = "\n".join(filter(None, (" ".join(b.split()) for b in blocks)))
    found = {r.page_id: r.text for r in QUERIES["op12_html_text"](spark, "/root/testdata/sf0.001").collect()}
    assert found == expected


# --- prefix trie ------------------------------------------------------------------


def trie(rows):
    """The trie from the definition; turns of equal number in the order of their SHA-256."""
    content = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    whole = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            whole.setdefault(conv, []).append((turn is not None, turn or 0, content(role or "", text or ""), role or "", text or ""))
    whole = {c: [t[3:] for t in sorted(ts)] for c, ts in whole.items()}
    nodes = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 9
        turns = whole.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
        for d in range(len(turns) + 1):
            members, ends = nodes.setdefault(tuple(turns[:d]), ([], []))
            members.append(c)
            if d == len(turns):
                ends.append(c)
    out = []
    for path, (members, ends) in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        out.append((
            min(members), len(path), min(nodes[path[:-1]][0]) if path else None, len(members),
            sum(p[:-1] == path for p in nodes if p), sum(p not in inner for p in below),
            sum((len(nodes[p][0]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows, parts=4):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    return table.withColumns({c: F.lit(1) for c in CLASHING})


def found(table):
    return sorted(map(tuple, prefix_trie(table).collect()), key=str)


def test_trie_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long text"]))
            for c in range(-12, 60) for t in range(rng.randint(0, 6))]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(3)]  # one very common conversation
    rows += [(200, None, "user", "first"), (200, 1, "user", "x"), (200, 1, "user", "x"), (200, 1, "user", "b"), (201, None, None, None),
             (None, 0, "user", "nobody"), (202, -3, "", "")]
    assert found(conversations(spark, rows)) == trie(rows)


def test_no_conversations(spark):
    assert found(conversations(spark, [])) == []
    assert found(conversations(spark, [(None, 1, "user", "x")])) == []


def test_long_conversation_is_spread_over_ranges(spark, monkeypatch):
    """A conversation with most of the rows, and lists of ids that take many rows."""
    monkeypatch.setattr(conversation_trie, "IDS_A_ROW", 7)
    rows = [(5, t, "user", f"turn {t % 3}") for t in range(400)] + [(10 + 5 * c, 0, "user", "hello") for c in range(60)]
    rows += [(10 + 5 * c, 1, "user", f"{c % 2}") for c in range(60)]
    assert found(conversations(spark, rows, 9)) == trie(rows)
    steps = spark.range(2_000).selectExpr("1L as key", "id as at", "id as value")
    got = {r["at"]: r["sum"] for r in running(steps, "key", [F.col("at")], F.sum, sum="value").collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(2_000)}
