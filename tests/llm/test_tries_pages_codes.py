"""Prefix tries, main texts of pages and vector codes against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pytest

from factloom.llm import boilerplate, prefixtrie, vectorcodes
from factloom.llm.registry import QUERIES

# prefix trie

TURNS = "conv_id long, turn long, role string, text string, shard int, key string, depth long"


def brute_trie(rows):
    """Nodes by their definition: rows are (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    found = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        found[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, ts in found.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def under(p):
        out, todo = [], [p]
        while todo:
            out.append(todo.pop())
            todo += children.get(out[-1], [])
        return out

    out = []
    for p, members in nodes.items():
        below = under(p)
        ends = ",".join(map(str, sorted(c for c in members if len(found[c]) == len(p))))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), sum(b not in children for b in below),
            sum((len(nodes[b]) - 1) * words(b[-1][1]) for b in below if b), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_of(spark, rows, shard_turns):
    df = spark.createDataFrame([(*r, 1, "k", 7) for r in rows], TURNS).repartition(3)
    return sorted((tuple(r[c] for c in prefixtrie.COLUMNS) for r in prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.sequences(df)), shard_turns).collect()), key=str)


@pytest.mark.parametrize(("seed", "shard_turns"), [(1, 2), (2, 5), (3, 40), (4, 1 << 18)])
def test_trie_against_brute_force(spark, seed, shard_turns):
    """Few texts, so that prefixes and whole conversations repeat; many shards, so that spines are long."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ua"), rng.choice(["a", "b c", ""])) for c in range(-25, 60) for t in range(rng.choice([1, 2, 3, 3, 9]))]
    rows += [(100 + c, t, "u", "same words") for c in range(40) for t in range(4)]
    assert trie_of(spark, rows, shard_turns) == brute_trie(rows)


def test_trie_edges(spark):
    assert trie_of(spark, [], 5) == []
    rows = [(None, 0, "u", "x"), (21, None, None, None), (21, 5, "u", "x y"), (21, None, "u", "b"), (21, 5, "u", "x y"), (21, 5, "a", "x y"), (3, 1, "u", "long " * 20_000), (3, 0, "u", None)]
    assert trie_of(spark, rows, 2) == brute_trie(rows)
    lone = [(c, 0, "u", "x") for c in (21, 23, 24, 26, 28, 29)]  # some have no turns of their own left, and no family head
    assert trie_of(spark, lone, 1) == brute_trie(lone) and any(r[1] == 0 and r[7] != prefixtrie.NO_ENDS for r in brute_trie(lone))


def test_a_deep_and_copied_conversation(spark):
    """One conversation of many turns, many copies of another: each is dealt over shards and merged."""
    rows = [(40, t, "u", f"t {t % 7}") for t in range(700)] + [(41 + c, t, "u", "hot") for c in range(300) for t in range(3)]
    assert trie_of(spark, rows, 100) == brute_trie(rows)


@pytest.mark.parametrize("seed", range(4))
def test_parentheses_against_brute_force(seed):
    rng = random.Random(seed)
    opens, depth = [True], 1
    while depth:
        up = len(opens) < 4000 and rng.random() < (0.5 if seed < 2 else 0.6) or depth == 1 and len(opens) < 2000
        opens.append(up)
        depth += 1 if up else -1
    stack, close, above = [], {}, {}
    for i, o in enumerate(opens):
        if o:
            above[i] = stack[-1] if stack else -1
            stack.append(i)
        else:
            close[stack.pop()] = i
    pairs, at = prefixtrie.Parentheses(np.array(opens)), np.flatnonzero(opens)
    assert pairs.find_close(at).tolist() == [close[i] for i in at.tolist()]
    assert pairs.enclose(at[1:]).tolist() == [above[i] for i in at[1:].tolist()]


# main text

PROSE = "The committee met on Tuesday and it was agreed that the plan for the new bridge would be sent to the council, which has to vote on it by the end of the month. "
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; U</title><style>p {{}}</style><script>if (a<b) x('</p>')</script></head><body class="has-sidebar nav-open">
<header class=site-header><a href=/>Home</a> <p>{PROSE}</p></header>
<div id="cookie-notice">We use cookies and it is for the good of the site. {PROSE}</div>
<div class="menuBar"><ul><li><a href=/a>Sport</a><li><a href=/b>News</a></ul></div>
<div id=content><h1>Bridge plan</h1><p>{PROSE * 2}</p><p>"We\tagree."</p><p>{PROSE * 2}<a href=/x>plan</a></p>
<div class="advert"><p>{PROSE * 3}</p></div><!-- <p>{PROSE * 2}</p> -->
<ul><li>One item<li>Two &amp; three</ul><p>A line<br>goes&nbsp;on &#233;.<br> <br>The end</p></div>
<aside><p>{PROSE * 2}</p></aside><noscript><p>{PROSE * 2}</p></noscript><p hidden>{PROSE * 2}</p>
<form><label>Name</label><p>{PROSE * 2}</p><select><option>{PROSE * 2}</select></form>
<section id="comments"><h2>Comments</h2><article class="comment"><p>{PROSE * 2}</p></article></section>
<footer><p>{PROSE * 2}</p></footer></body></html>"""
LONG = " ".join(PROSE.split())
MAIN = ["Bridge plan", f"{LONG} {LONG}", '"We agree."', f"{LONG} {LONG} plan", "One item", "Two & three", "A line goes on é.", "The end"]


def test_blocks_of_a_page():
    assert boilerplate.main_blocks(PAGE) == MAIN


@pytest.mark.parametrize(("page", "expected"), [
    (None, []), ("", []), ("<p>a", []), ("<article>short &lt;b&gt;</article>", ["short <b>"]), (f"plain {PROSE * 2} 1 < 2 <", [f"plain {LONG} {LONG} 1 < 2 <"]),
    (f"<form><main><p>{PROSE * 2}<p>x</main><p>{PROSE * 2}</form>", [f"{LONG} {LONG}", "x"]), (f"<div class=nav><p>{PROSE * 2}</div>", [f"{LONG} {LONG}"]),
    (f"<div><a 'x>{PROSE * 2}</div>", [f"{LONG} {LONG}"]), (f"<script>{PROSE}", []), (f"<article>one<nav>two</nav><aside>{PROSE * 2}</aside><p>three</article>{PROSE * 2}", ["one", "three", f"{LONG} {LONG}"]),
    (f"<article><p>{PROSE * 2}<p>{'абв где жзи ' * 30}</article>", [f"{LONG} {LONG}", ("абв где жзи " * 30).strip()]), (f"<p>{'лорем ипсум долор сит ' * 20}</p><nav>x</nav>", [("лорем ипсум долор сит " * 20).strip()]),
    (f"<main><p>{PROSE * 2}</p><p>&copy; 2020 Someone</p></main>", [f"{LONG} {LONG}"]), (f"<div><p>{PROSE * 2}<a href=x>{PROSE * 2}</a></p></div>", []),
])
def test_pages_of_many_forms(page, expected):
    assert boilerplate.main_blocks(page) == expected


def test_broken_pages_take_time_in_proportion():
    for piece in ("<", "<a '", "<div>", "<!--", "<b><p>", "</div>", "<i hidden><p>", "<p>x</p>", "<div class='", "<a href=x>", "&#x;", "word "):
        began = time.process_time()
        boilerplate.main_blocks(piece * 20_000)
        assert time.process_time() - began < 4, piece


def test_extraction_keeps_rows_and_columns(spark):
    rows = [(1, "u", PAGE, "en", "old", 5), (1, "u", PAGE, "en", "old", 5), (None, None, None, None, None, None), (2, "v", f"<article><p>{PROSE * 40_000}</article>", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lang string, text string, n_chars long")
    found = sorted((str(r.page_id), r.url, r.lang, r.text, r.n_chars) for r in boilerplate.extract_main_text(df).collect())
    text, long = "\n\n".join(MAIN), (PROSE * 40_000).strip()
    assert found == sorted([("1", "u", "en", text, len(text))] * 2 + [("None", None, None, "", 0), ("2", "v", None, long, len(long))])
    assert boilerplate.extract_main_text(df.limit(0)).count() == 0


def test_page_query_equals_the_article(spark, data):
    """The test pages hold their text in an article: a plain reading of it, by patterns, is the same."""
    found = {r.page_id: r for r in QUERIES["op12_block_rules"](spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        text = "\n\n".join(x for x in parts if x)
        assert (found[p.page_id].url, found[p.page_id].text, found[p.page_id].n_chars) == (p.url, text, len(text))


# vector codes


def brute_codes(rows):
    """rows: (vec_id, vector) of those that take part, of one dimension; codes, errors and codebooks by their definition."""
    floor = lambda x: [int(np.floor(4096 * c)) if abs(c) < 1e300 else 4096 * int(c) for c in x]
    vectors = [(i, floor(x)) for i, x in rows]
    first = {}
    for i, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, floor(x))
    dim = len(rows[0][1])
    ends = [len(p) for p in np.array_split(np.arange(dim), 8)]
    cuts = [(sum(ends[:p]), sum(ends[: p + 1])) for p in range(8)]
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for a, b in cuts:
        book = [x[a:b] for x in list(first.values())[:16]]
        nearest = lambda u, book: min((sum((c - d) ** 2 for c, d in zip(u, e, strict=True)), k) for k, e in enumerate(book))
        for _ in range(6):
            at = [nearest(x[a:b], book)[1] for _, x in vectors]
            mine = [[x[a:b] for (_, x), k in zip(vectors, at, strict=True) if k == e] for e in range(len(book))]
            book = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(mine, book, strict=True)]
        for n, (_, x) in enumerate(vectors):
            d, k = nearest(x[a:b], book)
            codes[n].append(k)
            errors[n] += d
        books.append(book)
    return [(i, bytes(c).hex(), min(e, vectorcodes.MOST)) for (i, _), c, e in zip(rows, codes, errors, strict=True)], books


@pytest.mark.parametrize(("dim", "scale"), [(64, 0.2), (16, 1e6), (13, 1e30), (8, 1e307), (5, 0.001), (0, 1.0)])
def test_codes_against_brute_force(spark, dim, scale):
    rng = random.Random(dim)
    rows = [(i, [round(rng.gauss(0, 1), 1) * scale for _ in range(dim)]) for i in range(-5, 60)]
    rows += rows[:3] + [(rows[1][0], rows[9][1]), (None, rows[4][1])] + [(200 + i, rows[7][1]) for i in range(40)]
    left_out = [(70, None), (71, [None] + [0.5] * (dim - 1)), (72, [float("nan")] * dim), (73, [float("inf")] * dim)] if dim else [(70, None)]
    df = spark.createDataFrame([(i, x, "z", 3) for i, x in rows + left_out], "vec_id long, embedding array<double>, code string, dim int").repartition(5)
    vectors = vectorcodes.kept_vectors(df, "vec_id", "embedding", "code", "dim")
    books = vectorcodes.fit(vectors)
    codes, expected = brute_codes(rows)
    assert books[dim] == expected
    found = vectorcodes.encode(vectors, books)
    assert sorted((str(r.vec_id), r.code, r.error) for r in found.collect()) == sorted((str(i), c, e) for i, c, e in codes)
    back = {r.vec_id: r.x for r in vectorcodes.decode(found, books).collect()}
    assert all(back[i] == [c / 4096 for book, k in zip(expected, bytes.fromhex(code), strict=True) for c in book[k]] for i, code, _ in codes if codes.count((i, code, _)) == 1 and i not in (rows[1][0], None))


def test_dimensions_have_codebooks_of_their_own(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(8 if i % 3 else 24)]) for i in range(80)]
    vectors = vectorcodes.kept_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    books = vectorcodes.fit(vectors)
    plain = [(r.vec_id, list(r.x)) for r in vectors.collect()]
    assert books == {d: brute_codes([r for r in plain if len(r[1]) == d])[1] for d in (8, 24)}
    assert vectorcodes.fit(vectors.limit(0)) == {} and vectorcodes.encode(vectors.limit(0), {}).count() == 0


@pytest.mark.parametrize("kind", [np.int64, object])
def test_search_meets_ties_and_stops(kind):
    """Equal entries, equal sums and equal distances: the lower index."""
    rng = np.random.default_rng(4)
    for width in (0, 1, 3, 8):
        entries = rng.integers(-3, 4, (16, width))
        entries[5], entries[12] = entries[2], -entries[3]
        parts = rng.integers(-6, 7, (300, width))
        away = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        at, best = vectorcodes.nearest(parts.astype(kind), entries.astype(kind))
        assert at.tolist() == away.argmin(1).tolist() and best.tolist() == away.min(1).tolist()


def test_sums_by_label(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 1), (None, 2), (3, vectorcodes.MOST), (3, 9)], "label int, error long")
    assert sorted((str(r.label), r.label_error) for r in vectorcodes.summed_by(df, "label", "error", "label_error").collect()) == [("1", 11)] * 2 + [("3", vectorcodes.MOST)] * 2 + [("None", 3)] * 2
