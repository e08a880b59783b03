import random
import time

from trolley.llm import page_diff as P


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        at = P.shared_lines(a, b)
        picked, rest = [a[i] for i in at], iter(b)
        assert at == sorted(set(at)) and len(at) == lcs(a, b) and all(x in rest for x in picked)


def test_lines_and_zones():
    page = ("<head><title>t</title></head><body><div class='cookie-notice'>We use <b>cookies</b></div><header>Site</header><script>var a='<p>x</p>'</script>"
            "<main><article><header><h1>T &amp; C</h1></header><p>One <i>t</i>wo<p>Three&nbsp;<br> four<aside>side</aside><form>f<input></form>"
            "<section id=comments><p>first!</section><style>p{}</style><!-- ad -->&copy; last &am</article></main><footer>x")
    lines = P.text_lines(page)
    can, _ = P.split_zones(lines)
    assert [t for (t, _), c in zip(lines, can) if c] == ["T & C", "One two", "Three", "four", "© last &am"]
    assert P.text_lines(None) == [] and P.text_lines("") == []
    assert P.text_lines("plain < text") == [("plain < text", P.OPEN)]


def test_differencing_deletes_what_neighbours_share(spark):
    page = "<div>Home of things</div><p>{}</p><div>All rights kept</div>"
    rows = [(1, "http://a.com/x/1", page.format("First story")), (2, "http://a.com/x/2?q", page.format("Second story")), (3, "http://b.com/x", page.format("Alone")),
            (4, None, None), (5, "::odd", ""), (2, "http://a.com/x/2?q", page.format("Second story"))]
    table = spark.createDataFrame([(*r, "u") for r in rows], "page_id bigint, url string, html string, path string")
    got = sorted((r["page_id"], r["url"] or "", r["text"], r["n_shared"]) for r in P.main_text(table).collect())
    assert got == [(1, "http://a.com/x/1", "First story", 2), (2, "http://a.com/x/2?q", "Second story", 2), (2, "http://a.com/x/2?q", "Second story", 2),
                   (3, "http://b.com/x", "Home of things Alone All rights kept", 0), (4, "", "", 0), (5, "::odd", "", 0)]


def test_the_nearest_path_is_the_partner_and_articles_keep_shared_lines(spark):
    rows = [(1, "http://a.com/a", "<p>Menu<p>one"), (2, "http://a.com/news/1", "<p>News bar<p>two"), (3, "http://a.com/news/2", "<p>News bar<p>Menu<p>three"),
            (4, "http://c.com/1", "<nav>N</nav><article><p>quoted<p>four</article>"), (5, "http://c.com/2", "<nav>N</nav><article><p>quoted<p>five</article>")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in P.main_text(table).collect()}
    assert got == {1: "Menu one", 2: "two", 3: "Menu three", 4: "quoted four", 5: "quoted five"}


def test_empty_table(spark):
    table = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert P.main_text(table).count() == 0


def test_lines_of_every_zone_are_differenced(spark):
    page = "<main><p>Share this</p><article><h1>{0}</h1><p>Read more below</p><p>{0} text</p></article><div class=content><p>Top tips</p></div><p>only {0}</p></main>"
    rows = [(k, f"http://a.com/n/{k}", page.format(w)) for k, w in enumerate(("one", "two", "three", "four"))]
    rows += [(k, f"http://b.com/{k}", f"<main><p>Latest</p><p>{w}</p></main>") for k, w in ((8, "eight"), (9, "nine"))]
    got = {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {**{k: f"{w} {w} text only {w}" for k, w in enumerate(("one", "two", "three", "four"))}, 8: "eight", 9: "nine"}


def test_copies_do_not_delete_each_other(spark):
    page = "<div>Home of things</div><p>{}</p><div>All rights kept</div>"
    story = "A long story that is told here in many words " * 9
    rows = [(1, "http://a.com/s/1", page.format(story)), (2, "http://a.com/s/1-print", page.format(story)), (3, "http://a.com/s/1?x", page.format(story) + "<p>v2"),
            (4, "http://a.com/s/2", page.format("Second story")), (5, "http://c.com/1", page.format(story)), (6, "http://c.com/2", page.format(story))]
    got = {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    whole = " ".join(["Home of things", story.strip(), "All rights kept"])
    assert got[4] == "Second story" and got[5] == got[6] == whole
    assert got[1] == got[2] == story.strip() and got[3] == story.strip() + " v2"


def test_both_ways_of_alignment_agree():
    rng = random.Random(5)
    for _ in range(150):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(2))
        for at in (P._many_matches(a, b), P.shared_lines(a, b)):
            picked, rest = [a[i] for i in at], iter(b)
            assert at == sorted(set(at)) and len(at) == lcs(a, b) and all(x in rest for x in picked)


def test_long_pages_are_read_and_aligned_in_time():
    cells = [0] * 20_000
    began = time.time()
    assert len(P.shared_lines([1, *cells, 2], [3, *cells, 4])) == 20_000
    mixed = [k % 7 for k in range(8_000)]
    assert len(P.shared_lines([9, *mixed, 5], [8, *mixed[1:], 4, 6])) >= 7_999
    assert len(P.text_lines("<div>" * 20_000 + "x" + "</div>" * 20_000)) == 1
    assert len(P.text_lines("<table>" + "<tr><td>0" * 20_000)) == 20_000
    assert time.time() - began < 10


def expected(pages):
    """Pairing and deletion by plain loops over each host's pages (distinct lines, plain URLs)."""
    out, hosts = {}, {}
    for page, url, html in pages:
        host, _, path = url.removeprefix("http://").partition("/")
        hosts.setdefault(host, []).append(("/" + path, page, P.text_lines(html)))
    for rows in hosts.values():
        rows.sort(key=lambda r: r[:2])
        for k, (path, page, lines) in enumerate(rows):
            def like(j):
                if not 0 <= j < len(rows):
                    return -1
                return next((n for n, (x, y) in enumerate(zip(path, rows[j][0])) if x != y), min(len(path), len(rows[j][0])))

            first = like(k - 1) >= like(k + 1)
            order = (k - 1, k + 1, k - 2) if first else (k + 1, k - 1, k + 2)
            near = [rows[j][2] for j in order if 0 <= j < len(rows)]
            words = [[t for t, _ in x] for x in near]
            gone = set()
            for t, zone in lines:
                usual = sum(t in [u for u, _ in r[2]] for r in rows)
                if near and t in words[0] and (zone < P.ARTICLE or (zone == P.ARTICLE and len(words) > 1 and t in words[1] and usual >= 4 and 2 * usual > len(rows))):
                    gone.add(t)
            out[page] = " ".join(t for t, zone in lines if zone != P.DROPPED and t not in gone)
    return out


def test_pairing_and_deletion_equal_brute_force(spark):
    rng, pages = random.Random(11), []
    bars = [f"bar {k}" for k in range(6)]
    for k in range(90):
        host = rng.choice(["a.com", "a.com", "b.com", "c.com"])
        used = sorted(rng.sample(range(6), 3))
        body = "".join(f"<p>own {k} {j} with enough words to be no copy of any other page at all</p>" for j in range(4))
        inside = "".join(f"<p>{x}</p>" for x in (["Share this"] * (host == "a.com" or (host == "c.com" and k % 4 == 0)) + [f"quote {k // 2}"] * (k % 3 == 0)))
        html = f"<nav>menu</nav><p>top</p>{''.join(f'<div>{bars[i]}</div>' for i in used)}<article><h1>Same title</h1>{body}{inside}</article><p>end</p>"
        pages.append((k, f"http://{host}/{rng.choice(['news', 'news/x', 'blog'])}/{k}", html))
    want = expected(pages)
    table = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id bigint, url string, html string, page string, hashes string")
    assert {r["page_id"]: r["text"] for r in P.main_text(table).collect()} == want
    assert all("Same title" in x for x in want.values()) and any("Share this" in x for x in want.values()) and any("Share this" not in x and "quote" in x for x in want.values())
