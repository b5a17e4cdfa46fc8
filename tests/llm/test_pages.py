"""WARC round trips and main text of pages."""

import hashlib

import numpy as np

from shelfsight.llm import html_text, warc

SCHEMA = "page_id bigint, url string, html string, payload_digest string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], SCHEMA)


def test_records_come_back_and_copies_revisit(spark):
    big, fake = "é" * 90, "text WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n tail"
    rows = [(5, "http://a/", big), (3, "http://b/", big), (9, None, big), (1, "u\r\nX: y", None), (2, "u", ""),
            (4, "u", "short"), (6, "u", "short"), (7, "u", fake), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (10, "u", fake * 5),
            (11, "u", "x" * 200_000), (12, "u", "WARC/1.1\r\n" * 40)]
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    try:
        for size in (before, "1000"):  # splits that cut records anywhere
            spark.conf.set(conf, size)
            got = {r["page_id"]: r for r in warc.round_trip(table(spark, rows).coalesce(1)).collect()}
            assert len(got) == len(rows)
            for i, _, h in rows:
                body = (h or "").encode()
                r = got[i]
                assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
                assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if i in (5, 9) else ("response", None))
    finally:
        spark.conf.set(conf, before)
    assert warc.round_trip(table(spark, rows).limit(0)).count() == 0


def page(body):
    return "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body>" + body + "</body></html>"


def test_articles_lose_their_surroundings(spark):
    chrome = "<nav><a href='/'>Home</a></nav><div class='ad'>Buy</div>"
    rows = [
        (1, "http://h/1", page(chrome + "<article><h1>Tea &amp; milk</h1><p>One\n  <b>two</b>.<br>Three<div class='comments'>no"
                               "</div><form>x</form></article><aside>side</aside><footer>&copy; me</footer>")),
        (2, "http://h/2", "<article><p>Cut off &am"), (3, None, None), (4, "x", ""),
        (5, "http://h/5", page("<article><p>a &lt;b&gt; &#233;<!-- c --></p></article><p>beside</p>")),
        (1, "http://h/1", page("<article>again</article>"))]
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(table(spark, rows)).collect())
    assert got == sorted([(1, "Tea & milk One two. Three"), (2, "Cut off &am"), (3, ""), (4, ""), (5, "a <b> é"), (1, "again")])
    assert html_text.extract(table(spark, rows).limit(0)).count() == 0


def test_repeated_strings_of_a_host_go(spark):
    shared = "read all the news of the day on our site and tell your friends"
    rows = [(i, "http://h/%d" % i, page(f"<div>{shared}</div><div>own words number {i} of this very page, {'x%d ' % i * 9}</div>"))
            for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(table(spark, rows)).collect()}
    for i in range(5):
        assert shared not in got[i] and f"number {i} of" in got[i]


def test_short_odd_and_named_pages(spark):
    """Few words outside an article, names around an article, hidden, camel case, names that only look alike."""
    rows = [(1, "http://a/", "<div>Hello world</div>"), (2, "http://b/", "one two three"),
            (3, "http://c/", "<article><a href=x>see this</a></article>"),
            (4, "http://d/", "<div class='page no-sidebar'><article>kept here</article></div>"),
            (5, "http://e/", "<div class='has-share'><article>and here</article></div>"),
            (6, "http://f/", "<div hidden>not this</div><div>but this</div>"),
            (7, "http://g/", "<article>a<div class='userComments'>c</div><div class='share-price'>p</div>"
                             "<div class=social-policy>q</div><div class=banner-image>r</div><div id=adBox2>s</div></article>"),
            (8, "http://h/", "<div class=sidebar><article>teaser</article></div><article>main</article>"),
            (9, "http://i/", "<div class='page sidebar'><article>only one</article></div>"),
            (10, "http://j/", "<div class=comments><article>a reader</article></div><main>text</main>"),
            (11, "http://k/", "<article>" + "<p>long words " * 60_000 + "</article>"), (12, "", "<p>x"), (None, "u", "<p>y")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(table(spark, rows)).collect()}
    assert got.pop(11) == " ".join(["long words"] * 60_000)
    assert got == {1: "Hello world", 2: "one two three", 3: "see this", 4: "kept here", 5: "and here", 6: "but this",
                   7: "a p q r", 8: "main", 9: "only one", 10: "text", 12: "x", None: "y"}


def hosts(rng):
    """Pages of hosts of several sizes, with and without articles, notices in articles and copies."""
    words = ["w%d" % i for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    rows = []
    for h, (n, article) in enumerate([(1, False), (2, False), (3, False), (12, False), (12, True), (40, True), (40, False)]):
        notice, top = prose(20), prose(9)
        copied = prose(30)
        for i in range(n):
            own = copied if i % 5 == 4 else prose(int(rng.integers(5, 60)))
            parts = [top] if not article else []
            parts += [own, notice] if i % 4 else [own]
            body = "".join(f"<p>{p}</p>" for p in parts)
            rows.append((len(rows), f"http://host{h}/{i}", page(f"<article>{body}</article>" if article else body)))
    return rows


def by_brute_force(rows):
    """The rule on all windows of all pages, without a choice among them."""
    streams = {}
    for i, u, h in rows:
        blocks = html_text.blocks_of(h)
        streams[i] = (u.split("/")[2], blocks, [w for b in blocks for w in b.text.split(" ")])
    sizes, where = {}, {}
    for i, (host, _, words) in streams.items():
        sizes[host] = sizes.get(host, 0) + 1
        for k in range(len(words) - 7):
            where.setdefault((host, *words[k:k + 8]), set()).add(i)
    out = {}
    for i, (host, blocks, words) in streams.items():
        copies = sum(s[2] == words and s[0] == host for s in streams.values())
        free = [b.zone != "text" for b in blocks for _ in b.text.split(" ")]
        gone = [False] * len(words)
        for zone, mine, least in (("text", False, html_text.LONG), ("open", True, html_text.WIDTH)):
            covered = [False] * len(words)
            for k in range(len(words) - 7):
                pages = len(where[(host, *words[k:k + 8])])
                if pages - copies >= max(html_text.LEAST_PAGES[zone] - 1, html_text.LEAST_SHARE[zone] * (sizes[host] - copies)):
                    covered[k:k + 8] = [True] * 8
            k = 0
            while k < len(words):
                end = k
                while end < len(words) and covered[end]:
                    end += 1
                if end - k >= least:
                    first = 0
                    for b in blocks:
                        stop = first + len(b.text.split(" "))
                        part = [j for j in range(first, stop) if k <= j < end]
                        if len(part) >= least or len(part) == stop - first:
                            for j in part:
                                gone[j] |= free[j] == mine
                        first = stop
                k = max(end, k + 1)
        out[i] = " ".join(w for w, g in zip(words, gone) if not g)
    return out


def test_extraction_equals_brute_force(spark):
    rows = hosts(np.random.default_rng(8))
    want = by_brute_force(rows)
    plain = {i: " ".join(b.text for b in html_text.blocks_of(h)) for i, _, h in rows}
    assert sum(want[i] != plain[i] for i in want) > 80 and sum(want[i] == plain[i] for i in want) > 3
    for small_rows in (html_text.SMALL_ROWS, 10):  # names broadcast, and joined to each page
        got = {r["page_id"]: r["text"] for r in
               html_text.extract(table(spark, rows).repartition(3), small_rows=small_rows).collect()}
        assert got == want


def test_large_hosts_have_the_same_rule(spark):
    """A notice on a quarter of 1,000 pages goes as it does on a quarter of 100; one on four pages stays on both."""
    rng = np.random.default_rng(9)
    words = ["w%d" % i for i in range(5000)]
    for n in (100, 1000):
        often, seldom = " ".join(rng.choice(words, 12)), " ".join(rng.choice(words, 12))
        rows = [(i, f"http://h/{i}", page(f"<div>{' '.join(rng.choice(words, 30))}</div>"
                                          + f"<div>{often}</div>" * (i % 4 == 0) + f"<div>{seldom}</div>" * (i < 4)))
                for i in range(n)]
        got = {r["page_id"]: r["text"] for r in html_text.extract(table(spark, rows).repartition(7)).collect()}
        assert not any(often in t for t in got.values())
        assert all(seldom in got[i] for i in range(4)) and all(len(t.split()) == 30 + 12 * (i < 4) for i, t in got.items())
