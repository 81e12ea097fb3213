import random
import re
import time

from sondage.llm import htmltext as H

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>if (a < b) {}</script></head><body>
<nav><ul><li><a href="/">Home page of the site</a></li></ul></nav>
<div class="Post-12 entry"><h1>Title &amp; more</h1><p>First <b>bold</b> line<br>second<p>Third {n}</div>
<!-- <p>hidden</p> --><footer>Copyright notice of the site</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, host int, path string")


def test_votes_and_text():
    assert max(H.votes(PAGE), key=H.votes(PAGE).get) == "page>html>body>div.entry.post"
    text, path = H.extract(PAGE, None)
    assert path == "page>html>body>div.entry.post" and text == "Title & more\nFirst bold line\nsecond\nThird {n}"


def test_hosts_agree(spark):
    odd_one = PAGE.replace("Third {n}", "").replace("Copyright notice of the site", "Copyright " * 60)
    rows = [(k, f"https://a.example/{k}?x#y", PAGE.replace("{n}", "text " * 20)) for k in range(4)] + [(9, "http://A.example:80/odd", odd_one)]
    got = {r["page_id"]: r for r in H.main_texts(pages(spark, rows)).collect()}
    assert {r["path"] for r in got.values()} == {"page>html>body>div.entry.post"} and {r["host"] for r in got.values()} == {"a.example"}
    assert got[9]["text"].startswith("Title & more")


def test_odd_pages(spark):
    deep = "<div>" * 20000 + "deep"
    rows = [(1, None, None), (2, None, ""), (3, "no url", "plain text"), (4, "http://b.example/", deep), (5, "http://c.example/", "<p>open <b>never closed <!-- gone"), (5, "http://c.example/", "<p>open <b>never closed <!-- gone"), (None, "http://d.example/", "<div>x</div>"), (6, "http://e.example/", "</div></p>a < b <script>x"), (7, "http://f.example/", "<" * 100000)]
    got = [(r["page_id"], r["host"], r["text"]) for r in H.main_texts(pages(spark, rows)).collect()]
    assert len(got) == len(rows)
    by = dict((i, t) for i, _, t in got)
    assert by[1] is None and by[2] == "" and by[3] == "plain text" and by[4] == "deep" and by[5] == "open never closed" and by[None] == "x" and by[6] == "a < b"
    assert H.main_texts(pages(spark, rows).limit(0)).count() == 0


def test_ties_go_to_the_path_that_sorts_first(spark):
    page = "<body><div class=b>same size</div><div class=a>same size</div></body>"
    assert H.host_paths(pages(spark, [(1, "http://x.example/", page)])).first()["path"] == "page>body>div.a"
    assert H.extract(page, "page>body>div.a")[0] == "same size"


def test_whole_pages_equal_a_plain_reading(spark, sf):
    import re

    for r in H.query(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        plain = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", article)).strip()
        import html

        assert " ".join(r["text"].split()) == " ".join(html.unescape(plain).split())


def random_tree(rng, depth=0):
    """(tag, classes, children): children are trees, texts, or links as one-tuples."""
    tag = rng.choice(["div", "div", "section", "article", "nav", "ul", "aside"]) if depth else "body"
    classes = rng.sample(["post", "entry", "menu", "c1", "c22", "x", "sidebar", "wide", "z9"], rng.choice([0, 0, 1, 2, 5])) if depth else []
    children = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.random()
        words = " ".join(rng.choice(["some", "words", "of", "text", "here", "longer-one"]) for _ in range(rng.randint(1, 12)))
        if kind < 0.45 and depth < 7:
            children.append(random_tree(rng, depth + 1))
        elif kind < 0.6:
            children.append((words,))
        else:
            children.append(words)
    return tag, classes, children


def render(tree):
    tag, classes, children = tree
    inner = "".join(f"<a href=x>{c[0]}</a>" if isinstance(c, tuple) and len(c) == 1 else f"<p>{c}</p>" if isinstance(c, str) else render(c) for c in children)
    return f'<{tag} class="{" ".join(classes)}">{inner}</{tag}>' if classes else f"<{tag}>{inner}</{tag}>"


def plain_votes(tree):
    """Votes from the tree itself, without reading any page."""
    scores, boring = {}, re.compile(r"(^|[.])(nav|aside|menu|sidebar)([.]|$)")

    # Every container is told by its place among all, in order of opening.
    counter = iter(range(10**6))

    def visit(node, ids, steps):
        ids = [*ids, next(counter)]
        steps = [*steps, ".".join([node[0], *sorted({c.strip("0123456789") for c in node[1]})])]
        for c in node[2]:
            if isinstance(c, tuple) and len(c) == 3:
                visit(c, ids, steps)
                continue
            size = -len(c[0]) if isinstance(c, tuple) else len(c)
            for up, part in enumerate((1, 2, 4)):
                k = len(ids) - 1 - up
                if k < 0:
                    break
                entry = scores.setdefault(ids[k], [0, steps[: k + 1]])
                entry[0] += size // part
                if boring.search(steps[k]):
                    break

    visit(("page", [], [tree]), [], [])
    paths = {}
    for score, steps in scores.values():
        if score > 0:
            path = ">".join(steps[-H.PATH_STEPS :])
            paths[path] = paths.get(path, 0) + (score // 5 if boring.search(steps[-1]) else score)
    whole = sum(paths.values())
    return {p: H.VOTES * s // whole for p, s in paths.items() if s}


def test_votes_equal_those_of_the_tree_itself(spark):
    rng = random.Random(6)
    rows, sums = [], {}
    for k in range(150):
        tree = random_tree(rng)
        page, want = render(tree), plain_votes(tree)
        assert H.votes(page) == want, page
        host = f"h{k % 7}.example"
        rows.append((k, f"http://{host}/{k}", page))
        for p, v in want.items():
            sums.setdefault(host, {}).setdefault(p, 0)
            sums[host][p] += v
    got = {r["host"]: (r["path"], r["votes"]) for r in H.host_paths(pages(spark, rows)).collect()}
    assert got == {h: min(x.items(), key=lambda i: (-i[1], i[0])) for h, x in sums.items()}


def test_time_grows_with_the_length_alone():
    def seconds(page):
        best = 9.9
        for _ in range(3):
            began = time.process_time()
            H.extract(page, "page>div")
            H.votes(page)
            best = min(best, time.process_time() - began)
        return best

    hostile = (
        lambda n: "<b>x" * n, lambda n: "<div>x" * n, lambda n: "<a><i>x</b>" * n, lambda n: "<p>x<br>" * n, lambda n: "<ul><li>x" * n, lambda n: "<div class='" + "k " * n + "'>" + "<div>x</div>" * n,
        lambda n: "<div class=" + "k" * n + ">" + "<div>x" * n, lambda n: "</div>" * n, lambda n: "<!--" * n, lambda n: "<script>" * n, lambda n: "<div><b>x</div>" * n,
    )
    for make in hostile:
        one, two = seconds(make(8000)), seconds(make(16000))
        assert two < 3.2 * max(one, 0.02), (make(2), one, two)
