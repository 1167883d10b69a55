"""URL classes, whitening and ranked search against brute force: nulls, empty and long values, ties, repeated rows, clashing names."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from furlong.llm import aliases, lexical, queries, whitening
from furlong.llm.aliases import Rule

rng = np.random.default_rng(11)


# --- URL filters


RULES = [Rule("com", "/", "allow"), Rule("bad.org", "/", "block"), Rule("net", "/es/", "block"), Rule("good.bad.org", "/", "allow")]
CANON = '<html><head><LINK HREF="{}" rel="nofollow Canonical"></head></html>'
FRESH = "<meta content=\"0; url='{}'\" HTTP-EQUIV=Refresh>"
PAGES = [
    (1, "https://a.info/x", CANON.format("http://bad.org/y#f")), (2, "http://a.info/x/?utm_source=feed", None), (3, "https://a.info:443/x#top", ""),
    (4, "https://b.info/p", FRESH.format("../q")), (5, "https://b.info/q", CANON.format("//c.info/r")), (6, "https://c.info/r", None),
    (7, "https://c.info/r?page=2", "<!-- " + CANON.format("http://bad.org/") + " -->"), (8, "https://d.info/", CANON.format("https://sub.bad.org/z")), (9, "https://e.info/", CANON.format("https://d.info")),
    (10, "https://e.info", CANON.format("https://x.com/ok")), (11, None, CANON.format("http://bad.org/")), (12, "no scheme", None), (13, "", None), (14, "https://h.net/es/1", None),
    (15, "https://GOOD.bad.org/1", None), (16, "https://h.net/en/1", CANON.format("https://h.net/es/1")), (None, "https://a.info/x", None), (1, "https://a.info/x", None),
    (17, "https://h.net/fr/" + "v" * 50_000, None), (18, "https://z.info/", CANON.format("http://[bad")), (19, "https://w.info/a", None), (20, "ftp://k.info/1", None),
]
REDIRECTS = [("https://w.info/a", "https://w.info/b"), ("https://w.info/c", "https://w.info/b"), ("https://w.info/c", "https://bad.org/"), (None, "https://bad.org/"), ("https://k.info/1", None)]


def brute_urls(pages, redirects):
    """Verdicts from the definition: links by hand, classes by repeated passes."""

    def parts(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0], rest

    def name(u):
        host, path, rest = parts(u)
        query = rest.split("#")[0].partition("?")[2]
        args = "&".join(a for a in query.split("&") if a and not a.startswith("utm_"))
        return re.sub(":(80|443)$", "", host) + path.rstrip("/") + ("?" + args if args else "") if host else None

    def rule(u):
        host, path, _ = parts(u)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path)) if fits else None

    links = [("https://a.info/x", "http://bad.org/y"), ("https://b.info/p", "https://b.info/q"), ("https://b.info/q", "https://c.info/r"), ("https://d.info/", "https://sub.bad.org/z"),
             ("https://e.info/", "https://d.info"), ("https://e.info", "https://x.com/ok"), ("https://h.net/en/1", "https://h.net/es/1")] + [r for r in redirects if None not in r]
    urls = {p[1] for p in pages} | {u for link in links for u in link}
    group = {name(u): name(u) for u in urls if name(u)}
    for _ in group:
        for a, b in links:
            group[name(a)] = group[name(b)] = min(group[name(a)], group[name(b)])
    says = {}
    for u in urls:
        if name(u) and rule(u):
            says.setdefault(group[name(u)], set()).add(rule(u).verdict)
    out = []
    for i, u, _ in pages:
        r = rule(u)
        out.append((i, parts(u)[0], parts(u)[1], r.host + r.path if r else None, r.verdict if r else "block" if says.get(group.get(name(u))) == {"block"} else "allow"))
    return Counter(out)


def test_url_classes(spark):
    pages = spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, host string, class int")
    redirects = spark.createDataFrame(REDIRECTS, "url string, target string")
    got = aliases.filter_urls(pages, RULES, redirects)
    rows = got.collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows) == brute_urls(PAGES, REDIRECTS)
    told = {(r.page_id, r.verdict, r.via) for r in rows}
    assert {(1, "block", "alias"), (2, "block", "alias"), (4, "allow", "none"), (10, "allow", "none"), (16, "block", "alias"), (19, "block", "alias"), (15, "allow", "rule")} <= told


def test_url_allow_precedence(spark):
    pages = spark.createDataFrame([(1, "https://q.info/", CANON.format("https://bad.org/")), (2, "https://q.info", CANON.format("https://x.com/"))], "page_id long, url string, html string")
    assert {r.verdict for r in aliases.filter_urls(pages, RULES).collect()} == {"allow"}
    assert {r.verdict for r in aliases.filter_urls(pages.filter("page_id = 1"), RULES).collect()} == {"block"}


def test_url_hub_and_edges(spark):
    """A chain and a star of aliases, one url in a third of all rows; no rules; an empty table."""
    chain = [(i, f"https://s.info/{i}", CANON.format(f"https://s.info/{i + 1}")) for i in range(12)]
    star = [(100 + i, f"https://t.info/{i}", CANON.format("https://s.info/0")) for i in range(60)]
    same = [(300 + i, "https://s.info/7/", None) for i in range(60)]
    pages = spark.createDataFrame([*chain, *star, *same], "page_id long, url string, html string")
    got = aliases.filter_urls(pages, [Rule("s.info", "/12", "block")])
    assert got.filter("verdict = 'block'").count() == 132
    assert aliases.filter_urls(pages, []).filter("verdict = 'block'").count() == 0
    assert aliases.filter_urls(pages.filter("page_id < 0"), RULES).count() == 0
    with pytest.raises(ValueError, match="verdict"):
        aliases.filter_urls(pages, [Rule("a", "/", "maybe")])


def test_op11_oracle(spark):
    """The query against its SQL, with the table that it reads (test_oracles gives DuckDB documents and benchmark only)."""
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got, want = queries.QUERIES["op11_redirect_classes"](spark, sf).toPandas(), con.sql(queries.ORACLE_SQL["op11_redirect_classes"]).df()
    key = sorted(want.columns)
    assert sorted(got.columns) == key and len(want) > 0
    rows = lambda f: sorted(map(str, f[key].astype(object).where(f[key].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


# --- whitening


def test_factor_and_rotations():
    for d, rank in ((1, 1), (7, 7), (8, 3), (33, 33)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-2, 3, rank)
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert np.allclose(factor @ factor.T, a, rtol=0, atol=1e-10 * np.abs(a).max())
        values, vectors = whitening.one_sided_jacobi(factor)
        want = np.linalg.eigvalsh(a)[::-1]
        assert np.allclose(values[:rank], want[:rank], rtol=1e-9, atol=1e-9 * want[0])
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-8
    assert whitening.pivoted_cholesky(np.zeros((4, 4))).shape == (4, 0)


def test_whitening(spark):
    base = rng.normal(size=(90, 5)) @ rng.normal(size=(5, 12)) * 0.2 + rng.normal(size=(90, 12)) * 0.02 + 3
    rows = [(i, [float(x) for x in v], "k", 1) for i, v in enumerate(base)]
    rows += [(200, None, "k", 1), (201, [1.0] * 11 + [None], "k", 1), (202, [1.0] * 11 + [float("nan")], "k", 1), (203, [float("inf")] * 12, "k", 1), (204, [], "k", 1), (205, [1.0] * 4, "k", 1), (None, rows[3][1], "k", 1), (3, rows[3][1], "k", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, component int").repartition(5)
    got = whitening.whiten(df, k=4).collect()
    kept = [(i, np.floor(1024 * np.float32(v).astype(float)).astype(int) + 100_000) for i, v, *_ in rows if v is not None and len(v) == 12 and None not in v and np.isfinite(v).all()]
    x = np.array([v for _, v in kept])
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert Counter(r.deviation for r in got if r.component == 1) == Counter(int((d.astype(object) ** 2).sum()) for d in n * x - sums)
    for c in range(1, 5):
        own = sorted((r.deviation, r.whitened) for r in got if r.component == c)
        want = (y @ vectors[:, c - 1]) / math.sqrt(values[c - 1])
        want = sorted(zip((((n * x - sums) ** 2).sum(1)).tolist(), want.tolist(), strict=True))
        a, b = np.array([w for _, w in own]), np.array([w for _, w in want])
        assert min(np.abs(np.sort(a) - np.sort(s * b)).max() for s in (1, -1)) < 1e-8
        assert [r.explained for r in got if r.component == c] == pytest.approx([values[c - 1] / values.sum()] * n, rel=1e-9)


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.filter("vec_id < 0")).count() == 0
    line = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


# --- ranked search


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    tfs = [Counter(terms(t)) for _, t in docs]
    big_n, big_l = sum(1 for c in tfs if c), sum(sum(c.values()) for c in tfs)
    df = Counter(w for c in tfs for w in c)
    out = Counter()
    for i, text in items:
        found = []
        for (d, _), c in zip(docs, tfs, strict=True):
            m = 10 + 90 * sum(c.values()) * big_n // big_l if c else 0
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        out += Counter((i, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k]))
    return out


WORDS = np.array([f"w{i}" for i in range(200)])
SHARE = 1 / np.arange(1, 201)


def prose(n):
    return " ".join(rng.choice(WORDS, n, p=SHARE / SHARE.sum()))


COPY = prose(30)
DOCS = [(i, prose(int(n))) for i, n in enumerate(rng.integers(1, 60, 400))]
DOCS += [(500 + i, COPY) for i in range(40)] + [(900, None), (901, ""), (902, "--- ...\n"), (None, COPY), (None, prose(20)), (7, COPY), (903, "Grüße_W1-W2 w3日本語"), (904, prose(3000)), (905, "w5" * 4000)]
ITEMS = [(1, prose(20)), (2, COPY), (3, None), (4, ""), (5, "nowhere"), (6, "W1 w1"), (6, prose(40)), (None, prose(5)), (8, "grüße w3日本語"), (9, prose(400))]


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    """Small shards, leaves and windows, and several blocks of items, give the same rows as large ones."""
    block = lexical.BLOCK
    if small:
        monkeypatch.setattr(lexical, "SHARD", 300)
        monkeypatch.setattr(lexical, "LEAF", 2)
        monkeypatch.setattr(lexical, "WINDOW", 50)
        monkeypatch.setattr(lexical, "LOOKUPS", 60)
        block = 1500
    lexical_docs = spark.createDataFrame([(*d, "k", 1) for d in DOCS], "doc_id long, text string, score string, rank int").repartition(3)
    items = spark.createDataFrame([(*i, "k") for i in ITEMS], "item_id long, text string, doc_id string")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank_documents(lexical_docs, items, block=block).collect())
    assert got == brute_search(DOCS, ITEMS, 10)


def test_search_parts():
    """Bounds, range maxima and exhaustive search of one shard, with module settings as they are and as small as can be."""
    n, v = 150, 12
    dense = np.where(rng.random((n, v)) < 0.3, rng.integers(1, 50, (n, v)), 0)
    doc, term = np.nonzero(dense)
    ids = rng.permutation(1000)[:n]
    shard = lexical.Shard(ids, dense[doc, term], doc, term)
    dense = dense[np.argsort(ids)]
    for _ in range(300):
        t, (a, b) = int(rng.integers(v)), sorted(rng.integers(0, n, 2).tolist())
        lo, hi = shard.range(np.array([t]), np.array([a]), np.array([b]))
        assert (hi - lo)[0] == (dense[a:b, t] > 0).sum()
        if lo < hi:
            assert shard.impact[shard.top(lo, hi)[0]] == dense[a:b, t].max()
    weight = rng.integers(1, 9, v)
    search = lexical.Search(np.arange(v), np.array([0, v]), weight, 5)
    bound, split = search.bounds(shard, np.array([0]), np.array([10]), np.array([90]))
    assert bound[0] == (dense[10:90].max(0) * weight).sum() and 10 <= split[0] < 90
    search.run(shard, np.array([0]))
    want = sorted(zip((-dense @ weight).tolist(), np.sort(ids).tolist(), strict=True))[:5]
    assert list(zip((-search.score[0]).tolist(), search.id[0].tolist(), strict=True)) == want


def test_search_windows():
    data = np.frombuffer(b"aa bb ccccccc,ddd  e" * 3, np.uint8)
    offs = np.array([0, 0, 20, 33, 60])
    cuts = list(lexical.windows(data, offs, 4))
    assert cuts[0][0] == 0 and cuts[-1][1] == 60 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert all(b in offs or not lexical.IS_TERM[data[b]] or not lexical.IS_TERM[data[b - 1]] for _, b in cuts)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame(DOCS[:5], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert lexical.rank_documents(docs.filter("doc_id < 0"), items).count() == 0
    assert lexical.rank_documents(docs, items.filter("item_id < 0")).count() == 0


@pytest.mark.parametrize("name", ["op11_redirect_classes", "op13_interval_search"])
def test_registered_with_an_oracle(name):
    assert name in queries.QUERIES and name in queries.ORACLE_SQL
