"""URL rules against a slow version."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cohortline.llm import url_rules as U

RULES = [U.ListRule("net", "/", "block"), U.ListRule("example.net", "/en/", "allow")]


def slow(pages, bad, least, confidence):
    """Host, path, rule, verdict and mined tokens by looking at every set of tokens of every labelled URL."""
    import re

    def parse(url):
        found = re.match(r"(?s:.*?)://([^/?#]*)([^?#]*)", url or "")
        host, path = found.groups() if found else ("", "")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path

    def words(host, path):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in path)
        split = lambda x: [w for w in re.split(r"[./:@_-]+", x) if w]
        return ["h:" + w for w in split(host)], ["p:" + w for w in split(low)]

    counts = {}
    for page, url in set(pages):
        if page in bad:
            h, p = words(*parse(url))
            items = sorted(set(h[::-1][:6] + p[:6]))
            for n in range(1, len(items) + 1):
                for part in combinations(items, n):
                    c = counts.setdefault(part, [0, 0])
                    c[0] += 1
                    c[1] += bad[page]
    rules = {k: b / n for k, (n, b) in counts.items() if b >= least and b / n >= confidence}
    rules = {k: v for k, v in rules.items() if not any(set(q) < set(k) for q in rules)}
    out = []
    for page, url in pages:
        host, path = parse(url)
        h, p = words(host, path)
        fits = [(len(r.text), r.text, r.verdict) for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        hit = max(((v, " ".join(k)) for k, v in rules.items() if set(k) <= set(h + p)), default=(0, None))[1]
        _, rule, says = max(fits, default=(0, None, None))
        out.append((page, host, path, rule, says or ("block" if hit else "allow"), hit))
    return sorted(out, key=repr)


def pages():
    rows = []
    for i in range(400):
        kind = i % 8
        host = ["casino-win", "news", "www.shop", "blog"][kind % 4] + f"{'' if kind % 4 == 0 else i % 3}" + [".example.com", ".example.org", ".example.net"][i % 3]
        rows.append((i, f"http{'s' * (i % 2)}://{host}/{['en', 'de', 'ads'][i % 3]}/{['deal', 'item'][kind // 4]}-{i}.html?x=http://casino.com/#a"))
    odd = ["", None, "no scheme", "http://", "ftp://NET", "http://net/", "HTTP://User@WWW.Example.NET:80/EN/x", "x://example.net/en/y", "http://a.net?q", "http://b.net#f",
           "mailto:x", "http://é.Österreich.com/Ä/a b\n?c", "http://a/" + "w/" * 5000, "a://b://casino/x", "http://notnet/", "http://net.org/ads"]
    return rows + [(1000 + i, u) for i, u in enumerate(odd)] + [(None, "http://casino.org/"), *rows[:3]]


@pytest.mark.parametrize("small", [True, False])
def test_equals_slow_version(spark, monkeypatch, small):
    """With a broadcast index and hits, and with joins by shuffle."""
    if not small:
        monkeypatch.setattr(U, "BROADCAST_RULES", -1)
        monkeypatch.setattr(U, "BROADCAST_HITS", -1)
    rows = pages()
    bad = {i: (i % 4 == 0 and i % 5 != 0) or (i % 3 == 2 and i % 8 >= 4) for i in range(0, 400) if i % 11}
    frame = spark.createDataFrame([(i, u, "x", "y", 1, "z") for i, u in rows], "page_id long, url string, host string, token string, row int, items string")
    labels = spark.createDataFrame(list(bad.items()), "page_id long, bad boolean")
    got = U.judged(frame, labels, RULES, least_rows=10, confidence=0.7)
    got = sorted([tuple(r) for r in got.collect()], key=repr)
    want = slow(rows, bad, 10, 0.7)
    assert got == want
    assert any(r[5] and r[5].count(" ") for r in want) and any(r[4] == "block" and r[3] is None for r in want)


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "http://x.net/a"), (2, "http://x.com/a"), (3, None)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["mined"]) for r in U.judged(frame, none, RULES).collect()}
    assert got == {1: ("net/", "block", None), 2: (None, "allow", None), 3: (None, "allow", None)}
    assert U.judged(frame.limit(0), none, RULES).count() == 0
    good = spark.createDataFrame([(1, False), (2, None)], "page_id long, bad boolean")
    assert U.judged(frame, good, RULES, least_rows=1).where(F.col("mined").isNotNull()).count() == 0


def test_every_word_is_mined(spark):
    """Rules of words behind the twentieth, and many words that always come together."""
    common = "http://h.com/" + "".join(f"w{i}/" for i in range(20))
    kinds = [("spam", True), ("u/v/x", True), ("u/v", False), ("x", False)]
    rows = [(20 * n + i, common + tail, bad) for n, (tail, bad) in enumerate(kinds) for i in range(20)] + [(200 + i, "http://q.com/", False) for i in range(5)]
    asked = {900: "http://z.org/spam", 901: "http://z.org/u/x", 902: "http://z.org/x/v", 903: "http://z.org/u/v", 904: "http://z.org/x/w1"}
    frame = spark.createDataFrame([(k, u) for k, u, _ in rows] + list(asked.items()), "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, _, b in rows], "page_id long, bad boolean")
    got = {r["page_id"]: r["mined"] for r in U.judged(frame, labels, RULES, least_rows=10, confidence=0.6).collect()}
    assert [got[k] for k in asked] == ["p:spam", "p:u p:x", "p:v p:x", None, None]
    assert {got[k] for k in range(20)} == {"p:spam"} and {got[k] for k in range(40, 85) if k in got} == {None}
