"""Hosts: endings, international names, suffix rules."""

from pyspark.sql import functions as F

from tracewell.functions import hosts
from tracewell.functions import text as T
from tracewell.operators import facts, resolution


def found(spark, *texts):
    lines = spark.createDataFrame([(1, n, t) for n, t in enumerate(texts, 1)], "doc_id int, line_number int, text string")
    return facts.extract(lines, ("URL", "DOMAIN"))


def test_known_endings(spark):
    rows = [("a.shop", True), ("a.com", True), ("com", False), ("a.xyz", True), ("a.in", True), ("a.invalid", False), ("a.xn--p1ai", True), ("a.рф", True), ("1.2.3.4", False), (None, None)]
    got = spark.createDataFrame(rows, "h string, want boolean").select(hosts.known_ending(F.col("h")).alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_unlisted_endings_stay_facts(spark):
    rows = found(spark, "see https://Pay.Unlisted/a/?utm_source=x and", "pay.unlisted/a or pay.xyz/a", "https://localhost/x http://user@a.com/ http://1.2.3.4/b").collect()
    got = sorted((r.line_number, r.field_type, r.raw_value, r.normalized_value, r.known) for r in rows)
    assert got == sorted([
        (1, "URL", "https://Pay.Unlisted/a/?utm_source=x", "https://pay.unlisted/a", False), (1, "DOMAIN", "Pay.Unlisted", "pay.unlisted", False),
        (2, "URL", "pay.unlisted/a", None, False), (2, "URL", "pay.xyz/a", "https://pay.xyz/a", True), (2, "DOMAIN", "pay.xyz", "pay.xyz", True),
        (3, "URL", "https://localhost/x", None, False), (3, "URL", "http://user@a.com/", None, True), (3, "DOMAIN", "a.com", "a.com", True), (3, "URL", "http://1.2.3.4/b", "http://1.2.3.4/b", True),
    ], key=lambda r: r)
    edges = facts.hosted_on(found(spark, "see https://Pay.Unlisted/a/?utm_source=x and"))
    assert [(r.url, r.host) for r in edges.collect()] == [("https://pay.unlisted/a", "pay.unlisted")]


def test_international_names(spark):
    rows = found(spark, "https://Bücher.Example/a", "http://xn--bcher-kva.example:80/", "https://日本.例え.jp/x?q=1", "https://xn--zzzz.example/ and https://xn--a.example/").collect()
    got = sorted((r.line_number, r.field_type, r.normalized_value, r.punycode) for r in rows)
    assert got[:6] == [
        (1, "DOMAIN", "bücher.example", "xn--bcher-kva.example"), (1, "URL", "https://xn--bcher-kva.example/a", None),
        (2, "DOMAIN", "bücher.example", "xn--bcher-kva.example"), (2, "URL", "http://xn--bcher-kva.example/", None),
        (3, "DOMAIN", "日本.例え.jp", "xn--wgv71a.xn--r8jz45g.jp"), (3, "URL", "https://xn--wgv71a.xn--r8jz45g.jp/x?q=1", None),
    ]
    edges = facts.hosted_on(found(spark, "https://Bücher.Example/a", "http://xn--bcher-kva.example/"))
    assert sorted((r.url, r.host) for r in edges.collect()) == [("http://xn--bcher-kva.example/", "bücher.example"), ("https://xn--bcher-kva.example/a", "bücher.example")]
    assert hosts.label_to_ascii("x" * 64) is None and hosts.label_to_unicode("xn--\udc80") == "xn--\udc80"
    for label in ("bücher", "straße", "日本語", "εχαμπλε", "plain", "faß-bar"):
        assert hosts.label_to_unicode(hosts.label_to_ascii(label)) == label


RULES = ["com", "co.uk", "uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", " Shop.Example "]


def plain(host):
    """The longest rule, an exception first."""
    labels = host.lower().split(".")
    tails = [".".join(labels[-n:]) for n in range(1, len(labels) + 1)]
    rules = {r.strip().lower() for r in RULES}
    known = [n for n, t in enumerate(tails, 1) if t in rules or n > 1 and "*." + tails[n - 2] in rules]
    excepted = [n - 1 for n, t in enumerate(tails, 1) if "!" + t in rules]
    n = max(excepted or known or [1])
    return (host.lower(), tails[n - 1], tails[n] if len(labels) > n else None, bool(excepted or known))


def test_registrable_domains(spark):
    names = ["example.com", "a.b.example.com", "com", "x.co.uk", "co.uk", "a.b.ck", "b.ck", "www.ck", "x.www.ck", "c.kobe.jp", "b.c.kobe.jp", "a.b.c.kobe.jp", "city.kobe.jp", "www.city.kobe.jp", "X.Shop.example", "one.unlisted", "unlisted"]
    table = spark.createDataFrame([(n, 1) for n in names + names[:3]] + [(None, 1), ("", 1)], "host string, n int")
    got = hosts.registrable(table, spark.createDataFrame([(r,) for r in RULES], "rule string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted({plain(n) for n in names})
    assert hosts.registrable(table.limit(0), spark.createDataFrame([], "rule string")).count() == 0


def test_bare_unlisted_hosts_are_unmerged(spark):
    rows = found(spark, "go to pay.unlisted/a").selectExpr("1 AS case_id", "doc_id AS fact_id", "field_type", "raw_value", "normalized_value", "CAST(NULL AS STRING) AS corrected_value", "'NORMALIZED' AS status", "'PROCESSED' AS evidence_status", "1 AS evidence_no")
    assert resolution.unmerged(rows).count() == 1
    assert T.normal_url is not None
