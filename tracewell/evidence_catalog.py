"""Queries over laid-out text, hosts, mail, timelines, rules, sources, sketches and kept analyses, with their SQL.

As in ``case_catalog`` keys of the driver tables stand in for cases. Where a text has to be laid out or mailed first, the rule for it is
the same in both languages; what is then found in it is worked out by each for itself.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .case_catalog import ORACLE_SQL, QUERIES, query, read  # noqa: F401
from .catalog import URL_SQL, word_cards
from .catalog import WHITE as SPACE
from .functions import hosts, sql
from .functions import text as T
from .operators import facts, lines, relational, relations, sketches
from .plans import analysis, case, constraints, graph, lifecycle, rules
from .sources import items, layout, mail
from .streaming import limiter

# ---- positioned text

def laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The words of each page as items: seven places a row, fifty rows a sheet, baselines that waver by a third of a unit."""
    k, word = F.col("ordinal"), F.col("text")
    words = read(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.posexplode_outer(F.regexp_extract_all("html", F.lit("[A-Za-z]+"), F.lit(0))).alias("ordinal", "text")).where("ordinal is not null")
    x = (k % 350) % 7 * F.lit(4.0) + (k * 13) % 10 * F.lit(0.1)
    texts = words.select("item_id", (F.floor(k / 350) + 1).cast("int").alias("page"), "ordinal", x.alias("x"), (F.floor((k % 350) / 7) * F.lit(0.6) + (k * 37) % 5 * F.lit(0.08)).alias("y"), (x + F.length(word) * F.lit(0.4)).alias("end_x"), (k % 3 * 2 + 8).cast("double").alias("size"), "text")
    return texts, texts.select("item_id", "page", F.lit(30.0).alias("width"), F.lit(32.0).alias("height")).distinct()


LAID = """WITH RECURSIVE w AS (SELECT page_id AS item_id, unnest(regexp_extract_all(html, '[A-Za-z]+')) AS t, generate_subscripts(regexp_extract_all(html, '[A-Za-z]+'), 1) - 1 AS k FROM pages),
i AS (SELECT item_id, k // 350 + 1 AS page, k, ((k % 350) % 7) * 4.0::DOUBLE + ((k * 13) % 10) * 0.1::DOUBLE AS x, ((k % 350) // 7) * 0.6::DOUBLE + ((k * 37) % 5) * 0.08::DOUBLE AS y, (k % 3) * 2 + 8 AS size, t FROM w),
p AS (SELECT *, x + length(t) * 0.4::DOUBLE AS e FROM i),
b AS (SELECT DISTINCT item_id, page, y FROM p),
s AS (SELECT item_id, page, min(y) AS y FROM b GROUP BY ALL UNION ALL SELECT s.item_id, s.page, min(b.y) FROM s JOIN b ON b.item_id = s.item_id AND b.page = s.page AND b.y - s.y > 0.25 GROUP BY s.item_id, s.page),
n AS (SELECT item_id, page, y, row_number() OVER (PARTITION BY item_id, page ORDER BY y) AS line_number FROM s),
g AS (SELECT item_id, page FROM p GROUP BY ALL HAVING sum(length(t)) < 10),
a AS (SELECT p.*, n.line_number FROM p ASOF JOIN n ON p.item_id = n.item_id AND p.page = n.page AND p.y >= n.y WHERE p.item_id NOT IN (SELECT item_id FROM g)),
l AS (SELECT *, CASE WHEN x - lag(e) OVER (PARTITION BY item_id, page, line_number ORDER BY x, y, k) > 0.1 THEN ' ' ELSE '' END || t AS part FROM a)"""


@query(LAID + """ SELECT item_id, page, line_number, string_agg(part, '' ORDER BY x, y, k) AS text, round(min(x) / 30, 6) AS x, round(min(y) / 32, 6) AS y, round(least(1, (max(e) - min(x)) / 30), 6) AS w, round(max(size) / 16 / 32, 6) AS h FROM l GROUP BY item_id, page, line_number""")
def positioned_rows(spark, sf_dir):
    found, _ = layout.text_rows(*laid_out(spark, sf_dir))
    return found.select("item_id", "page", "line_number", "text", *[F.round(c, 6).alias(c) for c in "xywh"])


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS page, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
SELECT doc_id AS item_id, string_agg(page, ',' ORDER BY page) AS pages FROM l WHERE length(regexp_replace(t, '{SPACE}', '', 'g')) < 10 GROUP BY doc_id""")
def text_layer_gates(spark, sf_dir):
    """Documents whose lines are pages: those with a page that says too little."""
    told = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    texts = told.select("item_id", "page", F.lit(0).alias("ordinal"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("end_x"), F.lit(12.0).alias("size"), "text")
    _, failures = layout.text_rows(texts, told.select("item_id", "page", F.lit(1.0).alias("width"), F.lit(1.0).alias("height")))
    return failures.select("item_id", F.array_join(F.transform("pages_without_text", lambda p: p.cast("string")), ",").alias("pages"))


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn as a recogniser records them: six a line, lines out of order, some of them doubtful."""
    k = F.col("word")
    words = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("block"), F.posexplode(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0))).alias("word", "text"))
    line = F.floor(k / 6)
    return words.select("item_id", "block", line.alias("line"), "word", "text", ((F.length("text") * 7 + k * 13) % 101).cast("double").alias("confidence"), (k % 6 * 100).alias("x0"), (line * 37 % 11 * 20).alias("y0"), (k % 6 * 100 + 80).alias("x1"), (line * 37 % 11 * 20 + 15).alias("y1"), F.lit(700).alias("width"), F.lit(300).alias("height"))


RECORDED = """WITH w AS (SELECT conv_id AS item_id, turn AS block, unnest(regexp_extract_all(text, '[^ \n]+')) AS t, generate_subscripts(regexp_extract_all(text, '[^ \n]+'), 1) - 1 AS k FROM conversations),
l AS (SELECT item_id, block, k // 6 AS line, string_agg(t, ' ' ORDER BY k) AS text, min((length(t) * 7 + k * 13) % 101) / 100 AS confidence, min(k % 6) * 100 AS x0, max(k % 6) * 100 + 80 AS x1, (k // 6) * 37 % 11 * 20 AS y0 FROM w GROUP BY item_id, block, k // 6),
o AS (SELECT * FROM l WHERE item_id IN (SELECT item_id FROM l GROUP BY item_id HAVING sum(length(replace(text, ' ', ''))) >= 10))"""


@query(RECORDED + """ SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY block, y0, x0, line) AS line_number, text, round(confidence, 3) AS confidence, round(x0 / 700, 6) AS x, round(y0 / 300, 6) AS y, round((x1 - x0) / 700, 6) AS w, round(15 / 300, 6) AS h FROM o""")
def recorded_lines(spark, sf_dir):
    found, _ = layout.recorded_lines(recognised(spark, sf_dir))
    return found.select("item_id", "line_number", "text", "confidence", *[F.round(c, 6).alias(c) for c in "xywh"])


@query(RECORDED + """ SELECT item_id, round(min(confidence), 3) AS confidence, CASE WHEN min(confidence) >= 0.85 THEN 'HIGH' WHEN min(confidence) >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM o WHERE length(text) > 45 GROUP BY item_id""")
def recorded_bands(spark, sf_dir):
    """How sure a fact over an item's long lines is: as the least sure of them."""
    found, _ = layout.recorded_lines(recognised(spark, sf_dir))
    sure = facts.confidence(F.array(F.min("confidence")))
    return found.where(F.length("text") > 45).groupBy("item_id").agg(sure.alias("confidence")).withColumn("band", T.confidence_band(F.col("confidence")))


# ---- hosts

RULES = ("com", "net", "org", "example.com", "*.example.net", "!www.example.net", "example.org")


@query(r"""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages), l AS (SELECT host, string_split(host, '.') AS a, len(string_split(host, '.')) AS m FROM h),
r(rule, n, x) AS (VALUES ('com', 1, 0), ('net', 1, 0), ('org', 1, 0), ('example.com', 2, 0), ('example.org', 2, 0)),
c AS (SELECT host, a, m, greatest(coalesce((SELECT max(n) FROM r WHERE '.' || host LIKE '%.' || rule), 0), CASE WHEN host LIKE '%_.example.net' THEN 3 ELSE 0 END) AS n, '.' || host LIKE '%.www.example.net' AS x FROM l),
d AS (SELECT host, a, m, CASE WHEN x THEN 2 WHEN n = 0 THEN 1 ELSE n END AS n, x OR n > 0 AS known FROM c)
SELECT host, array_to_string(a[m - n + 1:], '.') AS public_suffix, CASE WHEN m > n THEN array_to_string(a[m - n:], '.') END AS registrable, known FROM d""")
def registrable_hosts(spark, sf_dir):
    """Registrable domains of the pages' hosts under a table of suffix rules."""
    table = spark.createDataFrame([(r,) for r in RULES], "rule string")
    return hosts.registrable(read(spark, sf_dir, "pages").select(T.url_host(F.col("url")).alias("host")), table)


#: Names and the forms in which they are looked up.
NAMES = (("bücher", "xn--bcher-kva"), ("españa", "xn--espaa-rta"), ("münchen", "xn--mnchen-3ya"), ("日本", "xn--wgv71a"))


@query(URL_SQL + f""", n AS (SELECT page_id, {[a for a, _ in NAMES]}[page_id % 4 + 1] AS name, {[b for _, b in NAMES]}[page_id % 4 + 1] AS code, host, normalized_url FROM u),
d AS (SELECT page_id, CASE WHEN page_id % 3 = 2 THEN host ELSE name || '.' || host END AS domain, CASE WHEN page_id % 3 < 2 THEN code || '.' || host END AS punycode, CASE WHEN page_id % 3 = 2 THEN normalized_url ELSE replace(normalized_url, '://', '://' || code || '.') END AS url FROM n)
SELECT page_id, domain, punycode, url FROM d""")
def international_domains(spark, sf_dir):
    """The pages' URLs under international names, written either way: one domain and one URL for both."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % 4 + 1).cast("int"))
    name = F.when(F.col("page_id") % 3 == 0, F.initcap(pick([a for a, _ in NAMES]))).when(F.col("page_id") % 3 == 1, F.upper(pick([b for _, b in NAMES])))
    url = F.coalesce(F.regexp_replace("url", "://", F.concat(F.lit("://"), name, F.lit("."))), "url")
    said = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("line_number"), url.alias("text"))
    found = facts.extract(said, ("URL", "DOMAIN"))
    of = lambda kind: F.max(F.when(F.col("field_type") == kind, F.col("normalized_value")))
    return found.groupBy(F.col("doc_id").alias("page_id")).agg(of("DOMAIN").alias("domain"), F.max("punycode").alias("punycode"), of("URL").alias("url"))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:^|[^\w.@/:-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}(?:[^\w@-]|$)')) AS m FROM pages),
h AS (SELECT page_id, regexp_extract(m, '(?i)((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})', 1) AS raw FROM t)
SELECT lower(raw) AS host, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM h WHERE regexp_matches(lower(raw), '\.(?:[a-z]{2}|com|net|org|example|info|test)$') GROUP BY lower(raw)""")
def hosts_in_pages(spark, sf_dir):
    """Bare hosts in the markup of all pages."""
    said = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("line_number"), F.col("html").alias("text"))
    found = facts.candidates(said, ("URL",)).where(~F.col("raw_value").rlike("(?i)^https?://"))
    host = T.url_host(F.col("raw_value"))
    return found.where(hosts.known_ending(host)).groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_pages"))


@query(r"""WITH t AS (SELECT 'page' AS source, page_id AS id, html AS text FROM pages UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT source, id, count(*) AS n_emails, count(DISTINCT lower(m)) AS n_different, min(lower(m)) AS first_email FROM (SELECT source, id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}')) AS m FROM t) GROUP BY source, id""")
def emails_everywhere(spark, sf_dir):
    """E-mail addresses in the text of all pages, turns and documents, in one pass over their union."""
    of = lambda table, source, key, text: read(spark, sf_dir, table).select(F.lit(source).alias("source"), key.alias("doc_id"), F.col(text).alias("text"))
    every = of("pages", "page", F.col("page_id"), "html").unionByName(of("conversations", "turn", F.col("conv_id") * 1000 + F.col("turn"), "text")).unionByName(of("documents", "document", F.col("doc_id"), "text"))
    said = every.where(F.col("text").contains("@")).select(F.concat_ws(":", "source", "doc_id").alias("doc_id"), F.lit(1).alias("line_number"), "text")
    found = facts.extract(said, ("EMAIL",))
    per = found.groupBy("doc_id").agg(F.count("*").alias("n_emails"), F.count_distinct("normalized_value").alias("n_different"), F.min("normalized_value").alias("first_email"))
    return per.select(F.substring_index("doc_id", ":", 1).alias("source"), F.substring_index("doc_id", ":", -1).cast("bigint").alias("id"), "n_emails", "n_different", "first_email")


# ---- mail


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in a message: plain, as HTML, beside an attachment, nested, encrypted, or without the headers it needs."""
    n, text = F.col("doc_id") % 6, F.col("text")
    head = lambda kind: F.concat(F.lit("From: A <a@x.example>\r\nSubject: No "), F.col("doc_id"), F.lit(f"\r\nMIME-Version: 1.0\r\nContent-Type: {kind}\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"))
    part = lambda edge, kind, body: F.concat(F.lit(f"--{edge}\r\nContent-Type: {kind}\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), body, F.lit("\r\n"))
    plain, page, other = 'text/plain; charset="utf-8"', 'text/html; charset="utf-8"', 'text/csv; name="t.csv"\r\nContent-Disposition: attachment; filename="t.csv"'
    made = (
        F.when(n == 0, F.concat(head(plain), text))
        .when(n == 1, F.concat(head(page), F.lit("<p>"), F.regexp_replace(text, "\n", "<br>"), F.lit("</p>")))
        .when(n == 2, F.concat(head('multipart/mixed; boundary="b"'), part("b", plain, text), part("b", other, F.lit("a,b,c")), F.lit("--b--\r\n")))
        .when(n == 3, F.concat(head('multipart/mixed; boundary="b"'), F.lit('--b\r\nContent-Type: multipart/alternative; boundary="c"\r\n\r\n'), part("c", page, F.lit("<p>not this</p>")), part("c", plain, text), F.lit("--c--\r\n"), part("b", other, F.lit("12")), part("b", other, F.lit("3")), F.lit("--b--\r\n")))
        .when(n == 4, F.concat(head('multipart/encrypted; boundary="b"'), text))
        .otherwise(F.concat(F.lit("To: b@x.example\r\n\r\n"), text))
    )
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), made.alias("content"))


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS n, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS body FROM documents)
SELECT doc_id AS item_id, CASE n WHEN 4 THEN 'EMAIL_ENCRYPTED' WHEN 5 THEN 'EMAIL_UNPARSEABLE' END AS failure, CASE WHEN n < 4 THEN md5(array_to_string(list_transform(body, lambda x: regexp_replace(x, '\\s+', '', 'g')), '')) END AS body_hash,
 CASE WHEN n = 2 THEN 1 WHEN n = 3 THEN 2 ELSE 0 END AS n_attachments, CASE WHEN n = 2 THEN 5 WHEN n = 3 THEN 3 ELSE 0 END AS attached_bytes, CASE WHEN n < 4 THEN 'No ' || doc_id END AS subject FROM d""")
def mail_trees(spark, sf_dir):
    """What each message holds: its body without white space, as a hash, its subject and attachments, or why it can't be read."""
    own = mail.mail_items(mails(spark, sf_dir))
    size = F.aggregate("attached", F.lit(0).cast("bigint"), lambda a, x: a + x["size_bytes"])
    subject = F.filter("headers", lambda h: h["name"] == "Subject")
    hash_ = F.when(F.col("failure").isNull(), F.md5(F.regexp_replace(F.array_join("body", ""), r"\s+", "")))
    return own.select("item_id", "failure", hash_.alias("body_hash"), F.size("attached").cast("bigint").alias("n_attachments"), size.alias("attached_bytes"), F.get(subject, F.lit(0))["text"].alias("subject"))


@query("SELECT doc_id, text IS DISTINCT FROM nfc_normalize(text) AS changed, md5(nfc_normalize(text)) AS hash FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(replace(replace(text, 'é', 'e' || chr(769)), 'ö', 'o' || chr(776)), 'K', chr(8490)) ELSE text END AS text FROM documents)")
def texts_in_form_c(spark, sf_dir):
    """Texts whose accents stand alone in every third document, in form C."""
    loose = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "é", "é"), "ö", "ö"), "K", "K")
    text = F.when(F.col("doc_id") % 3 == 0, loose).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("t")).select("doc_id", (~F.col("t").eqNullSafe(items.form_c(F.col("t")))).alias("changed"), F.md5(items.form_c(F.col("t"))).alias("hash"))


# ---- timelines and times

TYPES = ("CALL", "OTHER", "MESSAGE_RECEIVED", "PAYMENT_INITIATED", "LINK_OPENED", None)


@query("""WITH e AS (SELECT user_id AS c, event_id AS i, event_id % 7 <> 0 AS timed, ts, CASE event_id % 3 WHEN 0 THEN 0 ELSE 1 END AS p, event_id % 5 AS ref, event_id % 2 AS page, [3, 10, 1, 8, 4, 11][event_id % 6 + 1] AS k, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
a AS (SELECT *, CASE WHEN NOT timed THEN CASE WHEN i % 4 = 0 THEN i - 1 ELSE before END END AS after FROM e),
d AS (SELECT c, i, row_number() OVER (PARTITION BY c ORDER BY ts, p, ref, page, k, i) AS n FROM a WHERE timed),
o AS (SELECT a.c, a.i, a.ref, a.page, a.k, coalesce(d.n, q.n) AS n, a.timed FROM a LEFT JOIN d ON d.c = a.c AND d.i = a.i LEFT JOIN d q ON q.c = a.c AND q.i = a.after)
SELECT c AS case_id, i AS event_id, CAST(row_number() OVER (PARTITION BY c ORDER BY n NULLS LAST, timed DESC, ref, page, k, i) AS INTEGER) AS position FROM o""")
def placed_timeline(spark, sf_dir):
    """Events of a user in order; every seventh has no time and follows the one before it, or one that may be another user's."""
    e = read(spark, sf_dir, "events")
    i, timed = F.col("event_id"), F.col("event_id") % 7 != 0
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (i % 6 + 1).cast("int"))
    events = e.select(F.col("user_id").alias("case_id"), "event_id", kind.alias("event_type"), F.when(timed, F.col("ts").cast("timestamp")).alias("at"), F.when(~timed, "INFERRED_ORDER_ONLY").when(i % 3 == 0, "EXACT").otherwise("APPROXIMATE").alias("precision"), (i % 5).alias("evidence_ref"), (i % 2).alias("page"), F.lit(1).alias("line_number"), F.when(~timed, F.when(i % 4 == 0, i - 1).otherwise(before)).alias("after_event"))
    return graph.timeline(events).select("case_id", "event_id", "position")


@query("""WITH e AS (SELECT user_id AS c, event_id AS i, event_id % 9 AS v, CASE event_id % 4 WHEN 0 THEN 'DATE' WHEN 1 THEN 'DATETIME' ELSE 'TIME' END AS kind, '2026-09-' || lpad(CAST(user_id % 3 * (event_id % 5) + 1 AS VARCHAR), 2, '0') AS d, lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':30' AS t, CASE WHEN event_id % 6 = 1 THEN 'APPROXIMATE' ELSE 'EXACT' END AS p FROM events),
w AS (SELECT *, last_value(CASE WHEN kind = 'DATE' THEN d END IGNORE NULLS) OVER (PARTITION BY c, v ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM e),
n AS (SELECT c, count(DISTINCT d) AS n, max(d) AS only_day FROM e WHERE kind <> 'TIME' GROUP BY c),
r AS (SELECT w.*, CASE WHEN kind <> 'TIME' THEN d WHEN own IS NOT NULL THEN own WHEN n.n = 1 THEN only_day END AS day, CASE WHEN kind = 'DATE' THEN 'APPROXIMATE' WHEN kind = 'DATETIME' OR own IS NOT NULL THEN p WHEN n.n = 1 THEN 'APPROXIMATE' ELSE 'INFERRED_ORDER_ONLY' END AS precision FROM w LEFT JOIN n ON n.c = w.c)
SELECT i AS fact_id, day, precision, CASE WHEN kind = 'DATE' THEN 'DATE' ELSE 'TIME' END AS granularity, epoch(CAST(day || ' ' || CASE WHEN kind = 'DATE' THEN '00:00' ELSE t END || ':00' AS TIMESTAMP)) - 19800 AS at_s FROM r""")
def stated_times(spark, sf_dir):
    """What dates, times and both say of when, in each user's evidence."""
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "DATE").when(i % 4 == 1, "DATETIME").otherwise("TIME")
    day = F.concat(F.lit("2026-09-"), F.lpad((F.col("user_id") % 3 * (i % 5) + 1).cast("string"), 2, "0"))
    clock = F.concat(F.lit("T"), F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":30"))
    value = F.when(kind == "DATE", day).when(kind == "DATETIME", F.concat(day, clock, F.lit("+05:30"))).otherwise(clock)
    said = read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), (i % 9).alias("evidence_id"), i.alias("line_number"), F.lit(0).alias("start"), i.alias("fact_id"), kind.alias("kind"), value.alias("value"), F.when(i % 6 == 1, "APPROXIMATE").otherwise("EXACT").alias("precision"))
    return graph.times_of(said).select("fact_id", "day", "precision", "granularity", F.unix_seconds("at").cast("double").alias("at_s"))


@query("""WITH t AS (SELECT o_custkey AS case_id, o_orderstatus AS k, o_orderkey AS id, epoch(o_orderdate) + (o_orderkey % 48) * 1800 AS s, o_orderkey % 2 = 0 AS d, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS p FROM orders)
SELECT a.case_id, a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.case_id = b.case_id AND a.k = b.k AND a.id < b.id WHERE CASE WHEN a.d OR b.d THEN floor((a.s + 19800) / 86400) <> floor((b.s + 19800) / 86400) ELSE abs(a.s - b.s) > 60 * [2, 10, 20][a.p + b.p + 1] END""")
def contradicting_dates(spark, sf_dir):
    """Orders of a customer in one state as times of one event: dates alone differ by their day, others by minutes; pairs are the feature."""
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 48 * 1800)
    times = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("event_key"), k.alias("id"), at.alias("at"), F.when(k % 3 == 0, "APPROXIMATE").otherwise("EXACT").alias("precision"), F.when(k % 2 == 0, "DATE").otherwise("TIME").alias("granularity"))
    return rules.time_contradictions(times).select("case_id", "id_a", "id_b")


# ---- contradictions, checklist, actions, urgency


@query("""WITH a AS (SELECT o_custkey AS c, l_orderkey AS t, CAST(l_quantity AS BIGINT) % 3 AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber < 3 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderkey % 10 = 0)
SELECT c AS case_id, t AS transaction_id, string_agg(DISTINCT 'INR ' || v || '.00', ',' ORDER BY 'INR ' || v || '.00') AS amounts FROM a GROUP BY c, t HAVING count(DISTINCT v) > 1""")
def transaction_amounts(spark, sf_dir):
    """Orders whose first lines, and what their customers said, name several amounts."""
    orders = read(spark, sf_dir, "orders")
    amount = F.concat(F.lit("INR "), (F.col("l_quantity").cast("bigint") % 3).cast("string"), F.lit(".00"))
    links = read(spark, sf_dir, "lineitem").where("l_linenumber < 3").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("case_id"), F.col("l_orderkey").alias("transaction_id"), amount.alias("amount"))
    said = orders.where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("transaction_id"), F.lit("INR 1.00").alias("amount"))
    return rules.amount_contradictions(links, said).select("case_id", "transaction_id", F.array_join("amounts", ",").alias("amounts"))


@query("""SELECT l_suppkey AS case_id, l_orderkey AS event_key, count(DISTINCT l_partkey) AS n_transactions FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1""")
def payment_transactions(spark, sf_dir):
    events = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_orderkey").alias("event_key"), F.when(F.col("l_linestatus") == "O", "DEBIT_NOTIFICATION").otherwise("CALL").alias("event_type"), F.col("l_partkey").alias("transaction_id"))
    return rules.transaction_contradictions(events).select("case_id", "event_key", F.size("transactions").cast("bigint").alias("n_transactions"))


ENTITY_TYPES = ("AMOUNT", "TRANSACTION", "BANK_OR_WALLET", "PHONE", "DOMAIN", "PERSON", "URL", "AMOUNT", "ACCOUNT_HINT", "PERSON", "DOMAIN")


def case_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as cases: orders are their events, lines their entities, so that each has some of what the rules ask for."""
    c, o, l = (read(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    own = l.join(o.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).where("l_partkey % 9 = 0")
    kind = F.element_at(F.array(*map(F.lit, ENTITY_TYPES)), (F.col("l_suppkey") % 11 + 1).cast("int"))
    entities = own.select(F.col("o_custkey").alias("case_id"), kind.alias("field_type"), (F.col("l_linenumber") == 1).alias("tied"))
    event = F.when(F.col("o_orderstatus") == "P", "PAYMENT_INITIATED").when(F.col("o_orderkey") % 31 == 0, "CREDENTIAL_OTP_REQUEST").otherwise("CALL")
    events = o.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("case_id"), event.alias("event_type"), (F.col("o_orderkey") % 8 == 0).alias("from_evidence"), F.when(F.col("o_orderkey") % 12 == 0, "INFERRED_ORDER_ONLY").otherwise("EXACT").alias("precision"), F.when(F.col("o_orderkey") % 12 != 0, "2026-01-01").alias("day"))
    cases = c.select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 5 == 0, " ").when(F.col("c_custkey") % 5 == 1, "told").alias("summary"), (F.col("c_custkey") % 2).alias("n_processed"), F.when(F.col("c_custkey") % 7 == 0, "2026-01-01").alias("incident_time"), (F.col("c_custkey") % 3).alias("n_missing_evidence"))
    detections = c.where("c_custkey % 13 = 0").select(F.col("c_custkey").alias("case_id"), F.lit("OTP").alias("kind"))
    labels = c.where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 3 == 0, "UNKNOWN_OTHER").otherwise("PHISHING").alias("label"))
    evidence = c.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 4 == 1, "FAILED").otherwise("PROCESSED").alias("status"))
    return {"cases": cases, "entities": entities, "events": events, "detections": detections, "labels": labels, "evidence": evidence}


CASES = f"""WITH en AS (SELECT o_custkey AS c, {list(ENTITY_TYPES)}[l_suppkey % 11 + 1] AS t, l_linenumber = 1 AS tied FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 9 = 0),
ev AS (SELECT o_custkey AS c, CASE WHEN o_orderstatus = 'P' THEN 'PAY' WHEN o_orderkey % 31 = 0 THEN 'OTP' ELSE 'CALL' END AS t, o_orderkey % 8 = 0 AS own, o_orderkey % 12 <> 0 AS timed FROM orders WHERE o_orderkey % 4 = 0),
f AS (SELECT c_custkey AS c, EXISTS (SELECT 1 FROM en WHERE en.c = c_custkey AND t = 'AMOUNT' AND tied) AS u1, c_custkey % 13 = 0 OR EXISTS (SELECT 1 FROM ev WHERE ev.c = c_custkey AND t = 'OTP' AND own) AS u2,
 EXISTS (SELECT 1 FROM en WHERE en.c = c_custkey AND t IN ('PHONE', 'URL')) AS suspect, EXISTS (SELECT 1 FROM en WHERE en.c = c_custkey AND t = 'BANK_OR_WALLET') AS bank, EXISTS (SELECT 1 FROM en WHERE en.c = c_custkey AND t = 'TRANSACTION') AS utr,
 EXISTS (SELECT 1 FROM ev WHERE ev.c = c_custkey AND timed) OR c_custkey % 7 = 0 AS dated, EXISTS (SELECT 1 FROM ev WHERE ev.c = c_custkey AND timed AND t = 'PAY') AS paid FROM customer)"""


@query(CASES + """, x AS (SELECT c, u1, unnest([{'f': 'INCIDENT_DATETIME', 'ok': dated, 'fin': false, 'ask': 'QUESTION', 'high': true}, {'f': 'INCIDENT_DETAILS', 'ok': c % 5 = 1 OR c % 2 > 0, 'fin': false, 'ask': 'QUESTION', 'high': false}, {'f': 'IDENTITY_DOCUMENT', 'ok': false, 'fin': false, 'ask': 'INFORMATIONAL', 'high': false},
 {'f': 'BANK_WALLET_MERCHANT', 'ok': bank, 'fin': true, 'ask': 'QUESTION', 'high': true}, {'f': 'TRANSACTION_ID_UTR', 'ok': utr, 'fin': true, 'ask': 'QUESTION', 'high': false}, {'f': 'TRANSACTION_DATE', 'ok': paid, 'fin': true, 'ask': 'QUESTION', 'high': false}, {'f': 'FRAUD_AMOUNT', 'ok': u1, 'fin': true, 'ask': 'QUESTION', 'high': false},
 {'f': 'RELEVANT_EVIDENCE', 'ok': c % 3 = 0, 'fin': false, 'ask': 'HINT', 'high': false}, {'f': 'SUSPECT_DETAILS', 'ok': suspect, 'fin': false, 'ask': 'OPTIONAL', 'high': false}]) AS x FROM f)
SELECT c AS case_id, x.f AS field, x.ask AS ask, x.high AS high_value FROM x WHERE NOT x.ok AND (u1 OR NOT x.fin)""")
def checklist_gaps(spark, sf_dir):
    """What the checklist misses in each case, by its variant."""
    t = case_tables(spark, sf_dir)
    signals = rules.signals_of(t["entities"], t["events"], t["detections"])
    present = rules.present_fields(t["cases"], t["entities"], t["events"])
    return rules.checklist(rules.variants(t["cases"], signals), present, rules.required_fields(spark))


@query(CASES + """, a AS (SELECT c, unnest([{'a': 'CONTACT_BANK', 'r': 1, 'on': u1 OR u2}, {'a': 'REPORT_1930_NCRP', 'r': 2, 'on': u1}, {'a': 'REPORT_CYBERCRIME_NCRP', 'r': 3, 'on': NOT u1 AND c % 3 = 1}, {'a': 'PRESERVE_EVIDENCE', 'r': 4, 'on': c % 4 > 1}, {'a': 'REPORT_SUSPECT_NCRP', 'r': 5, 'on': suspect}]) AS x FROM f)
SELECT c AS case_id, x.a AS action, CAST(row_number() OVER (PARTITION BY c ORDER BY x.r) AS INTEGER) AS position FROM a WHERE x.on""")
def case_actions(spark, sf_dir):
    t = case_tables(spark, sf_dir)
    signals = rules.signals_of(t["entities"], t["events"], t["detections"])
    return rules.ranked_actions(rules.action_triggers(signals, t["labels"], t["evidence"], t["entities"]), rules.action_templates(spark))


@query(CASES + """ SELECT c AS case_id, ['HIGH', 'MEDIUM', 'LOW'][c % 3 + 1] AS level, CASE WHEN u1 THEN 'HIGH' WHEN u2 THEN 'MEDIUM' ELSE 'LOW' END AS expected FROM f WHERE ['HIGH', 'MEDIUM', 'LOW'][c % 3 + 1] <> CASE WHEN u1 THEN 'HIGH' WHEN u2 THEN 'MEDIUM' ELSE 'LOW' END""")
def urgency_mismatches(spark, sf_dir):
    """Assessments by turns, against what the cases' signals give."""
    t = case_tables(spark, sf_dir)
    level = F.element_at(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), (F.col("case_id") % 3 + 1).cast("int"))
    return rules.urgency_violations(t["cases"].select("case_id", level.alias("level")), rules.signals_of(t["entities"], t["events"], t["detections"]))


@query("""SELECT event_id, CAST(least(value / 200, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.5 END) AS DOUBLE) AS confidence FROM events""")
def capped_confidences(spark, sf_dir):
    i = F.col("event_id") % 3
    precision = F.when(i == 0, "EXACT").when(i == 1, "APPROXIMATE").otherwise("INFERRED_ORDER_ONLY")
    return read(spark, sf_dir, "events").select("event_id", rules.capped_confidence(F.col("value") / 200, precision).alias("confidence"))


# ---- sources, proposals, coverage


def references(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders own references to parts (extractions), suppliers (statements) and orders (evidence with lines); a part belongs to a case by its number."""
    l = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "EXTRACTION").when(F.col("l_linenumber") % 3 == 1, "EVIDENCE").otherwise("USER_STATEMENT")
    target = F.when(kind == "EXTRACTION", F.col("l_partkey")).when(kind == "EVIDENCE", F.col("l_orderkey")).otherwise(F.col("l_suppkey"))
    refs = l.where("l_orderkey % 17 > 0").select(F.col("l_orderkey").alias("owner_id"), F.col("l_linenumber").alias("ordinal"), kind.alias("ref_kind"), target.alias("ref_id"), F.when((kind == "EVIDENCE") & (F.col("l_orderkey") % 2 == 0), F.col("l_linenumber") + F.when(F.col("l_orderkey") % 10 == 0, 50).otherwise(0)).alias("line_id"))
    owners = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner_id"), F.when(F.col("o_orderkey") % 5 == 0, "entity").otherwise("finding").alias("owner_kind"), F.lit(0).alias("case_id"))
    of = lambda name, key, as_, bad: read(spark, sf_dir, name).select(F.when(F.col(key) % bad == 0, 1).otherwise(0).alias("case_id"), F.col(key).alias(as_))
    return {"owners": owners, "refs": refs, "extractions": of("part", "p_partkey", "extraction_id", 11), "statements": of("supplier", "s_suppkey", "statement_id", 7), "evidence": of("orders", "o_orderkey", "evidence_id", 19), "lines": l.select(F.col("l_orderkey").alias("evidence_id"), F.col("l_linenumber").alias("line_id"))}


SOURCES = """WITH o AS (SELECT o_orderkey AS i, o_orderkey % 5 = 0 AS entity FROM orders), r AS (SELECT l_orderkey AS i, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_orderkey % 17 > 0),
j AS (SELECT o.i, CASE WHEN n IS NULL THEN 'NO_SOURCE' WHEN entity AND n % 3 <> 2 THEN 'ENTITY_NEEDS_STATEMENT' WHEN (n % 3 = 0 AND p % 11 = 0) OR (n % 3 = 2 AND s % 7 = 0) OR (n % 3 = 1 AND o.i % 19 = 0) THEN 'FOREIGN_SOURCE' WHEN n % 3 = 1 AND o.i % 10 = 0 THEN 'FOREIGN_LINE' END AS v,
 CASE WHEN n % 3 = 0 THEN 'X' || p WHEN n % 3 = 1 THEN 'E' || o.i || CASE WHEN o.i % 2 = 0 THEN ':' || n ELSE '' END ELSE 'S' || s END AS ref FROM o LEFT JOIN r ON r.i = o.i)"""


@query(SOURCES + " SELECT DISTINCT i AS owner_id, v AS violation FROM j WHERE v IS NOT NULL")
def source_violations(spark, sf_dir):
    return case.attach_sources(**references(spark, sf_dir))[1]


@query(SOURCES + " SELECT i AS owner_id, count(DISTINCT ref) AS n_sources FROM j GROUP BY i HAVING count(v) = 0")
def attached_sources(spark, sf_dir):
    return case.attach_sources(**references(spark, sf_dir))[0].groupBy("owner_id").agg(F.count("*").alias("n_sources"))


@query("SELECT DISTINCT l_orderkey AS fact_id FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3 AND l_partkey % 2 = 0)")
def facts_without_own_line(spark, sf_dir):
    """Orders as facts of even and odd evidence: those without a third line of their own."""
    l = read(spark, sf_dir, "lineitem")
    own = l.where("l_linenumber = 3").select(F.col("l_orderkey").alias("fact_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"))
    places = l.where("l_linenumber = 3").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"), (F.col("l_partkey") % 2).alias("evidence_id"))
    return case.without_own_line(l.select(F.col("l_orderkey").alias("fact_id"), F.lit(0).cast("bigint").alias("evidence_id")).distinct(), own, places).select("fact_id")


@query("SELECT doc_id AS evidence_id, CASE WHEN doc_id % 4 = 0 THEN 'COULD_NOT_COMPLETE' WHEN doc_id % 4 = 1 THEN 'MISMATCH' ELSE 'MATCH' END AS result FROM documents")
def verified_files(spark, sf_dir):
    """Documents as files: some lost, some changed since they were fingerprinted."""
    d = read(spark, sf_dir, "documents")
    evidence = d.select(F.col("doc_id").alias("evidence_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    files = d.where("doc_id % 4 > 0").select(F.col("doc_id").alias("evidence_id"), F.concat("text", F.when(F.col("doc_id") % 4 == 1, " ").otherwise("")).cast("binary").alias("content"))
    return case.verify_integrity(evidence, files)


@query("SELECT l_partkey AS from_value, l_suppkey AS to_value, string_agg(DISTINCT l_orderkey, ',' ORDER BY l_orderkey) AS doc_ids FROM lineitem GROUP BY ALL")
def merged_edges(spark, sf_dir):
    found = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_value"), F.lit("HOSTED_ON").alias("relation"), F.col("l_suppkey").alias("to_value"), F.col("l_orderkey").alias("doc_id"))
    return facts.merge_edges(found).select("from_value", "to_value", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


@query("SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 > 0 AND event_id % 5 > 0 AND value >= 30")
def correlated_facts(spark, sf_dir):
    i = F.col("event_id")
    rows = read(spark, sf_dir, "events").select("event_id", F.when(i % 2 == 0, "PROCESSED").otherwise("FAILED").alias("evidence_status"), F.when(i % 3 > 0, "NORMALIZED").otherwise("NOT_NORMALIZED").alias("status"), F.when(i % 5 > 0, i).alias("entity_id"), F.when(F.col("value") >= 30, 1).otherwise(0).alias("n_lines"))
    return relations.correlation_input(rows).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'MODEL_JUDGEMENT' ELSE 'SOURCE_VALIDATION' END AS basis FROM events")
def confidence_bases(spark, sf_dir):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "PERSON").when(i % 3 == 1, "PHONE").otherwise("BANK_OR_WALLET")
    return read(spark, sf_dir, "events").select("event_id", relations.confidence_basis(kind, F.when(i % 2 == 0, "LLM").otherwise("RULE")).alias("basis"))


@query("""WITH l AS (SELECT o_orderkey AS i, o_custkey % 5 AS p, o_orderkey % 4 AS w FROM orders)
SELECT i AS proposal_id, CASE WHEN p = 0 AND w <> 0 OR p = 1 AND w <> 1 OR p = 2 AND w <> 2 OR p = 3 AND w <> 3 THEN 'NO_CUE' END AS rejection FROM l""")
def cued_proposals(spark, sf_dir):
    """Orders propose relations that rest on words; each order's text has the words for one of them, for AMOUNT_OF none are needed."""
    l = read(spark, sf_dir, "orders")
    i, p, w = F.col("o_orderkey"), F.col("o_custkey") % 5, F.col("o_orderkey") % 4
    relation = F.when(p == 0, "PAID_TO").when(p == 1, "DEBITED_FROM").when(p == 2, "HOSTED_ON").when(p == 3, "MESSAGE_CONTAINED").otherwise("AMOUNT_OF")
    # entities by type: transaction 1, UPI 2, account 3, URL 4, domain 5, sender 6, phone 7, amount 8
    ends = F.when(p == 0, F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"))).when(p == 1, F.struct(F.lit(1).alias("a"), F.lit(3).alias("b"))).when(p == 2, F.struct(F.lit(4).alias("a"), F.lit(5).alias("b"))).when(p == 3, F.struct(F.lit(6).alias("a"), F.lit(7).alias("b"))).otherwise(F.struct(F.lit(8).alias("a"), F.lit(1).alias("b")))
    asked = l.select(i.alias("proposal_id"), ends["a"].alias("from_entity"), relation.alias("relation"), ends["b"].alias("to_entity"), F.array(i).alias("evidence_ids"), F.array(i * 10 + ends["a"], i * 10 + ends["b"]).alias("fact_ids"))
    kinds = ("TRANSACTION", "UPI_ID", "ACCOUNT_HINT", "URL", "DOMAIN", "SMS_SENDER_HEADER", "PHONE", "AMOUNT")
    known = spark.createDataFrame(list(enumerate(kinds, 1)), "entity_id int, field_type string")
    found = l.select(i.alias("evidence_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("entity_id")).join(F.broadcast(known), "entity_id").where((F.col("entity_id") != 6) | (F.col("evidence_id") % 4 == 3))
    value = F.when(F.col("entity_id") == 4, F.concat(F.lit("https://h"), "evidence_id", F.lit(".example/a"))).when(F.col("entity_id") == 5, F.concat(F.lit("h"), "evidence_id", F.lit(".example")))
    found = found.withColumn("fact_id", F.col("evidence_id") * 10 + F.col("entity_id")).withColumn("normalized_value", value).withColumn("header_name", F.lit(None).cast("string")).withColumn("line_number", F.when((F.col("entity_id") == 5) & (F.col("evidence_id") % 4 != 2), 2).otherwise(1))
    text = F.when(w == 0, "you have PAID  to him").when(w == 1, "Rs 5 debited from it").otherwise("nothing of the kind")
    said = l.select(i.alias("evidence_id"), F.lit(1).alias("line_number"), text.alias("text"))
    # the sender's fact is missing where the item has no sender, so cite it from a table that has all
    every = found.select("fact_id", "evidence_id", "entity_id").unionByName(l.where("o_orderkey % 4 <> 3").select((i * 10 + 6).alias("fact_id"), i.alias("evidence_id"), F.lit(6).alias("entity_id")))
    cues = relations.item_cues(said, found, l.select(i.alias("evidence_id"), F.lit("TEXT").alias("kind")))
    return relations.judge_proposals(asked, known, every, relations.allowed_pairs(spark), cues).select("proposal_id", "rejection")


# ---- windows, sketches, SQL, kept analyses


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, event_id AS i, epoch_us(ts) AS t FROM events),
s AS (SELECT u, min({'t': t, 'i': i}) AS x FROM e GROUP BY u UNION ALL SELECT s.u, min({'t': e.t, 'i': e.i}) FROM s JOIN e ON e.u = s.u AND e.t >= s.x.t + 3600000000 GROUP BY s.u)
SELECT u AS user_id, x.i AS event_id FROM s""")
def last_seen_refreshes(spark, sf_dir):
    """Events that renew a user's last-seen time, once an hour at most."""
    return limiter.refreshes(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)


@query("""SELECT l_returnflag, l_linestatus, l_shipmode_group, CAST(grouping(l_returnflag, l_linestatus, l_shipmode_group) AS BIGINT) AS grouping_id, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity
FROM (SELECT *, l_suppkey % 4 AS l_shipmode_group FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, l_shipmode_group), (l_shipmode_group), ())""")
def grouping_set_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("l_shipmode_group", F.col("l_suppkey") % 4)
    sets = [["l_returnflag", "l_linestatus"], ["l_returnflag", "l_shipmode_group"], ["l_shipmode_group"], []]
    return sketches.grouping_sets(rows, sets, F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query()
def monthly_sketches(spark, sf_dir):
    """Orders of each month: distinct customers and quantiles of the price, from sketches of days."""
    days = sketches.sketched(read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), ["day"], "o_custkey", "o_totalprice")
    months = sketches.merged(days.withColumn("month", F.date_format("day", "yyyy-MM")), ["month"])
    return sketches.estimates(months)


@query("""SELECT doc_id, regexp_extract(m, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}') AS raw_value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}')) AS m FROM documents)""")
def entities_in_sql(spark, sf_dir):
    """The table function in SQL, over all documents that hold an @."""
    sql.register(spark)
    return spark.sql("SELECT d.doc_id, f.raw_value FROM {docs} d, LATERAL extract_entities(d.text, 'EMAIL') f WHERE d.text LIKE '%@%'", docs=read(spark, sf_dir, "documents"))


@query(URL_SQL + """ SELECT 'URL' AS field_type, normalized_url AS canonical_value, count(*) AS n_facts, count(DISTINCT page_id) AS n_docs FROM u GROUP BY ALL UNION ALL SELECT 'DOMAIN', host, count(*), count(DISTINCT page_id) FROM u GROUP BY ALL""")
def analyzed_pages(spark, sf_dir):
    """The whole analysis of the pages' URLs, in two runs: first of half of them, then of all, which reads the other half only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints"
    store, pages = os.path.join(top, f"analysis-{uuid.uuid4().hex}"), read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))
    analysis.analyze(pages.where("doc_id % 2 = 0"), store)
    found, _ = analysis.analyze(pages, store)
    return found["entities"].select("field_type", "canonical_value", "n_facts", "n_docs")


# ---- constraints, overviews, edges of a run, formats


@query("""WITH e AS (SELECT doc_id, doc_id % 22 AS sequence_no, CASE WHEN doc_id % 3 = 0 THEN 'TEXT' ELSE 'PDF' END AS kind, CASE WHEN doc_id % 5 = 0 THEN 'UPLOADING' WHEN doc_id % 5 = 1 THEN 'FAILED' ELSE 'PROCESSED' END AS status, length(text) AS n, CASE WHEN doc_id % 7 > 0 THEN sha256(text) WHEN doc_id % 2 = 0 THEN 'no hash' END AS sha, doc_id % 25 AS pages, CASE WHEN doc_id % 4 = 0 THEN 'PDF_NO_TEXT_LAYER' END AS code, doc_id % 8 = 0 AS again FROM documents)
SELECT doc_id, failed_check FROM (SELECT doc_id, unnest([CASE WHEN sequence_no NOT BETWEEN 1 AND 20 THEN 'sequence_no_range' END, CASE WHEN kind = 'TEXT' AND n NOT BETWEEN 1 AND 20000 THEN 'text_char_count_range' END, CASE WHEN pages NOT BETWEEN 1 AND 20 THEN 'page_count_range' END, CASE WHEN sha = 'no hash' THEN 'sha256_format' END, CASE WHEN (sha IS NULL) = (status <> 'UPLOADING') THEN 'sha256_with_processing_status' END,
 CASE WHEN kind = 'TEXT' OR status = 'UPLOADING' THEN 'pages_of_files' END, CASE WHEN (code IS NOT NULL) <> (status = 'FAILED') THEN 'failure_code_with_processing_status' END, CASE WHEN status <> 'FAILED' THEN 'failure_retryable_with_processing_status' END, CASE WHEN code IS NOT NULL AND again THEN 'no_text_layer_is_final' END]) AS failed_check FROM e) WHERE failed_check IS NOT NULL""")
def evidence_constraints(spark, sf_dir):
    """Documents as stored items, against all rules for such."""
    d = F.col("doc_id")
    status = F.when(d % 5 == 0, "UPLOADING").when(d % 5 == 1, "FAILED").otherwise("PROCESSED")
    kind = F.when(d % 3 == 0, "TEXT").otherwise("PDF")
    rows = read(spark, sf_dir, "documents").select("doc_id", (d % 22).alias("sequence_no"), kind.alias("evidence_type"), status.alias("processing_status"), F.when(kind == "TEXT", F.length("text")).alias("text_char_count"), F.when(d % 7 > 0, F.sha2(F.col("text").cast("binary"), 256)).when(d % 2 == 0, "no hash").alias("sha256"), (d % 25).alias("page_count"), F.when(d % 4 == 0, "PDF_NO_TEXT_LAYER").alias("failure_code"), (d % 8 == 0).alias("failure_retryable"))
    return constraints.check(rows, "evidence_items", "doc_id")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 3 AS s, l_partkey % 2 AS filled, l_linenumber % 4 AS k FROM lineitem)
SELECT id, failed_check, count(*) AS n FROM (SELECT id, unnest([CASE WHEN s < 2 AND filled = 0 THEN 'computed_sha256_with_result' END, CASE WHEN s = 2 AND filled = 1 THEN 'computed_sha256_with_result' END, CASE WHEN (s = 2) <> (k = 0) THEN 'failure_code_with_result' END, CASE WHEN filled = 1 AND s < 2 AND (s = 0) <> (k < 2) THEN 'result_fits_hashes' END]) AS failed_check FROM r) WHERE failed_check IS NOT NULL GROUP BY ALL""")
def integrity_constraints(spark, sf_dir):
    """Lines as verifications of files, against the rules for such."""
    s, filled, k = F.col("l_suppkey") % 3, F.col("l_partkey") % 2 == 1, F.col("l_linenumber") % 4
    recorded = F.sha2(F.lit("a"), 256)
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(s == 0, "MATCH").when(s == 1, "MISMATCH").otherwise("COULD_NOT_COMPLETE").alias("result"), recorded.alias("recorded_sha256"), F.when(filled, F.when(k < 2, recorded).otherwise(F.sha2(F.lit("b"), 256))).alias("computed_sha256"), F.when(k == 0, "NO_FILE").alias("failure_code"))
    return constraints.check(rows, "integrity_verifications", "id").groupBy("id", "failed_check").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS case_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1")
def runs_at_once(spark, sf_dir):
    """Cases with more than one run that is not over."""
    runs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("SUCCEEDED").alias("status"))
    return constraints.more_than_one(runs, "analysis_runs")


@query("""WITH e AS (SELECT o_custkey AS c, count(*) AS total, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS failed FROM orders GROUP BY 1),
r AS (SELECT o_custkey AS c, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run FROM orders GROUP BY 1),
p AS (SELECT l_suppkey AS c, l_orderkey AS v, CASE WHEN max(l_linenumber) % 2 = 0 THEN 'GENERATED' ELSE 'INVALIDATED' END AS status FROM lineitem GROUP BY 1, 2),
q AS (SELECT c, max(v) AS latest, arg_max(status, v) AS latest_status, max(v) FILTER (WHERE status = 'GENERATED') AS current FROM p GROUP BY c)
SELECT c_custkey AS case_id, coalesce(total, 0) AS evidence_total, coalesce(failed, 0) AS evidence_failed, run AS latest_run_id, CASE WHEN run % 4 < 2 THEN 'STEP ' || run % 4 END AS failed_step, latest AS latest_report_version, latest_status AS latest_report_status, current AS current_report_version, coalesce(current % 5 > 0, false) AS has_active_confirmation, CASE WHEN c_custkey % 2 = 0 THEN 'HIGH' END AS urgency_level, c_custkey % 2 = 0 AND c_custkey % 3 = 0 AS urgency_out_of_date
FROM customer LEFT JOIN e ON e.c = c_custkey LEFT JOIN r ON r.c = c_custkey LEFT JOIN q ON q.c = c_custkey""")
def case_overviews(spark, sf_dir):
    """Customers as cases with evidence, runs, reports, confirmations and urgency."""
    c, o, l = (read(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    k, key = F.col("c_custkey"), F.col("o_orderkey")
    cases = c.select(k.alias("case_id"), F.when(k % 3 == 0, "EXTRACTED").otherwise("ACTIONS_READY").alias("status"))
    evidence = o.select(F.col("o_custkey").alias("case_id"), F.when(key % 3 == 0, "FAILED").otherwise("PROCESSED").alias("processing_status"))
    runs = o.select(F.col("o_custkey").alias("case_id"), key.alias("run_id"), F.lit("FAILED").alias("status"), F.col("o_orderdate").alias("created_at"), (key % 4).alias("failed_step_id"))
    steps = o.select((key % 2).alias("step_id")).distinct().withColumn("step_name", F.concat(F.lit("STEP "), F.col("step_id").cast("string")))
    reports = relational.dealt(l.select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey", "l_orderkey").groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_orderkey").alias("version")).agg(F.when(F.max("l_linenumber") % 2 == 0, "GENERATED").otherwise("INVALIDATED").alias("status")).withColumn("report_id", F.concat_ws("-", "case_id", "version"))
    confirmed = relational.dealt(reports.select("report_id", F.when(F.col("version") % 5 == 0, "2026-01-01").alias("voided_at")), "report_id", like=l)
    urgency = c.select(k.alias("case_id"), F.lit("HIGH").alias("level"), (k % 2 == 0).alias("is_current"))
    entities = c.select(k.alias("case_id"), F.lit("URL").alias("field_type")).limit(0)
    out = case.full_overview(cases, evidence, runs, entities, steps, reports, confirmed, urgency)
    return out.select("case_id", "evidence_total", "evidence_failed", "latest_run_id", "failed_step", "latest_report_version", "latest_report_status", "current_report_version", "has_active_confirmation", "urgency_level", "urgency_out_of_date")


@query("""WITH p AS (SELECT DISTINCT l_suppkey % 10 AS c, l_partkey AS a, l_suppkey AS b, l_orderkey AS s FROM lineitem WHERE l_linenumber < 4), n AS (SELECT DISTINCT l_suppkey % 10 AS c, l_partkey AS a, l_suppkey AS b, l_orderkey AS s FROM lineitem WHERE l_linenumber > 2),
e AS (SELECT DISTINCT c, a, b FROM n), o AS (SELECT DISTINCT c, a, b FROM p)
SELECT c AS case_id, (SELECT count(*) FROM e WHERE e.c = x.c) AS edges, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM o) d WHERE d.c = x.c) AS created, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM e) d WHERE d.c = x.c) AS stale, (SELECT count(*) FROM n WHERE n.c = x.c) AS sources,
 (SELECT count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM p) d WHERE d.c = x.c) AS added, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM n) d WHERE d.c = x.c) AS removed FROM (SELECT DISTINCT c FROM e UNION SELECT DISTINCT c FROM o) x""")
def synced_edges(spark, sf_dir):
    """Edges of parts and suppliers before and after a run that reads other lines."""
    l = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("case_id"), F.col("l_partkey").alias("from_value"), F.lit("HOSTED_ON").alias("relation"), F.col("l_suppkey").alias("to_value"), F.array("l_orderkey").alias("source_ids"), "l_linenumber")
    before = l.where("l_linenumber < 4").groupBy("case_id", "from_value", "relation", "to_value").agg(F.array_distinct(F.flatten(F.collect_list("source_ids"))).alias("source_ids"))
    _, changes, summary = facts.synced_edges(before, l.where("l_linenumber > 2"), "run 2")
    moved = changes.groupBy("case_id").agg(F.count_if(F.col("change") == "ADD").alias("added"), F.count_if(F.col("change") == "REMOVE").alias("removed"))
    return summary.join(moved, "case_id")


VALUES = (("PHONE", "98765 43210"), ("PHONE", "12345"), ("AMOUNT", "Rs. 1,234.50"), ("AMOUNT", "1,234.50"), ("EMAIL", "a.b@c.example"), ("EMAIL", "a@b"), ("UPI_ID", "ab@okbank."), ("UPI_ID", "a@okbank"), ("TRANSACTION", "AB12 3456 78"), ("TRANSACTION", "ABCDEFGHIJ"), ("ACCOUNT_HINT", "XX1234"), ("ACCOUNT_HINT", "1234"), ("SMS_SENDER_HEADER", "vm-hdfcbk"), ("SMS_SENDER_HEADER", "VMHDFC"), ("MESSAGING_HANDLE", "@agent_7"), ("MESSAGING_HANDLE", "agent"), ("PERSON", "Asha  Rao"), ("PERSON", "R2 D2"), ("DOMAIN", "bücher.example"), ("DOMAIN", "a.unlisted"), ("URL", "https://a.example/x"), ("URL", "https://a.example/x."))


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS fact_id, count(*) AS n, CAST(sum(CASE WHEN l_partkey % {len(VALUES)} % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM lineitem GROUP BY 1""")
def format_checks(spark, sf_dir):
    """Values of all types by turns, every other one of which has its type's form."""
    at = (F.col("l_partkey") % len(VALUES) + 1).cast("int")
    pick = lambda n: F.element_at(F.array(*[F.lit(v[n]) for v in VALUES]), at)
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), pick(0).alias("kind"), pick(1).alias("raw"))
    return rows.withColumn("ok", T.valid_format(F.col("kind"), F.col("raw"))).groupBy("fact_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_valid"))


@query("""SELECT event_id, event_id AS fact_id FROM events WHERE event_id % 3 = 0 AND event_id % 160 + 1 <= 80""")
def typed_attachments(spark, sf_dir):
    """An event's fragment takes an amount within eighty characters that is told of an event of its type."""
    i = F.col("event_id")
    e = read(spark, sf_dir, "events")
    fragments = e.select("event_id", i.alias("doc_id"), F.lit(1).alias("line_number"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("PAYMENT_INITIATED").alias("event_type"))
    start = (i % 160 + 1).cast("int")
    told = e.select(i.alias("fact_id"), i.alias("doc_id"), F.lit(1).alias("line_number"), F.lit("AMOUNT").alias("field_type"), start.alias("start"), (start + 5).alias("end"), F.when(i % 3 == 0, "PAYMENT_INITIATED").otherwise("CALL").alias("event_type"))
    return lifecycle.attached(fragments, told).select("event_id", "fact_id")


@query(ORACLE_SQL["redacted_cards"].replace("SELECT doc_id, count(*) AS n_cards", "SELECT doc_id, 'CARD_NUMBER' AS kind, count(*) AS n, 'redact-v1' AS version"))
def stamped_detections(spark, sf_dir):
    """As ``redacted_cards``, with the version of the rules."""
    return lines.detection_counts(word_cards(spark, sf_dir)).where("kind = 'CARD_NUMBER'")


# ---- the spellings of each type

#: For each type, how it is written around a number (``{k}``: as it is, ``{5}`` and ``{8}``: of so many digits), and its canonical value; None where there is none.
SPELLINGS = {
    "PHONE": (("+91 98765-{5}", "+9198765{5}"), ("098765{5}", "+9198765{5}"), ("91-98765 {5}", "+9198765{5}"), ("98765{5}", "+9198765{5}"), ("98765-{5}", "+9198765{5}"), ("+44794{8}", "+44794{8}")),
    "AMOUNT": (("₹1,23,456.70", "INR 123456.70"), ("Rs {k}", "INR {k}.00"), ("INR 1,234,567", "INR 1234567.00"), ("rs. 00{k}.05", "INR {k}.05"), ("Rs.{k}.50", "INR {k}.50")),
    "DATETIME": (("2024-03-05", "2024-03-05"), ("5/3/24 21:05", "2024-03-05T21:05+05:30"), ("Tue, 5 March 2024, 9:05 p.m.", "2024-03-05T21:05+05:30"), ("around 7:45 am", "T07:45"), ("05-03-1999", "1999-03-05"), ("31/12/69", "2069-12-31"), ("1-1-70", "1970-01-01"), ("30 Feb 2024", None), ("12:00 AM", "T00:00"), ("Sept 24:10", None), ("24 Sept 2026 at approx. 12:19 PM", "2026-09-24T12:19+05:30")),
    "TRANSACTION": (("UPI Ref No: Ab{8}", "AB{8}"), ("RRN {8}77", "{8}77"), ("Txn ID #ab{8}", "AB{8}"), ("Transaction ID. X{8}", "X{8}"), ("Reference No : {8}", "{8}"), ("utr.: Q{8}", "Q{8}")),
    "ACCOUNT_HINT": (("A/c no. XX{5}", None), ("A/c no. XX1234", "1234"), ("Acct ending in **987", "987"), ("account number: xxx{k}", "{k}"), ("ending 4321", "4321"), ("ending in 4321", "4321")),
    "MESSAGING_HANDLE": (("@Agent_{k}", "agent_{k}"), ("t.me/Some_{k}", "some_{k}"), ("@a.b.{k}", "a.b.{k}")),
    "UPI_ID": (("U{k}.x-y@okBank", "u{k}.x-y@okbank"), ("{8}@upi.", "{8}@upi")),
    "SMS_SENDER_HEADER": (("  VM-HDFCBK ", "VM-HDFCBK"), ("AX-B{k}", "AX-B{k}")),
    "PERSON": (("Paid by: Asha Rao", "Asha Rao"), ("paid TO :  Ravi K. Iyer", "Ravi K. Iyer"), ("Name: O'Neil Émile-Ann.", "O'Neil Émile-Ann")),
    "BANK_OR_WALLET": (("Bank name: North Trust", "North Trust"), ("Wallet : Pay Fast", "Pay Fast"), ("was debited from State Street Bank", "State Street Bank")),
}
SPELLED = [(kind, text, value) for kind, every in SPELLINGS.items() for text, value in every]
#: What makes a number fit: account hints take three or four digits.
K = "event_id % 900 + 100"


@query(f"""WITH e AS (SELECT event_id, CAST({K} AS VARCHAR) AS k, lpad(CAST(event_id AS VARCHAR), 5, '0') AS k5, lpad(CAST(event_id AS VARCHAR), 8, '0') AS k8, event_id % {len(SPELLED)} + 1 AS n FROM events),
s AS (SELECT event_id, k, k5, k8, {[k for k, *_ in SPELLED]}[n] AS field_type, [{", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for *_, v in SPELLED)}][n] AS v FROM e)
SELECT event_id AS doc_id, field_type, replace(replace(replace(v, '{{k}}', k), '{{5}}', k5), '{{8}}', k8) AS normalized_value FROM s WHERE v IS NOT NULL
UNION ALL SELECT event_id, 'PERSON', 'North Trust' FROM e WHERE n = {[t for _, t, _ in SPELLED].index("Bank name: North Trust") + 1}
UNION ALL SELECT event_id, unnest(['DOMAIN', 'URL']), unnest(['t.me', 'https://t.me/Some_' || k]) FROM e WHERE n = {[t for _, t, _ in SPELLED].index("t.me/Some_{k}") + 1}""")
def spelled_facts(spark, sf_dir):
    """Facts of each type in each of its spellings, with canonical values; spellings that have none give no fact or one without. The label of a bank's name is also one of a name, and a short link's host and path are facts too."""
    i = F.col("event_id")
    text = F.element_at(F.array(*[F.lit(t) for _, t, _ in SPELLED]), (i % len(SPELLED) + 1).cast("int"))
    for mark, value in (("{k}", F.expr(K).cast("string")), ("{5}", F.lpad(i.cast("string"), 5, "0")), ("{8}", F.lpad(i.cast("string"), 8, "0"))):
        text = F.replace(text, F.lit(mark), value)
    said = read(spark, sf_dir, "events").select(i.alias("doc_id"), F.lit(1).alias("line_number"), text.alias("text"))
    return facts.extract(said).where("normalized_value is not null").select("doc_id", "field_type", "normalized_value")
