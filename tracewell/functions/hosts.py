"""Hosts: endings, forms for international names, and registrable domains by suffix rules.

The two forms of an international name need Python's codec, in Arrow batches, and only get the hosts that have one;
everything else is native.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Every two ASCII letters are a country's ending or kept for one; longer endings in wide use are listed. Others are kept apart as not known.
COUNTRY = r"^[a-z]{2}$"
GENERIC = (
    "com org net edu gov mil int info biz name pro mobi asia jobs travel coop aero museum tel cat post xxx app dev page web xyz online site website store shop top club live life world today news media blog cloud tech "
    "digital email network systems solutions services support software company group global agency center international space zone work works link click help host hosting press wiki win vip fun icu buzz one art "
    "design studio photo photos video music movie game games bet casino poker bank finance financial money loan loans credit cash fund capital insurance tax legal law lawyer health care clinic doctor dental hospital "
    "academy school university college training education science energy eco green garden farm food cafe bar pub restaurant pizza beer wine hotel holiday tours flights taxi auto cars bike house homes land estate properties "
    "rent build builders construction city london paris berlin nyc tokyo africa eus gal swiss shopping sale deals discount gift toys baby kids fashion shoes clothing jewelry beauty hair fit fitness yoga run sport football golf ski "
    "example test"
).split()


def known_ending(host: Column) -> Column:
    """Whether a host ends in a country's ending, a listed one, or one in another script."""
    last = F.lower(F.substring_index(host, ".", -1))
    return host.contains(".") & (last.rlike(COUNTRY) | last.isin(*GENERIC) | last.startswith("xn--") | last.rlike(r"[^\x00-\x7F]"))


def is_address(host: Column) -> Column:
    """Whether a host is four numbers."""
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def label_to_ascii(label: str) -> str | None:
    """A label as it is looked up: lower case, compatibility forms joined; null if it can't be one."""
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", label.lower()).lower())
    try:
        out = text if text.isascii() else "xn--" + text.encode("punycode").decode("ascii")
    except UnicodeError:
        return None
    return out if 0 < len(out) < 64 else None


def label_to_unicode(label: str) -> str:
    """A label as it is read; one that is no valid code stays as it is."""
    if not label.lower().startswith("xn--"):
        return label
    try:
        text = label[4:].encode("ascii").decode("punycode")
    except UnicodeError:
        return label
    return text if label_to_ascii(text) == label.lower() else label


def _host_to_ascii(host: str | None) -> str | None:
    labels = None if host is None else [label_to_ascii(x) for x in host.replace("。", ".").split(".")]
    return None if labels is None or None in labels else ".".join(labels)


def both_forms(hosts: pd.Series) -> pd.DataFrame:
    """A host as it is looked up, and as it is read; null where it can't be either. Most batches hold none."""
    if not len(hosts.dropna()):
        return pd.DataFrame({"ascii": None, "read": None}, index=hosts.index, dtype=object)
    ascii_ = hosts.map(_host_to_ascii)
    read = ascii_.map(lambda h: None if h is None else ".".join(map(label_to_unicode, h.split("."))))
    return pd.DataFrame({"ascii": ascii_, "read": read})


FORMS = StructType([StructField("ascii", StringType()), StructField("read", StringType())])
#: Marked as not deterministic, so that filters on its results don't move below it and make it, and the facts, once more.
_both_forms = F.pandas_udf(both_forms, FORMS).asNondeterministic()


def international(facts: DataFrame) -> DataFrame:
    """Facts with international hosts in their canonical forms, and ``punycode``.

    URLs get the host as it is looked up; domains the one as it is read, with the other as ``punycode`` where they differ.
    A host that can't be looked up has a null canonical value. Other facts pass unchanged.
    """
    value, kind = F.col("normalized_value"), F.col("field_type")
    host = F.when(kind == "URL", F.regexp_extract(value, r"^[a-z]+://([^/?#:]+)", 1)).when(kind == "DOMAIN", value)
    some = facts.withColumn("_host", F.when(host.rlike(r"(?i)[^\x00-\x7F]|(?:^|\.)xn--"), host))
    some = some.withColumn("_forms", _both_forms("_host")).withColumn("_ascii", F.col("_forms.ascii")).withColumn("_read", F.col("_forms.read"))
    url = F.concat(F.regexp_extract(value, r"^([a-z]+://)", 1), F.col("_ascii"), F.regexp_extract(value, r"^[a-z]+://[^/?#:]+(.*)$", 1))
    canonical = F.when(F.col("_host").isNull(), value).when(kind == "URL", url).otherwise(F.col("_read"))
    code = F.when((kind == "DOMAIN") & (F.col("_read") != F.col("_ascii")), F.col("_ascii"))
    return some.withColumn("normalized_value", canonical).withColumn("punycode", code).drop("_host", "_forms", "_ascii", "_read")


def registrable(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, public_suffix, registrable, known`` for each host, by suffix rules that the caller has (``rule``).

    A rule is a suffix (``co.uk``), a wildcard for one label (``*.ck``) or an exception to one (``!www.ck``). The exception counts, else
    the rule with most labels; without any the last label is the suffix and ``known`` is false. Hosts that are a suffix themselves
    have no registrable domain. Null and empty hosts have no row; each host has one.
    """
    last = lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)
    n, size = F.col("n"), F.size(F.split("host", r"\."))
    one = hosts.select(F.lower("host").alias("host")).where("host <> ''").distinct()
    tails = one.select("host", F.explode(F.sequence(F.lit(1), size)).alias("n"))
    key = lambda rule, n, excepted: F.struct(rule.alias("rule"), n.alias("n"), F.lit(excepted).alias("except"))
    keys = F.array(key(last(n), n, False), key(F.when(n > 1, F.concat(F.lit("*."), last(n - 1))), n, False), key(F.concat(F.lit("!"), last(n)), n - 1, True))
    hit = tails.select("host", F.inline(keys)).join(rules.select(F.lower(F.trim("rule")).alias("rule")).distinct(), "rule")
    best = hit.groupBy("host").agg(F.max_by("n", F.struct("except", "n")).alias("n"))
    out = one.join(best, "host", "left").withColumn("known", n.isNotNull()).withColumn("n", F.coalesce(n, F.lit(1)))
    return out.select("host", last(n).alias("public_suffix"), F.when(size > n, last(n + 1)).alias("registrable"), "known")
