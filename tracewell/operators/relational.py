"""Relational building blocks of the read models: latest row, filtered counts, pages, guards, merges."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, status: str, values: dict[str, str]) -> DataFrame:
    """Each parent with its number of children, in all and for each status; parents without children have zeros."""
    counts = children.groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(name) for name, v in values.items()])
    out = parents.select(parent_key).join(counts, F.col(parent_key) == F.col("_key"), "left").drop("_key")
    return out.na.fill(0, ["total", *values])


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order; ranks are limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keyset_page(rows: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The next ``size`` rows, newest first, strictly behind the row with the key ``after``; one row more tells whether there is another page."""
    if after is not None:
        values = [F.lit(x).cast(rows.schema[c].dataType) for c, x in zip(order, after, strict=True)]
        rows = rows.where((F.col(order[0]) <= values[0]) & (F.struct(*order) < F.struct(*values)))  # the first part reaches the scan
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(size)


def page_with_cursor(rows: DataFrame, order: list[str], size: int, after: tuple | None = None) -> tuple[DataFrame, bool, tuple | None]:
    """A page, whether there is another, and the key behind which that one starts. Only ``size + 1`` keys come to the driver."""
    keys = keyset_page(rows, order, size + 1, after).select(*order).collect()
    last = tuple(keys[size - 1]) if len(keys) > size else None
    return keyset_page(rows, order, size, after), last is not None, last


def encode_cursor(timestamp: str, key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([timestamp, key]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    """The key in a cursor; ValueError if it isn't one."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except Exception as e:
        raise ValueError("not a cursor") from e
    forms = (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z", r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
    if not (isinstance(found, list) and len(found) == 2 and all(isinstance(x, str) and re.fullmatch(f, x) for f, x in zip(forms, found, strict=True))):
        raise ValueError("not a cursor")
    return found[0], found[1]


#: Rows of a task, about, where what a task holds would grow with the table.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, *by: str, like: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt by key to as many tasks as the table ``like`` (``rows`` itself) has times ``TASK_ROWS`` rows, the session's number of them at least."""
    n = -(-(rows if like is None else like).count() // TASK_ROWS)  # Parquet has it in its footers
    return rows.repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def exactly_one(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Groups with exactly one distinct value, and that value."""
    return rows.groupBy(by).agg(F.count_distinct(value).alias("_n"), F.max(value).alias(value)).where("_n = 1").drop("_n")


def lowest_free_slot(rows: DataFrame, by: str, slot: str, most: int) -> DataFrame:
    """The smallest number from 1 to ``most`` that a group doesn't use; null if all are taken."""
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(most)), F.collect_set(F.col(slot).cast("int"))))
    return rows.groupBy(by).agg(free.alias("free_slot"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of either side by natural key; the new side wins but for the columns in ``keep``, which an old row keeps."""
    cols = [c for c in new.columns if c not in key]
    a = old.select(*[F.col(k).alias(f"o_{k}") for k in key], *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("in_old"))
    b = new.select(*key, *cols, F.lit(True).alias("in_new"))
    both = a.join(b, [a[f"o_{k}"].eqNullSafe(b[k]) for k in key], "full")
    pick = lambda c: F.when(F.col("in_new").isNull() | (F.col("in_old") if c in keep else F.lit(False)), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.when(F.col("in_new"), F.col(k)).otherwise(F.col(f"o_{k}")).alias(k) for k in key], *[pick(c) for c in cols])


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet."""
    return new.join(old.select(*key).distinct(), key, "left_anti")


def reconcile(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Every key with what to do: ``insert``, ``keep`` or ``delete``."""
    a, b = old.select(*key).distinct().withColumn("in_old", F.lit(True)), new.select(*key).distinct().withColumn("in_new", F.lit(True))
    both = a.join(b, key, "full")
    return both.select(*key, F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "delete").otherwise("keep").alias("change"))


def violations(rows: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """Rows that fail a check (null counts as passed, as SQL's CHECK has it), once for each check."""
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return rows.select(key, F.explode(failed).alias("failed_check"))


def cascade(gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What is left of each child table (and the column that points at ``key``) when the rows in ``gone`` are deleted; tables that aren't named, such as the audit, stay."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return {name: rows.join(ids, rows[column] == ids["_gone"], "left_anti") for name, (rows, column) in children.items()}


def guarded_update(rows: DataFrame, status: str, after: Column, allowed: Column) -> DataFrame:
    """Rows whose status becomes ``after`` where ``allowed`` holds; ``changed`` tells which did."""
    ok = F.coalesce(allowed, F.lit(False))
    return rows.withColumn("changed", ok).withColumn(status, F.when(ok, after).otherwise(F.col(status)))


def merged_map(old: Column, new: Column) -> Column:
    """A shallow merge of maps: entries of ``new`` win; null counts as empty."""
    kind = "map<string,string>"
    a, b = F.coalesce(old, F.create_map().cast(kind)), F.coalesce(new, F.create_map().cast(kind))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def partial_update(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with patches merged in, and ``changed_fields``. A patch has ``given`` (an array of field names): what isn't given stays, what is given as null becomes null."""
    p = patches.select(key, "given", *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = rows.join(p, key, "left")
    given = lambda c: F.coalesce(F.array_contains("given", c), F.lit(False))
    changed = F.array_compact(F.array(*[F.when(given(c) & ~F.col(c).eqNullSafe(F.col(f"_new_{c}")), F.lit(c)) for c in columns]))
    rest = [c for c in rows.columns if c not in columns]
    return both.select(*rest, *[F.when(given(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns], changed.alias("changed_fields"))


def immutable_violations(before: DataFrame, after: DataFrame, key: str, frozen: list[str], since: Column | None = None) -> DataFrame:
    """``key, column`` of values that changed though they were set (or though ``since`` held before): each may be set once."""
    a = before.select(F.col(key), *[F.col(c).alias(f"_was_{c}") for c in frozen], (F.lit(True) if since is None else since).alias("_fixed"))
    both = a.join(after.select(key, *frozen), key)
    fixed = lambda c: F.col("_fixed") if since is not None else F.col(f"_was_{c}").isNotNull()
    return both.select(key, F.explode(F.array_compact(F.array(*[F.when(fixed(c) & ~F.col(c).eqNullSafe(F.col(f"_was_{c}")), F.lit(c)) for c in frozen]))).alias("column"))


def duplicates(rows: DataFrame, key: list[str], where: Column | None = None) -> DataFrame:
    """Keys that more than one row has, of those that ``where`` selects: what a unique index would refuse; keys with a null are never equal."""
    some = rows if where is None else rows.where(where)
    return some.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
