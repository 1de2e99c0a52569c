"""Relations between entities: allowed pairs, senders of messages, proposals, sources and nested reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import url_host
from .facts import debit_cue, paid_cue

# Which types a relation may join.
ALLOWED_PAIRS = {
    "HOSTED_ON": (("URL",), ("DOMAIN",)),
    "SENT_LINK": (("PHONE", "MESSAGING_HANDLE", "EMAIL", "SMS_SENDER_HEADER"), ("URL",)),
    "REQUESTED_PAYMENT_TO": (("PHONE", "MESSAGING_HANDLE", "EMAIL"), ("UPI_ID",)),
    "PAID_TO": (("TRANSACTION",), ("UPI_ID",)),
    "AMOUNT_OF": (("AMOUNT",), ("TRANSACTION",)),
    "DEBITED_FROM": (("TRANSACTION",), ("ACCOUNT_HINT",)),
    "MESSAGE_CONTAINED": (("SMS_SENDER_HEADER", "EMAIL"), ("PHONE", "URL", "UPI_ID")),
    "CONTACTED_FROM": (("PHONE",), ("PERSON",)),
}
# Types that are validated against their source, never judged.
IDENTIFIERS = ("PHONE", "URL", "DOMAIN", "EMAIL", "UPI_ID", "TRANSACTION", "AMOUNT", "ACCOUNT_HINT", "SMS_SENDER_HEADER", "MESSAGING_HANDLE")
CONTAINED = ALLOWED_PAIRS["MESSAGE_CONTAINED"][1]


def allowed_pairs(spark: SparkSession) -> DataFrame:
    """``relation, from_type, to_type``: 18 rows."""
    return spark.createDataFrame([(r, a, b) for r, (left, right) in ALLOWED_PAIRS.items() for a in left for b in right], "relation string, from_type string, to_type string")


def confidence_basis(field_type: Column, method: Column) -> Column:
    """Identifiers always rest on their source; a model's name of a person is a judgement."""
    return F.when(~field_type.isin(*IDENTIFIERS) & (method == "LLM") & (field_type == "PERSON"), "MODEL_JUDGEMENT").otherwise("SOURCE_VALIDATION")


def correlation_input(facts: DataFrame) -> DataFrame:
    """Facts that correlation reads: of processed items, normal, with an entity and at least one line."""
    return facts.where("evidence_status = 'PROCESSED' and status = 'NORMALIZED' and entity_id is not null and n_lines > 0")


def message_senders(items: DataFrame, facts: DataFrame) -> DataFrame:
    """The one sender of each item, if it has one: ``evidence_id, sender``.

    Mail: the only e-mail entity on the only From line. Other items: the only SMS header, one fact and one entity.
    ``items``: ``evidence_id, kind``; ``facts``: ``evidence_id, field_type, entity_id, header_name, line_number``.
    """
    sms = facts.where("field_type = 'SMS_SENDER_HEADER'").groupBy("evidence_id").agg(F.count("*").alias("n"), F.max("entity_id").alias("sender"))
    sms = items.where("kind <> 'EML'").join(sms.where("n = 1"), "evidence_id").select("evidence_id", "sender")
    on_from = F.lower("header_name") == "from"
    mail = facts.where(on_from).groupBy("evidence_id").agg(F.count_distinct("line_number").alias("n_lines"), F.count_distinct(F.when(F.col("field_type") == "EMAIL", F.col("entity_id"))).alias("n"), F.max(F.when(F.col("field_type") == "EMAIL", F.col("entity_id"))).alias("sender"))
    mail = items.where("kind = 'EML'").join(mail.where("n = 1 and n_lines = 1"), "evidence_id").select("evidence_id", "sender")
    return sms.unionByName(mail)


def messages_contained(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges from each item's sender, as ``message_senders`` has it, to the entities it holds, with the items that support them; one pass over the facts."""
    kind, entity = F.col("field_type"), F.col("entity_id")
    sms, on_from, held = kind == "SMS_SENDER_HEADER", F.coalesce(F.lower("header_name") == "from", F.lit(False)), kind.isin(*CONTAINED)
    ends = lambda test, x, name: [F.min(F.when(test, x)).alias(f"{name}0"), F.max(F.when(test, x)).alias(f"{name}1")]
    per = facts.where(sms | on_from | held).groupBy("evidence_id").agg(F.count_if(sms).alias("n_sms"), F.max(F.when(sms, entity)).alias("sms"), *ends(on_from, F.col("line_number"), "line"), *ends(on_from & (kind == "EMAIL"), entity, "mail"), F.collect_set(F.when(held, entity)).alias("held"))
    mail = F.col("kind") == "EML"
    own = items.join(per, "evidence_id").where((~mail & (F.col("n_sms") == 1)) | (mail & (F.col("line0") == F.col("line1")) & (F.col("mail0") == F.col("mail1"))))
    found = own.select("evidence_id", F.when(mail, F.col("mail0")).otherwise(F.col("sms")).alias("from_entity"), F.explode("held").alias("to_entity"))
    return found.groupBy("from_entity", "to_entity").agg(F.count("*").alias("n_items"), F.min("evidence_id").alias("first_item"))


#: What a cue must say for each relation that rests on one; ``item_cues`` finds them.
CUED = ("HOSTED_ON", "PAID_TO", "DEBITED_FROM", "MESSAGE_CONTAINED")


def item_cues(lines: DataFrame, facts: DataFrame, items: DataFrame) -> DataFrame:
    """``evidence_id, relation, from_entity, to_entity``: what an item's text lets a proposal say; null stands for any entity.

    HOSTED_ON needs a line with the URL and its domain; PAID_TO and DEBITED_FROM need their words in the item; MESSAGE_CONTAINED needs
    the item's one sender. ``lines``: ``evidence_id, line_number, text``; ``facts``: ``evidence_id, entity_id, field_type, line_number,
    header_name, normalized_value``.
    """
    any_ = F.lit(None).cast(dict(facts.dtypes)["entity_id"])
    own = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    text = lines.groupBy("evidence_id").agg(F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"))
    said = lambda cue, name: text.where(cue(F.col("text"))).select("evidence_id", F.lit(name).alias("relation"), any_.alias("from_entity"), any_.alias("to_entity"))
    url = facts.where("field_type = 'URL'").select("evidence_id", "line_number", F.col("entity_id").alias("from_entity"), url_host(F.col("normalized_value")).alias("host"))
    domain = facts.where("field_type = 'DOMAIN'").select("evidence_id", "line_number", F.col("entity_id").alias("to_entity"), F.lower("normalized_value").alias("host"))
    hosted = url.join(domain, ["evidence_id", "line_number", "host"]).select("evidence_id", F.lit("HOSTED_ON").alias("relation"), "from_entity", "to_entity").distinct()
    sender = message_senders(items, facts).select("evidence_id", F.lit("MESSAGE_CONTAINED").alias("relation"), F.col("sender").alias("from_entity"), any_.alias("to_entity"))
    return hosted.unionByName(sender).unionByName(said(paid_cue, "PAID_TO")).unionByName(said(debit_cue, "DEBITED_FROM"))


def judge_proposals(proposals: DataFrame, entities: DataFrame, facts: DataFrame, pairs: DataFrame, cues: DataFrame | None = None) -> DataFrame:
    """``proposal_id, rejection, support``: the first rule that a proposal breaks, null if none; its facts, sorted.

    Both ends must be different entities of a pair that the relation allows; each cited item must hold a cited fact of
    either end; no cited fact may be of anything else. With ``cues`` (of ``item_cues``) a relation that rests on one must have it
    in every cited item. ``proposals``: ``proposal_id, from_entity, relation, to_entity,
    evidence_ids, fact_ids``; ``entities``: ``entity_id, field_type``; ``facts``: ``fact_id, evidence_id, entity_id``.
    """
    end = lambda x: entities.select(F.col("entity_id").alias(f"{x}_entity"), F.col("field_type").alias(f"{x}_type"))
    ends = proposals.join(end("from"), "from_entity", "left").join(end("to"), "to_entity", "left")
    ends = ends.join(F.broadcast(pairs.withColumn("pair", F.lit(True))), ["relation", "from_type", "to_type"], "left")
    cited = proposals.select("proposal_id", "from_entity", "to_entity", "fact_ids", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    own = cited.join(facts, "evidence_id", "left")
    at = lambda x: F.coalesce(F.bool_or((F.col("entity_id") == F.col(f"{x}_entity")) & F.array_contains("fact_ids", F.col("fact_id"))), F.lit(False))
    mine = F.when(F.col("entity_id").isin(F.col("from_entity"), F.col("to_entity")), F.col("fact_id"))
    if cues is None:
        cued = cited.withColumn("cued", F.lit(True))
    else:
        rests = cited.join(proposals.select("proposal_id", "relation"), "proposal_id")
        hit = cues.select("evidence_id", "relation", F.col("from_entity").alias("_from"), F.col("to_entity").alias("_to"))
        fits = F.coalesce(F.col("_from") == F.col("from_entity"), F.lit(True)) & F.coalesce(F.col("_to") == F.col("to_entity"), F.lit(True))
        held = rests.join(hit, ["evidence_id", "relation"]).where(fits).select("proposal_id", "evidence_id").distinct().withColumn("_held", F.lit(True))
        cued = rests.join(held, ["proposal_id", "evidence_id"], "left").withColumn("cued", F.col("_held").isNotNull() | ~F.col("relation").isin(*CUED))
    cued = cued.groupBy("proposal_id").agg(F.bool_and("cued").alias("cued"))
    per = own.groupBy("proposal_id", "evidence_id").agg((at("from") & at("to")).alias("both"), F.collect_set(mine).alias("support"))
    per = per.groupBy("proposal_id").agg(F.bool_and("both").alias("supported"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("support")))).alias("support"))
    rejection = (
        F.when(F.col("from_type").isNull() | F.col("to_type").isNull(), "UNKNOWN_ENTITY")
        .when(F.col("from_entity") == F.col("to_entity"), "SAME_ENTITY")
        .when(F.col("pair").isNull(), "PAIR_NOT_ALLOWED")
        .when(~F.coalesce("supported", F.lit(False)), "UNSUPPORTED_ITEM")
        .when(~F.coalesce("cued", F.lit(False)), "NO_CUE")
        .when(F.size(F.array_except("fact_ids", "support")) > 0, "FOREIGN_FACT")
    )
    return ends.join(per, "proposal_id", "left").join(cued, "proposal_id", "left").select("proposal_id", rejection.alias("rejection"), "support")


def source_reference(fact_lines: DataFrame) -> DataFrame:
    """``fact_id, page, line_numbers, header_name, snippet``: the first line's page, the numbers of the lines on it, its header and text.

    ``fact_lines``: ``fact_id, page, line_number, header_name, text``.
    """
    first = F.struct("page", "line_number")
    out = fact_lines.groupBy("fact_id").agg(F.min("page").alias("page"), F.min_by("header_name", first).alias("header_name"), F.min_by("text", first).alias("text"), F.collect_set(F.struct("page", "line_number")).alias("all"))
    own = F.array_sort(F.transform(F.filter("all", lambda x: x["page"] == F.col("page")), lambda x: x["line_number"]))
    return out.select("fact_id", "page", own.alias("line_numbers"), "header_name", F.substring("text", 1, 200).alias("snippet"))


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Each parent with the sorted array of its children, each with its ``ordinal`` from 1; an empty array without any.

    A parent's children are one row by design, as a reader of one parent wants them; parents without a bound on their children need ``join``.
    """
    rest = [c for c in children.columns if c not in (key, *order)]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, *rest))), lambda x, i: x.withField("ordinal", i + 1))
    made = children.groupBy(key).agg(rows.alias(name))
    out = parents.join(made, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(made.schema[name].dataType)))


def prompt_block(lines: DataFrame) -> DataFrame:
    """A document's lines as one block with opaque references L1, L2, ...; angle brackets can't close it."""
    safe = F.regexp_replace(F.regexp_replace(F.col("text"), "<", "&lt;"), ">", "&gt;")
    rows = F.array_sort(F.collect_list(F.struct("line_number", safe.alias("text"))))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), x["text"])), "\n").alias("block"))


def display_names(headers: DataFrame) -> DataFrame:
    """Names in From lines before the address: ``doc_id, line_number, raw_value, start``. ``headers``: ``doc_id, line_number, header_name, text``."""
    name = F.trim(F.regexp_extract("text", r'^\s*"?([^"<]*?)"?\s*<', 1))
    out = headers.where(F.lower("header_name") == "from").withColumn("raw_value", name).where("raw_value <> ''")
    return out.select("doc_id", "line_number", "raw_value", (F.instr("text", F.col("raw_value")) - 1).alias("start"))
