"""From what was read in chunks to topics: mentions become topics, their fields and relations follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators.graph import components
from scriptoria.operators.tables import settled

#: Names at least as alike as this are taken for one topic, unless it was decided that they are not.
ALIKE = 0.5


def normal_name(name: Column) -> Column:
    """The search tokens of a name: case, marks, endings and stop words make no new name."""
    return F.array_join(T.search_tokens(T.collapsed(F.coalesce(name, F.lit("")))), " ")


def labels_of(mentions: DataFrame) -> DataFrame:
    """subject_id, mention_id, label and primary (whether the label is the mention's name, not an alias), without empty labels."""
    own = F.array(F.struct(normal_name(F.col("name")).alias("label"), F.lit(True).alias("primary")))
    more = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(normal_name(a).alias("label"), F.lit(False).alias("primary")))
    return mentions.select("subject_id", "mention_id", F.inline(F.concat(own, more))).where("label <> ''")


def alike_labels(labels: DataFrame, least: float = ALIKE) -> DataFrame:
    """Pairs of different labels (subject_id, label, first_id and other_label, other_id) of one subject with Jaccard `least` or
    more, of which at least one is a name. Labels meet on their rarest tokens, so no pair is missed and frequent words pair
    nothing; a label that many mentions have is one."""
    each = labels.groupBy("subject_id", "label").agg(F.min("mention_id").alias("first_id"), F.max("primary").alias("primary"))
    each = each.withColumn("tokens", F.array_distinct(F.split("label", " ")))
    words = each.select("subject_id", "label", "first_id", "primary", "tokens", F.explode("tokens").alias("token"))
    df = words.groupBy("subject_id", "token").agg(F.count("*").alias("df")).toDF("df_subject", "df_token", "df")
    counted = words.join(df, F.col("subject_id").eqNullSafe(F.col("df_subject")) & (F.col("token") == F.col("df_token")))
    ranked = counted.groupBy("subject_id", "label", "first_id", "primary", "tokens").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    # of two sets with Jaccard s or more, the first size - ceil(s * size) + 1 words in any fixed order have one in common
    prefix = F.slice("ranked.token", F.lit(1), (F.size("tokens") - F.ceil(F.lit(least) * F.size("tokens")) + 1).cast("int"))
    a = ranked.select("subject_id", "label", "first_id", "primary", "tokens", F.explode(prefix).alias("token"))
    b = a.toDF("other_subject", "other_label", "other_id", "other_primary", "other_tokens", "other_token")
    pairs = a.join(b, F.col("subject_id").eqNullSafe(F.col("other_subject")) & (F.col("token") == F.col("other_token")) & (F.col("label") < F.col("other_label")))
    pairs = pairs.where(F.col("primary") | F.col("other_primary")).where(T.jaccard(F.col("tokens"), F.col("other_tokens")) >= least)
    return pairs.select("subject_id", "label", "first_id", "other_label", "other_id").distinct()


def resolved_topics(mentions: DataFrame, apart: DataFrame | None = None, least: float = ALIKE) -> DataFrame:
    """mention_id and topic_id for every mention (mention_id long, subject_id, name, aliases array<string>).

    Mentions of a subject are one topic if they share a normal name or alias, or if a name is as alike as `least` to a name or
    alias of the other, through any number of mentions in between. A topic's id is the smallest id of its mentions. apart
    (subject_id, name, other_name) has pairs of names that were decided to be different topics: they are not joined for being
    alike, equal names always are.

    Mentions without a usable name are topics of their own; null subjects are one subject; repeated rows are one mention; an
    empty table gives no rows.
    """
    labels = settled(labels_of(mentions))
    firsts = labels.groupBy("subject_id", "label").agg(F.min("mention_id").alias("first_id"))
    same = labels.join(firsts.toDF("s", "l", "first_id"), F.col("subject_id").eqNullSafe(F.col("s")) & (F.col("label") == F.col("l"))).select("mention_id", "first_id")
    near = alike_labels(labels, least)
    if apart is not None:
        x, y = normal_name(F.col("name")), normal_name(F.col("other_name"))
        no = apart.select(F.col("subject_id").alias("s"), F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()
        near = near.join(no, F.col("subject_id").eqNullSafe(F.col("s")) & (F.col("label") == F.col("x")) & (F.col("other_label") == F.col("y")), "left_anti")
    links = same.unionByName(near.select(F.col("first_id").alias("mention_id"), F.col("other_id").alias("first_id")))
    found = components(links, "mention_id", "first_id")
    out = mentions.select("mention_id").distinct().join(found, F.col("mention_id") == F.col("node"), "left")
    return out.select("mention_id", F.coalesce("component", "mention_id").alias("topic_id"))


def topics_of(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """topic_id, subject_id, name (that of the smallest mention), mentions, emphasis (mentions that stress it)."""
    first = F.min(F.struct("mention_id", "subject_id", T.collapsed(F.col("name")).alias("name"))).alias("first")
    rows = mentions.join(resolved, "mention_id").groupBy("topic_id").agg(first, F.count("*").alias("mentions"), F.count_if(F.coalesce("emphasized", F.lit(False))).alias("emphasis"))
    return rows.select("topic_id", "first.subject_id", "first.name", "mentions", "emphasis")


def topic_aliases(mentions: DataFrame, resolved: DataFrame, topics: DataFrame) -> DataFrame:
    """topic_id and alias, a row for each: other names and aliases of its mentions that are not its name in another spelling."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = mentions.join(resolved, "mention_id").select("topic_id", F.explode(every).alias("alias")).select("topic_id", T.collapsed(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    kept = names.join(topics.select("topic_id", "name"), "topic_id").where(normal_name(F.col("alias")) != normal_name(F.col("name")))
    return kept.select("topic_id", "alias")


def merged_fields(fields: DataFrame) -> DataFrame:
    """field_id and kept_id, the field that stands for it, for fields (field_id long, topic_id, field_type, text, quote): those
    of one topic and part with the same text or the same quote, apart from case, dashes, quotation marks and layout, are one,
    through any number of fields in between. Empty quotes join nothing."""
    key = lambda c: T.normalized_for_match(F.coalesce(F.col(c), F.lit("")))
    keyed = fields.select("field_id", "topic_id", "field_type", F.explode(F.array(F.concat(F.lit("t"), key("text")), F.concat(F.lit("q"), key("quote")))).alias("key")).where("length(key) > 1")
    by = ["topic_id", "field_type", "key"]
    firsts = keyed.groupBy(*by).agg(F.min("field_id").alias("first_id"))
    links = keyed.join(firsts, by).select("field_id", "first_id")
    found = components(links, "field_id", "first_id")
    out = fields.select("field_id").distinct().join(found, F.col("field_id") == F.col("node"), "left")
    return out.select("field_id", F.coalesce("component", "field_id").alias("kept_id"))


def resolved_relations(relations: DataFrame, mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """from_topic, type, to_topic, draft for relations (mention_id, type, target): the topic of the subject that has the target's
    normal name or alias, the smallest where several have it. A target that no mention has is a draft topic: to_topic is null
    and draft its normal name. A relation of a topic to itself goes, and equal ones are one."""
    labels = labels_of(mentions).join(resolved, "mention_id").groupBy("subject_id", "label").agg(F.min("topic_id").alias("to_topic"))
    rows = relations.select("mention_id", "type", T.collapsed(F.col("target")).alias("target")).where(F.length("target").between(1, 120))
    rows = rows.join(mentions.select("mention_id", "subject_id"), "mention_id").join(resolved.withColumnRenamed("topic_id", "from_topic"), "mention_id")
    rows = rows.withColumn("draft", normal_name(F.col("target"))).where("draft <> ''")
    found = rows.join(labels.withColumnRenamed("subject_id", "s"), F.col("subject_id").eqNullSafe(F.col("s")) & (F.col("draft") == F.col("label")), "left")
    out = found.select("from_topic", "type", "to_topic", F.when(F.col("to_topic").isNull(), F.col("draft")).alias("draft")).distinct()
    return out.where("to_topic IS NULL OR to_topic <> from_topic")


def related_topics(relations: DataFrame, kind: str, k: int) -> DataFrame:
    """topic_id, related_id and place: up to k topics that a relation of a kind joins to a topic, whichever end it is of, the
    smallest first. Drafts are left out."""
    ends = relations.where((F.col("type") == kind) & F.col("to_topic").isNotNull())
    both = ends.select(F.col("from_topic").alias("topic_id"), F.col("to_topic").alias("related_id")).unionByName(ends.select(F.col("to_topic").alias("topic_id"), F.col("from_topic").alias("related_id")))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy("related_id"))
    return both.distinct().withColumn("place", place).where(F.col("place") <= k)
