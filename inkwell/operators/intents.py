"""Question intents by ordered rules, and the chunks they pin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.matching import substring_join

# Question patterns, in order of precedence; the first that matches decides.
DEATH_GATE = "死|亡|丧命|殒命|遇害|杀|斩|结局|遗言|遗诏|遗嘱|遗书|遗表|遗令|托孤|临终|驾崩|卒年|享年|去世|活了多少岁"
INTENTS = (
    ("death_agent", "被谁|谁杀|谁斩|谁所杀|死于谁手|死在谁手|何人.*杀"),
    ("death_place", "死[在哪于]|死于何地|丧命何处|殒命.*[何哪处]"),
    ("death_time", "何时.*死|什么时候.*死|死.*(在哪年|何年|哪年)"),
    ("death_age", "死的时候.*(多少岁|几岁|多大)|死时(多少岁|几岁|多大)|享年|卒年|去世时(多少岁|几岁|多大)|活了多少岁"),
    ("death_confirm", "死了(吗|没有)?[？?]?$|死没死"),
    ("death_manner", "怎么.*死|如何.*死|死因|死亡原因|因何.*死|为何.*死|是怎么没的|之死$"),
    ("death_last_words", "临终|死前|死时|遗言|遗诏|遗嘱|遗书|遗表|遗令|托孤|嘱托|交代后事"),
    ("death_aftermath", "死后|死了之后|结局|后来.*(怎样|如何)|之后.*(继任|接任|怎样)"),
)
BIRTH = "出场|登场|出世|露面|亮相|舞台|现身|出现"
# Words of tags about last words.
LAST_WORDS = "托孤|遗诏|遗令|遗言|遗嘱|遗书|遗表|临终"
# Tags that name a person: kind, beginning, ending.
PERSON_TAGS = (("death", "人物之死-", "之死"), ("birth", "人物之生-", "登场"), ("birth", "登场-", ""), ("speech", "遗言-", ""))


def intent_of(text: str) -> Column:
    """The death intent of a question, null without one."""
    c, out = F.col(text), None
    for kind, pattern in INTENTS:
        out = F.when(c.rlike(pattern), kind) if out is None else out.when(c.rlike(pattern), kind)
    return F.when(c.rlike(DEATH_GATE), out)


def direction_of(intent: Column) -> Column:
    """How a query's pins are ordered: later first for what came after, by score for last words, else earlier first."""
    return F.when(intent == "death_aftermath", -1).when(intent == "death_last_words", 0).otherwise(1)


def people_of_tags(tagged: DataFrame) -> DataFrame:
    """(kind, person, doc) of ``tagged(doc, tag)``: deaths, first appearances and last words of persons.

    Beside the tags that name a person by their form, a chunk with a tag about last words is one of every person
    of a death tag whose name its tags contain.
    """
    kind = person = None
    for k, begin, end in PERSON_TAGS:
        fits = F.col("tag").startswith(begin)
        rest = F.substring(F.col("tag"), len(begin) + 1, 1 << 20)
        rest = F.regexp_replace(rest, end + "$", "") if end else rest
        kind = F.when(fits, k) if kind is None else kind.when(fits, k)
        person = F.when(fits, rest) if person is None else person.when(fits, rest)
    named = tagged.select(kind.alias("kind"), person.alias("person"), "doc").where("kind is not null and person <> ''").distinct()
    dead = named.where("kind = 'death'").select("person").distinct()
    last = tagged.where(F.col("tag").rlike(LAST_WORDS)).select("doc").distinct()
    said = substring_join(tagged.join(last, "doc", "left_semi").select("doc", "tag"), "tag", dead, "person").select(F.lit("speech").alias("kind"), "person", "doc")
    return named.unionByName(said).distinct()


def intent_pins(queries: DataFrame, people: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """(qid, doc, direction): chunks that the intents of ``queries(qid, text)`` pin.

    ``people(kind, person, doc)`` has the chunks of persons' deaths (``death``), last words (``speech``) and
    first appearances (``birth``). A person counts when the question contains the name or ``expanded(qid,
    person)`` says that an alias in it stands for the person. A question about last words takes the speech
    chunks of a person, or the death chunks if there are none; about age both; other death questions the death
    chunks; a question about appearance the birth chunks. ``direction`` orders a query's pins by id: 1 earlier
    first, -1 later first (what came after), 0 by score (last words).
    """
    asked = queries.select("qid", "text", intent_of("text").alias("intent"), F.col("text").rlike(BIRTH).alias("birth")).where("intent is not null or birth")
    names = people.select("person").distinct()
    named = substring_join(asked, "text", names, "person").drop("text")
    if expanded is not None:
        named = named.unionByName(asked.drop("text").join(expanded.select("qid", "person"), "qid")).distinct()
    has_speech = people.where("kind = 'speech'").select("person", F.lit(True).alias("speaks")).distinct()
    rows = named.join(has_speech, "person", "left").join(people, "person")
    death_kinds = (
        F.when(F.col("intent") == "death_age", F.col("kind").isin("death", "speech"))
        .when((F.col("intent") == "death_last_words") & F.col("speaks").isNotNull(), F.col("kind") == "speech")
        .when(F.col("intent").isNotNull(), F.col("kind") == "death")
        .otherwise(F.lit(False))
    )
    kept = rows.where(death_kinds | (F.col("birth") & (F.col("kind") == "birth")))
    return kept.select("qid", "doc", direction_of(F.col("intent")).alias("direction")).distinct()
