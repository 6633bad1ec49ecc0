"""Chat logs: last messages, intents, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.functions import text as T


def last_turns(conversations: DataFrame) -> DataFrame:
    """The last message of each conversation; combined before the shuffle."""
    return conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"))


def last_user_message(conversations: DataFrame) -> DataFrame:
    """Conversations that end with a message of the user that isn't blank."""
    last = last_turns(conversations).where("role = 'user'").withColumn("text", T.message_text(F.col("text")))
    return last.where(F.col("text").rlike(r"\S")).select("conv_id", "turn", "text")


def last_assistant(conversations: DataFrame) -> DataFrame:
    """The assistant's last message before the last message of all."""
    ends = conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    said = conversations.where("role = 'assistant'").join(ends, "conv_id").where("turn < last")
    return said.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def route_messages(conversations: DataFrame) -> DataFrame:
    """What the user's last message asks for: intent, repo and branch, class of a graph command, enriched question."""
    m = last_user_message(conversations)
    text = F.col("text")
    index_repo, index_branch = T.index_arguments(text)
    m = m.withColumn("intent", T.intent(text))
    is_index = F.col("intent") == "index"
    return m.withColumns({
        "repo": F.when(is_index, index_repo).otherwise(T.first_repo(text)), "branch": F.when(is_index, index_branch).otherwise(T.first_branch(text)),
        "class_name": F.when(F.col("intent") == "graph", F.regexp_extract(text, T.GRAPH, 1)), "question": F.when(F.col("intent") == "question", T.enrich_query(text)),
    })


def to_markdown(df: DataFrame) -> DataFrame:
    """(title, content, repo?, branch?) to (filename, content): front matter if repo or branch is given."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    row = lambda c: F.coalesce(F.when(given(c), F.concat(F.lit(f"{c}: "), F.col(c), F.lit("\n"))), F.lit(""))
    front = F.when(given("repo") | given("branch"), F.concat(F.lit("---\n"), row("repo"), row("branch"), F.lit("---\n\n"))).otherwise("")
    return df.select(F.concat(F.replace("title", F.lit(" "), F.lit("_")), F.lit(".md")).alias("filename"), F.concat(front, F.coalesce("content", F.lit(""))).alias("content"))
