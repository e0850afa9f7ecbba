"""Edits of nested user records: user_id, and threads, a map of thread id to (name, created, updated, documents, chats).

Each edit is a column expression that leaves all other threads as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAT = "struct<role:string,text:string,ts:bigint>"
DOCUMENT = "struct<doc_id:string,file_name:string>"
THREAD = f"struct<name:string,created:bigint,updated:bigint,documents:array<{DOCUMENT}>,chats:array<{CHAT}>>"
USER = f"user_id string, name string, email string, threads map<string,{THREAD}>"


def _edit(thread: str, change) -> Column:
    return F.transform_values("threads", lambda k, t: F.when(k == thread, change(t)).otherwise(t))


def create_thread(thread: str, name: str, now: int) -> Column:
    """M2; an existing thread of that id is replaced."""
    fresh = F.struct(F.lit(name).alias("name"), F.lit(now).cast("long").alias("created"), F.lit(now).cast("long").alias("updated"), F.array().cast(f"array<{DOCUMENT}>").alias("documents"), F.array().cast(f"array<{CHAT}>").alias("chats")).cast(THREAD)
    return F.map_concat(F.map_filter("threads", lambda k, t: k != thread), F.create_map(F.lit(thread), fresh))


def rename_thread(thread: str, name: str, now: int) -> Column:
    """M3."""
    return _edit(thread, lambda t: t.withField("name", F.lit(name)).withField("updated", F.lit(now).cast("long")))


def delete_thread(thread: str) -> Column:
    """M4."""
    return F.map_filter("threads", lambda k, t: k != thread)


def append(thread: str, what: str, items: Column, now: int) -> Column:
    """M5: items behind the thread's documents or chats."""
    return _edit(thread, lambda t: t.withField(what, F.concat(t[what], items)).withField("updated", F.lit(now).cast("long")))


def delete_chat(thread: str, index: int) -> Column:
    """M6: a place that there is not changes nothing."""
    def change(t: Column) -> Column:
        n = F.size(t["chats"])
        inside = (F.lit(index) >= 0) & (F.lit(index) < n)
        rest = F.concat(F.slice(t["chats"], F.lit(1), F.lit(index)), F.slice(t["chats"], F.lit(index + 2), F.greatest(F.lit(0), n - index - 1)))
        return F.when(inside, t.withField("chats", rest)).otherwise(t)

    return _edit(thread, change) if index >= 0 else F.col("threads")


def clear_chats(thread: str) -> Column:
    """M7."""
    return _edit(thread, lambda t: t.withField("chats", F.array().cast(f"array<{CHAT}>")))


def find_document(thread: str, file_name: str) -> Column:
    """M9: the first document of that name, or null."""
    return F.get(F.filter(F.element_at("threads", thread)["documents"], lambda d: d["file_name"] == file_name), 0)


def totals(users: DataFrame) -> DataFrame:
    """Threads, documents and chats of each user."""
    of = lambda what: F.aggregate(F.map_values("threads"), F.lit(0).cast("long"), lambda a, t: a + F.size(t[what]))
    return users.select("user_id", F.size("threads").cast("long").alias("threads"), of("documents").alias("documents"), of("chats").alias("chats"))


def create_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """M1: users and the new ones whose id and e-mail nobody has yet, names in title case. Of new ones with one id or one e-mail only
    the first by id and name enters; one that gives way to another keeps no e-mail from a third. Those without an id or an e-mail have none in common."""
    fresh = new.join(users.select("email"), "email", "left_anti").join(users.select("user_id"), "user_id", "left_anti")
    for key in ("user_id", "email"):
        order = Window.partitionBy(key).orderBy("user_id", "name", "email")
        told = fresh.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
        fresh = told.unionByName(fresh.where(F.col(key).isNull()))
    return users.unionByName(fresh.withColumn("name", F.initcap("name")).select(*users.columns))


def extra_done(thread: str, done: Column | None = None) -> Column:
    """M8: whether a thread's extras are made, from a column ``extras`` (map of thread id to boolean); with ``done`` that map after it is set."""
    if done is None:
        return F.coalesce(F.element_at("extras", thread), F.lit(False))
    rest = F.map_filter(F.coalesce("extras", F.create_map().cast("map<string,boolean>")), lambda k, v: k != thread)
    return F.map_concat(rest, F.create_map(F.lit(thread), done))


def profile(users: DataFrame, user: str) -> DataFrame:
    """One user's record, without what is private."""
    return users.where(F.col("user_id") == user).drop("_id", "password")


def thread_order(users: DataFrame, by: str = "updated") -> DataFrame:
    """C4: (user_id, position, thread) of each user's threads by name, or the newest ``created`` or ``updated`` first; ties by thread id."""
    rows = users.select("user_id", F.explode(F.map_entries("threads")).alias("e")).select("user_id", F.col("e.key").alias("thread"), "e.value.*")
    first = F.col("name").asc() if by == "name" else F.col(by).desc()
    order = Window.partitionBy("user_id").orderBy(first, "thread")
    return rows.select("user_id", (F.row_number().over(order) - 1).alias("position"), "thread")


def invalid(users: DataFrame) -> DataFrame:
    """Records that break the rules: no id, an e-mail without @, a chat of a role that there is not."""
    roles = F.exists(F.map_values("threads"), lambda t: F.exists(t["chats"], lambda c: ~c["role"].isin("agent", "user")))
    return users.where(F.col("user_id").isNull() | ~F.coalesce(F.contains("email", F.lit("@")), F.lit(False)) | roles)


def from_conversations(turns: DataFrame) -> DataFrame:
    """User records from a table (conv_id, turn, role, text): a user and a thread for each conversation."""
    chats = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda c: F.struct(c["role"].alias("role"), c["text"].alias("text"), c["turn"].cast("long").alias("ts")))
    own = turns.groupBy("conv_id").agg(chats.alias("chats"))
    name = F.concat(F.lit("u"), F.col("conv_id").cast("string"))
    thread = F.struct(F.lit("chat").alias("name"), F.lit(0).cast("long").alias("created"), F.lit(0).cast("long").alias("updated"), F.array().cast(f"array<{DOCUMENT}>").alias("documents"), F.col("chats")).cast(THREAD)
    return own.select(name.alias("user_id"), name.alias("name"), F.concat(name, F.lit("@example.org")).alias("email"), F.create_map(F.lit("t1"), thread).alias("threads"))
