"""Workspace queries: parents with counts, bridges, message trees, updates and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import written


def with_child_count(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """``parents`` plus the number of their children; counted before the join, so nothing fans out."""
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias(name))
    return parents.join(counts, parent_key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def bridge_join(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Many to many through distinct pairs of ``bridge``."""
    return left.join(bridge.select(left_key, right_key).distinct(), left_key).join(right, right_key)


def partial_update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the non-null values of ``changes``, which has one row a key at most."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in fields])
    return table.join(renamed, key, "left").select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def cascade_delete(tables: list[tuple[DataFrame, str, str | None]], gone: DataFrame) -> list[DataFrame]:
    """Delete keys down a chain of tables.

    ``tables`` lists (table, key, parent_key) from the root down; ``gone`` has
    the root's keys in its first column. Children whose parent goes, go too.
    """
    out = []
    lost = gone.select(F.col(gone.columns[0]).alias("__gone"))
    for table, key, parent in tables:
        hit = F.col(parent or key) == F.col("__gone")
        out.append(table.join(lost, hit, "left_anti"))
        lost = table.join(lost, hit, "left_semi").select(F.col(key).alias("__gone")).distinct()
    return out


def set_null_on_delete(table: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``table`` with ``column`` null where it names a key that is gone."""
    lost = gone.select(F.col(gone.columns[0]).alias("__gone")).distinct()
    return table.join(lost, F.col(column) == F.col("__gone"), "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone")


def archived(ids: Column, one: Column) -> Column:
    return F.array_union(F.coalesce(ids, F.array().cast("array<long>")), F.array(one))


def restored(ids: Column, one: Column) -> Column:
    return F.array_remove(ids, one)


def get_or_create(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``table`` plus the rows of ``wanted`` whose key it lacks."""
    return table.unionByName(wanted.dropDuplicates([key]).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def message_root_ids(messages: DataFrame) -> DataFrame:
    """Adds root_id: the parent's own root_id, or the parent's id where that is empty; null without a parent of the same conversation."""
    parents = messages.select(F.col("convo_id"), F.col("message_id").alias("parent_id"), F.coalesce(F.nullif("root_id", F.lit("")), "message_id").alias("__root"))
    return messages.drop("root_id").join(parents, ["convo_id", "parent_id"], "left").withColumnRenamed("__root", "root_id")


def latest_per_id(messages: DataFrame, key: str, time: str, position: str) -> DataFrame:
    """Of rows of one id the latest stays, of equal times the first; rows without an id go."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.col(position))
    return messages.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def branches(messages: DataFrame) -> DataFrame:
    """Adds branch_index (from 0) and branch_count among messages of one parent."""
    by = Window.partitionBy("convo_id", "parent_id")
    return messages.withColumns({"branch_index": F.row_number().over(by.orderBy("message_id")) - 1, "branch_count": F.count("*").over(by)})


def ancestors(messages: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All ancestors of the messages in ``start (message_id)``: (message_id, ancestor_id, distance).

    Over ``messages (message_id, parent_id)``, at any depth, by doubling: round r
    joins what is up to 2^r steps above, so rounds are as many as the depth has
    binary digits. A round is written as a table of the shared folder. A path that comes
    to a message twice is a ValueError in the round that sees it, unless
    ``max_depth`` says where to stop.
    """
    step = messages.filter("parent_id is not null").select("message_id", F.col("parent_id").alias("ancestor_id")).distinct().withColumn("distance", F.lit(1).cast("long"))
    found = written(start.select("message_id").distinct().withColumns({"ancestor_id": F.col("message_id"), "distance": F.lit(0).cast("long")}), "ancestors")
    reach = 1
    while True:
        up = step.select(F.col("message_id").alias("ancestor_id"), F.col("ancestor_id").alias("above"), F.col("distance").alias("more"))
        higher = found.join(up, "ancestor_id").select("message_id", F.col("above").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        higher = written(higher, "ancestors")
        found = found.unionByName(higher)  # of written tables, one a round
        if max_depth is None:
            again = found.groupBy("message_id", "ancestor_id").agg(F.count_distinct("distance").alias("n")).filter("n > 1")
            if not again.isEmpty():
                raise ValueError("a message is its own ancestor")
        if higher.isEmpty() or max_depth is not None and reach > max_depth:
            break
        step = step.join(up.withColumnsRenamed({"above": "above_2", "more": "more_2"}), "ancestor_id").select("message_id", F.col("above_2").alias("ancestor_id"), (F.col("distance") + F.col("more_2")).alias("distance"))
        step = written(step.dropDuplicates(["message_id", "ancestor_id"]) if max_depth is None else step, "ancestor-steps")
        reach *= 2
    found = found.filter("distance > 0")
    return found if max_depth is None else found.filter(F.col("distance") <= max_depth)


def last_of_role(messages: DataFrame, role: str, by: str, order: str) -> DataFrame:
    """(by, order, text) of the last message of a role in each conversation."""
    best = F.max_by(F.struct(order, "text"), order).alias("m")
    return messages.filter(F.col("role") == role).groupBy(by).agg(best).select(by, f"m.{order}", "m.text")


def duplicates_of(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return table.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def resolved(*levels: Column) -> Column:
    """A preference: the value of the nearest level that has one."""
    return F.coalesce(*levels)


def owned(table: DataFrame, requests: DataFrame, key: str, owner: str) -> DataFrame:
    """``requests (key, asked_by, ...)`` with ``found``: whether the row of that key exists and belongs to who asks.

    A row that is not there and one of another owner look the same. A null owner belongs to no one.
    """
    held = table.select(F.col(key), F.col(owner).alias("asked_by")).distinct().withColumn("found", F.lit(True))
    return requests.join(held, [key, "asked_by"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


MISSING_USER, NOT_OWNED, NO_PARENT, OTHER_CONVO = "user id is required", "conversation not found or access denied", "parent message not found", "parent message not in same conversation"


def add_messages(convos: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New messages that may be added, and (message_id, reason) of the others.

    ``convos`` has convo_id and user_id, ``messages`` message_id, convo_id and root_id, ``new``
    message_id, convo_id, user_id, parent_id, root_id, attached_files, attached_sources (arrays) and any more.
    The user must own the conversation; a parent must be one of its stored messages; the root is
    the parent's root or else the parent, and without a parent the given one. Files are kept, or
    else sources, never both; empty arrays become null.
    """
    mine = convos.select("convo_id", "user_id").distinct().withColumn("__mine", F.lit(True))
    above = messages.select(F.col("message_id").alias("parent_id"), F.col("convo_id").alias("__convo"), F.coalesce(F.nullif("root_id", F.lit("")), "message_id").alias("__root")).dropDuplicates(["parent_id"])
    seen = new.join(mine, ["convo_id", "user_id"], "left").join(above, "parent_id", "left")
    child = F.coalesce("parent_id", F.lit("")) != ""
    reason = (
        F.when(F.coalesce(F.col("user_id").cast("string"), F.lit("")) == "", MISSING_USER)
        .when(F.col("__mine").isNull(), NOT_OWNED)
        .when(child & F.col("__root").isNull(), NO_PARENT)
        .when(child & (F.col("__convo") != F.col("convo_id")), OTHER_CONVO)
    )
    seen = seen.withColumn("__reason", reason)
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    files = some("attached_files")
    fine = seen.filter("__reason is null").withColumns({"root_id": F.when(child, F.col("__root")).otherwise(F.col("root_id")), "attached_files": files, "attached_sources": F.when(files.isNull(), some("attached_sources"))})
    return fine.select(*new.columns), seen.filter("__reason is not null").select("message_id", F.col("__reason").alias("reason"))


def touch(users: DataFrame, logins: DataFrame, key: str, time: str) -> DataFrame:
    """``users`` with ``time``, their last login, moved forward to the latest of ``logins (key, time)``, never back."""
    latest = logins.groupBy(key).agg(F.max(time).alias("__latest"))
    return users.join(latest, key, "left").withColumn(time, F.greatest(time, "__latest")).drop("__latest").select(*users.columns)


def eager(parents: DataFrame, key: str, one: dict[str, tuple[DataFrame, str, str]], many: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``parents`` with what belongs to them loaded: a struct or null for each of ``one``, an array for each of ``many``.

    ``one`` has name: (table, its key, the parents' column that names it), of equal keys the first by all columns; ``many`` has name: (table, its
    column that names the parent, what it is ordered by). Children are gathered before the join; a parent without
    any has an empty array. Children of one parent meet in one row.
    """
    out = parents
    for name, (table, own, column) in one.items():
        found = table.groupBy(F.col(own).alias("__key")).agg(F.min(F.struct(*table.columns)).alias(name))
        out = out.join(found, F.col(column) == F.col("__key"), "left").drop("__key")
    for name, (table, column, order) in many.items():
        rest = [c for c in table.columns if c not in (column, order)]
        gathered = F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name)
        out = out.join(table.groupBy(F.col(column).alias(key)).agg(gathered), key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out
