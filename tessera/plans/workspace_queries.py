"""Queries over workspaces, conversations and message trees, and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans import base
from tessera.plans.registry import query
from tessera.session import table
from tessera.streaming import events as S

# --- workspaces: customers own orders, orders have items ----------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 42)")
def tenant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id and owner; another owner's row is not found."""
    orders = _orders(spark, sf_dir)
    owner = orders.filter("o_orderkey = 42").select("o_custkey").distinct()
    return orders.filter("o_orderkey = 42").join(owner, "o_custkey", "left_semi").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""WITH q AS (SELECT o_orderkey, o_custkey AS asked_by FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 = 0)
SELECT q.o_orderkey, asked_by, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = q.o_orderkey AND o.o_custkey = asked_by) AS found FROM q""")
def tenant_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asked by its owner, by another customer, and under a key that does not exist: only the first is found."""
    some = _orders(spark, sf_dir).filter("o_orderkey % 10 = 0")
    asked = [some.select(key.alias("o_orderkey"), by.alias("asked_by")) for key, by in ((F.col("o_orderkey"), F.col("o_custkey")), (F.col("o_orderkey"), F.col("o_custkey") + 1), (-F.col("o_orderkey"), F.col("o_custkey")))]
    return R.owned(_orders(spark, sf_dir), asked[0].union(asked[1]).union(asked[2]), "o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 999 OFFSET 0")
def list_convos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).filter("o_orderstatus = 'F'").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(0).limit(999).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 100")
def list_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).filter("c_mktsegment = 'BUILDING'").orderBy("c_custkey").limit(100).select("c_custkey", "c_name")


@query("""SELECT c.c_custkey, coalesce(o.n, 0) AS order_count, coalesce(s.n, 0) AS supplier_count FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = c.c_nationkey""")
def workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = R.with_child_count(_customers(spark, sf_dir), _orders(spark, sf_dir), "c_custkey", "o_custkey", "order_count")
    return R.with_child_count(counted, table(spark, sf_dir, "supplier"), "c_nationkey", "s_nationkey", "supplier_count").select("c_custkey", "order_count", "supplier_count")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def exists_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = _orders(spark, sf_dir).filter("o_totalprice > 300000")
    customers = _customers(spark, sf_dir)
    return customers.join(large, customers["c_custkey"] == large["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT conv_id, count(*) AS n_messages, md5(string_agg(turn || ':' || role || ':' || text, chr(10) ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY conv_id")
def convo_with_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with its messages in order, nested and then written as text."""
    line = F.concat_ws(":", "turn", "role", "text")
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("messages"))
    return nested.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("messages", lambda m: m["line"]), "\n")).alias("messages_md5"))


@query("""SELECT o_orderkey, c_name AS owner, n_name AS nation, count(l_linenumber) AS n_items, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS items
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_name, n_name""")
def eager_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and its nation as structs and their items as an array."""
    customers = R.eager(_customers(spark, sf_dir).select("c_custkey", "c_name", "c_nationkey"), "c_custkey", {"nation": (table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "c_nationkey")}, {})
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    loaded = R.eager(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_orderkey", {"owner": (customers, "c_custkey", "o_custkey")}, {"items": (items, "l_orderkey", "l_linenumber")})
    line = F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    return loaded.select("o_orderkey", F.col("owner.c_name").alias("owner"), F.col("owner.nation.n_name").alias("nation"), F.size("items").cast("long").alias("n_items"), F.array_join(line, ",").alias("items"))


@query("SELECT p_partkey, s_suppkey, s_name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size = 10")
def source_workspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter("p_size = 10").select(F.col("p_partkey").alias("part"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_name")
    bridge = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    return R.bridge_join(parts, bridge, suppliers, "part", "supplier").select(F.col("part").alias("p_partkey"), F.col("supplier").alias("s_suppkey"), "s_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM customer")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _customers(spark, sf_dir).select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = customers.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("moved").alias("c_mktsegment"), F.when(F.col("c_custkey") % 6 == 0, 0.5).alias("c_acctbal"))
    return R.partial_update(customers, changes, "c_custkey")


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)),
l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM gone)))
SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation go with their orders and those orders' items; what is left, counted."""
    customers = _customers(spark, sf_dir)
    chain = [(customers, "c_custkey", None), (_orders(spark, sf_dir), "o_orderkey", "o_custkey"), (table(spark, sf_dir, "lineitem"), "l_linenumber", "l_orderkey")]
    left = R.cascade_delete(chain, customers.filter("c_nationkey = 3").select("c_custkey"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in zip(("customer", "orders", "lineitem"), left, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT o_orderkey, CASE WHEN c_nationkey <> 3 THEN o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def set_null_on_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _customers(spark, sf_dir).filter("c_nationkey = 3").select("c_custkey")
    return R.set_null_on_delete(_orders(spark, sf_dir), "o_custkey", gone).select("o_orderkey", "o_custkey")


@query("""WITH a AS (SELECT c_custkey, [c_custkey, 7::BIGINT, 9::BIGINT] AS ids FROM customer)
SELECT c_custkey, array_to_string(CASE WHEN list_contains(ids, 5) THEN ids ELSE list_append(ids, 5::BIGINT) END, ',') AS archived, array_to_string(list_filter(ids, lambda x: x <> 7), ',') AS restored
FROM (SELECT c_custkey, CASE WHEN c_custkey IN (7, 9) THEN list_distinct(ids) ELSE ids END AS ids FROM a WHERE c_custkey NOT IN (7, 9))""")
def archive_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.col("c_custkey"), F.lit(7).cast("long"), F.lit(9).cast("long"))
    shown = lambda c: F.array_join(c.cast("array<string>"), ",")
    rows = _customers(spark, sf_dir).filter("c_custkey NOT IN (7, 9)")
    return rows.select("c_custkey", shown(R.archived(ids, F.lit(5).cast("long"))).alias("archived"), shown(R.restored(ids, F.lit(7).cast("long"))).alias("restored"))


@query("SELECT n_name AS wanted, NOT EXISTS (SELECT 1 FROM supplier s WHERE lower(s.s_name) = lower(n.w)) AS available FROM (SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN upper((SELECT min(s_name) FROM supplier)) ELSE n_name END AS w FROM nation) n")
def username_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name is free if no existing name equals it in lower case."""
    taken = table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("key"), F.lit(True).alias("taken")).distinct()
    first = table(spark, sf_dir, "supplier").agg(F.upper(F.min("s_name")).alias("first"))
    wanted = table(spark, sf_dir, "nation").crossJoin(F.broadcast(first)).select("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("first")).otherwise(F.col("n_name")).alias("w"))  # one row of one value
    return wanted.withColumn("key", F.lower("w")).join(taken, "key", "left").select(F.col("n_name").alias("wanted"), F.col("taken").isNull().alias("available"))


@query("SELECT c.c_custkey, count(o.o_orderkey) AS message_count FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def convo_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_child_count(_customers(spark, sf_dir), _orders(spark, sf_dir), "c_custkey", "o_custkey", "message_count").select("c_custkey", "message_count")


@query("""SELECT 'text' AS kind, md5(text) AS what, count(*) AS occurrences FROM documents GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'role', role, count(*) FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY role""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are there twice, and roles outside the allowed ones."""
    twice = R.duplicates_of(base.documents(spark, sf_dir).select(F.md5("text").alias("what")), "what").select(F.lit("text").alias("kind"), "what", "occurrences")
    roles = table(spark, sf_dir, "conversations").filter(~F.col("role").isin("user", "assistant")).groupBy(F.col("role").alias("what")).agg(F.count("*").alias("occurrences"))
    return twice.unionByName(roles.select(F.lit("role").alias("kind"), "what", "occurrences"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'convo' END, CASE WHEN o_custkey % 3 = 0 THEN 'workspace' END, c_mktsegment) AS preference
FROM orders JOIN customer ON c_custkey = o_custkey""")
def resolve_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation over workspace over user."""
    joined = _orders(spark, sf_dir).join(_customers(spark, sf_dir).withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    own, workspace = F.when(F.col("o_orderkey") % 4 == 0, "convo"), F.when(F.col("o_custkey") % 3 == 0, "workspace")
    return joined.select("o_orderkey", R.resolved(own, workspace, F.col("c_mktsegment")).alias("preference"))


@query("""SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region""")
def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    new = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"))
    return R.get_or_create(have, have.filter("id < 5").withColumn("name", F.lit("other")).unionByName(new), "id").select(F.col("id").cast("int"), "name")


# --- message trees -----------------------------------------------------------

_MESSAGES = """m AS (SELECT conv_id AS convo_id, conv_id || '-' || turn AS message_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_id, turn, role, text FROM conversations)"""


@query(f"""WITH {_MESSAGES}, r AS (SELECT *, CASE WHEN turn % 3 = 1 THEN 'root-' || turn ELSE '' END AS own FROM m)
SELECT c.convo_id, c.message_id, coalesce(nullif(p.own, ''), p.message_id) AS root_id FROM r c LEFT JOIN r p ON p.convo_id = c.convo_id AND p.message_id = c.parent_id""")
def message_root_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.messages(spark, sf_dir).withColumn("root_id", F.when(F.col("turn") % 3 == 1, F.concat(F.lit("root-"), F.col("turn"))).otherwise(""))
    return R.message_root_ids(rows).select("convo_id", "message_id", "root_id")


_NEW_MESSAGES = f"""{_MESSAGES}, s AS (SELECT convo_id, message_id, parent_id, CASE WHEN turn % 3 = 1 THEN 'root-' || turn ELSE '' END AS root_id, turn FROM m),
n AS (SELECT 'new-' || message_id AS message_id, convo_id, CASE WHEN turn % 11 = 10 THEN NULL WHEN turn % 7 = 6 THEN convo_id % 5 + 1 ELSE convo_id % 5 END AS user_id,
  CASE WHEN turn = 0 THEN NULL WHEN turn % 5 = 4 THEN 'none' WHEN turn % 5 = 3 THEN (convo_id + 1) || '-0' ELSE message_id END AS parent_id, CASE WHEN turn = 0 THEN 'own' END AS root_id, turn % 2 = 1 AS files, turn % 3 > 0 AS sources FROM s),
j AS (SELECT n.*, p.convo_id AS p_convo, coalesce(nullif(p.root_id, ''), p.message_id) AS p_root FROM n LEFT JOIN s p ON p.message_id = n.parent_id),
x AS (SELECT *, CASE WHEN user_id IS NULL THEN 'user id is required' WHEN user_id <> convo_id % 5 THEN 'conversation not found or access denied'
  WHEN parent_id IS NOT NULL AND p_root IS NULL THEN 'parent message not found' WHEN parent_id IS NOT NULL AND p_convo <> convo_id THEN 'parent message not in same conversation' END AS reason FROM j)"""


@query(f"""WITH {_NEW_MESSAGES}
SELECT message_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN parent_id IS NULL THEN root_id ELSE p_root END END AS root_id,
  reason IS NULL AND files AS with_files, reason IS NULL AND NOT files AND sources AS with_sources FROM x""")
def add_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more message under each, some without a user, by a stranger, or under a parent that is nowhere or elsewhere."""
    t = F.col("turn")
    stored = base.messages(spark, sf_dir).withColumn("root_id", F.when(t % 3 == 1, F.concat(F.lit("root-"), t)).otherwise(""))
    convos = stored.select("convo_id", (F.col("convo_id") % 5).alias("user_id")).distinct()
    user = F.when(t % 11 == 10, None).when(t % 7 == 6, F.col("convo_id") % 5 + 1).otherwise(F.col("convo_id") % 5)
    parent = F.when(t == 0, None).when(t % 5 == 4, "none").when(t % 5 == 3, F.concat_ws("-", F.col("convo_id") + 1, F.lit(0))).otherwise(F.col("message_id"))
    attached = lambda some: F.when(some, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    new = stored.select(F.concat(F.lit("new-"), "message_id").alias("message_id"), "convo_id", user.alias("user_id"), parent.alias("parent_id"), F.when(t == 0, "own").alias("root_id"), attached(t % 2 == 1).alias("attached_files"), attached(t % 3 > 0).alias("attached_sources"))
    added, refused = R.add_messages(convos, stored, new)
    kept = added.select("message_id", F.lit(None).cast("string").alias("reason"), "root_id", F.col("attached_files").isNotNull().alias("with_files"), F.col("attached_sources").isNotNull().alias("with_sources"))
    return kept.unionByName(refused.select("message_id", "reason", F.lit(None).cast("string").alias("root_id"), F.lit(False).alias("with_files"), F.lit(False).alias("with_sources")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN greatest(DATE '1996-01-01', last) WHEN last IS NULL THEN NULL ELSE last END AS last_login FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def last_login(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as logins; every fourth customer has an earlier one on record."""
    users = _customers(spark, sf_dir).select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit("1996-01-01").cast("date")).alias("last_login"))
    logins = _orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("last_login"))
    return R.touch(users, logins, "c_custkey", "last_login")


@query("SELECT * FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_message_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = R.latest_per_id(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return latest.select("user_id", "event_id", "event_type", F.lit(1).cast("long").alias("n"))


@query("""SELECT a.conv_id || '-' || a.turn AS message_id, b.conv_id || '-' || b.turn AS ancestor_id, (a.turn - b.turn)::BIGINT AS distance
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn
WHERE a.turn = (SELECT max(turn) FROM conversations c WHERE c.conv_id = a.conv_id)""")
def message_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain above the last message of every conversation, at any depth."""
    rows = base.messages(spark, sf_dir)
    last = rows.groupBy("convo_id").agg(F.max_by("message_id", "turn").alias("message_id")).select("message_id")
    return R.ancestors(rows.select("message_id", "parent_id"), last)


@query(f"""WITH {_MESSAGES}, p AS (SELECT *, convo_id || '-' || (turn // 3) AS up FROM m)
SELECT convo_id, message_id, up AS parent_id, row_number() OVER (PARTITION BY convo_id, up ORDER BY message_id) - 1 AS branch_index, count(*) OVER (PARTITION BY convo_id, up) AS branch_count FROM p""")
def message_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three messages share a parent here."""
    rows = base.messages(spark, sf_dir).withColumn("parent_id", F.concat_ws("-", "convo_id", F.floor(F.col("turn") / 3)))
    return R.branches(rows).select("convo_id", "message_id", "parent_id", F.col("branch_index").cast("long"), "branch_count")


@query("""SELECT event_id, i::INTEGER AS pos, 's' || (event_id + i) AS source_id, value AS top_score FROM events, (SELECT unnest(range(3)) AS i) WHERE i <> 1 OR event_id % 2 = 0""")
def parse_attached_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of attached sources; entries without a source are dropped, positions stay."""
    entry = lambda i: F.to_json(F.struct(F.when((F.lit(i) != 1) | (F.col("event_id") % 2 == 0), F.concat(F.lit("s"), F.col("event_id") + i)).alias("source_id"), F.col("value").alias("top_score")))
    raw = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.concat_ws(",", *[entry(i) for i in range(3)]), F.lit("]")).alias("j"))
    parsed = raw.select("event_id", F.from_json("j", "array<struct<source_id:string,top_score:double>>").alias("s"))
    return parsed.select("event_id", F.posexplode("s").alias("pos", "s")).filter("s.source_id is not null").select("event_id", "pos", "s.source_id", "s.top_score")


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_assistant_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_of_role(table(spark, sf_dir, "conversations"), "assistant", "conv_id", "turn")


# --- streams -----------------------------------------------------------------

_CHANNEL = "CASE event_id % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'status' WHEN 2 THEN 'source' ELSE 'data' END"


@query(f"SELECT event_id, {_CHANNEL} AS channel, CASE WHEN event_id % 5 <> 0 THEN event_type END AS type, event_id % 5 = 0 AS malformed FROM events")
def sse_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as server-sent lines, decoded as a stream; every fifth body is broken."""
    stream = S.read_stream(spark, f"{sf_dir}/events.parquet")
    body = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("type"))))
    text = F.concat(F.lit(": comment\n"), F.expr(_CHANNEL), F.lit(": "), body, F.lit("\n\n"))
    decoded = S.decode_sse(stream.select("event_id", text.alias("text")))
    return S.run_to_table(decoded.select("event_id", "channel", F.col("event.type").alias("type"), "malformed"))


_STAGE = "CASE event_id % 8 WHEN 0 THEN 'fetching' WHEN 1 THEN 'processing' WHEN 2 THEN 'chunking' WHEN 3 THEN 'embedding' WHEN 4 THEN 'storing vectors' WHEN 5 THEN 'searching' WHEN 6 THEN 'complete' ELSE 'other' END"


@query(f"""WITH s AS (SELECT user_id, {_STAGE} AS stage FROM events),
p AS (SELECT user_id, stage, CASE stage WHEN 'fetching' THEN 0.1 WHEN 'processing' THEN 0.25 WHEN 'chunking' THEN 0.35 WHEN 'embedding' THEN 0.45 WHEN 'storing vectors' THEN 0.55 WHEN 'searching' THEN 0.75 WHEN 'complete' THEN 1.0 END::DOUBLE AS progress FROM s)
SELECT user_id, arg_max(stage, progress) AS stage, max(progress) AS progress FROM p WHERE progress IS NOT NULL GROUP BY user_id""")
def rag_progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = S.read_stream(spark, f"{sf_dir}/events.parquet").select("user_id", F.expr(_STAGE).alias("stage"))
    return S.run_to_table(S.latest_progress(staged, "user_id", "stage"), "complete")


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS full_text, count(*) AS n_deltas FROM events WHERE event_type <> '' GROUP BY user_id")
def assemble_stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assemble_text(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_time(S.read_stream(spark, f"{sf_dir}/events.parquet"), delay="1 hour")


#: Windows that the watermark (an hour behind the latest event) has passed; the others are still open.
_CLOSED = "window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _totals(windows: DataFrame) -> DataFrame:
    """Closed windows, as the stream appends them; their state is dropped."""
    return S.run_to_table(windows).withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "window_end": F.col("window_end").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query(f"SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) WHERE {_CLOSED}")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(S.tumbling(_events(spark, sf_dir), "1 hour", "event_type"))


@query(f"""SELECT * FROM (SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS w FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY ALL) WHERE {_CLOSED}""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(S.sliding(_events(spark, sf_dir), "1 hour", "30 minutes", "event_type"))


@query(f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT * FROM (SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session) WHERE {_CLOSED}""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(S.sessions(_events(spark, sf_dir), "2 hours", "user_id"))


@query("SELECT user_id, count(*) AS chunks_sent, round(epoch(max(ts) - min(ts))::DOUBLE, 3) AS duration_s FROM events GROUP BY user_id")
def response_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.response_stats(S.event_time(table(spark, sf_dir, "events")), "user_id", "ts").withColumn("duration_s", F.round("duration_s", 3))
