"""Queries over texts: routing, formatting, chunking, embedding, ingest, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import messages as M
from tessera.functions import text as T
from tessera.operators import chunking, embedding, pipeline, post
from tessera.plans import base
from tessera.plans.base import BLANKS_SQL, hits_cte, texted_cte, words_sql
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import files, points

# --- query understanding -----------------------------------------------------

_COMPLEX = f"regexp_matches(lower(text), 'and|or|also|compare|difference|vs') OR len({words_sql('text')}) > 15"
_OPEN = "regexp_matches(lower(text), '^(what|why|how|explain|describe)')"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query(f"SELECT conv_id, turn, {_COMPLEX} AS is_complex FROM conversations")
def is_complex_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.is_complex_query(F.col("text")).alias("is_complex"))


@query(f"SELECT conv_id, turn, {_OPEN} AS is_open FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'How ' || text ELSE text END AS text FROM conversations)")
def is_open_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("How "), F.col("text"))).otherwise(F.col("text"))
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.is_open_ended(asked).alias("is_open"))


@query(f"""SELECT conv_id, turn, requested, CASE WHEN trim(coalesce(text, ''), {BLANKS_SQL}) = '' THEN 'none'
  WHEN requested = 'auto' THEN CASE WHEN {_COMPLEX} THEN 'decomposition' WHEN {_OPEN} THEN 'hyde' ELSE 'expansion' END ELSE requested END AS resolved
FROM (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'auto' ELSE 'multi' END AS requested FROM conversations)""")
def route_query_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _conversations(spark, sf_dir).withColumn("requested", F.when(F.col("role") == "user", "auto").otherwise("multi"))
    return asked.select("conv_id", "turn", "requested", T.route(F.col("text"), F.col("requested")).alias("resolved"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {BLANKS_SQL})), lambda x: x <> '') AS c FROM documents)
SELECT doc_id, unnest(range(len(c)))::INTEGER AS pos, unnest(c) AS line FROM l""")
def split_llm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.documents(spark, sf_dir).select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("pos", "line"))


@query(f"SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 3 = 0 THEN '  ' WHEN turn % 3 = 1 THEN ' again: ' || text END, {BLANKS_SQL}), ''), text) AS reformulated FROM conversations")
def reformulate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("turn") % 3 == 0, "  ").when(F.col("turn") % 3 == 1, F.concat(F.lit(" again: "), F.col("text")))
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.or_original(answer, F.col("text")).alias("reformulated"))


@query("""SELECT conv_id, string_agg('<' || lower(role) || '>' || text || '</' || lower(role) || '>' || chr(10), '' ORDER BY turn) AS history
FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id""")
def chat_history_to_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _conversations(spark, sf_dir).withColumn("line", T.tagged(F.col("role"), F.col("text")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return lines.groupBy("conv_id").agg(F.array_join(ordered, "").alias("history"))


# --- formatting --------------------------------------------------------------

_LINE = "'[#' || coalesce((result_rank + 1)::VARCHAR, 'N/A') || ' RANKED CHUNK: FILE NAME: ' || coalesce(source_name, '') || ' CHUNK CONTENT: ' || coalesce(contents, '') || ']'"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base.hits_with_text(spark, sf_dir)
    return found.withColumn("line", T.context_line(F.col("result_rank") + 1, F.col("source_name"), F.col("contents")))


@query(f"WITH {texted_cte()} SELECT query_id, chunk_id, {_LINE} AS line FROM texted")
def to_context_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("query_id", "chunk_id", "line")


@query(f"WITH {texted_cte()} SELECT query_id, string_agg({_LINE}, chr(10) ORDER BY result_rank) || chr(10) || 'END OF RETRIEVED CONTEXT' AS context FROM texted GROUP BY query_id")
def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("result_rank", "line"))), lambda x: x["line"])
    return _lines(spark, sf_dir).groupBy("query_id").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n" + T.CONTEXT_END)).alias("context"))


_CDATA = "'<![CDATA[' || replace(coalesce({0}, ''), ']]>', ']]]]><![CDATA[>') || ']]>'"
_CITED = f"""{texted_cte()},
g AS (
  SELECT query_id, source_id, max(similarity_score) AS top, min(result_rank) AS first,
         string_agg('<chunk id=''' || chunk_id || '''>' || {_CDATA.format("contents")} || '</chunk>', chr(10) ORDER BY result_rank) AS chunks
  FROM texted GROUP BY ALL),
c AS (
  SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY top DESC, first) - 1 AS group_rank,
         '<document>' || chr(10) || '<document_metadata>' || chr(10) || '<document_id>' || source_id || '</document_id>' || chr(10)
         || '<title>' || {_CDATA.format("'source ' || source_id")} || '</title>' || chr(10)
         || '<metadata_json>' || {_CDATA.format("'\"{\\\"source_id\\\":' || source_id || '}\"'")} || '</metadata_json>' || chr(10)
         || '</document_metadata>' || chr(10) || chr(10) || '<document_content>' || chr(10) || chunks || chr(10) || '</document_content>' || chr(10) || '</document>' AS citation
  FROM g)"""


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One citation document for each query and source; metadata is JSON inside a JSON string."""
    found = base.hits_with_text(spark, sf_dir)
    chunk = F.concat(F.lit("<chunk id='"), F.col("chunk_id"), F.lit("'>"), T.cdata(F.col("contents")), F.lit("</chunk>"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("result_rank", "xml"))), lambda x: x["xml"])
    grouped = found.withColumn("xml", chunk).groupBy("query_id", "source_id").agg(F.max("similarity_score").alias("top"), F.min("result_rank").alias("first"), F.array_join(ordered, "\n").alias("chunks"))
    order = Window.partitionBy("query_id").orderBy(F.col("top").desc(), "first")
    parts = [
        "<document>\n<document_metadata>\n<document_id>",
        F.col("source_id").cast("string"),
        "</document_id>\n<title>",
        T.cdata(F.concat(F.lit("source "), F.col("source_id"))),
        "</title>\n<metadata_json>",
        T.cdata(T.json_string(F.to_json(F.struct("source_id")))),
        "</metadata_json>\n</document_metadata>\n\n<document_content>\n",
        F.col("chunks"),
        "\n</document_content>\n</document>",
    ]
    citation = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return grouped.select("query_id", "source_id", (F.row_number().over(order) - 1).cast("long").alias("group_rank"), citation.alias("citation"))


@query(f"WITH {_CITED} SELECT * FROM c")
def format_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citations(spark, sf_dir)


@query(f"""WITH {_CITED} SELECT query_id, 'Source material:' || chr(10) || '    <documents>' || chr(10) || '    '
  || string_agg(citation, chr(10) ORDER BY group_rank) || chr(10) || '    </documents>' AS section FROM c GROUP BY query_id""")
def format_sources_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("group_rank", "citation"))), lambda x: x["citation"])
    section = F.concat(F.lit("Source material:\n    <documents>\n    "), F.array_join(ordered, "\n"), F.lit("\n    </documents>"))
    return _citations(spark, sf_dir).groupBy("query_id").agg(section.alias("section"))


@query("SELECT conv_id, turn, text || chr(10) || role AS joined FROM conversations")
def extract_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).alias("text"))
    parts = F.array(part("text", "text"), part("file", "role"), part("text", "role"))
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.text_of_parts(parts).alias("joined"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN 'mine' WHEN upper(p) = 'OPENAI' THEN 'openai' WHEN upper(p) = 'TOGETHER' THEN 'together_ai' WHEN upper(p) = 'OPENROUTER' THEN 'openrouter' ELSE lower(p) END || '/' || lower(n_name) AS model
FROM (SELECT *, CASE n_nationkey % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'together' WHEN 2 THEN 'OPENROUTER' ELSE 'Other' END AS p FROM nation)""")
def build_model_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    provider = F.when(k == 0, "OpenAI").when(k == 1, "together").when(k == 2, "OPENROUTER").otherwise("Other")
    custom = F.when(F.col("n_nationkey") % 5 == 4, "mine")
    return table(spark, sf_dir, "nation").select("n_nationkey", T.model_string(provider, F.lower("n_name"), custom).alias("model"))


@query("""SELECT event_id, k, v FROM (
  SELECT event_id, 'type' AS k, event_type AS v FROM events UNION ALL SELECT event_id, 'big', CASE WHEN value > 50 THEN 'yes' END FROM events) WHERE v IS NOT NULL""")
def map_filter_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("big"), F.when(F.col("value") > 50, "yes"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(T.without_nulls(m)).alias("k", "v"))


@query("""SELECT conv_id, turn, CASE WHEN r IN ('user', 'assistant', 'system') THEN r ELSE 'user' END AS role
FROM (SELECT conv_id, turn, lower(trim(CASE WHEN turn = 1 THEN ' ' || upper(role) || ' ' WHEN turn = 2 THEN 'bot' ELSE role END)) AS r FROM conversations)""")
def normalize_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("turn") == 1, F.concat(F.lit(" "), F.upper("role"), F.lit(" "))).when(F.col("turn") == 2, "bot").otherwise(F.col("role"))
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.normal_role(given).alias("role"))


_DIGITS = "'0123456789ABCDEFGHJKMNPQRSTVWXYZ'"


@query(f"""WITH b AS (SELECT event_id, 1700000000000 + event_id * 7919 AS ms FROM events),
u AS (SELECT event_id, {" || ".join(f"substr({_DIGITS}, ((ms >> {5 * i}) & 31)::INTEGER + 1, 1)" for i in range(9, -1, -1))} || 'ABCDEFGHJKMNPQRS' AS ulid FROM b)
SELECT event_id, ulid, {" + ".join(f"(strpos({_DIGITS}, substr(ulid, {i + 1}, 1)) - 1)::BIGINT * {32 ** (9 - i)}" for i in range(10))} AS millis FROM u""")
def ulid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.lit(1700000000000) + F.col("event_id") * 7919
    digit = lambda i: F.substring(F.lit(T.ULID_DIGITS), (F.shiftright(ms, 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    made = table(spark, sf_dir, "events").select("event_id", F.concat(*[digit(i) for i in range(9, -1, -1)], F.lit("ABCDEFGHJKMNPQRS")).alias("ulid"))
    return made.withColumn("millis", T.ulid_millis(F.col("ulid")))


@query(f"WITH {hits_cte()} SELECT query_id, source_id, chunk_id, round(similarity_score, 6) AS score FROM hits")
def source_chunk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each source as a map, and the map's entries as rows."""
    grouped = post.group_by_source(base.hits(spark, sf_dir))
    m = F.map_from_entries(F.transform("chunks", lambda c: F.struct(c["chunk_id"], c["similarity_score"])))
    return grouped.select("query_id", "source_id", F.explode(m).alias("chunk_id", "score")).withColumn("score", F.round("score", 6))


@query(f"""WITH {hits_cte(5)},
m AS (SELECT query_id, result_rank, CASE WHEN result_rank % 2 = 0 THEN chunk_id ELSE chunk_id + 1000000 END AS cited FROM hits)
SELECT m.query_id, m.cited::VARCHAR AS cited, EXISTS (SELECT 1 FROM hits h WHERE h.query_id = m.query_id AND h.chunk_id = m.cited) AS valid FROM m""")
def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers ``[citation:id]`` of an answer against the chunks it was given."""
    found = base.hits(spark, sf_dir, top_k=5)
    marker = F.concat(F.lit("see [citation:"), F.when(F.col("result_rank") % 2 == 0, F.col("chunk_id")).otherwise(F.col("chunk_id") + 1000000), F.lit("]"))
    answers = found.groupBy("query_id").agg(F.array_join(F.collect_list(marker), " ").alias("answer"))
    cited = answers.select("query_id", F.explode(F.regexp_extract_all("answer", F.lit(r"\[citation:([^\]]+)\]"), 1)).alias("cited"))
    given = found.select("query_id", F.col("chunk_id").cast("string").alias("cited"), F.lit(True).alias("known")).distinct()
    return cited.join(given, ["query_id", "cited"], "left").select("query_id", "cited", F.coalesce("known", F.lit(False)).alias("valid"))


@query("SELECT conv_id, turn, 'Today is 2024-06-01.' || chr(10) || '<history>' || text || '</history>' AS prompt FROM conversations")
def format_system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template with a date that is a parameter, so results repeat."""
    prompt = T.from_template("Today is {day}.\n<history>{history}</history>", day=F.date_format(F.lit("2024-06-01").cast("date"), "yyyy-MM-dd"), history=F.col("text"))
    return _conversations(spark, sf_dir).select("conv_id", "turn", prompt.alias("prompt"))


@query("SELECT conv_id, turn, role <> 'system' AS has_files, 2 + (role <> 'system')::INTEGER AS n_parts FROM conversations")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("text").alias("text"))
    parts = F.when(F.col("role") != "system", F.array(part("text"), part("file"), part("text"))).otherwise(F.array(part("text"), part("text")))
    return _conversations(spark, sf_dir).select("conv_id", "turn", M.has_part(parts, "file").alias("has_files"), F.size(parts).alias("n_parts"))


@query('SELECT c_custkey AS "CCustkey", c_name AS "CName", c_mktsegment AS "Segment" FROM customer')
def egress_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed columns, one of them renamed, under their egress names."""
    safe = M.only(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment", "password"])
    return M.camel_columns(M.renamed(safe, {"c_mktsegment": "segment", "none": "c_name"}))


@query()
def index_and_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files to points; the text of every hundredth as a question."""
    docs = base.documents(spark, sf_dir)
    uploads = docs.select(F.col("doc_id").alias("source_id"), F.md5("text").alias("source_hash"), F.lit("text/plain").alias("media_type"), F.col("text").alias("content"))
    questions = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    found = pipeline.answer(pipeline.index_files(uploads), questions)
    return found.select("query_id", "chunk_id", "source_id", F.round("similarity_score", 6).alias("similarity_score"), "new_rank")


# --- chunking ----------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.documents(spark, sf_dir).select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"))


def _fixed_sql(size: int, overlap: int) -> str:
    window, back = 4 * size, 4 * overlap
    return f"""
s AS (SELECT doc_id AS source_id, text AS t, length(text) AS n FROM documents WHERE length(text) > 0),
walk(source_id, t, n, a, b) AS (
  SELECT source_id, t, n, 0, CASE WHEN {window} < n AND strpos(substr(t, 2, {window} - 1), ' ') > 0 THEN {window} - strpos(reverse(substr(t, 1, {window})), ' ') ELSE least({window}, n) END FROM s
  UNION ALL
  SELECT source_id, t, n, a2, CASE WHEN a2 + {window} < n AND strpos(substr(t, a2 + 2, {window} - 1), ' ') > 0 THEN a2 + {window} - strpos(reverse(substr(t, a2 + 1, {window})), ' ') ELSE least(a2 + {window}, n) END
  FROM (SELECT *, greatest(b - {back}, a + 1) AS a2 FROM walk WHERE b < n)),
chunks AS (
  SELECT source_id, a AS start_index, b AS end_index, trim(substr(t, a + 1, b - a), {BLANKS_SQL}) AS text FROM walk WHERE trim(substr(t, a + 1, b - a), {BLANKS_SQL}) <> ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_index) - 1 AS pos, greatest(1, length(text) // 4) AS token_count FROM chunks)"""


_CHUNK = "source_id, pos::INTEGER AS pos, start_index::INTEGER AS start_index, end_index::INTEGER AS end_index, token_count::INTEGER AS token_count, md5(text) AS text_md5"


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_id", "pos", "start_index", "end_index", "token_count", F.md5("text").alias("text_md5"))


@query(f"WITH RECURSIVE {_fixed_sql(512, 128)} SELECT {_CHUNK} FROM numbered")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(chunking.chunk_fixed(_sources(spark, sf_dir)))


@query(f"""WITH w AS (SELECT doc_id AS source_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT source_id, w, unnest(range(greatest(0, ceil((len(w) - 512) / 384.0))::BIGINT + 1)) AS pos FROM w WHERE len(w) > 0),
t AS (SELECT source_id, pos, pos * 384 AS start_index, w[pos * 384 + 1 : pos * 384 + 512] AS part FROM c),
numbered AS (SELECT source_id, pos, start_index, start_index + len(part) AS end_index, len(part) AS token_count, array_to_string(part, ' ') AS text FROM t)
SELECT {_CHUNK} FROM numbered""")
def chunk_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(chunking.chunk_token(_sources(spark, sf_dir)))


@query()
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(chunking.chunk_sentence(_sources(spark, sf_dir)))


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(chunking.chunk_semantic(_sources(spark, sf_dir)))


@query(f"WITH RECURSIVE {_fixed_sql(512, 128)} SELECT d.doc_id AS source_id, count(c.pos) AS chunk_count, coalesce(sum(c.token_count), 0)::BIGINT AS total_tokens FROM documents d LEFT JOIN numbered c ON c.source_id = d.doc_id GROUP BY d.doc_id")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _sources(spark, sf_dir)
    return chunking.chunk_stats(sources, chunking.chunk_fixed(sources))


@query("SELECT doc_id, n_chars - 5 >= 0 AND n_chars > n_chars - 5 AND n_chars // 4 > 0 AS valid FROM documents")
def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their last five characters: short ones break the constraints."""
    rows = base.documents(spark, sf_dir).select("doc_id", (F.col("n_chars") - 5).alias("start_index"), F.col("n_chars").alias("end_index"), F.expr("n_chars div 4").alias("token_count"))
    return chunking.validate_chunks(rows).select("doc_id", "valid")


@query("SELECT doc_id, greatest(1, ceil(length(coalesce(text, '')) / 3000.0))::INTEGER AS pages FROM documents")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.documents(spark, sf_dir).select("doc_id", chunking.page_count(F.col("text")).alias("pages"))


# --- embedding ---------------------------------------------------------------

_HASHED = f"""
w AS (SELECT conv_id, turn, text, unnest({words_sql("lower(coalesce(text, ''))")}) AS t FROM conversations),
b AS (SELECT conv_id, turn, ('0x' || substr(md5(t), 1, 8))::BIGINT % 32 AS d, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
l AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS l FROM b GROUP BY ALL)"""


@query(f"WITH {_HASHED} SELECT conv_id, turn, d::INTEGER AS i, round(n / l, 6) AS x FROM b JOIN l USING (conv_id, turn)")
def embed_valid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero parts of the hashing embedder's vectors; blank texts have none."""
    chunks = embedding.embed_chunks(_conversations(spark, sf_dir))
    parts = chunks.select("conv_id", "turn", F.posexplode("dense_vector").alias("i", "x"))
    return parts.filter("x <> 0").withColumn("x", F.round("x", 6))


@query("""SELECT conv_id AS source_id, count(*) AS chunk_count, count(*) FILTER (role <> 'system') AS embedded_count,
  CASE WHEN count(*) FILTER (role <> 'system') = 0 THEN 'failed' WHEN count(*) FILTER (role <> 'system') < count(*) THEN 'partial' ELSE 'complete' END AS status,
  count(*) FILTER (role <> 'system') || '/' || count(*) || ' chunks embedded' AS message FROM conversations GROUP BY conv_id""")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("role") != "system", F.col("text")).otherwise(" ")
    chunks = embedding.embed_chunks(_conversations(spark, sf_dir).select(F.col("conv_id").alias("source_id"), text.alias("text")))
    return embedding.embedding_coverage(chunks)


@query(f"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(trim(text, {BLANKS_SQL}), '[^.!?]*[.!?]+\\S*|[^.!?]+$'), 1, 1), '') <> '' OR trim(text, {BLANKS_SQL}) = '' AS has_summary FROM documents")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.documents(spark, sf_dir).select("doc_id", ((embedding.extractive_summary(F.col("text")) != "") | chunking.is_blank(F.col("text"))).alias("has_summary"))


@query(f"SELECT doc_id, md5(array_to_string(list_slice(string_split(regexp_replace(trim(coalesce(text, ''), {BLANKS_SQL}), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), 1, 2), ' ')) AS summary_md5 FROM documents")
def document_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary itself: the first two sentences of every document."""
    return base.documents(spark, sf_dir).select("doc_id", F.md5(embedding.extractive_summary(F.col("text"))).alias("summary_md5"))


# --- ingest and parsing ------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads; every seventh is no base64."""
    data = F.when(F.col("page_id") % 7 == 3, F.lit("*broken*")).otherwise(F.base64(F.col("html").cast("binary")))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id"), F.lit(".html")).alias("file_name"), F.lit("text/html").alias("media_type"), data.alias("data"))


@query("SELECT page_id, page_id % 7 <> 3 AS valid, CASE WHEN page_id % 7 <> 3 THEN md5(html) END AS content_md5 FROM pages")
def ingest_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.ingest(_parts(spark, sf_dir)).select("page_id", "valid", F.md5("content").alias("content_md5"))


@query("SELECT doc_id, sha256('d' || doc_id || ', text/plain' || chr(10) || text) AS file_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("doc_id"))
    return base.documents(spark, sf_dir).select("doc_id", files.content_hash(name, F.lit("text/plain"), F.col("text")).alias("file_hash"))


@query()
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLAKE3 of every document in the context of its name and type; tests hold it against published vectors."""
    name = F.concat(F.lit("d"), F.col("doc_id"))
    return base.documents(spark, sf_dir).select("doc_id", files.content_key(name, F.lit("text/plain"), F.col("text")).alias("file_key"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'text/markdown' ELSE 'unknown' END AS media_type FROM documents")
def declared_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "text/csv").when(k == 1, " Text/Markdown; charset=utf-8").when(k == 2, "text/none")
    return base.documents(spark, sf_dir).select("doc_id", T.known_type(kind).alias("media_type"))


@query("SELECT doc_id, decode(from_base64(to_base64(encode(text)))) = text AS same, md5(to_base64(encode(text))) AS encoded FROM documents")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    back = F.unbase64(F.base64(text.cast("binary"))).cast("string")
    return base.documents(spark, sf_dir).select("doc_id", (back == text).alias("same"), F.md5(F.regexp_replace(F.base64(text.cast("binary")), r"\s", "")).alias("encoded"))  # without the line ends of MIME


@query("SELECT doc_id, md5(to_base64(encode(text))) AS encoded FROM documents")
def base64_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded in blocks of three bytes times 10,922, as one."""
    return base.documents(spark, sf_dir).select("doc_id", F.md5(T.base64_in_blocks(F.col("text").cast("binary"))).alias("encoded"))


_EXTENSION = "CASE doc_id % 6 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'dir.x/b.md' WHEN 2 THEN 'c.tar.docx' WHEN 3 THEN 'noext' WHEN 4 THEN 'd.Html' ELSE 'e.bin' END"
_TYPE = "CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 4 THEN 'text/html' ELSE 'unknown' END"


@query(f"SELECT doc_id, {_EXTENSION} AS path, {_TYPE} AS media_type FROM documents")
def detect_document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = base.documents(spark, sf_dir).select("doc_id", F.expr(_EXTENSION).alias("path"))
    return named.withColumn("media_type", T.media_type(F.col("path")))


@query(f"""SELECT doc_id, CASE WHEN t = 'text/markdown' THEN 'markdown' WHEN t = 'text/html' THEN 'html' END AS parser FROM (SELECT doc_id, {_TYPE} AS t FROM documents)""")
def select_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = base.documents(spark, sf_dir).select("doc_id", F.expr(_EXTENSION).alias("path"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'html' ELSE 'pypdf' END").alias("preferred"))
    return named.select("doc_id", files.select_parser(F.lit("unknown"), F.col("preferred"), F.col("path")).alias("parser"))


@query(f"""WITH b AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n\\s*'), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS c FROM (SELECT doc_id, '# Doc ' || doc_id || chr(10) || chr(10) || text AS text FROM documents)),
p AS (SELECT doc_id, unnest(c) AS x, unnest(range(len(c))) AS i FROM b),
e AS (SELECT doc_id, i, replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM p),
f AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(x, '\\*\\*([^*\\n]+)\\*\\*', '<strong>\\1</strong>', 'g'), '\\*([^*\\n]+)\\*', '<em>\\1</em>', 'g'), '`([^`\\n]+)`', '<code>\\1</code>', 'g') AS x FROM e)
SELECT doc_id, md5(string_agg(CASE WHEN i = 0 THEN '<h1>' || substr(x, 3) || '</h1>' ELSE '<p>' || x || '</p>' END, chr(10) ORDER BY i)) AS html_md5 FROM f
WHERE doc_id IN (SELECT doc_id FROM p GROUP BY doc_id HAVING NOT bool_or(i > 0 AND regexp_matches(x, '^(#|[-*+][ \\t])'))) GROUP BY doc_id""")
def parse_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a heading, as Markdown."""
    text = F.concat(F.lit("# Doc "), F.col("doc_id"), F.lit("\n\n"), F.col("text"))
    return base.documents(spark, sf_dir).select("doc_id", F.md5(files.markdown_to_html(text)).alias("html_md5"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'html' ELSE 'markdown' END AS parser_used, CASE WHEN page_id % 3 = 1 THEN '<p>x</p>' END AS parsed FROM pages WHERE page_id % 3 <> 2
UNION ALL SELECT page_id, NULL, '' FROM pages WHERE page_id % 3 = 2""")
def parse_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown first, then HTML; every third page is of a type that neither reads."""
    k = F.col("page_id") % 3
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, "text/html").when(k == 1, "text/plain").otherwise("application/pdf").alias("media_type"), F.when(k == 1, "x").otherwise(F.col("html")).alias("content"))
    parsed = files.parse_with_fallback(rows, "markdown", ("html",))
    return parsed.select("page_id", "parser_used", F.when(k != 0, F.col("parsed")).alias("parsed"))


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def parse_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the HTML parser gives of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(files.html_to_text(F.col("html"))).alias("text_md5"))


# --- points store ------------------------------------------------------------

_READY = """r AS (SELECT vec_id AS id, d.text, 'h' || vec_id AS source_hash, CASE WHEN vec_id % 11 = 5 THEN '' ELSE label::VARCHAR END AS source_id
  FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id),
p AS (SELECT id, source_id FROM r WHERE trim(coalesce(text, '')) <> '' AND source_id <> '')"""


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.concat(F.lit("h"), F.col("vec_id")).alias("source_hash"), F.when(F.col("vec_id") % 11 == 5, "").otherwise(F.col("label").cast("string")).alias("source_id"))
    return points.prepare_points(rows.join(docs, "chunk_id", "left"))


@query(f"WITH {_READY} SELECT id, source_id FROM p")
def prepare_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir).select("id", "payload.source_id")


def _two_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("old").alias("batch"))
    new = all_points.filter("id % 4 = 0").withColumn("batch", F.lit("new")).unionByName(all_points.filter("id % 4 = 1").withColumns({"id": F.col("id") + 10_000_000, "batch": F.lit("new")}))
    return all_points, new


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS batch FROM embeddings
UNION ALL SELECT vec_id + 10000000, 'new' FROM embeddings WHERE vec_id % 4 = 1""")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.upsert_points(*_two_batches(spark, sf_dir)).select("id", "batch")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 <> 0")
def delete_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _two_batches(spark, sf_dir)
    return points.delete_points(stored, new).select("id")


@query("SELECT 'embeddings' AS collection, count(*) AS points_count, max(len(embedding))::INTEGER AS dimension, CASE WHEN max(len(embedding)) = min(len(embedding)) THEN 'ok' ELSE 'mixed' END AS status FROM embeddings")
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.collection_info(_two_batches(spark, sf_dir)[0], "embeddings")
