"""Mixing sources to target weights by temperature (operator 2).

Source i holds share p_i of the tokens. Weights are q_i = p_i^a / sum p_j^a. The
exponent a in [0, 1] is bisected: 1 keeps the corpus as it is, 0 gives every
source the same weight. The target is either an entropy of the weights or a
limit on how often a source repeats, q_i * budget / tokens_i; of the exponents
that meet it, the smallest (most even) is taken for the limit.

Weights become rows as budgeted block permutations. A source's documents fall
into blocks of about ``block_docs`` by a hash; an epoch visits the blocks in
hashed order and the documents of a block in hashed order. A source runs through
whole epochs while its token budget lasts; its last epoch ends where the budget
does, with or without the document that lies across that end, whichever comes
closer. So a source misses its budget by half a document at most (and may repeat
half a document beyond the limit). Each epoch is another permutation. No task
sees more than a block, or one total for each block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WHITE_SPACE, WHITE_SPACE_CLASS, fresh, identified, matching, prepare, settled, text_or_empty, written

MAX_REPETITION = 1.25
BLOCK_DOCS = 4096
STEPS = 60
#: Share by which rounding may miss a target.
SLACK = 1e-9


def word_count(text: Column) -> Column:
    """Words between white space (0x20, 0x09 to 0x0D)."""
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WHITE_SPACE_CLASS + "+"))).cast("long")


def weights_at(tokens: dict, exponent: float) -> dict:
    """Normalised weights; sources without tokens get 0."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = math.fsum(raw.values())
    return {s: x / norm if norm else 0.0 for s, x in raw.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def find_exponent(tokens: dict, budget: int, max_repetition: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent by bisection; entropy falls and the largest repetition falls as it rises from 0 to 1.

    A target that no exponent meets is a ValueError: a budget of more than
    ``max_repetition`` times all tokens, or an entropy outside what the shares
    allow. Without any token there is nothing to weigh, and the exponent is 1.
    """
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either max_repetition or target_entropy")
    if not any(tokens.values()):
        return 1.0

    def too_low(exponent: float) -> bool:
        weights = weights_at(tokens, exponent)
        if target_entropy is not None:
            return entropy(weights) > target_entropy + SLACK
        return any(weights[s] * budget > max_repetition * n * (1 + SLACK) for s, n in tokens.items() if n)

    low, high = 0.0, 1.0
    if too_low(high) or (target_entropy is not None and entropy(weights_at(tokens, low)) < target_entropy - SLACK):
        limits = f"repetition {max_repetition} of {budget} tokens out of {sum(tokens.values())}" if target_entropy is None else f"entropy {target_entropy}"
        raise ValueError(f"no exponent from 0 to 1 meets the target: {limits}")
    if not too_low(low):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if too_low(middle) else (low, middle)
    return high


def _draw(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _block(draw: Column, blocks: Column) -> Column:
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") % blocks


def mix_plan(docs: DataFrame, row: list[str], budget: int | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, tokens: Column | None = None) -> tuple[DataFrame, list[dict]]:
    """Narrow rows of ``docs`` (written), with the columns ``row`` that identify one, and, per source, its tokens, weight and budget.

    One total of each source comes to the driver: sources are a dimension of the
    mixture, not of the documents.
    """
    prepare(docs)
    text = text_or_empty()
    narrow = written(
        docs.select(
            *row, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.md5(text).alias("content"), (word_count(text) if tokens is None else tokens.cast("long")).alias("n_tokens")
        ),
        "mixing",
    )
    found = narrow.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()
    totals = {r["source"]: r["t"] for r in found}
    whole = sum(totals.values())
    budget = whole if budget is None else budget
    if whole == 0:
        exponent, weights = 1.0, dict.fromkeys(totals, 0.0)
    else:
        exponent = find_exponent(totals, budget, None if target_entropy is not None else max_repetition, target_entropy)
        weights = weights_at(totals, exponent)
    return narrow, [{"source": r["source"], "n_docs": r["n"], "source_tokens": r["t"], "exponent": exponent, "target_weight": weights[r["source"]], "source_budget": math.floor(weights[r["source"]] * budget)} for r in found]


PLAN_DDL = "source string, n_docs long, source_tokens long, exponent double, target_weight double, source_budget long"


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture as rows: doc_id, source, content (md5 of the text), n_tokens, epoch, block, source_start, target_weight.

    Options: ``budget`` in tokens, by default those of the corpus;
    ``max_repetition`` or ``target_entropy``; ``tokens``, a column that counts a
    row's, by default its words; ``block_docs``; ``seed``. A document occurs once for each epoch that
    reaches it; ``source_start`` is the number of tokens of its source before
    it. A null source is a source of its own. A source without tokens occurs
    whole, once. Rows that are repeated in ``docs`` count as often. An empty
    table gives no rows.
    """
    docs, row = identified(docs)
    return _placed(docs, row, **options).filter("__kept").drop("__kept", *row)


def realised(mixed: DataFrame) -> DataFrame:
    """Per source of a mixture: its rows, tokens, share of all tokens taken, and target_weight."""
    found = mixed.groupBy("source", "target_weight").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("tokens"))
    return found.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))  # one row a source


def _placed(docs: DataFrame, row: list[str], budget: int | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, block_docs: int = BLOCK_DOCS, seed: str = "mix", tokens: Column | None = None) -> DataFrame:
    """The columns of ``mix`` and ``row`` for every row and epoch that begins, and whether it is taken."""
    narrow, rows = mix_plan(docs, row, budget, max_repetition, target_entropy, tokens)
    spark = docs.sparkSession
    plan = spark.createDataFrame([tuple(r.values()) for r in rows], PLAN_DDL)
    whole = F.when(F.col("source_tokens") > 0, F.expr("source_budget div source_tokens")).otherwise(0)
    rest = F.when(F.col("source_tokens") > 0, F.col("source_budget") % F.col("source_tokens")).otherwise(0)
    plan = plan.withColumns({"whole": whole, "rest": rest, "blocks": F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_docs)).cast("long")})
    facts = plan.select(F.col("source").alias("of"), "source_tokens", "target_weight", "whole", "rest", "blocks")
    joined = narrow.join(facts, narrow["source"].eqNullSafe(facts["of"])).drop("of")
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null is not the empty name
    doc = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "content")
    epochs = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int"))))
    placed = epochs.withColumn("block", _block(_draw(seed, name, doc), F.col("blocks"))).withColumns(
        {"block_draw": _draw(seed, name, F.col("epoch").cast("string"), F.col("block").cast("string")), "doc_draw": _draw(seed, F.col("epoch").cast("string"), doc)}
    )
    in_block = Window.partitionBy("source", "epoch", "block").orderBy("doc_draw", "doc_id", "content", *row).rowsBetween(Window.unboundedPreceding, 0)
    in_source = Window.partitionBy("source", "epoch").orderBy("block_draw", "block").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("source", "epoch", "block", "block_draw").agg(F.sum("n_tokens").alias("block_tokens"))
    starts = totals.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), (F.sum("block_tokens").over(in_source) - F.col("block_tokens")).alias("block_start"))
    ends = placed.withColumn("end", F.sum("n_tokens").over(in_block)).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
    end = F.col("block_start") + F.col("end")
    kept = (F.col("epoch") < F.col("whole")) | (2 * end - F.col("n_tokens") <= 2 * F.col("rest"))
    return ends.withColumn("__kept", kept).select("__kept", *row, "doc_id", "source", "content", "n_tokens", "epoch", "block", (F.col("epoch") * F.col("source_tokens") + end - F.col("n_tokens")).alias("source_start"), "target_weight")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as the mixture takes it, all columns kept.

    Options are those of ``mix``, as is what happens to nulls and repeated rows.
    An empty table stays empty. Only rows that do not occur exactly once are
    joined, so the others stay where they lie.
    """
    docs, row = identified(docs)
    times = fresh(docs, "__tessera_times")
    changed = settled(lambda: _placed(docs, row, **options).groupBy(*row).agg(F.sum(F.col("__kept").cast("int")).alias(times)).filter(F.col(times) != 1), "mixed")
    taken = matching(docs, changed, row, "left").drop(*row)
    columns = [F.col(f"`{x}`") for x in docs.columns if x not in row]
    copies = F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col(times), F.lit(1)).cast("int"))).alias(times)
    return taken.select(*columns, copies).drop(times)


MIX_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS content,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents),
t AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS source_tokens FROM d GROUP BY source),
b AS (SELECT sum(source_tokens)::BIGINT AS budget FROM t),
worst AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.0::DOUBLE AS probe
  UNION ALL
  SELECT step + 1, CASE WHEN bad THEN probe ELSE low END, CASE WHEN bad THEN high ELSE probe END,
         (CASE WHEN bad THEN probe ELSE low END + CASE WHEN bad THEN high ELSE probe END) / 2
  FROM (SELECT w.*, (SELECT max(power(t.source_tokens::DOUBLE / budget, w.probe) * budget / t.source_tokens)
                            / sum(power(t.source_tokens::DOUBLE / budget, w.probe)) > {MAX_REPETITION} * (1 + {SLACK})
                     FROM t, b WHERE t.source_tokens > 0) AS bad FROM worst w)
  WHERE step <= {STEPS}),
e AS (SELECT CASE WHEN (SELECT high FROM worst WHERE step = 1) = 0 THEN 0.0 ELSE (SELECT high FROM worst WHERE step = {STEPS} + 1) END AS a),
q AS (
  SELECT source, n_docs, source_tokens,
         power(source_tokens::DOUBLE / budget, a) / (SELECT sum(power(source_tokens::DOUBLE / budget, a)) FROM t, b, e WHERE source_tokens > 0) AS target_weight, budget
  FROM t, b, e WHERE source_tokens > 0
  UNION ALL SELECT source, n_docs, source_tokens, 0.0, budget FROM t, b WHERE source_tokens = 0),
p AS (
  SELECT *, CASE WHEN source_tokens > 0 THEN floor(target_weight * budget)::BIGINT // source_tokens ELSE 0 END AS whole,
         CASE WHEN source_tokens > 0 THEN floor(target_weight * budget)::BIGINT % source_tokens ELSE 0 END AS rest,
         greatest(1, ceil(n_docs / {float(BLOCK_DOCS)}))::BIGINT AS blocks,
         coalesce('=' || source, '') AS name
  FROM q),
j AS (
  SELECT d.*, p.source_tokens, p.target_weight, p.whole, p.rest, p.name, x.epoch,
         ('0x' || substr(md5(concat_ws('|', 'mix', p.name, coalesce(d.doc_id::VARCHAR, ''), d.content)), 1, 8))::BIGINT % p.blocks AS block
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(p.whole + 1)) AS epoch) x),
r AS (
  SELECT *, md5(concat_ws('|', 'mix', name, epoch::VARCHAR, block::VARCHAR)) AS block_draw,
         md5(concat_ws('|', 'mix', epoch::VARCHAR, coalesce(doc_id::VARCHAR, ''), content)) AS doc_draw FROM j),
s AS (
  SELECT *, (sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block_draw, block, doc_draw, doc_id, content ROWS UNBOUNDED PRECEDING))::BIGINT AS until FROM r)
SELECT doc_id, source, content, n_tokens, epoch::INTEGER AS epoch, block, epoch * source_tokens + until - n_tokens AS source_start, round(target_weight, 9) AS target_weight
FROM s WHERE epoch < whole OR 2 * until - n_tokens <= 2 * rest
"""
