"""Mixes sources to target weights: whole copies for certain, the rest by Pareto order sampling.

A source's target in words over its size says how often each of its documents
should occur. The whole part of that is copied for certain. For the rest every
document has an inclusion probability, and documents are ranked by random odds
``u / (1 - u)`` over their inclusion odds; those of the lowest ranks are taken
until the source's words are used up, so the sample's size is fixed. The last one
gives only the words that are still missing.

A document that is long for its source is drawn with a greater probability and
gives fewer words when it is drawn, so that its expected share is that of all others
and one long document doesn't make up its source's sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators.catalog import numbered

from .common import checkpointed, free_name, joined_with, ship

WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD).finditer
#: A draw gives at most so many times the mean size of the source's documents.
LONG = 4
#: The rank at which a source's words are used up is searched in so many slices, twice.
SLICES = 4096
#: Bits of the hash that decides.
HASH_BITS = 52


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, from the key's sha256."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, HASH_BITS // 4), 16, 10).cast("long") + 0.5) / float(1 << HASH_BITS)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size`` (words of the text; 0 for null) of every document."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, copies: int = 2) -> DataFrame:
    """``source, source_size, n, target``: sources in code point order (null last) take ``weights`` in turn and share ``percent`` of all words.

    No target is over ``copies`` times its source's size: what is over is shared among
    the other sources by weight, again and again until none is over. Each round is a sum
    over the table of sources, of which two numbers reach the driver.
    """
    totals = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    totals = checkpointed(totals.select("source", "source_size", "n", weight.cast("long").alias("weight"), (F.col("source_size") * copies).alias("most")))
    words = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, by_weight, level = words * percent / 100, 0, -1.0
    while True:
        # a source is at its most when its share at this level is over it; the level rises, so it stays there
        full = F.col("most") < F.col("weight") * F.lit(level)
        taken, rest = totals.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if rest == by_weight or not rest:
            break
        left, by_weight = words * percent / 100 - taken, rest
        level = left / by_weight
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(max(by_weight, 1)))
    return totals.select("source", "source_size", "n", F.when(full, F.col("most").cast("double")).otherwise(F.least(share, F.col("most").cast("double"))).alias("target"))


def _planned(targets: DataFrame) -> DataFrame:
    """Adds ``copies`` (certain), ``rate`` (what is left of the expected copies), ``most`` (words of a draw)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    most = F.greatest(F.ceil(F.col("source_size") * LONG / F.greatest("n", F.lit(1))), F.lit(1)).cast("long")
    return targets.withColumns({"copies": F.floor(rate).cast("long"), "rate": rate - F.floor(rate), "most": most})


def _ranked(sizes: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Adds to every document its source's plan, ``part`` (words of a draw), ``sure`` (drawn for certain) and ``rank``.

    ``rank`` is q / (1 + q) of the odds' ratio q, so it lies between 0 and 1, and about
    at a half where a source's words are used up.
    """
    plan = planned.select(F.col("source").alias("_source"), "source_size", "target", "copies", "rate", "most")
    rows = joined_with(sizes, plan, [F.col("source").eqNullSafe(F.col("_source"))], "inner").drop("_source")
    chance = F.when(F.col("size") <= F.col("most"), F.col("rate")).otherwise(F.col("rate") * F.col("size") / F.col("most"))
    u = uniform(F.col("id"), seed)
    rows = rows.withColumns({"chance": chance, "u": u}).withColumn("sure", F.col("chance") >= 1)
    part = F.when(F.col("sure"), F.floor(F.col("rate") * F.col("size") + 0.5).cast("long")).otherwise(F.least("size", "most"))
    odds = F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(F.col("chance"), 1 - F.col("chance")))
    return rows.withColumns({"part": part, "odds": F.when(~F.col("sure") & (F.col("chance") > 0) & (F.col("size") > 0), odds)}).withColumn("rank", F.col("odds") / (1 + F.col("odds"))).drop("odds", "u", "chance")


def _slice(rank: Column, slices: int) -> Column:
    return F.floor(rank * float(slices)).cast("long")


def _cut(rows: DataFrame, left: DataFrame, slices: int) -> DataFrame:
    """Per source the slice of ranks in which ``left`` (source, words) is used up, and the words left before it.

    Tasks add the words of a slice before they are shuffled; a source then has at most
    as many rows as a search has slices.
    """
    sums = rows.groupBy("source", _slice(F.col("rank"), slices).alias("slice")).agg(F.sum("part").alias("words"))
    order = Window.partitionBy("source").orderBy("slice")
    summed = sums.withColumn("upto", F.sum("words").over(order)).withColumns({"before": F.col("upto") - F.col("words")})
    met = summed.join(left.select(F.col("source").alias("_source"), F.col("left")), F.col("source").eqNullSafe(F.col("_source")))
    return met.where("upto >= left and before < left").select("source", "slice", (F.col("left") - F.col("before")).alias("left"))


def mixture(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, copies: int = 2, seed: int = 12) -> DataFrame:
    """What a mix of ``percent`` of all words takes of every document of ``sizes`` (``id, source, size``).

    Returns ``id, source, size, source_size, target, copies`` (whole ones), ``drawn``
    (words of a further one, from its start) and ``taken`` (all words). A source's taken
    words differ from its target by the rounding of its certain draws, half a word
    each, and only if there are no others. No document gives more than ``copies`` times
    its size.

    Reruns agree: chance is the sha256 of ``seed:id``. A null id is hashed as nothing.
    Rows with one id, source and size draw alike: if only some fit in the sample, what
    fits is shared out evenly among them and less than a word each is left over. Documents
    without words, and sources of such alone, give nothing. An empty table gives an empty
    one.

    ``sizes`` is read several times, so it should be written or checkpointed. Nothing is
    sorted or gathered by source: sums of slices of ranks find where a source's words
    are used up, first among 4096 slices, then among as many within the one found; only
    the documents of a slice of 4096 x 4096 are ranked one by one.
    """
    planned = checkpointed(_planned(source_targets(sizes, weights, percent, copies)))
    rows = checkpointed(_ranked(sizes, planned, seed))
    drawn = rows.where("rank is not null")
    parts = rows.groupBy(F.col("source").alias("_source")).agg(*(F.coalesce(F.sum(F.when(F.expr(c), F.col("part"))), F.lit(0)).alias(n) for n, c in (("_sure", "sure"), ("_pool", "rank is not null"))))
    words = F.round(F.col("target")).cast("long") - F.col("copies") * F.col("source_size") - F.col("_sure")
    left = planned.join(parts, F.col("source").eqNullSafe(F.col("_source"))).select("source", F.least(words, "_pool").alias("left"))
    first = checkpointed(_cut(drawn, left, SLICES))
    inner = joined_with(drawn, first.select(F.col("source").alias("_source"), F.col("slice").alias("_slice")), [F.col("source").eqNullSafe(F.col("_source")) & (_slice(F.col("rank"), SLICES) == F.col("_slice"))], "left_semi")
    fine = SLICES * SLICES
    second = checkpointed(_cut(inner, first, fine))
    last = joined_with(inner, second.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), "left"), [F.col("source").eqNullSafe(F.col("_source")) & (_slice(F.col("rank"), fine) == F.col("_slice"))], "inner")
    alike = last.groupBy("source", "left", "rank", "id", "size", "part").agg(F.count("*").alias("times"))
    before = F.coalesce(F.sum(F.col("part") * F.col("times")).over(Window.partitionBy("source").orderBy("rank", F.asc_nulls_last("id"), "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = alike.withColumn("room", F.greatest(F.col("left") - before, F.lit(0)))
    edge = checkpointed(edge.select(F.col("source").alias("_source"), F.col("id").alias("_id"), F.col("size").alias("_size"), F.least("part", F.floor(F.col("room") / F.col("times"))).cast("long").alias("_edge")))
    cut = second.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"))
    full = joined_with(rows, cut, [F.col("source").eqNullSafe(F.col("_source"))], "left").drop("_source")
    met = joined_with(full, edge, [F.col("source").eqNullSafe(F.col("_source")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size"))], "left")
    at = _slice(F.col("rank"), fine)
    words = F.when(F.col("sure"), F.col("part")).when(at < F.col("_slice"), F.col("part")).when(at == F.col("_slice"), F.coalesce("_edge", F.lit(0))).otherwise(0).cast("long")
    return met.withColumn("drawn", words).select("id", "source", "size", "source_size", "target", "copies", "drawn", (F.col("copies") * F.col("size") + F.col("drawn")).alias("taken"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, copies: int = 2, seed: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``mixture`` of documents: the id column, ``size, source_size, target, copies, drawn, taken``.

    Texts are read once, for their sizes, which are written to the shared folder. A null
    text has no words; a null source is a source of its own, the last. Other columns are
    ignored, whatever their names.
    """
    found = mixture(checkpointed(sized(docs, id_col, text_col, source_col)), weights, percent, copies, seed)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", "drawn", "taken")


def mixed_texts(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the mix, as often as ``plan`` (of ``mix_sources``; ids unique) says; a drawn one ends behind its words."""
    ship(docs.sparkSession)
    copies, drawn = free_name(docs, "copies"), free_name(docs, "drawn")
    own = plan.select(F.col(id_col).alias("_id"), F.col("copies").alias(copies), F.col("drawn").alias(drawn)).where(f"{copies} > 0 or {drawn} > 0")
    met = docs.join(own, docs[id_col].eqNullSafe(own["_id"])).select(*docs.columns, copies, drawn)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                whole, words = row.column(len(docs_names))[0].as_py(), row.column(len(docs_names) + 1)[0].as_py()
                text = row.column(at)[0].as_py()
                texts = [text] * whole
                if words:
                    texts.append(text[: next(islice(_WORD(text), words - 1, None)).end()])
                for t in texts:
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.string()) if k == at else row.column(k) for k in range(len(docs_names))], docs_names)

    docs_names = docs.columns
    return met.mapInArrow(run, docs.schema)


#: The same rows by sorting every source's documents.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source)
), levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS words_left,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS by_weight
  FROM totals WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
), open AS (
  SELECT arg_max(words_left, by_weight) AS words_left, max(by_weight) AS by_weight FROM levels WHERE 2 * source_size * by_weight >= weight * words_left
), targets AS (
  SELECT source, source_size, CASE WHEN 2 * source_size * l.by_weight < weight * l.words_left THEN 2.0::DOUBLE * source_size ELSE least(weight * o.words_left / o.by_weight, 2.0::DOUBLE * source_size) END AS target,
    greatest(ceil(source_size * 4.0::DOUBLE / n), 1)::BIGINT AS most
  FROM levels l, open o
), planned AS (
  SELECT *, floor(each)::BIGINT AS copies, each - floor(each) AS rate FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS each FROM targets)
), chances AS (
  SELECT doc_id, size, p.*, CASE WHEN size <= most THEN rate ELSE rate * size / most END AS chance,
    (('0x' || substr(sha256('12:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
), odds AS (
  SELECT *, CASE WHEN chance < 1 AND chance > 0 AND size > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds,
    CASE WHEN chance >= 1 THEN floor(rate * size + 0.5::DOUBLE)::BIGINT ELSE least(size, most) END AS part
  FROM chances
), summed AS (
  SELECT *, round(target)::BIGINT - copies * source_size - coalesce(sum(part) FILTER (chance >= 1) OVER (PARTITION BY source), 0)
    - coalesce(sum(part) FILTER (odds IS NOT NULL) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM odds
), drawn AS (
  SELECT *, (CASE WHEN chance >= 1 THEN part WHEN odds IS NOT NULL THEN least(part, greatest(room, 0)) ELSE 0 END)::BIGINT AS drawn FROM summed
)
SELECT doc_id, size, source_size, target, copies, drawn, (copies * size + drawn)::BIGINT AS taken FROM drawn
"""
