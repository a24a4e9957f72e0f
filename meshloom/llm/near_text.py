"""Near-duplicate texts: candidates by prefixes of their word shingles, verified on all shingles.

Shingles are put in one order, from rare to frequent. Of two texts with a Jaccard
similarity of t or more, each holds at least a share t of the other's shingles, so
the first n - ceil(t n) + l of both have l in common: texts that share fewer of
these keys can't be linked. No key is left out, however many texts share it.

Most texts of a large group are linked through a few pairs of each. Then those
that share a key and are still in different groups are compared, if their sizes,
the key's places and their parity bits allow the similarity at all: none of these
tests can rule out a pair that is similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, distinct_rows, joined_with, kept_rows, ship, small, with_text_hashes
from .components import connected_components
from .simhash import words_of

#: Texts of a key that are compared pair by pair.
FEW = 8
#: Texts of a key outside its largest group that a block holds when all that are left are compared.
BLOCK = 1024
#: Texts of a large group that those outside it are compared with in each turn, before all are.
HUBS, TURNS = 16, 3
#: Shingles that a task counts at once, the count from which it reports one, and the most that are ordered by count.
COUNTED, REPORTED, FREQUENT = 1 << 22, 4, 500_000
#: A key that is counted so often is dealt out in parts of about so many texts.
HOT = 2000
#: Texts that a task remembers, so as to handle their copies once.
SEEN_TEXTS = 200_000
#: Bits of a text's parities.
PARITIES = 1024
#: A text of n shingles has 1 + n // STEP more keys than its similarity alone asks for, and must share so many.
STEP = 20


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The different hashes of the text's shingles of ``width`` words, sorted; fewer words are one shingle."""
    words = words_of(text)
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts)), ">u8").astype(np.uint64))


def frequent_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are frequent in ``text``, sorted, and their counts; they only order shingles, so rough counts will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            often = n >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], ["key", "n"])

        size = 0
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                held.append(shingle_hashes(text, width))
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted()
                    size = 0
        yield counted()

    counts = texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
    key = found["key"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(key)
    return key[by], found["n"].to_numpy(np.int64)[by]


def counts_of(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often frequent shingles are counted; 0 for others."""
    key, n = frequent
    if not len(key):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
    return np.where(key[at] == hashes, n[at], 0)


def prefix_of(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest of a text's shingles, so many that it shares 1 + m // STEP of them with every similar text of m shingles, if m is less."""
    count = counts_of(hashes, frequent)
    size = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 + len(hashes) // STEP
    return hashes[np.lexsort((hashes, count))[:size]]


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of PARITIES residues of a hash, whether an odd number of the text's shingles have it; 64 in a number."""
    odd = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fits(nx: str, px: str, ny: str, py: str, similarity: float) -> Column:
    """Can texts with so many shingles be similar? At the first key that they share, all they have in common is from its places on."""
    return F.least(F.expr(f"{nx} - {px}"), F.expr(f"{ny} - {py}")) >= similarity / (1 + similarity) * F.expr(f"{nx} + {ny}") - 1e-9


def near_bits(nx: str, bx: str, ny: str, by: str, similarity: float) -> Column:
    """Can texts with such parities be similar? Every bit that differs stands for a shingle that only one of them has."""
    differing = F.aggregate(F.zip_with(bx, by, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    return differing <= (1 - similarity) / (1 + similarity) * F.expr(f"{nx} + {ny}") + 1e-9


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose parities allow the similarity."""
    of = lambda end: sets.select(F.col("text_hash").alias(end), F.size("shingles").alias(f"n{end}"), F.col("bits").alias(f"bits_{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(near_bits("na", "bits_a", "nb", "bits_b", similarity)).select("a", "b")


def few_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all texts that share a key and may be similar; for keys of at most FEW texts, so the pairs are some times the rows."""
    a = rows.select("key", F.col("text_hash").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    b = rows.select("key", F.col("text_hash").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & fits("na", "pa", "nb", "pb", similarity)).select("a", "b")


def end_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of each text with two others of its keys: of those that are a key's smallest or largest, the smallest and the largest."""
    other = lambda c: F.when(fits("n", "place", f"{c}.n", f"{c}.place", similarity) & F.expr(f"text_hash <> {c}.text_hash"), F.col(f"{c}.text_hash"))
    ends = rows.groupBy("text_hash").agg(F.min(other("least")).alias("first"), F.max(other("most")).alias("last"))
    ends = ends.select("text_hash", F.explode(F.array("first", "last")).alias("other")).where("other is not null")
    return ends.select(F.least("text_hash", "other").alias("a"), F.greatest("text_hash", "other").alias("b"))


def apart(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of keys that several groups share, with their group and the key's largest one; a text without a group is its own.

    ``most`` and ``rest`` count the key's texts in the largest group and outside it.
    """
    named = shared.join(groups, "text_hash", "left").withColumn("group", F.coalesce("group", "text_hash"))
    per = named.groupBy("key", "group").agg(F.count("*").alias("m")).groupBy("key")
    per = per.agg(F.max_by("group", F.struct("m", "group")).alias("main"), F.count("*").alias("k"), F.max("m").alias("most"), (F.sum("m") - F.max("m")).alias("rest")).where("k > 1")
    return checkpointed(named.join(per.drop("k"), "key"))


def hub_pairs(split: DataFrame, bits: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(a, b) of texts outside the largest group of a key, each in the key where that is largest, and HUBS texts of that group."""
    large = split.where("most > 1")
    rest = large.where("group <> main").groupBy("text_hash").agg(F.max_by(F.struct("key", "n"), F.struct("most", "key")).alias("x")).select("text_hash", "x.*")
    rest = rest.join(bits, "text_hash").select("key", F.col("text_hash").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("text_hash", F.lit(turn)), "text_hash"))
    hubs = large.join(rest.select("key").distinct(), "key", "left_semi").where("group = main").withColumn("at", first).where(F.col("at") <= HUBS)
    hubs = hubs.join(bits, "text_hash").select("key", F.col("text_hash").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    # the key may be any that they share, not the first, so its places tell nothing
    fit = (F.least("nx", "ny") >= similarity * F.greatest("nx", "ny") - 1e-9) & near_bits("nx", "bx", "ny", "by", similarity)
    return rest.join(hubs, (rest["key"] == hubs["key"]) & fit).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def cross_pairs(split: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all texts that share a key, are in different groups and may be similar.

    A key's largest group is joined with the rest, the rest with itself; the rest
    is cut into blocks of about ``BLOCK`` texts, so that no key is one task's.
    """
    blocks = F.ceil(F.col("rest") / BLOCK).cast("int")
    rows = split.join(bits, "text_hash")
    of = lambda end: [F.col("text_hash").alias(end), F.col("n").alias(f"n{end}"), F.col("place").alias(f"p{end}"), F.col("group").alias(f"g{end}"), F.col("bits").alias(f"b{end}")]
    left = rows.where("group <> main").select("key", F.pmod(F.xxhash64("text_hash"), blocks).cast("int").alias("block"), *of("x"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), (F.col("group") == F.col("main")).alias("of_main"), *of("y"))
    apart = F.expr("gx <> gy and (of_main or x < y)") & fits("nx", "px", "ny", "py", similarity) & near_bits("nx", "bx", "ny", "by", similarity)
    met = (left["key"] == right["key"]) & (left["block"] == right["block"])
    return left.join(right, met & apart).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_text_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, text_col: str = "text") -> DataFrame:
    """(text_hash, group) of every text that is linked to a different one; ``group`` is the smallest hash reached.

    Texts are linked if the Jaccard similarity of their sets of ``width``-word
    shingles (A-Z lower-cased) is at least ``similarity``. ``text_hash`` is
    ``xxhash64`` of the text, so copies are one text. Null texts and texts
    without words have no links. Only texts with a candidate are read again.

    Of all texts only the keys are shuffled, once. Two texts that share no key with
    a third cost nothing more.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("text is not null")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, width))  # FREQUENT shingles at most

    def fresh(batch: pa.RecordBatch, seen: set[int]) -> dict[int, str]:
        """The batch's texts with words that the task hasn't seen yet."""
        rows = {h: t for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if h not in seen and t.strip(" \t\n\v\f\r")}
        if len(seen) < SEEN_TEXTS:
            seen.update(rows)
        return rows

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small(batches):
            rows = fresh(batch, seen)
            own = [shingle_hashes(t, width) for t in rows.values()]
            found = [prefix_of(h, frequent.value, similarity) for h in own]
            size = [len(f) for f in found]
            flat = np.concatenate([np.zeros(0, np.uint64), *found])
            names = np.repeat(np.fromiter(rows, np.int64, len(rows)), size)
            n = np.repeat(np.fromiter(map(len, own), np.int32, len(own)), size)
            place = np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in size)])
            # a key that is counted often is surely shared, and its texts are dealt out by their own hashes
            times = counts_of(flat, frequent.value) // HOT
            salt = np.where(times > 0, 1 + names.view(np.uint64) % np.maximum(times, 1).astype(np.uint64), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(salt), pa.array(names), pa.array(n), pa.array(place)], ["key", "salt", "text_hash", "n", "place"])

    keyed = texts.mapInArrow(keys, "key long, salt int, text_hash long, n int, place int")
    of_key, of_text = Window.partitionBy("key", "salt"), Window.partitionBy("text_hash")
    # the smallest and largest tell texts apart from mere copies before anything is joined
    keyed = keyed.withColumn("least", F.min("text_hash").over(of_key)).withColumn("most", F.max("text_hash").over(of_key))
    shared = keyed.where("salt > 0 or least < most").select("key", "text_hash", "n", "place").distinct()
    # the smallest similar text has a share t of the shingles, and as many keys as that asks for are in common
    asked = F.lit(1) + F.floor(F.ceil(F.col("n") * similarity - 1e-9) / STEP)
    shared = checkpointed(shared.withColumn("own", F.count("*").over(of_text)).where(F.col("own") >= asked).drop("own"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small(batches):
            rows = fresh(batch, seen)
            own = [shingle_hashes(t, width) for t in rows.values()]
            columns = [pa.array(list(rows), pa.int64()), pa.array([h.view(np.int64) for h in own], pa.list_(pa.int64())), pa.array([parities(h) for h in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["text_hash", "shingles", "bits"])

    again = joined_with(texts, shared.select("text_hash").distinct(), ["text_hash"], "left_semi")
    sets = checkpointed(again.mapInArrow(shingles, "text_hash long, shingles array<long>, bits array<long>").dropDuplicates(["text_hash"]))
    bits = sets.select("text_hash", "bits")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs)
        named = pairs.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct()
        own = joined_with(sets, named, ["text_hash"], "left_semi")
        of = lambda end: own.select(F.col("text_hash").alias(end), F.col("shingles").alias(f"of_{end}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("same", F.size(F.array_intersect("of_a", "of_b")))
        return checkpointed(both.where(F.col("same") >= similarity * (F.size("of_a") + F.size("of_b") - F.col("same")) - 1e-9).select("a", "b"))

    def grouped(links: DataFrame) -> DataFrame:
        return connected_components(links, "a", "b").select(F.col("node").alias("text_hash"), F.col("component").alias("group"))

    # a few links of each text join most of a group; only texts that they leave apart are compared with all others of their keys
    # keys of few texts are settled pair by pair; in others a few links of each text join most of a group at first
    of_key, row = Window.partitionBy("key"), F.struct("text_hash", "n", "place")
    met = shared.withColumn("m", F.count("*").over(of_key)).withColumn("least", F.min(row).over(of_key)).withColumn("most", F.max(row).over(of_key))
    links = linked(alike(few_pairs(met.where((F.col("m") > 1) & (F.col("m") <= FEW)), similarity).unionByName(end_pairs(met.where(F.col("m") > FEW), similarity)).distinct(), sets, similarity))
    shared = checkpointed(met.where(F.col("m") > FEW).select("key", "text_hash", "n", "place"))
    for turn in range(TURNS):
        split = apart(shared, grouped(links))
        found = linked(hub_pairs(split, bits, turn, similarity))
        if found.isEmpty():
            break
        links = links.unionByName(found)
    else:
        split = apart(shared, grouped(links))
    return grouped(links.unionByName(linked(cross_pairs(split, bits, similarity))))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of copies and near copies: that with the smallest id.

    Copies of a text are one group, whatever the text; null texts are one group,
    too. Null ids come last; rows that repeat an id and a text are copies. All
    columns stay. Copies are told by 128 bits of their text's hashes. Texts aren't
    shuffled: what goes is found among hashes.
    """
    groups = near_text_groups(docs, similarity, width, text_col=text_col)
    hashed, names = with_text_hashes(docs, text_col)
    once = checkpointed(distinct_rows(hashed, names, id_col))
    own = once.groupBy("hash", "check").agg(F.min("row").alias("row"))
    own = own.join(groups.withColumnRenamed("text_hash", "hash"), "hash", "left")
    alone = F.col("group").isNull()
    least = own.groupBy(F.coalesce("group", "hash").alias("of"), F.when(alone, F.col("check")).alias("alone")).agg(F.min(F.struct("row", "hash", "check")).alias("x")).select("x.*")
    return kept_rows(hashed, names, once, least, id_col).select(*docs.columns)
