"""Near-duplicates by the Jaccard similarity of whole sets of word shingles, for the pipeline.

Candidates come from SimHash (``simhash.near_duplicates``, with its own shingles and bits): all texts of one of its components
meet.  Texts of similarity 0.8 lie about ten bits apart, often more than fifteen, which is beyond any Hamming ball that
can be enumerated, so minima of the shingle hashes under many permutations are joined to bands as well, and texts that agree
in a band meet too.  A candidate of either kind counts only if the sets themselves, made again from both whole texts, are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm import simhash
from plurality.llm.graph import components
from plurality.plans.lineage import stored

SHINGLE = 5
SIMILAR = 0.8
SEED = 42
#: A pair of similarity s shares no band with chance (1 - s ** ROWS) ** BANDS: 0.00007 at 0.8, none in practice at 0.9.
ROWS, BANDS = 5, 24
#: Sets of a band value that are compared pair by pair where hubs left them apart; more are compared in tiles of about TILE x TILE.
CROWD, TILE = 32, 128
#: Words of a hub's partners that one task compares, about.
WORDS = 200_000
AT_ONCE = 2048

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted different hashes of the word shingles; a text of fewer words is one shingle.

    A-Z is lower-cased; words are runs of other bytes than blank, tab, newline, vertical tab, form feed and return.
    """
    import xxhash

    words = text.lower().split() if text else []
    size = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)} if words else ()
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def set_id(hashes: np.ndarray) -> int:
    """One signed number for a whole set."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def bands(hashes: np.ndarray) -> list[int]:
    """A value per band; none for the empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), AT_ONCE):
        least = np.minimum(least, ((hashes[at : at + AT_ONCE, None] ^ _MASKS) * _FACTORS).min(axis=0))
    return [xxhash.xxh64_intdigest(part.tobytes(), SEED) - (1 << 63) for part in least.reshape(BANDS, ROWS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def mark() -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64("text")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, id, n, bands): the set, its size and its bands, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array(map(set_id, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(list(map(bands, sets)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *columns], names=["doc_id", "mark", "id", "n", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, id long, n long, bands array<long>")


def with_simhash(docs: DataFrame, sets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``sets`` with one more band value: the SimHash components of all rows of the set, named as one where a set lies in several.

    ``rows`` (doc_id, mark, id) are the sets of all rows of ``docs``, made here if they are not given.
    """
    row = F.xxhash64("doc_id", "mark")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), "text")
    found = simhash.near_duplicates(texts.select(row.alias("doc_id"), "text"))
    parts = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_part")).distinct()
    own = (signatures(docs) if rows is None else rows).select(row.alias("_row"), "id").distinct()
    lies = stored(own.join(parts, "_row").select("id", "_part").distinct(), "lies")
    groups = stored(lies.groupBy("id").agg(F.min("_part").alias("_group")), "groups")
    both = stored(lies.join(groups, "id").filter("_part <> _group").select(F.col("_group").alias("a"), F.col("_part").alias("b")), "both")
    if not both.isEmpty():
        roots = stored(components(both), "roots")
        groups = groups.join(roots, groups["_group"] == roots["node"], "left").select("id", F.coalesce("root", "_group").alias("_group"))
    more = F.when((F.size("bands") > 0) & F.col("_group").isNotNull(), F.concat("bands", F.array("_group"))).otherwise(F.col("bands"))
    return sets.join(groups, "id", "left").withColumn("bands", more).select(*sets.columns)


def fits(a: str, b: str) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * SIMILAR


def members(sets: DataFrame) -> DataFrame:
    """(id, n, band, value, many): the band values that more than one set holds, with the number of sets."""
    rows = stored(sets.select("id", "n", F.posexplode("bands").alias("band", "value")), "bands")
    shared = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    return stored(rows.join(shared, ["band", "value"]).select("id", "n", "band", "value", "many"), "members")


def hub_pairs(held: DataFrame) -> DataFrame:
    """(hub, other, n): every set with one hub of each of its band values: the set that shares most, which is the original of a family of copies."""
    liked = stored(held.groupBy("id").agg(F.sum("many").alias("liked")), "liked")
    centre = F.max_by(F.struct(F.col("id").alias("hub"), F.col("n").alias("hub_n")), F.struct("liked", "id"))
    hubs = stored(held.join(liked, "id").groupBy("band", "value").agg(centre.alias("c")).select("band", "value", "c.hub", "c.hub_n"), "hubs")
    met = held.join(hubs, ["band", "value"]).filter((F.col("id") != F.col("hub")) & fits("n", "hub_n"))
    return met.select("hub", F.col("id").alias("other"), "n").distinct()


def _texts(docs: DataFrame, sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text): one whole text of each set in ``ids``."""
    wanted = sets.join(ids, "id").select("id", "doc_id", "mark")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), F.col("text").cast("binary").alias("text"))
    return stored(rows.join(wanted, ["doc_id", "mark"]).groupBy("id").agg(F.first("text").alias("text")), "texts")


def _near_hub(rows: pa.Table) -> pa.Table:
    """Links of one hub (the row without ``other``) to a slice of its partners."""
    others, texts = rows.column("other").to_pylist(), rows.column("text").to_pylist()
    own = shingles(texts[others.index(None)])
    found = [i for i, text in zip(others, texts) if i is not None and similarity(own, shingles(text)) >= SIMILAR]
    return pa.table([pa.array([rows.column("hub")[0].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) of the pairs (hub, other, n) whose sets are similar.  A hub's partners are dealt in slices of bounded text, its own text once to each."""
    words = pairs.groupBy("hub").agg(F.sum("n").alias("words")).select("hub", F.ceil(F.col("words") / WORDS).cast("int").alias("slices"))
    words = stored(words.withColumn("slices", F.greatest("slices", F.lit(1))), "slices")
    hubs = words.select("hub", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).join(texts.withColumnRenamed("id", "hub"), "hub")
    dealt = pairs.join(words, "hub").select("hub", F.pmod(F.xxhash64("other"), F.col("slices")).cast("int").alias("slice"), "other")
    others = dealt.join(texts.withColumnRenamed("id", "other"), "other")
    rows = others.select("hub", "slice", "other", "text").unionByName(hubs.select("hub", "slice", F.lit(None).cast("long").alias("other"), "text"))
    return rows.groupBy("hub", "slice").applyInArrow(_near_hub, "a long, b long")


def _tile(rows: pa.Table) -> pa.Table:
    """Links between strays and members of one band value that no link connects yet; a spanning part of them."""
    parts = {}
    for r in rows.sort_by("id").to_pylist():
        parts.setdefault(r["stray"], []).append((r["id"], r["root"], r["bands"], shingles(r["text"])))
    band, top, found = rows.column("band")[0].as_py(), {}, []

    def root(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    for a, a_root, a_bands, a_set in parts.get(True, []):
        for b, b_root, b_bands, b_set in parts.get(False, []):
            x, y = root(a_root), root(b_root)
            if x == y or min(len(a_set), len(b_set)) < SIMILAR * max(len(a_set), len(b_set)):
                continue
            first = next(i for i, (v, w) in enumerate(zip(a_bands, b_bands)) if v == w)  # a pair meets in one band only
            if first == band and similarity(a_set, b_set) >= SIMILAR:
                found.append((a, b))
                top[x] = y
    return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def left_over(docs: DataFrame, sets: DataFrame, held: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between sets of one band value that the hubs left in different components: every such pair is compared.

    Band values of few sets give their pairs.  In others, each set outside the value's largest component (a stray) meets all sets of the value
    in tiles of bounded size, dealt over many tasks.
    """
    named = held.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = stored(named, "named")
    by_root = named.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("own"))
    groups = by_root.groupBy("band", "value").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("own", "root")).alias("main"), F.max("own").alias("most"), F.sum("own").alias("many"))
    open_ = stored(groups.filter("roots > 1"), "open")
    rows = stored(named.drop("many").join(open_, ["band", "value"]), "unsettled")
    wanted = rows.select("id").distinct()
    texts = _texts(docs, sets, wanted)

    one = F.struct("id", "n", "root")
    lists = rows.filter(F.col("many") <= CROWD).groupBy("band", "value").agg(F.collect_list(one).alias("held"))  # CROWD sets at most

    def partners(x):
        own = F.filter("held", lambda y: (y["id"] > x["id"]) & (y["root"] != x["root"]) & (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * SIMILAR))
        return F.transform(own, lambda y: F.struct(x["id"].alias("hub"), y["id"].alias("other"), y["n"].alias("n")))

    pairs = stored(lists.select(F.explode(F.flatten(F.transform("held", partners))).alias("pair")).select("pair.*").distinct(), "pairs")
    crowded = rows.filter(F.col("many") > CROWD).withColumn("stray", F.col("root") != F.col("main"))
    strays = F.ceil((F.col("many") - F.col("most")) / TILE).cast("int")
    all_ = F.ceil(F.col("many") / TILE).cast("int")
    own = lambda slices: F.pmod(F.xxhash64("id"), slices).cast("int")
    every = lambda slices: F.explode(F.sequence(F.lit(0), slices - 1))
    first = crowded.filter("stray").select("band", "value", own(strays).alias("x"), every(all_).alias("y"), F.lit(True).alias("stray"), "id", "root")
    second = crowded.select("band", "value", every(strays).alias("x"), own(all_).alias("y"), F.lit(False).alias("stray"), "id", "root")
    dealt = first.unionByName(second).join(sets.select("id", "bands"), "id").join(texts, "id")
    tiles = dealt.groupBy("band", "value", "x", "y").applyInArrow(_tile, "a long, b long")
    return stored(verified(pairs, texts).unionByName(tiles), "links")


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between sets (id, doc_id, mark, n, bands) of similarity ``SIMILAR`` or more, verified on whole texts.

    They connect what all pairs of sets that share a band value (a SimHash component is one) and are similar would connect: first every set meets the hubs of its values,
    which joins a family of copies at once, then what the hubs left apart is compared.
    """
    held = members(sets)
    pairs = stored(hub_pairs(held), "pairs")
    ids = pairs.select(F.col("hub").alias("id")).unionByName(pairs.select(F.col("other").alias("id"))).distinct()
    near = stored(verified(pairs, _texts(docs, sets, ids)), "links")
    return near.unionByName(left_over(docs, sets, held, stored(components(near), "roots")))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of texts linked by similarity: of the smallest doc_id, and of its texts in the group the first by a hash.

    All columns stay.  Texts without a word are alike.  Rows that repeat a doc_id with unlike texts are groups of their own; rows
    that are equal in doc_id and text count once.  Rows without a doc_id are compared with each other, as rows of one id are; they
    link no rows that have one, nor do those take their place: nothing names them.
    """
    named, nameless = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    if nameless.isEmpty():
        return _single(named)
    kind = docs.schema["doc_id"].dataType
    single = _single(nameless.withColumn("doc_id", F.lit(0).cast("long"))).withColumn("doc_id", F.lit(None).cast(kind))
    return _single(named).unionByName(single)


def _single(named: DataFrame) -> DataFrame:
    """``without_duplicates`` of rows that all have a doc_id."""
    least = F.min(F.struct("doc_id", "mark")).alias("least")
    rows = stored(signatures(named), "signatures")
    sets = rows.groupBy("id").agg(least, F.first("n").alias("n"), F.first("bands").alias("bands")).select("id", "least.doc_id", "least.mark", "n", "bands")
    sets = stored(with_simhash(named, sets, rows), "sets")
    roots = stored(components(links(named, sets)), "roots")
    rooted = sets.join(roots, sets["id"] == roots["node"], "left").select(F.coalesce("root", "id").alias("root"), "doc_id", "mark")
    kept = rooted.groupBy("root").agg(least).select(F.col("least.doc_id").alias("_kept"), F.col("least.mark").alias("_mark"))
    whole = named.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_kept"), mark().alias("_mark"))
    once = Window.partitionBy("_kept", "_mark").orderBy(F.lit(0))
    single = whole.join(kept, ["_kept", "_mark"], "left_semi").withColumn("_nth", F.row_number().over(once)).filter("_nth = 1")
    return single.select("row.*")
