"""How sources of a language diverge in their terms, summed over a frequent-pattern tree of term rows.

A term's row holds, for every source in which it occurs, the source and its count there, as the smoothed share p
that the count gives.  The divergence of source s from source t is a sum of f(p_s, p_t) over all kept terms.  As most counts
are zero, with share p0, the sum is split exactly into

    V * f(p0_s, p0_t)                                              every term taken as absent in both,
    sum of f(p_s, p0_t) - f(p0_s, p0_t)                            over the terms of s, and the like over those of t,
    sum of f(p_s, p_t) - f(p_s, p0_t) - f(p0_s, p_t) + f(p0_s, p0_t)   over the terms that both hold.

The last line is summed over the tree: equal rows are one row with a multiplicity, rows are sorted with their sources in
one order (those with most terms first), so that equal beginnings are one path, and a node meets each of its ancestors once,
with the multiplicity of all rows through it.  Sums are linear, so the sorted rows may be cut anywhere into tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.plans.lineage import stored
from plurality.plans.skew import attach

LEAST_DOCS = 3
TERMS = 200
UNIT = 1_000_000_000
#: Different words a task counts before it hands them on, and places of term rows in one piece of the tree.
HELD = 300_000
PLACES = 1 << 20
#: Bytes that are no part of a term become blanks, A-Z becomes a-z; bytes of other characters stay.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term) of a task's rows; every group has a row of the empty term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms)),
                    pa.array([source] * len(terms)),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *[docs[t] for t in n]], pa.int64()),
                    pa.array([0, *n.values()], pa.int64()),
                ],
                names=["lang", "source", "term", "docs", "n"],
            )

    for batch in batches:
        for lang, source, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "text")]):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(TERM_BYTES).split()
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from out()
            held.clear()
    yield from out()


def term_rows(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, seen array of (source, n), total) of the terms in at least ``least_docs`` documents of the language.

    The empty term stands for the groups themselves: its ``seen`` names every source of the language.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*text).withColumn("text", F.col("text").cast("binary")).mapInArrow(_counted, "lang string, source string, term string, docs long, n long")
    by_term = counted.repartition("lang", "term")  # both groupings below use this one exchange
    by_source = by_term.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    rows = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("seen"))
    return rows.filter((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs")


def share(count: str, total: str) -> Column:
    """p of a count: 1 + floor(UNIT * (count + 1) / total); exact for any count."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({total} as decimal(19,0))")


def gap(p: str, q: str) -> str:
    """f as SQL over longs: floor((p - q)^2 / q); shares stay below 2^31, so the square fits."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def times(count: str, value: str) -> Column:
    return F.expr(f"cast({count} as decimal(18,0)) * cast({value} as decimal(19,0))")


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Tree:
    """The tree of sorted rows: per node its item (index into the flat items), parent and multiplicity.

    ``starts`` and ``sizes`` give each row's items; ``item`` holds one number per different item.
    """

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, item: np.ndarray, many: np.ndarray):
        row = np.repeat(np.arange(len(sizes)), sizes)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = starts[row] + depth
        before = np.where(row > 0, sizes[row - 1], 0)
        same = depth < before
        same[same] = item[at[same]] == item[starts[row[same] - 1] + depth[same]]
        shared = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(shared, row[~same], depth[~same])  # the first place where a row leaves the one before it
        new = depth >= shared[row]
        order = np.lexsort((row, depth))  # rows that share a node are neighbours at its depth
        node = np.empty(len(row), dtype=np.int64)
        node[order] = np.cumsum(new[order]) - 1
        first = np.flatnonzero(new[order])
        self.item = at[order][first]
        self.many = np.add.reduceat(many[row][order], first) if len(first) else many[:0]
        above = np.where(depth > 0, np.concatenate([[-1], node[:-1]])[: len(node)], -1)
        self.parent = above[order][first]

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, ancestors) at distance 1, 2, ...: every node with every node above it, once."""
        node, above = np.arange(len(self.parent)), self.parent
        while True:
            some = above >= 0
            if not some.any():
                return
            node, above = node[some], above[some]
            yield node, above
            above = self.parent[above]


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): what pairs of sources that hold terms together add, from sorted rows (lang, seen, many)."""
    for batch in batches:
        seen = batch.column("seen")
        bounds = seen.offsets.to_numpy().astype(np.int64)
        flat = seen.values
        langs = batch.column("lang").dictionary_encode()
        names = flat.field("source").dictionary_encode()
        of_row = langs.indices.to_numpy().astype(np.int64)
        source, p, p0 = names.indices.to_numpy().astype(np.int64), flat.field("p").to_numpy(), flat.field("p0").to_numpy()
        lang = np.zeros(len(p), dtype=np.int64)
        lang[bounds[0] : bounds[-1]] = np.repeat(of_row, np.diff(bounds))
        group = lang * len(names.dictionary) + source
        item = np.unique(np.stack([group, p]), axis=1, return_inverse=True)[1].ravel()
        many = batch.column("many").to_numpy()
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PLACES, "right")) - 1)
            tree = Tree(bounds[at:stop], np.diff(bounds[at : stop + 1]), item, many[at:stop])
            keys, values = [], []
            for node, above in tree.meetings():
                a, b, m = tree.item[node], tree.item[above], tree.many[node]
                for x, y in ((a, b), (b, a)):
                    keys.append(group[x] * len(names.dictionary) + source[y])
                    values.append(m * (_gap(p[x], p[y]) - _gap(p[x], p0[y]) - _gap(p0[x], p[y]) + _gap(p0[x], p0[y])))
            at = stop
            if not keys:
                continue
            pairs, where = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(sums, where, np.concatenate(values))
            first, other = np.divmod(pairs, len(names.dictionary))
            own_lang, own = np.divmod(first, len(names.dictionary))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(own_lang)), names.dictionary.take(pa.array(own)), names.dictionary.take(pa.array(other)), pa.array(sums)],
                names=["lang", "source", "item", "value"],
            )


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs`` (lang, source, text).

    Part ``pair``: the divergence from each other source of the language, all ranks.  Part ``term``: the ``terms`` terms that
    the source holds most above its language.  Terms are runs of A-Z (lower-cased), a-z and characters beyond ASCII; those in
    fewer than ``least_docs`` documents of a language do not count.  Null text, lang and source are read as empty.  Rows
    that repeat a doc_id are documents of their own.  A group without terms has its smoothed shares; in a language without
    kept terms all pairs have value 0; a language of one source has no pairs.  An empty table gives an empty result.  All numbers are exact.
    """
    rows = stored(term_rows(docs, least_docs), "terms")
    kept = rows.filter("term <> ''")
    places = kept.select("lang", "term", "total", F.explode("seen").alias("at")).select("lang", "term", "total", "at.source", "at.n")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    of_source = places.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    named = rows.filter("term = ''").select("lang", F.explode("seen.source").alias("source"))
    sizes = named.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    sizes = sizes.select(
        "lang", "source", "v", F.col("held").alias("held"), (F.col("n") + F.col("v")).alias("size"), (F.col("lang_n") + F.col("v")).alias("lang_size"),
        F.when(F.col("v") == 0, 1).otherwise(share("0", "greatest(n + v, 1)")).alias("p0"),
    )
    sizes = stored(sizes, "sizes")
    shares = attach(places, sizes.select("lang", "source", "held", "size", "lang_size", "p0"), ["lang", "source"], ["term"], "inner")
    shares = stored(shares.select("lang", "source", "term", "held", "p0", share("n", "size").alias("p"), share("total", "lang_size").alias("q")), "shares")

    item = F.struct((-F.col("held")).alias("held"), "source", "p", "p0")
    sets = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(item)).alias("seen")).groupBy("lang", "seen").agg(F.count(F.lit(1)).alias("many"))
    lined = stored(sets, "rows").repartitionByRange("lang", "seen").sortWithinPartitions("lang", "seen")
    together = lined.mapInArrow(_corrections, "lang string, source string, item string, value long").withColumn("value", F.col("value").cast("decimal(38,0)"))

    alone = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")).withColumn("v", F.lit(0).cast("long"))
    alone = alone.unionByName(sizes.select("lang", "source", F.col("p0").alias("p"), "p0", F.lit(0).cast("long").alias("m"), "v"))
    levels = sizes.select("lang", F.col("p0").alias("r0")).distinct()  # sources of equal p0 are met as one
    met = attach(alone, levels, ["lang"], ["source", "p"], "inner")
    absent = times("v", gap("p0", "r0"))
    met = met.withColumn("to", absent + times("m", f"{gap('p', 'r0')} - {gap('p0', 'r0')}")).withColumn("back", times("m", f"{gap('r0', 'p')} - {gap('r0', 'p0')}"))
    met = met.groupBy("lang", "source", "r0").agg(F.sum("to").alias("to"), F.sum("back").alias("back"))
    others = sizes.select("lang", F.col("p0").alias("r0"), F.col("source").alias("other"))
    faced = attach(met, others, ["lang", "r0"], ["source"], "inner").filter("source <> other")
    ways = F.explode(F.array(
        F.struct(F.col("source").alias("source"), F.col("other").alias("item"), F.col("to").alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")),
    ))
    each = faced.select("lang", ways.alias("way")).select("lang", "way.*").unionByName(together)
    pairs = each.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))

    over = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value")).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
