"""Survey files to typed cells, and the result, topline and log sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.functions import dist, keys
from plurality.plans.ranking import ranked_by_hash
from plurality.sources import records

RAW_COLUMNS = (
    "dataset_name",
    "input_template",
    "human_answer",
    "group_prompt_template",
    "group_prompt_variable_map",
    "grouping_keys",
    "num_grouping_vars",
    "group_size",
    "answer_options",
)

# Columns kept when persona shards are read (fixed values).
PERSONA_COLUMNS = (
    "uuid",
    "sex",
    "age",
    "marital_status",
    "education_level",
    "state",
    "city",
    "occupation",
    "persona",
    "professional_persona",
    "cultural_background",
    "hobbies_and_interests",
    "career_goals_and_ambitions",
)

RUN_LOG_SCHEMA = (
    "run_id string, seq bigint, node_id string, config_hash string, parent_id string, lever_id string, "
    "rationale string, dev_score double, dev_breakdown map<string,double>, val_score double, eta double, "
    "accepted boolean, global_k_at_query int, ts string, cost_usd double, cum_cost_usd double, "
    "params map<string,string>, spec_config string"
)


# A quoted string of a dict or set literal, escapes included.
QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
JSON_OPTIONS = {"allowBackslashEscapingAnyCharacter": "true"}


def _as_json_text(literal: Column) -> Column:
    """A dict literal's None, True, False, bare integer keys and last comma as JSON; quoted strings stay as they are."""

    def outside(piece: Column) -> Column:
        for pattern, new in ((r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"([{,]\s*)(-?\d+)(\s*:)", '$1"$2"$3'), (r",(\s*)\}", "$1}")):
            piece = F.regexp_replace(piece, pattern, new)
        return piece

    pieces, quoted = F.split(literal, QUOTED, -1), F.regexp_extract_all(literal, F.lit(QUOTED), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(pieces, quoted, lambda p, q: F.array(outside(p), F.coalesce(q, F.lit(""))))), "")


def last_wins(found: Column) -> Column:
    """A map that was read with repeated keys: the last value of a key, at the key's first place."""

    def body(entries: Column) -> Column:
        names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        values = F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
        return F.map_from_arrays(names, values)

    return dist.let(F.map_entries(found), body)


def parse_mapping(text: Column) -> Column:
    """Dict-like text to ``map<string,string>``; empty, nan, none and unreadable give an empty map.

    JSON and dict literals (single quotes, None, True, False, integer keys, a last comma) are read on the JVM.
    The text must end with its object; of a repeated key the last value counts.
    """
    clean = F.trim(text)
    blank = clean.isNull() | F.lower(clean).isin("", "nan", "none", "{}")
    wanted = F.when(~blank & clean.startswith("{") & clean.endswith("}"), clean)
    read = lambda t: F.from_json(t, "map<string,string>", JSON_OPTIONS)
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(last_wins(F.coalesce(read(wanted), read(_as_json_text(wanted)))), empty)


def parse_keyset(text: Column) -> Column:
    """Set literal such as ``{'b', 'a'}`` or ``{1, 2}`` to a sorted array; ``set()`` and unreadable text to an empty one."""
    quoted = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))
    names = F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    inside = F.regexp_extract(F.trim(text), r"(?s)^\{(.*)\}$", 1)
    bare = F.regexp_extract_all(F.regexp_replace(inside, QUOTED, ""), F.lit(r"[^,\s]+"), F.lit(0))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(names, bare))), F.array().cast("array<string>"))


def normalize_distribution(raw: Column) -> Column:
    """Label -> percentage text to label -> probability; true counts one, labels without a finite number are dropped."""
    number = lambda v: F.when(F.lower(v) == "true", 1.0).when(F.lower(v) == "false", 0.0).otherwise(v.try_cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    numeric = F.map_filter(F.transform_values(raw, lambda _, v: number(v)), lambda _, v: finite(v))

    def scaled(m: Column) -> Column:
        total = dist.vsum(F.map_values(m))
        return dist.let(
            total,
            lambda s: F.when(s <= 0, F.transform_values(m, lambda _, v: F.lit(1.0) / F.size(m))).otherwise(
                F.transform_values(m, lambda _, v: v / s)
            ),
        )

    return dist.let(numeric, scaled)


def whole_number(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(~F.isnan(number), number).try_cast("bigint")


def to_cells(raw: DataFrame, split: str | Column) -> DataFrame:
    """Typed cells from raw survey rows; rows without a usable distribution are dropped.

    ``record_id`` is a 128-bit content hash of dataset, split, question and segment: the question's text is stored once, in
    ``question``.  Rows that repeat all four repeat the id; ``one_per_record`` settles them.
    """
    missing = [c for c in RAW_COLUMNS if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else raw
    typed = raw.select(
        F.coalesce("dataset_name", F.lit("")).alias("dataset"),
        (F.lit(split) if isinstance(split, str) else split).alias("split"),
        F.coalesce("input_template", F.lit("")).alias("question"),
        normalize_distribution(parse_mapping(F.col("human_answer"))).alias("truth"),
        parse_mapping(F.col("answer_options")).alias("answer_options"),
        F.coalesce("group_prompt_template", F.lit("")).alias("group_prompt"),
        parse_mapping(F.col("group_prompt_variable_map")).alias("segment"),
        parse_keyset(F.col("grouping_keys")).alias("grouping_keys"),
        whole_number(F.col("num_grouping_vars")).alias("_n_vars"),
        whole_number(F.col("group_size")).alias("group_size"),
    ).filter(F.size("truth") > 0)
    return typed.select(
        keys.record_key(F.col("dataset"), F.col("split"), F.col("question"), F.col("segment")).alias("record_id"),
        "dataset",
        "split",
        "question",
        F.map_keys("truth").alias("options"),
        "truth",
        "answer_options",
        "group_prompt",
        "segment",
        "grouping_keys",
        F.coalesce(F.col("_n_vars").try_cast("int"), F.size("segment")).alias("n_grouping_vars"),
        "group_size",
    )


def one_per_record(cells: DataFrame) -> DataFrame:
    """One row per record_id: that of the largest group, of equal ones the one whose truth comes first as text."""
    pick = F.min_by(F.struct("*"), F.struct((-F.coalesce("group_size", F.lit(-1))).alias("size"), F.to_json("truth").alias("truth")))
    return cells.groupBy(F.col("record_id").alias("_id")).agg(pick.alias("row")).select("row.*")


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Cells of the CSV files at ``path``; a file is read in as many tasks as it has blocks, line breaks in quoted fields included."""
    return to_cells(records.read(spark, path), split)


def read_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union of the splits, tagged: ``{"pop": path, "grouped": path}``."""
    frames = [read_split(spark, path, split) for split, path in paths.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def is_population() -> Column:
    return (F.col("n_grouping_vars") == 0) & (F.size("segment") == 0)


# -- sinks -------------------------------------------------------------------------


def write_results(scored: DataFrame, path: str) -> None:
    """Per-record results, one folder per system."""
    scored.write.mode("overwrite").partitionBy("system").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_topline(topline: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """Topline CSV (one small file) and an optional one-row JSON with the run's settings."""
    topline.coalesce(1).write.mode("overwrite").csv(path, header=True)
    if meta is not None:
        meta.coalesce(1).write.mode("overwrite").json(f"{path}.meta")


def read_topline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_meta(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The settings that ``write_topline`` stored beside its table, typed by ``schema``: one row per run at ``path`` (which may be a pattern)."""
    return spark.read.schema(schema).json(f"{path}.meta")


def append_log(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).json(path)


def ingest_personas(spark: SparkSession, paths: Sequence[str], sample: int, seed: int = 0) -> DataFrame:
    """Seeded subsample of persona shards; only the kept columns are read.

    The cut is taken on distributed ranks of a seeded hash, so ``sample`` may be large.
    """
    shards = spark.read.parquet(*paths)
    kept = shards.select(*[c for c in PERSONA_COLUMNS if c in shards.columns])
    return sample_rows(kept, "uuid", sample, seed)


def sample_rows(df: DataFrame, id_column: str, sample: int, seed: int = 0) -> DataFrame:
    """The ``sample`` rows of smallest seeded hash; only rows up to the hash prefix that holds the cut are ranked."""
    hashed = df.withColumn("_order", keys.hash_order(seed, F.col(id_column).cast("string")))
    prefix = F.substring("_order", 1, 3)
    below, last = 0, ""
    for row in sorted(hashed.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):  # 4,096 at most
        below, last = below + row["n"], row["p"]
        if below >= sample:
            break
    hashed = hashed.filter(prefix <= last)
    return ranked_by_hash(hashed, [], "_order", "_rank").filter(F.col("_rank") <= sample).drop("_order", "_rank")


def missing_requests(requests: DataFrame, completions: DataFrame) -> DataFrame:
    """Requests whose content key has no stored response yet: the remaining work list."""
    return requests.dropDuplicates(["key"]).join(completions.select("key"), "key", "left_anti")


def answered_requests(requests: DataFrame, completions: DataFrame) -> DataFrame:
    return requests.join(completions.dropDuplicates(["key"]), "key")
