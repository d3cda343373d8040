"""Deterministic keys: content ids, hash-to-unit values and replicate weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO64 = 18446744073709551616.0


def hash_unit(seed: int, *parts: Column) -> Column:
    """Uniform value in [0, 1] from sha-256 of ``seed::part::part``; same on every machine."""
    text = F.concat_ws("::", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("double") / TWO64


def hash_order(seed: int, *parts: Column) -> Column:
    """Hex text whose order is a seeded shuffle of the rows."""
    return F.sha2(F.concat_ws("::", F.lit(str(seed)), *parts), 256)


def hash32(*parts: Column) -> Column:
    """32-bit non-negative hash as bigint."""
    return F.conv(F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 8), 16, 10).cast("bigint")


def content_id(payload: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(payload, 256), 1, length)


def segment_key(segment: Column) -> Column:
    """Canonical text of a segment map, independent of its entry order."""
    entries = F.array_sort(F.transform(F.map_entries(segment), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.when(F.size(segment) == 0, F.lit("<pop>")).otherwise(F.array_join(entries, "|"))


def record_key(dataset: Column, split: Column, question: Column, segment: Column) -> Column:
    """32-hex id of one cell; lengths of the parts are hashed with them, so no two cells read alike."""
    parts = [dataset, split, question, segment_key(segment)]
    return content_id(F.concat_ws("|", *[F.concat(F.length(p), F.lit(":"), p) for p in parts]), 32)


def question_id(dataset: Column, split: Column, question: Column, segment: Column) -> Column:
    """12-hex id of one cell."""
    seg = F.array_sort(
        F.transform(F.map_entries(segment), lambda e: F.array(e["key"], e["value"]))
    )
    return content_id(
        F.concat_ws("\n", F.to_json(F.array(dataset, split, question)), F.to_json(seg)), 12
    )


def config_hash(model: Column, system: Column, calibrators: Column) -> Column:
    """16-hex content hash of a pipeline description."""
    payload = F.to_json(F.struct(calibrators.alias("calibrators"), model.alias("model"), system.alias("predictor")))
    return content_id(payload, 16)


def request_key(messages: Column, *params: Column) -> Column:
    """Content key under which the response to a rendered request is stored."""
    return F.sha2(F.concat_ws("\n", F.to_json(messages), *params), 256)
