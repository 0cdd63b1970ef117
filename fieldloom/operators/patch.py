"""Versioned, additive patches of specs, and the gates a patch must pass."""

from __future__ import annotations

import copy
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.extract import signature

CAP = 6
TAU = 0.90
#: Signals that a patched field may still show.
WAIVED = ("tier_shift", "match_count")


def promote(stack: list[dict], locator: dict, version: int, cap: int = CAP) -> list[dict]:
    """The locator in front of the stack; beyond the cap the last entry that never served goes, else the last."""
    out = [locator | {"born": version, "last_hit": None}, *(x for x in stack if signature(x) != signature(locator))]
    while len(out) > cap:
        idle = [i for i, x in enumerate(out) if i and x.get("last_hit") is None]
        del out[idle[-1] if idle else -1]
    return out


def bump(spec: dict, note: str = "") -> dict:
    return copy.deepcopy(spec) | {"parent": spec["version"], "version": spec["version"] + 1, "note": note}


def apply_patches(spec: dict, patches: list[dict], note: str = "") -> dict:
    """One new version for all patches; a patch without a field is for the record selector, one of an unknown field does nothing."""
    out = bump(spec, note)
    for p in patches:
        if p.get("field") is None:
            out["record_selector"] = promote(out["record_selector"], p["locator"], out["version"])
        elif p["field"] in out["fields"]:
            field = out["fields"][p["field"]]
            field["stack"] = promote(field["stack"], p["locator"], out["version"])
    return out


def record_hits(spec: dict, served: set[tuple[str, int]], root_tier: int | None) -> dict:
    """The spec with last_hit on every locator that served."""
    out = copy.deepcopy(spec)
    for name, tier in served:
        if name in out["fields"] and tier < len(out["fields"][name]["stack"]):
            out["fields"][name]["stack"][tier]["last_hit"] = out["version"]
    if root_tier is not None and root_tier < len(out["record_selector"]):
        out["record_selector"][root_tier]["last_hit"] = out["version"]
    return out


def record_hits_of(specs: DataFrame, results: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, spec) with last_hit stamped by the (field, tier) pairs that served; ``specs``: key, spec; ``results``: key, field, tier."""
    served = results.where("tier is not null").groupBy(key).agg(F.to_json(F.array_sort(F.collect_set(F.struct("field", "tier")))).alias("served"))

    def run(batches):
        for batch in batches:
            rows = [(k, json.dumps(record_hits(json.loads(spec), {(x["field"], x["tier"]) for x in json.loads(hits or "[]")}, 0))) for k, spec, hits in zip(batch[key], batch["spec"], batch["served"], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "spec"])

    return specs.join(served, key, "left").select(key, "spec", "served").mapInPandas(run, f"{key} string, spec string")


def spec_diff(old: dict, new: dict) -> list[tuple[str, str, str]]:
    """(stack, sign, signature): + new, ~ moved, - gone."""
    out = []
    stacks = [("<record>", old["record_selector"], new["record_selector"]), *((f, old["fields"].get(f, {"stack": []})["stack"], x["stack"]) for f, x in new["fields"].items())]
    for name, a, b in stacks:
        was, now = [signature(x) for x in a], [signature(x) for x in b]
        out += [(name, "+", s) for s in now if s not in was]
        out += [(name, "~", s) for i, s in enumerate(now) if s in was and was.index(s) != i]
        out += [(name, "-", s) for s in was if s not in now]
    return out


def promoted(stack: Column, locator: Column, cap: int = CAP) -> Column:
    """``promote`` for stacks as array<struct<sig, hit>> columns; ``locator`` is such a struct."""
    joined = F.concat(F.array(locator), F.filter(stack, lambda x: x["sig"] != locator["sig"]))
    idle = F.filter(F.sequence(F.lit(2), F.greatest(F.size(joined), F.lit(2))), lambda i: F.try_element_at(joined, i)["hit"].isNull() & (i <= F.size(joined)))
    at = F.coalesce(F.try_element_at(idle, F.lit(-1)), F.size(joined))
    cut = F.concat(F.slice(joined, F.lit(1), at - 1), F.slice(joined, at + 1, F.greatest(F.size(joined) - at, F.lit(0))))
    return F.when(F.size(joined) > cap, cut).otherwise(joined)


def gates(scores: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], tau: float = TAU) -> DataFrame:
    """(keys, g1, g2, g3, passed).

    ``scores``: keys, f1_broken, f1_old.  ``before`` and ``after``: keys, field, severity, and in ``after`` patched and the score
    without waived signals in ``severity``.  The third gate fails while a field that was critical still is, or a
    field other than the record becomes critical.
    """
    was = before.where("severity = 'critical'").select(*keys, "field", F.lit(True).alias("was"))
    bad = after.where("severity = 'critical'").join(was, [*keys, "field"], "left").where("was or field <> '<record>'").groupBy(*keys).agg(F.count("*").alias("bad"))
    out = scores.join(bad, keys, "left").select(*keys, (F.col("f1_broken") >= tau).alias("g1"), (F.col("f1_old") >= tau).alias("g2"), (F.coalesce("bad", F.lit(0)) == 0).alias("g3"))
    return out.withColumn("passed", F.col("g1") & F.col("g2") & F.col("g3"))
