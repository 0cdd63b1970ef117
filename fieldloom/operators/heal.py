"""The repair loop: extract, perceive, diff, diagnose, patch, verify.

All cases advance together.  A case is a row (case_id, site, old_html, new_html, spec): the last good page, the
page of today and the spec as JSON.  Each cycle is a bounded number of DataFrame jobs over all cases
that are still broken, at most ``max_cycles`` of them, so a thousand broken sites cost as many jobs as one.
Pages are parsed inside Arrow tasks; measuring, ranking, scoring and the gates are DataFrame operations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import values
from fieldloom.operators import candidates, diff, dom, health, memory, patch, scoring, stack
from fieldloom.sources import extract
from fieldloom.sources.html_tree import Node
from fieldloom.sources.store import Store, stored

MAX_CYCLES, MAX_FIELDS = 4, 6
KEY = ["case_id"]
_VALIDATORS = "array<struct<type:string,min:double,max:double,pattern:string,values:array<string>,max_len:int>>"
_HITS = f"case_id string, {extract.HITS}, transform string, validators {_VALIDATORS}"


def _spec_hits(html_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["case_id", *(x.split()[0] for x in extract.HITS.split(", ")), "transform", "validators"]
        for batch in batches:
            rows = []
            for case, html, text in zip(batch["case_id"], batch[html_col], batch["spec"], strict=True):
                spec = json.loads(text)
                for hit in extract.page_hits(html, spec):
                    field = spec["fields"].get(hit[1], {}) if hit[1] else {}
                    checks = [{k: v.get(k) for k in ("type", "min", "max", "pattern", "values", "max_len")} for v in field.get("validators") or []]
                    rows.append((case, *hit, field.get("transform") or "text", checks))
            yield pd.DataFrame(rows, columns=columns).astype({"record": "Int64", "tier": "Int32", "n_hits": "Int32", "root_tier": "Int32"})

    return run


def _checked(v: Column, text: Column, number: Column) -> Column:
    kind = v["type"]
    in_range = number.isNotNull() & (v["min"].isNull() | (number >= v["min"])) & (v["max"].isNull() | (number <= v["max"]))
    ok = F.when(kind == "number", in_range).when(kind == "nonempty", F.length(F.trim(text)) > 0).when(kind == "regex", v["pattern"].isNotNull() & F.rlike(text, F.coalesce(v["pattern"], F.lit("")))).when(kind == "enum", F.array_contains(F.coalesce(v["values"], F.array().cast("array<string>")), text)).when(kind == "max_len", v["max_len"].isNull() | (F.char_length(text) <= v["max_len"])).when(kind == "url", text.rlike("^(https?://|/)")).otherwise(F.lit(True))
    return F.coalesce(ok, F.lit(False))


def _valued(rows: DataFrame) -> DataFrame:
    """Rows with value and number from raw by the transform that each row names."""
    name = F.col("transform")
    amount = F.when(name.isin("money", "float"), values.money(F.col("raw"))).when(name == "int", values.int_value(F.col("raw")).cast("double"))
    text = F.when(name == "digits", values.digits(F.col("raw"))).when(name == "iso_date", values.iso_date(F.col("raw"))).when(~name.isin(*values.NUMERIC), values.normal_text(F.col("raw")))
    return rows.withColumn("number", amount).withColumn("value", F.coalesce(values.value_key(F.col("number").cast("string"), F.col("number")), text))


def extracted(cases: DataFrame, html_col: str) -> tuple[DataFrame, DataFrame]:
    """(results, headers) of every case's page under its own spec."""
    found = stored(cases.select("case_id", html_col, "spec").mapInPandas(_spec_hits(html_col), _HITS))
    rows = _valued(found.where("record is not null"))
    fail = F.filter("validators", lambda v: ~_checked(v, F.col("value"), F.col("number")))
    rows = rows.withColumn("fail", F.when(F.col("value").isNotNull() & (F.size(fail) > 0), F.get(fail, 0)["type"]))
    res = stored(stack.resolve(rows, [*KEY, "record", "field"], ("number", "n_hits")).select(*KEY, "record", "field", "value", "number", "tier", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "failed_validator"))
    heads = extract.headers(found, KEY).join(extract.shapes(res, KEY), KEY, "left").withColumn("shape_entropy", F.coalesce("shape_entropy", F.lit(0.0)))
    return res, heads


def perceived(res: DataFrame, heads: DataFrame, baseline: DataFrame, site_baseline: DataFrame, as_of: str, floors: DataFrame | None = None) -> DataFrame:
    return health.signals(res, baseline, KEY, as_of, floors).unionByName(health.record_signals(heads, site_baseline, KEY))


def macro_f1(pred: DataFrame, truth: DataFrame, name: str) -> DataFrame:
    """(case_id, mean F1 over the fields of truth)."""
    p = pred.select(*KEY, "field", F.col("value").alias("value_key"))
    t = truth.select(*KEY, "field", F.col("value").alias("value_key"))
    return scoring.field_scores(p, t, KEY).groupBy(*KEY).agg(F.avg("f1").alias(name))


_CANDIDATES = "case_id string, field string, transform string, locator string, signature string, kind string, q string, attr string, old boolean, record int, raw string, n_hits int"


def _spec_fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The version of each spec, and of its fields the floor of the fill rate, the transform and the first locator's kind."""
    for batch in batches:
        rows = []
        for case, text in zip(batch["case_id"], batch["spec"], strict=True):
            spec = json.loads(text)
            rows += [(case, int(spec.get("version") or 1), name, float(f.get("min_fill") or 0.95), f.get("transform") or "text", (f["stack"][0]["kind"] if f["stack"] else None)) for name, f in spec["fields"].items()]
        yield pd.DataFrame(rows, columns=["case_id", "spec_version", "field", "floor", "transform", "locator_kind"])


def _proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hits of every candidate locator of every broken field, on the new page and on the old."""
    columns = [x.split()[0] for x in _CANDIDATES.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for case, old, new, text, fields, known in zip(*(batch[c] for c in ("case_id", "old_html", "new_html", "spec", "fields", "known")), strict=True):
            spec, wanted = json.loads(text), {k["field"]: set(k["values"]) for k in known}
            pages = [(False, extract.Page.of(new)), (True, extract.Page.of(old))]
            roots = {side: extract.roots_of(p, spec["record_selector"])[0] for side, p in pages}
            for name in fields:
                field = spec["fields"].get(name)
                if field is None or not roots[False]:
                    continue
                values_known = wanted.get(name, set())
                cores = {re.sub("[^a-z0-9]", "", v.lower()) for v in values_known}
                read = lambda s: re.sub(r"[^\d.]", "", s) if re.search(r"\d", s) else s
                for locator in candidates.generate(pages[0][1], roots[False], values_known, cores, field["stack"], read):
                    for side, page in pages:
                        for i, root in enumerate(roots[side]):
                            hits = extract.resolve_all(root, locator, page, i)
                            rows.append((case, name, field.get("transform") or "text", json.dumps(locator, sort_keys=True), extract.signature(locator), locator["kind"], locator["q"], locator.get("attr"), side, i, hits[0] if hits else None, len(hits)))
        yield pd.DataFrame(rows, columns=columns)


def ranked_candidates(cases: DataFrame, known: DataFrame) -> DataFrame:
    """The best candidates of each broken field; ``cases`` has fields (array), ``known``: case_id, field, value."""
    sets = known.where("value is not null").groupBy(*KEY, "field").agg(F.array_sort(F.collect_set("value")).alias("values"))
    sets = sets.groupBy(*KEY).agg(F.collect_list(F.struct("field", "values")).alias("known"))
    hits = stored(cases.join(sets, KEY).select("case_id", "old_html", "new_html", "spec", "fields", "known").mapInPandas(_proposed, _CANDIDATES))
    read = _valued(hits).join(known.select(*KEY, "field", "value").distinct().withColumn("known", F.lit(True)), [*KEY, "field", "value"], "left")
    by = [*KEY, "field", "locator", "signature", "kind", "q", "attr"]
    now = candidates.evaluate(read.where("not old"), by)
    then = candidates.evaluate(read.where("old"), [*KEY, "field", "signature"]).select(*KEY, "field", "signature", (F.col("recovery") >= 0.9).alias("survives"))
    found = now.join(then, [*KEY, "field", "signature"], "left").withColumn("survives", F.coalesce("survives", F.lit(False))).withColumn("prior", candidates.prior(F.col("kind"), F.col("q"), F.col("attr")))
    return candidates.ranked(found.withColumn("strategy_class", candidates.strategy(F.col("kind"), F.col("q"), F.col("attr"))), [*KEY, "field"])


def _root_repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A root locator for specs that need one, without records or with a record count in a critical state at a fallback tier:
    that tier, if it finds as many records as before, moves to the front; else the best induced one."""
    for batch in batches:
        out = []
        for case, new, text, n_old, known, sick in zip(*(batch[c] for c in ("case_id", "new_html", "spec", "n_old", "known", "sick")), strict=True):
            spec, page = json.loads(text), extract.Page.of(new)
            have, tier = extract.roots_of(page, spec["record_selector"])
            if have and not (sick and tier):
                continue
            if have and abs(len(have) - n_old) <= 0.02 * n_old:
                out.append((case, json.dumps({k: v for k, v in spec["record_selector"][tier].items() if k in ("kind", "q")}) if tier else None, False))
                continue
            cores = {re.sub("[^a-z0-9]", "", v.lower()) for k in known for v in k["values"][:60]} - {""}

            def worth(roots: list, locator: dict, n_old=n_old, cores=cores) -> float:
                texts = [re.sub("[^a-z0-9]", "", r.text.lower()) if isinstance(r, Node) else "" for r in roots]
                recovery = sum(any(c in t for t in texts) for c in cores) / max(len(cores), 1)
                fit = max(0.0, 1 - abs(len(roots) - n_old) / max(n_old, 1))
                return 0.45 * recovery + 0.35 * fit + 0.20 * (0.75 if locator["kind"] == "css" and "." in locator["q"] else 0.4)

            best, top = None, worth(have, {"kind": "css", "q": ""}) if have else 0.0
            for locator in candidates.root_candidates(page, spec, set()):
                roots = [r for r in extract.nodes_of(page.document, locator) if isinstance(r, Node)]
                if len(roots) >= 3 and (w := worth(roots, locator)) > top:
                    best, top = locator, w
            out.append((case, json.dumps(best) if best else None, True))
        yield pd.DataFrame(out, columns=["case_id", "root", "induced"])


def _patched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for case, text, patches in zip(batch["case_id"], batch["spec"], batch["patches"], strict=True):
            spec = json.loads(text)
            out.append((case, json.dumps(patch.apply_patches(spec, [{"field": p["field"], "locator": json.loads(p["locator"])} for p in patches]))))
        yield pd.DataFrame(out, columns=["case_id", "spec"])


def quarantine_card(cap: int) -> Column:
    """What a person needs to know of a case that stays broken: at most six lines of evidence."""
    gates = F.coalesce("gates", F.lit("never reached verification"))
    head = [
        F.format_string("QUARANTINE  %s  spec v%d", "site", "spec_version"), F.concat(F.lit("  structural change : "), F.coalesce("diff_class", F.lit("UNKNOWN"))), F.format_string(f"  cycles spent      : %d (cap {cap})", F.coalesce("spent", F.lit(0))),
        F.concat(F.lit("  last gate state   : "), gates), F.when(F.col("gates").isNull(), "  reason            : no candidate locator recovered any known value").otherwise("  reason            : gates never passed"), F.lit("  monitor evidence  :"),
    ]
    return F.concat_ws("\n", *head, F.array_join(F.coalesce("evidence", F.array().cast("array<string>")), "\n"), F.lit("  action            : extraction of this site is paused until its spec is reviewed"))


def _kept(store: Store, healed: DataFrame, tried: DataFrame, now: DataFrame, baseline: DataFrame, run_id: str) -> None:
    """Writes what a healed case leaves: its spec, page, results, folded baseline and the mark of a good run."""
    fixed = stored(tried.join(healed.select(*KEY), KEY, "left_semi"))
    if fixed.isEmpty():
        return
    run = F.concat_ws("/", F.lit(run_id), "case_id").alias("run_id")
    version = F.get_json_object("spec", "$.version").cast("int")
    results = now.join(fixed.select(*KEY, "site"), KEY)
    stamped = patch.record_hits_of(fixed.select(*KEY, "spec"), results)
    fixed = stored(fixed.drop("spec").join(stamped, KEY))
    store.save_specs(fixed.select("site", version.alias("version"), F.get_json_object("spec", "$.parent").cast("int").alias("parent"), F.lit("heal").alias("created_by"), run.alias("note"), "spec"))
    store.save_snapshots(fixed.select("site", run, F.col("new_html").alias("html")))
    store.save_results(results.select("site", run, "record", "field", "value", "number", "tier"))
    folded = health.fold_baseline(baseline.join(fixed.select(*KEY), KEY, "left_semi"), health.baseline_of(now.join(fixed.select(*KEY), KEY, "left_semi"), KEY), KEY)
    store.save_baselines(folded.join(fixed.select(*KEY, "site"), KEY).withColumn("run_id", run).drop(*KEY))
    store.mark_good(fixed.select("site", run, F.current_timestamp().alias("marked_at")))


def heal(
    cases: DataFrame, as_of: str = "2030-01-01", max_cycles: int = MAX_CYCLES, chooser: Callable[[DataFrame], DataFrame] | None = None, episodes: DataFrame | None = None, store: Store | None = None, run_id: str = "heal",
    cross_site_only: bool = False, use_diff: bool = True, regression_gate: bool = True,
) -> DataFrame:
    """(case_id, status, cycles, diff_class, f1_before, f1_after, f1_old, fields, asked, recalled, card, spec) of every case.

    status: healthy (the monitor is quiet), healed or quarantined; ``card`` says why a case is quarantined.  A field whose
    candidates are ambiguous takes what memory decides (``episodes``, else those of ``store``): the candidate of the
    strategy class of the most similar healed episode (of other sites, with ``cross_site_only``); ``recalled`` counts
    such fields and ``asked`` those that memory leaves open, where ``chooser`` may reorder the ranked candidates (columns
    as ``ranked_candidates``) and else the best one is taken.  Strategies that failed, in earlier cycles or by memory, are
    avoided unless nothing else is left.  A store gets each cycle's episodes, and of healed cases the spec, the page,
    the results, the folded baseline and the mark of a good run.  ``use_diff`` and ``regression_gate`` switch off the class of
    difference and the gate on the old page, for ablations.
    """
    spark = cases.sparkSession
    cases = stored(cases)
    truth, old_heads = extracted(cases, "old_html")
    baseline, site_baseline = stored(health.baseline_of(truth, KEY)), stored(old_heads.select(*KEY, "n_records", "root_tier", "shape_entropy"))
    res, heads = extracted(cases, "new_html")
    described = stored(cases.select("case_id", "spec").mapInPandas(_spec_fields, "case_id string, spec_version int, field string, floor double, transform string, locator_kind string"))
    floors = described.select(*KEY, "field", "floor")
    seen = stored(perceived(res, heads, baseline, site_baseline, as_of, floors))
    before = stored(health.report(seen, KEY))
    if episodes is None and store is not None:
        episodes = store.known_episodes()
    f1_before = stored(macro_f1(res, truth, "f1_before"))
    fired = before.where("fired").select(*KEY).distinct()
    active = stored(cases.join(fired, KEY))
    nodes = lambda c: dom.dom_nodes(active.select(*KEY, F.col(c).alias("html")), KEY)
    if use_diff:
        blobs = stored(diff.json_strings(active, KEY, "new_html"))
        classes = stored(diff.primary(diff.edits(stored(nodes("old_html")), stored(nodes("new_html")), KEY, blobs), KEY))
    else:
        classes = spark.createDataFrame([], "case_id string, diff_class string")
    shape = T.StructType([T.StructField(k, t()) for k, t in (("case_id", T.StringType), ("status", T.StringType), ("cycles", T.IntegerType), ("f1_after", T.DoubleType), ("f1_old", T.DoubleType), ("fields", lambda: T.ArrayType(T.StringType())), ("new_spec", T.StringType))])
    counted = spark.createDataFrame([], "case_id string, asked long, recalled long")
    tried_gates = spark.createDataFrame([], "case_id string, cycle int, gates string")
    done = spark.createDataFrame([], shape)
    avoid = spark.createDataFrame([], "case_id string, field string, strategy_class string")
    if episodes is not None:
        episodes = stored(episodes)
        lost_before = memory.failed_strategies(episodes).select("site", "field", "spec_version", F.explode("strategies").alias("strategy_class"))
        avoid = stored(described.select(*KEY, "field", "spec_version").join(cases.select(*KEY, "site"), KEY).join(lost_before, ["site", "field", "spec_version"]).select(*KEY, "field", "strategy_class").distinct())
    sick = before.where("field = '<record>' and severity = 'critical'").select(*KEY, F.lit(True).alias("sick"))
    for cycle in range(1, max_cycles + 1):
        if active.isEmpty():
            break
        known = truth.select(*KEY, "field", "value")
        sets = known.where("value is not null").groupBy(*KEY, "field").agg(F.array_sort(F.collect_set("value")).alias("values")).groupBy(*KEY).agg(F.collect_list(F.struct("field", "values")).alias("known"))
        roots = active.join(site_baseline.select(*KEY, F.col("n_records").alias("n_old")), KEY).join(sets, KEY).join(sick, KEY, "left").select("case_id", "new_html", "spec", "n_old", "known", F.coalesce("sick", F.lit(False)).alias("sick")).mapInPandas(_root_repaired, "case_id string, root string, induced boolean")
        roots = stored(roots.where("root is not null"))
        root_patch = roots.select(*KEY, F.array(F.struct(F.lit(None).cast("string").alias("field"), F.col("root").alias("locator"))).alias("patches"))
        rooted = active.join(root_patch, KEY).select("case_id", "spec", "patches").mapInPandas(_patched, "case_id string, spec string").withColumnRenamed("spec", "rooted")
        staged = stored(active.join(rooted, KEY, "left").withColumn("staged", F.coalesce("rooted", "spec")).drop("rooted"))
        # with a new root the page is perceived again: fields that the root alone heals are no longer broken
        again = stored(staged.join(roots.select(*KEY), KEY, "left_semi").withColumn("spec", F.col("staged")))
        if again.isEmpty():
            now_seen = seen
        else:
            now_seen = stored(seen.join(again.select(*KEY), KEY, "left_anti").unionByName(perceived(*extracted(again, "new_html"), baseline, site_baseline, as_of, floors).join(again.select(*KEY), KEY, "left_semi")))
        level = health.report(now_seen, KEY)
        broken = level.where("severity <> 'ok' and field <> '<record>'").select(*KEY, "field", "place")
        fields = broken.groupBy(*KEY).agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "field"))), 1, MAX_FIELDS).alias("b")).select(*KEY, F.col("b.field").alias("fields"))
        asked = staged.join(fields, KEY).select("case_id", "old_html", "new_html", F.col("staged").alias("spec"), "fields")
        ranked = stored(ranked_candidates(asked, known))
        held = ranked.join(avoid, [*KEY, "field", "strategy_class"], "left_anti")
        left = ranked.join(held.select(*KEY, "field").distinct(), [*KEY, "field"], "left_anti")  # nothing else is left
        live = stored(held.unionByName(left))
        unsure = candidates.ambiguous(live, [*KEY, "field"]).where("ambiguous").select(*KEY, "field")
        prints = stored(memory.fingerprints(now_seen.where("field <> '<record>'"), classes, described.select(*KEY, "field", "transform", "locator_kind"), KEY).join(cases.select(*KEY, "site"), KEY))
        decided = live.limit(0)
        if episodes is not None:
            recalls = memory.recall(prints.join(unsure, [*KEY, "field"]).withColumnRenamed("field", "asked_field"), episodes.drop("gates"), [*KEY, "asked_field"], cross_site_only)
            decided = memory.apply_recall(live, recalls.select(*KEY, F.col("asked_field").alias("field"), "outcome", "strategy_class", "place"), [*KEY, "field"])
        decided = stored(decided)
        rest = live.join(decided.select(*KEY, "field"), [*KEY, "field"], "left_anti")
        rest = chooser(rest) if chooser else rest
        picked = stack.first_per_group(rest, [*KEY, "field"], ["place"]).withColumn("used_memory", F.lit(False))
        choice = stored(picked.unionByName(decided.withColumn("used_memory", F.lit(True))).select(*KEY, "field", "locator", "strategy_class", "used_memory"))
        open_fields = unsure.join(choice.select(*KEY, "field", "used_memory"), [*KEY, "field"]).groupBy(*KEY).agg(F.count_if(~F.col("used_memory")).alias("asked"), F.count_if("used_memory").alias("recalled"))
        counted = stored(counted.unionByName(open_fields))
        patches = choice.select(*KEY, "field", "locator").unionByName(roots.select(*KEY, F.lit(None).cast("string").alias("field"), F.col("root").alias("locator")))
        patches = patches.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("field", "locator"))).alias("patches"))
        new = active.select("case_id", "spec").join(patches, KEY).mapInPandas(_patched, "case_id string, spec string").withColumnRenamed("spec", "new_spec")
        tried = stored(active.join(new, KEY).withColumn("spec", F.col("new_spec")))
        now, now_heads = extracted(tried, "new_html")
        then, _ = extracted(tried, "old_html")
        signals = perceived(now, now_heads, baseline, site_baseline, as_of, floors)
        is_patched = choice.select(*KEY, "field", F.lit(True).alias("patched"))
        waived = signals.join(is_patched, [*KEY, "field"], "left").where(~(F.coalesce("patched", F.lit(False)) & F.col("signal").isin(*patch.WAIVED))).drop("patched")
        after = health.health(waived, KEY)
        scores = stored(macro_f1(now, truth, "f1_broken").join(macro_f1(then, truth, "f1_old"), KEY))
        verdict = patch.gates(scores, before, after, KEY)
        if not regression_gate:
            verdict = verdict.withColumn("passed", F.col("g1") & F.col("g3"))
        verdict = stored(verdict.join(scores, KEY).join(described.select(*KEY, "spec_version").distinct(), KEY).join(f1_before, KEY, "left").withColumn("cycles", F.lit(cycle)))
        told = F.concat_ws(", ", *(F.concat(F.lit(f"{g.upper()}="), F.when(F.col(g), "pass").otherwise("FAIL")) for g in ("g1", "g2", "g3")))
        tried_gates = stored(tried_gates.unionByName(verdict.select(*KEY, F.col("cycles").alias("cycle"), told.alias("gates"))))
        if store is not None:
            store.append_episodes(memory.remember(choice, prints, verdict, KEY))
        names = choice.groupBy(*KEY).agg(F.array_sort(F.collect_list("field")).alias("fields"))
        healed = tried.select(*KEY, "new_spec").join(verdict.where("passed"), KEY).join(names, KEY, "left").select(*KEY, F.lit("healed").alias("status"), F.lit(cycle).alias("cycles"), F.col("f1_broken").alias("f1_after"), "f1_old", "fields", "new_spec")
        done = stored(done.unionByName(healed))
        avoid = stored(avoid.unionByName(choice.join(verdict.where("not passed").select(*KEY), KEY).select("case_id", "field", "strategy_class")).distinct())
        if store is not None:
            _kept(store, healed, tried, now, baseline, run_id)
        active = stored(active.join(done.select(*KEY), KEY, "left_anti").join(tried.select(*KEY), KEY, "left_semi"))
    last = tried_gates.groupBy(*KEY).agg(F.max_by("gates", "cycle").alias("gates"), F.max("cycle").alias("spent"))
    asked = counted.groupBy(*KEY).agg(F.sum("asked").alias("asked"), F.sum("recalled").alias("recalled"))
    evidence = before.where("severity <> 'ok'").groupBy(*KEY).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", F.format_string("    - %s: %s (%.2f)", "field", "severity", "score").alias("line")))), 1, 6), lambda x: x["line"]).alias("evidence"))
    out = cases.select(*KEY, "site", "spec").join(f1_before, KEY, "left").join(fired.withColumn("fired", F.lit(True)), KEY, "left").join(classes, KEY, "left").join(done, KEY, "left").join(last, KEY, "left").join(asked, KEY, "left").join(evidence, KEY, "left").join(described.select(*KEY, "spec_version").distinct(), KEY, "left")
    status = F.coalesce("status", F.when(F.col("fired"), "quarantined").otherwise("healthy"))
    return out.select(*KEY, "site", status.alias("status"), F.coalesce("cycles", F.when(F.col("fired"), max_cycles).otherwise(0)).alias("cycles"), F.when(F.col("fired"), F.coalesce("diff_class", F.lit("UNKNOWN"))).alias("diff_class"), "f1_before", F.coalesce("f1_after", "f1_before").alias("f1_after"), "f1_old", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("recalled", F.lit(0)).alias("recalled"), F.when(status == "quarantined", quarantine_card(max_cycles)).alias("card"), F.coalesce("new_spec", "spec").alias("spec"))
