"""Operational tables: keyed stores, sessions, logs, sweeps, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import scale
from tracewright.operators.quality import exact_quantiles
from tracewright.session import stage


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Last row per key."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, seq: str, delete: str) -> DataFrame:
    """Apply the last change of every key to `base`; deleted keys leave the result."""
    values = [c for c in base.columns if c != key]
    last = latest(changes, key, seq)
    new = last.select(key, F.struct(*values).alias("_n"), F.col(delete).alias("_d"))
    old = base.select(key, F.struct(*values).alias("_o"))
    return (
        old.join(new, key, "full_outer").where(~F.coalesce(F.col("_d"), F.lit(False)))
        .select(key, F.coalesce("_n", "_o").alias("_r")).select(key, "_r.*")
    )


def without_types(entries: DataFrame, types: Sequence[str]) -> DataFrame:
    return entries.where(~F.coalesce(F.col("entry_type").isin(*types), F.lit(False)))


def last_messages(messages: DataFrame, session: str, turn: str, n: int) -> DataFrame:
    return scale.top_n(messages, [session], [F.col(turn).desc()], n).drop("_rank")


# fixed values: types a named history scope shows
SCOPES = {
    "image-processing": ("crop", "upload", "processed", "page", "retouch"),
    "symbol-detection": ("symbol-detection",),
    "line-segmentation": ("line-segmentation", "netlist", "spice-netlist"),
}


def of_scope(kind: Column, scope: str | None = None, types: Sequence[str] = ()) -> Column:
    """Named scope and explicit types both restrict; an unknown scope does not."""
    allowed = None
    named = SCOPES.get((scope or "").strip().lower())
    wanted = {t.strip() for t in types if t and t.strip()}
    if named:
        allowed = set(named)
    if wanted:
        allowed = wanted if allowed is None else allowed & wanted
    return F.lit(True) if allowed is None else kind.isin(*sorted(allowed))


def epoch_progress(log: DataFrame, total_epochs: int) -> DataFrame:
    """Time since the epoch before and whole seconds left at the average pace."""
    order = [F.col("epoch")]
    sliced = scale.slice_by_order(log, ["run"], order)
    rows = scale.previous(sliced, ["run"], order, "time_s", "_before").drop(scale.SLICE)
    left = F.greatest(F.lit(total_epochs) - F.col("epoch"), F.lit(0)) * (F.col("time_s") / F.col("epoch"))
    known = (F.col("epoch") > 0) & (F.col("time_s") > 0)
    return rows.withColumns({
        "delta": F.col("time_s") - F.coalesce("_before", F.lit(0.0)),
        "eta_s": F.when(known, F.floor(left)),
    }).drop("_before")


def latency_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    flat = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    med = exact_quantiles(rows, keys, value, {"median": 0.5})
    return flat.join(med, list(keys)).withColumn("fps", F.when(F.col("mean") > 0, 1000.0 / F.col("mean")).otherwise(0.0))


def sweep_totals() -> list[Column]:
    """Totals with timeouts included in the mean time."""
    return [
        F.count(F.lit(1)).alias("total"), F.count_if("timeout").alias("timeouts"),
        F.count_if(F.coalesce(F.col("returncode"), F.lit(0)) != 0).alias("nonzero"),
        F.round(F.avg("elapsed_s"), 3).alias("avg_elapsed"),
        F.count("pixel_delta").alias("delta_counted"), F.round(F.coalesce(F.avg("pixel_delta"), F.lit(0.0)), 3).alias("avg_delta"),
    ]


def mode_totals() -> list[Column]:
    """Totals with timeouts left out of the mean time and the exit codes."""
    done = ~F.col("timeout")
    return [
        F.count(F.lit(1)).alias("total"), F.count_if("timeout").alias("timeouts"),
        F.round(F.avg(F.when(done, F.col("elapsed_s"))), 6).alias("avg_elapsed"),
        F.count_if(done & (F.col("returncode") != 0)).alias("nonzero"),
    ]


def readiness(components: DataFrame, sessions: DataFrame, floor: int = 80) -> DataFrame:
    """Flags, truncated coverage percents, missing list and the ready rule per session.

    `components(session_id, label, value)`; `sessions(session_id, netlist)`.
    """
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    per = components.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(filled("label")).alias("l"), F.count_if(filled("value")).alias("v"))
    s = sessions.join(per, "session_id", "left").na.fill(0, ["n", "l", "v"])
    pct = lambda c: F.when(F.col("n") > 0, F.floor(F.col(c) * 100 / F.col("n"))).otherwise(F.lit(0))
    s = s.withColumns({"symbols": F.col("n") > 0, "labels_pct": pct("l"), "values_pct": pct("v")})
    low_l, low_v = F.col("labels_pct") < floor, F.col("values_pct") < floor
    return s.select(
        "session_id", "symbols", "netlist", "labels_pct", "values_pct",
        F.concat_ws(",", F.when(~F.col("symbols"), "symbols"), F.when(~F.col("netlist"), "netlist"),
                    F.when(low_l, "component_labels"), F.when(low_v, "component_values")).alias("missing"),
        (F.col("symbols") & F.col("netlist") & ~(low_l & low_v)).alias("ready"),
    )


def extreme_segments(segments: DataFrame, session: str) -> DataFrame:
    """Worst (missing score = 1) and best (missing = -1) segment per session and every tie of the worst.

    Rows need `ord`, `segment_id`, `score`.
    """
    low, high = F.coalesce("score", F.lit(1.0)), F.coalesce("score", F.lit(-1.0))
    ends = segments.groupBy(session).agg(
        F.min_by(F.struct("segment_id", "score"), F.struct(low, F.col("ord"))).alias("w"),
        F.min_by("segment_id", F.struct(-high, F.col("ord"))).alias("best"),
    )
    j = segments.join(ends, session)
    worst = F.col("segment_id") == F.col("w.segment_id")
    tied = F.when(F.col("w.score").isNull(), worst).otherwise(F.coalesce(F.abs(F.col("score") - F.col("w.score")) < 1e-9, F.lit(False)))
    return j.select(session, "segment_id", "score", worst.alias("is_worst"), (F.col("segment_id") == F.col("best")).alias("is_best"), tied.alias("tied_worst"))


def attach_connectors(candidates: DataFrame, connectors: DataFrame) -> DataFrame:
    """Connectors of every owner whose history id equals a candidate id, ignoring case and edge blanks.

    Rows (owner, connector), not lists, so a much used history id stays spread out.
    """
    norm = lambda c: F.lower(F.trim(F.col(c)))
    own = candidates.select("owner_id", norm("history_id").alias("_h")).where("_h <> ''").distinct()
    return own.join(connectors.withColumn("_h", norm("history_id")), "_h").drop("_h")


def connector_summary(candidates: DataFrame, connectors: DataFrame) -> DataFrame:
    """(owner_id, n, pages, edges): attached connectors of every owner that has any, with their distinct pages and edge ids.

    Connectors are counted once per history id, so an owner of one id reads one row however
    many connectors share it. Only owners of several ids meet their connectors one by one.
    """
    norm = lambda c: F.lower(F.trim(F.col(c)))
    counts = [F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"), F.count_distinct("edge_id").alias("edges")]
    own = candidates.select("owner_id", norm("history_id").alias("_h")).where("_h <> ''").distinct()
    ids = own.groupBy("owner_id").agg(F.count(F.lit(1)).alias("_ids"), F.min("_h").alias("_h"))
    facts = connectors.select(norm("history_id").alias("_h"), "page", "edge_id").groupBy("_h").agg(*counts)
    single = ids.where("_ids = 1").join(facts, "_h").select("owner_id", "n", "pages", "edges")
    several = own.join(ids.where("_ids > 1").select("owner_id"), "owner_id", "left_semi").withColumnRenamed("_h", "history_id")
    return single.unionByName(attach_connectors(several, connectors).groupBy("owner_id").agg(*counts))


def attach_or_inline(owners: DataFrame, stored: DataFrame, key: str, inline: str, payload: str) -> DataFrame:
    """Inline payload where given, else the stored one under the key."""
    return owners.join(stored.select(key, payload), key, "left").withColumn(payload, F.coalesce(F.col(inline), F.col(payload)))


# fixed values: points an agreeing field gives
MATCH_POINTS = {"history": 5, "kind": 2, "source": 2, "filename": 1, "url": 1}


#: Points that are tried together, the most first.
BANDS = ((7, 11), (3, 6), (1, 2))
#: Copies of an entry that the lookups of a single field's value are dealt over.
SALTS = 16


def best_scoring(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry with the highest sum of points per lookup, newest on ties, then first.

    The sets of fields that agree are tried in bands from the most points down; a lookup
    that has found an entry asks no further. For every set the newest entry per value combination
    is kept, so no lookup is ever paired with all entries of a common value, and
    values of a single field, which many lookups share, are dealt over SALTS keys.
    Entries go by their number in order of age, so that what is compared is one whole number,
    which is counted in a hash table without sorting the rows.
    """
    fields = list(MATCH_POINTS)
    width = scale.shuffle_width(lookups.sparkSession)
    # null dates are the oldest; of equal dates the first entry counts as the newest
    numbered = stage(scale.renumber(entries.select("entry_id", "updated_at", (-F.col("ord")).alias("neg_ord"), *fields), [F.col("updated_at"), F.col("neg_ord"), F.col("entry_id")], "number"))
    aged = numbered.select("number", *fields).repartition(width, "number")
    sets = [c for r in range(1, len(fields) + 1) for c in combinations(fields, r)]
    points = lambda names: sum(MATCH_POINTS[n] for n in names)

    def keyed(df: DataFrame, tried: Sequence[tuple], salts: Column) -> DataFrame:
        cells = []
        for i, names in enumerate(tried):
            vals = [F.lower(F.col(n)) if n == "kind" else F.col(n) for n in names]
            ok = vals[0].isNotNull() & (vals[0] != "")
            for v in vals[1:]:
                ok = ok & v.isNotNull() & (v != "")
            spread = salts if len(names) == 1 else F.array(F.lit(0))
            cells.append(F.when(ok, F.struct(F.lit(i).alias("set"), F.concat_ws("\u0001", *vals).alias("val"), F.lit(points(names)).alias("score"), spread.alias("salts"))))
        return df.withColumn("_k", F.explode(F.array_compact(F.array(*cells)))).select("*", "_k.set", "_k.val", "_k.score", F.explode("_k.salts").alias("salt")).drop("_k")

    left, found = lookups.select("lookup_id", *fields).repartition(width, "lookup_id"), None
    one, every = F.array(F.pmod(F.xxhash64("lookup_id"), F.lit(SALTS)).cast("int")), F.array(*[F.lit(k) for k in range(SALTS)])
    for low, high in BANDS:
        tried = [c for c in sets if low <= points(c) <= high]
        newest = keyed(aged, tried, F.array(F.lit(0))).groupBy("set", "val").agg(F.max("number").alias("number"))
        alone = F.array(*[F.lit(i) for i, c in enumerate(tried) if len(c) == 1]).cast("array<int>")
        newest = newest.withColumn("salt", F.explode(F.when(F.array_contains(alone, F.col("set")), every).otherwise(F.array(F.lit(0)))))
        hits = keyed(left, tried, one).select("lookup_id", "set", "val", "score", "salt").join(newest, ["set", "val", "salt"])
        best = stage(hits.groupBy("lookup_id").agg(F.max(F.col("score") * F.lit(2**40) + F.col("number")).alias("b")).select(
            "lookup_id", F.col("b").bitwiseAND(F.lit(2**40 - 1)).alias("number"), F.shiftright("b", 40).cast("int").alias("score")))
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select("lookup_id"), "lookup_id", "left_anti")
    return found.join(numbered.select("number", "entry_id"), "number").select("lookup_id", "entry_id", "score")


def only_ending(endings: DataFrame, files: DataFrame) -> DataFrame:
    """(_t, _u): each ending `_t` that exactly one row of `files` has, with its name.

    Names and endings are sorted from their last letter on. The names with an ending
    follow it there, so the next two names tell whether there is exactly one: a row
    per name and ending, however long they are.
    """
    turned = lambda c: F.reverse(F.col(c))
    names = files.select(turned("name").alias("k"), F.lit(True).alias("is_name"), F.monotonically_increasing_id().alias("tie"))
    rows = names.unionByName(endings.select(turned("_t").alias("k"), F.lit(False).alias("is_name"), F.lit(0).cast("bigint").alias("tie")).distinct())
    # walking from the end, every row sees the two names that come next
    order = [F.desc("k"), F.desc("is_name"), F.desc("tie")]
    sliced = scale.slice_by_order(rows, [], order)
    place = F.when(F.col("is_name"), F.col("k"))
    seen = scale.running(sliced, [], order, {"place": F.col("is_name").cast("bigint")})
    numbered = stage(seen.select("k", "is_name", "place").withColumn("name", place))
    ask = numbered.where("NOT is_name AND place > 0").select(F.col("k").alias("q"), "place")
    by = numbered.where("is_name").select("place", "name")
    first = ask.join(by, "place").where(F.startswith(F.col("name"), F.col("q")))
    second = by.select((F.col("place") + 1).alias("place"), F.col("name").alias("other"))
    alone = first.join(second, "place", "left").where(F.col("other").isNull() | ~F.startswith(F.col("other"), F.col("q")))
    return alone.select(turned("q").alias("_t"), turned("name").alias("_u"))


def resolve_names(refs: DataFrame, files: DataFrame) -> DataFrame:
    """File a reference means: same name, else the part after the first dash, else the only file ending so."""
    base = F.element_at(F.split("ref", "/"), -1)
    dash = F.instr(base, "-")
    r = refs.withColumn("_b", base).withColumn("_s", F.when(dash > 0, F.substr(base, dash + 1)))
    names = files.select("name").distinct()
    exact = names.select(F.col("name").alias("_b"), F.col("name").alias("_e"))
    cut = names.select(F.col("name").alias("_s"), F.col("name").alias("_c"))
    known = stage(r.withColumn("_t", F.coalesce("_s", "_b")).join(exact, "_b", "left").join(cut, "_s", "left"))
    lost = known.where("_e IS NULL AND _c IS NULL AND _t <> ''").select("_t").distinct()
    out = known.join(only_ending(lost, files), "_t", "left")
    how = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_c").isNotNull(), "after_dash").when(F.col("_u").isNotNull(), "suffix")
    return out.withColumns({"file": F.coalesce("_e", "_c", "_u"), "how": how}).drop("_b", "_s", "_t", "_e", "_c", "_u")


def grid_tasks(images: DataFrame, grid: dict[str, Sequence]) -> DataFrame:
    """Every image with every parameter combination."""
    out = images
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def sync_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Listed rows take the label of the folder they are in; unlisted files are added."""
    j = manifest.select("filename", F.col("label").alias("_old")).join(
        found.select("filename", F.col("label").alias("_new")), "filename", "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNotNull() & (F.col("_new") != F.col("_old")), "relabelled").otherwise("kept")
    )
    return j.select("filename", F.coalesce("_new", "_old").alias("label"), change.alias("change"))


def merge_corrections(components: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Given fields of a correction overwrite; unknown references are added.

    `has_label` and `has_value` tell a given null from a missing field.
    """
    c = corrections.select(*keys, "has_label", "has_value", F.col("label").alias("_l"), F.col("value").alias("_v"))
    j = components.join(c, list(keys), "full_outer")
    return j.select(
        *keys, F.when(F.col("has_label"), F.col("_l")).otherwise(F.col("label")).alias("label"),
        F.when(F.col("has_value"), F.col("_v")).otherwise(F.col("value")).alias("value"))


def wire_mentions(messages: DataFrame, wires: DataFrame, scope: str) -> DataFrame:
    """Wire ids named in messages with the wire they mean; `segment_id` is null for unknown ones."""
    said = messages.select("msg_id", scope, F.explode(T.mentions(F.col("text"))).alias("wire"))
    known = wires.groupBy(scope, T.squeeze(F.col("segment_id")).alias("wire")).agg(F.min("segment_id").alias("segment_id"))
    return said.join(known, [scope, "wire"], "left")


def correction_counts(corrections: DataFrame) -> DataFrame:
    """Entries with a component or a value, and how often each is named."""
    c, v = F.trim("component"), F.trim("value")
    rows = corrections.select(F.nullif(c, F.lit("")).alias("component"), F.nullif(v, F.lit("")).alias("value")).where(
        "component IS NOT NULL OR value IS NOT NULL")
    named = F.explode(F.array(
        F.struct(F.lit("component").alias("kind"), F.col("component").alias("item")),
        F.struct(F.lit("value").alias("kind"), F.col("value").alias("item")),
        F.struct(F.lit("entries").alias("kind"), F.lit("").alias("item"))))
    return rows.select(named.alias("n")).select("n.*").where("item IS NOT NULL").groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n"))


def inspection_set(results: DataFrame, longest: int = 6, largest: int = 8, size: int = 16) -> DataFrame:
    """Images to look at: timeouts, the longest runs and the largest differences of saved counts."""
    last = results.groupBy("image", "mode").agg(F.max_by(F.struct("timeout", "elapsed_s", "stdout"), "task_id").alias("r"))
    saved = F.coalesce(F.regexp_extract("r.stdout", r"saved=(\d+)", 1).try_cast("bigint"), F.lit(0))
    per = last.groupBy("image").agg(
        F.bool_or("r.timeout").alias("timeout"),
        F.max(F.when(~F.col("r.timeout"), F.col("r.elapsed_s"))).alias("elapsed"),
        F.abs(F.sum(F.when(F.col("mode") == "conservative", saved).otherwise(-saved))).alias("diff"),
    )
    pick = lambda df: df.select("image")
    return (
        pick(per.where("timeout"))
        .unionByName(pick(per.where("elapsed IS NOT NULL").orderBy(F.desc("elapsed"), F.desc("image")).limit(longest)))
        .unionByName(pick(per.orderBy(F.desc("diff"), F.desc("image")).limit(largest)))
        .distinct().orderBy("image").limit(size)
    )


def training_samples(manifest: DataFrame, files: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Manifest rows with a listed label whose file lies under its label or in the root."""
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("unknown"))
    rows = manifest.withColumn("label", label).where(F.col("label").isin(*labels) & (F.col("filename") != ""))
    path = F.concat_ws("/", "label", "filename")
    here = files.select(F.col("path").alias("_p"), F.lit(True).alias("_in_label")).distinct()
    root = files.select(F.col("path").alias("_q"), F.lit(True).alias("_in_root")).distinct()
    j = rows.withColumn("_p", path).join(here, "_p", "left").join(root, rows["filename"] == root["_q"], "left")
    return j.where("_in_label OR _in_root").withColumn(
        "path", F.when(F.col("_in_label"), F.col("_p")).otherwise(F.col("filename"))).drop("_p", "_q", "_in_label", "_in_root")


def with_defaults(entries: DataFrame) -> DataFrame:
    """Missing ids and labels filled in from the sequence number and the type."""
    return entries.withColumns({
        "id": F.coalesce("id", F.concat(F.lit("entry-"), F.col("seq").cast("string"))),
        "label": F.coalesce("label", F.concat(F.lit("Entry "), "type"))})
