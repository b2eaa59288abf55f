"""Keyed picks, top-k, quotas, status joins and roll-ups.

Where a pick per key can be a partial aggregate (``max_by``), it is one; windows are
partitioned by the key and never global.  Null order is stated everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cols(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def latest_per_key(df: DataFrame, keys: str | list[str], *order: str) -> DataFrame:
    """The row with the greatest ``order`` columns per key, by map-side aggregation."""
    keys = cols(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def oldest_per_key(df: DataFrame, keys: str | list[str], *order: str) -> DataFrame:
    """The row with the smallest ``order`` columns per key."""
    keys = cols(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def top_k_per_key(df: DataFrame, keys: str | list[str], k: int, *order: Column, out: str = "rn") -> DataFrame:
    """The first k rows per key in the given order, numbered from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(*order))).where(F.col(out) <= k)


def lowest_rank(df: DataFrame, keys: str | list[str], rank: str) -> DataFrame:
    """One row per key with the lowest rank, null ranks last."""
    return oldest_per_key(df.withColumn("_none", F.col(rank).isNull()), keys, "_none", rank).drop("_none")


def outdated_versions(versions: DataFrame, provider: str, active: str, at: str, keep: int) -> DataFrame:
    """Inactive versions beyond the keep - 1 newest of their provider."""
    w = Window.partitionBy(provider).orderBy(F.col(at).desc_nulls_last())
    return versions.where(~F.col(active)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > keep - 1).drop("_rn")


def first_wins(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """The first row of a key in file order, the rows dropped, and how many of these disagree with it."""
    row = F.struct(*[c for c in df.columns if c != key])
    # a row per key and value, then one per key: the input is worked out once and joined with nothing
    values = df.where(F.col(key).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.min_by(row, position).alias("_row"), F.min(position).alias("_at"), F.count("*").alias("_n"))
    firsts = values.groupBy(key).agg(F.min_by(F.struct("_row", "_n"), "_at").alias("_f"), F.sum("_n").alias("_all"), F.sum(F.when(F.col("_v").isNull(), F.col("_n"))).alias("_none"))
    same = F.coalesce("_f._n", "_none", F.lit(0))  # rows that agree with the first; without any position it is all null
    return firsts.select(key, "_f._row.*", (F.col("_all") - 1).alias("n_duplicates"), (F.col("_all") - same).alias("n_conflicts"))


def average_ranks(df: DataFrame, group: str | list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Ranks from 1 with ties averaged, within each group."""
    w, tie = Window.partitionBy(*cols(group)).orderBy(value), Window.partitionBy(*cols(group), value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(tie) - 1) / 2)


def extremes(df: DataFrame, value: str, key: str, n: int = 15) -> DataFrame:
    """The n largest and n smallest values, numbered per side; two bounded top-n scans."""
    high = df.orderBy(F.desc(value), key).limit(n).withColumn("side", F.lit("over"))
    low = df.orderBy(F.asc(value), key).limit(n).withColumn("side", F.lit("under"))
    by = Window.partitionBy("side").orderBy(F.when(F.col("side") == "over", -F.col(value)).otherwise(F.col(value)), key)
    return high.unionByName(low).withColumn("rn", F.row_number().over(by))


def round_robin(df: DataFrame, site: str, kind: str, kinds: list[str], position: str, limit: int) -> DataFrame:
    """One row per kind in turn, in the order of ``kinds``, until ``limit`` rows per site."""
    turn = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    rows = df.where(F.col(kind).isin(kinds)).withColumn("_turn", turn)
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(site, kind).orderBy(position)))
    pick = F.row_number().over(Window.partitionBy(site).orderBy("_rn", "_turn"))
    return rows.withColumn("pick", pick).where(F.col("pick") <= limit).drop("_turn", "_rn")


def hash_sample(df: DataFrame, site: str, item: str, n: int, seed: int) -> DataFrame:
    """A uniform sample of n rows per site that is the same for any order and partitioning."""
    w = Window.partitionBy(site).orderBy(F.xxhash64(F.lit(seed), item), item)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def spread_pick(df: DataFrame, site: str, position: str, k: int) -> DataFrame:
    """Items number int(i * n / k), i < k, of each site's n items; all where n is below k."""
    w = Window.partitionBy(site)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(position)) - 1).withColumn("_n", F.count("*").over(w))
    i = F.ceil(F.col("_i") * F.lit(float(k)) / F.col("_n"))
    hit = (F.col("_n") <= k) | ((i < k) & (F.floor(i * (F.col("_n").cast("double") / k)) == F.col("_i")))
    return rows.where(hit).drop("_i", "_n")


def quota_pick(df: DataFrame, site: str, is_product: str, position: str, budget: int, share: float = 0.25) -> DataFrame:
    """``share`` of the budget is kept for products, others get the rest, and unused slots go back to products."""
    w = Window.partitionBy(site)
    n = lambda c: F.count_if(c).over(w)
    rows = df.withColumn("_p", n(F.col(is_product))).withColumn("_o", n(~F.col(is_product)))
    reserved = F.least(F.col("_p"), F.ceil(F.lit(budget) * F.lit(share)))
    rows = rows.withColumn("_no", F.least(F.col("_o"), budget - reserved)).withColumn("_np", F.least(F.col("_p"), budget - F.col("_no")))
    rn = F.row_number().over(Window.partitionBy(site, is_product).orderBy(position))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= F.when(F.col(is_product), F.col("_np")).otherwise(F.col("_no"))).drop("_p", "_o", "_no", "_np", "_rn")


def ordered_distinct(df: DataFrame, site: str, key: str, start: str, position: str, limit: int) -> DataFrame:
    """The start first, then candidates in order, one per key, up to ``limit`` rows per site."""
    first = oldest_per_key(df.withColumn("_late", ~F.col(start)), [site, key], "_late", position)
    rank = F.row_number().over(Window.partitionBy(site).orderBy("_late", position))
    return first.withColumn("pick", rank).where(F.col("pick") <= limit).drop("_late")


def keyset_page(df: DataFrame, at: str, key: str, before, n: int, where: Column | None = None) -> DataFrame:
    """The newest n rows before a point in time; the filter reaches the scan."""
    rows = df.where(F.col(at) < before)
    return (rows if where is None else rows.where(where)).orderBy(F.desc(at), F.desc(key)).limit(n)


def page_with_total(df: DataFrame, key: str, order: list[str], size: int, offset: int = 0) -> DataFrame:
    """Rows [offset, offset + size) of each key with the key's row count."""
    w = Window.partitionBy(key)
    rows = df.withColumn("total", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(*order)))
    return rows.where((F.col("rn") > offset) & (F.col("rn") <= offset + size))


def top_counts(df: DataFrame, key: str, value: str, k: int, out: str) -> DataFrame:
    """A map of each key's k most frequent values (ties: smaller value first); nulls are not counted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    top = top_k_per_key(counts, key, k, F.desc("_n"), F.asc(value), out="_rn")
    return top.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(value, "_n"))).alias(out))


def random_rows(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """N rows in a seeded random order that does not depend on partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def in_input_order(asked: DataFrame, states: DataFrame, key: str, position: str, default: str, status: str) -> DataFrame:
    """An answer for each asked row, duplicates and unknown ones kept, by input position."""
    return asked.join(states, key, "left").withColumn(status, F.coalesce(status, F.lit(default))).orderBy(position)


# joins ------------------------------------------------------------------------------------


def list_lookup(domains: DataFrame, versions: DataFrame, entries: DataFrame) -> DataFrame:
    """Every domain against the active version of every provider: present, absent or no_list.

    ``versions(provider, list_id, active, row_count)`` has a row per list version;
    active versions are few and crossed in as a broadcast; the entries, which may be
    many millions, join by (list_id, domain).
    """
    providers = versions.select("provider").distinct()
    active = versions.where("active").select("provider", "list_id", "row_count")
    grid = domains.crossJoin(F.broadcast(providers.join(active, "provider", "left")))
    found = entries.withColumn("_hit", F.lit(True))
    status = F.when(F.col("list_id").isNull(), "no_list").when(F.col("_hit"), "present").otherwise("absent")
    return grid.join(found, ["list_id", "domain"], "left").withColumn("status", status).drop("_hit")


def classify_ingest(raw: DataFrame, position: str, domain: str, open_runs: DataFrame, completed: DataFrame, now: Column, hours: int, force: bool = False) -> DataFrame:
    """Invalid, duplicate, existing (a run is open), recent (completed within ``hours``) or queued.

    Rows without a domain are dealt by their position, so that many of them are not one window.
    """
    last = completed.groupBy(domain).agg(F.max("completed_at").alias("_last"))
    open_ = open_runs.select(domain).distinct().withColumn("_open", F.lit(True))
    rows = raw.withColumn("_rn", F.row_number().over(Window.partitionBy(domain, F.when(F.col(domain).isNull(), F.col(position))).orderBy(position)))
    rows = rows.join(open_, domain, "left").join(last, domain, "left")
    recent = F.lit(False) if force else F.coalesce(F.col("_last") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False))
    status = F.when(F.col(domain).isNull(), "invalid").when(F.col("_rn") > 1, "duplicate").when(F.col("_open"), "existing").when(recent, "recent").otherwise("queued")
    return rows.withColumn("status", status).drop("_rn", "_open", "_last")


def not_fresh(tasks: DataFrame, observations: DataFrame, sources: DataFrame, now: Column, hours: int) -> DataFrame:
    """Tasks (domain, collector) but those whose collector's sources all have an observation younger than ``hours``."""
    latest = observations.groupBy("domain", "source").agg(F.max("collected_at").alias("_at"))
    wanted = tasks.join(sources, "collector").join(latest, ["domain", "source"], "left")
    fresh = F.coalesce(F.col("_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False))
    done = wanted.groupBy("domain", "collector").agg(F.bool_and(fresh).alias("_all")).where("_all")
    return tasks.join(done, ["domain", "collector"], "left_anti")


def last_status(domains: DataFrame, runs: DataFrame, key: str, at: str, status: str, default: str = "not_submitted") -> DataFrame:
    """Each domain with the status of its last run."""
    last = runs.groupBy(key).agg(F.max_by(status, at).alias(status))
    return domains.join(last, key, "left").withColumn(status, F.coalesce(status, F.lit(default)))


def overlay_status(grid: DataFrame, failed: DataFrame, disabled: DataFrame) -> DataFrame:
    """Failed tasks (domain, source) and disabled sources replace ``missing`` only."""
    rows = grid.join(failed.select("domain", "source").distinct().withColumn("_f", F.lit(True)), ["domain", "source"], "left")
    rows = rows.join(disabled.select("source").distinct().withColumn("_d", F.lit(True)), "source", "left")
    status = F.when((F.col("status") == "missing") & F.col("_d"), "disabled").when((F.col("status") == "missing") & F.col("_f"), "failed").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_f", "_d").select(*grid.columns)


def attach_latest(examples: DataFrame, features: DataFrame, key: str, at: str) -> DataFrame:
    """Each measurement with the newest snapshot of its domain, whatever its date; without one it goes."""
    return examples.join(latest_per_key(features, key, at), key)


def roll_up_children(parents: DataFrame, children: DataFrame, key: str, at: str) -> DataFrame:
    """Parents with the number of children (0) and the last child's time (null)."""
    sums = children.groupBy(key).agg(F.count("*").alias("n_children"), F.max(at).alias("last_at"))
    return parents.join(sums, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def stale_parents(parents: DataFrame, children: DataFrame, key: str, at: str, before, open_child: Column) -> DataFrame:
    """Parents older than ``before`` with no open child."""
    return parents.where(F.col(at) < before).join(children.where(open_child).select(key), key, "left_anti")


def due_lists(providers: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Providers without an active version, or whose active one is older than the refresh period."""
    active = versions.where("active").select("provider", "downloaded_at")
    old = F.col("downloaded_at") < now - F.make_dt_interval(F.lit(0), F.col("refresh_hours"))
    return providers.join(active, "provider", "left").where(F.col("downloaded_at").isNull() | old)


# roll-ups ---------------------------------------------------------------------------------


def status_counts(df: DataFrame, kind: str, status: str, values: list[str]) -> DataFrame:
    """Counts by kind with one column per status, zero filled."""
    return df.groupBy(kind).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values])


def finished_parents(tasks: DataFrame, parent: str, status: str, terminal: list[str]) -> DataFrame:
    """Parents all of whose tasks have ended."""
    return tasks.groupBy(parent).agg(F.count("*").alias("n_tasks"), F.count_if(~F.col(status).isin(terminal)).alias("_open")).where("_open = 0").drop("_open")


def histogram(df: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts up to each bound, sum and count per label set."""
    les = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return df.groupBy(*labels).agg(*les, F.sum(value).alias("total"), F.count(value).alias("n"))


def nest_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each parent with its ordered list of children (empty if none)."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("children"))
    return parents.join(lists, key, "left").withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)))


def union_entries(*frames: DataFrame) -> DataFrame:
    """One schema from all; columns a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def owned_rows(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """The rows whose owner is among ``owners``, with the owner's columns; null keys meet nothing.

    ``owners`` holds each key once, as scoped by the caller; no side is broadcast by force.
    """
    return owners.join(rows, key)


def conditional_counts(df: DataFrame, keys: list[str], conditions: dict[str, Column], total: str = "n") -> DataFrame:
    """Per key the rows (``total``) and those that meet each condition (null counts as not met), in one pass with partial sums."""
    return df.groupBy(*keys).agg(F.count("*").alias(total), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def union_of_sets(df: DataFrame, key: str, values: str, without: list | None = None) -> DataFrame:
    """Per key the sorted distinct members of all its arrays ``values``, but nulls and those in ``without``.

    Members are made distinct by (key, member) before they are gathered, so that a key with very many rows is spread over tasks
    and only its distinct members meet.  A key whose set is empty has no row.
    """
    members = df.select(key, F.explode(values).alias("_m")).where(F.col("_m").isNotNull())
    members = members.where(~F.col("_m").isin(without)) if without else members
    return members.distinct().groupBy(key).agg(F.array_sort(F.collect_list("_m")).alias(values))


def disabled_keys(known: DataFrame, enabled: DataFrame, unlisted: DataFrame, key: str) -> DataFrame:
    """U4: the distinct keys that are known but not enabled, with those in ``unlisted``; a null is a key as any other."""
    return known.select(key).subtract(enabled.select(key)).union(unlisted.select(key)).distinct()


def minus_by_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b doesn't hold."""
    return a.join(b.select(key), key, "left_anti")


def job_view(jobs: DataFrame, options: str, started: str, finished: str, status: str, estimate: str | None = None) -> DataFrame:
    """Snake-case option keys, duration in milliseconds (null until both times are known), pending / ready / failed, and refreshing.

    With ``estimate`` (a column, null where there is none) an estimate makes a row ready whatever its last job does, and
    refreshing while that is queued or running; without it a completed job is ready and nothing refreshes.
    """
    snake = lambda k: F.lower(F.regexp_replace(k, "([A-Z])", "_$1"))
    running, failed = F.coalesce(F.col(status).isin("queued", "running"), F.lit(False)), F.coalesce(F.col(status).isin("failed", "cancelled"), F.lit(False))
    there = F.col(estimate).isNotNull() if estimate else F.coalesce(F.col(status) == "completed", F.lit(False))
    ms = F.unix_millis(F.col(finished).cast("timestamp")) - F.unix_millis(F.col(started).cast("timestamp"))
    return jobs.withColumns({
        options: F.transform_keys(options, lambda k, _: snake(k)), "duration_ms": ms,
        "view_status": F.when(there, "ready").when(failed, "failed").otherwise("pending"), "refreshing": there & running,
    })
