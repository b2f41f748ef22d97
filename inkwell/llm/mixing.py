"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.runtime import cut

#: hash buckets per source for the fractional draw; the prefix sums run over buckets, not over rows
BUCKETS = 4096
MOST_TARGETS = 100_000


def source_name(c: Column) -> Column:
    """Sources are compared without case and surrounding blanks; null stays null."""
    return F.lower(F.trim(c))


def water_fill(targets: list[tuple[str, float, float | None]], sizes: dict[str, int], budget: float | None = None) -> dict[str, dict]:
    """Tokens to draw from each source of one mix.

    ``targets``: (source, weight, most repeats or None). Sources are clamped at ``size * repeats`` and what
    they can't take is shared out again in proportion to the weights of the rest, until nothing exceeds its
    cap. ``budget`` is the wanted total, by default the size of the named sources. Sources without tokens,
    weights that are null, negative or not finite, and caps of zero or less take nothing.
    """
    weight = {s: w if w is not None and 0 < w < float("inf") else 0.0 for s, w, _ in targets}
    cap = {s: sizes.get(s, 0) * (float("inf") if r is None else max(0, r)) if sizes.get(s, 0) else 0.0 for s, _, r in targets}
    total = float(sum(sizes.get(s, 0) for s in weight) if budget is None else budget)
    out = {s: 0.0 for s in weight}
    open_ = {s for s in weight if weight[s] > 0 and cap[s] > 0}
    left = total
    while open_ and left > 0:
        mass = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / mass >= cap[s]}
        if not over:
            for s in open_:
                out[s] = left * weight[s] / mass
            break
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
        open_ -= over
    all_weight = sum(weight.values())
    return {
        s: {"target_share": weight[s] / all_weight if all_weight else 0.0, "tokens": out[s], "epochs": out[s] / sizes[s] if sizes.get(s) else 0.0, "capped": bool(cap[s] and out[s] >= cap[s])}
        for s in weight
    }


def exact_total(targets: list[tuple[str, float, float | None]], sizes: dict[str, int]) -> float:
    """The largest total at which every source that has tokens reaches its share within its cap."""
    usable = [(s, w, sizes[s] * (float("inf") if r is None else max(0, r))) for s, w, r in targets if w is not None and 0 < w < float("inf") and sizes.get(s) and (r is None or r > 0)]
    mass = sum(w for _, w, _ in usable)
    most = min((cap * mass / w for _, w, cap in usable), default=0.0)
    return most if most < float("inf") else float(sum(sizes[s] for s, _, _ in usable))


def plan_mixes(sized: DataFrame, targets: DataFrame, budget: float | str | None = None) -> DataFrame:
    """One row per mix and named source: its share, size, cap and epochs. ``sized``: (source, n_tokens).

    ``budget``: the wanted total of each mix in tokens; None for the size of its sources (shares then give
    way where caps bind), ``"exact"`` for the largest total at which all wanted shares hold.

    The target table is configuration and is bounded (an error beyond ``MOST_TARGETS`` rows); only per-source
    sums for sources it names reach the driver. Repeated rows of one mix and source add their weights and
    keep the larger cap (null: none).
    """
    spark = sized.sparkSession
    named = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_weight", "max_repeats").where("source is not null")
    rows = (
        named.groupBy("mix_name", "source")
        .agg(F.sum("target_weight").alias("w"), F.when(F.max(F.col("max_repeats").isNull()), None).otherwise(F.max("max_repeats")).alias("r"))
        .limit(MOST_TARGETS + 1)
        .collect()
    )
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"over {MOST_TARGETS} targets")
    sums = sized.join(F.broadcast(named.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    sizes = {r.source: int(r.n or 0) for r in sums.collect()}
    mixes: dict[str, list] = {}
    for r in rows:
        mixes.setdefault(r.mix_name, []).append((r.source, r.w, r.r))
    plan = []
    for mix in sorted(mixes, key=lambda m: (m is None, m or "")):
        ordered = sorted(mixes[mix], key=lambda t: t[0])
        filled = water_fill(ordered, sizes, exact_total(ordered, sizes) if budget == "exact" else budget)
        caps = {s: c for s, _, c in mixes[mix]}
        for s, p in filled.items():
            plan.append((mix, s, float(p["target_share"]), caps[s], sizes.get(s, 0), float(p["tokens"]), float(p["epochs"]), p["capped"]))
    return spark.createDataFrame(
        plan, "mix_name string, source string, target_share double, max_repeats int, available_tokens bigint, planned_tokens double, epochs double, capped boolean"
    )


def draw(sized: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, repeats): every planned document and how often it is repeated.

    A source's documents are all taken ``floor(epochs)`` times; for the fraction they are ordered by a seeded
    hash and taken while the tokens before them are under the fraction of the source's size. The order is cut
    into hash buckets, so the running sums go over at most ``BUCKETS`` rows per mix and source, and over rows
    only inside the one bucket where the fraction ends. ``plan`` must be small (see ``plan_mixes``).
    """
    wanted = plan.where("epochs > 0").select("mix_name", "source", "epochs", "available_tokens")
    order = F.xxhash64("doc_id", F.coalesce("mix_name", F.lit("")), F.lit(seed))
    rows = (
        sized.where("n_tokens > 0")
        .join(F.broadcast(wanted), "source")
        .withColumn("whole", F.floor("epochs").cast("int"))
        .withColumn("part", (F.col("epochs") - F.floor("epochs")) * F.col("available_tokens"))
        .withColumn("h", order)
        .withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)).cast("int"))
    )
    at_bucket = rows.groupBy("mix_name", "source", "bucket").agg(F.sum("n_tokens").alias("t"), F.first("part").alias("part"))
    w = Window.partitionBy("mix_name", "source").orderBy("bucket")
    ends = (
        at_bucket.withColumn("before", F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where("before < part")
        # the last bucket that begins under the fraction holds its end
        .groupBy("mix_name", "source")
        .agg(F.max_by("bucket", "bucket").alias("end_bucket"), F.max_by("before", "bucket").alias("before"))
    )
    ends = ends.withColumnsRenamed({"mix_name": "end_mix", "source": "end_source"})
    placed = rows.join(F.broadcast(ends), (F.col("source") == F.col("end_source")) & F.col("mix_name").eqNullSafe(F.col("end_mix")), "left").drop("end_mix", "end_source")
    inner = Window.partitionBy("mix_name", "source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sure = placed.where("end_bucket is null or bucket <> end_bucket").withColumn("extra", F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False)))
    edge = placed.where("bucket = end_bucket").withColumn("extra", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)) < F.col("part"))
    return (
        sure.unionByName(edge)
        .select("mix_name", "source", "doc_id", "n_tokens", (F.col("whole") + F.col("extra").cast("int")).alias("repeats"))
        .where("repeats > 0")
    )


def reached_shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Wanted and reached share per mix and source, also for sources that gave nothing."""
    got = drawn.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats")
    )
    joined = plan.alias("p").join(got.alias("g"), (F.col("p.source") == F.col("g.source")) & F.col("p.mix_name").eqNullSafe(F.col("g.mix_name")), "left")
    rows = joined.select(
        "p.mix_name", "p.source", "target_share", "max_repeats", "available_tokens", "capped", "epochs",
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    total = F.sum("drawn_tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("reached_share", F.when(total > 0, F.col("drawn_tokens") / total).otherwise(F.lit(0.0)))


def sized_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), written out once; tokens of a public tokenizer."""
    from inkwell.llm.tokens import token_counts

    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").alias("__t"))
    return cut(token_counts(named, ["doc_id", "source"], "__t", path))
