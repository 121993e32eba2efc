"""Deliberate, reproducible degradation of trajectory data.

Everything random comes from a seeded md5 over the row key, so a rerun after a lost executor gives the
same rows and any engine can repeat the choice. ``row_key`` must identify a row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrack.operators.clean import impute_constant, impute_mean
from seatrack.operators.ordered import Track, row_numbers
from seatrack.operators.resample import downsample_first, resample_linear
from seatrack.operators.selection import PREFIX, hash_cuts, hash_number, row_hash, single_row
from seatrack.operators.series import interpolate
from seatrack.sources.staging import stage


def share(percent: float) -> Column:
    """``int(n * (percent / 100))`` in double arithmetic."""
    return F.floor(F.col("n") * F.lit(float(percent) / 100.0))


def add_duplicates(df: DataFrame, row_key: Sequence[str], percent: float = 30, seed: int = 42) -> DataFrame:
    """Append ``int(n*p/100)`` rows drawn with replacement.

    Rows get an index in hash order (counted per hash bucket). The rows with the lowest indexes each
    make one draw: the hash of the draw number modulo n is the index of the row to repeat.
    """
    hashed = df.withColumn("_h", row_hash(seed, *row_key))
    indexed = row_numbers(hashed, [], [F.col("_h")], F.substring("_h", 1, PREFIX), "_i", total="n")
    draws = (
        indexed.where(F.col("_i") <= share(percent))
        .select((hash_number(row_hash(f"{seed}:draw", "_i")) % F.col("n") + 1).alias("_i"))
        .groupBy("_i").agg(F.count(F.lit(1)).alias("_times"))
    )
    repeats = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_times"), F.lit(0)))).alias("copy_no")
    return indexed.join(draws, "_i", "left").select(*df.columns, repeats)


def add_label_noise(
    df: DataFrame, percent: float, key: str = "trajectory_id", label: str = "label", seed: int = 42
) -> DataFrame:
    """Set the label to 0 on ``int(m*p/100)`` of the m trajectories that have a label 1."""
    ids = df.where(F.col(label) == 1).select(key).distinct().withColumn("_h", row_hash(seed, key))
    cut = single_row(hash_cuts(ids, [], "_h", {"cut": share(percent)}))
    noisy = row_hash(seed, key) <= F.col("_cut.cut")
    return df.withColumn("_cut", cut).withColumn(label, F.when(noisy, 0).otherwise(F.col(label))).drop("_cut")


def add_missing_values(
    df: DataFrame, row_key: Sequence[str], shares: Mapping[str, float], seed: int = 42, exact: bool = True
) -> DataFrame:
    """Blank out ``int(n*p/100)`` cells of each feature.

    Exact: the hash at the border is looked up from a histogram of hashes and applied in a projection,
    so the rows are not shuffled. Otherwise each cell is blanked with probability p by its own hash.
    """
    present = {c: p for c, p in shares.items() if c in df.columns}
    if not exact:
        return df.withColumns(
            {
                c: F.when(hash_number(row_hash(f"{seed}:{c}", *row_key)) % 10_000 >= F.lit(float(p) * 100), F.col(c))
                for c, p in present.items()
            }
        )
    d = missing_flags(df, row_key, present, seed)
    return d.withColumns({c: F.when(~F.col(f"_hit_{c}"), F.col(c)) for c in present}).drop(*[f"_hit_{c}" for c in present])


def missing_flags(df: DataFrame, row_key: Sequence[str], shares: Mapping[str, float], seed: int = 42) -> DataFrame:
    """Adds ``_hit_{feature}`` for exactly ``int(n*p/100)`` rows per feature."""
    hashes = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), row_hash(f"{seed}:{c}", *row_key).alias("_h")) for c in shares])
        ).alias("_e")
    ).select("_e.*")
    factor = F.element_at(
        F.create_map(*[x for c, p in shares.items() for x in (F.lit(c), F.lit(float(p) / 100.0))]), F.col("feature")
    )
    cuts = hash_cuts(hashes, ["feature"], "_h", {"cut": F.floor(F.col("n") * factor)}, few=True)
    row = cuts.agg(*[F.max(F.when(F.col("feature") == c, F.col("cut"))).alias(c) for c in shares])
    d = df.withColumn("_cut", single_row(row))
    hit = {f"_hit_{c}": F.coalesce(row_hash(f"{seed}:{c}", *row_key) <= F.col(f"_cut.{c}"), F.lit(False)) for c in shares}
    return d.withColumns(hit).drop("_cut")


def key_percent(seed: int, key: str, low: float, high: float) -> Column:
    """Uniform percentage between ``low`` and ``high`` fixed by the key."""
    unit = (hash_number(row_hash(f"{seed}:share", key)) % 1_000_000) / F.lit(1_000_000.0)
    return F.lit(float(low)) + (F.lit(float(high)) - F.lit(float(low))) * unit


def drop_irregularly(
    df: DataFrame, row_key: Sequence[str], key: str = "trajectory_id", low: float = 1, high: float = 10, seed: int = 42
) -> DataFrame:
    """Drop ``int(n * share)`` rows of each trajectory, the share drawn per trajectory."""
    hashes = df.select(key, row_hash(seed, *row_key).alias("_h"))
    wanted = F.floor(F.col("n") * (key_percent(seed, key, low, high) / 100.0))
    cuts = hash_cuts(hashes, [key], "_h", {"_cut": wanted})
    d = df.join(cuts, key, "left")
    return d.where(F.col("_cut").isNull() | (row_hash(seed, *row_key) > F.col("_cut"))).drop("_cut")


def corruption_variants(levels: Sequence[float]) -> list[tuple[str, tuple[str, ...], float | None]]:
    """Name, steps and noise level of every non-empty combination of the four degradations."""
    kinds = ("missing", "dupes", "labelnoise", "irregular")
    out = []
    for size in range(1, len(kinds) + 1):
        for combo in combinations(kinds, size):
            for level in levels if "labelnoise" in combo else [None]:
                name = "_".join(f"{c}_{level}" if c == "labelnoise" else c for c in combo)
                out.append((name, combo, level))
    return out


def apply_corruption(
    df: DataFrame, steps: Sequence[str], level: float | None, row_key: Sequence[str], shares: Mapping[str, float],
    duplicate_percent: float = 30, key: str = "trajectory_id", label: str = "label", seed: int = 42,
) -> DataFrame:
    d, row_key = df, list(row_key)
    for step in steps:
        if step == "missing":
            d = add_missing_values(d, row_key, shares, seed)
        elif step == "dupes":
            d = add_duplicates(d, row_key, duplicate_percent, seed)
            row_key = [*row_key, "copy_no"]
        elif step == "labelnoise":
            d = add_label_noise(d, level, key, label, seed)
        elif step == "irregular":
            d = drop_irregularly(d, row_key, key, seed=seed)
        else:
            raise ValueError(step)
    return d.drop("copy_no")


def corruption_marks(
    df: DataFrame, levels: Sequence[float], row_key: Sequence[str], shares: Mapping[str, float],
    duplicate_percent: float = 30, key: str = "trajectory_id", label: str = "label", seed: int = 42,
) -> DataFrame:
    """The rows once, with what every variant of :func:`all_corrupted_versions` makes of them.

    ``blank_{c}``: the cells with missing values; ``weight``, ``weight_irregular``, ``weight_dupes``, ``weight_dupes_irregular``: how often
    a row is there without and with irregular sampling and duplicates; ``label_{i}``: the label under the i-th level of noise. So a
    model is fitted on a variant by choosing cells, label and weight, and no variant is written.
    """
    present, row_key = [c for c in shares if c in df.columns], list(row_key)
    ids = df.where(F.col(label) == 1).select(key).distinct().withColumn("_h", row_hash(seed, key))
    noise = single_row(hash_cuts(ids, [], "_h", {f"l{i}": share(p) for i, p in enumerate(levels)}))
    d = missing_flags(df, row_key, {c: shares[c] for c in present}, seed)
    d = d.withColumns({f"blank_{c}": F.when(~F.col(f"_hit_{c}"), F.col(c)) for c in present}).drop(*[f"_hit_{c}" for c in present])
    d = d.withColumns({"_noise": noise, "_id": row_hash(seed, key)})
    d = d.withColumns({f"label_{i}": F.when(F.coalesce(F.col("_id") <= F.col(f"_noise.l{i}"), F.lit(False)), 0).otherwise(F.col(label)) for i in range(len(levels))})
    copies = add_duplicates(df.select(*row_key, key), row_key, duplicate_percent, seed)
    for rows, keys, name in ((df.select(*row_key, key), row_key, ""), (copies, [*row_key, "copy_no"], "_dupes")):
        kept = drop_irregularly(rows, keys, key, seed=seed).groupBy(*row_key).agg(F.count(F.lit(1)).alias(f"weight{name}_irregular"))
        d = d.join(kept, row_key, "left").na.fill(0, [f"weight{name}_irregular"])
    times = copies.groupBy(*row_key).agg(F.count(F.lit(1)).alias("weight_dupes"))
    return d.join(times, row_key, "left").withColumn("weight", F.lit(1).cast("bigint")).drop("_noise", "_id")


def variant_columns(steps: Sequence[str], level: float | None, levels: Sequence[float], label: str = "label") -> tuple[str, str]:
    """Weight and label column of :func:`corruption_marks` for a variant."""
    weight = "_".join(["weight", *[s for s in ("dupes", "irregular") if s in steps]])
    return weight, label if level is None else f"label_{list(levels).index(level)}"


def variant_counts(marks: DataFrame, levels: Sequence[float], label: str = "label") -> DataFrame:
    """Rows and rows with label 1 of every variant, from one pass over the marks; ``clean`` is the data as it was."""
    variants = [("clean", (), None), *corruption_variants(levels)]
    sums, entries = {}, []
    for name, steps, level in variants:
        w, y = variant_columns(steps, level, levels, label)
        sums[f"_n_{w}"] = F.sum(w)
        sums[f"_p_{w}_{y}"] = F.coalesce(F.sum(F.when(F.col(y) == 1, F.col(w))), F.lit(0))
        entries.append(F.struct(F.lit(name).alias("corruption"), F.col(f"_n_{w}").alias("rows"), F.col(f"_p_{w}_{y}").alias("positive_rows")))
    row = marks.agg(*[e.alias(n) for n, e in sums.items()])
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def all_corrupted_versions(
    df: DataFrame, levels: Sequence[float], row_key: Sequence[str], shares: Mapping[str, float],
    duplicate_percent: float = 30, key: str = "trajectory_id", label: str = "label", seed: int = 42,
) -> DataFrame:
    """Every combination of degradations, told apart by ``variant``.

    Equals :func:`apply_corruption` per variant. Which cells, rows and trajectories are hit depends only
    on hashes (for irregular sampling also on whether rows were duplicated before), so each choice is
    made once and marked on the rows, and the variants are projections of the marked rows.
    """
    present = [c for c in shares if c in df.columns]
    ids = df.where(F.col(label) == 1).select(key).distinct().withColumn("_h", row_hash(seed, key))
    noise = single_row(hash_cuts(ids, [], "_h", {f"l{i}": share(p) for i, p in enumerate(levels)}))
    blanks = missing_flags(df, row_key, {c: shares[c] for c in present}, seed)
    marked = blanks.withColumns({f"_blank_{c}": F.when(~F.col(f"_hit_{c}"), F.col(c)) for c in present})
    marked = marked.drop(*[f"_hit_{c}" for c in present])
    variants = corruption_variants(levels)
    out = None
    for dupes in (False, True):
        d, keys = marked, list(row_key)
        if dupes:
            d, keys = add_duplicates(marked, row_key, duplicate_percent, seed), [*row_key, "copy_no"]
        hashes = d.select(key, row_hash(seed, *keys).alias("_h"))
        wanted = F.floor(F.col("n") * (key_percent(seed, key, 1, 10) / 100.0))
        d = d.join(hash_cuts(hashes, [key], "_h", {"_cut": wanted}), key, "left")
        d = d.withColumns({"_gone": F.coalesce(row_hash(seed, *keys) <= F.col("_cut"), F.lit(False)), "_noise": noise,
                           "_id": row_hash(seed, key)})
        chosen = [
            F.struct(
                F.lit(name).alias("name"), F.lit("missing" in steps).alias("missing"),
                F.lit("irregular" in steps).alias("irregular"),
                F.lit(-1 if level is None else levels.index(level)).alias("level"),
            )
            for name, steps, level in variants
            if ("dupes" in steps) == dupes
        ]
        d = d.withColumn("_v", F.explode(F.array(*chosen))).where(~(F.col("_v.irregular") & F.col("_gone")))
        flipped = F.lit(False)
        for i in range(len(levels)):
            flipped = flipped | ((F.col("_v.level") == i) & F.coalesce(F.col("_id") <= F.col(f"_noise.l{i}"), F.lit(False)))
        values = {c: F.when(F.col("_v.missing"), F.col(f"_blank_{c}")).otherwise(F.col(c)) for c in present}
        values[label] = F.when(flipped, 0).otherwise(F.col(label))
        one = d.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns], F.col("_v.name").alias("variant"))
        out = one if out is None else out.unionByName(one)
    return out


def degrade(
    df: DataFrame, track: Track, row_key: Sequence[str], shares: Mapping[str, float], columns: Sequence[str],
    label: str = "label", irregular: bool = False, downsample_s: int | None = None, resample_s: int | None = None,
    missing: bool = False, impute: str | None = None, duplicates: bool = False, seed: int = 42,
) -> DataFrame:
    """Configured chain: irregular sampling, down- or resampling, missing values with imputation, duplicates.

    Every step reads its input more than once, so the result of each step but the last is staged.
    """
    key = track.key[0]
    later = [bool(downsample_s or resample_s), missing, duplicates]
    d = df
    if irregular:
        d = drop_irregularly(d, row_key, key, seed=seed)
        d = stage(d, "irregular") if any(later) else d
    if downsample_s:
        d = downsample_first(d, track, [*columns, label], downsample_s)
    if resample_s:
        d = resample_linear(d, track, columns, resample_s, label)
    if downsample_s or resample_s:
        row_key = [*track.key, track.order]
        track = track.without_tie()
        d = stage(d, "sampled") if any(later[1:]) else d
    if missing:
        d = add_missing_values(d, row_key, shares, seed)
        d = stage(d, "holes") if duplicates or impute in ("mean", "linear") else d
        blanked = [c for c in shares if c in d.columns]
        if impute == "zero":
            d = impute_constant(d, blanked)
        elif impute == "mean":
            d = impute_mean(d, blanked)
        elif impute == "linear":
            d = interpolate(d, track, blanked, by="row", ends="both")
        d = stage(d, "imputed") if duplicates and impute in ("mean", "linear") else d
    if duplicates:
        d = add_duplicates(d, row_key, seed=seed).drop("copy_no")
    return d
