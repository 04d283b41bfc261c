"""Splits that keep related records together.

Records that share a recording or a clip must not be parted between train,
validation and test.  Relatedness is a connected component of the graph of
recordings; components are found by hash-to-min and given to splits by weighted
rendezvous hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import blank, checkpoint, checkpoint_with, spread_join

#: ``{video_id}_{speaker}_{number}``
CLIP_ID = r"^(.+)_SPEAKER_\d+_\d+$"

#: Most splits.
MAX_SPLITS = 200
#: Salts of the hash that are compared, and rounds in which their weights are fitted.
SALTS, FIT_ROUNDS = 16, 6
#: Members of a component that are paired with all others in one task.
PAIR_ROWS = 2000


def recording_of_clip(clip: Column) -> Column:
    """The recording named inside a clip id, or null if it has another form."""
    inner = F.regexp_extract(clip, CLIP_ID, 1)
    return F.when(~blank(inner), inner)


def _links(rows: DataFrame, video: str, sample: str) -> DataFrame:
    """Distinct (sample, recording) pairs, from the recording column and from the clip id."""
    v, s = F.col(video), F.col(sample)
    return (
        rows.select(
            F.when(~blank(s), s).alias("__weft_s"),
            F.array_compact(F.array(F.when(~blank(v), v), recording_of_clip(s))).alias("__weft_vs"),
        )
        .where("__weft_s IS NOT NULL")
        .select("__weft_s", F.explode(F.array_distinct("__weft_vs")).alias("__weft_v"))
        .distinct()
    )


def recording_graph(rows: DataFrame, video: str = "video_id", sample: str = "sample_id") -> DataFrame:
    """Edges (a, b) between recordings that share a sample: each to the lowest of the sample's recordings.

    Samples of one recording carry no link and drop out before any join.
    """
    return _edges(*checkpoint_with(_links(rows, video, sample), n=F.count("*")))


def _edges(links: DataFrame, seen: dict) -> DataFrame:
    shared = links.groupBy("__weft_s").agg(F.min("__weft_v").alias("__weft_lo"), F.max("__weft_v").alias("__weft_hi"), F.count("*").alias("__weft_n")).where("__weft_lo < __weft_hi")
    return (
        spread_join(links, shared.drop("__weft_hi"), "__weft_s", "__weft_n", seen["n"])
        .where("__weft_v <> __weft_lo")
        .select(F.col("__weft_v").alias("a"), F.col("__weft_lo").alias("b"))
        .distinct()
    )


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) per node, component being its lowest node.

    Every node holds a cluster, at first itself and its neighbours.  In a round it
    sends its cluster to the cluster's minimum and the minimum to all of the
    cluster, until nothing changes.  A cluster is a set of rows, never one value;
    minima are combined before the shuffle; nodes with very large clusters are not
    shuffled (spread_join).  Null ends and loops are ignored; an empty table has no
    components.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    h = F.xxhash64("a", "b")
    state = {"n": F.count("*"), "x": F.bit_xor(h), "y": F.sum(F.shiftright(h, 30))}
    clusters, now = checkpoint_with(both.unionByName(both.select("a", F.col("a").alias("b"))).distinct(), **state)
    for _ in range(max_rounds):
        lowest = clusters.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        sent = spread_join(clusters, lowest, "a", "n", now["n"])
        before = now
        clusters, now = checkpoint_with(
            sent.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .distinct(),
            **state,
        )
        if now == before:
            return clusters.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def related_recordings(rows: DataFrame, video: str = "video_id", sample: str = "sample_id") -> DataFrame:
    """(node, component) of each recording that is related to another one."""
    return hash_to_min(recording_graph(rows, video, sample))


def related_members(rows: DataFrame, video: str = "video_id", sample: str = "sample_id") -> DataFrame:
    """(video_id, component, n_members): the recordings in ``video`` that are related to another of them, what they belong to, and how many belong to it.

    Recordings named only inside clip ids link others and may name the component, but are no members.
    """
    present = rows.select(F.col(video).alias("node")).where(~blank(F.col(video))).distinct()
    member = checkpoint(related_recordings(rows, video, sample).join(present, "node", "left_semi"))
    sizes = member.groupBy("component").agg(F.count("*").alias("n_members"), F.count("*").alias("__weft_n")).where("n_members > 1")
    return spread_join(member, sizes, "component", "__weft_n", F.lit(member.count())).select(F.col("node").alias("video_id"), "component", "n_members")


def related_pairs(rows: DataFrame, video: str = "video_id", sample: str = "sample_id") -> DataFrame:
    """All pairs (video_id_a, video_id_b) of recordings in ``video`` that must stay together, lower id first.

    The pairs themselves are the wanted result, so their number is that of the
    components' pairs.  The first sides of a large component are dealt out to parts,
    each of which meets all second sides, so that no task pairs a whole component.
    """
    parts = F.ceil(F.col("n_members") / PAIR_ROWS).cast("int")
    member = related_members(rows, video, sample).withColumn("__weft_parts", parts)
    a = member.select("component", F.pmod(F.xxhash64("video_id"), "__weft_parts").cast("int").alias("__weft_part"), F.col("video_id").alias("video_id_a"))
    b = member.select("component", F.explode(F.sequence(F.lit(0), F.col("__weft_parts") - 1)).alias("__weft_part"), F.col("video_id").alias("video_id_b"))
    return a.join(b, ["component", "__weft_part"]).where("video_id_a < video_id_b").select("video_id_a", "video_id_b")


def rendezvous(key: Column, weights: dict[str, float | Column], salt: Column | int = 0) -> Column:
    """The split of ``key`` by weighted rendezvous hashing: the least -ln(u)/w over splits, u in (0, 1) hashed from key, split and salt."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    scored = [
        F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(n), salt), 11) + F.lit(0.5)) / F.lit(float(1 << 53))) / (w if isinstance(w, Column) else F.lit(float(w)))).alias("x"), F.lit(n).alias("n"))
        for n, w in sorted(weights.items())
    ]
    return F.array_min(F.array(*scored))["n"]


def fit_weights(units: DataFrame, unit: str, size: str, shares: dict[str, int], salts: int = SALTS, rounds: int = FIT_ROUNDS) -> tuple[int, dict[str, float]]:
    """The salt and the weights at which rendezvous hashing of ``units`` comes nearest to the shares.

    Weights are at first the shares.  A large component fills much of its split, and
    the others would still take their part of it; so each round counts the rows that
    every salt gives to every split, and moves the salt's weights by what is wanted
    against what is there.  Units stay where they are: only salts x splits sums come
    to the driver.  A component above its split's share leaves a distance that
    nothing can close; the nearest is taken all the same.
    """
    weight = sum(shares.values())
    weights = [dict(shares) for _ in range(salts)]
    best, nearest = (0, {n: float(w) for n, w in shares.items()}), None
    salted = units.select(unit, size, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__weft_salt"))
    for _ in range(rounds):
        of_salt = {n: F.get(F.array(*(F.lit(float(w[n])) for w in weights)), F.col("__weft_salt")) for n in shares}
        got = salted.groupBy("__weft_salt", rendezvous(F.col(unit), of_salt, F.col("__weft_salt")).alias("__weft_to")).agg(F.sum(size)).collect()
        rows = [dict.fromkeys(shares, 0) for _ in range(salts)]
        for salt, name, n in got:
            rows[salt][name] = int(n)
        total = sum(rows[0].values())
        for salt, has in enumerate(rows):
            wanted = {n: total * w / weight for n, w in shares.items()}
            off = sum(abs(has[n] - wanted[n]) for n in shares)
            if nearest is None or off < nearest:
                nearest, best = off, (salt, {n: float(w) for n, w in weights[salt].items()})
            moved = {n: weights[salt][n] * (wanted[n] + 0.5) / (has[n] + 0.5) for n in shares}
            weights[salt] = {n: max(w / sum(moved.values()), 1e-6) for n, w in moved.items()}
        if not nearest:
            break
    return best


def assign_splits(
    rows: DataFrame, targets: DataFrame, video: str = "video_id", sample: str = "sample_id", split: str = "assigned_split", unit: str = "split_unit",
    fitted: tuple[int, dict[str, float]] | None = None,
) -> DataFrame:
    """``rows`` with the columns ``unit`` (what must stay together) and ``split``, near the shares in ``targets`` (split_name, permille).

    No two related rows get different splits.  Weighted rendezvous hashing gives
    every component its split, whatever its size: with a given salt and weights
    (``fitted``) the split of a component depends on nothing else, so new rows move
    no other component.  Where they aren't given they are fitted to the rows
    (fit_weights); keep them to keep splits stable.

    A row without recording belongs to its sample's component; a
    row without both is a unit of its own (equal rows together).  Repeated rows stay
    repeated, columns of ``rows`` are kept, columns named like the results are
    replaced.  Targets without a name or a positive share are ignored, more than
    MAX_SPLITS are an error; without any the split is null.  An empty table gives an
    empty table.
    """
    wanted = targets.where("split_name IS NOT NULL AND permille > 0").groupBy("split_name").agg(F.sum("permille")).limit(MAX_SPLITS + 1).collect()
    if len(wanted) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    shares = {name: int(w) for name, w in wanted}
    data = rows.drop(split, unit)
    v, s = F.col(video), F.col(sample)
    keyed = data.withColumn("__weft_v", F.coalesce(F.when(~blank(v), v), recording_of_clip(s)))

    links, seen = checkpoint_with(_links(data, video, sample), n=F.count("*"))
    by_sample = links.groupBy("__weft_s").agg(F.min("__weft_v").alias("__weft_lo"))
    orphan = keyed.where("__weft_v IS NULL").drop("__weft_v")
    everything = F.to_json(F.struct(*(F.col(f"`{c}`") for c in data.columns))) if data.columns else F.lit("")
    rescued = orphan.withColumn("__weft_s", s).join(by_sample, "__weft_s", "left").drop("__weft_s")
    rescued = rescued.withColumn("__weft_v", F.coalesce(F.col("__weft_lo"), F.when(~blank(s), F.concat(F.lit("\u0001sample "), s)), F.concat(F.lit("\u0001row "), F.sha2(everything, 256)))).drop("__weft_lo")
    keyed = keyed.where("__weft_v IS NOT NULL").unionByName(rescued)

    sizes = keyed.groupBy("__weft_v").agg(F.count("*").alias("__weft_n"))
    component = hash_to_min(_edges(links, seen)).withColumnRenamed("node", "__weft_v")
    units, seen = checkpoint_with(sizes.join(component, "__weft_v", "left").withColumn(unit, F.coalesce("component", "__weft_v")).drop("component"), total=F.sum("__weft_n"))
    if not shares:
        choice = F.lit(None).cast("string")
    else:
        whole = units.groupBy(unit).agg(F.sum("__weft_n").alias("__weft_u"))
        salt, weights = fitted or fit_weights(whole, unit, "__weft_u", shares)
        choice = rendezvous(F.col(unit), weights, salt)
    chosen = units.withColumn(split, choice)
    return spread_join(keyed, chosen, "__weft_v", "__weft_n", seen["total"] or 0).select(*(F.col(f"`{c}`") for c in data.columns), unit, split)
