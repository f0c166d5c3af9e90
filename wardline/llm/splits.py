"""Splits that keep related records together.

Method: a table of components, kept between batches in the shared folder, maps each entity (a value of a key column) to
a component. A batch that links entities of several components merges them, by hooking to the smallest neighbour and
pointer jumping. A component keeps the split it has; components without one fill the splits' deficits, stratum by stratum;
a merge, or a delivery, that brings together components of different splits is quarantined, and stays so: the store keeps
of each entity the split that was delivered first, and of its component the status and all splits it has stood in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.mixing import source_name
from wardline.llm.support import HOT_SHARE, cut, keyed_join, unit_interval

#: White space that may surround a split's name.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0    　"
#: node: an entity; split: the one its rows got first; splits: all its component has stood in; rows: seen so far.
STORE_SCHEMA = "node STRING, comp STRING, split STRING, status STRING, splits ARRAY<STRING>, rows BIGINT"
#: Splits that targets may name; more are an error.
MOST_SPLITS = 1000
#: Stands for all strata of less than HOT_SHARE of the rows where components are placed one by one.
SMALL_STRATA = "\u0001"


def split_name(split: Column) -> Column:
    """A split as delivered, without regard to letter case and outer white space; val means validation."""
    bare = F.trim(F.lower(split), F.lit(BLANKS))
    return F.when(bare.isin("val", "valid"), "validation").when(bare == "", None).otherwise(bare)


def _node(name: str) -> Column:
    return F.when(F.col(f"`{name}`").isNotNull(), F.concat(F.lit(f"{name}:"), F.col(f"`{name}`").cast("string")))


def _follow(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows with the node in column replaced by what names (node, to) has for it, if anything. A node of many rows, such
    as a hub of links, is not one task."""
    counts = rows.groupBy(F.col(column).alias("_from")).agg(F.count("*").alias("_n"))
    known = cut(names.select(F.col("node").alias("_from"), F.col("to").alias("_to")).join(counts, "_from"), "p1-names")
    joined = keyed_join(rows.withColumnRenamed(column, "_from"), known, ["_from"], "_n", rows.count(), "left")
    return joined.withColumn(column, F.coalesce("_to", "_from")).drop("_from", "_to", "_n")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(edges: DataFrame) -> DataFrame | None:
    """node, root (the smallest node it hangs together with) for the edges' nodes; None without edges."""
    edges = cut(_ordered(edges), "p1-edges")
    parents: DataFrame | None = None
    while edges.limit(1).count():
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        tops = edges.select(F.col("a").alias("node")).distinct().join(hooks, "node", "left_anti").withColumn("up", F.col("node"))
        forest = cut(hooks.unionByName(tops), "p1-forest")
        while True:  # pointer jumping: every step halves the depth
            jumped = cut(_follow(forest.withColumn("was", F.col("up")), "up", forest.select("node", F.col("up").alias("to"))), "p1-jump")
            forest = jumped.select("node", "up")
            if not jumped.where("up <> was").limit(1).count():
                break
        names = forest.select("node", F.col("up").alias("to"))
        parents = forest if parents is None else cut(_follow(parents, "up", names).select("node", "up"), "p1-parents")
        edges = cut(_ordered(_follow(_follow(edges, "a", names), "b", names)), "p1-edges")
    return None if parents is None else parents.select("node", F.col("up").alias("root"))


def components(rows: DataFrame, key_cols: list[str], store: DataFrame | None = None) -> DataFrame:
    """node, comp, old_comp, old_split, old_status, old_splits, old_rows: the batch's nodes and those of the store's
    components that the batch touches, with the component each belongs to now."""
    spark = rows.sparkSession
    keyed = rows.select(*[_node(k).alias(f"k{i}") for i, k in enumerate(key_cols)])
    seen = reduce(DataFrame.union, [keyed.select(F.col(f"k{i}").alias("node")).where("node is not null") for i in range(len(key_cols))]).distinct()
    old = (store if store is not None else spark.createDataFrame([], STORE_SCHEMA)).toDF("node", "old_comp", "old_split", "old_status", "old_splits", "old_rows")
    if store is None:
        nodes = cut(seen.join(old, "node", "left").withColumn("own", F.col("node")), "p1-nodes")
    else:
        touched = cut(old.join(seen, "node", "left_semi").select("old_comp").distinct(), "p1-touched")
        nodes = cut(seen.join(old.join(touched, "old_comp", "left_semi"), "node", "full").withColumn("own", F.coalesce("old_comp", "node")), "p1-nodes")
    whole = ["node", F.col("own").alias("comp"), "old_comp", "old_split", "old_status", "old_splits", "old_rows"]
    if len(key_cols) == 1:
        return nodes.select(*whole)
    present = F.filter(F.array(*[f"k{i}" for i in range(len(key_cols))]), lambda k: k.isNotNull())
    chained = keyed.select(present.alias("ks")).where(F.size("ks") > 1).distinct()
    links = cut(chained.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ks") - 1), lambda i: F.struct(F.col("ks")[i - 1].alias("a"), F.col("ks")[i].alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "p1-links")
    if store is not None:
        moved = nodes.where("own <> node").select("node", F.col("own").alias("to"))
        links = _follow(_follow(links, "a", moved), "b", moved)
    roots = _roots(links)
    if roots is None:
        return nodes.select(*whole)
    merged = _follow(nodes, "own", roots.withColumnRenamed("root", "to"))
    return merged.select(*whole)


def _none() -> Column:
    return F.array().cast("array<string>")


def _claims(keyed: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per node its rows, the splits they stand in, its component and history; per component its rows and all splits."""
    sizes = keyed.groupBy("node").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("given")).alias("own_splits"))
    nodes = cut(comps.join(sizes, "node", "left").withColumn("own_splits", F.coalesce("own_splits", _none())), "p1-sizes")
    history = F.array_union(F.coalesce("old_splits", _none()), F.when(F.col("old_split").isNotNull(), F.array("old_split")).otherwise(_none()))
    every = nodes.select("comp", F.coalesce("n", F.lit(0)).alias("n"), (F.col("old_status") == "quarantined").alias("bad"), F.array_union("own_splits", history).alias("each"))
    # Splits are few, so that a component of any size is counted before its rows move.
    named = every.where(F.size("each") > 0).select("comp", F.explode("each").alias("split")).distinct().groupBy("comp").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    per_comp = every.groupBy("comp").agg(F.sum("n").alias("size"), F.coalesce(F.max("bad"), F.lit(False)).alias("bad")).join(named, "comp", "left")
    per_comp = per_comp.select("comp", "size", F.coalesce("splits", _none()).alias("splits"), (F.col("bad") | (F.coalesce(F.size("splits"), F.lit(0)) > 1)).alias("bad"))
    return nodes, cut(per_comp, "p1-claims")


def _keyed(rows: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rows with a key, each counted under its first one."""
    return rows.withColumn("node", F.coalesce(*[_node(k) for k in key_cols])).where("node is not null")


def conflicts(rows: DataFrame, key_cols: list[str], split_col: str = "split", store: DataFrame | None = None) -> DataFrame:
    """Quarantined components: node, comp, splits, own_splits, for the nodes of components whose rows or history stand in
    several splits, or that were quarantined before. own_splits are those of the node's own rows in this batch, counted
    under their first key."""
    given = cut(rows.withColumn("given", split_name(F.col(f"`{split_col}`"))).select(*[F.col(f"`{k}`") for k in key_cols], "given"), "p1-given")
    comps = cut(components(given, key_cols, store), "p1-comps")
    nodes, per_comp = _claims(_keyed(given, key_cols), comps)
    bad = per_comp.where("bad").select("comp", "splits", F.lit(True).alias("bad"))
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("nodes"))
    counted = cut(bad.join(sizes, "comp"), "p1-bad")
    return keyed_join(nodes.select("node", "comp", "own_splits"), counted, ["comp"], "nodes", nodes.count()).select("node", "comp", "splits", "own_splits")


def _cases(wanted: list[tuple[str, Column]], u: Column) -> Column:
    """The split at point u of the splits' shares laid end to end."""
    so_far, out = F.lit(0.0), None
    for name, share in wanted:
        so_far = so_far + share
        out = F.when(u < so_far, name) if out is None else out.when(u < so_far, name)
    return out.otherwise(wanted[-1][0])


def _shares(targets: DataFrame) -> dict[str, float]:
    rows = targets.select(split_name(F.col("split")).alias("split"), "target_share").limit(MOST_SPLITS + 1).collect()
    if len(rows) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    shares: dict[str, float] = {}
    for r in rows:
        if r["split"]:
            shares[r["split"]] = shares.get(r["split"], 0.0) + float(r["target_share"] or 0)
    if not shares:
        raise ValueError("no splits to fill")
    whole = sum(shares.values())
    return {k: v / whole if whole else 1 / len(shares) for k, v in sorted(shares.items())}


def _large_placed(large: DataFrame, cells: DataFrame, lacking: DataFrame, names: list[str], total: int) -> list[tuple[str, str]]:
    """(component, split) of the components above HOT_SHARE of the rows, the largest first: each goes where its strata lack
    most. Both tables are small: at most 1 / HOT_SHARE components, and as many strata, the others being one."""
    small = F.when(F.col("all") > total * HOT_SHARE, F.col("stratum")).otherwise(SMALL_STRATA)
    strata = lacking.groupBy(small.alias("stratum")).agg(F.sum("all").alias("all"), *[F.sum(f"lack_{i}").alias(f"lack_{i}") for i in range(len(names))]).collect()
    lack = {r["stratum"]: [float(r[f"lack_{i}"]) for i in range(len(names))] for r in strata}
    whole = {r["stratum"]: r["all"] for r in strata}
    counts: dict[str, dict[str, int]] = {}
    for r in cells.join(F.broadcast(large.select("comp")), "comp").groupBy("comp", "stratum").agg(F.sum("n").alias("n")).collect():
        own = counts.setdefault(r["comp"], {})
        k = r["stratum"] if r["stratum"] in lack else SMALL_STRATA
        own[k] = own.get(k, 0) + r["n"]
    placed = []
    for comp, own in sorted(counts.items(), key=lambda c: (-sum(c[1].values()), c[0])):
        best = max(range(len(names)), key=lambda i: (sum(n * lack[k][i] / max(1, whole[k]) for k, n in own.items()), -i))
        for k, n in own.items():
            lack[k][best] -= n
        placed.append((comp, names[best]))
    return placed


def assign_splits(rows: DataFrame, key_cols: list[str], targets: DataFrame, id_col: str = "row_id", split_col: str = "split", strata: tuple[str, ...] = ("label", "source"), store_path: str | None = None, seed: int = 5, hold_out: bool = False) -> DataFrame:
    """One row per input row: row_id, split, status (kept, new or quarantined).

    Rows that share a value of a key column share a split, directly or over other rows. A component that stands in one
    split keeps it. New and quarantined components fill what the splits lack in their strata: those above HOT_SHARE of all
    rows one by one, largest first; the others by a hash of their name in proportion to what is lacking in the stratum
    of most of their rows. Rows without key are on their own: they keep their split, or fill what their stratum lacks.
    Null strata are strata. Delivered splits that the targets don't name count as none. Shares are relative to their sum.

    With store_path the components are read from there and those that the batch touches are written back; earlier
    batches count towards the shares. An entity keeps the split that its rows got first, also when its component is
    quarantined later: such rows have that split and the status quarantined, in this batch and all later ones, so that
    nothing is moved and all can be held out. With hold_out the split of quarantined rows is null.
    """
    spark = rows.sparkSession
    shares = _shares(targets)
    names = list(shares)
    store = read_store(spark, store_path) if store_path else None
    given = split_name(F.col(f"`{split_col}`"))
    stratum = F.concat_ws("|", *[F.coalesce(source_name(F.col(f"`{c}`").cast("string")), F.lit("-")) for c in strata]) if strata else F.lit("")
    own = cut(rows.select(F.col(f"`{id_col}`").alias("row_id"), *[F.col(f"`{k}`") for k in key_cols], stratum.alias("stratum"), F.when(given.isin(names), given).alias("given")), "p1-rows")
    total = own.count()
    if store is not None:
        before = {r["split"]: r["n"] for r in store.groupBy("split").agg(F.sum("rows").alias("n")).collect()}
        due = {s: max(0.0, shares[s] * (total + sum(before.values())) - before.get(s, 0)) for s in names}
        shares = {s: due[s] / sum(due.values()) for s in names} if sum(due.values()) else shares
    comps = cut(components(own, key_cols, store), "p1-comps")
    keyed = _keyed(own, key_cols)
    nodes, per_comp = _claims(keyed, comps)
    alone = own.where(F.coalesce(*[_node(k) for k in key_cols]).isNull())

    kept = per_comp.where((F.size("splits") == 1) & ~F.col("bad")).select("comp", F.col("splits")[0].alias("split"), F.lit("kept").alias("status"))
    free = per_comp.where((F.size("splits") != 1) | F.col("bad"))
    cells = cut(keyed.groupBy("node", "stratum").agg(F.count("*").alias("n")).join(nodes.select("node", "comp"), "node").groupBy("comp", "stratum").agg(F.sum("n").alias("n")), "p1-cells")
    in_kept = cells.join(kept, "comp").groupBy("stratum", F.col("split").alias("s")).agg(F.sum("n").alias("n"))
    in_alone = alone.where("given is not null").groupBy("stratum", F.col("given").alias("s")).agg(F.count("*").alias("n"))
    held = cut(in_kept.unionByName(in_alone), "p1-held")
    per_stratum = cut(own.groupBy("stratum").agg(F.count("*").alias("all")), "p1-strata")

    def lacking(have: DataFrame) -> DataFrame:
        counted = have.groupBy("stratum").agg(*[F.sum(F.when(F.col("s") == s, F.col("n")).otherwise(0)).alias(f"have_{i}") for i, s in enumerate(names)])
        joined = per_stratum.join(counted, "stratum", "left")
        return joined.select("stratum", "all", *[(F.col("all") * shares[s] - F.coalesce(f"have_{i}", F.lit(0))).alias(f"lack_{i}") for i, s in enumerate(names)])

    large = free.where(F.col("size") > max(10, int(total * HOT_SHARE)))
    fixed = cut(spark.createDataFrame(_large_placed(large, cells, lacking(held), names, total), "comp STRING, split STRING"), "p1-large")
    in_large = cells.join(F.broadcast(fixed), "comp").groupBy("stratum", F.col("split").alias("s")).agg(F.sum("n").alias("n"))
    left = [F.greatest(f"lack_{i}", F.lit(0.0)) for i in range(len(names))]
    summed = reduce(lambda a, b: a + b, left)
    odds = cut(lacking(held.unionByName(in_large)).select("stratum", "all", *[F.when(summed > 0, x / summed).otherwise(shares[s]).alias(f"odds_{i}") for i, (s, x) in enumerate(zip(names, left))]), "p1-odds")
    wanted = [(s, F.col(f"odds_{i}")) for i, s in enumerate(names)]
    main = cells.groupBy("comp").agg(F.max_by("stratum", F.struct("n", "stratum")).alias("stratum"))
    state = F.when(F.col("bad"), "quarantined").otherwise("new").alias("status")
    small = free.join(F.broadcast(fixed.select("comp")), "comp", "left_anti").join(main, "comp", "left").withColumn("stratum", F.coalesce("stratum", F.lit("")))
    small = keyed_join(small, odds, ["stratum"], "all", total, "left").select("comp", F.coalesce(_cases(wanted, unit_interval(F.lit(seed), F.col("comp"))), F.lit(names[0])).alias("split"), state)
    settled = cut(kept.unionByName(free.join(F.broadcast(fixed), "comp").select("comp", "split", state)).unionByName(small).join(per_comp.select("comp", "splits"), "comp"), "p1-settled")

    sizes = nodes.groupBy("comp").agg(F.count("*").alias("nodes"))
    known = cut(settled.join(sizes, "comp"), "p1-known")
    by_node = cut(keyed_join(nodes, known, ["comp"], "nodes", nodes.count()).withColumn("split", F.coalesce("old_split", "split")), "p1-by-node")
    if store_path:
        write_store(by_node.select("node", "comp", "split", F.when(F.col("status") == "quarantined", "quarantined").otherwise("kept").alias("status"), F.array_union("splits", F.array("split")).alias("splits"), (F.coalesce("old_rows", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("rows")), store_path)
    by_node = by_node.where("n is not null").select("node", "split", "status", F.col("n").alias("node_rows"))
    with_keys = keyed_join(keyed, by_node, ["node"], "node_rows", total).select("row_id", "split", "status")
    fresh = keyed_join(alone.where("given is null"), odds, ["stratum"], "all", total).select("row_id", _cases(wanted, unit_interval(F.lit(seed), F.col("row_id"))).alias("split"), F.lit("new").alias("status"))
    stay = alone.where("given is not null").select("row_id", F.col("given").alias("split"), F.lit("kept").alias("status"))
    out = with_keys.unionByName(stay).unionByName(fresh)
    return out.withColumn("split", F.when(F.col("status") != "quarantined", F.col("split"))) if hold_out else out


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The component table: of each node the row of the last complete version that has it. None without versions."""
    versions = _versions(spark, path)
    if not versions:
        return None
    parts = [spark.read.schema(STORE_SCHEMA).parquet(f"{path}/v{v}").withColumn("v", F.lit(v)) for v in versions]
    if len(parts) == 1:
        return parts[0].drop("v")
    names = [c.split(" ")[0] for c in STORE_SCHEMA.split(", ")]
    last = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.max_by(F.struct(*names[1:]), "v").alias("r"))
    return last.select("node", *[f"r.{n}" for n in names[1:]])


def write_store(table: DataFrame, path: str) -> None:
    """A new version with the nodes that changed; the earlier ones stay, so that a lost job leaves the last complete state."""
    versions = _versions(table.sparkSession, path)
    table.write.mode("overwrite").parquet(f"{path}/v{(versions[-1] if versions else 0) + 1}")


def compact_store(spark: SparkSession, path: str) -> None:
    """Writes the whole table as one more version and drops those before it."""
    versions = _versions(spark, path)
    if len(versions) > 1:
        write_store(read_store(spark, path), path)
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for v in versions:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}"), True)
