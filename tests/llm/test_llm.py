"""The training-data operators: against SQL, against brute force, and on awkward input."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from wardline.llm import capping, conversations, format_dups, leakage, lookalikes, mixing, overlap, packing, reading, splits, support
from wardline.llm.oracle import LLM_ORACLE_SQL
from wardline.llm.queries import llm_queries

QUERIES = llm_queries()
LONG = "word " * 30_000


@pytest.mark.parametrize("name", sorted(LLM_ORACLE_SQL))
def test_equals_sql(name, spark, small):
    same(QUERIES[name], LLM_ORACLE_SQL[name], spark, small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(LLM_ORACLE_SQL)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() >= 0


# 1 splits


def targets(spark):
    return spark.createDataFrame([("train", 0.75), ("validation", 0.08), ("test", 0.17)], "split string, target_share double")


def test_splits_keep_groups_together(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(40)]), rng.choice([None, None, "train", " TRAIN", "val", "test", "odd"]), rng.choice([0, 1, None]), rng.choice(["a", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, template_id long, split string, label int, source string").withColumn("node", F.lit("clash")).withColumn("status", F.lit("clash"))
    out = {r["row_id"]: (r["split"], r["status"]) for r in splits.assign_splits(df, ["template_id"], targets(spark)).collect()}
    assert len(out) == 2000 and all(s in ("train", "validation", "test") for s, _ in out.values())
    by = defaultdict(set)
    for i, t, *_ in rows:
        if t is not None:
            by[t].add(out[i][0])
    assert all(len(s) == 1 for s in by.values())
    name = {"train": "train", " TRAIN": "train", "val": "validation", "test": "test"}
    for i, t, s, *_ in rows:
        if t is None and s in name:
            assert out[i] == (name[s], "kept")


def test_components_merge_over_several_keys(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 400), rng.choice([None, *range(300)]), None) for i in range(500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b, _ in rows:
        find(("a", a))
        if b is not None:
            parent[find(("a", a))] = find(("b", b))
    df = spark.createDataFrame(rows, "row_id long, a long, b long, split string")
    got = {r["node"]: r["comp"] for r in splits.components(df, ["a", "b"]).collect()}
    assert set(got) == {f"{k}:{v}" for k, v in parent}
    assert Counter(Counter(got.values()).values()) == Counter(Counter(find(x) for x in parent).values())


def test_long_chain_of_links(spark):
    df = spark.createDataFrame([(i, i, i + 1, None) for i in range(200)], "row_id long, a long, b long, split string").withColumn("c", F.col("b"))
    chain = df.selectExpr("row_id", "concat('n', a) AS a", "concat('n', b) AS b", "split")
    both = chain.select("row_id", F.col("a").alias("k"), "split").unionByName(chain.select("row_id", F.col("b").alias("k"), "split"))
    assert both.count() == 400
    linked = splits._roots(chain.select("a", "b"))
    assert linked.select("root").distinct().count() == 1 and linked.count() == 201


def test_store_keeps_splits_and_quarantines_merges(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "x", None, "train"), (2, "y", None, "test"), (3, "z", None, None)], "row_id long, a string, b string, split string")
    a = {r["row_id"]: r["split"] for r in splits.assign_splits(first, ["a", "b"], targets(spark), strata=(), store_path=path).collect()}
    second = spark.createDataFrame([(4, "x", None, None), (5, "z", None, None), (6, "x", "q", None), (7, "y", "q", None)], "row_id long, a string, b string, split string")
    assert {r["row_id"]: r["split"] for r in splits.assign_splits(second.where("row_id < 6"), ["a", "b"], targets(spark), strata=(), store_path=path).collect()} == {4: "train", 5: a[3]}
    bad = splits.conflicts(second, ["a", "b"], store=splits.read_store(spark, path))
    assert {r["node"] for r in bad.collect()} == {"a:x", "a:y", "b:q"}


def test_quarantine_is_remembered(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "row_id long, a string, b string, split string"
    run = lambda rows, **more: {r["row_id"]: (r["split"], r["status"]) for r in splits.assign_splits(spark.createDataFrame(rows, schema), ["a", "b"], targets(spark), strata=(), store_path=path, **more).collect()}
    assert run([(1, "x", None, "train"), (2, "y", None, "test")]) == {1: ("train", "kept"), 2: ("test", "kept")}
    linked = run([(3, "x", "q", None), (4, "y", "q", None)])
    assert linked == {3: ("train", "quarantined"), 4: ("test", "quarantined")}
    assert run([(5, "y", None, None), (6, "z", None, None)])[5] == ("test", "quarantined")
    assert run([(7, None, "q", None), (8, "w", "q", None)], hold_out=True) == {7: (None, "quarantined"), 8: (None, "quarantined")}
    kept = {r["node"]: (r["split"], r["status"], sorted(r["splits"])) for r in splits.read_store(spark, path).collect()}
    assert kept["a:x"] == ("train", "quarantined", ["test", "train"]) and kept["a:y"] == ("test", "quarantined", ["test", "train"])
    assert kept["a:w"][1] == "quarantined" and kept["a:z"][1] == "kept"
    nodes = {r["node"] for r in splits.conflicts(spark.createDataFrame([(9, "y", None, None)], schema), ["a", "b"], store=splits.read_store(spark, path)).collect()}
    assert nodes == {"a:x", "a:y", "a:w", "b:q"}
    splits.compact_store(spark, path)
    assert {r["node"]: (r["split"], r["status"], sorted(r["splits"])) for r in splits.read_store(spark, path).collect()} == kept


def test_only_touched_components_are_written(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "row_id long, a string, split string"
    splits.assign_splits(spark.createDataFrame([(i, f"k{i}", None) for i in range(50)], schema), ["a"], targets(spark), strata=(), store_path=path).count()
    splits.assign_splits(spark.createDataFrame([(90, "k3", None), (91, "new", None)], schema), ["a"], targets(spark), strata=(), store_path=path).count()
    assert {r["node"] for r in spark.read.parquet(f"{path}/v2").collect()} == {"a:k3", "a:new"}
    assert splits.read_store(spark, path).agg(F.sum("rows")).first()[0] == 52


def test_shares_and_mix_of_splits(spark):
    rng = random.Random(7)
    rows = []
    for i in range(20_000):
        source, label = rng.choice(["a", "a", "b", "c"]), rng.randint(0, 1)
        group = rng.randint(0, 400) if rng.random() < 0.5 else None
        rows.append((i, f"{source}{label}{group}" if group is not None else None, "big" if source == "c" and rng.random() < 0.3 else None, label, source, rng.choice([None] * 9 + ["train"]) if group is None else None))
    df = spark.createDataFrame(rows, "row_id long, author string, site string, label int, source string, split string")
    out = {r["row_id"]: r["split"] for r in splits.assign_splits(df, ["author", "site"], targets(spark)).collect()}
    want = {"train": 0.75, "validation": 0.08, "test": 0.17}
    for s, share in want.items():
        assert abs(sum(x == s for x in out.values()) / len(rows) - share) < 0.02
    # The component of "big" hangs together with half of source c; the other strata have the mix.
    for source, label in itertools.product("ab", (0, 1)):
        own = [out[r[0]] for r in rows if r[4] == source and r[3] == label]
        for s, share in want.items():
            assert abs(sum(x == s for x in own) / len(own) - share) < 0.03
    by = defaultdict(set)
    for i, a, b, *_ in rows:
        for k in (a, b):
            if k:
                by[k].add(out[i])
    assert all(len(s) == 1 for s in by.values())


def test_hub_of_links(spark, monkeypatch):
    edges = spark.range(20_000).selectExpr("'hub' AS a", "concat('n', id) AS b").unionByName(spark.range(500).selectExpr("concat('m', id) AS a", "concat('m', id + 1) AS b"))
    roots = splits._roots(edges)
    assert sorted((r["root"], r["count"]) for r in roots.groupBy("root").count().collect()) == [("hub", 20_001), ("m0", 501)]


def test_too_many_targets(spark):
    rows = spark.createDataFrame([(1, None, None, None, None)], "row_id long, template_id long, split string, label int, source string")
    with pytest.raises(ValueError):
        splits.assign_splits(rows, ["template_id"], spark.range(1001).selectExpr("concat('s', id) AS split", "0.1D AS target_share"))


def test_splits_of_nothing(spark):
    empty = spark.createDataFrame([], "row_id long, template_id long, split string, label int, source string")
    assert splits.assign_splits(empty, ["template_id"], targets(spark)).count() == 0
    assert splits.conflicts(empty, ["template_id"]).count() == 0


# 2 conversations


def test_conversations(spark, tmp_path):
    u, v, w, x = ("00000000-0000-0000-0000-00000000000" + c for c in "1234")
    rows = [
        ("m2", u.upper(), "2025-01-01 10:00", "second", "r2", "2025-01-01 10:01"),
        ("m1", "{" + u + "}", "2025-01-01 10:00", "tie", "r1", "2025-01-01 10:01"),
        ("m3", u.replace("-", ""), "2025-01-03 09:00", "later day", "r3", "2025-01-09 09:00"),
        ("m4", v, "2025-01-01 10:00", "stale", None, "2025-01-01 10:01"),
        ("m4", v, "2025-01-01 10:00", "fresh", "ok", "2025-01-01 10:02"),
        ("m5", w, "2025-01-01 10:00", "zero width", "​﻿ \t", "2025-01-01 10:01"),
        ("m6", x, "2025-01-01 10:00", "no such session", "r", "2025-01-01 10:01"),
        ("m7", None, "2025-01-01 10:00", "nowhere", "r", "2025-01-01 10:01"),
        ("m8", u, "2025-01-01 11:00", LONG, "long", None),
    ]
    m = spark.createDataFrame(rows, "id string, session_id string, c string, text string, reply string, i string").selectExpr("id", "session_id", "timestamp(c) created_at", "text", "null verdict", "1.0D confidence", "null attack_family", "null family_scores", "null model_version", "reply", "timestamp(i) ingested_at")
    m.selectExpr("id", "session_id", "created_at", "text", "cast(verdict as string) verdict", "confidence", "cast(attack_family as string) attack_family", "cast(family_scores as string) family_scores", "cast(model_version as string) model_version", "reply", "ingested_at").repartition(3).write.parquet(str(tmp_path / "messages"))
    known = spark.createDataFrame([(u,), (v.upper(),), (w,), ("ffffffff-0000-0000-0000-000000000000",), (None,)], "id string")
    dropped = {r["session_id"]: r["state"] for r in conversations.dropped_sessions(spark, str(tmp_path / "messages"), known).collect()}
    assert dropped == {w: "broken", x: "unknown", "ffffffff-0000-0000-0000-000000000000": "empty"}
    turns = sorted((r["session_id"], r["turn"], r["role"], r["text"]) for r in conversations.conversations(spark, str(tmp_path / "messages"), known).collect())
    assert turns == [(u, 1, "user", "tie"), (u, 2, "assistant", "r1"), (u, 3, "user", "second"), (u, 4, "assistant", "r2"), (u, 5, "user", LONG), (u, 6, "assistant", "long"), (u, 7, "user", "later day"), (u, 8, "assistant", "r3"), (v, 1, "user", "fresh"), (v, 2, "assistant", "ok")]


def message_rows(spark, rows):
    """Rows (id, session, created, text, reply, ingested) as the table has them."""
    m = spark.createDataFrame(rows, "id string, session_id string, c string, text string, reply string, i string")
    return m.selectExpr("id", "session_id", "timestamp(c) created_at", "text", "cast(null AS string) verdict", "1.0D confidence", "cast(null AS string) attack_family", "cast(null AS string) family_scores", "cast(null AS string) model_version", "reply", "timestamp(i) ingested_at")


def test_late_and_odd_messages(spark, tmp_path):
    rows = [(f"f{i}", f"filler{i}", f"2025-02-{i + 1:02d} 10:00", "t", "r", f"2025-02-{i + 1:02d} 10:00") for i in range(25)]
    rows += [
        ("a1", "late", "2025-02-01 10:00", "one", "r", "2025-02-01 10:00"), ("a2", "late", "2025-02-01 10:05", "two", "r", "2025-02-24 10:00"),  # after its session closed
        ("b1", "resumed", "2025-02-01 10:00", "one", "r", "2025-02-01 10:00"), ("b2", "resumed", "2025-02-20 10:00", "two", "r", "2025-02-20 10:00"),
        ("c1", "bad late", "2025-02-01 10:00", "one", "r", "2025-02-01 10:00"), ("c2", "bad late", "2025-02-01 10:05", "two", None, "2025-02-24 10:00"),
        ("d1", "from the future", "2031-01-01 10:00", "one", "r", "2025-02-02 10:00"),
        ("e1", "timeless", None, "first", "r", None), ("e2", "timeless", "2025-02-05 10:00", "second", "r", None), ("e3", "timeless", None, "third", "r", "2025-02-06 10:00"),
        (None, "nameless", "2025-02-05 10:00", "x", "r", None), (None, "nameless", "2025-02-05 10:00", "y", "r", None), (None, "nameless", "2025-02-05 10:00", "y", "r", None),
        ("g1", "moved from", "2025-02-03 10:00", "old", None, "2025-02-03 10:00"), ("g1", "moved to", "2025-02-03 10:00", "new", "r", "2025-02-04 10:00"), ("g2", "moved from", "2025-02-03 11:00", "stays", "r", "2025-02-03 11:00"),
    ]
    message_rows(spark, rows).repartition(3).write.parquet(str(tmp_path / "messages"))
    known = spark.createDataFrame([(s,) for s in {r[1] for r in rows}], "id string")
    turns = defaultdict(list)
    for r in conversations.conversations(spark, str(tmp_path / "messages"), known).where("role = 'user'").orderBy("turn").collect():
        turns[r["session_id"]].append(r["text"])
    assert {s: t for s, t in turns.items() if not s.startswith("filler")} == {"late": ["one", "two"], "resumed": ["one", "two"], "from the future": ["one"], "timeless": ["first", "second", "third"], "nameless": sorted(turns["nameless"]), "moved to": ["new"], "moved from": ["stays"]}
    assert sorted(turns["nameless"]) == ["x", "y"] and len(turns) == 25 + 7
    assert {(r["session_id"], r["state"]) for r in conversations.dropped_sessions(spark, str(tmp_path / "messages"), known).collect()} == {("bad late", "broken")}


def test_hot_sessions_are_units_by_the_hour(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "HOT_ROWS", 50)
    rows = [(f"h{i:03d}", "hot", f"2025-03-{1 + i // 96:02d} {i // 4 % 24:02d}:{i % 4 * 15:02d}", f"t{i}", "r", f"2025-03-{1 + i // 96:02d} {i // 4 % 24:02d}:{i % 4 * 15:02d}") for i in range(300)]
    rows += [(f"k{i}", f"cold{i % 9}", "2025-03-02 10:00", "t", "r", "2025-03-02 10:00") for i in range(30)]
    message_rows(spark, rows).write.parquet(str(tmp_path / "messages"))
    known = spark.createDataFrame([(s,) for s in {r[1] for r in rows}], "id string")
    got = conversations.conversations(spark, str(tmp_path / "messages"), known).where("role = 'user' and session_id = 'hot'").orderBy("turn").collect()
    assert [(r["turn"], r["text"]) for r in got] == [(2 * i + 1, f"t{i}") for i in range(300)]


def test_numbering_of_hot_keys(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id % 7 AS a", "id AS b")
    want = {r["b"]: r["n"] for r in rows.selectExpr("b", "row_number() over (partition by k order by a, b) AS n").collect()}
    monkeypatch.setattr(conversations, "HOT_ROWS", 500)
    got = {r["b"]: r["n"] for r in conversations.numbered(rows, "k", ["a", "b"], 5000).collect()}
    assert got == want


# 3 mixing


def test_mix_reaches_its_shares(spark):
    rows = spark.range(1000).selectExpr("id AS row_id", "if(id % 10 < 7, ' Big-Source', 'small\t') AS source", "1 AS label", "if(id % 4 = 0, null, if(id % 4 = 1, double('NaN'), id / 1000.0D)) AS quality", "id AS cell", "id AS bin")
    want = spark.createDataFrame([("big_source", 1, 0.5, 1), ("small", 1, 0.4, 2), ("small", 0, 0.1, 3), ("gone", None, None, None)], "source string, label int, target_share double, max_repeats int")
    plan = {(r["source"], r["label"]): r for r in mixing.plan_mix(rows, want).collect()}
    assert plan["big_source", 1]["reached_share"] == pytest.approx(0.5) and not plan["big_source", 1]["short"]
    assert (plan["small", 1]["epochs"], plan["small", 1]["short"]) == (1, False)
    assert plan["small", 0]["short"] and plan["small", 0]["reached_share"] == 0.0
    drawn = mixing.draw_mix(rows, want).collect()
    assert sum(r["uses"] for r in drawn if r["source"] == "big_source") == 500
    assert sum(r["uses"] for r in drawn if r["source"] == "small") == 400
    assert {r["uses"] for r in drawn if r["source"] == "small"} == {1, 2}
    assert len({(r["row_id"], r["source"]) for r in drawn}) == len(drawn)
    assert sorted(mixing.draw_mix(rows, want).collect()) == sorted(drawn)


def test_mix_prefers_quality(spark):
    rows = spark.range(20_000).selectExpr("id AS row_id", "'s' AS source", "1 AS label", "if(id % 2 = 0, 0.9D, 0.1D) AS quality")
    want = spark.createDataFrame([("s", 1, 0.2, 1)], "source string, label int, target_share double, max_repeats int")
    drawn = [r["row_id"] for r in mixing.draw_mix(rows, want).collect()]
    assert len(drawn) == 4000 and sum(i % 2 == 0 for i in drawn) > 0.8 * len(drawn)


def test_mix_report_counts_what_is_drawn(spark):
    rows = spark.range(1000).selectExpr("id AS row_id", "if(id < 900, 'big', 'small') AS source", "1 AS label", "0.5D AS quality")
    want = spark.createDataFrame([("big", 1, 0.6004, 1), ("small", 1, 0.4, 2), ("none", 1, 0.0, 1), ("gone", 0, 0.1, 1)], "source string, label int, target_share double, max_repeats int")
    plan, drawn = mixing.draw(rows, want)
    uses = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum("uses").alias("n")).collect()}
    report = {r["source"]: (r["reached_share"], r["short"]) for r in mixing.mix_report(plan, drawn).collect()}
    assert report == {"big": (uses["big"] / 1000, False), "small": (0.2, True), "none": (0.0, False), "gone": (0.0, True)} and uses["small"] == 200


def test_mix_by_size_and_of_nothing(spark):
    want = spark.createDataFrame([("s", 1, 0.25, 1)], "source string, label int, target_share double, max_repeats int")
    rows = spark.range(400).selectExpr("id AS row_id", "'s' AS source", "1 AS label", "0.5D AS quality", "if(id = 0, null, id % 9) AS size")
    sizes = {r["row_id"]: r["size"] or 0 for r in rows.collect()}
    drawn = mixing.draw_mix(rows, want, size_col="size").collect()
    whole = sum(sizes.values())
    assert 0.25 * whole - 9 <= sum(sizes[r["row_id"]] for r in drawn) <= 0.25 * whole + 1
    assert mixing.draw_mix(rows.limit(0), want).count() == 0
    assert [r["short"] for r in mixing.plan_mix(rows.limit(0), want).collect()] == [False]


# 4 format duplicates


def test_format_duplicates(spark):
    rows = [
        (1, '{"task": "Do it, now", "tone": "kind"}', 1), (2, "tone: KIND; task: do it now", 1), (3, "Task: Do it now\nTone: kind\n", 1),
        (4, "tone: kind; task: do it", 1), (5, "Hello,  World!", 0), (6, "hello world", 0), (7, "hello world", 1), (8, "hello world", 0),
        (9, None, 0), (10, "", 0), (11, "?!", 0), (12, "?!", 0), (13, "hello world", None), (14, "hello world", -1), (15, LONG, 0), (16, LONG.upper(), 0),
        (17, "héllo", 0), (18, "hello", 0), (None, "hello", 0), (19, "tone kind; task do it now", 1),
    ]
    df = spark.createDataFrame(rows, "row_id long, text string, label int").withColumns({"codes": F.lit(1), "uid": F.lit(1), "copies": F.lit(9)})
    out = {r["row_id"]: (r["first_row_id"], r["copies"]) for r in format_dups.record_members(df).collect()}
    assert out[1] == out[2] == out[3] == (1, 3) and out[4] == (4, 1)
    assert out[5] == out[6] == out[8] == (5, 3) and out[7] == (7, 1)
    assert out[15] == out[16] == (15, 2) and out[17] == (17, 1) and out[18] == out[None] == (18, 2)
    assert all(out[i] == (i, 1) for i in (9, 10, 11, 12, 13, 14))
    assert format_dups.record_members(df.limit(0)).count() == 0


# 5 look-alikes


@pytest.mark.parametrize("text, other", [("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"), ("café", "café"), ("a​b­c﻿", "abc"), ("ﬁne oﬃce", "fine office"), ("x y   z", "x y z")])
def test_fold(text, other):
    assert lookalikes.fold(text) == lookalikes.fold(other) == other.replace("é", "é")


@pytest.mark.parametrize("a, b", [("Word", "word"), ("end.", "end"), ("l33t", "leet"), ("cafe", "café"), ("x²", "x2"), ("a\nb", "a b")])
def test_fold_keeps_what_looks_different(a, b):
    assert lookalikes.fold(a) != lookalikes.fold(b)


def test_same_look_pairs(spark):
    left = [("1", "the secret рass code"), ("2", "the secret pass code"), ("3", "Привет, мир"), ("4", None), ("5", "​"), ("6", "ｔｈｅ secret pass code"), ("7", "the secret pass code"), ("8", "соре"), ("9", "THE secret pass code")]
    right = [("a", "the secret pass code"), ("b", "thе secret pаss code"), ("c", "Пpивет, мир"), ("d", " "), ("e", "the secret pass cоdе"), ("e", "the secret pass cоdе")]
    pairs = lookalikes.same_look_pairs(spark.createDataFrame(left, "id string, text string"), spark.createDataFrame(right, "id string, text string"))
    got = {(r["left_id"], r["right_id"]) for r in pairs.collect()}
    assert got == {("1", "a"), ("1", "b"), ("1", "e"), ("2", "b"), ("2", "e"), ("3", "c"), ("6", "a"), ("6", "b"), ("6", "e"), ("7", "b"), ("7", "e")}


def test_repair_needs_the_corpus(spark):
    texts = spark.createDataFrame([("t", "1", "an unseеn word"), ("t", "2", "plain text"), ("t", "3", None), ("t", "4", LONG)], "tab string, id string, text string")
    out = {r["id"]: r["form"] for r in lookalikes.consistent(texts).collect()}
    assert out["1"] == "an unseеn word" and out["2"] == "plain text" and out["3"] is None and out["4"] == LONG.strip()
    more = texts.unionByName(spark.createDataFrame([("t", "5", "the unseen hand")], "tab string, id string, text string"))
    assert {r["id"]: r["form"] for r in lookalikes.consistent(more).collect()}["1"] == "an unseen word"
    assert lookalikes.consistent(texts.limit(0)).count() == 0


def test_repair_in_whatever_case_and_script(spark):
    texts = [("t", "1", "Рassword first"), ("t", "2", "the password"), ("t", "3", "ɡrid and ցrid"), ("t", "4", "grid"), ("t", "5", "𝐩𝐚𝐬𝐬𝐰𝐨𝐫𝐝"), ("t", "6", "ᏢASSWORD"), ("t", "7", "lone misspеlling"), ("t", "8", "lone misspelⅼing")]
    out = {r["id"]: r["form"] for r in lookalikes.consistent(spark.createDataFrame(texts, "tab string, id string, text string")).collect()}
    assert out["1"] == "Password first" and out["3"].startswith("grid and") and out["5"] == "password" and out["6"] == "PASSWORD" and out["7"] == "lone misspеlling"


def test_agreeing_spellings_are_a_choice(spark):
    texts = spark.createDataFrame([("t", "1", "the unsееn one"), ("t", "2", "the unѕeen one")], "tab string, id string, text string")
    forms = lambda **more: {r["form"] for r in lookalikes.consistent(texts, **more).collect()}
    assert forms() == {"the unseen one"} and len(forms(agreeing_spellings=False)) == 2


# 6 overlap


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_words():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (rng.choices("abcde", k=rng.randint(1, 30)) for _ in range(2))
        assert overlap.common_words(len(a), overlap.bit_masks(a), b) == lcs(a, b)


def test_overlap_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.choice([3, 8, 12, 30, 60, 400])) for _ in range(60)]
    rows = []
    for i in range(400):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(t) // 7))):
            j = rng.randrange(len(t))
            t[j : j + 1] = rng.choice([[], [rng.choice(words)], [t[j], rng.choice(words)]]) or [t[j]]
        rows.append((i, " ".join(t), rng.choice(["train", "TRAIN ", "val", "test", None, "?"]), rng.choice(["a", None])))
    rows += [(900, None, "train", "a"), (901, "?!", "test", "a"), (902, "", "test", "a")]
    df = spark.createDataFrame(rows, "row_id long, text string, split string, source string").withColumn("n", F.lit(1)).withColumn("shard", F.lit(1))
    monkeypatch.setattr(overlap, "SHARD_RECORDS", 40)
    members, pairs = overlap.overlaps(df)
    got = {(r["train_id"], r["eval_id"]) for r in overlap.row_pairs(members, pairs).collect()}
    side = lambda s: {"train": "t", "TRAIN ": "t", "val": "e", "test": "e"}.get(s)
    t, e = ([(i, x.split()) for i, x, s, _ in rows if side(s) == k and x and re.search(r"\w", x)] for k in "te")
    want = {(i, j) for (i, a), (j, b) in itertools.product(t, e) if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and lcs(a, b) >= 0.8 * max(len(a), len(b)) - 1e-9}
    assert got == want and len(want) > 200
    report = overlap.overlap_report(members, pairs).collect()
    assert sum(r["eval_rows"] for r in report) == len(e) and sum(r["exact_rows"] + r["near_rows"] for r in report) == len({j for _, j in got})


def brute_force(rows):
    """Pairs of (row_id, words, split) rows, t against e, by the definition."""
    t, e = ([(i, x) for i, x, s in rows if (s == "train") == k] for k in (True, False))
    return {(i, j) for (i, a), (j, b) in itertools.product(t, e) if lcs(a, b) >= 0.8 * max(len(a), len(b)) - 1e-9}


def overlap_pairs(spark, rows):
    df = spark.createDataFrame([(i, " ".join(x), s, "a") for i, x, s in rows], "row_id long, text string, split string, source string")
    return {(r["train_id"], r["eval_id"]) for r in overlap.row_pairs(*overlap.overlaps(df)).collect()}


def test_overlap_where_one_template_dominates(spark):
    rng = random.Random(12)
    template, rows = [f"w{i}" for i in range(50)], []
    for i in range(120):
        t = list(template)
        for j in rng.sample(range(50), rng.randint(3, 9)):
            t[j] = f"own{i}x{j}"
        rows.append((i, t, "train" if i % 2 else "test"))
    want = brute_force(rows)
    assert overlap_pairs(spark, rows) == want and 300 < len(want) < 3600


def test_overlap_where_one_template_dominates_and_its_rare_passages_change(spark):
    template = [f"w{i}" for i in range(50)]
    rows = [(i, template[:10] + [f"own{i}"] + template[11:25] + [f"own{i}b"] + template[26:40] + [f"own{i}c"] + template[41:], "test") for i in range(20)]
    rows.append((100, [w if w.startswith("w") else f"{w}x" for w in rows[0][1]], "train"))
    assert overlap_pairs(spark, rows) == brute_force(rows) == {(100, i) for i in range(20)}


def test_overlap_of_evenly_spread_changes(spark):
    long, short = [f"w{i}" for i in range(25)], [f"s{i}" for i in range(10)]
    spread = [f"new{i}" if i % 5 == 0 else w for i, w in enumerate(long)]
    apart = [*short[:2], *short[3:5], "x", short[5], "y", short[6], *short[8:]]
    rows = [(1, long, "test"), (2, spread, "train"), (3, short, "test"), (4, apart, "train")]
    assert overlap_pairs(spark, rows) == brute_force(rows) == {(2, 1), (4, 3)}


def test_overlap_of_evenly_spread_changes_at_many_lengths(spark):
    rows, i = [], 0
    for m in (5, 20, 25, 30, 40, 60, 100):
        own = [f"m{m}w{j}" for j in range(m)]
        changed = [f"c{m}x{j}" if j % 5 == 2 else w for j, w in enumerate(own)]
        added = [x for j, w in enumerate(own) for x in ((w, f"a{m}x{j}") if j % 4 == 1 else (w,))]
        apart = [x for j, w in enumerate(own) for x in ((w, f"p{m}x{j}") if j % 10 == 7 else () if j % 10 == 2 else (w,))]
        for t in (changed, added, apart):
            rows += [(i, own, "test"), (i + 1, t, "train")]
            i += 2
    want = brute_force(rows)
    assert overlap_pairs(spark, rows) == want and len({a for a, _ in want}) >= 20


def test_overlap_where_openings_are_shared(spark):
    rng = random.Random(31)
    opening, rows = [f"o{i}" for i in range(20)], []
    for i in range(160):
        body = rng.choices([f"b{j}" for j in range(25)], k=15)
        rows.append((i, opening + body, "train" if i % 2 else "val"))
    for i in range(40):
        t = list(rows[rng.randrange(0, 160, 2)][1])
        for j in rng.sample(range(35), 7):
            t[j] = f"n{i}x{j}"
        rows.append((200 + i, t, "train"))
    want = brute_force([(i, x, "train" if s == "train" else "test") for i, x, s in rows])
    assert overlap_pairs(spark, rows) == want and len(want) >= 40


def test_a_piece_stands_in_every_text_that_is_like_a_record():
    rng = random.Random(17)
    for m in (2, 4, 5, 9, 25, 40, 101, 230):
        record = [f"w{i}" for i in range(m)]
        index = overlap.Index([(0, 0, " ".join(record))])
        spans = [(int(p), int(p + d)) for p, d in zip(index.at, index.apart)]
        assert len(spans) == overlap.pieces(m) and len({i for p, q in spans for i in range(p, q + 1)}) == sum(q - p + 1 for p, q in spans)
        for _ in range(40):
            # As many words lost and added as may be, preferably where they spoil pieces.
            lost = {rng.choice(range(p, q + 1)) for p, q in rng.sample(spans, min(len(spans), m - overlap.required(m)))}
            text = [w for i, w in enumerate(record) if i not in lost]
            while len(text) < m:
                j = rng.randrange(len(text))
                text[j:j] = [f"x{len(text)}y{k}" for k in range(min(m - len(text), overlap.GAP + 1))]
            found = list(overlap.Scanner(index).matches(overlap.Block([(1, 1, " ".join(text))]), 0, 1))
            assert [(t, r) for t, r, _, _ in found] == [(0, 0)] and found[0][3] == (m - len(lost)) / m


def test_overlap_looks_at_few_records_where_templates_are_shared(monkeypatch):
    rng = random.Random(23)
    fixed = [[f"t{k}f{i}" for i in range(16)] for k in range(8)]
    sentence = lambda k: [f"s{rng.randrange(40)}k{k}" if i % 2 else w for i, w in enumerate(fixed[k])]
    draw = lambda: " ".join(w for k in rng.choices(range(8), k=3) for w in sentence(k))
    records, texts = [draw() for _ in range(4000)], [draw() for _ in range(300)]
    seen, entries = [], overlap.Scanner._near
    monkeypatch.setattr(overlap.Scanner, "_near", lambda *a: seen.append(int(a[-1].sum())) or entries(*a))
    list(overlap.Scanner(overlap.Index([(i, i, w) for i, w in enumerate(records)])).matches(overlap.Block([(i, i, w) for i, w in enumerate(texts)]), 0, len(texts)))
    assert sum(seen) < 0.12 * len(records) * len(texts)  # lists of neighbouring words had 0.26 of all pairs


def test_overlap_of_texts_of_one_word_again_and_again(spark, monkeypatch):
    monkeypatch.setattr(overlap, "STRETCH_PAIRS", 50)
    rows = [(i, ["ha"] * m, "train" if i % 2 else "test") for i, m in enumerate((3, 4, 5, 6, 10, 12, 60, 70, 250, 300, 301, 2))]
    assert overlap_pairs(spark, rows) == brute_force(rows)


def test_overlap_coverage(spark):
    text = [f"w{i}" for i in range(40)]
    rows = [(1, text, "test", "a"), (2, text, "train", "a"), (3, text[:20] + ["x"] + text[21:34], "train", "a"), (4, text[2:], "val", "b"), (5, ["solo"], "val", "b"), (6, ["Solo!"], "train", "b")]
    df = spark.createDataFrame([(i, " ".join(x), s, c) for i, x, s, c in rows], "row_id long, text string, split string, source string")
    members, pairs = overlap.overlaps(df)
    by = {r["similarity"]: sum(bin(b).count("1") for b in r["covered"]) for r in pairs.where("words = 40").collect()}
    assert by == {33 / 40: 33}
    assert {(r["exact"], r["coverage"]) for r in overlap.record_coverage(pairs).collect()} == {(True, 1.0), (False, 1.0)}
    report = {r["split"]: (r["eval_rows"], r["exact_rows"], r["near_rows"], r["coverage"]) for r in overlap.overlap_report(members, pairs).collect()}
    assert report == {"test": (1, 1, 0, 1.0), "validation": (2, 1, 1, 1.0)}


def test_overlap_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(support, "PIECE_ROWS", 7)
    rows = [(i, ["one", "text", "twice", "over"], "train" if i % 3 else "test") for i in range(90)] + [(500 + i, [f"own{i}", "words"], "train") for i in range(30)]
    assert overlap_pairs(spark, rows) == {(i, j) for i in range(90) if i % 3 for j in range(0, 90, 3)}


def test_overlap_of_nothing(spark):
    empty = spark.createDataFrame([], "row_id long, text string, split string, source string")
    members, pairs = overlap.overlaps(empty)
    assert overlap.row_pairs(members, pairs).count() == 0
    only_train = spark.createDataFrame([(1, "a b c", "train", "s")], "row_id long, text string, split string, source string")
    assert overlap.row_pairs(*overlap.overlaps(only_train)).count() == 0


# 7 capping


@pytest.mark.parametrize("rank_rows", [200_000, 3])
def test_caps(spark, monkeypatch, rank_rows):
    rng = random.Random(6)
    inf, nan = float("inf"), float("nan")
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, nan, inf, -inf, 0.5, 0.5, rng.random()])) for i in range(600)]
    rows += [(1000 + i, 9, 0.7) for i in range(100)] + [(2000 + i, 8, None) for i in range(50)]
    monkeypatch.setattr(capping, "RANK_ROWS", rank_rows)
    df = spark.createDataFrame(rows, "row_id long, t long, q double").withColumns({"key": F.lit(0), "bin": F.lit(0), "need": F.lit(0)})
    got = {r["row_id"] for r in capping.cap_contributors(df, "t", "q", max_rows=5).where("keep").collect()}
    want = set()
    for k in {r[1] for r in rows} - {None}:
        own = [(i, q) for i, t, q in rows if t == k]
        own.sort(key=lambda r: (r[1] is None or r[1] != r[1], -(r[1] or 0) if r[1] == r[1] else 0, r[0]))
        want |= {i for i, _ in own[:5]}
    assert got == want


def test_scores_come_out_as_given(spark):
    rows = [(1, 1, float("inf")), (2, 1, float("-inf")), (3, 1, None), (4, 1, 2.0), (5, 1, float("nan"))]
    out = {r["row_id"]: (str(r["score"]), r["keep"]) for r in capping.cap_contributors(spark.createDataFrame(rows, "row_id long, t long, q double"), "t", "q", max_rows=2).collect()}
    assert out == {1: ("inf", True), 2: ("-inf", False), 3: ("None", False), 4: ("2.0", True), 5: ("nan", False)}


def test_cap_by_share_and_of_nothing(spark):
    df = spark.range(1000).selectExpr("id AS row_id", "if(id < 900, 1, id) AS t", "id / 7.0D AS q")
    kept = capping.cap_contributors(df, "t", "q", max_share=0.1).where("keep")
    assert kept.where("key = 1").count() == 100 and kept.where("key <> 1").count() == 100
    assert {r["row_id"] for r in kept.where("key = 1").collect()} == set(range(800, 900))
    assert capping.cap_contributors(df.limit(0), "t", "q", max_rows=5).count() == 0
    with pytest.raises(ValueError):
        capping.cap_contributors(df, "t", "q")


# 8 packing


def test_fill_uses_every_item_once_and_little_space():
    rng = random.Random(8)
    counts = Counter(rng.randint(1, 100) for _ in range(800))
    bins = packing.fill(counts, 100)
    used = Counter()
    for own, n in bins:
        assert sum(k * c for k, c in own.items()) <= 100
        for k, c in own.items():
            used[k] += c * n
    assert used == counts
    first_fit = []
    for x in sorted(counts.elements(), reverse=True):
        at = next((i for i, filled in enumerate(first_fit) if filled + x <= 100), None)
        if at is None:
            first_fit.append(x)
        else:
            first_fit[at] += x
    assert sum(n for _, n in bins) <= len(first_fit) + 1


def test_fill_is_as_close_as_possible():
    assert packing.fill({6: 1, 5: 2, 4: 1, 3: 3}, 10) == [({6: 1, 4: 1}, 1), ({5: 2}, 1), ({3: 3}, 1)]


def test_packing(spark):
    sizes = spark.createDataFrame([(1, 0), (2, None), (3, 5), (4, 10), (5, 25), (6, 5), (6, 5)], "item_id long, tokens long").withColumn("window", F.lit(3))
    kinds = spark.createDataFrame([("s", 10), ("bad", 0), ("none", None)], "container string, capacity_tokens int")
    rows = packing.pack(sizes, kinds).collect()
    bins = defaultdict(int)
    for r in rows:
        assert (r["bin_id"] is None) == (r["tokens"] == 0) and r["container"] == "s"
        bins[r["bin_id"]] += r["tokens"]
    assert sorted((r["item_id"], r["piece"], r["tokens"]) for r in rows) == [(1, 0, 0), (2, 0, 0), (3, 0, 5), (4, 0, 10), (5, 0, 10), (5, 1, 10), (5, 2, 5), (6, 0, 5), (6, 0, 5)]
    assert all(n <= 10 for n in bins.values()) and len(bins) == 6 and {b for b in bins if b is not None and b < 0}
    assert packing.pack(sizes.limit(0), kinds).count() == 0


def test_many_kinds_of_containers(spark):
    sizes = spark.range(300).selectExpr("id AS item_id", "id % 40 + 1 AS tokens")
    kinds = spark.range(200).selectExpr("concat('k', id) AS container", "id + 40 AS capacity_tokens")
    packed = packing.pack(sizes, kinds)
    assert packed.groupBy("container").agg(F.count_distinct("item_id").alias("n")).where("n = 300").count() == 200
    assert packed.groupBy("container", "capacity", "bin_id").agg(F.sum("tokens").alias("t")).where("t > capacity").count() == 0
    with pytest.raises(ValueError):
        packing.pack(sizes, spark.range(1001).selectExpr("concat('k', id) AS container", "id + 40 AS capacity_tokens"))


def test_full_pieces_stay_out_of_the_windows(spark):
    rows = packing.pack(spark.createDataFrame([(1, 1_000_003), (2, 4)], "item_id long, tokens long"), spark.createDataFrame([("s", 10)], "container string, capacity_tokens int"))
    assert rows.count() == 100_002 and rows.where("bin_id < 0").count() == 100_000
    assert rows.select("bin_id").distinct().count() == 100_001 and rows.agg(F.sum("tokens")).first()[0] == 1_000_007


def test_tokens_of_pieces_add_up(monkeypatch):
    text = "Some words, and 12 numbers:\n\nnew  lines; it's don't   " * 40
    monkeypatch.setattr(packing, "PIECE_CHARS", 50)
    assert "".join(packing._pieces(text)) == text and len(list(packing._pieces(text))) > 10
    words = packing.re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+")
    assert [w for p in packing._pieces(text) for w in words.findall(p)] == words.findall(text)


def test_tokens(spark):
    texts = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, LONG)], "item_id long, text string")
    got = {r["item_id"]: r["tokens"] for r in packing.count_tokens(texts).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 30_000


# 9 leakage

ITEM = "Decide it. Beside the old harbour a tea merchant sold nine yellow kites to sailors while another quarry would verify nothing before closing time on Sunday"
DOCS = [
    (1, "Prose. beside the OLD harbour, a tea merchant sold nine yellow kites to sailors! End", True),
    (2, "beside\nthe old\n\nharbour a tea merchant sold nine green kites to sailors while another", True),
    (3, "Decide it. Beside the old harbour a tea", False),
    (4, "harbour the old beside merchant tea a sold kites yellow nine sailors to another while quarry", False),
    (5, "bеside thе old harbоur a tea merchant sоld nine yellоw kites to sailors", True),
    (6, None, False), (7, "", False), (8, LONG + "beside the old harbour a tea merchant sold nine yellow kites to sailors", True),
    (9, "decide it decide it decide it decide it decide it decide it decide it", False),
]


def test_leaks(spark):
    docs = spark.createDataFrame([d[:2] for d in DOCS], "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("shard", F.lit(0))
    items = spark.createDataFrame([(10, ITEM), (11, "Decide it. Another item, which shares no more than its first words with the one before, and it stands nowhere"), (12, None), (13, "short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()}
    assert got == {(d, 10) for d, _, leaked in DOCS if leaked}
    assert leakage.leaks(docs, items.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0


def test_leaks_over_several_shards(spark, monkeypatch):
    docs = spark.createDataFrame([d[:2] for d in DOCS], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM if i == 7 else f"item {i} " + " ".join(f"word{i}x{j}" for j in range(30))) for i in range(20)], "item_id long, text string")
    monkeypatch.setattr(leakage, "SHARD_ITEMS", 3)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()} == {(d, 7) for d, _, leaked in DOCS if leaked}


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(12)
    words = [f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(6000)]
    items = [words[i * 30 : i * 30 + 30] for i in range(200)]
    index = leakage.Index(items)
    for _ in range(200):
        query = {w for i in rng.sample(range(200), 2) for w in rng.sample(items[i], 12)}
        scores = defaultdict(float)
        for w in query:
            for i, x in zip(index.ids.get(w, ()), index.impacts.get(w, ())):
                scores[i] += x
        assert sorted(index.search(query)) == sorted(i for i, s in scores.items() if s >= 1)


def test_wand_finds_runs_that_meet_the_threshold_exactly():
    rng = random.Random(3)
    items = [rng.sample([f"w{i}" for i in range(400)], 30) for _ in range(200)]
    index, missed = leakage.Index(items), []
    for i, ws in enumerate(items):
        impact = {w: index.impacts[w][index.ids[w].index(i)] for w in ws}
        runs = [sorted(ws[s : s + leakage.RUN], key=impact.get)[: -leakage.CHANGED] for s in range(len(ws) - leakage.RUN + 1)]
        weakest = min(runs, key=lambda r: sum(map(impact.get, r)))
        missed += [i for _ in range(10) if i not in index.search(dict.fromkeys(rng.sample(weakest, len(weakest))))]
    assert not missed


# 10 reading level


def test_reading_levels(spark):
    rng = random.Random(11)
    pools = {1: "cat dog sun red hat run sit", 5: "notwithstanding epistemological heterogeneous operationalisation institutional dissemination corroborate"}
    text = lambda level: ". ".join(" ".join(rng.choices(pools[level].split(), k=8)) for _ in range(6)) + "."
    docs = [(i, text(1 if i % 2 else 5), "en", "guide") for i in range(60)]
    docs += [(100, None, "en", "guide"), (101, " \n", None, None), (102, text(5), "de", None), (103, text(5), "en", "log"), (104, "cat dog.", "en", None)]
    docs += [(200 + i, "der hund und die katze sind im haus und das haus ist rot. " * 5, "de-DE", "guide") for i in range(20)] + [(300, "die katze und der hund sind im haus. " * 9, "en", "guide")]
    docs += [(400 + i, rng.choice(["cat dog.", "sun red hat.", "run."]), "en", "note") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, doc_type string").withColumn("level", F.lit("clash")).withColumn("best", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 if i % 2 else 5) for i in range(40)] + [(1, None), (3, 2), (3, 1), (5, 99), (None, 1)], "doc_id long, reading_level int").withColumn("rater", F.lit("r"))
    out = {r["doc_id"]: (r["reading_level"], r["kind"]) for r in reading.reading_levels(df, labels).collect()}
    assert len(out) == len(docs)
    assert all(out[i][0] == (1 if i % 2 else 5) for i in range(60))
    assert out[100] == out[101] == (None, "blank") and out[102][0] == 5 and out[103] == (None, "type:log") and out[104] == (None, "type:note")
    assert out[300] == (None, "lang:de")
    assert {r["kind"] for r in reading.reading_levels(df, labels.limit(0)).collect()} <= {"blank", "unknown", "lang:de", "type:log", "type:note"}
    assert {r["kind"] for r in reading.reading_levels(df.where("doc_id < 60"), labels.limit(0)).collect()} == {"unknown"}
    assert reading.reading_levels(df.limit(0), labels).count() == 0


def test_many_languages(spark):
    rng = random.Random(5)
    words = {f"l{k:02d}": [f"w{k}x{j}" for j in range(15)] for k in range(15)}
    docs = [(k * 100 + i, " ".join(rng.choices(own, k=40)), lang, "guide") for k, (lang, own) in enumerate(words.items()) for i in range(15 - k + 4)]
    docs += [(9000 + i, "the cat sat on the red mat and saw the sun " * 3, "en", "guide") for i in range(30)]
    untagged = [(8000 + k, " ".join(rng.choices(own, k=40)), None, "guide") for k, own in enumerate(words.values())]
    df = spark.createDataFrame(docs + untagged, "doc_id long, text string, lang string, doc_type string")
    labels = spark.createDataFrame([(9000 + i, 1) for i in range(20)], "doc_id long, reading_level int")
    out = {r["doc_id"]: (r["reading_level"], r["kind"]) for r in reading.reading_levels(df, labels).collect()}
    assert all(out[8000 + k] == (None, f"lang:l{k:02d}" if k < reading.LANGUAGES else reading.OTHER_LANGUAGE) for k in range(15))
    assert all(out[9000 + i][0] == 1 for i in range(30))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/reading_labels.parquet").where("reading_level is not null")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    levels = reading.reading_levels(docs.join(test.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.join(train.select("doc_id").distinct(), "doc_id", "left_semi")), train)
    judged = [(r["reading_level_"], r["reading_level"]) for r in levels.withColumnRenamed("reading_level", "reading_level_").join(test, "doc_id").collect()]
    assert len(judged) > 20 and sum(a is not None and abs(a - b) <= 1 for a, b in judged) >= 0.9 * len(judged)
