"""Membership labels, paths of containers and bitmap stamps against plain versions."""

import random

from pyspark.sql import functions as F

from tarn.operators import access, bitmaps, containment
from tarn.operators.intervals import points_in_ranges, tree_intervals
from tarn.operators.membership import membership_labels, strong_components


def reach(edges):
    """All (group, member) pairs by walking down from each group."""
    below = {}
    for g, m in edges:
        below.setdefault(g, set()).add(m)
    found = set()
    for g in below:
        todo, seen = list(below[g]), set()
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += below.get(m, ())
        found |= {(g, m) for m in seen if m != g}
    return found


def test_points_meet_the_ranges_that_hold_them(spark):
    draw = random.Random(1)
    for most in (1, 65, 300_000):
        ranges = [(i, *sorted((draw.randrange(most + 1), draw.randrange(most + 1)))) for i in range(12)] + [(99, 0, most)]
        points = [(draw.randrange(most),) for _ in range(60)]
        found = points_in_ranges(
            spark.createDataFrame(points, "p bigint"), spark.createDataFrame(ranges, "r int, low bigint, high bigint"), "p", "low", "high", most
        )
        expected = sorted((p, r) for (p,) in points for r, low, high in ranges if low <= p < high)
        assert sorted((x["p"], x["r"]) for x in found.collect()) == expected


def test_tree_numbers_make_descendants_intervals(spark):
    draw = random.Random(2)
    parent = {i: None if i in (0, 1) else draw.randrange(i) for i in range(60)}
    rows = spark.createDataFrame([(f"x{i:03}", None if p is None else f"x{p:03}") for i, p in parent.items()], "node string, parent string")
    found = {r["node"]: (r["low"], r["high"]) for r in tree_intervals(rows).collect()}
    assert sorted(low for low, _ in found.values()) == list(range(60))

    def above(i):
        return set() if parent[i] is None else {parent[i]} | above(parent[i])

    for a in parent:
        low, high = found[f"x{a:03}"]
        assert {i for i in parent if low <= found[f"x{i:03}"][0] < high} == {i for i in parent if i == a or a in above(i)}


def test_labels_of_a_random_graph(spark):
    draw = random.Random(3)
    names = [f"g{i}" for i in range(12)]
    edges = {(draw.choice(names), draw.choice(names)) for _ in range(16)} | {(draw.choice(names), f"u{draw.randrange(30)}") for _ in range(40)}
    rows = [(g, m) for g, m in edges] + [("g1", None), (None, "u1"), ("g2", "g2")]
    df = spark.createDataFrame(rows, "group_id string, member_principal_id string")
    real = {(g, m) for g, m in edges if g != m}
    pairs = reach(real)
    cycles = {r["node"]: r["component"] for r in strong_components(df.where("group_id IS NOT NULL").select(F.col("member_principal_id").alias("a"), F.col("group_id").alias("b")).dropna()).collect()}
    for a in names:
        for b in names:
            together = (a, b) in pairs and (b, a) in pairs
            assert a == b or together == (a in cycles and cycles.get(a) == cycles.get(b))
    labels = membership_labels(df)
    asked = spark.createDataFrame([(n,) for n in [*names, "u1", "nobody"]], "group_id string")
    assert {tuple(r) for r in labels.members_of(asked).select("group_id", "member_principal_id").collect()} == pairs
    questions = [(g, m) for g in names for m in [*names, "u1", "u2", "u3", "nobody"]]
    answered = labels.is_member(spark.createDataFrame(questions, "group_id string, member_principal_id string")).collect()
    assert {(r["group_id"], r["member_principal_id"]) for r in answered if r["is_member"]} == pairs & set(questions)
    assert len(answered) == len(questions)


def test_a_cycle_of_many_groups_is_one_label(spark):
    ring = [(f"g{i}", f"g{(i + 1) % 40}") for i in range(40)]
    labels = membership_labels(spark.createDataFrame([*ring, ("g3", "u")], "group_id string, member_principal_id string"))
    assert labels.intervals.count() == 2 and labels.count == 2  # not 40 x 40 pairs
    asked = spark.createDataFrame([("g9",)], "group_id string")
    assert labels.members_of(asked).count() == 40


ACL = "source_object_id string, principal_id string, access_level string, effect string, grant_type string, granted_via string, extracted_at int"


def test_grants_by_path_equal_the_closure(spark):
    draw = random.Random(5)
    parents = [(f"o{i}", f"o{draw.randrange(i)}") for i in range(1, 40)] + [("a/b", "o3"), ("a", "o4"), ("a%2Fb", "a"), (None, "o1"), ("o0", None)]
    objects = sorted({o for o, _ in parents if o})
    grants = {
        (draw.choice(objects), draw.choice("pqr"), draw.choice(["read", "write"]), draw.choice(["allow", "deny"])): draw.randrange(99) for _ in range(30)
    }
    acl = spark.createDataFrame([(*k, "direct", None, at) for k, at in grants.items()], ACL)
    tree = spark.createDataFrame(parents, "object_id string, parent_id string")
    paths = containment.object_paths(tree)
    assert paths.count() == len(objects)
    found = containment.effective_grants(spark.createDataFrame([(o,) for o in objects] + [("free",)], "object_id string"), paths, containment.grants_by_path(acl, paths))
    columns = ["source_object_id", "principal_id", "access_level", "effect", "grant_type"]
    expected = access.inherit_acl(acl, tree).select(*columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, expected.collect()))


def test_ranges_of_paths_reach_the_files(spark, capsys):
    tree = spark.createDataFrame([(f"c{i}", f"b{i % 5}") for i in range(50)] + [(f"b{i}", "a") for i in range(5)] + [("x", "y"), ("y", "x"), ("z", "y")], "object_id string, parent_id string")
    paths = containment.object_paths(tree)
    held = containment.under(paths, "a/b3")
    assert sorted(r["object_id"] for r in held.collect()) == sorted(f"c{i}" for i in range(50) if i % 5 == 3)
    held.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(path,a/b3/)" in plan and "LessThan(path,a/b30)" in plan and "Join" not in plan
    # Objects of a cycle, and below one, hang from nowhere.
    assert {r["object_id"]: r["path"] for r in paths.where("object_id in ('x', 'y', 'z')").collect()} == {"x": "x", "y": "y", "z": "z"}


def test_bitmaps_equal_the_grant_table(spark):
    draw = random.Random(6)
    grants = [(f"o{draw.randrange(6)}", f"p{draw.randrange(150)}", draw.choice(["allow", "allow", "deny"])) for _ in range(300)] + [("o1", None, "allow")]
    acl = spark.createDataFrame(grants, "source_object_id string, principal_id string, effect string")
    numbers = bitmaps.number_principals(acl, "principal_id")
    assert sorted(r["number"] for r in numbers.collect()) == list(range(len({p for _, p, _ in grants if p})))
    half = acl.where("effect = 'deny'")
    stamps = bitmaps.merged_stamps(bitmaps.bitmap_stamps(acl.where("effect = 'allow'"), numbers), bitmaps.bitmap_stamps(half, numbers))
    assert sorted(map(tuple, stamps.collect())) == sorted(map(tuple, bitmaps.bitmap_stamps(acl, numbers).collect()))
    counts = {r["source_object_id"]: tuple(r)[1:] for r in bitmaps.stamp_counts(stamps).collect()}
    for o in counts:
        allow = {p for x, p, e in grants if x == o and e == "allow" and p}
        deny = {p for x, p, e in grants if x == o and e == "deny"}
        assert counts[o] == (len(allow), len(deny), len(allow - deny))
    objects = spark.createDataFrame([(f"o{i}",) for i in range(8)], "object string")
    for who in (["p1"], ["p2", "p77", "p149"], ["nobody"]):
        requester = spark.createDataFrame([(w,) for w in who], "principal_id string")
        for default in ("private", "public"):
            seen = bitmaps.visible_by_bitmaps(objects, "object", stamps, requester, numbers, default)
            known = access.visible_by_grants(objects, "object", acl, requester, default)
            assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, known.collect()))


def test_labels_without_cycles_write_the_edges_once(spark, monkeypatch):
    from tarn.operators import membership

    written, real = [], membership.cut_lineage
    monkeypatch.setattr(membership, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    rows = [("z", "s1"), ("z", "s2"), ("s1", "p1"), ("s2", "p1"), ("s2", "p2")]
    labels = membership_labels(spark.createDataFrame(rows, "group_id string, member_principal_id string"))
    assert ["child", "parent"] not in written
    found = labels.members_of(spark.createDataFrame([("z",), ("s1",)], "group_id string")).collect()
    assert sorted(map(tuple, found)) == [("s1", "p1"), ("z", "p1"), ("z", "p2"), ("z", "s1"), ("z", "s2")]


def test_members_of_one_group_are_spread(spark, monkeypatch):
    monkeypatch.setattr("tarn.session.ROWS_A_TASK", 10)
    labels = membership_labels(spark.range(200).selectExpr("'g' group_id", "concat('u', id) member_principal_id"))
    found = labels.members_of(spark.createDataFrame([("g",)], "group_id string"))
    assert found.count() == 200 and found.rdd.getNumPartitions() == 21  # the group's own number too


def test_inherited_grants_are_chosen_once_for_a_container(spark, monkeypatch):
    from tarn.operators import containment

    seen, real = [], containment.keep_latest
    monkeypatch.setattr(containment, "keep_latest", lambda df, *a: seen.append(df.count()) or real(df, *a))
    tree = spark.range(50).selectExpr("concat('o', id) object_id", "'box' parent_id")
    paths = containment.object_paths(tree)
    acl = spark.sql(
        "SELECT 'box' source_object_id, 'u' principal_id, 'read' access_level, 'allow' effect, 'direct' grant_type, "
        "CAST(NULL AS STRING) granted_via, 1 extracted_at UNION ALL SELECT 'o7', 'u', 'read', 'allow', 'direct', NULL, 0"
    )
    found = containment.effective_grants(tree.select("object_id"), paths, containment.grants_by_path(acl, paths))
    kinds = {r["source_object_id"]: r["grant_type"] for r in found.collect()}
    assert len(kinds) == 50 and kinds["o7"] == "direct" and kinds["o8"] == "inherited"
    assert seen == [1]
