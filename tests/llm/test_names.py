from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quire.llm.names import _one_error, cells, components, link_names, nicknames_of, radius_join, spelling_pairs


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_radius_join_is_exact(spark):
    import random

    rng = random.Random(1)
    keys = sorted({"".join(rng.choices("abc", k=rng.randint(3, 7))) for _ in range(400)})
    df = spark.createDataFrame([(1, k) for k in keys], "book_id bigint, key string")
    got = {(r.lkey, r.rkey) for r in radius_join(df, df, ["book_id"]).collect()}
    want = {(a, b) for a in keys for b in keys if levenshtein(a, b) <= 2}
    assert got == want


def test_one_error():
    assert _one_error("abcd", "abdc") and _one_error("abcd", "abd") and _one_error("abcd", "abcdd") and not _one_error("abcd", "badc")


def test_components(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "x", "y"), (2, "a", "z")], "book_id bigint, a string, b string")
    nodes = e.select("book_id", F.col("a").alias("name")).union(e.select("book_id", "b")).distinct()
    got = {(r.book_id, r.name): r.root for r in components(e, nodes).collect()}
    assert got[1, "c"] == "a" and got[1, "y"] == "x" and got[2, "z"] == "a"


def test_links_and_dirty_values(spark):
    speakers = [(1, n) for n in ("Thomas Fennimarsh", "Fennimarsh, Thomas", "Tom", "T. Fennimarsh", "Tohmas Fennimarsh", "narrator", "a voice", None, "", "  ", "Eleanor Marsh", "Thomas Fennimarsh")] + [(None, "Tom"), (2, "Tom"), (1, "苏伯庸"), (1, "苏·伯庸")]
    profiles = [(1, 10, "Aunt Marsh", ["Eleanor Marsh", None]), (1, 10, "Aunt Marsh", ["Eleanor Marsh", None]), (1, 11, None, None)]
    s = spark.createDataFrame(speakers, "book_id bigint, speaker string")
    p = spark.createDataFrame(profiles, "book_id bigint, profile_id bigint, display_name string, aliases array<string>")
    n = spark.createDataFrame([("en", "Thomas", "Tom"), (None, None, None)], "lang string, full_name string, nickname string")
    linked = link_names(s, p, n)
    got = {tuple(r) for r in spelling_pairs(linked).collect()}
    assert {(r.name, r.entity) for r in linked.filter("entity = 'Aunt Marsh'").collect()} == {("Aunt Marsh", "Aunt Marsh"), ("Eleanor Marsh", "Aunt Marsh")}
    thomas = ["Thomas Fennimarsh", "Fennimarsh, Thomas", "Tom", "T. Fennimarsh", "Tohmas Fennimarsh"]
    want = {(1, *sorted(x)) for x in combinations(thomas, 2)} | {(1, "Aunt Marsh", "Eleanor Marsh"), (1, *sorted(("苏伯庸", "苏·伯庸")))}
    assert got == want
    assert link_names(s.limit(0), p.limit(0), n).count() == 0


def test_components_settle_or_fail(spark):
    edges = spark.createDataFrame([(1, f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)], "book_id bigint, a string, b string")
    nodes = spark.createDataFrame([(1, f"n{i:02d}") for i in range(41)], "book_id bigint, name string")
    assert {r.root for r in components(edges, nodes).collect()} == {"n00"}
    with pytest.raises(RuntimeError):
        components(edges, nodes, rounds=2)


def test_replication_of_border_keys(spark):
    import random

    rng = random.Random(2)
    keys = sorted({"".join(rng.choices("abcdefghij", k=rng.randint(9, 16))) for _ in range(3000)})
    df = spark.createDataFrame([(1, k) for k in keys], "book_id bigint, key string")
    home, near = cells(df, df, ["book_id"])
    assert home.count() == len(keys) and home.join(near, ["book_id", "key", "pivot", "ring"]).count() == len(keys)
    pivots = near.select("pivot").distinct().count()
    assert 1 < pivots <= 20 and near.count() <= len(keys) * pivots


def test_a_nickname_list_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.names.NICKNAMES", 2)
    with pytest.raises(ValueError):
        nicknames_of(spark.range(3).selectExpr("'en' AS lang", "concat('a', id) AS full_name", "concat('b', id) AS nickname"))
