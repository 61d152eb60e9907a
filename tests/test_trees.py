"""Trees on a small example."""

from lociflow.operators import trees

TEXT = "((a:1,b:0)x:0,(c:0.5,out:2)y:1)r;"


def test_tree_operations(spark):
    t = trees.read_newick(spark, TEXT)
    assert trees.write_newick(t) == "((a:1,b:0)x:0,(c:0.5,out:2)y:1)r;"
    simple, kept = trees.collapse(trees.zero_short(t, 100))
    assert {r["node"]: r["kept"] for r in kept.collect()} == {"a": "a", "b": "r", "x": "r", "c": "c", "out": "out", "y": "y", "r": "r"}
    assert trees.write_newick(simple) == "(a:1,(c:0.5,out:2)y:1)r;"
    assert {r["node"]: r["distance"] for r in trees.root_tip_distances(t).collect()} == {"a": 1.0, "b": 0.0, "c": 1.5, "out": 3.0}
    turned = trees.without_leaf(trees.reroot(t, "out"), "out")
    assert {r["node"]: r["distance"] for r in trees.root_tip_distances(turned).collect()} == {"a": 3.0, "b": 2.0, "c": 1.5}
