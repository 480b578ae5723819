"""Visual parents from confident matches of evenly spaced probes."""

from quadloom.plans.matching import visual_parents


def test_only_confident_majorities_name_a_parent(spark):
    far = lambda k: [1000.0 * (k == i) for i in range(12)]
    rows = [(k, 1, far(k)) for k in range(12)]  # label 1: twelve distinct images
    rows += [(100 + k, 2, [x + 1.0 for x in far(k)]) for k in range(3)]  # three confident votes for 1
    rows += [(200 + k, 3, [x + 1.5 for x in far(5 + k)]) for k in range(2)]  # two votes are too few
    rows += [(300 + k, 4, [500.0] * 12) for k in range(5)]  # nothing near
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = {r.child: (r.parent, r.n_votes, r.n_all) for r in visual_parents(df).collect()}
    # label 1 has three matches in 2 and two in 3
    assert got == {2: (1, 3, 3), 1: (2, 3, 5)}
