"""Golden geometry (independent numpy values) and frame properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orisite.functions.vec import M3
from orisite.operators.frames import to_site_frame
from orisite.operators.sites import orient_sites

TOL = 1e-8


def _positions(spark, a1, a2, a3, siteid=0):
    row = ("e", "A", 0, siteid, "AAA", *a1, *a2, *a3)
    cols = ("entry string, chainid string, rescounter int, siteid int, resname string, "
            + ", ".join(f"a{k}{c} double" for k in (1, 2, 3) for c in "xyz"))
    return spark.createDataFrame([row], cols)


def test_golden_frame_and_local_position(spark):
    ca, c, n = (1.2, -0.4, 0.8), (2.1, 0.7, 0.3), (0.3, 0.9, 1.9)
    cg = orient_sites(_positions(spark, ca, c, n)).collect()[0]
    assert np.allclose([cg.exx, cg.exy, cg.exz], [0.597350980, 0.730095643, -0.331861656], atol=TOL)
    assert np.allclose([cg.eyx, cg.eyy, cg.eyz], [-0.481805701, 0.657506925, 0.579264974], atol=TOL)
    assert np.allclose([cg.ezx, cg.ezy, cg.ezz], [0.641120170, -0.186131662, 0.744526649], atol=TOL)
    atoms = spark.createDataFrame([("e", "A", 0, "AAA", 0, " CB ", 0.9, -1.6, 1.5)],
                                  "entry string, chainid string, rescounter int, resname string, siteid int, "
                                  "atomname string, x double, y double, z double")
    rel = to_site_frame(atoms, orient_sites(_positions(spark, ca, c, n))).collect()[0]
    assert np.allclose([rel.orientedx, rel.orientedy, rel.orientedz],
                       [-1.287623225, -0.238981118, 0.552190598], atol=TOL)


def test_golden_terminus_frame(spark):
    c, o, oxt = (-2.0, 0.5, 1.0), (-1.1, 1.4, 0.2), (-3.0, 1.3, 0.6)
    cg = orient_sites(_positions(spark, c, o, oxt, siteid=-1)).collect()[0]
    assert np.allclose([cg.exx, cg.exy, cg.exz], [0.598671095, 0.598671095, -0.532152084], atol=TOL)
    assert np.allclose([cg.eyx, cg.eyy, cg.eyz], [-0.788813822, 0.556070766, -0.261835937], atol=TOL)
    assert np.allclose([cg.ezx, cg.ezy, cg.ezz], [0.139160610, 0.576522526, 0.805143528], atol=TOL)


def test_frames_orthonormal_right_handed_and_second_director_on_axis(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(50):
        p = rng.normal(size=(3, 3)) * 2
        rows.append(("e", "A", i, 0, "AAA", *map(float, p.ravel())))
    cols = ("entry string, chainid string, rescounter int, siteid int, resname string, "
            + ", ".join(f"a{k}{c} double" for k in (1, 2, 3) for c in "xyz"))
    pos = spark.createDataFrame(rows, cols)
    for r in orient_sites(pos).collect():
        m = np.array([[r.exx, r.exy, r.exz], [r.eyx, r.eyy, r.eyz], [r.ezx, r.ezy, r.ezz]])
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-12)
        assert abs(np.linalg.det(m) - 1) < 1e-12
    atoms = pos.select("entry", "chainid", "rescounter", "resname", "siteid", F.lit(" A2 ").alias("atomname"),
                       F.col("a2x").alias("x"), F.col("a2y").alias("y"), F.col("a2z").alias("z"))
    for r in to_site_frame(atoms, orient_sites(pos)).collect():
        assert r.orientedx > 0 and abs(r.orientedy) < 1e-12 and abs(r.orientedz) < 1e-12


def test_degenerate_sites_dropped(spark):
    a = (0.0, 0.0, 0.0)
    rows = [_positions(spark, a, a, (1.0, 2.0, 3.0)),  # coincident a1, a2
            _positions(spark, a, (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)),  # collinear
            _positions(spark, a, (1.0, 0.0, 0.0), (None, None, None))]  # missing a3
    for df in rows:
        assert orient_sites(df).count() == 0


def test_inverse_closed_form_matches_numpy(spark):
    from orisite.functions.vec import M3, inv3

    rng = np.random.default_rng(3)
    m = rng.normal(size=(3, 3))
    cols = {f"m{r}{c}": float(m["xyz".index(r), "xyz".index(c)]) for r in "xyz" for c in "xyz"}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} double" for k in cols))
    out = df.select(*inv3(M3.named("m")).alias("i")).collect()[0]
    got = np.array([[out[f"i{r}{c}"] for c in "xyz"] for r in "xyz"])
    assert np.allclose(got, np.linalg.inv(m), atol=1e-10)
    sing = spark.createDataFrame([tuple([1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 1.0, 0.0])],
                                 ", ".join(f"{k} double" for k in cols))
    assert all(v is None for v in sing.select(*inv3(M3.named("m")).alias("i")).collect()[0])


def test_eigenvalues_match_numpy(spark):
    from orisite.functions.vec import eigenvalues3

    rng = np.random.default_rng(4)
    mats = [a @ a.T * k for k in (1e-12, 1.0, 1e12) for a in rng.normal(size=(20, 3, 3))]
    mats += [np.diag([2.0, 2.0, 2.0]), np.zeros((3, 3)), np.ones((3, 3)), np.diag([1.0, 1e-9, 1e-18])]
    names = [f"m{r}{c}" for r in "xyz" for c in "xyz"]
    df = spark.createDataFrame([(i, *map(float, m.reshape(-1))) for i, m in enumerate(mats)], ["i", *names])
    got = {r.i: r.e for r in df.select("i", eigenvalues3(M3.named("m")).alias("e")).collect()}
    for i, m in enumerate(mats):
        want = np.linalg.eigvalsh(m)[::-1]
        assert np.allclose(got[i], want, rtol=1e-9, atol=1e-15 * max(want[0], 1e-300)), (i, got[i], want)


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
@pytest.mark.parametrize("shift", [0.0, 1e3])
def test_rank_of_the_predictors(spark, scale, shift):
    """Planar, collinear and constant predictors get NULL under rotation, shift and scaling; others a slope."""
    from orisite.operators.corrections import fit_corrections

    rng, rows = np.random.default_rng(7), []
    slope = rng.normal(size=(3, 3))
    shapes = {"full": (1, 1, 1), "thin": (1, 1, 1e-3), "plane": (1, 1, 0), "line": (1, 0, 0), "point": (0, 0, 0)}
    for name, size in shapes.items():
        for turn in range(4):
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            p = (rng.normal(size=(60, 3)) * size @ q.T + shift) * scale
            rows += [(name, str(turn), *map(float, slope @ (x / scale - shift)), *map(float, x)) for x in p]
    for name, n in (("one", 1), ("three", 3)):  # too few
        rows += [(name, "0", *map(float, rng.normal(size=6))) for _ in range(n)]
    pairs = spark.createDataFrame(rows, "resname string, atomname string, yx double, yy double, yz double, px double, py double, pz double")
    cov = fit_corrections(pairs).collect()
    assert len(cov) == 22
    for r in cov:
        rank = {"full": 3, "thin": 3, "plane": 2, "line": 1, "point": 0, "one": 0, "three": 2}[r.resname]
        assert r["rank"] == rank, r
        fitted = [r[f"slope{a}{b}"] for a in "xyz" for b in "xyz"] + [r.interceptx, r.condition]
        assert all((x is not None) == (rank == 3) for x in fitted)
        if r.resname == "full":
            assert np.allclose(np.array(fitted[:9]).reshape(3, 3) * scale, slope, atol=1e-6) and 1 <= r.condition < 20
        if r.resname == "thin":
            assert 1e5 < r.condition < 1e8
